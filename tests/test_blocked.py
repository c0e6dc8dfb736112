"""Blocked products: the recommenders for all users, with hot products, in small blocks and slices, against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shopcast.operators import banded_topk, blocked, ratings, shared_buyers


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 4), st.lists(st.dictionaries(st.tuples(st.integers(0, 4), st.integers(0, 30)), st.sampled_from([0.5, 1.0, 2.0, 5.0]), max_size=40), max_size=4))
def test_best_keeps_the_largest_and_then_the_smallest_ids(limit, batches):
    best, want, seen = blocked.Best(5, limit), {u: [] for u in range(5)}, set()
    for batch in batches:
        rows = [(u, i, v) for (u, i), v in sorted(batch.items()) if (u, i) not in seen]
        seen |= {(u, i) for u, i, _ in rows}
        for u, i, v in rows:
            want[u].append((-v, i))
        u, i, v = (np.array(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        best.add(0, 5, u, i, v)
    users, ids, values = best.packed(np.arange(5) * 10)
    got = {int(u) // 10: list(zip(i, v, strict=True)) for u, i, v in zip(users, ids.to_pylist(), values.to_pylist(), strict=True)}
    assert got == {u: [(i, -v) for v, i in sorted(w)[:limit]] for u, w in want.items() if w}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 5, 6, 7, 1000, 10**12]), min_size=1, max_size=60))
def test_cells_are_numbered_in_order(cells):
    found, of = blocked.numbered(np.array(cells))
    assert found.tolist() == sorted(set(cells)) and found[of].tolist() == cells


def _grids(monkeypatch):
    """Collects the rows of every grid that runs."""
    rows, run = [], blocked.Grid.run

    def spy(self, df, *args, **kw):
        rows.append((self, df))
        return run(self, df, *args, **kw)

    monkeypatch.setattr(blocked.Grid, "run", spy)
    return rows


def _per_task(df):
    return max(r["count"] for r in df.groupBy("gid").count().collect())


@pytest.mark.parametrize(("k", "limit", "block", "width", "entries"), [(40, 50, 16_384, 16_384, 1 << 21), (3, 6, 10, 5, 200), (5, 8, 7, 1000, 10_000)])
def test_predictions_with_an_item_that_everybody_rated(spark, monkeypatch, k, limit, block, width, entries):
    """Item 0 is rated by everybody and user 0 rated everything; no task sees a row per term of the product."""
    rnd, users, items = random.Random(k), 60, 45
    r = {(u, 0): float(rnd.randint(1, 5)) for u in range(users)} | {(0, i): float(rnd.randint(1, 5)) for i in range(items)}
    r |= {(rnd.randrange(users), rnd.randrange(items - 3)): rnd.choice([1.0, 2.5, 4.0, 5.0]) for _ in range(250)}
    known = {(u, rnd.randrange(items)) for u in range(users) for _ in range(2)} | set(list(r)[::2])
    products = [*range(1, items + 4)]  # some that nobody rated; item 0 is not sold any more
    df = spark.createDataFrame([(*x, v) for x, v in r.items()], "user_id long, product_id long, rating double")
    sim_df = ratings.item_similarity(df)
    sim = {(x.item_i, x.item_j): round(x.similarity, 9) for x in sim_df.collect()}
    want = {}
    for u in range(users + 1):
        pred = []
        for i in set(products) - {p for v, p in known if v == u}:
            near = sorted(((-sim[i, j], j) for j in range(items) if (u, j) in r and sim.get((i, j), 0) > 0))[:k]
            e = sum(-s * r[u, j] for s, j in near) / -sum(s for s, _ in near) if near else 3.3
            pred.append((-round(min(5.0, max(1.0, e)), 9), i))
        want[u] = [(i, pytest.approx(-p, abs=2e-9)) for p, i in sorted(pred)[:limit]]
    grids = _grids(monkeypatch)
    everybody = spark.createDataFrame([(u,) for u in range(users + 1)], "user_id long")
    out = ratings.predict_all(df, sim_df, spark.createDataFrame(list(known), "user_id long, product_id long"), spark.createDataFrame([(p,) for p in products], "product_id long"),
                              everybody, 3.3, limit, k, block, width, entries)
    got = {u: [] for u in range(users + 1)}
    for x in out.orderBy("user_id", (-out.prediction), "product_id").collect():
        got[x.user_id].append((x.product_id, x.prediction))
    assert got == want
    (grid, rows), = grids
    if block < users:
        assert grid.blocks > 1
    # Packed rows of a task: its users, and for each slice its columns and at most one row per item.
    in_block = max(x["count"] for x in everybody.groupBy(grid.block("user_id")).count().collect())
    assert _per_task(rows) <= in_block + grid.slices * (items + 1)


def test_a_user_with_more_terms_than_a_task_should_hold(monkeypatch):
    monkeypatch.setattr(ratings, "TERMS", 20)
    rng = np.random.default_rng(1)
    items, width = 30, 12
    weight = np.round(rng.random((items, width)), 3) * (rng.random((items, width)) < 0.8)
    row, col = np.nonzero(weight)
    near = ratings.Neighbours(np.arange(items), blocked.starts(np.bincount(row, minlength=items)), col, weight[row, col], width)
    rating = rng.integers(1, 6, items).astype(float)
    cell, estimate = ratings._sums(near, np.zeros(items, np.int64), np.arange(items), np.arange(items), rating, 4)
    for c, e in zip(cell, estimate, strict=True):
        best = sorted(((-weight[j, c], j) for j in range(items) if weight[j, c]))[:4]
        assert e == pytest.approx(sum(-w * rating[j] for w, j in best) / -sum(w for w, _ in best))
    assert cell.tolist() == np.flatnonzero(weight.any(axis=0)).tolist()


def _shared(lines, requested, factor, limit, least=0):
    own = {u: {p for v, p in lines if v == u} for u in {v for v, _ in lines}}
    want = set()
    for u in requested:
        n = {}
        for v in own:
            if v != u and own.get(u, set()) & own[v]:
                for p in own[v] - own[u]:
                    n[p] = n.get(p, 0) + lines[v, p]
        best = sorted((-c * factor[p], p) for p, c in n.items() if p in factor and c * factor[p] >= least)
        want |= {(u, p, -c) for c, p in best[:limit]}
    return want


@pytest.mark.parametrize(("hot", "block", "width", "everybody"), [(512, 1024, 16_384, 0), (10, 1024, 16_384, 50), (10, 13, 9, 50), (4, 11, 20, 70), (0, 17, 1000, 3)])
def test_shared_buyers_with_products_that_everybody_bought(spark, monkeypatch, hot, block, width, everybody):
    """The first products are bought by (nearly) everybody; no pair of their buyers becomes a row."""
    rnd, users = random.Random(hot + block), 80
    lines = {(u, p): rnd.randint(1, 3) for u in range(users) for p in range(everybody) if rnd.random() < 0.97}
    lines |= {(rnd.randrange(users), everybody + rnd.randrange(60)): rnd.randint(1, 3) for _ in range(150)}
    factor = {p: rnd.randint(1, 3) for p in range(everybody + 55)}
    requested = list(range(0, users + 2, 2))
    buy = spark.createDataFrame([(*x, n) for x, n in lines.items()], "user_id long, product_id long, lines long")
    mine = buy.where("user_id % 2 = 0")
    grids = _grids(monkeypatch)
    out = shared_buyers.shared_buyer_counts(buy, mine, spark.createDataFrame(list(factor.items()), "product_id long, factor long"), 6, hot, 3, block, width)
    assert {tuple(r) for r in out.collect()} == _shared(lines, requested, factor, 6, 3)
    (grid, rows), = grids
    packed = rows.count()
    cold = [p for p in {p for _, p in lines} if sum(q == p for _, q in lines) <= hot]
    pairs = sum(sum(q == p for _, q in lines) ** 2 for p in cold)
    slots = grid.parts * grid.slices
    # Users and patterns once per block and slot, light pairs at most once per slot: linear in the purchases.
    assert packed <= users * grid.parts + slots * grid.blocks * (users + 1) + slots * pairs


@pytest.mark.parametrize(("hot", "terms"), [(512, 1 << 21), (512, 7), (6, 1 << 21), (6, 7)])
def test_shared_buyers_travel_by_user_and_block(spark, monkeypatch, hot, terms):
    """Users without a hot product: a user's purchases go once to each block where a product is shared, and nothing goes to all blocks."""
    monkeypatch.setattr(shared_buyers, "TERMS", terms)
    monkeypatch.setattr(shared_buyers, "USERS", 3)
    rnd, users = random.Random(hot + terms), 60
    lines = {(u, 10 * (u // 5) + rnd.randrange(10)): rnd.randint(1, 300) for u in range(users) for _ in range(3)}
    lines |= {(u, 1000): 2 for u in range(0, users, 4)} | {(u, 2000 + u): 1 for u in range(users)}
    factor = {p: rnd.randint(0, 3) for p in {p for _, p in lines} if rnd.random() < 0.9} | dict.fromkeys(range(5000, 6000), 1)
    buy = spark.createDataFrame([(*x, n) for x, n in lines.items()], "user_id long, product_id long, lines long")
    mine = buy.where("user_id % 3 > 0")
    grids = _grids(monkeypatch)
    out = shared_buyers.shared_buyer_counts(buy, mine, spark.createDataFrame(list(factor.items()), "product_id long, factor long"), 4, hot, 2)
    want = _shared(lines, [u for u in range(users) if u % 3], factor, 4, 2)
    assert {tuple(r) for r in out.collect()} == {x for x in want if x[2] > 0}
    grid, rows = grids[0]
    assert grid.blocks > 5 and len(grids) == (1 if hot > 100 else 2)
    sharing = {(v, u) for u, p in lines for v, q in lines if p == q}
    got = [(r.key, r.gid) for r in rows.select("key", "gid").collect()]
    assert len(got) == len(set(got)) <= len(sharing)


def test_patterns_meet_where_they_share_a_bit():
    rng = np.random.default_rng(3)
    sets = [sorted(set(rng.integers(0, 300, n).tolist())) for n in (0, 1, 3, 40, 0, 5, 200)]
    words = []
    for s in sets:
        places = sorted({x // 64 for x in s})
        values = [sum(1 << (x % 64) for x in s if x // 64 == p) for p in places]
        words.append([y for p, v in zip(places, values, strict=True) for y in (p, v - 2**64 if v >= 2**63 else v)])
    flat, lengths = np.array([x for w in words for x in w], np.int64), np.array([len(w) for w in words])
    p = shared_buyers._Patterns(flat, lengths)
    meet = p.meet(flat, lengths)
    for i, a in enumerate(sets):
        assert (p.of[i] < 0) == (not a)
        assert p.of[i] < 0 or meet[p.of[i]].tolist() == [bool(set(a) & set(b)) for b in sets]


@pytest.mark.parametrize(("values", "chunk", "salt", "seen"), [((3.0,), 1 << 16, 1 << 16, 256), ((3.0,), 11, 7, 2), (None, 16, 1 << 16, 3), ((1.0, 3.0, 3.0, 4.5), 40, 5, 0)])
def test_score_lists_when_users_share_their_mean(spark, values, chunk, salt, seen):
    """All users at mean 3.0: one list, salted; and as many means as users. User 0 excludes nearly everything."""
    rnd = random.Random(chunk)
    items = spark.createDataFrame([(i, f"p{i}", float(rnd.choice([-1, 0, 1, 2, 5, 40])), rnd.choice([0.0, 1.0, 2.5, 3.0, 5.0])) for i in range(100)], "product_id long, name string, w double, c double")
    users = spark.createDataFrame([(u, rnd.choice(values) if values else 1 + rnd.random() * 4) for u in range(60)], "user_id long, a double")
    excl = spark.createDataFrame([(u, rnd.randrange(110)) for u in range(1, 60) for _ in range(rnd.randrange(9))] + [(0, p) for p in range(3, 100)], "user_id long, product_id long")
    kw = dict(weight="w", centre="c", user_value="a", k=5)
    fast = banded_topk.banded_topk(items, users, excl, bands=4, chunk=chunk, salt=salt, seen=seen, **kw)
    slow = banded_topk.brute_force_topk(items, users, excl, **kw)
    cols = ["user_id", "product_id", "name", "w", "c", "score"]
    assert sorted(map(tuple, fast.select(*cols).collect())) == sorted(map(tuple, slow.select(*cols).collect()))
    assert [r.product_id for r in fast.where("user_id = 0").orderBy("product_id").collect()] == [0, 1, 2]


def test_cross_validation_makes_the_pairs_once(spark, monkeypatch):
    """One self-join for all folds, and the result of training each fold apart."""
    rnd = random.Random(8)
    r = {(rnd.randrange(12), rnd.randrange(15)): float(rnd.randint(1, 5)) for _ in range(110)}
    df = spark.createDataFrame([(*x, v) for x, v in r.items()], "user_id long, product_id long, rating double")
    plans, written = [], ratings.materialize
    monkeypatch.setattr(ratings, "materialize", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or written(d))
    got = {x.fold: x for x in ratings.cross_validate(df, k=3).collect()}
    assert sum("item_i" in p and "item_j" in p and "Join" in p and "__sim" not in p for p in plans) == 1
    for f in range(3):
        fold = {x: (x[0] * 31 + x[1]) % 3 for x in r}
        train = {x: v for x, v in r.items() if fold[x] != f}
        mean, errors = sum(train.values()) / len(train), []
        for (u, i), v in r.items():
            if fold[u, i] != f:
                continue
            near = []
            for j in {p for w, p in train if w == u}:
                both = [(train[w, i], train[w, j]) for w in range(12) if (w, i) in train and (w, j) in train]
                if both:
                    near.append((-round(sum(a * b for a, b in both) / (sum(a * a for a, _ in both) * sum(b * b for _, b in both)) ** 0.5, 9), j))
            near = sorted(near)[:3]
            e = sum(-s * train[u, j] for s, j in near) / -sum(s for s, _ in near) if near else mean
            errors.append(min(5.0, max(1.0, e)) - v)
        assert got[f].n == len(errors)
        assert got[f].mae == pytest.approx(sum(map(abs, errors)) / len(errors), abs=2e-6)
        assert got[f].rmse == pytest.approx((sum(e * e for e in errors) / len(errors)) ** 0.5, abs=2e-6)


def test_the_share_of_compared_pairs_falls_with_the_number_of_items(spark):
    """√n cells in a tree of two levels: four times the items, a smaller share of the pairs, and the answer of all pairs."""
    from shopcast.operators import knn
    rng, share = np.random.default_rng(7), []
    for n in (1200, 4800):
        x = rng.normal(size=(n, 3))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
        q, visits = df.where("id < 60"), []
        got = {}
        for r in knn.cosine_topk(q, df, 5, block=200, visits=visits).collect():
            got.setdefault(r.query_id, set()).add(r.item_id)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        sim = np.round(unit @ unit.T, 9)
        np.fill_diagonal(sim, -2)
        assert all(got[i] == set(np.argsort(-sim[i], kind="stable")[:5].tolist()) for i in range(60))
        share.append(visits[0] / visits[1])
    print(f"share of pairs compared: {share}")
    assert share[1] < 0.75 * share[0] < 0.2


@pytest.mark.parametrize(("terms", "ratings_of_a_block"), [(1 << 21, 1 << 23), (40, 60)])
def test_cross_validation_writes_lists_of_ratings_only(spark, monkeypatch, terms, ratings_of_a_block):
    """Item 0 is rated by everybody and user 0 rated everything: the same errors by brute force, and no pair of items is written as a row."""
    monkeypatch.setattr(ratings, "TERMS", terms)
    monkeypatch.setattr(ratings, "RATINGS", ratings_of_a_block)
    rnd, written, write = random.Random(5), [], ratings.materialize
    monkeypatch.setattr(ratings, "materialize", lambda df: written.append(write(df)) or written[-1])
    r = {(u, 0): float(rnd.randint(1, 5)) for u in range(25)} | {(0, i): float(rnd.randint(1, 5)) for i in range(20)}
    r |= {(rnd.randrange(25), rnd.randrange(20)): rnd.choice([1.0, 2.5, 4.0, 5.0]) for _ in range(90)} | {(40, 77): 2.0}
    df = spark.createDataFrame([(*x, v) for x, v in r.items()], "user_id long, product_id long, rating double")
    fold, errors = {x: (x[0] * 31 + x[1]) % 3 for x in r}, {0: [], 1: [], 2: []}
    for f in range(3):
        train = {x: v for x, v in r.items() if fold[x] != f}
        sim = {}
        for i in range(20):
            for j in range(20):
                both = [(train[u, i], train[u, j]) for u in range(25) if (u, i) in train and (u, j) in train]
                if both and i != j:
                    sim[i, j] = round(sum(a * b for a, b in both) / (sum(a * a for a, _ in both) * sum(b * b for _, b in both)) ** 0.5, 9)
        for (u, i), v in r.items():
            if fold[u, i] == f:
                near = sorted((-sim[i, j], j) for j in range(20) if (u, j) in train and (i, j) in sim)[:4]
                e = sum(-s * r[u, j] for s, j in near) / -sum(s for s, _ in near) if near else sum(train.values()) / len(train)
                errors[f].append(min(5.0, max(1.0, e)) - v)
    got = {x.fold: (x.rmse, x.mae, x.n) for x in ratings.cross_validate(df, 3, 4).collect()}
    assert got == {f: (pytest.approx((sum(x * x for x in e) / len(e)) ** 0.5, abs=2e-6), pytest.approx(sum(map(abs, e)) / len(e), abs=2e-6), len(e)) for f, e in errors.items()}
    assert all(w.count() <= len(r) for w in written)


def test_changes_of_sums_travel_once(spark):
    """The old sums and the changes are added up in one aggregate by pair."""
    df = spark.createDataFrame([(u, i, float(1 + (u * i) % 5)) for u in range(6) for i in range(5)], "user_id long, product_id long, rating double")
    changes = spark.createDataFrame([(1, 2, None), (2, 3, 1.5), (7, 1, 2.0), (7, 2, 3.0)], "user_id long, product_id long, rating double")
    old = ratings.materialize(ratings.pair_statistics(df))
    new = ratings.update_statistics(old, df, changes)
    plan = new._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate(keys=[item_i#") == 2  # partial and final
    want = {(x.item_i, x.item_j): (x.n, pytest.approx(x.sij), pytest.approx(x.sii), pytest.approx(x.sjj)) for x in ratings.pair_statistics(ratings.update_ratings(df, changes)).collect()}
    assert {(x.item_i, x.item_j): (x.n, x.sij, x.sii, x.sjj) for x in new.collect()} == want


def _ratings_with_hot_items(seed, users=30, items=24):
    """Item 0 is rated by everybody and user 0 rated everything."""
    rnd = random.Random(seed)
    r = {(u, 0): float(rnd.randint(1, 5)) for u in range(users)} | {(0, i): float(rnd.randint(1, 5)) for i in range(items)}
    return r | {(rnd.randrange(users), rnd.randrange(items)): rnd.choice([0.0, 1.0, 2.5, 4.0, 5.0]) for _ in range(110)}


def _pair_sums(r):
    want = {}
    for (u, i), x in r.items():
        for (v, j), y in r.items():
            if u == v and i != j:
                want[i, j] = [a + b for a, b in zip(want.get((i, j), (0, 0, 0, 0)), (1, x * y, x * x, y * y), strict=True)]
    return want


@pytest.mark.parametrize(("terms", "ratings_of_a_block", "heavy"), [(1 << 21, 1 << 23, 2000), (30, 100, 2000), (30, 100, 5), (1 << 21, 300, 2000)])
def test_pairs_are_summed_in_blocks_of_items(spark, monkeypatch, terms, ratings_of_a_block, heavy):
    """No pair is shuffled before its sums are whole, but for those of an item that everybody rated; NULL keys pair with nothing."""
    monkeypatch.setattr(ratings, "TERMS", terms)
    monkeypatch.setattr(ratings, "RATINGS", ratings_of_a_block)
    r = _ratings_with_hot_items(3)
    df = spark.createDataFrame([(*x, v) for x, v in r.items()] + [(None, 3, 2.0), (None, 4, 2.0), (5, None, 1.0)], "user_id long, product_id long, rating double")
    want = _pair_sums(r)
    got = ratings.pair_statistics(df, heavy)
    assert {(x.item_i, x.item_j): tuple(x)[2:] for x in got.collect()} == {k: pytest.approx(v) for k, v in want.items() if k[0] < k[1]}
    assert got.count() == sum(i < j for i, j in want)
    hot = ratings._terms(df, df)[1]
    if ratings_of_a_block == 100:
        assert {0} <= {x.product_id for x in hot.collect()}
    if hot is None:
        for plan in (got, ratings.item_similarity(df, heavy=heavy)):
            assert "keys=[item_i#" not in plan._jdf.queryExecution().sparkPlan().toString()
    cosine = {k: v[1] / (v[2] * v[3]) ** 0.5 if v[2] > 0 and v[3] > 0 else 0.0 for k, v in want.items()}
    assert {(x.item_i, x.item_j): x.similarity for x in ratings.item_similarity(df, heavy=heavy).collect()} == {k: pytest.approx(v) for k, v in cosine.items()}
    of = spark.createDataFrame([(0,), (7,), (7,), (99,)], "product_id long")
    assert {(x.item_i, x.item_j): x.similarity for x in ratings.item_similarity(df, of, heavy).collect()} == {k: pytest.approx(v) for k, v in cosine.items() if k[1] in (0, 7)}


@pytest.mark.parametrize(("k", "limit", "most", "held", "terms", "ratings_of_a_block"), [(40, 50, None, 1 << 24, 1 << 21, 1 << 23), (3, 6, 1, 1 << 24, 1 << 21, 1 << 23), (3, 6, 1, 60, 40, 100), (5, 8, 2, 400, 1 << 21, 300)])
@pytest.mark.parametrize("few", [False, True])
def test_predictions_write_no_similarities(spark, monkeypatch, k, limit, most, held, terms, ratings_of_a_block, few):
    """As by brute force, also where a part has more of a user's best than it gives at first; what is written is linear in ratings and users."""
    monkeypatch.setattr(ratings, "TERMS", terms)
    monkeypatch.setattr(ratings, "RATINGS", ratings_of_a_block)
    rnd, users = random.Random(k), 30
    r = {x: v for x, v in _ratings_with_hot_items(k).items() if v > 0}
    asked = [*range(0, users + 2, 2)] if few else [*range(users + 2)]
    known = set(list(r)[::2]) | {(u, rnd.randrange(28)) for u in range(users) for _ in range(2)}
    products = [*range(1, 30)]  # some that nobody rated; item 0 is not sold any more
    sim = {x: round(v[1] / (v[2] * v[3]) ** 0.5, 9) for x, v in _pair_sums(r).items()}
    want = {}
    for u in asked:
        pred = []
        for i in set(products) - {p for v, p in known if v == u}:
            near = sorted(((-sim[i, j], j) for j in range(24) if (u, j) in r and (i, j) in sim))[:k]
            pred.append((-round(min(5.0, max(1.0, sum(-s * r[u, j] for s, j in near) / -sum(s for s, _ in near) if near else 3.3)), 9), i))
        want[u] = [(i, pytest.approx(-p, abs=2e-9)) for p, i in sorted(pred)[:limit]]
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    df = frame([(*x, v) for x, v in r.items()], "user_id long, product_id long, rating double")
    mine = df.where(df.user_id.isin(asked))
    written, write = [], ratings.materialize
    monkeypatch.setattr(ratings, "materialize", lambda d: written.append(write(d)) or written[-1])
    out = ratings.predict_from_ratings(df, mine, frame([x for x in known if x[0] in asked], "user_id long, product_id long"), frame([(p,) for p in products], "product_id long"),
                                       frame([(u,) for u in asked], "user_id long"), 3.3, limit, k, few, held, 2000, most)
    got = {u: [] for u in asked}
    for x in out.orderBy("user_id", (-out.prediction), "product_id").collect():
        got[x.user_id].append((x.product_id, x.prediction))
    assert got == want
    assert written and all(w.count() <= len(r) for w in written)
    if most:
        assert sum("best" in w.columns for w in written) == 2


@pytest.mark.parametrize(("strip", "items"), [(1 << 24, "all"), (1000, "all"), (1 << 24, "near")])
def test_isotropic_vectors_meet_in_blocks(spark, monkeypatch, strip, items):
    """Cells rule out nothing: queries don't travel once per cell, and ties, copies and zero vectors come as by brute force."""
    from shopcast.operators import knn
    monkeypatch.setattr(knn, "STRIP", strip)
    monkeypatch.setattr(knn, "WHOLE", 150)
    rng, k = np.random.default_rng(5), 4
    x = rng.normal(size=(500, 24))
    x[20], x[33], x[34] = x[7], 3 * x[7], 0
    if items == "near":  # similarities that single precision can't tell apart
        x[100:140] = x[8] + 1e-7 * rng.normal(size=(40, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    written, write = [], knn.materialize
    monkeypatch.setattr(knn, "materialize", lambda d: written.append(write(d)) or written[-1])
    got, visits = {}, []
    for r in knn.cosine_topk(df, df, k, block=100, visits=visits).collect():
        got.setdefault(r.query_id, []).append((-r.similarity, r.item_id))
    norm = np.sqrt((x * x).sum(axis=1))
    sim = np.round((x @ x.T) / np.where(norm > 0, norm, 1.0)[:, None] / np.where(norm > 0, norm, 1.0), 9)
    for i in range(500):
        want = sorted((-s, j) for j, s in enumerate(sim[i]) if j != i)[:k]
        assert [s for s, _ in sorted(got[i])] == pytest.approx([s for s, _ in want], abs=2e-9)
        if items == "all":
            assert [j for _, j in sorted(got[i])] == [j for _, j in want]
    assert visits[0] >= visits[1] and all(w.count() <= 500 * max(k, knn.FIRST) for w in written)

"""What large jobs leave on disk: packed values, waves, removed shuffles, and the same results."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopcast import session
from shopcast.operators import blocked, ratings, shared_buyers


def _files(top):
    return sum(os.path.getsize(f"{at}/{f}") for at, _, names in os.walk(top) for f in names if f.startswith("shuffle_"))


def _shuffled(spark):
    """Bytes of the session's shuffle files."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(_files(d.getAbsolutePath()) for d in dirs)


def _ratings(spark, seed, users=40, items=30):
    rnd = random.Random(seed)
    r = {(rnd.randrange(users), rnd.randrange(items)): rnd.choice([1.0, 2.5, 4.0, 5.0]) for _ in range(260)}
    return spark.createDataFrame([(*x, v) for x, v in r.items()], "user_id long, product_id long, rating double")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-2**62, 2**62), max_size=30), min_size=1, max_size=4), st.lists(st.floats(allow_nan=False), max_size=30))
def test_packed_arrays_come_back(ints, floats):
    arrays = [np.array(x, np.int64) for x in ints] + [np.array(floats, float), blocked.narrow(np.array([0, 300] * len(ints))), np.array([True, False])]
    for packed in (arrays, [*arrays, np.array(["a", None], object)]):
        back = blocked.unpack(blocked.pack(*packed))
        assert [x.dtype for x in back] == [x.dtype for x in packed] and all((x == y).all() for x, y in zip(back, packed, strict=True))


def test_ratings_take_few_bytes():
    rng = np.random.default_rng(1)
    item, rating = rng.integers(0, 1_000_000, 20_000), rng.choice([4.0, 1.0, 11 / 3], 20_000)
    assert len(blocked.pack(item, rating)) < 5 * 20_000  # 16 as numbers


def test_waves_cover_all_cells_and_hold_few_copies(monkeypatch):
    monkeypatch.setattr(blocked, "WAVE", 100)
    for cells, copies, entries, tasks in ((180, 36_000, 200, 8), (5, 10, 10, 8), (31, 31 * 900, 900, 4), (7, 1e9, 1, 2)):
        got = blocked.waves(cells, copies, entries, tasks)
        assert [c for low, high in got for c in range(low, high)] == [*range(cells)]
        most = max(high - low for low, high in got)
        assert most <= max(2 * tasks, 2 * cells * max(100, 4 * entries) / copies)


def test_what_was_shuffled_for_a_written_frame_is_removed(spark):
    before = _shuffled(spark)
    df = spark.range(200_000).groupBy((F.col("id") * 7919 % 150_000).alias("k")).agg(F.sum("id").alias("x"))
    for write in (session.materialize, session.compact):
        got = write(df)
        assert got.count() == 150_000 and got.schema == df.schema
        assert spark.conf.get(session.REMOVE_SHUFFLES) == "false"
    rows = spark.createDataFrame([(1, None, [1.5], "ä"), (None, 2.0, [], None)], "a int, b double, c array<double>, d string")
    assert sorted(session.compact(rows).collect(), key=str) == sorted(rows.collect(), key=str)
    assert _shuffled(spark) - before < 1_000_000  # one frame's rows alone are more


@pytest.mark.parametrize("most", [None, 1])
def test_predictions_in_waves(spark, monkeypatch, most):
    """Parts in several waves: the same lists as in one, and no wave has users pass by more parts than its own."""
    r = _ratings(spark, 3)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    args = (r, r, r.select("user_id", "product_id"), frame([(p,) for p in range(33)], "product_id long"), frame([(u,) for u in range(42)], "user_id long"), 3.3, 7)
    want = {tuple(x) for x in ratings.predict_from_ratings(*args, held=400).collect()}
    ran, packed = [], blocked.Grid.packed
    monkeypatch.setattr(blocked.Grid, "packed", lambda self, rows, *a, **kw: ran.append((kw["wave"], rows)) or packed(self, rows, *a, **kw))
    monkeypatch.setattr(blocked, "WAVE", 1)
    assert {tuple(x) for x in ratings.predict_from_ratings(*args, held=400, most=most).collect()} == want
    assert len(ran) > 1
    for (low, high), rows in ran:
        assert {x.gid for x in rows.select("gid").distinct().collect()} <= set(range(low, high))


def test_attached_columns_are_those_of_a_join(spark):
    """Repeated and missing ids, NULL keys, many entries of one id, and as many rows as a join gives."""
    rnd = random.Random(2)
    info = spark.createDataFrame([(p, f"n{p}", p / 2, [p]) for p in range(0, 90, 2)] + [(4, "again", None, None), (None, "nobody", 1.0, None), (-7, None, 2.0, [1])], "p long, name string, price double, l array<long>")
    lists = [(u, [4, *rnd.sample(range(-10, 100), rnd.randrange(8))], None) for u in range(300)] + [(1000, [], None)]
    lists = [(u, ids, [rnd.random() for _ in ids]) for u, ids, _ in lists]
    df = spark.createDataFrame(lists, blocked.PACKED)
    want = df.select("user_id", F.explode(F.arrays_zip("ids", "vals")).alias("e")).select("user_id", F.col("e.ids").alias("p"), F.col("e.vals").alias("score")).join(info, "p")
    got = blocked.attach(df, info, "p", "score")
    cols = ["user_id", "score", "p", "name", "price", "l"]
    assert got.columns == cols and sorted(map(str, got.collect())) == sorted(map(str, want.select(*cols).collect()))


@pytest.mark.parametrize(("pair_rows", "ratings_of_a_block"), [(1 << 23, 1 << 23), (60, 1 << 23), (60, 100)])
def test_sums_are_updated_in_waves(spark, monkeypatch, pair_rows, ratings_of_a_block):
    """Item 0 is rated by everybody, user 0 rated everything; the result is that of summing anew, and some items' rows are shuffled at a time."""
    before = _ratings(spark, 5).unionByName(spark.createDataFrame([(u, 90, 2.0) for u in range(40)] + [(90, i, 3.0) for i in range(30)], "user_id long, product_id long, rating double"))
    changes = spark.createDataFrame([(u, p, v) for u in (0, 3, 7, 90) for p, v in ((90, None), (1, 1.5), (29, 4.0))] + [(200, 1, 2.0), (200, 2, 3.0)], "user_id long, product_id long, rating double")
    after = ratings.update_ratings(before, changes)
    old, want = session.materialize(ratings.pair_statistics(before)), {tuple(x)[:3]: pytest.approx(tuple(x)[3:]) for x in ratings.pair_statistics(after).collect()}
    for name, value in (("PAIR_ROWS", pair_rows), ("RATINGS", ratings_of_a_block), ("TERMS", 50)):
        monkeypatch.setattr(ratings, name, value)
    written, compact = [], ratings.compact
    monkeypatch.setattr(ratings, "compact", lambda *d: written.append(len(d)) or compact(*d))
    got = ratings.update_statistics(old, before, changes)
    assert {tuple(x)[:3]: tuple(x)[3:] for x in got.collect()} == want
    assert (written[-1] > 10) == (pair_rows == 60)


@pytest.mark.parametrize("factor", [1, 3])
def test_similar_users_in_waves(spark, monkeypatch, factor):
    """Blocks in several waves: the same lists as in one, with names attached; what a wave sends are compressed values, one for a block and batch of users at most."""
    rnd = random.Random(9)
    lines = {(u, rnd.randrange(70)): rnd.randint(1, 300) for u in range(90) for _ in range(4)}
    buy = spark.createDataFrame([(*x, n) for x, n in lines.items()], "user_id long, product_id long, lines long")
    products = spark.createDataFrame([(p, factor) for p in range(60)], "product_id long, factor long")
    info = spark.createDataFrame([(p, f"n{p}") for p in range(58)] + [(5, "again")], "product_id long, name string")
    args = (buy, buy.where("user_id % 3 > 0"), products, 5, 512, 2)
    monkeypatch.setattr(shared_buyers, "USERS", 3)
    want = shared_buyers.shared_buyer_counts(*args)
    named = want.join(info, "product_id").select("user_id", "product_id", "n", "name")
    ran, run = [], blocked.Grid.run
    monkeypatch.setattr(blocked.Grid, "run", lambda self, rows, *a, **kw: ran.append((kw["wave"], rows)) or run(self, rows, *a, **kw))
    monkeypatch.setattr(blocked, "WAVE", 1)
    monkeypatch.setattr(blocked, "COPIES", 1)
    assert sorted(shared_buyers.shared_buyer_counts(*args).collect()) == sorted(want.collect())
    assert len(ran) > 1
    for (low, high), rows in ran:
        sent = [(x.key, x.gid) for x in rows.select("key", "gid").collect()]
        assert len(set(sent)) == len(sent) and {gid for _, gid in sent} <= set(range(low, high))
    got = shared_buyers.shared_buyer_counts(*args, info=info)
    assert got.columns == ["user_id", "product_id", "n", "name"] and sorted(got.collect()) == sorted(named.collect())


def test_cross_validation_in_waves(spark, monkeypatch):
    """Blocks in several waves: the same errors as in one, and the ratings are written once, not once for a block."""
    r = _ratings(spark, 4)
    monkeypatch.setattr(ratings, "RATINGS", 60)
    want = sorted(ratings.cross_validate(r, 3, 4).collect())
    written, write = [], ratings.materialize
    monkeypatch.setattr(ratings, "materialize", lambda d: written.append(write(d)) or written[-1])
    monkeypatch.setattr(blocked, "WAVE", 1)
    got = sorted(ratings.cross_validate(r, 3, 4).collect())
    assert [(x.fold, x.n) for x in got] == [(x.fold, x.n) for x in want] and [(x.rmse, x.mae) for x in got] == [pytest.approx((x.rmse, x.mae), abs=2e-6) for x in want]
    errors = [w for w in written if "fold" in w.columns]
    assert len(errors) > 1 and not any("block" in w.columns for w in written)

"""Recommendation strategies on literal fixtures (hand-computed answers) and against brute force."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from helpers import tables, ts
from shopcast import session
from shopcast.operators import ratings as rt
from shopcast.operators import spine
from shopcast.plans import recommend, training
from shopcast.session import published
from shopcast.sources.tables import ingest_records, normalize, read_records


def _fanout(spark):
    # product 1: details 2 + 3 units in completed sales, three reviews 4, 5, 3
    return tables(
        spark,
        product=[(1, "p1", 10.0), (2, "p2", 20.0)],
        stock=[(10, 1), (20, 2)],
        sale=[(100, 7, "completed", 50.0, ts(2001, 7, 20)), (101, 8, "completed", 30.0, ts(2001, 7, 25))],
        sale_detail=[(100, 10, 2.0), (101, 10, 3.0)],
        review=[(1, 7, 1, 4.0), (2, 8, 1, 5.0), (3, 9, 1, 3.0)],
        users=[(7, "a@x"), (8, "b@x"), (9, "c@x")],
    )


def test_fanout_corrected_and_reference(spark):
    t = _fanout(spark)
    c = {r.product_id: r for r in recommend.popular_products(t).collect()}
    ref = {r.product_id: r for r in recommend.popular_products(t, semantics="reference").collect()}
    assert c[1].total_purchases == 5 and ref[1].total_purchases == 15
    assert c[1].average_rating == pytest.approx(4.0) == ref[1].average_rating
    assert c[2].total_purchases == 0 and c[2].average_rating == 0.0


def test_status_in_on_clause(spark):
    t = tables(
        spark, product=[(1, "p1", 1.0)], stock=[(10, 1)],
        sale=[(100, 1, "completed", 1.0, ts(2001, 1, 1)), (101, 1, "pending", 1.0, ts(2001, 1, 1))],
        sale_detail=[(100, 10, 2.0), (101, 10, 3.0)], users=[(1, "a@x")])
    assert recommend.popular_products(t).first().total_purchases == 2
    assert recommend.popular_products(t, semantics="reference").first().total_purchases == 5


def test_trending_window_and_score(spark):
    t = _fanout(spark)
    out = {r.product_id: r for r in recommend.trending_products(t, as_of=ts(2001, 8, 1), days=10).collect()}
    # only the sale of 2001-07-25 is inside the 10-day window: 1 line x avg 4.0
    assert out[1].trend_score == pytest.approx(4.0)
    assert out[1].total_purchases == 3
    ref = {r.product_id: r for r in recommend.trending_products(
        t, as_of=ts(2001, 8, 1), days=10, semantics="reference").collect()}
    assert ref[1].trend_score == pytest.approx(3 * 4.0)


def test_min_filters_and_limit(spark):
    t = _fanout(spark)
    out = recommend.popular_products(t, min_rating=1, min_purchases=1, limit=5).collect()
    assert [r.product_id for r in out] == [1]
    assert recommend.popular_products(t, limit=1).count() == 1


def test_explicit_plus_implicit_rating_and_guest(spark):
    t = tables(
        spark, product=[(1, "p", 1.0)], stock=[(10, 1)],
        sale=[(100, 5, "completed", 1.0, ts(2001, 1, 1)), (101, None, "completed", 1.0, ts(2001, 1, 1))],
        sale_detail=[(100, 10, 1.0), (101, 10, 1.0)], review=[(1, 5, 1, 2.0)], users=[(5, "a@x")])
    r = rt.ratings(t).collect()
    assert len(r) == 1 and r[0].user_id == 5 and r[0].rating == pytest.approx(3.0)


def _shop(spark):
    # users 1..3; user 1 bought p1, user 2 bought p1 and p2, user 3 bought p3; user 4 bought nothing
    return tables(
        spark,
        product=[(1, "p1", 1.0), (2, "p2", 2.0), (3, "p3", 3.0), (4, "p4", 4.0)],
        stock=[(10, 1), (20, 2), (30, 3), (40, 4)],
        sale=[(100, 1, "completed", 1.0, ts(2001, 1, 1)), (101, 2, "completed", 1.0, ts(2001, 1, 1)),
              (102, 3, "completed", 1.0, ts(2001, 1, 1)), (103, 2, "pending", 1.0, ts(2001, 1, 1))],
        sale_detail=[(100, 10, 1.0), (101, 10, 1.0), (101, 20, 4.0), (102, 30, 2.0), (103, 40, 9.0)],
        review=[(1, 2, 2, 5.0), (2, 3, 3, 1.0)],
        users=[(1, "u1@x"), (2, "u2@x"), (3, "u3@x"), (4, "u4@x")],
    )


def test_similar_users(spark):
    t = _shop(spark)
    users = spark.createDataFrame([(1,), (4,)], "user_id long")
    out = recommend.similar_users(t, users).collect()
    # user 1 shares p1 with user 2, who also bought p2; user 4 has no purchases -> no rows
    assert [(r.user_id, r.product_id, r.purchased_by_similar_users) for r in out] == [(1, 2, 1)]
    assert out[0].average_rating == pytest.approx(5.0)


def test_personalized_user_average_default(spark):
    t = _shop(spark)
    users = spark.createDataFrame([(1,)], "user_id long")
    avg = recommend.user_average_rating(t, users).first()
    assert avg.user_avg == 3.0
    out = {r.product_id: r for r in recommend.personalized(t, users).collect()}
    assert 1 not in out  # already bought
    # p2: total 4 units, avg 5 -> 4 * (5 - |5 - 3|) = 12
    assert out[2].score == pytest.approx(12.0)


def test_known_products_include_null_ratings(spark):
    t = tables(spark, product=[(1, "p", 1.0)], review=[(1, 9, 1, None)], users=[(9, "a@x")])
    users = spark.createDataFrame([(9,)], "user_id long")
    assert [(r.user_id, r.product_id) for r in spine.known_products(t, users).collect()] == [(9, 1)]


def test_item_similarity_two_coraters(spark):
    r = spark.createDataFrame([(1, 10, 4.0), (1, 11, 5.0), (2, 10, 2.0), (2, 11, 1.0)],
                              "user_id long, product_id long, rating double")
    sim = {(x.item_i, x.item_j): x.similarity for x in rt.item_similarity(r).collect()}
    assert sim[(10, 11)] == pytest.approx((4 * 5 + 2 * 1) / ((16 + 4) * (25 + 1)) ** 0.5, abs=1e-12)
    assert sim[(10, 11)] == pytest.approx(0.9648, abs=1e-4)
    assert sim[(10, 11)] == sim[(11, 10)]


def test_collaborative_never_rated_is_global_mean(spark):
    t = _shop(spark)
    users = spark.createDataFrame([(1,)], "user_id long")
    out = {r.product_id: r.predicted_rating for r in recommend.collaborative(t, users).collect()}
    r = rt.ratings(t).agg(F.avg("rating")).first()[0]
    assert 1 not in out
    # p4 was never rated by anyone: global mean
    assert out[4] == pytest.approx(r)


def test_router(spark):
    t = _shop(spark)
    with pytest.raises(ValueError):
        recommend.recommend(t, "nope")
    with pytest.raises(ValueError):
        recommend.recommend(t, "similar_users")
    with pytest.raises(ValueError):
        recommend.recommend(t, "content_based")
    emails = spark.createDataFrame([("u1@x",)], "email string")
    assert recommend.recommend(t, "similar_users", emails=emails).count() == 1
    assert recommend.recommend(t).count() == 4
    with pytest.raises(ValueError, match="nobody@x"):
        recommend.recommend(t, "similar_users", emails=spark.createDataFrame([("u1@x",), ("nobody@x",)], "email string"))


def _random_shop(spark, seed, hot=True):
    """Users 0-39, products 0-29; product 0 is bought by everybody and user 0 bought everything."""
    rnd = random.Random(seed)
    sales, details, reviews = [], [], []
    for u in range(40):
        bought = {rnd.randrange(1, 30) for _ in range(rnd.randrange(5))} | ({0} if hot else set()) | (set(range(30)) if u == 0 else set())
        for p in sorted(bought):
            sales.append((1000 * u + p, u, "completed", 1.0, ts(2001, 1, 1)))
            details += [(1000 * u + p, p, float(rnd.randint(1, 3)))] * rnd.randint(1, 2)
    for i in range(60):
        reviews.append((i, rnd.randrange(40), rnd.randrange(30), float(rnd.randint(1, 5))))
    return tables(spark, product=[(p, f"p{p}", float(p)) for p in range(30)], stock=[(p, p) for p in range(30)], sale=sales,
                  sale_detail=details, review=reviews, users=[(u, f"u{u}@x") for u in range(42)])


@pytest.mark.parametrize("seed,hot,limit", [(1, True, 5), (2, False, 4), (3, True, 50)])
def test_similar_users_with_a_hot_product_and_a_heavy_user(spark, monkeypatch, seed, hot, limit):
    monkeypatch.setattr(recommend, "HOT", 3)
    t = _random_shop(spark, seed, hot)
    lines = {(r.user_id, r.product_id): r.lines for r in spine.purchases(t).collect()}
    owned = {u: {p for v, p in lines if v == u} for u in range(42)}
    want = set()
    for u in range(42):
        counts = {}
        for v in range(40):
            if v != u and owned[u] & owned[v]:
                for p in owned[v] - owned[u]:
                    counts[p] = counts.get(p, 0) + lines[v, p]
        want |= {(u, p, n) for p, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:limit]}
    users = spark.createDataFrame([(u,) for u in range(42)], "user_id long")
    got = {(r.user_id, r.product_id, r.purchased_by_similar_users) for r in recommend.similar_users(t, users, limit=limit).collect()}
    assert got == want


def test_item_similarity_of_a_heavy_user(spark):
    """One user rated every item; the items are cut into chunks, and each pair is made once."""
    rnd = random.Random(4)
    rated = {(0, p): float(rnd.randint(1, 5)) for p in range(50)} | {(rnd.randrange(1, 9), rnd.randrange(50)): float(rnd.randint(1, 5)) for _ in range(80)}
    r = spark.createDataFrame([(u, p, x) for (u, p), x in rated.items()], "user_id long, product_id long, rating double")
    want = {}
    for i in range(50):
        for j in range(50):
            both = [(rated[u, i], rated[u, j]) for u in range(9) if (u, i) in rated and (u, j) in rated]
            if i != j and both:
                want[i, j] = sum(a * b for a, b in both) / (sum(a * a for a, _ in both) * sum(b * b for _, b in both)) ** 0.5
    for heavy in (2000, 7):
        rows = rt.item_similarity(r, heavy=heavy).collect()
        assert {(x.item_i, x.item_j): pytest.approx(x.similarity) for x in rows} == want and len(rows) == len(want)
        few = rt.item_similarity(r, of=spark.createDataFrame([(3,), (7,)], "product_id long"), heavy=heavy).collect()
        assert {(x.item_i, x.item_j): pytest.approx(x.similarity) for x in few} == {k: v for k, v in want.items() if k[1] in (3, 7)}


@pytest.mark.parametrize("k,limit", [(2, 6), (40, 50)])
def test_collaborative_brute_force(spark, k, limit):
    t = _random_shop(spark, 5)
    r = {(x.user_id, x.product_id): x.rating for x in rt.ratings(t).collect()}
    sim = {(x.item_i, x.item_j): round(x.similarity, 9) for x in rt.item_similarity(rt.ratings(t)).collect()}
    known = {(x.user_id, x.product_id) for x in t.review.collect()} | {(x.user_id, x.product_id) for x in spine.purchases(t).collect()}
    mean, want = sum(r.values()) / len(r), set()
    for u in range(42):
        pred = []
        for i in range(30):
            if (u, i) not in known:
                near = sorted(((sim[i, j], j) for j in range(30) if (u, j) in r and sim.get((i, j), 0) > 0), key=lambda x: (-x[0], x[1]))[:k]
                e = sum(s * r[u, j] for s, j in near) / sum(s for s, _ in near) if near else mean
                pred.append((round(min(5.0, max(1.0, e)), 9), i))
        want |= {(u, i, p) for p, i in sorted(pred, key=lambda x: (-x[0], x[1]))[:limit]}
    users = spark.createDataFrame([(u,) for u in range(42)], "user_id long")
    for few in (False, True):
        got = recommend.collaborative(t, users, limit=limit, k=k, few_users=few).collect()
        assert {(x.user_id, x.product_id) for x in got} == {(u, i) for u, i, _ in want}
        scores = {(u, i): p for u, i, p in want}
        assert all(x.predicted_rating == pytest.approx(scores[x.user_id, x.product_id], abs=2e-9) for x in got)


def test_trained_recommender_is_served(spark, tmp_path):
    t = _random_shop(spark, 6)
    path = f"{tmp_path}/model"
    model = training.load_or_train(t, path)
    assert {"knn_test_mean_distance", "cv_rmse_mean", "cv_mae_mean"} <= {m.metric for m in model.metrics.collect()}
    before = published(spark, path)
    again = training.load_or_train(t, path)  # loaded, not trained anew
    assert published(spark, path) == before
    users, targets = spark.createDataFrame([(3,), (4,)], "user_id long"), spark.createDataFrame([(2,)], "product_id long")
    for kw in ({"strategy": "collaborative", "users": users}, {"strategy": "content_based", "targets": targets}):
        served, live = (sorted(map(tuple, recommend.recommend(t, model=m, **kw).collect())) for m in (again, None))
        assert [x[:2] for x in served] == [x[:2] for x in live] and served
    shutil.rmtree(f"{published(spark, path)}/scaler")
    with pytest.raises(AnalysisException):  # a damaged model is an error, not a reason to overwrite it
        training.load_or_train(t, path)


def test_normalize_bad_values(spark):
    raw = spark.createDataFrame([("1", "2", "completed", "nan", "2001-02-03 04:05:06"), ("x", None, None, "1.5", "no date")],
                                "id string, user_id string, status string, grand_total string, created_at string")
    out = normalize(raw, "sale").collect()
    assert out[0].id == 1 and out[0].grand_total is None and out[0].created_at == dt.datetime(2001, 2, 3, 4, 5, 6)
    assert out[1].id is None and out[1].created_at is None and out[1].grand_total == 1.5


def test_read_records(spark, tmp_path):
    (tmp_path / "e.json").write_text('[{"employee_id": 1, "completed_tasks": 2, "total_tasks": 4.0, "team": "a"}, {"employee_id": 2}]')
    df = read_records(spark, str(tmp_path / "e.json"), "employee_record", extra=StructType([StructField("team", StringType())]))
    rows = {r.employee_id: r for r in df.collect()}
    assert rows[1].team == "a" and rows[1].completed_tasks == 2.0 and rows[2].avg_task_hours is None
    (tmp_path / "none.json").write_text("[]")
    with pytest.raises(ValueError):
        read_records(spark, str(tmp_path / "none.json"), "employee_record")


@pytest.mark.parametrize("heavy", [2000, 4])
def test_updated_statistics_are_those_of_retraining(spark, heavy):
    """Random runs of inserted, deleted and replaced ratings; user 0 rated everything."""
    rnd = random.Random(11)
    r = {(0, p): float(rnd.randint(1, 5)) for p in range(14)} | {(rnd.randrange(1, 8), rnd.randrange(14)): rnd.choice([1.0, 2.5, 5.0, 3.3]) for _ in range(40)}
    frame = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], "user_id long, product_id long, rating double")
    statistics = rt.pair_statistics(frame(r), heavy)
    for _ in range(3):
        after = dict(r)
        for k in rnd.sample(sorted(after), 9):
            after.pop(k)
        for _ in range(9):
            after[rnd.randrange(10), rnd.randrange(16)] = rnd.choice([1.0, 4.0, 0.0])
        changes = rt.rating_changes(frame(r), frame(after))
        assert {(c.user_id, c.product_id, c.rating) for c in changes.collect()} == {(*k, after.get(k)) for k in set(r) | set(after) if r.get(k) != after.get(k)}
        assert sorted(rt.update_ratings(frame(r), changes).collect()) == sorted(frame(after).collect())
        statistics = session.materialize(rt.update_statistics(statistics, frame(r), changes, heavy))
        got = {(x.item_i, x.item_j): tuple(x)[2:] for x in statistics.collect()}
        want = {(x.item_i, x.item_j): tuple(x)[2:] for x in rt.pair_statistics(frame(after)).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
        r = after


def test_a_served_model_is_brought_up_to_date(spark, tmp_path):
    path = f"{tmp_path}/model"
    training.train_recommender(_random_shop(spark, 6), path)
    later = _random_shop(spark, 7)
    model, first = training.update(later, path), published(spark, path)
    fresh = {(x.item_i, x.item_j): x.similarity for x in rt.item_similarity(rt.ratings(later)).collect()}
    assert {(x.item_i, x.item_j): x.similarity for x in model.similarity.collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in fresh.items()}
    assert training.update(later, path).ratings.count() == model.ratings.count() and published(spark, path) != first
    with pytest.raises(FileNotFoundError):
        training.load(spark, f"{tmp_path}/nothing")


def test_records_that_cannot_be_read_are_set_aside(spark, tmp_path):
    lines = ['{"employee_id": 1, "completed_tasks": 2, "total_tasks": 4.5, "team": "a"}', '{"employee_id": "2", "completed_tasks": "NaN", "avg_task_hours": null}',
             '{"employee_id": 3, "completed_tasks": "many", "total_tasks": "x"}', '{"completed_tasks": 1}', '{"employee_id": 4, "completed', '{"employee_id": "e5"}', '{"employee_id": 6, "team": {"a": 1}}']
    (tmp_path / "e.json").write_text("\n".join(lines))
    extra = StructType([StructField("team", StringType())])
    got = ingest_records(spark, str(tmp_path / "e.json"), "employee_record", "employee_id", multi_line=False, extra=extra)
    assert got.counts == {"read": 7, "accepted": 3, "rejected": 4}
    rows = {r.employee_id: r for r in got.accepted.collect()}
    assert set(rows) == {1, 2, 6} and rows[1].total_tasks == 4.5 and rows[1].team == "a" and rows[2].completed_tasks is None
    assert sorted(r.reason for r in got.rejected.collect()) == ["completed_tasks is no double", "employee_id is no bigint", "no employee_id", "unreadable"]
    assert {r.record for r in got.rejected.where("reason = 'unreadable'").collect()} == {lines[4]}
    (tmp_path / "a.json").write_text('[{"employee_id": 1}, {"employee_id": null}]')
    whole = ingest_records(spark, str(tmp_path / "a.json"), "employee_record", "employee_id")
    assert whole.counts == {"read": 2, "accepted": 1, "rejected": 1}
    got.accepted.write.parquet(f"{tmp_path}/p")
    assert ingest_records(spark, f"{tmp_path}/p", "employee_record", "employee_id", fmt="parquet").counts == {"read": 3, "accepted": 3, "rejected": 0}


def test_router_serves_every_strategy_with_and_without_a_model(spark, tmp_path):
    t = _random_shop(spark, 6)
    model = training.load_or_train(t, f"{tmp_path}/model")
    users, emails = spark.createDataFrame([(3,), (4,)], "user_id long"), spark.createDataFrame([("u3@x",), ("u4@x",)], "email string")
    for name, direct in (("popular", recommend.popular_products(t)), ("trending", recommend.trending_products(t, ts(2001, 1, 2))),
                         ("personalized", recommend.personalized(t, users)), ("collaborative", recommend.collaborative(t, users))):
        kw = {"as_of": ts(2001, 1, 2)} | ({"emails": emails} if name in recommend.USER_STRATEGIES else {})
        for m in (None, model):
            assert sorted(map(tuple, recommend.recommend(t, name, model=m, **kw).collect())) == sorted(map(tuple, direct.collect())), name

"""Pruned operators against brute force, rank helper, and plan shape."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import tables, ts
from shopcast import session
from shopcast.functions import expr
from shopcast.functions.expr import global_rank
from shopcast.operators import banded_topk, knn, ratings, shared_buyers, spine
from shopcast.plans import forecast, recommend
from shopcast.sources.tables import catalog_tables, store_bucketed


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_banded_topk_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    items = spark.createDataFrame(
        [(i, f"p{i}", float(rnd.choice([0, 1, 2, 5, 10, 40])), rnd.choice([0.0, 1.0, 2.5, 3.0, 4.5, 5.0]))
         for i in range(120)], "product_id long, name string, w double, c double")
    users = spark.createDataFrame([(u, rnd.choice([1.0, 2.0, 3.0, 3.5, 4.25, 5.0])) for u in range(40)],
                                  "user_id long, a double")
    excl = spark.createDataFrame([(u, rnd.randrange(120)) for u in range(40) for _ in range(rnd.randrange(30))],
                                 "user_id long, product_id long")
    kw = dict(weight="w", centre="c", user_value="a", k=7)
    fast = banded_topk.banded_topk(items, users, excl, bands=4, **kw)
    slow = banded_topk.brute_force_topk(items, users, excl, **kw)
    cols = ["user_id", "product_id", "score"]
    assert _rows(fast, cols) == _rows(slow, cols)


@pytest.mark.parametrize("dims,exclude", [(3, True), (6, False)])
def test_cosine_topk_equals_brute_force(spark, dims, exclude):
    rnd = random.Random(dims)
    vecs = [[float(rnd.randint(0, 3)) for _ in range(dims)] for _ in range(150)]
    vecs[5] = [0.0] * dims          # a zero vector
    vecs[6] = list(vecs[7])         # an exact duplicate
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "id long, vec array<double>")
    slow = knn.brute_force_topk(df, df, 5, exclude_self=exclude)
    cols = ["query_id", "item_id", "similarity"]
    for block in (10, 40, 2048):
        fast = knn.cosine_topk(df, df, 5, exclude_self=exclude, block=block)
        assert _rows(fast, cols) == _rows(slow, cols), block
        zero = [r for r in fast.collect() if r.query_id == 5]
        assert zero and all(r.similarity == 0.0 for r in zero)


def test_cosine_topk_skips_cells(spark):
    """Grouped vectors: nearly all cells are proven to hold no neighbour, and the answer is that of all pairs."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=6) * 5 + rng.normal(size=(100, 6)) * 0.05 for _ in range(40)])
    x[17] = 0.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    visits = []
    got = {(r.query_id, r.item_id, r.similarity) for r in knn.cosine_topk(df, df, 10, block=50, visits=visits).collect()}
    n = np.sqrt((x * x).sum(axis=1))
    sim = np.round(np.where(np.outer(n, n) > 0, (x @ x.T) / np.where(np.outer(n, n) > 0, np.outer(n, n), 1), 0.0), 9)
    want = {(i, int(j)) for i in range(len(x)) for j in sorted((j for j in range(len(x)) if j != i), key=lambda j: (-sim[i, j], j))[:10]}
    # The last bit of a product may round a tie the other way: at most a few near-ties differ.
    assert len(got) == len(want) and len({g[:2] for g in got} ^ want) <= 4
    seen, possible = visits
    print(f"visited {seen} of {possible} (query, other cell) pairs")
    assert seen < 0.2 * possible


def test_global_rank(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("v"))
    out = global_rank(df, [F.col("v"), F.col("id")], "pos").collect()
    assert sorted(r.pos for r in out) == list(range(1, 1001))
    assert all(r.pos == r.v + 1 for r in out)


def test_global_rank_keeps_every_row_and_its_payload(spark):
    """Columns outside the sort key, many partitions: no row lost, no place given twice."""
    df = spark.range(0, 200_000, 1, 16).select(
        F.pmod(F.xxhash64("id"), F.lit(5000)).alias("v"), "id", F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    out = global_rank(df, [F.col("v"), F.col("id")], "pos")
    n, places, lo, hi, ids, bad = out.agg(
        F.count(F.lit(1)), F.countDistinct("pos"), F.min("pos"), F.max("pos"), F.countDistinct("id"),
        F.count_if(F.col("payload") != F.sha2(F.col("id").cast("string"), 256))).first()
    assert (n, places, lo, hi, ids, bad) == (200_000, 200_000, 1, 200_000, 200_000, 0)
    rows = [(r.v, r.id) for r in out.orderBy("pos").limit(3000).collect()]
    assert rows == sorted(rows)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _shop(spark):
    return tables(
        spark, product=[(1, "p1", 1.0), (2, "p2", 2.0)], stock=[(10, 1), (20, 2)],
        sale=[(100, 1, "completed", 1.0, ts(2001, 1, 1)), (101, 2, "completed", 1.0, ts(2001, 1, 1))],
        sale_detail=[(100, 10, 1.0), (101, 10, 1.0), (101, 20, 1.0)], review=[(1, 1, 2, 4.0)],
        users=[(1, "a@x"), (2, "b@x")])


def test_plans_have_no_cartesian_product(spark, monkeypatch):
    t = _shop(spark)
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    seen = []
    written = session.materialize

    def spy(df):
        seen.append(_plan(df))
        return written(df)

    for module in (recommend, banded_topk, shared_buyers, ratings, expr):
        monkeypatch.setattr(module, "materialize", spy)
    for df in (recommend.similar_users(t, users), recommend.personalized(t, users),
               recommend.collaborative(t, users), recommend.popular_products(t), ratings.cross_validate(ratings.ratings(t))):
        seen.append(_plan(df))
    assert len(seen) > 15  # the written parts as well as what follows them
    for plan in seen:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_trending_drops_old_lines_before_the_aggregate(spark):
    """In corrected mode the filtered sale is an inner join, so no line outside the window is aggregated."""
    t = _shop(spark)
    corrected = _plan(recommend.trending_products(t, as_of=ts(2001, 1, 5)))
    assert "LeftOuter" in _plan(recommend.trending_products(t, as_of=ts(2001, 1, 5), semantics="reference"))
    join = [line for line in corrected.splitlines() if "sale_id" in line and "Join" in line]
    assert join and all("Inner" in line for line in join)


def test_per_user_top_n_uses_window_group_limit(spark):
    df = expr.top_n(spine.purchases(_shop(spark)), ["user_id"], [F.desc("lines"), F.col("product_id")], 2)
    df.collect()
    assert "WindowGroupLimit" in _plan(df)


def test_sales_filter_pushed_to_parquet(spark, tmp_path):
    import datetime as dt
    path = str(tmp_path / "sale")
    spark.createDataFrame([(1, 1, "completed", 2.0, dt.datetime(2000, 1, 5))],
                          "id long, user_id long, status string, grand_total double, created_at timestamp_ntz") \
        .write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        df = forecast.monthly_sales(spark.read.parquet(path), dt.date(2000, 1, 1), dt.date(2000, 12, 31))
        plan = _plan(df)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(status,completed)" in plan
    assert "GreaterThanOrEqual(created_at" in plan and "LessThan(created_at" in plan
    assert "ReadSchema: struct<id:bigint,status:string,grand_total:double,created_at:timestamp_ntz>" in plan


def test_stored_tables_join_without_a_shuffle(spark, tmp_path):
    """Bucketed sale and sale_detail: no exchange below their join, months before the window are not read, same answers as the frames."""
    rnd = random.Random(5)
    sales = [(i, rnd.randrange(9), rnd.choice(["completed", "pending"]), 1.0, ts(2001, rnd.randint(1, 8), rnd.randint(1, 28))) for i in range(120)]
    details = [(rnd.randrange(120), 10 * rnd.randint(1, 6), float(rnd.randint(1, 4))) for _ in range(300)]
    t = tables(spark, product=[(i, f"p{i}", 1.0) for i in range(1, 7)], stock=[(10 * i, i) for i in range(1, 7)], sale=sales, sale_detail=details,
               review=[(i, rnd.randrange(9), rnd.randint(1, 6), float(rnd.randint(1, 5))) for i in range(40)], users=[(u, f"u{u}@x") for u in range(9)])
    store_bucketed(t, "shop_test", str(tmp_path), buckets=4)
    stored, as_of = catalog_tables(spark, "shop_test"), ts(2001, 8, 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (spine.purchases(stored), spine.product_sales(stored), spine.product_sales(stored, semantics="reference")):
            lines = _plan(df).splitlines()
            at = next(i for i, line in enumerate(lines) if "Join" in line and "sale_id" in line)
            depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
            below = list(itertools.takewhile(lambda line: len(line) - len(line.lstrip(" :+-")) > depth, lines[at + 1:]))  # noqa: B023
            assert sum("FileScan" in line for line in below) == 2 and not any("Exchange" in line for line in below)
        recent = _plan(spine.product_sales(stored, since=ts(2001, 7, 11)))
        assert "PartitionFilters: [isnotnull(sale_month" in recent and "sale_month" not in _plan(spine.product_sales(t, since=ts(2001, 7, 11)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for job in (recommend.popular_products, lambda x: recommend.trending_products(x, as_of=as_of), lambda x: recommend.trending_products(x, as_of=as_of, semantics="reference"),
                lambda x: spine.purchases(x).select("user_id", "product_id", "lines", "units")):
        assert sorted(map(tuple, job(stored).collect())) == sorted(map(tuple, job(t).collect()))
    for name in ("product", "stock", "sale", "sale_detail", "review", "users"):
        spark.sql(f"drop table shop_test_{name}")


def test_knn_boxes_rule_out_cells_that_angles_leave(spark):
    """Six components, long thin cells: far fewer pairs are compared than by angles alone, with the same result."""
    rnd = random.Random(4)
    rows = [(i, [rnd.random() ** 3 for _ in range(3)] + [rnd.random() * 0.02, 0.5, 1.0 if i % 3 else 0.0]) for i in range(3000)] + [(5000, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    visits = []
    got = {(r.query_id, r.item_id, r.similarity) for r in knn.cosine_topk(df.where("id % 7 = 0 or id = 5000"), df, 5, block=100, visits=visits).collect()}
    want = {(r.query_id, r.item_id, r.similarity) for r in knn.brute_force_topk(df.where("id % 7 = 0 or id = 5000"), df, 5).collect()}
    assert got == want
    assert visits[0] < 0.12 * visits[1]

"""Forecast, product and employee scoring on literal fixtures."""

import datetime as dt
import shutil
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrameWriter

from shopcast.functions.expr import minmax
from shopcast.operators import clustering, iforest
from shopcast.plans import employees, forecast, products
from shopcast.session import published

SALE = "id long, user_id long, status string, grand_total double, created_at timestamp_ntz"


def _sales(spark, rows):
    return spark.createDataFrame([(i, 1, "completed", v, d) for i, (d, v) in enumerate(rows)], SALE)


def _monthly(spark, totals):
    rows = [(dt.datetime(2024, m + 1, 1), v) for m, v in enumerate(totals)]
    return forecast.monthly_sales(_sales(spark, rows), "all")


def test_month_gap(spark):
    s = _sales(spark, [(dt.datetime(2024, 1, 5), 1.0), (dt.datetime(2024, 3, 2), 2.0)])
    out = forecast.monthly_sales(s, "all").orderBy("period").collect()
    assert [(r.period, r.month, r.total_sales, r.transaction_count) for r in out] == [
        ("2024-01", "Jan", 1.0, 1), ("2024-02", "Feb", 0.0, 0), ("2024-03", "Mar", 2.0, 1)]


def test_date_range_filter(spark):
    s = _sales(spark, [(dt.datetime(2023, 12, 31), 5.0), (dt.datetime(2024, 1, 31, 23), 1.0)])
    out = forecast.monthly_sales(s, dt.date(2024, 1, 1), dt.date(2024, 1, 31)).collect()
    assert [(r.period, r.total_sales) for r in out] == [("2024-01", 1.0)]


def test_short_series_zero(spark):
    r = forecast.sales_forecast(_monthly(spark, [1.0, 2.0])).first()
    assert all(v == 0 for v in r.asDict().values())


def test_exact_line(spark):
    r = forecast.sales_forecast(_monthly(spark, [10.0, 20.0, 30.0, 40.0, 50.0])).first()
    assert r.next_month_forecast == pytest.approx(60.0)
    assert r.expected_range_low == pytest.approx(60.0) and r.expected_range_high == pytest.approx(60.0)
    assert r.growth_rate == pytest.approx(25.0)
    assert r.model_accuracy == pytest.approx(100.0)
    assert r.confidence_level == 95.0


def test_zero_previous_month(spark):
    assert forecast.sales_forecast(_monthly(spark, [5.0, 0.0, 7.0])).first().growth_rate == 0.0


def test_forecast_per_series(spark):
    rows = []
    for m, (a, b) in enumerate([(10.0, 1.0), (20.0, 1.0), (30.0, 1.0), (40.0, 1.0), (50.0, 1.0)]):
        rows += [(2 * m, 1, "completed", a, dt.datetime(2024, m + 1, 3), "A"),
                 (2 * m + 1, 1, "completed", b, dt.datetime(2024, m + 1, 3), "B")]
    s = spark.createDataFrame(rows, SALE + ", series string")
    out = {r.series: r for r in forecast.sales_forecast(forecast.monthly_sales(s, "all", series="series"),
                                                         series="series").collect()}
    assert out["A"].next_month_forecast == pytest.approx(60.0)
    assert out["B"].next_month_forecast == pytest.approx(1.0)


EMP = "employee_id long, completed_tasks double, total_tasks double, avg_task_hours double"


def test_guarded_ratio_and_missing_metrics(spark):
    df = spark.createDataFrame([(1, 3.0, 0.0, 1.0), (2, None, None, None), (3, 2.0, 4.0, 0.5)], EMP)
    out = {r.employee_id: r for r in employees.employee_scores(df).collect()}
    assert out[1].completion_rate == 0.0
    assert (out[2].completed_tasks, out[2].total_tasks, out[2].avg_task_hours) == (0.0, 0.0, 0.0)
    assert out[3].completion_rate == 0.5
    scores = [r.performance_score for r in out.values()]
    assert min(scores) == 0.0 and max(scores) == pytest.approx(100.0)


def test_constant_column_minmax(spark):
    df = spark.createDataFrame([(7.0,), (7.0,)], "x double")
    assert [r.x for r in minmax(df, ["x"]).collect()] == [0.0, 0.0]


def test_identical_employees(spark):
    df = spark.createDataFrame([(i, 1.0, 2.0, 3.0) for i in range(3)], EMP)
    assert [r.performance_score for r in employees.employee_scores(df).collect()] == [0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        employees.fit(df)


PROD = "product_id long, name string, price double, units_sold double, stock double, extra string"


def test_product_nulls_and_degenerate(spark):
    df = spark.createDataFrame([
        (1, "a", 10.0, 5.0, 5.0, "x"), (2, "b", 0.0, 3.0, 1.0, "x"),
        (3, "c", 4.0, 0.0, 0.0, "x"), (4, "d", 2.0, 2.0, 2.0, None)], PROD)
    out = {r.product_id: r for r in products.product_performance(df).collect()}
    assert 4 not in out  # NULL in a pass-through column drops the row
    assert out[2].is_degenerate and out[2].sales_velocity is None and out[2].sales_velocity_scaled == 0.0
    assert out[3].is_degenerate and out[3].stock_ratio is None
    assert not out[1].is_degenerate
    assert out[1].extra == "x"


def test_product_missing_column(spark):
    df = spark.createDataFrame([(1, "a", 1.0)], "product_id long, name string, price double")
    with pytest.raises(ValueError):
        products.product_performance(df)


def test_summary(spark):
    df = spark.createDataFrame([(1, "a", 10.0, 5.0, 5.0, "x"), (2, "b", 1.0, 1.0, 9.0, "x")], PROD)
    s = products.product_summary(products.product_performance(df)).first()
    assert s.top_product == "a" and s.total_revenue == 51.0 and s.avg_score == 50.0


def test_tiers_need_three_distinct_rows(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 1.0, 1.0, "x"), (2, "b", 2.0, 2.0, 2.0, "x")], PROD)
    with pytest.raises(ValueError):
        products.product_tiers(df).collect()


def test_three_blobs_recovered(spark):
    rows = []
    for blob, base in enumerate([0.0, 50.0, 100.0]):
        for i in range(10):
            rows.append((blob * 100 + i, base + i * 0.01, base + i * 0.02))
    df = spark.createDataFrame(rows, "id long, x double, y double")
    model = clustering.fit_kmeans(df, ["x", "y"], k=3)
    out = clustering.assign(model, df, ["x", "y"]).withColumn("score", df["x"])
    ranked = clustering.rank_clusters(out, "cluster", "score", labels=["Low", "Medium", "High"]).collect()
    labels = {r.id // 100: set() for r in ranked}
    for r in ranked:
        labels[r.id // 100].add(r.cluster)
    assert labels == {0: {"Low"}, 1: {"Medium"}, 2: {"High"}}


def test_blobs_of_equal_sum_are_recovered(spark):
    """The features' sum tells nothing; a third of the rows is one point."""
    import random
    rnd = random.Random(3)
    middles = [(0.0, 6.0, 0.0), (6.0, 0.0, 0.0), (0.0, 0.0, 6.0), (2.0, 2.0, 2.0)]
    rows = [(100 * b + i, *(c + rnd.gauss(0, 0.1) for c in m)) for b, m in enumerate(middles) for i in range(30)] + [(1000 + i, *middles[1]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    model = clustering.fit_kmeans(df, ["x", "y", "z"], k=4)
    assert model == clustering.fit_kmeans(df.repartition(7), ["x", "y", "z"], k=4)  # the order of the rows doesn't matter
    found = {(r.id // 100 if r.id < 1000 else 1, r.cluster) for r in clustering.assign(model, df, ["x", "y", "z"]).collect()}
    assert len(found) == 4 == len({c for _, c in found})


def test_silhouette_brute_force(spark):
    import random
    rnd = random.Random(9)
    rows = [(i, rnd.choice(["a", "b", "c", None]), rnd.gauss(0, 1), rnd.gauss(0, 5)) for i in range(60)] + [(60, "alone", 1.0, 1.0), (61, "a", 0.0, 0.0), (62, "a", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    dist = lambda p, q: (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2
    for r in clustering.silhouette(df, ["x", "y"], "g").collect():
        p = rows[r.id]
        mean = {}
        for g in {q[1] for q in rows}:
            others = [dist(p, q) for q in rows if q[1] == g and q[0] != r.id]
            if others:
                mean[g] = sum(others) / len(others)
        a, b = mean.get(p[1]), min(v for g, v in mean.items() if g != p[1])
        assert r.silhouette == pytest.approx((b - a) / max(a, b) if a is not None else 0.0, abs=1e-9)
    one = clustering.silhouette(df.where("g = 'a'"), ["x", "y"], "g").collect()
    assert {r.silhouette for r in one} == {0.0}


def test_isolation_forest_flags_far_point(spark):
    import random
    rnd = random.Random(7)
    rows = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(200)] + [(999, 40.0, 40.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    forest = iforest.fit(df, ["a", "b"], "id", trees=50, psi=64)
    out = iforest.flag(df, forest).collect()
    flagged = {r.id for r in out if r.is_anomaly}
    assert 999 in flagged
    assert len(flagged) <= 0.05 * len(rows) + 1
    assert max(out, key=lambda r: r.anomaly_score).id == 999


def test_forest_passes_other_columns_through(spark):
    rows = [(i, float(i % 7), 9007199254740993 if i % 2 else None, Decimal("12345678901234567.89"), dt.datetime(2001, 1, 1, 0, 0, 0, 123456)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, big long, money decimal(20,2), at timestamp_ntz")
    out = iforest.flag(df, iforest.fit(df, ["a"], "id", trees=10, psi=16))
    assert sorted(tuple(r)[:5] for r in out.select(*df.columns).collect()) == sorted(rows, key=lambda r: r[0])


def test_forest_sample_is_that_of_smallest_hashes(spark):
    """The same trees whatever the partitions, and as many rows per tree as asked."""
    rows = [(i, float((i * 7919) % 1000), float(i % 13)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    one, two = (iforest.fit(d, ["a", "b"], "id", trees=5, psi=32) for d in (df.repartition(1), df.repartition(9)))
    assert one.threshold == two.threshold
    key = lambda f: f.nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    assert key(one).equals(key(two))
    assert set(one.nodes[one.nodes.node == 1]["size"]) == {32}


def test_employee_model_round_trip(spark, tmp_path):
    rows = [(i, float(i % 9), 10.0, float(i % 4)) for i in range(80)] + [(999, 500.0, 500.0, 90.0)]
    df = spark.createDataFrame(rows, EMP)
    path = f"{tmp_path}/employees"
    first = employees.employee_performance(df, employees.load_or_fit(df, path)).collect()
    again = employees.employee_performance(df, employees.load_or_fit(df.limit(5), path)).collect()  # loaded
    assert sorted(first) == sorted(again)
    assert {r.employee_id for r in first if r.is_anomaly} >= {999}
    shutil.rmtree(f"{published(spark, path)}/forest")
    with pytest.raises(AnalysisException):  # a damaged model is an error, not a reason to overwrite it
        employees.load_or_fit(df, path)


def test_an_aborted_save_leaves_the_old_model(spark, tmp_path, monkeypatch):
    """The forest of a new version is written, its threshold is not: readers keep the version before, whole."""
    rows = [(i, float(i % 9), 10.0, float(i % 4)) for i in range(80)] + [(999, 500.0, 500.0, 90.0)]
    df, path = spark.createDataFrame(rows, EMP), f"{tmp_path}/employees"
    old = employees.load_or_fit(df, path)
    new = employees.fit(df.limit(40))
    parquet, written = DataFrameWriter.parquet, []

    def fails(self, to, *args, **kw):
        if to.endswith("/meta"):
            raise OSError("the executor's disk is gone")
        written.append(to)
        return parquet(self, to, *args, **kw)

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", fails)
        with pytest.raises(OSError):
            new.save(spark, path)
    assert [w.rsplit("/", 1)[1] for w in written] == ["forest"]
    again = employees.EmployeeModel.load(spark, path)
    assert again.forest.threshold == old.forest.threshold and again.mean == old.mean
    before = published(spark, path)
    new.save(spark, path)
    assert published(spark, path) != before and employees.EmployeeModel.load(spark, path).mean == new.mean
    assert employees.EmployeeModel.load(spark, path).forest.nodes.shape == new.forest.nodes.shape
    spark.read.parquet(f"{before}/forest").count()  # a reader of the old version is not disturbed


def test_tier_model_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i}", 1.0 + i % 5, float(i * i), 10.0, "x") for i in range(30)], PROD)
    path = f"{tmp_path}/tiers"
    first = products.product_tiers(df, path=path).collect()
    assert sorted(products.product_tiers(df, path=path).collect()) == sorted(first)
    assert {r.performance_tier for r in first} == {"Low", "Medium", "High"}


def test_empty_records_are_an_error(spark):
    with pytest.raises(ValueError):
        employees.employee_performance(spark.createDataFrame([], EMP))
    with pytest.raises(ValueError):
        products.product_tiers(spark.createDataFrame([], PROD))

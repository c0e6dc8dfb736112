"""Monthly sales and the next-month linear-trend forecast, for one or many series.

Plan: completed sales in the date range (filter pushed to the scan) →
partial/final aggregate per (series, month) → per-series month spine
(``sequence`` of the series' own first..last month, empty months 0) → one
aggregate per series with the regression and error statistics. Any number of
series costs the same two shuffles; nothing is collected.

The forecast fits ordinary least squares on the period index. The reference
standardizes the index before fitting; that does not change OLS predictions,
so the closed-form ``regr_slope`` / ``regr_intercept`` aggregates are used on
the raw index.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopcast.sources.tables import COMPLETED

TEST_SHARE = 0.2
RANGE_WIDTH = 1.5


def _series_cols(series: str | list[str] | None) -> list[str]:
    if series is None:
        return []
    return [series] if isinstance(series, str) else list(series)


def completed_sales(sales: DataFrame, start: dt.date | dt.datetime | None = None,
                    end: dt.date | dt.datetime | None = None, as_of: dt.datetime | None = None,
                    status: str = COMPLETED) -> DataFrame:
    """Sales with ``status`` created in ``[start, end + 1 day)``.

    Without ``start`` the range is year-to-date of ``as_of`` (default now);
    ``start="all"`` disables the date filter.
    """
    s = sales.where(F.col("status") == status)
    if start == "all":
        return s
    if start is None:
        as_of = as_of or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        start = dt.datetime(as_of.year, 1, 1)
        end = end or as_of.date()
    start_ts = dt.datetime.combine(start, dt.time()) if not isinstance(start, dt.datetime) else start
    s = s.where(F.col("created_at") >= F.lit(start_ts).cast("timestamp_ntz"))
    if end is not None:
        end_day = end.date() if isinstance(end, dt.datetime) else end
        stop = dt.datetime.combine(end_day + dt.timedelta(days=1), dt.time())
        s = s.where(F.col("created_at") < F.lit(stop).cast("timestamp_ntz"))
    return s


def monthly_sales(sales: DataFrame, start=None, end=None, series: str | list[str] | None = None,
                  as_of: dt.datetime | None = None) -> DataFrame:
    """Per (series, month): ``total_sales, transaction_count, month ('Jan'), period ('2000-01')``.

    Months without sales inside a series' first..last month are 0 / 0, as a
    monthly resample gives. Money is summed as DECIMAL(18,2).
    """
    keys = _series_cols(series)
    s = completed_sales(sales, start, end, as_of)
    per_month = (s.groupBy(*keys, F.trunc("created_at", "month").alias("__m"))
                 .agg(F.sum(F.col("grand_total").cast("decimal(18,2)")).cast("double").alias("total_sales"),
                      F.count("id").alias("transaction_count")))
    spine = (per_month.groupBy(*keys).agg(F.min("__m").alias("__lo"), F.max("__m").alias("__hi"))
             .select(*keys, F.explode(F.sequence("__lo", "__hi", F.expr("interval 1 month"))).alias("__m")))
    return (spine.join(per_month, [*keys, "__m"], "left")
            .select(*keys,
                    F.coalesce("total_sales", F.lit(0.0)).alias("total_sales"),
                    F.coalesce("transaction_count", F.lit(0)).cast("long").alias("transaction_count"),
                    F.date_format("__m", "MMM").alias("month"),
                    F.date_format("__m", "yyyy-MM").alias("period")))


def sales_forecast(monthly: DataFrame, series: str | list[str] | None = None) -> DataFrame:
    """One row per series: ``next_month_forecast, confidence_level,
    expected_range_low, expected_range_high, growth_rate, model_accuracy``.

    ``monthly`` is the output of :func:`monthly_sales` (gap-filled). The last
    ``ceil(0.2 n)`` months are the test set; fewer than 3 months gives all
    zeros. Values are rounded to 2 decimals.
    """
    keys = _series_cols(series)
    # A single series is keyed by a constant, so both cases share one plan.
    grp = keys or ["__one"]
    m = monthly.select(*keys, "total_sales", F.to_date(F.concat(F.col("period"), F.lit("-01"))).alias("__d"))
    if not keys:
        m = m.withColumn("__one", F.lit(0))
    w = Window.partitionBy(*grp)
    m = (m.withColumn("__x", F.months_between("__d", F.min("__d").over(w)).cast("int"))
         .withColumn("__n", F.count(F.lit(1)).over(w))
         .withColumn("__is_test", F.col("__x") >= F.col("__n") - F.ceil(F.col("__n") * F.lit(TEST_SHARE))))

    y, x = F.col("total_sales"), F.col("__x").cast("double")
    train = ~F.col("__is_test")
    prev_x = F.col("__n") - 2
    fit = m.groupBy(*grp).agg(
        F.first("__n").alias("n"),
        F.regr_slope(F.when(train, y), F.when(train, x)).alias("b1"),
        F.regr_intercept(F.when(train, y), F.when(train, x)).alias("b0"),
        F.max_by(y, F.col("__x")).alias("cur"),
        F.max(F.when(F.col("__x") == prev_x, y)).alias("prev"),
    )
    resid = y - (F.col("b0") + F.col("b1") * x)
    err = (m.where(F.col("__is_test")).join(fit.select(*grp, "b0", "b1"), grp)
           .groupBy(*grp).agg(F.avg(F.abs(resid)).alias("mae"), F.avg(y).alias("mean_test"),
                              F.stddev_pop(resid).alias("sd")))
    joined = fit.join(err, grp, "left")

    n = F.col("n")
    forecast = F.col("b0") + F.col("b1") * n.cast("double")
    sd = F.coalesce(F.col("sd"), F.lit(0.0))
    accuracy = F.coalesce(
        F.greatest(F.lit(0.0), F.lit(100.0) - F.try_divide(F.col("mae"), F.col("mean_test")) * 100.0), F.lit(0.0))
    growth = F.when(F.col("prev") > 0, (F.col("cur") - F.col("prev")) / F.col("prev") * 100.0).otherwise(F.lit(0.0))
    enough = n >= 3

    def r(c):
        return F.when(enough, F.round(c, 2)).otherwise(F.lit(0.0))

    return joined.select(
        *keys,
        r(forecast).alias("next_month_forecast"),
        r(F.least(F.lit(90.0) + n * 2.0, F.lit(95.0))).alias("confidence_level"),
        r(F.greatest(F.lit(0.0), forecast - RANGE_WIDTH * sd)).alias("expected_range_low"),
        r(forecast + RANGE_WIDTH * sd).alias("expected_range_high"),
        r(growth).alias("growth_rate"),
        r(accuracy).alias("model_accuracy"),
    )

"""Column-expression helpers shared by the jobs.

Everything here is built from ``pyspark.sql.functions`` so it stays inside
whole-stage codegen; scaler statistics are one global aggregate joined back as
a one-row broadcast (a few doubles, size fixed by the number of columns).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopcast.session import materialize


def guarded_ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` when ``den > 0`` else 0.0 (no ANSI divide-by-zero)."""
    num, den = _c(num), _c(den)
    return F.when(den > 0, F.try_divide(num, den)).otherwise(F.lit(0.0))


def minmax(df: DataFrame, cols: Iterable[str], suffix: str = "", scale: float = 1.0) -> DataFrame:
    """Min-max scale ``cols`` to [0, scale]; a constant column scales to 0.

    The statistics are one global aggregate used as scalar subqueries, which
    Catalyst merges into a single pass.
    """
    cols = list(cols)
    lo = {c: df.agg(F.min(c)).scalar() for c in cols}
    hi = {c: df.agg(F.max(c)).scalar() for c in cols}
    out = df
    for c in cols:
        scaled = F.when(hi[c] > lo[c], (F.col(c) - lo[c]) / (hi[c] - lo[c])).otherwise(F.lit(0.0))
        out = out.withColumn(c + suffix, scaled * F.lit(float(scale)) if scale != 1.0 else scaled)
    return out


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, rank_col: str | None = None) -> DataFrame:
    """Top ``n`` rows per ``by`` group (row_number, planned as WindowGroupLimit).

    Without ``by`` it is a global ``orderBy().limit()`` (TakeOrderedAndProject).
    """
    if not by:
        return df.orderBy(*order).limit(n)
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    out = df.withColumn("__rn", rn).where(F.col("__rn") <= n)
    if rank_col:
        return out.withColumnRenamed("__rn", rank_col)
    return out.drop("__rn")


def global_rank(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Dense 1-based position of every row in ``order`` without a one-task window.

    The rows are range-partitioned and sorted by ``order``, and each gets its
    place within its partition. That frame is written once: partition numbers
    depend on sampled bounds, so every later use reads the written copy. The
    offsets are a table with one row per partition.
    """
    at, part = "__at", "__part"
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    rows = rows.withColumn(part, F.shiftright(at, 33))
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("__n"), F.min(at).alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(part).alias("__p"), (before - F.col("__first") + 1).alias("__off"))
    return (rows.join(F.broadcast(offsets), F.col(part) == F.col("__p"))
            .withColumn(name, (F.col(at) + F.col("__off")).cast("long"))
            .drop(at, part, "__p", "__off"))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c

"""Product performance: revenue / stock ratio / sales velocity, min-max
scaled, a weighted 0–100 score, k-means tiers and a one-row summary."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcast.functions.expr import minmax
from shopcast.operators import clustering
from shopcast.operators.spine import check_semantics
from shopcast.session import materialize, publish, published
from shopcast.sources.tables import require_columns, require_rows

REQUIRED = ["product_id", "name", "price", "units_sold", "stock"]
FEATURES = ["revenue", "stock_ratio", "sales_velocity"]
# Fixed score weights and tier labels of the reference job.
WEIGHTS = {"revenue": 0.5, "stock_ratio": 0.3, "sales_velocity": 0.2}
TIER_LABELS = ["Low", "Medium", "High"]


def product_performance(df: DataFrame) -> DataFrame:
    """Input columns + ``revenue, stock_ratio, sales_velocity`` (raw),
    ``*_scaled`` (min-max), ``performance_score`` (0–100) and ``is_degenerate``.

    Rows with a missing value in any column are dropped. A zero price or a
    zero stock+units makes a ratio undefined: it is NULL in the raw column,
    counts as 0 after scaling and the row is flagged ``is_degenerate``.
    """
    require_columns(df, REQUIRED)
    clean = df.na.drop(how="any")
    price, units, stock = F.col("price"), F.col("units_sold"), F.col("stock")
    feats = clean.select(
        "*",
        (price * units).alias("revenue"),
        F.try_divide(units, stock + units).alias("stock_ratio"),
        F.try_divide(units, price).alias("sales_velocity"),
    ).withColumn("is_degenerate", F.col("stock_ratio").isNull() | F.col("sales_velocity").isNull())
    scaled = minmax(feats, FEATURES, suffix="_scaled")
    for c in FEATURES:
        scaled = scaled.withColumn(c + "_scaled", F.coalesce(F.col(c + "_scaled"), F.lit(0.0)))
    score = sum((F.lit(w) * F.col(c + "_scaled") for c, w in WEIGHTS.items()), F.lit(0.0)) * F.lit(100.0)
    return scaled.withColumn("performance_score", score)


def save_tiers(spark: SparkSession, model: clustering.KMeans, path: str) -> None:
    """The tier model as one row of JSON, published under ``path``."""
    meta = json.dumps({"cols": model.cols, "centres": model.centres})
    publish(spark, path, {"meta": spark.createDataFrame([(meta,)], "meta string")})


def load_tiers(spark: SparkSession, path: str) -> clustering.KMeans:
    return clustering.KMeans(**json.loads(spark.read.parquet(f"{published(spark, path)}/meta").first()["meta"]))


def product_tiers(df: DataFrame, k: int = 3, path: str | None = None) -> DataFrame:
    """``product_performance`` + ``performance_tier`` (Low / Medium / High by mean score).

    With ``path`` the tier model saved there is used, or fitted and saved when there is none.
    """
    spark = df.sparkSession
    scored = materialize(product_performance(df))
    require_rows(scored, "product records")
    cols = [c + "_scaled" for c in FEATURES]
    if path and published(spark, path) is not None:
        model = load_tiers(spark, path)
    else:
        model = clustering.fit_kmeans(scored, cols, k=k)
        if path:
            save_tiers(spark, model, path)
    out = clustering.assign(model, scored, cols, out="__cluster")
    return clustering.rank_clusters(out, "__cluster", "performance_score",
                                    labels=TIER_LABELS if k == 3 else None, out="performance_tier")


def tier_silhouette(tiers: DataFrame) -> DataFrame:
    """How well the tiers of :func:`product_tiers` are apart: ``performance_tier, products, silhouette`` (mean, 6 decimals)."""
    each = clustering.silhouette(tiers, [c + "_scaled" for c in FEATURES], "performance_tier")
    return each.groupBy("performance_tier").agg(F.count(F.lit(1)).alias("products"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


def product_summary(scored: DataFrame, semantics: str = "corrected") -> DataFrame:
    """One row: ``avg_score`` (1 dp), ``top_product`` (name of the highest
    score, lowest id on ties), ``total_revenue`` (2 dp).

    ``reference`` mode sums the scaled revenue, as the reference does after
    overwriting the column.
    """
    check_semantics(semantics)
    revenue = F.col("revenue") if semantics == "corrected" else F.col("revenue_scaled")
    return scored.agg(
        F.round(F.avg("performance_score"), 1).alias("avg_score"),
        F.max_by("name", F.struct(F.col("performance_score"), -F.col("product_id"))).alias("top_product"),
        F.round(F.sum(revenue), 2).alias("total_revenue"),
    )

"""Product feature table and the content-based (k-NN) recommendations built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcast.operators import spine
from shopcast.operators.knn import cosine_topk
from shopcast.session import materialize
from shopcast.sources.tables import Tables

FEATURES = ("price", "avg_rating", "review_count", "total_sales", "price_log", "popularity")


def product_features(t: Tables, semantics: str = "corrected") -> DataFrame:
    """One row per product: ``product_id, name, price, avg_rating, review_count,
    total_sales, price_log, popularity``.

    ``total_sales`` counts every sale line regardless of status. In
    ``reference`` mode units are multiplied by the review count and reviews
    by the number of detail rows, as the literal join chain does.
    """
    spine.check_semantics(semantics)
    units = spine.product_units(t)
    reviews = spine.product_reviews(t)
    base = (t.product.select(F.col("id").alias("product_id"), "name", "price")
            .join(units, "product_id", "left")
            .join(reviews, "product_id", "left"))
    n_rev = F.coalesce(F.col("n_reviews"), F.lit(0))
    units_all = F.coalesce(F.col("units_all"), F.lit(0.0))
    if semantics == "corrected":
        review_count, total_sales = n_rev, units_all
    else:
        review_count = n_rev * F.coalesce(F.col("n_rows"), F.lit(1))
        total_sales = units_all * F.greatest(n_rev, F.lit(1))
    avg_rating = F.coalesce(F.col("avg_rating"), F.lit(0.0))
    price = F.col("price").cast("double")
    return base.select(
        "product_id", "name",
        price.alias("price"),
        avg_rating.alias("avg_rating"),
        review_count.cast("long").alias("review_count"),
        total_sales.alias("total_sales"),
        F.log1p(price).alias("price_log"),
        (review_count * avg_rating).alias("popularity"),
    )


def feature_scaler(feats: DataFrame) -> DataFrame:
    """``feature, min, max``: the min-max statistics of the six features."""
    stats = feats.agg(*[F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"))
                        .alias(c) for c in FEATURES])
    return stats.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}.min").alias("min"), F.col(f"{c}.max").alias("max"))
        for c in FEATURES])).alias("s")).select("s.*")


def scaled_feature_vectors(feats: DataFrame, scale: DataFrame) -> DataFrame:
    """``id, vec``: the six features min-max scaled with ``scale`` (six rows, see :func:`feature_scaler`); a constant feature scales to 0."""
    bounds = {r["feature"]: (r["min"], r["max"]) for r in scale.collect()}
    cols = []
    for c in FEATURES:
        lo, hi = bounds[c]
        x = F.col(c).cast("double")
        cols.append((x - F.lit(lo)) / F.lit(hi - lo) if lo is not None and hi > lo else F.lit(0.0))
    return feats.select(F.col("product_id").alias("id"), F.array(*cols).alias("vec"))


def content_based(t: Tables, targets: DataFrame, limit: int = 50, scaler: DataFrame | None = None) -> DataFrame:
    """Most similar products to each target (cosine over min-max scaled features).

    ``targets``: column ``product_id``. ``scaler``: statistics of a trained model,
    by default those of the live features. Output: ``target_id, product_id,
    product_name, similarity_score, price, average_rating``; the target
    itself is excluded, unknown targets give no rows.
    """
    feats = materialize(product_features(t))
    vecs = scaled_feature_vectors(feats, scaler if scaler is not None else feature_scaler(feats))
    q = vecs.join(targets.select(F.col("product_id").alias("id")).distinct(), "id", "left_semi")
    top = cosine_topk(q, vecs, limit)
    info = feats.select("product_id", F.col("name").alias("product_name"), "price",
                        F.col("avg_rating").alias("average_rating"))
    return top.join(info, top["item_id"] == info["product_id"]).select(
        F.col("query_id").alias("target_id"), "product_id", "product_name",
        F.col("similarity").alias("similarity_score"), "price", "average_rating")


def is_train(key: str = "product_id", share: int = 80) -> Column:
    """Deterministic ``share`` % / rest split on a key (stable under repartitioning)."""
    return F.pmod(F.col(key) * F.lit(7919) + F.lit(13), F.lit(100)) < F.lit(share)


def holdout_distance(t: Tables, k: int = 10) -> DataFrame:
    """Mean cosine distance from each held-out product to its ``k`` nearest
    training products (scaler fitted on the training split).

    One row: ``mean_distance, test_products, neighbours``.
    """
    feats = materialize(product_features(t))
    train = feats.where(is_train())
    test = feats.where(~is_train())
    scale = feature_scaler(train)
    top = cosine_topk(scaled_feature_vectors(test, scale), scaled_feature_vectors(train, scale), k,
                      exclude_self=False)
    return top.agg(F.round(F.avg(F.lit(1.0) - F.col("similarity")), 9).alias("mean_distance"),
                   F.countDistinct("query_id").alias("test_products"),
                   F.count(F.lit(1)).alias("neighbours"))

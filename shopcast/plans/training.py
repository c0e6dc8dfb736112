"""Training, evaluation and persistence of the recommendation models.

The content model is the min-max statistics of the product features (the
k-NN search itself runs on the live feature table); the collaborative model
is the item-similarity table, with the ratings and the sums per pair of items that it was made of. They are
published together as one version (``session.publish``), with the evaluation metrics. ``update`` brings a saved model up
to date from the ratings that changed, without training it anew.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcast.operators import ratings as rt
from shopcast.plans import features
from shopcast.session import materialize, publish, published
from shopcast.sources.tables import Tables


@dataclass
class RecommenderModel:
    scaler: DataFrame        # feature, min, max
    ratings: DataFrame       # user_id, product_id, rating
    statistics: DataFrame    # item_i, item_j, n, sij, sii, sjj
    similarity: DataFrame    # item_i, item_j, similarity
    metrics: DataFrame       # metric, value


def evaluate(t: Tables, folds: int = 3, k: int = 10) -> DataFrame:
    """``metric, value``: hold-out k-NN distance and per-fold / mean CV RMSE and MAE."""
    hold = features.holdout_distance(t, k=k).select(F.lit("knn_test_mean_distance").alias("metric"),
                                                    F.col("mean_distance").alias("value"))
    cv = rt.cross_validate(rt.ratings(t), folds=folds)
    per_fold = cv.select(F.explode(F.array(
        F.struct(F.concat(F.lit("cv_rmse_fold"), F.col("fold").cast("string")).alias("metric"), F.col("rmse").alias("value")),
        F.struct(F.concat(F.lit("cv_mae_fold"), F.col("fold").cast("string")).alias("metric"), F.col("mae").alias("value")),
    )).alias("m")).select("m.*")
    means = cv.agg(F.round(F.avg("rmse"), 6).alias("rmse"), F.round(F.avg("mae"), 6).alias("mae")).select(
        F.explode(F.array(F.struct(F.lit("cv_rmse_mean").alias("metric"), F.col("rmse").alias("value")),
                          F.struct(F.lit("cv_mae_mean").alias("metric"), F.col("mae").alias("value")))).alias("m")
    ).select("m.*")
    return hold.unionByName(per_fold).unionByName(means)


def train_recommender(t: Tables, path: str, folds: int = 3) -> DataFrame:
    """Fit, evaluate and save both models under ``path``; returns the metrics."""
    spark = t.product.sparkSession
    r = materialize(rt.ratings(t))
    statistics = materialize(rt.pair_statistics(r))
    version = publish(spark, path, {"scaler": features.feature_scaler(features.product_features(t)), "ratings": r, "statistics": statistics,
                                    "similarity": rt.similarity_of(statistics), "metrics": evaluate(t, folds=folds)})
    return spark.read.parquet(f"{version}/metrics")


def load(spark: SparkSession, path: str) -> RecommenderModel:
    """The model published last under ``path``."""
    version = published(spark, path)
    if version is None:
        raise FileNotFoundError(f"no model is published under {path}")
    return RecommenderModel(**{f.name: spark.read.parquet(f"{version}/{f.name}") for f in fields(RecommenderModel)})


def load_or_train(t: Tables, path: str) -> RecommenderModel:
    """Load the saved models; train and save them first when there are none under ``path``."""
    spark = t.product.sparkSession
    if published(spark, path) is None:
        train_recommender(t, path)
    return load(spark, path)


def update(t: Tables, path: str) -> RecommenderModel:
    """Publish the model under ``path`` as it is for the tables now, from the ratings that changed since.

    The metrics are those of the last training: evaluating is training three times.
    """
    spark = t.product.sparkSession
    model = load(spark, path)
    now = materialize(rt.ratings(t))
    changes = materialize(rt.rating_changes(model.ratings, now))
    statistics = materialize(rt.update_statistics(model.statistics, model.ratings, changes))
    publish(spark, path, {"scaler": features.feature_scaler(features.product_features(t)), "ratings": now, "statistics": statistics,
                          "similarity": rt.similarity_of(statistics), "metrics": model.metrics})
    return load(spark, path)

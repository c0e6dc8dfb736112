"""Employee performance: completion rate, standardized features, k-means
clusters, isolation-forest anomalies and a 0–100 score.

The fitted state (scaler statistics, k-means model, forest) lives in an
``EmployeeModel`` that can be saved to and loaded from a directory; without
one the model is fitted on the given records, standardized once and used in
that same space for fitting and prediction.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcast.functions.expr import guarded_ratio, minmax
from shopcast.operators import clustering, iforest
from shopcast.session import materialize, publish, published
from shopcast.sources.tables import require_columns, require_rows

METRICS = ["completed_tasks", "total_tasks", "avg_task_hours"]
FEATURES = ["completed_tasks", "total_tasks", "avg_task_hours", "completion_rate"]
# Fixed score weights of the reference job.
W_RATE, W_HOURS, W_DONE = 0.4, 0.3, 0.3


def features(df: DataFrame) -> DataFrame:
    """Missing metrics → 0, plus ``completion_rate`` (0 when total is not positive)."""
    return (df.fillna(0.0, subset=METRICS)
            .withColumn("completion_rate", guarded_ratio("completed_tasks", "total_tasks")))


def score(df: DataFrame) -> DataFrame:
    """``performance_score``: weighted raw score, min-max scaled to 0–100 over the batch."""
    raw = (F.lit(W_RATE) * F.col("completion_rate") + F.lit(W_HOURS) * (F.lit(1.0) - F.col("avg_task_hours"))
           + F.lit(W_DONE) * F.col("completed_tasks"))
    return minmax(df.withColumn("performance_score", raw), ["performance_score"], scale=100.0)


def employee_scores(df: DataFrame) -> DataFrame:
    """Input columns + ``completion_rate`` + ``performance_score`` (no models)."""
    return score(features(df))


@dataclass
class EmployeeModel:
    mean: dict[str, float]
    std: dict[str, float]
    kmeans: clustering.KMeans | None = None
    forest: iforest.Forest | None = None

    def standardize(self, df: DataFrame) -> DataFrame:
        """``z_*`` columns, rounded so that the last bit of a mean doesn't decide a split."""
        out = df
        for c in FEATURES:
            mu, sd = self.mean[c], self.std[c]
            z = F.round((F.col(c) - F.lit(mu)) / F.lit(sd), clustering.ROUND) if sd > 0 else F.lit(0.0)
            out = out.withColumn(f"z_{c}", z)
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """Two tables, published together under ``path``: the forest's nodes, and one row of JSON with the rest."""
        meta = {"mean": self.mean, "std": self.std, "centres": self.kmeans.centres, "cols": self.forest.cols,
                "psi": self.forest.psi, "threshold": self.forest.threshold}
        publish(spark, path, {"forest": spark.createDataFrame(self.forest.nodes), "meta": spark.createDataFrame([(json.dumps(meta),)], "meta string")})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EmployeeModel:
        version = published(spark, path)
        if version is None:
            raise FileNotFoundError(f"no model is published under {path}")
        meta = json.loads(spark.read.parquet(f"{version}/meta").first()["meta"])
        nodes = spark.read.parquet(f"{version}/forest").toPandas()
        forest = iforest.Forest(nodes=nodes, cols=meta["cols"], psi=meta["psi"], threshold=meta["threshold"])
        return cls(meta["mean"], meta["std"], clustering.KMeans(meta["cols"], meta["centres"]), forest)


def fit_scaler(df: DataFrame) -> EmployeeModel:
    """The means and standard deviations of the features."""
    f = features(df)
    stats = f.agg(*[F.avg(c).alias(f"m_{c}") for c in FEATURES],
                  *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES]).first()
    return EmployeeModel({c: float(stats[f"m_{c}"]) for c in FEATURES}, {c: float(stats[f"s_{c}"] or 0.0) for c in FEATURES})


def fit(df: DataFrame, id_col: str = "employee_id", k: int = 3, contamination: float = 0.05,
        parts: tuple[str, ...] = ("clusters", "anomalies")) -> EmployeeModel:
    """Scaler and, as ``parts`` asks, the clusters and the forest."""
    df = materialize(df)
    model = fit_scaler(df)
    zcols = [f"z_{c}" for c in FEATURES]
    z = materialize(model.standardize(features(df)).select(id_col, *zcols))
    if "clusters" in parts:
        model.kmeans = clustering.fit_kmeans(z, zcols, k=k)
    if "anomalies" in parts:
        model.forest = iforest.fit(z, zcols, id_col, contamination=contamination)
    return model


def load_or_fit(df: DataFrame, path: str, **kw) -> EmployeeModel:
    """Load the model saved under ``path``; when there is none, fit on ``df`` and save it there."""
    spark = df.sparkSession
    if published(spark, path) is not None:
        return EmployeeModel.load(spark, path)
    model = fit(df, **kw)
    model.save(spark, path)
    return model


def employee_performance(df: DataFrame, model: EmployeeModel | None = None,
                         id_col: str = "employee_id") -> DataFrame:
    """Input columns + ``completion_rate, performance_cluster, is_anomaly, performance_score``.

    ``performance_cluster`` is 0/1/2 ordered by the clusters' mean score. A model
    fitted for one part only gives only that part's column.
    """
    require_columns(df, [id_col, *METRICS])
    df = materialize(df)
    require_rows(df, "employee records")
    model = model or fit(df, id_col=id_col)
    zcols = [f"z_{c}" for c in FEATURES]
    out = score(model.standardize(features(df)))
    if model.forest:
        out = iforest.flag(out, model.forest, out="is_anomaly").drop("anomaly_score")
    if model.kmeans:
        out = clustering.assign(model.kmeans, out, zcols, out="__cluster")
        out = clustering.rank_clusters(out, "__cluster", "performance_score", out="performance_cluster")
    return out.drop(*zcols)

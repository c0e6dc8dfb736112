"""k-means as Spark aggregates, clusters labelled by their mean score.

The first centres come from oversampled rounds (k-means‖), with draws that are hashes of the rows, so a
rerun draws the same: in each of ``ROUNDS`` rounds every distinct row is drawn with a chance
proportional to its number of repeats and its squared distance to the rows drawn so far. Each drawn row weighs
as many rows as are nearest to it, and the ``k`` centres are taken from them one by one, largest
weight times squared distance first. A Lloyd step
sums the rows per cluster in every task; steps go on until the centres, rounded to
``ROUND`` decimals, stay (or come back). Cluster ids are arbitrary, so the jobs order clusters by the mean of a score column: label 0 /
"Low" is always the weakest cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopcast.operators.iforest import PRIME, mixed
from shopcast.session import materialize

DEFAULT_K = 3
ROUND = 9
#: Rounds of draws for the first centres.
ROUNDS = 3


def require_distinct_rows(df: DataFrame, cols: list[str], k: int) -> None:
    """k-means needs at least ``k`` distinct feature rows (a limit-k job)."""
    n = df.select(*cols).distinct().limit(k).count()
    if n < k:
        raise ValueError(f"k-means with k={k} needs at least {k} distinct feature rows, got {n}")


@dataclass
class KMeans:
    cols: list[str]
    centres: list[list[float]]

    def nearest(self) -> Column:
        """Number of the nearest centre, the first of equally near ones."""
        d = [sum(((F.col(c) - F.lit(x)) * (F.col(c) - F.lit(x)) for c, x in zip(self.cols, xs, strict=True)), F.lit(0.0))
             for xs in self.centres]
        return (F.array_position(F.array(*d), F.array_min(F.array(*d))) - 1).cast("int")


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, summed up in the order of the columns, for the same last bit everywhere."""
    d = np.zeros((len(x), len(centres)))
    for i in range(x.shape[1]):
        d += (x[:, [i]] - centres[:, i]) * (x[:, [i]] - centres[:, i])
    return d


def _draw(x: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each row, from its values in millionths."""
    h = np.zeros(len(x), np.int64)
    for i in range(x.shape[1]):
        h = mixed(h + np.floor(x[:, i] * 1e6 + 0.5).astype(np.int64) % PRIME, i)
    return mixed(h, salt) / PRIME


def _first_centres(df: DataFrame, cols: list[str], k: int, rounds: int = ROUNDS) -> list[list[float]]:
    """Starts by k-means‖; the drawn rows, about ``2 * k`` a round, are all that reaches the driver."""
    points = materialize(df.groupBy(*[F.col(c).cast("double").alias(c) for c in cols]).agg(F.count(F.lit(1)).alias("__m")))
    schema = ", ".join([*[f"`{c}` double" for c in cols], "__m long", "__v double"])

    def near(drawn: np.ndarray, value):
        """Rows of ``points`` with ``value(rows, repeats, squared distance to the nearest drawn row, which one)``; rows without are left out."""
        def run(batches):
            for rows in batches:
                x, m = rows[cols].to_numpy(dtype=float), rows["__m"].to_numpy()
                d = _squared(x, drawn) if len(drawn) else np.zeros((len(x), 1))
                v = value(x, m, d.min(axis=1), d.argmin(axis=1))
                yield rows.assign(__v=v)[~np.isnan(v)]
        return points.mapInPandas(run, schema)

    def rows(found: DataFrame) -> list[tuple]:
        return [tuple(r[c] for c in cols) for r in found.select(*cols).collect()]

    first = near(np.zeros((0, len(cols))), lambda x, m, d, i: _draw(x, 100)).orderBy("__v", *cols).limit(1)
    drawn = rows(first)
    for r in range(1, rounds + 1):
        at = np.array(drawn)
        total = near(at, lambda x, m, d, i: m * d).agg(F.sum("__v")).first()[0]
        drawn = sorted(set(drawn) | set(rows(near(at, lambda x, m, d, i, r=r, total=total: np.where(_draw(x, 100 + r) * total < 2 * k * m * d, 1.0, np.nan)))))  # noqa: B023
    while len(drawn) < k:  # hardly ever: the row that weighs most among those left
        at = np.array(drawn)
        drawn = sorted(drawn + rows(near(at, lambda x, m, d, i: m * d).orderBy(F.desc("__v"), *cols).limit(1)))
    at = np.array(drawn)
    weight = np.zeros(len(at))
    for r in near(at, lambda x, m, d, i: i.astype(float)).groupBy("__v").agg(F.sum("__m").alias("w")).collect():
        weight[int(r["__v"])] = r["w"]
    chosen = [int(np.argmax(weight))]
    while len(chosen) < k:
        chosen.append(int(np.argmax(weight * _squared(at, at[chosen]).min(axis=1))))
    return [list(map(float, at[c])) for c in chosen]


def silhouette(df: DataFrame, cols: list[str], cluster: str) -> DataFrame:
    """``df`` with ``silhouette``: (b − a) / max(a, b) of each row, by squared Euclidean distance, exactly.

    a is the mean distance to the other rows of the row's cluster, b the smallest mean distance to the rows of
    another; alone in its cluster, or without another cluster, a row has 0. The means follow from
    the number, sum and sum of squares of each cluster, so no pair of rows is looked at.
    """
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    norm = sum((v * v for v in x), F.lit(0.0))
    stats = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(norm).alias("q"), F.array(*[F.sum(v) for v in x]).alias("s"))
    every = stats.agg(F.collect_list(F.struct(F.col(cluster).alias("g"), "n", "q", "s")).alias("__stats"))  # a row with one entry per cluster
    dot = lambda c: sum((v * c["s"][i] for i, v in enumerate(x)), F.lit(0.0))
    total = lambda c: F.greatest(c["n"] * norm - 2 * dot(c) + c["q"], F.lit(0.0))
    mine = lambda c: c["g"].eqNullSafe(F.col(cluster))
    own = F.filter("__stats", mine)[0]
    a = total(own) / (own["n"] - 1)
    b = F.array_min(F.transform(F.filter("__stats", lambda c: ~mine(c)), lambda c: total(c) / c["n"]))
    value = F.when((own["n"] > 1) & b.isNotNull() & (F.greatest(a, b) > 0), (b - a) / F.greatest(a, b)).otherwise(F.lit(0.0))
    return df.withColumn("__stats", every.scalar()).withColumn("silhouette", value).drop("__stats")


def _step(df: DataFrame, model: KMeans) -> KMeans:
    """One Lloyd step: every task sums its rows per cluster, k rows per task are added up on the driver.

    The centres are data of the tasks, not literals of the plan, which would be compiled anew in every step.
    """
    cols, centres = model.cols, np.array(model.centres)

    def sums(batches):
        total = np.zeros((len(centres), len(cols) + 1))
        for rows in batches:
            x = rows[cols].to_numpy(dtype=float)
            near = _squared(x, centres).argmin(axis=1)  # as in KMeans.nearest
            for c in range(len(centres)):
                total[c] += [*x[near == c].sum(axis=0), (near == c).sum()]
        yield pd.DataFrame(total, columns=[*cols, "n"]).assign(c=range(len(centres)))

    schema = ", ".join([*[f"`{c}` double" for c in cols], "n double", "c int"])
    total = np.zeros((len(centres), len(cols) + 1))
    for r in df.select(*cols).mapInPandas(sums, schema).collect():
        total[r["c"]] += [*(r[c] for c in cols), r["n"]]
    return KMeans(cols, [[round(float(x), ROUND) for x in t[:-1] / t[-1]] if t[-1] else old for t, old in zip(total, model.centres, strict=True)])


def fit_kmeans(df: DataFrame, cols: list[str], k: int = DEFAULT_K) -> KMeans:
    """Centres of ``k`` clusters of the rows of ``df``, which is read once per step: pass a written frame."""
    require_distinct_rows(df, cols, k)
    model, seen = KMeans(list(cols), _first_centres(df, cols, k)), set()
    while (state := tuple(map(tuple, model.centres))) not in seen:
        seen.add(state)
        model = _step(df, model)
    return model


def assign(model: KMeans, df: DataFrame, cols: list[str], out: str = "cluster") -> DataFrame:
    return df.withColumn(out, KMeans(list(cols), model.centres).nearest())


def rank_clusters(df: DataFrame, cluster: str, score: str, labels: list[str] | None = None,
                  out: str | None = None) -> DataFrame:
    """Replace arbitrary cluster ids by their rank of mean ``score`` (0 = lowest).

    With ``labels`` the rank is mapped to a label (e.g. Low / Medium / High). The
    label table has a row per cluster and is broadcast.
    """
    means = df.groupBy(cluster).agg(F.round(F.avg(score), ROUND).alias("__mean"))
    ranks = means.withColumn("__rank", (F.row_number().over(Window.orderBy("__mean", cluster)) - 1).cast("int"))
    if labels:
        mapping = F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(i), F.lit(lab))])
        ranks = ranks.withColumn("__label", mapping[F.col("__rank")])
    else:
        ranks = ranks.withColumn("__label", F.col("__rank"))
    target = out or cluster
    return (df.join(F.broadcast(ranks.select(cluster, "__label")), cluster)
            .drop(cluster).withColumnRenamed("__label", target))

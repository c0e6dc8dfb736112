"""Isolation forest (Liu, Ting & Zhou, 2008) as a Spark job.

1. Sample: each tree takes the ``psi`` rows of smallest hash (row id, tree). A task
   keeps the ``psi`` smallest per tree of the rows it reads, and a window merges
   what the tasks kept: at most ``trees * psi`` rows per task are shuffled.
2. Build: ``groupBy(tree).applyInPandas`` grows one tree from at most
   ``psi`` rows. Features and split places come from hashes of (node, tree).
3. Score: the forest has at most ``trees * (2 psi - 1)`` nodes — a size fixed by
   the parameters — and is broadcast; a pandas UDF over the feature columns
   walks the trees, all other columns stay in the JVM. Scores are rounded to
   ``ROUND`` decimals.
4. Threshold: the ``1 - contamination`` quantile of the training scores, exact
   (rounded scores have at most 10**ROUND distinct values); rows above it
   are anomalies.

The hash is integer arithmetic below 2**63, so SQL can repeat it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.functions.expr import top_n

ROUND = 6
PRIME = 2**31 - 1
_EULER = 0.5772156649015329
NODE_SCHEMA = "tree int, node long, feature int, split double, size long, depth int"


def mixed(x, salt):
    """Hash of whole numbers (arrays or ints) with a salt, below ``PRIME``."""
    h = (x % PRIME + 1) * ((salt * 7919 + 104_729) % PRIME) % PRIME
    h = (h ^ (h >> 15)) * 48_271 % PRIME
    return (h ^ (h >> 13)) * 69_621 % PRIME


def avg_path(n: float) -> float:
    """Average unsuccessful-search path length in a binary search tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n


@dataclass
class Forest:
    nodes: pd.DataFrame          # NODE_SCHEMA rows, at most trees * (2*psi - 1)
    cols: list[str]
    psi: int
    threshold: float | None = None


def _grow(x: np.ndarray, tree: int, max_depth: int) -> list[tuple]:
    """Grow one isolation tree; rows (node, feature, split, size, depth). A node's children are 2 * node and 2 * node + 1."""
    rows: list[tuple] = []
    stack = [(np.arange(len(x)), 1, 0)]
    while stack:
        idx, node, depth = stack.pop()
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= max_depth or len(idx) <= 1 or usable.size == 0:
            rows.append((node, -1, 0.0, len(idx), depth))
            continue
        f = int(usable[mixed(node, tree + 1000) % len(usable)])
        split = float(lo[f] + (hi[f] - lo[f]) * ((mixed(node, tree + 2000) % 1_048_576 + 0.5) / 1_048_576.0))
        left = sub[:, f] < split
        rows.append((node, f, split, len(idx), depth))
        stack += [(part, 2 * node + right, depth + 1) for right, part in enumerate((idx[left], idx[~left])) if len(part)]
    return rows


def _smallest(trees: int, psi: int):
    """Of a task's rows, the ``psi`` of smallest hash per tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame | None] = [None] * trees
        for rows in batches:
            ids = rows["__id"].to_numpy(np.int64)
            for t in range(trees):
                h = mixed(ids, t)
                near = rows.iloc[np.argpartition(h, psi - 1)[:psi]] if len(h) > psi else rows
                near = near.assign(tree=t, __h=mixed(near["__id"].to_numpy(np.int64), t))
                both = near if kept[t] is None else pd.concat([kept[t], near])
                kept[t] = both.sort_values(["__h", "__id"]).head(psi)
        yield from (k for k in kept if k is not None)

    return run


def fit(df: DataFrame, cols: list[str], id_col: str, trees: int = 100, psi: int = 256,
        contamination: float = 0.05) -> Forest:
    """Fit a forest on ``cols`` of ``df`` (``id_col``, a whole number, must identify rows)."""
    n = df.count()
    if n == 0:
        raise ValueError("isolation forest needs at least one row")
    psi = int(min(psi, n))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id"), *[F.col(c).cast("double").alias(c) for c in cols])
    near = rows.mapInPandas(_smallest(trees, psi), ", ".join(["__id long", *[f"`{c}` double" for c in cols], "tree int", "__h long"]))
    sample = top_n(near, ["tree"], [F.col("__h"), F.col("__id")], psi)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        out = pd.DataFrame(_grow(pdf[cols].to_numpy(dtype=float), tree, max_depth), columns=["node", "feature", "split", "size", "depth"])
        out.insert(0, "tree", tree)
        return out

    nodes = sample.groupBy("tree").applyInPandas(build, NODE_SCHEMA).toPandas()
    forest = Forest(nodes=nodes, cols=list(cols), psi=psi)
    forest.threshold = float(score(df, forest).agg(F.percentile("anomaly_score", 1.0 - contamination)).first()[0])
    return forest


class Walker:
    """The forest's nodes as arrays, children by position."""

    def __init__(self, nodes: pd.DataFrame):
        self.trees = []
        for _, t in nodes.groupby("tree"):
            t = t.sort_values("node")
            ids = t["node"].to_numpy()
            place = {n: i for i, n in enumerate(ids.tolist())}
            child = np.array([[place.get(2 * n, 0), place.get(2 * n + 1, 0)] for n in ids.tolist()])
            leaf = np.array([d + avg_path(s) for d, s in zip(t["depth"], t["size"], strict=True)])
            self.trees.append((t["feature"].to_numpy(), t["split"].to_numpy(), child, leaf))

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        """Mean adjusted path length of every row of ``x`` over all trees."""
        total = np.zeros(len(x))
        for feature, split, child, leaf in self.trees:
            cur = np.zeros(len(x), dtype=int)
            rows = np.flatnonzero(feature[cur] >= 0)
            while rows.size:
                at = cur[rows]
                cur[rows] = child[at, (x[rows, feature[at]] >= split[at]).astype(int)]
                rows = rows[feature[cur[rows]] >= 0]
            total += leaf[cur]
        return total / max(len(self.trees), 1)


def score(df: DataFrame, forest: Forest) -> DataFrame:
    """``df`` + ``anomaly_score`` in (0, 1]; higher is more anomalous."""
    bc = df.sparkSession.sparkContext.broadcast(forest.nodes)
    c_psi = avg_path(forest.psi)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        walker = Walker(bc.value)  # once per task
        for x in batches:
            h = walker.path_lengths(x.to_numpy(dtype=float))
            yield pd.Series(np.power(2.0, -h / c_psi) if c_psi > 0 else np.ones(len(x)))

    # pandas_udf reads the kind of function from the hints, as objects.
    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(run, "double")
    features = F.struct(*[F.col(c).cast("double").alias(c) for c in forest.cols])
    return df.withColumn("anomaly_score", F.round(udf(features), ROUND))


def flag(df: DataFrame, forest: Forest, out: str = "is_anomaly") -> DataFrame:
    """``df`` + ``anomaly_score`` + boolean ``out`` (score above the fitted threshold)."""
    if forest.threshold is None:
        raise ValueError("forest has no threshold; fit it first")
    return score(df, forest).withColumn(out, F.col("anomaly_score") > F.lit(forest.threshold))

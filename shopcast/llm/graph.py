"""Connected components of a graph given as links, by alternating star operations.

In a large-star step every node links its larger neighbours to its smallest
one; in a small-star step it links its smaller neighbours to their smallest. The
links shrink to stars whose centre is the smallest node of each component.
Neither step gathers a node's neighbours: each is a minimum per node, partly
aggregated before the shuffle, and a join with it. Links are written to the
checkpoint folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.llm.common import materialize


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``links`` (u, v: long) that aren't their component's smallest; label is the smallest."""
    e = materialize(links.where("u <> v").select("u", "v").distinct())
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = now
        e = materialize(_small(_large(e)))

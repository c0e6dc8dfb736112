"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Method. A source's target is its weight's share of all words, at most
``max_repeat`` times what the source has; what targets beyond that leave over is
shared again by weight. Each document of a source expects target / source_size
copies. Within a source, documents are ordered by size, the expected copies are
summed up, one offset (from a hash of the source and the seed) is added, and a
document is emitted once per integer boundary that the sum crosses in it. In
order of size, the words taken differ from the target by less than the largest
document of the source.

Scale: a source may hold most of the rows, so the running sum is not a window
over a source. Slim rows are range-partitioned by (source, size, hash of the id,
id), which splits a source over many tasks; a row's place in its partition is
counted as it is written to the checkpoint folder, and the number of a source's
rows in earlier partitions is added from a table with a row per partition and
source. The slim rows are written once and only the written copy is used, so
partition numbers can't change between uses.

Rows: null text counts as empty (size 0, expects the same number of copies as
its source's other documents); a null source is a source of its own, last in
order; repeated rows are sampled each; null ids are allowed; an empty table
gives an empty result; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shopcast.llm.common import WORD, free_name, materialize, row_key

#: Weights of the sources in code-point order of their names, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 20240229


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds ``target`` to (source, source_size), one row per source.

    Resharing the excess until no target is above its bound gives
    min(weight * rate, bound) for one rate. In order of bound / weight the
    bounded sources come first, so the rate follows from running sums. The
    window holds a row per source, not per document.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    bound = (F.col("source_size") * max_repeat).cast("double")
    w = sizes.select("source", "source_size", weight.alias("weight"), bound.alias("bound"))
    by_ratio = W.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    rate = (F.sum("source_size").over(W.partitionBy(F.lit(1))) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    w = w.select("source", "source_size", "weight", "bound", rate.alias("rate"), (F.col("bound") <= F.col("weight") * rate).alias("full"))
    # The first source that is not full sets the rate of those after it.
    final = F.first(F.when(~F.col("full"), F.col("rate")), ignorenulls=True).over(W.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0))
    return w.select("source", "source_size", F.when(F.col("full") & final.isNull(), F.col("bound")).otherwise(F.least("bound", F.col("weight") * final)).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, source, row_hash, size, source_size, target, copies, taken."""
    keys = ["source", "size", "h", "doc_id", "row_hash", "salt"]
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", F.lit(seed)).alias("h"), row_key(docs).alias("row_hash"), F.monotonically_increasing_id().alias("salt"))
    slim = materialize(slim)  # range bounds are sampled from it first, so the texts would be read twice
    rows = materialize(slim.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).drop("h", "salt").withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("part", "source").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.sum("size").alias("words"))
    sizes = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    t = targets(sizes, weights, max_repeat).withColumn("expected", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    t = t.withColumn("offset", F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("earlier", earlier).alias("p").join(t.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    parts = parts.select(F.col("p.part").alias("p_part"), F.col("p.source").alias("p_source"), "first", "earlier", "source_size", "target", "expected", "offset")
    place = F.col("at") - F.col("first") + F.col("earlier")
    crossed = F.floor((place + 1) * F.col("expected") + F.col("offset")) - F.floor(place * F.col("expected") + F.col("offset"))
    out = rows.join(parts, (rows["part"] == parts["p_part"]) & rows["source"].eqNullSafe(parts["p_source"])).withColumn("copies", crossed.cast("long"))
    return out.select("doc_id", "source", "row_hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, with the columns of ``docs``.

    Rows equal in every column are one row here whose copies add up; the
    removal of repeats and the join use the same partitioning by (id, row hash).
    """
    copies = plan(docs, weights, max_repeat, seed).groupBy("doc_id", "row_hash").agg(F.sum("copies").alias("n")).where("n > 0")
    names = {k: free_name(docs, f"__{k}") for k in ("id", "row", "n", "copy")}
    # The row hash tells a null id from others, so the id may be any value in its place.
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    copies = copies.select(known("doc_id").alias(names["id"]), F.col("row_hash").alias(names["row"]), F.col("n").cast("int").alias(names["n"]))
    rows = docs.withColumns({names["id"]: known("doc_id"), names["row"]: row_key(docs)}).dropDuplicates([names["id"], names["row"]])
    out = rows.join(copies, [names["id"], names["row"]])
    return out.withColumn(names["copy"], F.explode(F.sequence(F.lit(1), F.col(names["n"])))).drop(*names.values())

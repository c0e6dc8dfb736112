"""Exact per-user top-k of ``w(p) · (5 − |c(p) − a(u)|)`` without a users × items cross join.

The score of an item depends on the user only through one number ``a(u)``
(the user's mean rating), and users share few such numbers. So the best items are listed once per
*distinct* number and attached to its users.

A user who excludes ``m(u)`` items (already bought) finds the best ``k`` among the first
``k + m(u)`` of the list; lengths are rounded up to powers of two, so few lists per number are needed. The
numbers are cut into intervals (``bands``). A task has one interval and one chunk of the items: inside the interval ``[lo, hi]``
every item has a lower and an upper bound of its score, and items whose upper bound is below the n-th largest
lower bound are out for all its numbers; the rest are scored exactly. Lists of chunks are merged.

Users get their list by an equi-join on (number, length); a number that many users share (all those without
reviews) is cut into salts. What a user excludes is taken out of the list as an array, for users
with very many exclusions by an anti-join of their list's rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.functions.expr import top_n
from shopcast.operators.blocked import flat, starts
from shopcast.session import materialize

# Relative slack on the threshold; it only adds candidates, so the result
# stays exact when the bounds round differently from the score.
_SLACK = 1e-9
#: Items of a chunk, distinct numbers of an interval, users of a salt, exclusions that are taken out as an array.
CHUNK, NUMBERS, SALT, SEEN = 1 << 16, 1024, 1 << 16, 256
_CELLS = 1 << 21


def banded_topk(items: DataFrame, users: DataFrame, exclude: DataFrame, *, weight: str, centre: str,
                user_value: str, k: int, bands: int = 32, item_key: str = "product_id",
                user_key: str = "user_id", full: float = 5.0, chunk: int = CHUNK, salt: int = SALT, seen: int = SEEN) -> DataFrame:
    """Top ``k`` items per user by ``weight · (full − |centre − user_value|)``.

    ``items``: one row per item (``item_key``, ``weight``, ``centre`` and
    pass-through columns). ``users``: ``user_key, user_value``, each user once.
    ``exclude``: ``user_key, item_key`` pairs that must not be recommended.
    Output: item columns + ``user_key`` + ``score``; ties broken by item key.
    """
    items = materialize(items)
    excl = exclude.select(user_key, item_key).distinct().join(items.select(item_key), item_key, "left_semi")
    own = excl.groupBy(user_key).agg(F.collect_list(item_key).alias("__own"))
    n = F.lit(k) + F.coalesce(F.size("__own"), F.lit(0))
    u = materialize(users.select(user_key, F.col(user_value).alias("__a")).join(own, user_key, "left")
                    .withColumn("__n", F.pow(F.lit(2), F.ceil(F.log2(n))).cast("long")))
    lists = _lists(items, u, weight, centre, item_key, full, bands, chunk)

    # A list for each salt of a number that many users share; such numbers are few, at most users / salt.
    many = (u.groupBy("__a", "__n").agg(F.ceil(F.count(F.lit(1)) / salt).cast("int").alias("__salts")).where(F.col("__salts") > 1))
    salted = lambda df, s: df.join(F.broadcast(many), ["__a", "__n"], "left").withColumn("__salt", s).drop("__salts")
    salts = F.coalesce("__salts", F.lit(1))
    mine = (salted(u, F.pmod(F.xxhash64(user_key), salts).cast("int"))
            .join(salted(lists, F.explode(F.sequence(F.lit(0), salts - 1))), ["__a", "__n", "__salt"]))
    few = F.coalesce(F.size("__own"), F.lit(0)) <= seen
    rest = F.filter("__list", lambda x: ~F.array_contains(F.coalesce("__own", F.array()), x["id"]))
    light = mine.where(few).select(user_key, F.explode(F.slice(rest, 1, k)).alias("__e"))
    heavy = (mine.where(~few).select(user_key, F.explode("__list").alias("__e")).withColumn(item_key, F.col("__e.id"))
             .join(excl, [user_key, item_key], "left_anti"))
    heavy = top_n(heavy, [user_key], [F.col("__e.s"), F.col(item_key)], k).select(user_key, "__e")
    return light.unionByName(heavy).select(user_key, "__e.item.*", (-F.col("__e.s")).alias("score"))


def _lists(items: DataFrame, u: DataFrame, weight: str, centre: str, item_key: str, full: float, bands: int, chunk: int) -> DataFrame:
    """``__a, __n, __list``: for each distinct number and length the best items as structs (s = -score, id, item), best first."""
    wanted = materialize(u.select("__a", "__n").distinct())
    low, high, d = wanted.agg(F.min("__a"), F.max("__a"), F.count(F.lit(1))).first()
    bands = max(1, min(bands, d), math.ceil(d / NUMBERS))
    width = (high - low) / bands if d else 0.0
    chunks = max(1, math.ceil(items.count() / chunk))
    band = F.least(F.floor((F.col("__a") - F.lit(low)) / F.lit(width)), F.lit(bands - 1)).cast("int") if width > 0 else F.lit(0)
    left = (wanted.groupBy(band.alias("band")).agg(F.collect_list(F.struct("__a", "__n")).alias("w"))
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))))
    packed = F.collect_list(F.struct(F.col(item_key).alias("id"), F.col(weight).cast("double").alias("w"), F.col(centre).cast("double").alias("c")))
    right = (items.groupBy(F.pmod(F.xxhash64(item_key), F.lit(chunks)).cast("int").alias("chunk")).agg(packed.alias("i"))
             .withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))))
    met = left.join(right, ["band", "chunk"]).select(F.col("w.__a").alias("a"), F.col("w.__n").alias("n"), F.col("i.id").alias("id"), F.col("i.w").alias("w"), F.col("i.c").alias("c"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                a, n, ids, w, c = (flat(b.slice(r, 1).column(x))[0] for x in ("a", "n", "id", "w", "c"))
                order = np.argsort(ids)
                yield from best_items(a, n, ids[order], w[order], c[order], full)

    best = met.mapInArrow(work, "__a double, __n long, id array<long>, score array<double>")
    rows = best.select("__a", "__n", F.explode(F.arrays_zip(F.col("id"), F.transform("score", lambda s: -s).alias("s"))).alias("e"))
    item = F.struct(*[F.col(f"`{c}`") for c in items.columns])
    rows = rows.select("__a", "__n", "e.s", "e.id").join(items.select(F.col(item_key).alias("id"), item.alias("item")), "id")
    found = F.sort_array(F.collect_list(F.struct("s", "id", "item")))
    return materialize(rows.groupBy("__a", "__n").agg(F.slice(found, F.lit(1), F.col("__n").cast("int")).alias("__list")))


def best_items(a: np.ndarray, n: np.ndarray, ids: np.ndarray, w: np.ndarray, c: np.ndarray, full: float) -> Iterator[pa.RecordBatch]:
    """For each number ``a`` the best ``n`` items (``ids`` ascending) with their scores, best first, one length after the other."""
    for length in np.unique(n).tolist():
        mine = np.sort(a[n == length])
        left = np.arange(len(ids))
        if len(ids) > length:
            low, high = mine[0], mine[-1]
            small = full - np.maximum(abs(c - low), abs(c - high))
            large = full - np.maximum(np.maximum(low - c, c - high), 0.0)
            lower, upper = np.minimum(w * small, w * large), np.maximum(w * small, w * large)
            bar = np.partition(lower, len(lower) - length)[len(lower) - length]
            left = np.flatnonzero(upper >= bar - abs(bar) * _SLACK)
        step = max(1, _CELLS // max(1, len(left)))
        for at in range(0, len(mine), step):
            part = mine[at:at + step]
            score = w[left] * (full - abs(c[left] - part[:, None]))
            order = np.argsort(-score, axis=1, kind="stable")[:, :length]
            offsets = pa.array(starts(np.full(len(part), order.shape[1])).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.float64()), pa.array(np.full(len(part), length), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids[left][order].ravel(), pa.int64())),
                 pa.ListArray.from_arrays(offsets, pa.array(np.take_along_axis(score, order, 1).ravel(), pa.float64()))], ["__a", "__n", "id", "score"])


def brute_force_topk(items: DataFrame, users: DataFrame, exclude: DataFrame, *, weight: str, centre: str,
                     user_value: str, k: int, item_key: str = "product_id", user_key: str = "user_id",
                     full: float = 5.0) -> DataFrame:
    """Reference answer for tests on small fixtures: score every (user, item) pair."""
    pairs = users.select(user_key, user_value).crossJoin(items)
    pairs = pairs.join(exclude.select(user_key, item_key), [user_key, item_key], "left_anti")
    scored = pairs.withColumn("score", F.col(weight) * (F.lit(full) - F.abs(F.col(centre) - F.col(user_value))))
    return top_n(scored, [user_key], [F.col("score").desc(), F.col(item_key)], k).drop(user_value)


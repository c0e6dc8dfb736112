"""User × product ratings and the item-based k-NN model on top of them.

Ratings: explicit review ratings plus an implicit 4.0 for every completed
purchase line, averaged per (user, product). Both sides are pre-aggregated to
(sum, count) per pair before the union, so the final average is one more
partial/final aggregate on the same key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcast.operators import blocked as bl
from shopcast.operators import spine
from shopcast.session import compact, materialize
from shopcast.sources.tables import Tables

IMPLICIT_RATING = 4.0


def ratings(t: Tables, implicit: float = IMPLICIT_RATING) -> DataFrame:
    """``user_id, product_id, rating`` — one row per pair; NULL keys dropped."""
    explicit = (t.review.where(F.col("rating").isNotNull())
                .where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
                .groupBy("user_id", "product_id")
                .agg(F.sum("rating").alias("__s"), F.count(F.lit(1)).alias("__n")))
    bought = spine.purchases(t).where(F.col("product_id").isNotNull()).select(
        "user_id", "product_id",
        (F.col("lines") * F.lit(float(implicit))).alias("__s"),
        F.col("lines").alias("__n"))
    return (explicit.unionByName(bought)
            .groupBy("user_id", "product_id")
            .agg((F.sum("__s") / F.sum("__n")).alias("rating")))


# Item-based k-NN defaults (cosine similarity over co-raters, 40 neighbours,
# at least one neighbour, predictions clipped to the 1–5 rating scale).
NEIGHBOURS = 40
RATING_MIN, RATING_MAX = 1.0, 5.0
ROUND = 9
# Items of one user that travel in one row, or are paired in one go.
HEAVY_USER = 2000


def item_similarity(r: DataFrame, of: DataFrame | None = None, heavy: int = HEAVY_USER) -> DataFrame:
    """Cosine similarity of every item pair that shares at least one rater.

    ``r``: ``user_id, product_id, rating`` (one row per pair), read several times:
    pass a written frame. Output ``item_i, item_j, similarity`` for ``i != j`` (both orders), computed over
    the common raters only: ``Σ r_i r_j / sqrt(Σ r_i² · Σ r_j²)``. With ``of``
    (``product_id``) only the rows whose ``item_j`` is in it.

    The pairs come from a self-join on the user of packed rows, see :func:`_pairs`; each pair is made once and mirrored
    in its task.
    """
    item = r.schema["product_id"].dataType.simpleString()
    if of is None:
        return _pairs(r, r, heavy, f"item_i {item}, item_j {item}, similarity double", _both)
    mine = r.join(of.select("product_id").distinct(), "product_id", "left_semi").select("user_id", "product_id", "rating")
    return _pairs(mine, r, heavy, f"item_j {item}, item_i {item}, similarity double", _one, once=False).select("item_i", "item_j", "similarity")


def pair_statistics(r: DataFrame, heavy: int = HEAVY_USER) -> DataFrame:
    """What the similarities are made of: ``item_i, item_j, n, sij, sii, sjj`` (common raters, sums of rᵢrⱼ, rᵢ², rⱼ²), item_i < item_j."""
    item = r.schema["product_id"].dataType.simpleString()
    return _pairs(r, r, heavy, f"item_i {item}, item_j {item}, n long, sij double, sii double, sjj double", lambda *x: x)


def _cosine() -> Column:
    return F.when((F.col("sii") > 0) & (F.col("sjj") > 0), F.col("sij") / F.sqrt(F.col("sii") * F.col("sjj"))).otherwise(F.lit(0.0))


def _cosines(sij: np.ndarray, sii: np.ndarray, sjj: np.ndarray) -> np.ndarray:
    """As :func:`_cosine`; as there, NaN counts as more than 0."""
    some = ~((sii <= 0) | (sjj <= 0))
    out = np.zeros(len(sij))
    out[some] = sij[some] / np.sqrt(sii[some] * sjj[some])
    return out


def _one(i, j, n, sij, sii, sjj) -> tuple[np.ndarray, ...]:
    return i, j, _cosines(sij, sii, sjj)


def _both(i, j, n, sij, sii, sjj) -> tuple[np.ndarray, ...]:
    s = _cosines(sij, sii, sjj)
    return np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([s, s])


#: Blocks of items: at least so many, and more where more than so many terms of sums would come to a block. An item with more terms is dealt by rater.
BLOCKS, RATINGS = 32, 1 << 23
_SUMS = ("n", "sij", "sii", "sjj")
#: Rows of old sums and changes that an update shuffles at a time: so many, or as many as ``MOST_WAVES`` leave.
PAIR_ROWS, MOST_WAVES = 1 << 23, 16


def _pairs(own: DataFrame, other: DataFrame, heavy: int, schema: str, give: Callable[..., tuple], once: bool = True) -> DataFrame:
    """What ``give`` makes of the sums (i, j, n, sij, sii, sjj) of all pairs of an item of ``own`` and another of ``other``, both ``user_id, product_id, rating``.

    With ``once`` only pairs i < j. Items of ``own`` are dealt into blocks. A user's ratings in a block travel there with the user's ratings
    of ``other``, many users as one compressed value; so a block has all raters of its items and what they rated, and adds up
    the sums of their pairs: no pair is a row before that. Items whose raters rated too much for one block are
    dealt by rater, and only their sums are added up by a shuffle.
    """
    terms, hot = _terms(own, other)
    blocks = min(bl.MOST_PARTITIONS, max(1, min(BLOCKS, math.ceil(terms / 1024)), math.ceil(terms / RATINGS)))
    names, item = [c.split()[0] for c in schema.split(", ")], own.schema["product_id"].dataType.simpleString()

    def sums(some: DataFrame, deal: str, into: str, make: Callable[..., tuple], columns: list[str]) -> DataFrame:
        def work(batches):
            for found in _pair_sums(batches, once):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in make(*found)], columns)

        rows = _lists(_rated(some), _rated(other), heavy, F.pmod(F.xxhash64(deal), F.lit(blocks))).mapInArrow(_dealt(once), DEALT)
        return rows.repartitionById(blocks, F.col("block")).mapInArrow(work, into)

    if hot is None:
        return sums(own, "product_id", schema, give, names)

    def finish(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in give(*(c.to_numpy(zero_copy_only=False) for c in b.columns))], names)

    cut = sums(own.join(hot, "product_id", "left_semi"), "user_id", f"i {item}, j {item}, n long, sij double, sii double, sjj double", lambda *x: x, ["i", "j", *_SUMS])
    summed = cut.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])
    return sums(own.join(hot, "product_id", "left_anti"), "product_id", schema, give, names).unionByName(summed.mapInArrow(finish, schema))


def _rated(r: DataFrame) -> DataFrame:
    """Without NULL keys, which pair with nothing; a NULL rating adds nothing to a sum."""
    return r.where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull()).select("user_id", "product_id", F.coalesce("rating", F.lit(0.0)).alias("rating"))


def _lists(own: DataFrame, other: DataFrame, heavy: int | None, block: Column, hits: bool = False) -> DataFrame:
    """The self-join on the user: ``user_id``, ratings of ``own`` with the ``block`` of each (``item_i, ri, block``), and those of ``other`` (``item_j, rj``), ``heavy`` at most in a row; with ``hits`` also whether each is a hit (``hi, hj``)."""
    side = lambda i, *x: F.collect_list(F.struct(F.col("product_id").alias(f"item_{i}"), F.col("rating").alias(f"r{i}"), *([F.col("hit").alias(f"h{i}")] if hits else []), *x)).alias(i)
    i = own.repartition("user_id").groupBy("user_id").agg(side("i", block.cast("int").alias("block")))
    pairs = i.join(other.repartition("user_id").groupBy("user_id").agg(side("j")), "user_id")
    if heavy is not None:
        cut = F.transform(F.sequence(F.lit(1), F.size("j"), F.lit(heavy)), lambda at: F.slice("j", at, heavy))
        pairs = pairs.withColumn("j", F.explode(F.when(F.size("j") > heavy, cut).otherwise(F.array("j"))))
    return pairs.select("user_id", "i.item_i", "i.ri", "i.block", "j.item_j", "j.rj", *(["i.hi", "j.hj"] if hits else []))


#: Users' ratings in a block with all their other ratings: :func:`blocked.pack` of users, numbers of own items, these, their ratings, numbers of other items, these, their ratings; and
#: with hits, which of the own and of the others are.
DEALT = "block int, blob binary"


def _dealt(once: bool, low: int = 0, high: int | None = None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Deals rows of :func:`_lists` to the blocks low <= block < high. With ``once`` the smallest of a user's items in a block meets larger ones only."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = _by_block(b, once, low, high)
            if blobs:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())], ["block", "blob"])

    return deal


def _by_block(b: pa.RecordBatch, once: bool, low: int, high: int | None) -> list[tuple[int, bytes]]:
    users, (own, n), (ids, size) = b.column("user_id").to_numpy(zero_copy_only=False), bl.flat(b.column("item_i")), bl.flat(b.column("item_j"))
    ri, rj, block = (bl.flat(b.column(c))[0] for c in ("ri", "rj", "block"))
    hi, hj = (bl.flat(b.column(c))[0] for c in ("hi", "hj")) if "hi" in b.schema.names else (None, None)
    first = bl.starts(size)[:-1]
    order = np.argsort(block, kind="stable")
    order = order[(block[order] >= low) & (block[order] < (np.iinfo(np.int64).max if high is None else high))]
    if not len(order):
        return []
    row, out = np.repeat(np.arange(len(n)), n)[order], []
    edges = np.flatnonzero(np.append(True, np.diff(block[order]) != 0))
    for x, y in zip(edges, [*edges[1:], len(order)], strict=True):
        mine, at = order[x:y], np.append(True, np.diff(row[x:y]) != 0)
        some, begin = row[x:y][at], np.flatnonzero(at)
        count, length = np.diff(np.append(begin, y - x)), size[some]
        where, owner = bl.spans(first[some], length)
        if once:
            larger = ids[where] > np.minimum.reduceat(own[mine], begin)[owner]
            if hi is not None:
                larger &= hj[where] | np.logical_or.reduceat(hi[mine], begin)[owner]
            where, length = where[larger], np.bincount(owner[larger], minlength=len(some))
            if not len(where):
                continue
        out.append((int(block[mine[0]]), bl.pack(users[some], bl.narrow(count), own[mine], ri[mine], bl.narrow(length), ids[where], rj[where], *([] if hi is None else [hi[mine], hj[where]]))))
    return out


def _terms(own: DataFrame, other: DataFrame) -> tuple[float, DataFrame | None]:
    """How many terms the pairs have, and the items of ``own`` (``product_id``) that alone have more than a block should, if any."""
    count = lambda r, key, n: _rated(r).groupBy(key).agg(F.count(F.lit(1)).cast("double").alias(n))
    sizes = count(other, "user_id", "m")
    terms, most = count(own, "user_id", "n").join(sizes, "user_id").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0.0)), F.coalesce(F.max("m"), F.lit(0.0))).first()
    if terms <= RATINGS or most * count(own, "product_id", "n").agg(F.max("n")).first()[0] <= RATINGS:
        return terms, None
    hot = materialize(_rated(own).join(sizes, "user_id").groupBy("product_id").agg(F.sum("m").alias("m")).where(F.col("m") > RATINGS).select("product_id"))
    return terms, None if hot.isEmpty() else hot


def _pair_sums(batches: Iterable[pa.RecordBatch], once: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Sums of the pairs of one block: i, j, n, sij, sii, sjj, each pair once, ``TERMS`` terms at a time."""
    lists = _joined(batches)
    if lists:
        _, n, own, ri, size, ids, rj = lists
        del lists
        yield from _sums_of(own, n, ids, size, ri, rj, once)


def _joined(batches: Iterable[pa.RecordBatch]) -> list[np.ndarray]:
    """All lists of one block, see ``DEALT``; none if there are no rows."""
    parts = [bl.unpack(blob.as_py()) for b in batches for blob in b.column("blob")]
    out = [np.concatenate(x) for x in zip(*parts, strict=True)]
    return [x.astype(np.int64) if k in (1, 4) else x for k, x in enumerate(out)]


def _sums_of(own: np.ndarray, n: np.ndarray, ids: np.ndarray, size: np.ndarray, ri: np.ndarray, rj: np.ndarray, once: bool,
             hi: np.ndarray | None = None, hj: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """As :func:`_pair_sums` from rows of ``n`` items ``own`` with ratings ``ri`` and ``size`` items ``ids`` with ratings ``rj``; with ``hi`` and ``hj`` only terms of which one side is a hit."""
    if not len(own) or not len(ids):
        return
    names, item = np.unique(ids, return_inverse=True)
    item, width, first = item.astype(np.int32), len(names), bl.starts(size)
    # The block's ratings, item by item.
    order = np.argsort(own, kind="stable")
    row, own, ri, hi = np.repeat(np.arange(len(n)), n)[order], own[order], ri[order], None if hi is None else hi[order]
    load = bl.starts(size[row])
    edges = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own))
    heads = own[edges[:-1]]
    place = np.repeat(np.arange(len(heads)), np.diff(edges))
    low = 0
    while low < len(heads):  # items with about TERMS terms at a time; one with more is read part by part
        high = max(low + 1, int(np.searchsorted(load[edges], load[edges[low]] + TERMS, side="right")) - 1)
        cells, held, a = np.zeros(0, np.int64), np.zeros((4, 0)), int(edges[low])
        while a < edges[high]:
            b = min(int(edges[high]), max(a + 1, int(np.searchsorted(load, load[a] + TERMS, side="right")) - 1))
            at, one = bl.spans(first[row[a:b]], size[row[a:b]])
            one += a
            apart = ids[at] > own[one] if once else ids[at] != own[one]
            if hi is not None:
                apart &= hi[one] | hj[at]
            one, at = one[apart], at[apart]
            a = b
            if not len(at):
                continue
            new, of = bl.numbered(place[one] * width + item[at])
            x, y = ri[one], rj[at]
            found = np.stack([np.bincount(of, w, len(new)) for w in (np.ones(len(of)), x * y, x * x, y * y)])
            if len(cells):
                new, of = np.unique(np.concatenate([cells, new]), return_inverse=True)
                found = np.stack([np.bincount(of, w, len(new)) for w in np.concatenate([held, found], axis=1)])
            cells, held = new, found
        if len(cells):
            yield heads[cells // width], names[cells % width], held[0].astype(np.int64), held[1], held[2], held[3]
        low = high


def similarity_of(statistics: DataFrame) -> DataFrame:
    """Similarities in both orders from :func:`pair_statistics`."""
    sim = statistics.select("item_i", "item_j", _cosine().alias("similarity"))
    ends = F.array(F.struct(F.col("item_i").alias("i"), F.col("item_j").alias("j")),
                   F.struct(F.col("item_j").alias("i"), F.col("item_i").alias("j")))
    return sim.select(F.explode(ends).alias("e"), "similarity").select(
        F.col("e.i").alias("item_i"), F.col("e.j").alias("item_j"), "similarity")


def rating_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs (user, product) whose rating differs: ``user_id, product_id, rating`` as it is now, NULL where it is gone."""
    old = before.select("user_id", "product_id", F.col("rating").alias("__old"), F.lit(True).alias("__was"))
    both = after.select("user_id", "product_id", "rating", F.lit(True).alias("__is")).join(old, ["user_id", "product_id"], "full")
    return both.where(F.col("__is").isNull() | F.col("__was").isNull() | (F.col("rating") != F.col("__old"))).select("user_id", "product_id", "rating")


def update_ratings(before: DataFrame, changes: DataFrame) -> DataFrame:
    """Ratings after ``changes`` (a NULL rating deletes, another inserts or replaces; a pair at most once)."""
    return (before.join(changes, ["user_id", "product_id"], "left_anti").select("user_id", "product_id", "rating")
            .unionByName(changes.where(F.col("rating").isNotNull()).select("user_id", "product_id", "rating")))


def update_statistics(statistics: DataFrame, before: DataFrame, changes: DataFrame, heavy: int = HEAVY_USER) -> DataFrame:
    """:func:`pair_statistics` of the ratings after ``changes``, from those of the ratings ``before``.

    Only pairs of items of one user of which at least one rating changed are made, before (to be taken off) and after (to be
    added), and summed up in blocks of items as in :func:`_pairs`; all else is the sum by pair with the old table. A pair that nobody rates any more is dropped by its count,
    which is exact. With more than ``PAIR_ROWS`` pairs, those of some items after the others are summed up and written, so that only their rows are shuffled at a time.
    """
    hit = changes.select("user_id", "product_id", F.lit(True).alias("hit"))

    def touched(r: DataFrame) -> DataFrame:
        mine = _rated(r).join(changes.select("user_id").distinct(), "user_id", "left_semi")
        return compact(mine.join(hit, ["user_id", "product_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False))))

    sides = [(sign, r, *_terms(r.where("hit"), r)) for sign, r in ((-1, touched(before)), (1, touched(update_ratings(before, changes))))]
    terms = sum(n for _, _, n, _ in sides)
    waves = max(1, min(MOST_WAVES, math.ceil((statistics.count() + terms) / PAIR_ROWS)))
    each = max(1, math.ceil(min(BLOCKS, terms / 1024) / waves), math.ceil(terms / RATINGS / waves))
    wave = lambda item: F.pmod(F.xxhash64(item), F.lit(waves)).cast("int")

    def lists(sign: int, r: DataFrame, hot: DataFrame | None) -> DataFrame:
        # Of an item with more terms than a block should have, a rater's go to one block of its wave.
        deal = F.xxhash64("product_id", F.lit(1))
        own = r if hot is None else r.join(hot.withColumn("hot", F.lit(True)), "product_id", "left")
        deal = deal if hot is None else F.when(F.col("hot"), F.xxhash64("user_id")).otherwise(deal)
        block = wave("product_id") * each + F.pmod(deal, F.lit(each))
        return _lists(own, r, heavy, block, hits=True).withColumn("sign", F.lit(sign))

    rows = [lists(sign, r, hot) for sign, r, _, hot in sides]
    rows = compact(*rows) if waves > 1 else rows[0].unionByName(rows[1])
    item = before.schema["product_id"].dataType.simpleString()
    names = ["item_i", "item_j", *_SUMS]

    def deal(low: int, high: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def work(batches):
            for b in batches:
                for sign in (-1, 1):
                    for dealt in _dealt(True, low, high)([b.filter(pa.array(b.column("sign").to_numpy() == sign))]):
                        yield dealt.append_column("sign", pa.array(np.full(dealt.num_rows, sign, np.int32)))
        return work

    def change(batches):
        held = {-1: [], 1: []}
        for b in batches:
            for sign in held:
                held[sign].append(b.filter(pa.array(b.column("sign").to_numpy() == sign)))
        for sign in held:
            some = _joined(held[sign])
            held[sign] = None
            if some:
                _, n, own, ri, size, ids, rj, hi, hj = some
                for i, j, *sums in _sums_of(own, n, ids, size, ri, rj, True, hi, hj):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i, j, *(sign * x for x in sums))], names)

    def updated(w: int) -> DataFrame:
        dealt = rows.mapInArrow(deal(w * each, (w + 1) * each), f"{DEALT}, sign int").repartitionById(each, F.col("block") - w * each)
        new = dealt.mapInArrow(change, f"item_i {item}, item_j {item}, n long, sij double, sii double, sjj double")
        # One sum for the old table and the changes, so that the changes travel once.
        sums = [F.sum(c).alias(c) for c in _SUMS]
        return (statistics.where(wave("item_i") == w) if waves > 1 else statistics).unionByName(new).groupBy("item_i", "item_j").agg(*sums).where(F.col("n") > 0)

    return compact(*[updated(w) for w in range(waves)]) if waves > 1 else updated(0)


def global_mean(r: DataFrame) -> Column:
    """Mean of all ratings, as a scalar subquery."""
    return r.agg(F.avg("rating")).scalar()


def clipped(estimate: np.ndarray | float) -> np.ndarray:
    """Estimates within the scale, rounded."""
    return np.floor(np.clip(estimate, RATING_MIN, RATING_MAX) * 10**ROUND + 0.5) / 10**ROUND


#: Users of a block, columns and similarities of a slice of a block's part, and terms added up at a time.
BLOCK, WIDTH, SLICE, TERMS = 16_384, 16_384, 1 << 21, 1 << 21


def predict_all(mine: DataFrame, sim: DataFrame, known: DataFrame, products: DataFrame, users: DataFrame, fallback: float,
                limit: int, k: int = NEIGHBOURS, block: int = BLOCK, width: int = WIDTH, entries: int = SLICE) -> DataFrame:
    """The ``limit`` best predictions of each user among the ``products`` that are not ``known``: ``user_id, product_id, prediction``.

    Neighbours of (u, i) are the items j rated by u with ``sim(i, j) > 0``; the ``k`` most similar
    (similarity rounded to 9 decimals, then j) give ``Σ sim·r / Σ sim``, clipped to [1, 5]. A product without
    neighbours has the prediction ``fallback``. Ties go to the smaller id.

    ``mine``: ``user_id, product_id, rating`` of the ``users`` (``user_id``, distinct); ``known``: ``user_id,
    product_id``, distinct; ``products``: ``product_id``, distinct; ``sim``: both orders of each pair. All are read more than
    once: pass written frames. The product of ratings and similarities is made block by block (see
    ``operators.blocked``): users travel with their ratings and known products, an item's
    similarities as one packed row per slice of columns to the blocks where somebody rated it. No term of a sum is a Spark row.
    """
    spark = mine.sparkSession
    sim = sim.where(F.col("similarity") > 0)
    grid = bl.Grid.of(users.count(), block, products.count(), width, 2 * spark.sparkContext.defaultParallelism, sim.count(), entries)
    none = F.lit(None).cast("double")
    lists = (mine.select("user_id", "product_id", "rating", F.lit(False).alias("known"))
             .unionByName(known.join(users, "user_id", "left_semi").select("user_id", "product_id", none.alias("rating"), F.lit(True).alias("known")))
             .unionByName(users.select("user_id", F.lit(None).cast("long").alias("product_id"), none.alias("rating"), F.lit(None).cast("boolean").alias("known")))
             .groupBy("user_id").agg(F.collect_list(F.when(~F.col("known"), F.struct("product_id", "rating"))).alias("rated"),
                                     F.collect_list(F.when(F.col("known"), F.col("product_id"))).alias("seen")))
    columns = products.groupBy(grid.slot("product_id").alias("slot")).agg(F.collect_list("product_id").alias("ids"))
    near = (sim.groupBy("item_j", grid.slot("item_i").alias("slot"))
            .agg(F.collect_list(F.struct(F.col("item_i").alias("i"), F.round("similarity", ROUND).alias("s"))).alias("near")))
    wanted = mine.select(F.col("product_id").alias("item_j"), grid.block("user_id").alias("block")).distinct()
    rows = (grid.rows(lists, bl.USERS, block=grid.block("user_id"), key=F.col("user_id"), ids=F.col("rated.product_id"), vals=F.col("rated.rating"), more=F.col("seen"))
            .unionByName(grid.rows(columns, bl.COLUMNS, slot=F.col("slot"), ids=F.col("ids")))
            .unionByName(grid.rows(near.join(wanted, "item_j"), bl.ROWS, block=F.col("block"), slot=F.col("slot"), key=F.col("item_j"),
                                   ids=F.col("near.i"), vals=F.col("near.s"))))
    return grid.run(rows, lambda runs: _predictions(runs, k, limit, fallback), limit).select(
        "user_id", F.col("column").alias("product_id"), F.col("value").alias("prediction"))


#: Terms of the similarities that a task holds in predictions from ratings.
HELD = 1 << 24


#: Users of a chunk that passes by the parts of the products as one compressed value.
CHUNK = 4096


def predict_from_ratings(*args, **options) -> DataFrame:
    """As :func:`predict_all`, from the ratings: the entries of :func:`best_from_ratings` as rows ``user_id, product_id, prediction``."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for users, n, ids, vals in predicted(b):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(users, n), ids, vals)], ["user_id", "product_id", "prediction"])

    return best_from_ratings(*args, **options).mapInArrow(rows, "user_id long, product_id long, prediction double")


def best_from_ratings(r: DataFrame, mine: DataFrame, known: DataFrame, products: DataFrame, users: DataFrame, fallback: float, limit: int,
                      k: int = NEIGHBOURS, few_users: bool = False, held: int = HELD, heavy: int = HEAVY_USER, most: int | None = None) -> DataFrame:
    """The best predictions as in :func:`predict_all`, with the similarities of the ratings ``r``, none of which is written; :func:`predicted` reads the result.

    Products are dealt into parts. As in :func:`_pairs`, a part has all raters of its products with what they rated, and makes the
    similarities of its products with all others (``few_users``: with those that the users rated), about ``held`` at most. Then all users pass by, a chunk at a time, with
    what they rated and know, so a part's predictions are whole. A part gives the ``most`` best of a user, by default some more than its
    share of ``limit``. Where a part's last one is better than the user's last of all parts, it may have more
    of the best: these users, few as products are dealt by hash, pass by a second time, for ``limit`` of each part.

    Lists and chunks are compressed, and the parts run in waves: between them only the best so far of each user are kept, so that the disk
    holds few copies of the ratings at a time, however many parts there are.
    """
    tasks = mine.sparkSession.sparkContext.defaultParallelism
    other = r.join(mine.select("product_id").distinct(), "product_id", "left_semi").select("user_id", "product_id", "rating") if few_users else r
    terms, hot = _terms(r, other)
    grid = bl.Grid(1, min(bl.MOST_PARTITIONS, max(1, min(32, 2 * tasks), math.ceil(terms / held))))
    share = limit / grid.parts
    most = min(limit, most or math.ceil(share + 3 * math.sqrt(share)) + 2)
    lists = compact(_lists(_rated(r if hot is None else r.join(hot, "product_id", "left_anti")), _rated(other), heavy, grid.slot("product_id")))
    columns = products.groupBy(grid.slot("product_id").alias("slot")).agg(F.collect_list("product_id").alias("ids"))
    near = None
    if hot is not None:
        item = r.schema["product_id"].dataType.simpleString()
        own = r.join(hot, "product_id", "left_semi").select("user_id", "product_id", "rating")
        sim = _pairs(own, other, heavy, f"item_i {item}, item_j {item}, similarity double", _one, once=False).where("similarity > 0")
        near = compact(sim.groupBy("item_j", grid.slot("item_i").alias("slot")).agg(F.collect_list(F.struct(F.col("item_i").alias("i"), F.col("similarity").alias("s"))).alias("near")))
    rated = mine.groupBy("user_id").agg(F.collect_list(F.struct("product_id", "rating")).alias("rated"))
    seen = known.groupBy("user_id").agg(F.collect_list("product_id").alias("seen"))
    none = F.array().cast("array<long>")
    ids, seen_ids = F.coalesce("rated.product_id", none).cast("array<long>"), F.coalesce("seen", none).cast("array<long>")
    number = mine.count()

    def parts(low: int, high: int) -> DataFrame:
        here = (F.col("slot") >= low) & (F.col("slot") < high)
        rows = (grid.rows(columns.where(here), bl.COLUMNS, block=F.lit(0), slot=F.col("slot"), ids=F.col("ids"))
                .unionByName(grid.rows(lists.mapInArrow(_dealt(False, low, high), DEALT), bl.MORE, block=F.lit(0), slot=F.col("block"), blob=F.col("blob"))))
        if near is None:
            return rows
        return rows.unionByName(grid.rows(near.where(here), bl.ROWS, block=F.lit(0), slot=F.col("slot"), key=F.col("item_j"), ids=F.col("near.i"), vals=F.col("near.s")))

    def best(some: DataFrame, m: int) -> DataFrame:
        # What a user rated is nearly all that is known: only the differences travel besides.
        whole = some.join(rated, "user_id", "left").join(seen, "user_id", "left").select(
            "user_id", ids.alias("ids"), F.coalesce("rated.rating", F.array().cast("array<double>")).alias("vals"), F.array_except(seen_ids, ids).alias("more"), F.array_except(ids, seen_ids).alias("bits"))
        chunks = materialize(whole.mapInArrow(_chunks, "chunk long, blob binary"))
        state = None
        for low, high in bl.waves(grid.parts, 2.0 * grid.parts * number, number, tasks):
            passing = grid.rows(chunks.withColumn("slot", F.explode(F.sequence(F.lit(low), F.lit(high - 1)))), bl.USERS, block=F.lit(0), slot=F.col("slot"), key=F.col("chunk"), blob=F.col("blob"))
            found = grid.packed(parts(low, high).unionByName(passing.withColumn("slice", F.lit(1))), lambda runs: _part_predictions(runs, k, m, fallback), schema=BEST, wave=(low, high))
            both = found if state is None else found.unionByName(state)
            state = materialize(both.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(lambda batches: _folded(batches, m, limit), BEST))
        return state

    first = best(users, most)
    deep = materialize(first.mapInArrow(_short, "user_id long"))
    return first if deep.isEmpty() else first.unionByName(best(deep, limit))


#: The best so far of a chunk's users (named by the first), :func:`blocked.pack` of users, lengths, ids and values; folded also the
#: values and ids below which a part may have more, and whether that reaches into the best.
BEST = "chunk long, best binary"


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``CHUNK`` users at a time with what they rated, what else they know, and what they rated and don't know."""
    for b in batches:
        for at in range(0, b.num_rows, CHUNK):
            some = b.slice(at, CHUNK)
            users, (item, n), (more, m), (bits, g) = some.column("user_id").to_numpy(), *(bl.flat(some.column(c)) for c in ("ids", "more", "bits"))
            blob = bl.pack(users, item, bl.narrow(n), bl.flat(some.column("vals"))[0], more, bl.narrow(m), bits, bl.narrow(g))
            yield pa.RecordBatch.from_arrays([pa.array(users[:1]), pa.array([blob], pa.binary())], ["chunk", "blob"])


def _part_predictions(runs: Iterator[tuple], k: int, limit: int, fallback: float) -> Iterator[tuple]:
    """Best predictions of all chunks of users over one part of the products."""
    columns, lists, rows, near, cols = [], [], [[] for _ in range(3)], None, None
    for _, tag, batch in runs:
        if tag == bl.COLUMNS:
            columns.append(bl.flat(batch.column("ids"))[0])
        elif tag == bl.ROWS:
            ids, n = bl.flat(batch.column("ids"))
            for to, x in zip(rows, (ids, np.repeat(batch.column("key").to_numpy(), n), bl.flat(batch.column("vals"))[0]), strict=True):
                to.append(x)
        elif tag == bl.MORE:
            lists.append(_joined([batch]))
        else:
            if near is None:
                cols = np.sort(np.concatenate(columns)) if columns else np.zeros(0, np.int64)
                near = _near(cols, lists, rows)
                lists = rows = columns = None
            for chunk, blob in zip(batch.column("key").to_pylist(), batch.column("blob"), strict=True):
                state = _Rated.unpacked(blob.as_py())
                best = bl.Best(len(state.ids), limit)
                _add_slice(state, best, cols, near, k, limit, fallback)
                n, ids, values = best.lists()
                yield [chunk], pa.array([bl.pack(state.ids, bl.narrow(n), ids, values)], pa.binary())


def _folded(batches: Iterable[pa.RecordBatch], most: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The ``limit`` best of each user from what parts gave, ``most`` at most, and from what was folded before; rows come by chunk."""
    chunk, held, n = None, [], 0
    for b in batches:
        for at, blob in zip(b.column("chunk").to_pylist(), b.column("best"), strict=True):
            if at != chunk and held:
                yield _fold(chunk, held, most, limit)[1]
                held, n = [], 0
            chunk = at
            held.append(bl.unpack(blob.as_py()))
            n += len(held[-1][2])
            if n > TERMS:
                held, n = [_fold(chunk, held, most, limit)[0]], 0
    if held:
        yield _fold(chunk, held, most, limit)[1]


def _fold(chunk: int, lists: list[list[np.ndarray]], most: int, limit: int) -> tuple[list[np.ndarray], pa.RecordBatch]:
    users = lists[0][0]
    cut, cut_id = np.full(len(users), -np.inf), np.full(len(users), np.iinfo(np.int64).max)
    for _, n, ids, vals, *folded in lists:
        if folded:
            there, (value, last, _) = np.arange(len(users)), folded
        else:
            there = np.flatnonzero(n >= most) if most < limit else np.zeros(0, np.int64)
            end = np.cumsum(n, dtype=np.int64)[there] - 1
            value, last = vals[end], ids[end]
        better = (value > cut[there]) | ((value == cut[there]) & (last < cut_id[there]))
        cut[there[better]], cut_id[there[better]] = value[better], last[better]
    user = np.concatenate([np.repeat(np.arange(len(users)), x[1]) for x in lists])
    ids, vals = (np.concatenate([x[c] for x in lists]) for c in (2, 3))
    order = np.lexsort((ids, -vals, user))
    order = order[bl.place_in_group(user[order]) < limit]
    n, ids, vals = np.bincount(user[order], minlength=len(users)), ids[order], vals[order]
    end = np.cumsum(n)[n == limit] - 1
    short = cut > -np.inf
    short[n == limit] &= (cut[n == limit] > vals[end]) | ((cut[n == limit] == vals[end]) & (cut_id[n == limit] < ids[end]))
    out = [users, bl.narrow(n), ids, vals, cut, cut_id, short]
    return out, pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([bl.pack(*out)], pa.binary())], ["chunk", "best"])


def _short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Users of whose best a part may have more than it gave."""
    for b in batches:
        for blob in b.column("best"):
            users, *_, short = bl.unpack(blob.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(users[short])], ["user_id"])


def predicted(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Users, lengths, products and predictions of rows of :func:`best_from_ratings`."""
    for blob in b.column("best"):
        users, n, ids, vals, *_, short = bl.unpack(blob.as_py())
        keep = ~np.repeat(short, n)
        yield users[~short], n[~short], ids[keep], vals[keep]


def _near(cols: np.ndarray, lists: list[list], rows: list[list]) -> Neighbours:
    """Similarities of the products ``cols`` from their raters' ratings, and those given as rows (i, j, similarity)."""
    found = [list(zip(*rows, strict=True))] if rows[0] else []
    found = [x for group in found for x in group]
    if lists:
        _, n, own, ri, size, ids, rj = (np.concatenate(x) for x in zip(*lists, strict=True))
        lists.clear()
        for i, j, _, *sums in _sums_of(own, n, ids, size, ri, rj, False):
            found.append((i, j, _cosines(*sums)))
    parts = []
    for i, j, s in found:
        col, there = bl.find(cols, i)
        there &= s > 0
        parts.append((col[there].astype(np.int32), j[there], np.floor(s[there] * 10**ROUND + 0.5) / 10**ROUND))
    col, j, s = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
    del found, parts
    order = np.argsort(j, kind="stable")
    keys, n = np.unique(j, return_counts=True)
    return Neighbours(keys, bl.starts(n), col[order], s[order], len(cols))


def _predictions(runs: Iterator[tuple], k: int, limit: int, fallback: float) -> Iterator[tuple]:
    """Best predictions of one block of users over one part of the products."""
    users: list = []
    slices: dict[int, list] = {}
    state = best = None

    def close() -> None:
        for columns, keys, lengths, items, weights in slices.values():
            cols = np.sort(np.concatenate(columns)) if columns else np.zeros(0, np.int64)
            joined = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.int64), (lengths, np.int64), (items, np.int64), (weights, float))]
            _add_slice(state, best, cols, Neighbours.of(cols, *joined), k, limit, fallback)
        slices.clear()

    for at, tag, rows in runs:
        if tag == bl.USERS:
            users.append(rows)
            continue
        if state is None:
            state = _Rated.of(users)
            best = bl.Best(len(state.ids), limit)
        if at not in slices:
            close()
            slices[at] = [[], [], [], [], []]
        columns, keys, lengths, items, weights = slices[at]
        ids, n = bl.flat(rows.column("ids"))
        if tag == bl.COLUMNS:
            columns.append(ids)
        else:
            keys.append(rows.column("key").to_numpy())
            lengths.append(n)
            items.append(ids)
            weights.append(bl.flat(rows.column("vals"))[0])
    if state is not None and len(state.ids):
        close()
        yield best.packed(state.ids)


class _Rated:
    """Users of a block: what they rated and what they know, in the order of the users."""

    def __init__(self, ids: np.ndarray, item: np.ndarray, n: np.ndarray, rating: np.ndarray, known: np.ndarray, m: np.ndarray):
        self.ids, self.item, self.rating, self.known = ids, item, rating, known
        self.rated_at, self.known_at = bl.starts(n), bl.starts(m)

    @classmethod
    def of(cls, batches: list) -> _Rated:
        join = lambda parts, x, kind=np.int64: np.concatenate([p[x] for p in parts] or [np.zeros(0, kind)])
        items, ratings, known = ([bl.flat(b.column(c)) for b in batches] for c in ("ids", "vals", "more"))
        return cls(np.concatenate([b.column("key").to_numpy() for b in batches] or [np.zeros(0, np.int64)]), join(items, 0), join(items, 1), join(ratings, 0, float), join(known, 0), join(known, 1))

    @classmethod
    def unpacked(cls, blob: bytes) -> _Rated:
        """A chunk: known is what was rated but for what is known not to be, and some more."""
        ids, item, n, rating, more, m, open_, gaps = bl.unpack(blob)
        n, m, gaps = (x.astype(np.int64) for x in (n, m, gaps))
        owner = np.repeat(np.arange(len(n)), n)
        shut = np.ones(len(owner), bool)
        if len(open_):
            names = np.unique(open_)
            at, there = bl.find(names, item)
            gap = np.repeat(np.arange(len(gaps)), gaps) * len(names) + np.searchsorted(names, open_)
            shut = ~(there & np.isin(owner * len(names) + at, gap))
        owner = np.concatenate([owner[shut], np.repeat(np.arange(len(m)), m)])
        order = np.argsort(owner, kind="stable")
        return cls(ids, item, n, rating, np.concatenate([item[shut], more])[order], np.bincount(owner, minlength=len(n)))


@dataclass
class Neighbours:
    """Similarities of a slice: per item (``keys``, sorted) the columns ``col`` and weights from ``first`` to the next."""

    keys: np.ndarray
    first: np.ndarray
    col: np.ndarray
    weight: np.ndarray
    width: int

    @classmethod
    def of(cls, cols: np.ndarray, keys: np.ndarray, lengths: np.ndarray, items: np.ndarray, weights: np.ndarray) -> Neighbours:
        order = np.argsort(keys, kind="stable")
        at, _ = bl.spans(bl.starts(lengths)[:-1][order], lengths[order])
        col, there = bl.find(cols, items[at])
        n = np.bincount(np.repeat(np.arange(len(keys)), lengths[order])[there], minlength=len(keys))
        return cls(keys[order], bl.starts(n), col[there], weights[at][there], len(cols))

    def between(self, low: int, high: int) -> Neighbours:
        """Columns low <= col < high only, numbered as before."""
        inside = (self.col >= low) & (self.col < high)
        n = np.bincount(np.repeat(np.arange(len(self.keys)), np.diff(self.first))[inside], minlength=len(self.keys))
        return Neighbours(self.keys, bl.starts(n), self.col[inside], self.weight[inside], self.width)


def _add_slice(users: _Rated, best: bl.Best, cols: np.ndarray, near: Neighbours, k: int, limit: int, fallback: float) -> None:
    """Predictions of all users of the block for the products ``cols`` of a slice."""
    row, there = bl.find(near.keys, users.item)
    terms = np.where(there, np.diff(near.first)[row] if len(near.keys) else 0, 0)
    load = bl.starts(terms)[users.rated_at]  # terms before each user
    # Candidates of a user in a slice: at most its terms, and those without neighbours.
    widest = min(near.width, int(np.diff(load).max(initial=0)) + limit)
    low = 0
    while low < len(users.ids):
        most = np.searchsorted(load, load[low] + TERMS, side="right") - 1
        high = int(min(len(users.ids), max(low + 1, most), low + max(1, 4 * TERMS // max(1, widest))))
        _add_users(users, best, cols, near, row, there, low, high, k, limit, fallback)
        low = high


def _add_users(users, best, cols, near, row, there, low, high, k, limit, fallback) -> None:
    n = high - low
    rated = slice(int(users.rated_at[low]), int(users.rated_at[high]))
    user = np.repeat(np.arange(n), np.diff(users.rated_at[low:high + 1]))[there[rated]]
    rows, item, rating = (x[rated][there[rated]] for x in (row, users.item, users.rating))
    cell, estimate = _sums(near, user, rows, item, rating, k)
    seen = slice(int(users.known_at[low]), int(users.known_at[high]))
    col, is_col = bl.find(cols, users.known[seen])
    known = np.unique((np.repeat(np.arange(n), np.diff(users.known_at[low:high + 1])) * near.width + col)[is_col])
    new = ~bl.find(known, cell)[1]
    u, c = np.divmod(cell[new], max(1, near.width))
    best.add(low, high, low + u, cols[c], clipped(estimate[new]))
    # Products without a neighbour all have the same prediction: the smallest ids can be listed, where it reaches a user's last one.
    short = np.flatnonzero(best.bar[low:high] <= fallback)
    taken = np.sort(np.concatenate([known, cell[new]]), kind="stable") if len(short) else known
    fill = []
    for u in short.tolist():
        mine = taken[np.searchsorted(taken, u * near.width):np.searchsorted(taken, (u + 1) * near.width)] - u * near.width
        front = np.ones(min(near.width, limit + len(mine)), bool)
        front[mine[mine < len(front)]] = False
        fill.append(np.flatnonzero(front)[:limit])
    if fill:
        free = np.concatenate(fill)
        best.add(low, high, low + np.repeat(short, [len(f) for f in fill]), cols[free], np.full(len(free), fallback))


def _sums(near: Neighbours, user: np.ndarray, rows: np.ndarray, item: np.ndarray, rating: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (user * width + column) that have a neighbour, sorted, and their estimates."""
    lengths = near.first[rows + 1] - near.first[rows] if len(rows) else np.zeros(0, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0)
    if total > 2 * TERMS and len(np.unique(near.col)) > 1:  # one user with more terms than a task should hold: fewer columns at a time
        middle = int(np.median(np.unique(near.col))) + 1
        middle = min(middle, int(near.col.max()))
        parts = [_sums(half, user, rows, item, rating, k) for half in (near.between(0, middle), near.between(middle, near.width))]
        cell, estimate = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(cell, kind="stable")
        return cell[order], estimate[order]
    at, owner = bl.spans(near.first[rows], lengths)
    s, cell = near.weight[at], user[owner] * near.width + near.col[at]
    cells, of = bl.numbered(cell)
    count = np.bincount(of)
    if k < count.max():  # cells with more than k neighbours keep the k most similar
        crowded = np.flatnonzero(count[of] > k)
        order = crowded[np.lexsort((item[owner[crowded]], -s[crowded], of[crowded]))]
        out = order[bl.place_in_group(of[order]) >= k]
        s = s.copy()
        s[out] = 0.0
    den = np.bincount(of, weights=s)
    return cells, np.bincount(of, weights=s * rating[owner]) / den


def fold_of(n_folds: int = 3) -> Column:
    """Deterministic fold of a rating: ``(user_id·31 + product_id) mod n``."""
    return F.pmod(F.col("user_id") * F.lit(31) + F.col("product_id"), F.lit(n_folds)).cast("int")


def cross_validate(r: DataFrame, folds: int = 3, k: int = NEIGHBOURS) -> DataFrame:
    """k-fold RMSE and MAE of the item-based model: ``fold, rmse, mae, n``.

    Each fold is predicted by the similarities of the other folds, all in one pass: rating i is predicted from
    rating j of the user where their folds differ, with the similarity without the fold of i.

    Items are dealt into blocks. The self-join on the user that makes the pairs is one of packed rows: a user's ratings in a
    block with all of the user's ratings, many users as one compressed value. So a block has all raters of its items and what they rated: the
    pairs of its items with all others, their sums without each fold, and the ratings predicted from
    them. No pair of items is a Spark row; lists of ratings are what is written and shuffled, the latter for some blocks at a time (:func:`blocked.waves`).
    """
    r = compact(r)
    means = [x if x is not None else 0.0 for x in r.agg(*[F.avg(F.when(fold_of(folds) != f, F.col("rating"))) for f in range(folds)]).first()]
    n, squares = r.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0))).first()
    grid = bl.Grid(min(bl.MOST_PARTITIONS, max(1, min(BLOCKS, math.ceil(n / 1024)), math.ceil(squares / RATINGS))), 1)
    some = r.where(F.col("user_id").isNotNull())
    rows = compact(_lists(some, some, None, grid.block("product_id")), by=materialize)

    def work(batches):
        got = _fold_errors(batches, folds, k, means)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["fold", "squares", "sizes", "n"])

    def of(low: int, high: int) -> DataFrame:
        dealt = rows.mapInArrow(_dealt(False, low, high), DEALT).repartitionById(high - low, F.col("block") - low)
        return materialize(dealt.mapInArrow(work, "fold long, squares double, sizes double, n long"))

    errors = reduce(DataFrame.union, [of(*wave) for wave in bl.waves(grid.blocks, min(squares, n * grid.blocks), n, r.sparkSession.sparkContext.defaultParallelism)])
    total = F.sum("n")
    return errors.groupBy(F.col("fold").cast("int").alias("fold")).agg(F.round(F.sqrt(F.sum("squares") / total), 6).alias("rmse"), F.round(F.sum("sizes") / total, 6).alias("mae"), total.alias("n"))


def _fold_errors(batches: Iterable[pa.RecordBatch], folds: int, k: int, means: list[float]) -> tuple[np.ndarray, ...]:
    """Of the ratings of one block of items: folds, sums of squared and of absolute errors, numbers of ratings."""
    lists = _joined(batches)
    squares, sizes, number = np.zeros(folds), np.zeros(folds), np.zeros(folds, np.int64)
    if lists:
        user, n, own, ri, size, ids, rj = lists
        del lists
        fold = lambda rows, product: ((user[rows] * 31 + product) % folds).astype(np.int8)
        names, item = np.unique(ids, return_inverse=True)
        fj, item, width, first = fold(np.repeat(np.arange(len(size)), size), ids), item.astype(np.int32), len(names), bl.starts(size)
        # The block's ratings, item by item: row, item, rating and fold.
        order = np.argsort(own, kind="stable")
        row = np.repeat(np.arange(len(n)), n)[order]
        mine, ri, fi = np.searchsorted(names, own[order]).astype(np.int32), ri[order], fold(row, own[order])
        del ids, own, order
        load = bl.starts(size[row])
        edges = np.append(np.flatnonzero(np.append(True, mine[1:] != mine[:-1])), len(mine))

        def terms(low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The ratings low to high of the block with the other ratings of their users: place of the one, the other, and their pair of items."""
            at, one = bl.spans(first[row[low:high]], size[row[low:high]])
            one += low
            apart = item[at] != mine[one]
            one, at = one[apart], at[apart]
            return one, at, mine[one].astype(np.int64) * width + item[at]

        def sums(one: np.ndarray, at: np.ndarray, of: np.ndarray, cells: int) -> np.ndarray:
            out = np.zeros((3 * folds, cells))
            for f in range(folds):
                outside = np.flatnonzero((fi[one] != f) & (fj[at] != f))
                a, b = ri[one[outside]], rj[at[outside]]
                for t, x in enumerate((a * b, a * a, b * b)):
                    out[3 * f + t] = np.bincount(of[outside], x, cells)
            return out

        low = 0
        while low < len(edges) - 1:  # items with about TERMS terms at a time; one with more is read part by part, twice
            high = max(low + 1, int(np.searchsorted(load[edges], load[edges[low]] + TERMS, side="right")) - 1)
            parts, a = [], int(edges[low])
            while a < edges[high]:
                b = min(int(edges[high]), max(a + 1, int(np.searchsorted(load, load[a] + TERMS, side="right")) - 1))
                parts.append((a, b))
                a = b
            cells, held, read = np.zeros(0, np.int64), np.zeros((3 * folds, 0)), None
            for part in parts:
                read = terms(*part)
                if not len(read[2]):
                    continue
                new, of = bl.numbered(read[2])
                found = sums(*read[:2], of, len(new))
                if len(cells):
                    new, of = np.unique(np.concatenate([cells, new]), return_inverse=True)
                    both = np.concatenate([held, found], axis=1)
                    found = np.stack([np.bincount(of, x, len(new)) for x in both])
                cells, held = new, found
            similarity = np.zeros((folds, len(cells)))
            for f in range(folds):
                sij, sii, sjj = held[3 * f:3 * f + 3]
                some = (sii > 0) & (sjj > 0)
                similarity[f, some] = np.floor(sij[some] / np.sqrt(sii[some] * sjj[some]) * 10**ROUND + 0.5) / 10**ROUND
            for a, b in parts:
                one, at, cell = read if len(parts) == 1 else terms(a, b)
                differ = fi[one] != fj[at]
                one, at, cell = one[differ], at[differ], cell[differ]
                s = similarity[fi[one], np.searchsorted(cells, cell)]
                near = s > 0
                one, at, s = one[near] - a, at[near], s[near]
                if len(one) and np.bincount(one).max() > k:  # only the k most similar
                    order = np.lexsort((item[at], -s, one))
                    order = order[bl.place_in_group(one[order]) < k]
                    one, at, s = one[order], at[order], s[order]
                den = np.bincount(one, s, b - a)
                of = fi[a:b]
                estimate = np.where(den > 0, np.bincount(one, s * rj[at], b - a) / np.where(den > 0, den, 1.0), np.array(means)[of])
                error = clipped(estimate) - ri[a:b]
                squares += np.bincount(of, error * error, folds)
                sizes += np.bincount(of, np.abs(error), folds)
                number += np.bincount(of, minlength=folds)
            low = high
    there = np.flatnonzero(number)
    return there, squares[there], sizes[there], number[there]

"""Exact k-nearest neighbours by cosine similarity.

Method. A tree of two levels: about √n cells for n items, each with a centre (an
item chosen by hash) and the largest angle of an item to it, below about √√n
top cells with the same two. Items and queries go down the tree to a cell. A query first meets its own cell, which gives
it a bar: its k-th similarity there. By the triangle inequality on the sphere, the angle
between a query and an item is at least the query's angle to a centre less the largest
angle of the centre's items; so whole top cells are skipped, and in the others the cells that can't hold
an item as near as the bar. Vectors of few components have a second bound, the distance of the query's direction to
the box around the directions of a cell's items, which rules out cells whose angle reaches far past their items. The most promising cells are visited first, and the bar
they leave is carried to the rest, fewer of which are then visited. Where the bars would still leave more than a quarter of
all pairs (many nearly isotropic components), the rest is met in large blocks of all items instead. Cells are cut into blocks; a block of queries meets a block of items in
one task with one matrix product. No pair becomes a row, a task holds two
blocks, and skipped cells are proven to hold no neighbour. The centres (at most ``MOST_CELLS`` vectors) travel to the
tasks.

Zero vectors have similarity 0 with everything (as cosine distance 1 does in the
usual libraries). A zero query takes the ``k`` smallest item ids; zero items form
a cell that every query visits whose bar is not above 0.

All rankings are ``similarity desc, id asc`` on the similarity rounded to
``ROUND`` decimals, so last-bit noise cannot reorder near-ties.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcast.functions.expr import top_n
from shopcast.operators.blocked import place_in_group, starts
from shopcast.session import materialize

ROUND = 9
#: Most cells of a tree, and cells that a query visits before its bar is raised.
MOST_CELLS, FIRST = 16_384, 4
#: Most components of vectors whose cells have boxes; with many, boxes rule out nothing that the angles leave.
BOXED = 16
_SLACK = 1e-6
#: Similarities of a block that are held at a time.
STRIP = 1 << 24
#: Vectors of a block, and share of the pairs from which on cells are left aside: queries in many cells travel more often than in blocks of all items.
WHOLE, CROWDED, SAMPLE = 16_384, 0.25, 1024


def _order() -> list[Column]:
    return [F.col("similarity").desc(), F.col("item_id")]


def _dot(a: Column, b: Column, d: int) -> Column:
    """Dot product unrolled over ``d`` elements (plain arithmetic, whole-stage codegen)."""
    out = F.lit(0.0)
    for i in range(d):
        out = out + a[i] * b[i]
    return out


def cosine(a: Column, b: Column, d: int) -> Column:
    """``dot / sqrt(|a|²·|b|²)``; 0 when either vector is zero."""
    na, nb = _dot(a, a, d), _dot(b, b, d)
    return F.when((na > 0) & (nb > 0), _dot(a, b, d) / F.sqrt(na * nb)).otherwise(F.lit(0.0))


def as_vectors(df: DataFrame, key: str, cols: list[str] | None = None, array_col: str | None = None) -> DataFrame:
    """``id, vec`` from parallel numeric columns or an array column."""
    if array_col:
        vec = F.transform(F.col(array_col), lambda v: v.cast("double"))
    else:
        vec = F.array(*[F.col(c).cast("double") for c in cols or []])
    return df.select(F.col(key).alias("id"), vec.alias("vec"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    arrays = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [a.flatten().to_numpy(zero_copy_only=False) for a in arrays]
    rows = sum(len(a) for a in arrays)
    return np.concatenate(flat).astype(float).reshape(rows, -1) if rows else np.zeros((0, 0))


def _top(q: pa.Table, it: pa.Table, k: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``q`` and ``it`` and similarities of the ``k`` most similar items of one block for each query of another, from the query's bar on.

    Directions in single precision tell which items may reach the bar, or the k-th similarity; only those are compared exactly.
    """
    qv, iv = _matrix(q.column("vec")), _matrix(it.column("vec"))
    qn, im = (qv * qv).sum(axis=1), (iv * iv).sum(axis=1)
    qid, iid = (t.column("id").to_numpy() for t in (q, it))
    unit = lambda v, n: np.where(n > 0, 1 / np.sqrt(np.where(n > 0, n, 1.0)), 0.0)[:, None] * v
    qu, iu = unit(qv, qn).astype(np.float32), unit(iv, im).astype(np.float32).T
    # Single precision may be off by this much; bars are rounded.
    off = np.float32((qv.shape[1] + 8) * 2.0**-23 + 2e-9)
    same = np.zeros(len(qid), np.int64)
    if exclude_self:
        ids = np.sort(iid)
        same = np.searchsorted(ids, qid, side="right") - np.searchsorted(ids, qid)
    bars = q.column("bar").to_numpy().astype(float)
    found = []
    strip = max(1, STRIP // max(1, len(iid)))
    for low in range(0, len(qid), strip):
        part = slice(low, low + strip)
        near = qu[part] @ iu
        cut = np.maximum(bars[part], -2.0).astype(np.float32) - off
        take = k + int(same[part].max())
        able = near >= cut[:, None]
        many = np.flatnonzero(able.sum(axis=1) > 4 * take) if near.shape[1] > take else []
        if len(many):  # a bar that rules out little: the k-th similarity of the block is higher
            last = np.partition(near[many], near.shape[1] - take, axis=1)[:, near.shape[1] - take]
            cut[many] = np.maximum(cut[many], last - 2 * off)
            able[many] = near[many] >= cut[many][:, None]
        row, col = np.nonzero(able)
        row += low
        if exclude_self:
            other = qid[row] != iid[col]
            row, col = row[other], col[other]
        sim = np.zeros(len(row))
        for at in range(0, len(row), STRIP // 64):
            r, c = row[at:at + STRIP // 64], col[at:at + STRIP // 64]
            norm = np.sqrt(qn[r] * im[c])
            sim[at:at + len(r)] = np.where(norm > 0, np.einsum("ij,ij->i", qv[r], iv[c]) / np.where(norm > 0, norm, 1.0), 0.0)
        sim = np.round(sim, ROUND)
        order = np.lexsort((iid[col], -sim, row))
        row, col, sim = row[order], col[order], sim[order]
        keep = place_in_group(row) < k
        found.append((row[keep], col[keep], sim[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _angles(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angle of each vector to each centre."""
    norm = np.sqrt(np.outer((v * v).sum(axis=1), (centres * centres).sum(axis=1)))
    return np.arccos(np.clip((v @ centres.T) / norm, -1.0, 1.0))


@dataclass
class Tree:
    """Two levels of cells: ``centres`` of the cells, those below one top centre in a row (from ``first`` to the next)."""

    tops: np.ndarray
    centres: np.ndarray
    first: np.ndarray
    radius: np.ndarray | None = None
    top_radius: np.ndarray | None = None
    #: Of each cell, smallest and largest components of its items' directions.
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    @classmethod
    def of(cls, chosen: np.ndarray) -> Tree:
        """The first √c of the ``c`` chosen vectors are the tops; each chosen vector is the centre of a cell below its nearest top."""
        tops = chosen[:math.ceil(math.sqrt(len(chosen)))]
        below = _angles(chosen, tops).argmin(axis=1)
        used, below = np.unique(below, return_inverse=True)
        order = np.argsort(below, kind="stable")
        return cls(tops[used], chosen[order], starts(np.bincount(below)))

    def locate(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per vector its cell (the nearest one below the nearest top) and the angles to its centre and top."""
        high = _angles(v, self.tops)
        top = high.argmin(axis=1)
        cell, angle = np.zeros(len(v), np.int64), np.zeros(len(v))
        for t in np.unique(top).tolist():
            mine = np.flatnonzero(top == t)
            low = _angles(v[mine], self.centres[self.first[t]:self.first[t + 1]])
            best = low.argmin(axis=1)
            cell[mine], angle[mine] = self.first[t] + best, low[np.arange(len(mine)), best]
        return cell, angle, high[np.arange(len(v)), top]

    def reach(self, v: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a vector and a cell that may hold an item at an angle up to the vector's ``limit``, and the least angle possible there."""
        found = []
        go = _angles(v, self.tops) - self.top_radius <= limit[:, None]
        if self.low is not None:
            go &= _beside(v, np.minimum.reduceat(self.low, self.first[:-1]), np.maximum.reduceat(self.high, self.first[:-1])) <= limit[:, None]
        for t in range(len(self.tops)):
            mine = np.flatnonzero(go[:, t])
            cells = np.arange(self.first[t], self.first[t + 1])
            cells = cells[self.radius[cells] >= 0]  # cells that hold items
            least = np.maximum(_angles(v[mine], self.centres[cells]) - self.radius[cells], 0.0)
            if self.low is not None:
                least = np.maximum(least, _beside(v[mine], self.low[cells], self.high[cells]))
            r, c = np.nonzero(least <= limit[mine][:, None])
            found.append((mine[r], cells[c], least[r, c]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _beside(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least possible angle of each vector to a direction in each box: that of the chord from the vector's direction to the box."""
    v = v / np.sqrt((v * v).sum(axis=1))[:, None]
    chord = np.zeros((len(v), len(low)))
    for d in range(v.shape[1]):
        x = v[:, d, None]
        chord += np.maximum(np.maximum(low[:, d] - x, x - high[:, d]), 0.0)**2
    return 2 * np.arcsin(np.minimum(np.sqrt(chord) / 2, 1.0))


def _limit(bar: np.ndarray) -> np.ndarray:
    """Largest angle of an item that reaches the bar. Similarities are rounded, and angles lose digits near 0: a little more."""
    return np.arccos(np.clip(bar - 2e-9, -1.0, 1.0)) + _SLACK


def _meet(q: DataFrame, it: DataFrame, k: int, exclude_self: bool, block: int) -> DataFrame:
    """Best items per query and block: ``q`` (id, vec, cell, bar) meets the items (id, vec, cell) of the same cell, block by block."""
    ids = (q.schema["id"].dataType.simpleString(), it.schema["id"].dataType.simpleString())
    schema = f"query_id {ids[0]}, item_id {ids[1]}, similarity double"
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name)).select(F.col("cell").alias("cell"), name)
    # One row per cell, of which there are at most MOST_CELLS.
    both = F.broadcast(blocks(q, "__nq").join(blocks(it, "__ni"), "cell"))
    deal = lambda df, own, n, other, m: (df.join(both, "cell").withColumn(own, F.pmod(F.xxhash64("id"), F.col(n)).cast("int"))
                                         .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).drop(n, m))
    keys = ["cell", "__q", "__i"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_id", "item_id", "similarity"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], a.schema.field("id").type), pa.array([], b.schema.field("id").type), pa.array([], pa.float64())], names)
        row, col, sim = _top(a, b, k, exclude_self)
        return pa.table([a.column("id").take(pa.array(row)), b.column("id").take(pa.array(col)), pa.array(sim, pa.float64())], names)

    return (deal(q.select("id", "vec", "cell", "bar"), "__q", "__nq", "__i", "__ni").groupBy(*keys)
            .cogroup(deal(it.select("id", "vec", "cell"), "__i", "__ni", "__q", "__nq").groupBy(*keys))
            .applyInArrow(run, schema))


def cosine_topk(queries: DataFrame, items: DataFrame, k: int, exclude_self: bool = True,
                block: int = 2048, cells: int | None = None, visits: list[int] | None = None) -> DataFrame:
    """Top ``k`` items per query by cosine similarity.

    ``queries`` and ``items``: ``id, vec`` (one length). Output ``query_id, item_id,
    similarity`` (rounded to ``ROUND`` decimals). With ``exclude_self`` an item
    never matches the query with the same id. ``cells``: by default √n of n items (three times as many with at most ``BOXED`` components), and one where they fit
    into one ``block``. ``visits`` gets the number of (query, item) pairs compared and possible.
    """
    zero = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x) == 0
    # Columns get names of their own, as both may be one frame.
    items, queries = (df.select(F.col("id").alias("id"), F.transform("vec", lambda x: x.cast("double")).alias("vec")) for df in (items, queries))
    items, queries = materialize(items.withColumn("zero", zero)), materialize(queries.withColumn("zero", zero))
    ids = queries.schema["id"].dataType.simpleString()
    n = items.where(~F.col("zero")).count()
    short = items.where(F.size("vec") > BOXED).isEmpty()
    # Cells with boxes are seldom visited in vain, so they can be smaller.
    count = cells or (math.ceil(math.sqrt(n)) * (3 if short else 1) if n > block else 1)
    chosen = items.where(~F.col("zero")).orderBy(F.xxhash64("id"), "id").limit(min(count, MOST_CELLS)).collect()
    least = F.lit(float("-inf")).alias("bar")
    it, q = (df.where(~F.col("zero")).select("id", "vec") for df in (items, queries))
    if len(chosen) < 2:  # one cell: nothing to skip
        it, q = it.withColumn("cell", F.lit(0)), q.withColumn("cell", F.lit(0))
        near = materialize(top_n(_meet(q.select("*", least), it, k, exclude_self, block), ["query_id"], _order(), k))
        if visits is not None:
            visits += [n * q.count(), n * q.count()]
    else:
        tree = Tree.of(np.array([r["vec"] for r in chosen], dtype=float))

        def dealt(batches):
            for b in batches:
                if b.num_rows:
                    cell, angle, top = tree.locate(_matrix(b.column("vec")))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(angle), pa.array(top)], ["id", "vec", "cell", "angle", "top"])

        place = lambda df: materialize(df.mapInArrow(dealt, f"id {df.schema['id'].dataType.simpleString()}, vec array<double>, cell int, angle double, top double"))
        it, q = place(it), place(q)
        widest = {r["cell"]: r for r in it.groupBy("cell").agg(F.max("angle").alias("r"), F.max("top").alias("t"), F.count(F.lit(1)).alias("n")).collect()}  # a row per cell
        tree.radius = np.array([widest[c]["r"] if c in widest else -1.0 for c in range(len(tree.centres))])
        tops = np.array([widest[c]["t"] if c in widest else -1.0 for c in range(len(tree.centres))])
        tree.top_radius = np.maximum.reduceat(tops, tree.first[:-1])
        size = tree.centres.shape[1]
        if short:
            norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
            ends = it.select("cell", F.transform("vec", lambda x: x / norm).alias("v")).groupBy("cell").agg(
                F.array(*[F.min(F.get("v", F.lit(d))) for d in range(size)]).alias("low"), F.array(*[F.max(F.get("v", F.lit(d))) for d in range(size)]).alias("high")).collect()  # a row per cell
            tree.low, tree.high = np.full((len(tree.centres), size), np.inf), np.full((len(tree.centres), size), -np.inf)
            for r in ends:
                tree.low[r["cell"]], tree.high[r["cell"]] = r["low"], r["high"]
        near = materialize(top_n(_meet(q.select("id", "vec", "cell", least), it, k, exclude_self, block), ["query_id"], _order(), k))
        compared = q.groupBy("cell").count()
        for first in (True, False):
            # The bar so far decides which cells are visited: the most promising ones, and with the bar that these leave the rest.
            bars = near.groupBy("query_id").agg(F.min("similarity").alias("b"), F.count(F.lit(1)).alias("m")).select("query_id", F.when(F.col("m") >= k, F.col("b")).alias("b"))
            q = q.join(bars, F.col("id") == F.col("query_id"), "left").select("id", "vec", "cell", F.coalesce("b", F.lit(-2.0)).alias("bar"), *([] if first else [F.col("bar").alias("before")]))
            q = materialize(q)
            if not first and _share(tree, q, widest, n) > CROWDED:
                # The bars rule out few cells: all items are met in blocks, with the bars.
                near = materialize(top_n(_meet(q.withColumn("cell", F.lit(0)), it.withColumn("cell", F.lit(0)), k, exclude_self, max(block, WHOLE)), ["query_id"], _order(), k))
                compared = q.groupBy(F.lit(0).alias("cell")).count()
                widest = {0: {"n": n}}
                break
            away = materialize(q.mapInArrow(_visits(tree, first), f"id {ids}, vec array<double>, cell int, bar double"))
            compared = compared.unionByName(away.groupBy("cell").count())
            found = near.unionByName(_meet(away, it, k, exclude_self, block))
            near = materialize(top_n(found, ["query_id"], _order(), k))
        if visits is not None:
            visits += [sum(r["count"] * widest[r["cell"]]["n"] for r in compared.collect() if r["cell"] in widest), n * q.count()]
    zeros = items.where("zero").select("id", "vec", F.lit(-1).alias("cell"))
    bars = near.groupBy("query_id").agg(F.min("similarity").alias("b"), F.count(F.lit(1)).alias("m"))
    to_zeros = (q.select("id", "vec").join(bars, F.col("id") == F.col("query_id"), "left").where((F.coalesce("m", F.lit(0)) < k) | (F.col("b") <= 0))
                .select("id", "vec", F.lit(-1).alias("cell"), least))
    found = near.unionByName(_meet(to_zeros, zeros, k, exclude_self, block))
    # A zero query is as near to every item.
    first = [r["id"] for r in items.orderBy("id").limit(k + 1).select("id").collect()]
    if first:
        rest = F.array(*map(F.lit, first))
        if exclude_self:
            rest = F.filter(rest, lambda x: x != F.col("id"))
        found = found.unionByName(queries.where("zero").select(
            F.col("id").alias("query_id"), F.explode(F.slice(rest, 1, k)).alias("item_id"), F.lit(0.0).alias("similarity")))
    return top_n(found, ["query_id"], _order(), k)


def _share(tree: Tree, q: DataFrame, widest: dict, n: int) -> float:
    """Share of the pairs in the cells that are left to visit, from ``SAMPLE`` queries. It only chooses how the rest is compared."""
    some = materialize(q.orderBy(F.xxhash64("id"), "id").limit(SAMPLE))
    visits = some.mapInArrow(_visits(tree, False), f"id {q.schema['id'].dataType.simpleString()}, vec array<double>, cell int, bar double").groupBy("cell").count().collect()  # a row per cell
    return sum(r["count"] * widest[r["cell"]]["n"] for r in visits) / max(1, n * some.count())


def _visits(tree: Tree, first: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, vec, cell, bar) of queries for the other cells they visit: the ``FIRST`` most promising ones, or those but for these."""

    def promising(v: np.ndarray, bar: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, cell, least = tree.reach(v, _limit(bar))
        other = cell != own[row]
        row, cell, least = row[other], cell[other], least[other]
        order = np.lexsort((cell, least, row))
        return row[order], cell[order], place_in_group(row[order])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                v, own, bar = _matrix(b.column("vec")), b.column("cell").to_numpy(), b.column("bar").to_numpy()
                row, cell, place = promising(v, bar if first else b.column("before").to_numpy(), own)
                early = place < FIRST
                if first:
                    row, cell = row[early], cell[early]
                else:  # what the first visits left, as far as the new bar doesn't rule it out
                    seen = row[early] * len(tree.centres) + cell[early]
                    row, cell, _ = promising(v, bar, own)
                    new = ~np.isin(row * len(tree.centres) + cell, seen)
                    row, cell = row[new], cell[new]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), b.column("vec").take(pa.array(row)), pa.array(cell, pa.int32()), pa.array(bar[row], pa.float64())],
                                                 ["id", "vec", "cell", "bar"])

    return run


def brute_force_topk(queries: DataFrame, items: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """Reference answer for tests on small fixtures: score every (query, item) pair."""
    d = int(items.select(F.size("vec")).first()[0])
    pairs = queries.select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")).crossJoin(
        items.select(F.col("id").alias("item_id"), F.col("vec").alias("ivec")))
    if exclude_self:
        pairs = pairs.where(F.col("item_id") != F.col("query_id"))
    pairs = pairs.select("query_id", "item_id", F.round(cosine(F.col("qvec"), F.col("ivec"), d), ROUND).alias("similarity"))
    return top_n(pairs, ["query_id"], [F.col("similarity").desc(), F.col("item_id")], k)

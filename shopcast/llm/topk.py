"""Exact top-k by integer inner product, with columnar branch-and-bound.

Method. Components are turned into floor(256 * x). Candidates are dealt into
chunks and held in vertical layout: a matrix per block of dimensions, most
energetic dimensions first. For a block of queries the products of the first
dimension block are one matrix product. From then on, per query, the products
of the remaining dimensions are bounded by the norms of what remains
(Cauchy-Schwarz), the k-th largest lower bound is the bar, and only candidates
whose upper bound reaches it are compacted and accumulated over the next block.
No candidate that could be among the k best, ties included, is dropped. The
first chunk is searched before the others, and its k-th score of a query is a bar
that the query takes along to them, so what one chunk proves prunes the next.

Scale: every query block meets every chunk once, in a task of its own; a task
holds ``CHUNK`` + ``QUERIES`` vectors and multiplies ``STEP`` queries at a time. A
vector is shuffled once per block of queries, a query once per chunk: the table
goes over the wire once for every ``QUERIES`` queries. A task passes on k rows per
query at most, those that reach the bar, and a window over a query merges them.
Nothing is broadcast.

Rows: vectors that are null or hold a null or non-finite component take no part;
vectors of different lengths are compared as if the shorter ended in zeros; an
empty vector is a vector of zeros; a row is not a candidate for itself, but a
repeat of it with the same id is, and a repeated query row has result rows of
its own; components saturate at the bounds of a long, and so do scores. Null ids come last
among ties and are no queries. Further columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shopcast.llm.common import materialize

K = 5
CHUNK, QUERIES, BLOCK = 16_384, 65_536, 8
#: Queries whose products with a chunk are held at a time.
STEP = 64
_RESULT = "query_uid long, query_id long, vec_id long, uid long, score long"


def _matrix(vectors: list[list[int]], width: int) -> np.ndarray:
    """A row per vector; doubles where every partial product and sum is exact in them, else Python integers."""
    exact = max((abs(x) for v in vectors for x in v), default=0) < 2**20 and width < 2**12
    out = np.zeros((len(vectors), width), np.float64 if exact else object)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _dense(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    flat, lengths = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    if len(flat) and (lengths == width).all() and np.abs(flat.astype(np.float64)).max() < 2**20 and width < 2**12:
        return flat.reshape(-1, width).astype(np.float64)
    return _matrix(lists.to_pylist(), width)


def search(q: np.ndarray, x: np.ndarray, own: np.ndarray, rank: np.ndarray, k: int, block: int = BLOCK, bars: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per row of ``q``: the rows of ``x`` with the k largest inner products and these. ``own``: the query's row in ``x``
    or -1. ``rank`` decides ties, smallest first. ``bars``: per query a product below which rows are of no interest."""
    order = np.argsort(-(x.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    q, xt = q[:, order], np.ascontiguousarray(x[:, order].T)
    starts = list(range(0, len(order), block)) or [0]
    # What remains after each block, rounded up so that the bound holds in doubles.
    rest = lambda m, at: np.sqrt((m[at:].astype(np.float64) ** 2).sum(axis=0)) * (1 + 1e-9) + 1e-6
    x_rest, q_rest = [rest(xt, at + block) for at in starts], [rest(q.T, at + block) for at in starts]
    for i in range(len(q)):
        if i % STEP == 0:
            first = q[i:i + STEP, :block] @ xt[:block]
        alive, sums = np.arange(len(x)), first[i % STEP]
        if own[i] >= 0:
            alive, sums = np.delete(alive, own[i]), np.delete(sums, own[i])
        bar = -np.inf if bars is None or sums.dtype == object else bars[i]
        for n, at in enumerate(starts):
            if n:
                sums = sums + q[i, at:at + block] @ xt[at:at + block, alive]
            if len(alive) <= k and bar == -np.inf:
                continue
            slack = q_rest[n][i] * x_rest[n][alive]
            low = (sums - slack).astype(np.float64)
            if len(low) > k:
                bar = max(bar, np.partition(low, len(low) - k)[len(low) - k])
            keep = (sums + slack).astype(np.float64) >= bar
            alive, sums = alive[keep], sums[keep]
        best = np.lexsort((rank[alive], -sums))[:k] if sums.dtype != object else np.array(sorted(range(len(alive)), key=lambda j: (-sums[j], rank[alive[j]]))[:k], np.int64)
        yield alive[best], sums[best]


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (floor(scale * x) as longs) of the vectors that take part, with a uid per row."""
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(sound).select("vec_id", ints.alias("v"), F.monotonically_increasing_id().alias("uid"))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, chunk: int = CHUNK, queries: int = QUERIES, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` (vec_id, embedding) on which ``is_query`` holds."""
    rows = materialize(scaled(vectors, scale).withColumn("q", F.coalesce(is_query, F.lit(False))))
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    chunks, blocks = max(1, math.ceil(n / chunk)), max(1, math.ceil(n_queries / queries))
    deal = lambda parts, seed: F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(parts)).cast("int")
    some = rows.where("q").select(*[F.col(c).alias(c) for c in ("vec_id", "uid", "v")], deal(blocks, 1).alias("block"))
    every = rows.select("vec_id", "uid", "v", deal(chunks, 2).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if a.num_rows and b.num_rows:
            width = max(int(pc.max(pc.list_value_length(t.column("v"))).as_py()) for t in (a, b))
            q, x = _dense(a.column("v"), width), _dense(b.column("v"), width)
            if q.dtype != x.dtype:
                q, x = q.astype(object), x.astype(object)
            uid, vec = b.column("uid").to_numpy(), b.column("vec_id").to_pylist()
            at = {u: i for i, u in enumerate(uid.tolist())}
            rank = np.empty(len(vec), np.int64)
            rank[sorted(range(len(vec)), key=lambda i: (vec[i] is None, vec[i] or 0, uid[i]))] = np.arange(len(vec))
            q_uid, q_id = a.column("uid").to_pylist(), a.column("vec_id").to_pylist()
            # A bar that a double can't hold exactly is none.
            bars = np.array([-np.inf if s is None or abs(s) > 2**53 else s for s in a.column("bar").to_pylist()])
            for i, (rows, sums) in enumerate(search(q, x, np.array([at.get(u, -1) for u in q_uid]), rank, k, bars=bars)):
                found += [(q_uid[i], q_id[i], vec[r], int(uid[r]), max(-(2**63), min(2**63 - 1, int(s)))) for r, s in zip(rows, sums, strict=True)]
        cols = list(zip(*found, strict=True)) or [()] * 5
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["query_uid", "query_id", "vec_id", "uid", "score"])

    meet = lambda a, b: a.groupBy("block", "chunk").cogroup(b.groupBy("block", "chunk")).applyInArrow(run, _RESULT)
    near = meet(some.withColumns({"chunk": F.lit(0), "bar": F.lit(None).cast("long")}), every.where("chunk = 0"))
    if chunks > 1:
        near = materialize(near)
        bars = near.groupBy(F.col("query_uid").alias("uid")).agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("bar"))
        on = some.join(bars, "uid", "left").withColumn("chunk", F.explode(F.sequence(F.lit(1), F.lit(chunks - 1))))
        near = near.unionByName(meet(on, every.where("chunk > 0")))
    place = F.row_number().over(W.partitionBy("query_uid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "uid"))
    return near.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

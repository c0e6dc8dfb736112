"""Centroid clustering (Lloyd's rounds) in exact integers, with zone maps over a space-filling curve.

Method. Components are turned into floor(1024 * x). Vectors are sorted along a
Hilbert curve over the dimensions of largest variance, and runs of ``BLOCK``
vectors become blocks, each with its box: the smallest and largest value of every
dimension. In a round, the box bounds the distances of a block's vectors to each
centroid from both sides; a centroid whose least distance is above another's
greatest is out, and so is one that the centroid nearest to the box's middle beats
at every point of the box (the difference of two squared distances is linear, so its
extreme lies at a corner). A block with one candidate left is settled by its stored
sum, its vectors aren't looked at; the others compare all vectors with the candidates in
one matrix product. Ties go to the smaller number, in the bounds as well.

Scale: the vectors are shuffled once, into the order of the curve (equal vectors are
spread by a hash of their place), and written as blocks. A round reads the
blocks and passes on k * (dimensions + 1) sums per task; the driver holds k
centroids. Work for pruned blocks is that of their boxes. Sums are kept in
decimals of 38 digits.

Rows: vectors that are null, hold a null or non-finite component, or have not
exactly ``dims`` components take no part. Repeated rows count each, as starts
too. A null vec_id is passed on; as a start it comes last. With fewer vectors than ``k``
every vector is a start. Components saturate at the bounds of a long, and so do distances and
inertias; below 2**22 all arithmetic is in doubles that hold it exactly, above in Python integers.
Further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.llm.common import materialize
from shopcast.llm.topk import scaled

K, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
BLOCK = 512
#: Dimensions that the curve runs through, and bits of each: a key of 64 bits.
AXES, BITS = 8, 8
#: Vectors of one partition while the blocks are made.
PART = 1 << 17
_EXACT = 1 << 22
_LONG = 2**63 - 1


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each row of ``cells`` (integers below 2**bits, one column per axis) on the Hilbert curve, as unsigned 64-bit integers.

    Works on all rows at once. Going down from the highest bit, an axis whose bit is set mirrors the
    lower bits of the first axis, one whose bit is clear swaps its lower bits with the first axis's; what is
    left is the curve's Gray code, axis by axis.
    """
    x = [c.astype(np.uint64) for c in cells.T]
    n, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for a in range(n):
            is_set = (x[a] >> np.uint64(b)) & one == one
            swap = np.where(is_set, np.uint64(0), (x[0] ^ x[a]) & low)
            x[0] = np.where(is_set, x[0] ^ low, x[0] ^ swap)
            if a:
                x[a] = x[a] ^ swap
    for a in range(1, n):
        x[a] = x[a] ^ x[a - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(b)) & one == one, np.uint64((1 << b) - 1), np.uint64(0))
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for a in range(n):
            key = (key << one) | (((x[a] ^ flip) >> np.uint64(b)) & one)
    return key


def _lists(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _moments(rows: DataFrame, dims: int) -> list:
    """Per dimension: n, smallest, largest, mean and variance of the vectors' values; ``dims`` rows."""

    def run(batches):
        n, total, square = 0, np.zeros(dims), np.zeros(dims)
        low, high = np.full(dims, np.inf), np.full(dims, -np.inf)
        for b in batches:
            if b.num_rows:
                v = _lists(b.column("v"), dims).astype(np.float64)
                n, total, square = n + len(v), total + v.sum(0), square + (v * v).sum(0)
                low, high = np.minimum(low, v.min(0)), np.maximum(high, v.max(0))
        if n:
            yield pa.RecordBatch.from_pydict({"dim": np.arange(dims, dtype=np.int32), "n": np.full(dims, n), "s": total, "ss": square, "lo": low, "hi": high})

    parts = rows.select("v").mapInArrow(run, "dim int, n long, s double, ss double, lo double, hi double")
    out = parts.groupBy("dim").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")], F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    return [(r.dim, r.n, r.lo, r.hi, r.ss / r.n - (r.s / r.n) ** 2) for r in out]


def blocks(rows: DataFrame, dims: int = DIMS, size: int = BLOCK) -> DataFrame:
    """Blocks of the vectors ``rows`` (vec_id, v, uid) in the order of the curve: ids, vectors (packed), lo, hi, n, total."""
    moments = _moments(rows, dims)
    axes = sorted(sorted(moments, key=lambda m: (-m[4], m[0]))[:AXES])
    low, span = np.array([m[2] for m in axes]), np.array([max(m[3] - m[2], 1.0) for m in axes])
    which, n = [m[0] for m in axes], max((m[1] for m in moments), default=0)

    def place(batches):
        for b in batches:
            v = _lists(b.column("v"), dims)[:, which].astype(np.float64)
            cells = np.clip((v - low) / span * 2**BITS, 0, 2**BITS - 1).astype(np.uint64)
            key = (hilbert_keys(cells) ^ np.uint64(2**63)).view(np.int64) if len(v) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key, pa.int64())], [*b.schema.names, "key"])

    def pack(batches):
        held: list = []
        ids: list = []
        for b in batches:
            held.append(_lists(b.column("v"), dims))
            ids += b.column("vec_id").to_pylist()
            while len(ids) >= size:
                v = np.concatenate(held)
                yield block(ids[:size], v[:size])
                held, ids = [v[size:]], ids[size:]
        if ids:
            yield block(ids, np.concatenate(held))

    def block(ids: list, v: np.ndarray) -> pa.RecordBatch:
        lo, hi = v.min(0), v.max(0)
        small = lo.min() >= -(2**31) and hi.max() < 2**31
        total = [Decimal(int(x)) for x in (v.sum(0) if small else v.astype(object).sum(0))]
        raw = v.astype("<i4" if small else "<i8").tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([raw], pa.binary()), pa.array([lo], pa.list_(pa.int64())), pa.array([hi], pa.list_(pa.int64())),
             pa.array([len(ids)], pa.int64()), pa.array([total], pa.list_(pa.decimal128(38, 0)))], ["ids", "raw", "lo", "hi", "n", "total"])

    if not n:
        return rows.sparkSession.createDataFrame([], _BLOCK)
    parts = max(math.ceil(n / PART), min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / (4 * size))))
    keyed = rows.select("vec_id", "uid", "v").mapInArrow(place, "vec_id long, uid long, v array<long>, key long")
    spread = F.xxhash64("uid")
    return keyed.repartitionByRange(parts, F.col("key"), spread).sortWithinPartitions("key", spread).select("vec_id", "v").mapInArrow(pack, _BLOCK)


_BLOCK = "ids array<long>, raw binary, lo array<long>, hi array<long>, n long, total array<decimal(38,0)>"


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in doubles where squares and their sums are exact in them, else as Python integers."""
    large = any(a.size and (int(a.max()) >= _EXACT or int(a.min()) <= -_EXACT) for a in arrays) or arrays[0].shape[-1] > 128
    return [a.astype(object) if large else a.astype(np.float64) for a in arrays]


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The numbers of the centroids that are nearest to some point of the box from ``lo`` to ``hi``, as far as the bounds can tell."""
    lo, hi, c = _exact(lo, hi, centroids)
    least = (np.maximum(np.maximum(lo - c, c - hi), 0) ** 2).sum(axis=1)
    most = (np.maximum(abs(c - lo), abs(c - hi)) ** 2).sum(axis=1)
    left = np.flatnonzero(least <= most.min())
    middle = ((lo + hi - 2 * c[left]) ** 2).sum(axis=1)
    z = left[int(np.argmin(middle))]
    # Largest value over the box of distance to z less distance to the other one.
    lead = np.maximum((lo - c[z]) ** 2 - (lo - c[left]) ** 2, (hi - c[z]) ** 2 - (hi - c[left]) ** 2).sum(axis=1)
    return left[(lead > 0) | ((lead == 0) & (left <= z))]


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``v`` the place of the nearest row of ``centroids`` (ties: the first) and the squared distance."""
    v, c = _exact(v, centroids)
    d = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]
    best = np.array([min(range(d.shape[1]), key=row.__getitem__) for row in d], np.int64) if d.dtype == object else d.argmin(axis=1)
    return best, d[np.arange(len(d)), best]


def _vectors(raw: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4" if len(raw) == 4 * n * dims else "<i8").reshape(n, dims)


def _open_blocks(batches, centroids: np.ndarray):
    """Blocks one by one, each with its candidates."""
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1)
            lo, hi = (np.array(row.column(c)[0].as_py(), np.int64) for c in ("lo", "hi"))
            yield row, candidates(lo, hi, centroids)


def _sums(table: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Per cluster that has vectors: their number and their sum."""
    dims = centroids.shape[1]

    def run(batches):
        n, total = {}, {}
        for row, left in _open_blocks(batches, centroids):
            size = row.column("n")[0].as_py()
            if len(left) == 1:
                parts = [(int(left[0]), size, np.array([int(x) for x in row.column("total")[0].as_py()], object))]
            else:
                v = _vectors(row.column("raw")[0].as_py(), size, dims)
                best, _ = nearest(v, centroids[left])
                exact = v if v.dtype == np.dtype("<i4") else v.astype(object)
                parts = [(int(left[j]), int((best == j).sum()), exact[best == j].sum(axis=0)) for j in np.unique(best)]
            for c, m, s in parts:
                n[c] = n.get(c, 0) + m
                total[c] = total.get(c, 0) + s.astype(object)
        rows = [(c, d, Decimal(int(x))) for c in n for d, x in enumerate([n[c], *total[c]], -1)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.decimal128(38, 0))], ["cluster", "dim", "s"])

    found = table.mapInArrow(run, "cluster int, dim int, s decimal(38,0)").groupBy("cluster", "dim").agg(F.sum("s").alias("s")).collect()
    out: dict = {}
    for r in found:
        out.setdefault(r.cluster, {})[r.dim] = int(r.s)
    return {c: (s[-1], [s[d] for d in range(dims)]) for c, s in out.items()}


def starts(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``, in the order of the hash."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(h.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


def lloyd(table: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after ``rounds`` rounds over the blocks of ``table``; earlier where a round changes nothing."""
    for _ in range(rounds):
        now = centroids.copy()
        for c, (n, total) in _sums(table, centroids).items():
            now[c] = [x // n for x in total]
        if (now == centroids).all():
            break
        centroids = now
    return centroids


def assign(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector of the blocks."""
    dims = centroids.shape[1]

    def run(batches):
        for row, left in _open_blocks(batches, centroids):
            n = row.column("n")[0].as_py()
            best, d = nearest(_vectors(row.column("raw")[0].as_py(), n, dims), centroids[left])
            distance = [min(int(x), _LONG) for x in d] if d.dtype == object else d.astype(np.int64)
            yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), pa.array(left[best], pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return table.select("ids", "raw", "lo", "hi", "n").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Per kept row of ``vectors`` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. Runs its rounds as it is called."""
    spark = vectors.sparkSession
    rows = materialize(scaled(vectors, scale).where(F.size("v") == dims))
    table = materialize(blocks(rows, dims))
    centroids = starts(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = lloyd(table, centroids, rounds)
    out = materialize(assign(table, centroids))
    sums = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    known = spark.createDataFrame([(c, min(s, _LONG), min(sum(sums.values()), _LONG), digest(c)) for c, s in sorted(sums.items())],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

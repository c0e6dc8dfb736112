"""Sparse products of users with columns, a block of users and a part of the columns at a time.

The recommenders that answer every user need, for each user, the best columns (products) of a
sparse product: ratings times similarities, or shared buyers times purchases. As rows, every
term of every sum would be shuffled. Here users are dealt into blocks and columns into parts; both
factors travel as packed rows (arrays, or many users' arrays as one compressed value, see :func:`pack`), one copy per block or part
that needs them, and a task adds the terms up in numpy and keeps the best ``limit`` columns of its users. Per
(block, part) one packed row per user leaves the task. Where the copies are many, the grid is run in waves of some cells each
(:func:`waves`), and what a wave shuffled is removed before the next, so that the disk holds few copies at a time.

The rows of one (block, part) come to a task in order of (slice, tag): first the users, then, slice
by slice, columns and rows of the other factor, so that a task holds its users and one slice.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of rows of a cell of the grid, in the order in which they come.
USERS, COLUMNS, ROWS, MORE = range(4)
CELL = "gid int, slice int, tag int, key long, ids array<long>, vals array<double>, more array<long>, bits array<long>, blob binary"
PACKED = "user_id long, ids array<long>, vals array<double>"
#: Partitions of a grid; more cells than that share them.
MOST_PARTITIONS = 20_000
#: Entries that travel in one wave: so many, or so many times all entries, if that is more.
WAVE, COPIES = 1 << 27, 4


@dataclass(frozen=True)
class Grid:
    """How users and columns are dealt: ``blocks`` of users, ``parts`` of columns, each in ``slices``."""

    blocks: int
    parts: int
    slices: int = 1

    @classmethod
    def of(cls, users: int, block: int, columns: int, width: int, tasks: int, entries: int = 0, most_entries: int = 1) -> Grid:
        """Blocks of about ``block`` users; enough parts for ``tasks`` tasks (16 at most); slices of at most about ``width`` columns and ``most_entries`` entries."""
        blocks = max(1, math.ceil(users / block))
        parts = min(16, max(1, math.ceil(tasks / blocks)))
        return cls(blocks, parts, max(1, math.ceil(columns / parts / width), math.ceil(entries / parts / most_entries)))

    def block(self, user: str) -> Column:
        return F.pmod(F.xxhash64(F.col(user), F.lit(1)), F.lit(self.blocks)).cast("int")

    def slot(self, column: str) -> Column:
        """Part and slice of a column in one number."""
        return F.pmod(F.xxhash64(F.col(column), F.lit(2)), F.lit(self.parts * self.slices)).cast("int")

    def rows(self, df: DataFrame, tag: int | Column, *, block: Column | None = None, slot: Column | None = None, **fields: Column) -> DataFrame:
        """``df`` as rows of the grid. Without ``block`` a copy for every block, without ``slot`` one for every part, ahead of the slices."""
        out = df.withColumn("__b", block if block is not None else F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))))
        if slot is not None:
            out = out.withColumn("__s", slot).withColumn("__p", F.col("__s") % self.parts).withColumn("__s", F.floor(F.col("__s") / self.parts))
        else:
            out = out.withColumn("__s", F.lit(-1)).withColumn("__p", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))))
        empty = {"key": F.lit(0), "ids": F.array(), "vals": F.array(), "more": F.array(), "bits": F.array(), "blob": F.lit(None)}
        types = {"key": "long", "ids": "array<long>", "vals": "array<double>", "more": "array<long>", "bits": "array<long>", "blob": "binary"}
        return out.select((F.col("__b") * self.parts + F.col("__p")).cast("int").alias("gid"), F.col("__s").cast("int").alias("slice"), (tag if isinstance(tag, Column) else F.lit(tag)).alias("tag"),
                          *[fields.get(c, empty[c]).cast(types[c]).alias(c) for c in types])

    def run(self, rows: DataFrame, task: Callable[[Iterator[tuple]], Iterator[tuple]], limit: int, largest_first: bool = True, ordered: bool = True,
            wave: tuple[int, int] | None = None) -> DataFrame:
        """The best ``limit`` (user_id, column, value) per user of what ``task`` gives for the cells of the grid: (user, ids, vals) each.

        For a ``wave`` of cells, in a grid of one part, these lists as they are: ``user_id, ids, vals``.
        """
        found = self.packed(rows, task, ordered, wave=wave)
        if wave is not None:
            return found
        if self.parts == 1:
            best = found.select("user_id", pairs().alias("best"))
        else:
            best = found.groupBy("user_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list(pairs()))), 1, limit).alias("best"))
        return listed(best)

    def packed(self, rows: DataFrame, task: Callable[[Iterator[tuple]], Iterator[tuple]], ordered: bool = True, schema: str = PACKED,
               wave: tuple[int, int] | None = None) -> DataFrame:
        """What ``task`` gives for the cells of the grid (of a ``wave`` from one to before another), as it is: columns of ``schema``.

        A task that takes the rows of its cell in any order, not ``ordered``, spares their sort.
        """
        names = [c.split()[0] for c in schema.split(", ")]

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, runs in cells(batches):
                for first, *others in task(runs):
                    yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), *others], names)

        low, high = wave or (0, self.blocks * self.parts)
        n = min(high - low, MOST_PARTITIONS)
        dealt = rows.repartitionById(n, F.col("gid") - low)
        return (dealt if not ordered and n == high - low else dealt.sortWithinPartitions("gid", "slice", "tag")).mapInArrow(work, schema)


def pairs() -> Column:
    """Packed ids and values as (-value, id), which sort from the best on."""
    return F.arrays_zip(F.transform("vals", lambda v: -v).alias("v"), F.col("ids").alias("id"))


def listed(best: DataFrame) -> DataFrame:
    """``user_id, column, value`` from ``user_id`` and its :func:`pairs`, ``best``."""
    return best.select("user_id", F.explode("best").alias("b")).select("user_id", F.col("b.id").alias("column"), (-F.col("b.v")).alias("value"))


def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, int, pa.RecordBatch]]]]:
    """The cells of the grid in a partition one after the other, each as runs (slice, tag, rows) in their order."""
    stream = _runs(batches)
    ahead = next(stream, None)
    while ahead is not None:
        gid = ahead[0]

        def mine():
            nonlocal ahead
            while ahead is not None and ahead[0] == gid:  # noqa: B023
                _, at, tag, rows = ahead
                ahead = next(stream, None)
                yield at, tag, rows

        one = mine()
        yield gid, one
        for _ in one:  # what the task left
            pass


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, int, pa.RecordBatch]]:
    for b in batches:
        if not b.num_rows:
            continue
        marks = [b.column(c).to_numpy() for c in ("gid", "slice", "tag")]
        edge = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
        for at, end in zip([0, *edge.tolist()], [*edge.tolist(), b.num_rows], strict=True):
            yield int(marks[0][at]), int(marks[1][at]), int(marks[2][at]), b.slice(at, end - at)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, the bytes of a place together: ids and ratings of few values take a few bytes each."""
    if any(x.dtype == object for x in arrays):
        return b"o" + zlib.compress(pickle.dumps(arrays))
    body = b"".join(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes() for x in arrays)
    head = ",".join(f"{x.dtype.str}:{len(x)}" for x in arrays).encode()
    return b"n" + head + b";" + (pa.compress(body, codec="zstd", asbytes=True) if body else b"")


def unpack(blob: bytes) -> list[np.ndarray]:
    """The arrays of :func:`pack`."""
    if blob[:1] == b"o":
        return list(pickle.loads(zlib.decompress(blob[1:])))
    head, _, body = blob[1:].partition(b";")
    kinds = [(np.dtype(kind), int(n)) for kind, n in (x.split(":") for x in head.decode().split(","))]
    size = sum(kind.itemsize * n for kind, n in kinds)
    raw, at, out = np.frombuffer(pa.decompress(body, size, codec="zstd") if size else b"", np.uint8), 0, []
    for kind, n in kinds:
        out.append(np.ascontiguousarray(raw[at:at + kind.itemsize * n].reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += kind.itemsize * n
    return out


def narrow(ids: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the smallest type that holds them."""
    return ids.astype(np.min_scalar_type(int(ids.max(initial=0))))


def waves(cells: int, copies: float, entries: float, tasks: int) -> list[tuple[int, int]]:
    """Cells low <= cell < high that run together: of ``copies`` entries that travel to all ``cells`` no more than ``COPIES`` times all ``entries`` (or ``WAVE``), and ``tasks`` cells at least."""
    n = max(1, min(math.ceil(copies / max(WAVE, COPIES * entries)), cells // max(1, tasks)))
    edges = [cells * i // n for i in range(n + 1)]
    return list(zip(edges, edges[1:], strict=False))


def attach(lists: DataFrame, info: DataFrame, key: str, value: str, read: Callable[[pa.RecordBatch], Iterable[tuple]] | None = None) -> DataFrame:
    """``user_id``, ``value`` and the columns of ``info`` for each entry of lists ``user_id, ids, vals`` whose id is in the column ``key`` (long), as by a join.

    A row per entry would be shuffled by its id. Here the entries of many users go to a bucket of ids as one compressed value. ``read`` gives the
    (users, lengths, ids, vals) of a batch of other rows than such lists.
    """
    spark = info.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) | 1
    mixed = F.col(key).cast("long")
    for shift in (7, 15, 23, 31):
        mixed = mixed.bitwiseXOR(F.shiftright(F.col(key).cast("long"), shift))
    rows = info.where(F.col(key).isNotNull()).select(F.pmod(mixed, F.lit(buckets)).cast("int").alias("__bucket"), F.lit(0).alias("__tag"), F.lit(None).cast("binary").alias("__blob"), *info.columns)
    names, schema = info.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in info.schema)

    def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held, n = [], 0
        for b in batches:
            for users, lengths, ids, vals in read(b) if read else [(b.column("user_id").to_numpy(), flat(b.column("ids"))[1], flat(b.column("ids"))[0], flat(b.column("vals"))[0])]:
                held.append((np.repeat(users, lengths), ids, vals))
                n += len(ids)
                if n > 1 << 20:
                    yield [np.concatenate(x) for x in zip(*held, strict=True)]
                    held, n = [], 0
        if n:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for users, ids, vals in gathered(batches):
            bucket = (ids ^ (ids >> 7) ^ (ids >> 15) ^ (ids >> 23) ^ (ids >> 31)) % buckets
            order = np.argsort(bucket, kind="stable")
            edges = np.append(np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)), len(order))
            blobs = [pack(*(x[order[a:z]] for x in (users, ids, vals))) for a, z in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order[edges[:-1]]], pa.int32()), pa.array(blobs, pa.binary())], ["b", "blob"])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, table, ids, order = [], None, None, None
        for b in batches:
            mine = b.column("__tag").to_numpy() == 0
            if mine.any():
                held.append(b.filter(pa.array(mine)).select(names))
            if not held or mine.all():
                continue
            if table is None:
                table = pa.Table.from_batches(held).combine_chunks()
                ids = table.column(key).cast(pa.int64()).to_numpy()
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
            for blob in b.column("__blob").filter(pa.array(~mine)):
                users, wanted, vals = unpack(blob.as_py())
                for at in range(0, len(users), 1 << 16):
                    some = wanted[at:at + (1 << 16)]
                    first = np.searchsorted(ids, some)
                    where, entry = spans(first, np.searchsorted(ids, some, side="right") - first)
                    got = table.take(pa.array(order[where])).combine_chunks()
                    for part in got.to_batches():
                        yield pa.RecordBatch.from_arrays([pa.array(users[at + entry], pa.int64()), pa.array(vals[at + entry], pa.float64()), *part.columns], ["user_id", value, *names])

    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in info.schema]
    entries = lists.mapInArrow(deal, "b int, blob binary").select(F.col("b").alias("__bucket"), F.lit(1).alias("__tag"), F.col("blob").alias("__blob"), *nothing)
    return (rows.unionByName(entries).repartitionById(buckets, F.col("__bucket")).sortWithinPartitions("__bucket", "__tag")
            .mapInArrow(join, f"user_id long, `{value}` double, {schema}"))


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and how many each row has."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def spans(first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions first[i], first[i] + 1, ... of ``lengths[i]`` each, all in a row, and the i of each."""
    owner = np.repeat(np.arange(len(first)), lengths)
    return np.arange(len(owner)) - np.repeat(starts(lengths)[:-1], lengths) + first[owner], owner


def find(sorted_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each id among ``sorted_ids``, and whether it is there."""
    if not len(sorted_ids):
        return np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    at = np.searchsorted(sorted_ids, ids)
    at[at == len(sorted_ids)] = 0
    return at, sorted_ids[at] == ids


def place_in_group(groups: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal values."""
    if not len(groups):
        return np.zeros(0, np.int64)
    first = np.concatenate([[True], groups[1:] != groups[:-1]])
    at = np.arange(len(groups))
    return at - np.maximum.accumulate(np.where(first, at, 0))


def numbered(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells, sorted, and the place of each entry's cell among them; by marks where the cells lie dense, else by sorting."""
    low = int(cell.min())
    span = int(cell.max()) - low + 1
    if span > 8 * len(cell):
        return np.unique(cell, return_inverse=True)
    marks = np.zeros(span, bool)
    marks[cell - low] = True
    places = np.cumsum(marks) - 1
    return np.flatnonzero(marks) + low, places[cell - low]


class Best:
    """The best ``limit`` (value, id) of each of ``n`` users so far: largest values, then smallest ids."""

    def __init__(self, n: int, limit: int):
        self.limit = limit
        self.value, self.id = np.full((n, limit), -np.inf), np.full((n, limit), np.iinfo(np.int64).max)

    @property
    def bar(self) -> np.ndarray:
        """Value that a user's next candidate must reach."""
        return self.value[:, -1]

    def add(self, low: int, high: int, user: np.ndarray, ids: np.ndarray, value: np.ndarray) -> None:
        """Candidates of the users low <= user < high, in order of (user, id); every id is new to its user."""
        able = value >= self.bar[user]
        user, ids, value = user[able] - low, ids[able], value[able]
        if not len(user):
            return
        counts = np.bincount(user, minlength=high - low)
        place = np.arange(len(user)) - np.repeat(starts(counts)[:-1], counts)
        if counts.max() > self.limit:  # without sorting: what lies above the limit-th value, and of those equal to it the first ids
            table = np.full((high - low, int(counts.max())), -np.inf)
            table[user, place] = value
            last = np.partition(table, table.shape[1] - self.limit, axis=1)[:, -self.limit]
            above, equal = table > last[:, None], table == last[:, None]
            keep = above | (equal & (np.cumsum(equal, axis=1) <= (self.limit - above.sum(axis=1))[:, None]))
            kept = keep[user, place]
            user, ids, value = user[kept], ids[kept], value[kept]
            counts = np.bincount(user, minlength=high - low)
            place = np.arange(len(user)) - np.repeat(starts(counts)[:-1], counts)
        rows = np.flatnonzero(counts)
        width = int(counts.max())
        v, i = np.full((len(rows), width), -np.inf), np.full((len(rows), width), np.iinfo(np.int64).max)
        at = np.searchsorted(rows, user)
        v[at, place], i[at, place] = value, ids
        v, i = np.concatenate([self.value[low + rows], v], axis=1), np.concatenate([self.id[low + rows], i], axis=1)
        order = np.lexsort((i, -v), axis=1)[:, :self.limit]
        self.value[low + rows], self.id[low + rows] = np.take_along_axis(v, order, 1), np.take_along_axis(i, order, 1)

    def packed(self, users: np.ndarray) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
        """Users with candidates, their ids and values, best first."""
        there = self.value > -np.inf
        counts = there.sum(axis=1)
        some = np.flatnonzero(counts)
        offsets = pa.array(starts(counts[some]).astype(np.int32), pa.int32())
        return users[some], pa.ListArray.from_arrays(offsets, pa.array(self.id[there], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(self.value[there], pa.float64()))

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many candidates each user has, their ids and values, best first."""
        there = self.value > -np.inf
        return there.sum(axis=1), self.id[there], self.value[there]

"""Packing token sequences of equal length, balanced by attention cost.

Method (cost-balanced packing). A document's tokens (its ids and one end id)
are cut into full pieces of ``capacity``, each a sequence of its own, and a
remainder. Remainders are gathered into windows of ``window`` tokens; the
tokens beyond a multiple of ``capacity`` (the shortest remainders, one of them
cut) go on to the next window, and the others fill their window's sequences to
the end. A piece of n tokens costs ``linear * n + quadratic * n * n``; pieces go
in descending order of cost to the sequence of lowest cost that still has room.
When none has room for all of a piece, it is cut: the sequence with most room is
filled and the rest is placed next. So a sequence's attention cost is near its
neighbours'.

The first pass works within input partitions, without a shuffle, and leaves
less than one sequence of each. These leftovers are shuffled into as many tasks
as their tokens fill windows and packed the same way; only a task of this second
pass pads, less than one sequence. The window bounds a task's memory in both.
The first pass is written before its leftovers are read, and ``sequence_id``
carries the pass and the task's number, so a task run again after a lost
executor gives the same rows.

Rows: null text counts as empty, and an empty document is one end id; repeated
rows are packed each; a null doc_id is passed on; further columns are not read;
an empty table gives an empty result. Ties go to the earlier row and the
lower sequence.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.llm.common import text_slices, written
from shopcast.llm.tokens import TOKENIZER, encoder

CAPACITY = 1024
#: Tokens of remainders that are packed together.
WINDOW = 1 << 20
#: Cost of n tokens: LINEAR * n + QUADRATIC * n * n. 1/1024: at 1,024 tokens attention costs as much as the rest.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

#: Marks the sequences of the second pass.
SECOND = 1 << 62

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def assign(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Place pieces of the given lengths (1 to ``capacity``): (piece, first token, tokens, sequence, offset in it)."""
    room = np.full(-(-sum(lengths) // capacity), capacity, np.int64)
    cost = np.zeros(len(room))
    placed = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        first, left = 0, lengths[i]
        while left:
            fits = room >= left
            s = int(np.where(fits, cost, np.inf).argmin())
            n = left
            if not fits[s]:
                s = int(room.argmax())
                n = int(room[s])
            placed.append((i, first, n, s, capacity - int(room[s])))
            room[s] -= n
            cost[s] += linear * n + quadratic * n * n
            first, left = first + n, left - n
    return placed


class _Packer:
    """Pieces of one task, as rows (doc_id, start, ids, doc_tokens, sequence_id, offset)."""

    def __init__(self, capacity: int, window: int, first_sequence: int):
        self.capacity, self.window, self.sequence = capacity, max(window, capacity), first_sequence
        #: Pieces that wait for a window: doc_id, start, ids, doc_tokens.
        self.rest: list[tuple[int | None, int, np.ndarray, int]] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            yield doc_id, at, ids[at:at + self.capacity], len(ids), self.sequence, 0
            self.sequence += 1
        if whole < len(ids):
            yield from self.wait(doc_id, whole, ids[whole:].copy(), len(ids))

    def wait(self, doc_id: int | None, start: int, ids: np.ndarray, total: int) -> Iterator[tuple]:
        """Take a piece of at most ``capacity`` tokens; a window that it fills is packed."""
        self.rest.append((doc_id, start, ids, total))
        self.tokens += len(ids)
        if self.tokens >= self.window:
            yield from self.fill()

    def fill(self) -> Iterator[tuple]:
        """Pack the waiting pieces into full sequences; less than one sequence waits on."""
        over, keep = self.tokens % self.capacity, []
        self.rest.sort(key=lambda r: len(r[2]), reverse=True)
        while over:
            doc_id, start, ids, total = self.rest.pop()
            n = max(0, len(ids) - over)
            if n:
                self.rest.append((doc_id, start, ids[:n], total))
            keep.append((doc_id, start + n, ids[n:], total))
            over -= len(ids) - n
        yield from self.flush()
        self.rest, self.tokens = keep, sum(len(r[2]) for r in keep)

    def flush(self) -> Iterator[tuple]:
        """Pack all waiting pieces; the last sequences may have room left."""
        for i, first, n, s, offset in assign([len(r[2]) for r in self.rest], self.capacity):
            doc_id, start, ids, total = self.rest[i]
            yield doc_id, start + first, ids[first:first + n], total, self.sequence + s, offset
        self.sequence += -(-self.tokens // self.capacity)
        self.rest, self.tokens = [], 0


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = 0, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32 (of little-endian 32-bit ids),
    doc_tokens, sequence_id, offset, and with ``with_ids`` the piece's ids."""

    def table(rows: Iterable[tuple], ids_too: bool) -> pa.RecordBatch:
        doc_id, start, ids, total, sequence, offset = zip(*rows, strict=True)
        cols = [doc_id, start, [len(x) for x in ids], [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], total, sequence, offset]
        arrays = [pa.array(c, pa.int64()) for c in cols]
        # The second pass needs the ids of what has no sequence yet.
        arrays.append(pa.array([x.tolist() if ids_too or s is None else None for x, s in zip(ids, sequence, strict=True)], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    def first(batches):
        enc = encoder(tokenizer)
        packer = _Packer(capacity, window, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], np.uint32)
        for b in text_slices(batches):
            rows = [r for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for r in packer.add(d, np.concatenate([enc.encode(t), end]))]
            if rows:
                yield table(rows, with_ids)
        rows = [*packer.fill(), *((*r, None, None) for r in packer.rest)]
        if rows:
            yield table(rows, with_ids)

    def second(batches):
        packer = _Packer(capacity, window, SECOND | TaskContext.get().partitionId() << 33)
        for b in text_slices(batches):
            pieces = zip(*[b.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")], strict=True)
            rows = [r for d, s, ids, n in pieces for r in packer.wait(d, s, np.array(ids, np.uint32), n)]
            if rows:
                yield table(rows, with_ids)
        rows = list(packer.flush())
        if rows:
            yield table(rows, with_ids)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = _SCHEMA + ", ids array<int>"
    placed = written(slim.mapInArrow(first, schema), "packing")
    left = placed.where("sequence_id is null")
    tasks = max(1, math.ceil((left.agg(F.sum("length")).first()[0] or 0) / window))
    order = ["doc_id", "start", "ids_crc32"]
    again = left.repartition(tasks, *order).sortWithinPartitions(*order).mapInArrow(second, schema)
    out = placed.where("sequence_id is not null").unionByName(again)
    return out if with_ids else out.drop("ids")

"""Exact deduplication with a sharded cuckoo-filter index over text digests.

Method. A text's digest is SHA-256 of the text without ASCII white space. The
index is split into shards by digest. A shard holds a cuckoo filter (four
16-bit fingerprints a bucket, two buckets a digest, moved about when both are
full) and, beside each fingerprint, the stored digest and its record. Looking
up compares fingerprints first and verifies a hit against the stored digest.
Deleting a digest frees its slot. When an insertion finds no slot after many
moves, the table is doubled and rebuilt from the stored digests. A record holds
how many live rows have the digest and which row is to stay.

Scale: a group may hold a third of all rows. Each task first runs its own rows
through an index of bounded size, so that it passes on one record per digest;
these meet in the shards. The number of shards follows from the number of rows.

Rows: null text counts as empty. Of equal texts the row with most characters in
the original text, then the smallest doc_id (null last), stays. Repeats of a row
(same id, same text) count in the group's size and are all marked kept if one is;
``keep_unique`` returns one of them. Further columns pass through. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcast.llm.common import id_key, keep_rows, materialize

SLOTS, MOVES = 4, 200
#: Digests that a task's own index holds before it passes its records on.
LOCAL_DIGESTS = 200_000
#: Rows for each shard of the index.
SHARD_ROWS = 200_000

RECORD = "digest string, n long, keep_len long, keep_id long"


def digest(text: Column) -> Column:
    """SHA-256 in lower-case hex of the text without ``[\\x20\\x09-\\x0D]``."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", ""), 256)


class CuckooIndex:
    """Live digests (64 hex digits) with a record each: [rows, length of the row that stays, its id]."""

    def __init__(self, buckets: int = 256):
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.n_buckets, self.size = buckets, 0
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.content: list[list | None] = [None] * (buckets * SLOTS)

    def _places(self, d: str) -> tuple[int, int, int]:
        """Fingerprint (never 0) and both buckets; either bucket follows from the other and the fingerprint."""
        mark = int(d[-4:], 16) or 1
        one = int(d[:15], 16) % self.n_buckets
        return mark, one, (mark * 0x5BD1E995 - one) % self.n_buckets

    def _slot(self, d: str) -> int | None:
        mark, *both = self._places(d)
        for b in both:
            for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.prints[slot] == mark and self.content[slot][0] == d:  # the fingerprint may be another digest's
                    return slot
        return None

    def get(self, d: str) -> list | None:
        """[digest, rows, length, id] of a live digest."""
        slot = self._slot(d)
        return None if slot is None else self.content[slot]

    def add(self, d: str, n: int, length: int, doc_id: int | None) -> None:
        """Insert ``n`` rows of a digest, of which the one given comes first."""
        held = self.get(d)
        if held is None:
            self._put([d, n, length, doc_id])
            return
        held[1] += n
        if (-length, doc_id is None, doc_id or 0) < (-held[2], held[3] is None, held[3] or 0):
            held[2:] = [length, doc_id]

    def delete(self, d: str) -> bool:
        """Remove a digest; whether it was live."""
        slot = self._slot(d)
        if slot is None:
            return False
        self.prints[slot], self.content[slot] = 0, None
        self.size -= 1
        return True

    def _put(self, entry: list) -> None:
        for turn in range(MOVES):
            mark, one, other = self._places(entry[0])
            for b in (one, other):
                for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.content[slot] = mark, entry
                        self.size += 1
                        return
            # Both buckets are full: take a slot, and place what it held.
            slot = (one, other)[turn % 2] * SLOTS + (turn * 7 + mark) % SLOTS
            entry, self.content[slot] = self.content[slot], entry
            self.prints[slot] = mark
        self._grow(entry)

    def _grow(self, homeless: list) -> None:
        stored = [*self.entries(), homeless]
        self._empty(2 * self.n_buckets)
        for entry in stored:
            self._put(entry)

    def entries(self) -> Iterator[list]:
        return (e for e in self.content if e is not None)


def _table(index: CuckooIndex) -> pa.RecordBatch:
    rows = list(index.entries())
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["digest", "n", "keep_len", "keep_id"])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of a task's rows, each digest once for every ``LOCAL_DIGESTS`` digests."""
    index = CuckooIndex()
    for batch in batches:
        for d, n, length, doc_id in zip(*(batch.column(c).to_pylist() for c in ("digest", "n", "keep_len", "keep_id")), strict=True):
            index.add(d, n, length, doc_id)
            if index.size >= LOCAL_DIGESTS:
                yield _table(index)
                index = CuckooIndex()
    yield _table(index)


def records(docs: DataFrame) -> DataFrame:
    """A record for each row of ``docs`` (doc_id, text)."""
    return docs.select(digest(F.col("text")).alias("digest"), F.lit(1).cast("long").alias("n"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("keep_len"), F.col("doc_id").cast("long").alias("keep_id"))


def update(index: DataFrame | None, inserts: DataFrame, deletes: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """The index (``RECORD``, a row per live digest) after removing the digests of ``deletes`` and inserting the records of ``inserts``.

    ``rows`` is a bound of the rows that the shards are to hold, by default counted.
    """
    held = inserts if index is None else index.unionByName(inserts)
    shards = max(1, math.ceil((held.count() if rows is None else rows) / SHARD_ROWS))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")
    marked = inserts.select("digest", "n", "keep_len", "keep_id").mapInArrow(_local, RECORD).withColumn("act", F.lit(2))
    if index is not None:
        marked = index.select("digest", "n", "keep_len", "keep_id").withColumn("act", F.lit(0)).unionByName(marked)
    if deletes is not None:
        gone = deletes.select("digest").distinct().select("digest", *[F.lit(0).cast("long").alias(c) for c in ("n", "keep_len", "keep_id")], F.lit(1).alias("act"))
        marked = marked.unionByName(gone)

    def run(table: pa.Table) -> pa.Table:
        index = CuckooIndex(max(256, table.num_rows // 3))
        for act in (0, 1, 2):
            part = table.filter(pc.equal(table.column("act"), act))
            for d, n, length, doc_id in zip(*(part.column(c).to_pylist() for c in ("digest", "n", "keep_len", "keep_id")), strict=True):
                index.delete(d) if act == 1 else index.add(d, n, length, doc_id)
        return pa.Table.from_batches([_table(index)])

    return marked.withColumn("shard", shard).groupBy("shard").applyInArrow(run, RECORD)


def groups(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    slim = materialize(records(docs))
    index = update(None, slim).select(F.col("digest").alias("i_digest"), F.col("n").alias("group_size"), F.col("keep_len").alias("i_len"), F.col("keep_id").alias("i_id"))
    out = slim.join(index, slim["digest"] == index["i_digest"])
    kept = slim["keep_id"].eqNullSafe(F.col("i_id")) & (slim["keep_len"] == F.col("i_len"))
    return out.select(slim["keep_id"].alias("doc_id"), F.col("i_id").alias("keep_id"), "group_size", kept.alias("kept"), slim["digest"].alias("text_sha256"))


def keep_unique(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each text, all columns."""
    index = update(None, materialize(records(docs)))
    kept = index.select(*[c.alias(k) for k, c in id_key(F.col("keep_id")).items()], "digest", F.col("keep_len").alias("len"))
    return keep_rows(docs, kept, id_key(F.col("doc_id").cast("long")) | {"digest": digest(F.col("text")), "len": F.coalesce(F.char_length("text"), F.lit(0)).cast("long")})

"""Near-duplicates by SimHash, exact within a bit distance.

Method (pigeonhole blocks). A fingerprint has bit i set if it is set in over
half of the XXH64 hashes of the text's word shingles. The 64 bits are split into
``distance + 2`` blocks; two fingerprints that differ in at most ``distance`` bits
agree in two blocks at least, so every pair of blocks is a bucket key (10 keys
of 25 or 26 bits for distance 3). Fingerprints that share a bucket are compared
by Hamming distance; those within it are links, and documents linked directly
or through others are one group.

Scale: the nodes are distinct fingerprints, so copies of a text are one node.
Buckets of one fingerprint are dropped. A bucket of more than ``BUCKET``
fingerprints is cut into chunks, and every two chunks are compared in a task
of their own: all pairs are compared, none is made a row. A comparison passes on
a spanning forest of its links (at most one per fingerprint). Components are
found by star operations on the links (``graph``).

Rows: null and empty texts have fingerprint 0 and link like others; a group's
``component_id`` is its smallest doc_id (null only if it has none); repeated rows
are in the same group; further columns pass through; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.llm.common import ascii_words, id_key, keep_rows, materialize, text_pieces, text_slices
from shopcast.llm.graph import components

SHINGLE, DISTANCE = 3, 3
#: Fingerprints compared in one go.
BUCKET = 2048


def _shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the text's shingles, about a million characters at a time; of fewer words, of all of them together."""
    h64, carry, whole = xxhash.xxh64_intdigest, [], True
    for piece in text_pieces(text):
        words = carry + ascii_words(piece)
        if len(words) < shingle:
            carry = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(begins.tolist(), ends[shingle - 1:].tolist(), strict=False)
        yield np.fromiter((h64(joined[b:e], 42) for b, e in spans), np.uint64, len(words) - shingle + 1)
        carry, whole = words[len(words) - shingle + 1:], False
    if whole and carry:
        yield np.array([h64(b" ".join(carry), 42)], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in _shingle_hashes(text, shingle):
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at:at + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(part)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > total)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (64 bits as a long) and text_hash, which tells rows of one doc_id apart."""

    def run(batches):
        for b in text_slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _forest(a: np.ndarray, b: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Links that connect what pairs within ``distance`` connect, among ``a`` or between ``a`` and ``b``."""
    nodes = a if b is None else np.concatenate([a, b])
    bits = nodes.view(np.uint64)  # of a negative number, bitwise_count would count the absolute value's
    label = np.arange(len(nodes))
    found = []
    for i in range(len(a)):
        first = i + 1 if b is None else len(a)
        near = np.flatnonzero(np.bitwise_count(bits[first:] ^ bits[i]) <= distance) + first
        while len(apart := near[label[near] != label[i]]):
            j = apart[0]
            found.append((int(a[i]), int(nodes[j])))
            label[label == label[j]] = label[i]
    return found


def bucket_keys(fp, distance: int = DISTANCE) -> list:
    """A key column for each two of the blocks: which two, and their bits."""
    n = max(3, distance + 2)
    cuts = [round(64 * i / n) for i in range(n + 1)]
    blocks = [F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(n)]
    return [F.shiftleft(F.lit(k).cast("long"), 48).bitwiseOR(F.shiftleft(blocks[i], 24)).bitwiseOR(blocks[j]) for k, (i, j) in enumerate(combinations(range(n), 2))]


def links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints ``fp`` as all pairs within ``distance`` do."""
    rows = fps.select("fp", F.explode(F.array(*bucket_keys(F.col("fp"), distance))).alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(sizes, "key").withColumn("chunks", F.ceil(F.col("n") / bucket).cast("int"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("fp", "key"), F.col("chunks")).cast("int"))
    # Each row goes to the comparisons of its chunk with every chunk of the bucket, its own included.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cell = rows.select("fp", "key", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), (F.col("chunk") > F.col("other")).alias("second"))
    cells = cell.groupBy("key", "one", "two").agg(F.collect_list(F.when(~F.col("second"), F.col("fp"))).alias("a"), F.collect_list(F.when(F.col("second"), F.col("fp"))).alias("b"))

    def run(batches):
        for batch in text_slices(batches, 4096):
            out = []
            for a, b, one, two in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "one", "two")), strict=True):
                if one == two and len(a) == 2:
                    if ((a[0] ^ a[1]) & (2**64 - 1)).bit_count() <= distance:
                        out.append((a[0], a[1]))
                elif one == two or (a and b):
                    out += _forest(np.array(a, np.int64), None if one == two else np.array(b, np.int64), distance)
            u, v = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return cells.select("a", "b", "one", "two").mapInArrow(run, "u long, v long")


def _components(slim: DataFrame, distance: int) -> DataFrame:
    """Per fingerprint of ``slim``: fp, component_id and the (doc_id, text_hash) of the component's first row."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    nodes = materialize(slim.groupBy("fp").agg(first))
    labels = components(links(nodes, distance))
    labelled = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    firsts = labelled.groupBy("label").agg(F.min("first").alias("first"))
    return labelled.select("fp", "label").join(firsts, "label").select("fp", F.col("first.doc_id").alias("component_id"), "first")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id."""
    slim = materialize(fingerprints(docs, shingle))
    groups = _components(slim, distance).select(F.col("fp").alias("c_fp"), "component_id")
    out = slim.join(groups, slim["fp"] == groups["c_fp"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The row with the smallest doc_id (null last) of each group, all columns of ``docs``."""
    firsts = _components(materialize(fingerprints(docs, shingle)), distance).select("first").distinct()
    kept = firsts.select(*[c.alias(k) for k, c in id_key(F.col("first.doc_id")).items()], F.col("first.text_hash").alias("text"))
    return keep_rows(docs, kept, id_key(F.col("doc_id").cast("long")) | {"text": F.xxhash64("text")})

"""Source divergence audit: how the words of one source differ from another's and from their language's.

Per language, terms in at least ``MIN_DOCS`` of its documents are kept. A group is a
(language, source); p of a group or a language for a term is its smoothed relative count in
parts of 10**9, in exact integers. Pairs of groups are compared by the sum of abs(p - q)
over all kept terms, a group with its language by the terms it uses more.

Method (K²-tree of the group-term count matrix). A language's matrix, a row per
group and a column per kept term, is cut into tiles: ``COLUMNS`` terms by two bands of
``ROWS`` groups, and each tile becomes a K²-tree with k = 2: per level the quadrants
that hold a count. All pairs of groups descend the tree jointly. Where a column range is empty for
two ranges of groups, every pair of them has the same difference in each of
its columns, so the number of columns is noted once for the range pair and priced
for its pairs at the end; only where one side has a count the descent goes on, down to
single cells. Rows of a language's totals are paired with its groups at the cells of
the groups.

Scale: a task counts its documents' words and passes on one row per (language, source,
term) it met, at most ``HELD`` characters of terms at a time; counts are added up by key, so a source with a third
of all rows costs each task one more row per term. A tile holds at most 2 * ROWS * COLUMNS cells; pairs of
ranges on the way down are taken ``BATCH`` at a time. A tile passes on its groups' pairs
and at most ``TOP`` terms a group. Nothing is broadcast by this module, and nothing reaches the driver but the
number of kept terms.

Rows: null texts, languages and sources are empty strings; repeated rows are
documents of their own; a group without terms is compared like any other; a language without kept terms
has the value 0 for every pair and no terms. Further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shopcast.llm.common import materialize, text_pieces, text_slices

MIN_DOCS, TOP = 30, 50
UNIT, PRIOR = 1_000_000_000, 5
ROWS, COLUMNS, BATCH = 512, 4096, 1 << 18
#: Characters of distinct terms that a task holds before it passes its counts on.
HELD = 1 << 25
#: Letters A-Z to a-z, other bytes of terms to themselves, all else to a space. Bytes from 0x80 on belong to characters beyond ASCII.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"


def terms(text: str) -> list[bytes]:
    """Terms of a text in UTF-8: runs of letters A-Z (lower-cased), a-z and characters beyond ASCII."""
    return text.encode().translate(_LETTERS).split()


def term_counts(docs: DataFrame, most: int = HELD) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it) over ``docs`` (text, lang, source); each group also has a row of the empty term."""

    def run(batches):
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for b in text_slices(batches):
            for text, lang, source in zip(*(b.column(c).to_pylist() for c in ("text", "lang", "source")), strict=True):
                n, with_it = counts.setdefault((lang, source), (Counter(), Counter()))
                mine: set[bytes] = set()
                for piece in text_pieces(text):
                    found = terms(piece)
                    n.update(found)
                    mine.update(found)
                before = len(with_it)
                with_it.update(mine)
                held += 16 * (len(with_it) - before) + (len(text) if len(text) > 1 << 16 else 0)
            if held > most:
                yield from passed_on(counts)
                counts, held = {}, 0
        yield from passed_on(counts)

    def passed_on(counts):
        for (lang, source), (n, with_it) in counts.items():
            found = list(n)
            for at in range(0, len(found) + 1, 1 << 16):
                part = found[at:at + (1 << 16)]
                names = [w.decode() for w in part] + ([""] if not at else [])
                rows = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * rows), pa.array([source] * rows), pa.array(names, pa.string()), pa.array([n[w] for w in part] + [0] * (rows - len(part)), pa.int64()),
                     pa.array([with_it[w] for w in part] + [0] * (rows - len(part)), pa.int64())], ["lang", "source", "term", "n", "docs"])

    slim = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return slim.mapInArrow(run, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: np.ndarray, kept: int, unit: int = UNIT, prior: int = PRIOR) -> np.ndarray:
    """1 + floor(unit * (count + prior) / (total + prior * kept)), exactly."""
    if count.size and int(count.max()) >= 2**63 // unit - prior:
        count, total = count.astype(object), total.astype(object)
    return (1 + unit * (count + prior) // (total + prior * kept)).astype(np.int64)


class Tree:
    """K²-tree (k = 2) over the cells (row, column) of a matrix: ``levels[l]`` marks the quadrants of side 2**l that hold a cell."""

    def __init__(self, row: np.ndarray, column: np.ndarray, rows: int, columns: int):
        self.rows, self.columns = rows, columns
        self.height = max(rows - 1, columns - 1, 0).bit_length()
        self.levels = []
        for level in range(self.height + 1):
            marks = np.zeros((((rows - 1) >> level) + 1, ((columns - 1) >> level) + 1), bool)
            marks[row >> level, column >> level] = True
            self.levels.append(marks)

    def width(self, column: np.ndarray, level: int) -> np.ndarray:
        """Columns of the matrix in the quadrants ``column`` of a level."""
        return np.minimum((column + 1) << level, self.columns) - (column << level)

    def descend(self, batch: int = BATCH):
        """All pairs of rows a < b, jointly: ("empty", level, a, b, columns) for pairs of row ranges that have no cell in so many columns, and
        ("cells", 0, a, b, column) for single cells of which at least one is marked."""
        zero = np.zeros(1, np.int64)
        stack = [(self.height, zero, zero, zero)]
        while stack:
            level, a, b, c = stack.pop()
            if len(a) > batch:
                stack += [(level, a[i:i + batch], b[i:i + batch], c[i:i + batch]) for i in range(0, len(a), batch)]
                continue
            marks = self.levels[level]
            some = marks[a, c] | marks[b, c]
            if not some.all():
                yield "empty", level, a[~some], b[~some], self.width(c[~some], level)
                a, b, c = a[some], b[some], c[some]
            if not len(a):
                continue
            if not level:
                pairs = a < b
                yield "cells", 0, a[pairs], b[pairs], c[pairs]
                continue
            below = self.levels[level - 1].shape
            parts = [(2 * a + i, 2 * b + j, 2 * c + k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
            a, b, c = (np.concatenate([p[x] for p in parts]) for x in range(3))
            inside = (a <= b) & (b < below[0]) & (c < below[1])
            stack.append((level - 1, a[inside], b[inside], c[inside]))


def pair_values(tree: Tree, row: np.ndarray, column: np.ndarray, p: np.ndarray, floor: np.ndarray, batch: int = BATCH) -> np.ndarray:
    """Per pair of rows a < b the sum of abs(p - q) over all columns. ``p``: of the cells (row, column); ``floor``: p of a row where it has no cell."""
    n = tree.rows
    value = np.zeros(n * n, np.int64)
    empty = [np.zeros((m.shape[0], m.shape[0]), np.int64) for m in tree.levels]
    # Cells by place, to read p of a cell that may be empty.
    place = row * tree.columns + column
    order = np.argsort(place)
    place, p = place[order], p[order]

    def read(r, c):
        at = np.searchsorted(place, r * tree.columns + c)
        at[at == len(place)] = 0
        return np.where(place[at] == r * tree.columns + c, p[at], floor[r])

    for kind, level, a, b, c in tree.descend(batch):
        if kind == "empty":
            np.add.at(empty[level], (a, b), c)
        else:
            np.add.at(value, a * n + b, abs(read(a, c) - read(b, c)))
    # What was noted for ranges of rows holds for their halves: down to single rows, then priced.
    for level in range(tree.height, 0, -1):
        size = empty[level - 1].shape[0]
        empty[level - 1] += empty[level].repeat(2, axis=0).repeat(2, axis=1)[:size, :size]
    return value.reshape(n, n) + empty[0] * abs(floor[:, None] - floor[None, :])


def _tile(table: pa.Table) -> pa.Table:
    """Pairs and leading terms of one tile: its rows are the groups of its bands (no term) and their cells."""
    names = ["lang", "source", "part", "item", "value"]
    schema = pa.schema([pa.field(n, pa.int64() if n == "value" else pa.string()) for n in names])
    heads = table.filter(pc.is_null(table.column("term")))
    cells = table.filter(pc.is_valid(table.column("term")))
    order = np.lexsort([heads.column("band").to_numpy()])
    sources, bands = [heads.column("source").to_pylist()[i] for i in order], heads.column("band").to_numpy()[order]
    sizes, kept = heads.column("size").to_numpy()[order], heads.column("kept")[0].as_py()
    lang, left, right = (heads.column(c)[0].as_py() for c in ("lang", "left", "right"))
    place = {s: i for i, s in enumerate(sources)}
    row = np.array([place[s] for s in cells.column("source").to_pylist()], np.int64)
    found = cells.column("term").to_pylist()
    used = Counter(found)
    columns = {t: i for i, t in enumerate(sorted(used, key=lambda t: (-used[t], t.encode())))}  # widespread terms first, so that empty cells lie together
    column = np.array([columns[t] for t in found], np.int64)
    n = cells.column("n").to_numpy()
    p = share(n, sizes[row], kept) if len(n) else n
    floor = share(np.zeros(len(sizes), np.int64), sizes, kept) if kept else np.zeros(len(sizes), np.int64)
    value = np.zeros((len(sources),) * 2, np.int64)
    width = heads.column("width")[0].as_py()  # kept terms of the slice, also those of other bands' groups only
    if width:
        value = pair_values(Tree(row, column, len(sources), width), row, column, p, floor)
    a, b = np.triu_indices(len(sources), 1)
    if left != right:
        across = bands[a] != bands[b]
        a, b = a[across], b[across]
    out = [pa.table([pa.array([lang] * len(a), pa.string()), pa.array([sources[i] for i in a], pa.string()), pa.array(["pair"] * len(a), pa.string()),
                     pa.array([sources[i] for i in b], pa.string()), pa.array(value[a, b], pa.int64())], schema=schema)]
    if left == right and len(n):
        whole, lang_size = cells.column("whole").to_numpy(), cells.column("lang_size").to_numpy()
        lead = p - share(whole, lang_size, kept)
        utf8 = [t.encode() for t in found]
        best: dict[int, list] = {}
        for i in np.flatnonzero(lead > 0).tolist():
            best.setdefault(int(row[i]), []).append((-int(lead[i]), utf8[i]))
        top = [(sources[r], t.decode(), -v) for r, g in best.items() for v, t in sorted(g)[:TOP]]
        out.append(pa.table([pa.array([lang] * len(top), pa.string()), pa.array([t[0] for t in top], pa.string()), pa.array(["term"] * len(top), pa.string()),
                             pa.array([t[1] for t in top], pa.string()), pa.array([t[2] for t in top], pa.int64())], schema=schema))
    return pa.concat_tables(out)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (text, lang, source); see the contract of the parts above. Runs jobs as it is called."""
    if top > TOP:
        raise ValueError(f"at most {TOP} terms a group")
    counts = materialize(term_counts(docs))
    by_term = (counts.where(F.col("term") != "").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole"))
               .where(F.col("docs") >= min_docs).select("lang", "term", "whole"))
    by_term = materialize(by_term)
    cells = materialize(counts.join(by_term, ["lang", "term"]).select("lang", "source", "term", "n", "whole"))
    kept = by_term.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("whole").alias("lang_size"))
    size = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = (counts.where(F.col("term") == "").select("lang", "source").join(size, ["lang", "source"], "left").join(kept, "lang", "left")
              .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "kept", "lang_size")])
              .withColumn("i", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
              .withColumn("band", F.floor(F.col("i") / rows).cast("int"))
              .withColumn("bands", F.max("band").over(W.partitionBy("lang")) + 1)
              .withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("kept") / columns)).cast("int")))
    groups = materialize(groups.select("lang", "source", "size", "kept", "lang_size", "band", "bands", "slices"))
    in_slice = F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice")
    widths = by_term.join(groups.select("lang", "slices").distinct(), "lang").groupBy("lang", in_slice).agg(F.count(F.lit(1)).alias("width"))
    # A band meets itself and every other band of its language.
    met = F.explode(F.sequence(F.lit(0), F.col("bands") - 1))
    heads = (groups.select("*", met.alias("other")).select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
             .join(widths, ["lang", "slice"], "left")
             .withColumns({"term": F.lit(None).cast("string"), "n": F.lit(0).cast("long"), "whole": F.lit(0).cast("long"), "width": F.coalesce("width", F.lit(0)).cast("long")}))
    body = cells.join(groups, ["lang", "source"]).select("*", met.alias("other")).select("*", in_slice, F.lit(0).cast("long").alias("width"))
    cols = ["lang", "source", "band", "slice", "term", "n", "whole", "size", "kept", "lang_size", "width"]
    sides = [F.least("band", "other").alias("left"), F.greatest("band", "other").alias("right")]
    tiles = heads.select(*cols, *sides).unionByName(body.select(*cols, *sides)).groupBy("lang", "left", "right", "slice")
    found = materialize(tiles.applyInArrow(_tile, "lang string, source string, part string, item string, value long"))  # once for both parts
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("source"), F.col("item")), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("e")
    pairs = pairs.select("lang", both, "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    lead = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = pairs.withColumn("rank", F.row_number().over(order)).unionByName(lead)
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))

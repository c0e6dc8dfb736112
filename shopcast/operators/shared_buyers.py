"""Products of the users who share a purchase with a user, counted block by block.

For a user u the count of a product p is the sum of ``lines(v, p)`` over all users v who own
a product that u owns: a boolean product (who shares with whom) times the purchases. Through a
product with b buyers there are b² pairs, so products are split by their buyers:

* light ones (at most ``hot`` buyers) pair their buyers as rows, at most ``hot`` per purchase;
* a user's hot products are bits of packed words, 64 products to a word, words without a bit left out.
  Users with the same words are one pattern with summed lines. Patterns travel to the blocks
  of users as packed rows, and a task finds by a bitwise and which of its users' patterns meet
  which, so no pair of buyers of a hot product is ever a row, however many hot products there are.

A pair that meets in a hot product is left out of the light pairs, so nobody counts twice.
A user's own lines are only on own products, which are never listed.

Users without a hot product, as a rule nearly all, need neither patterns nor pairs as rows: a user's purchases
travel once to each block where somebody shares a product with the user, many users as one compressed value, and the task finds there who
shares with whom. The blocks are few and large; where the copies are many nevertheless, blocks run in waves, and the disk holds those of one wave.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.functions.expr import global_rank
from shopcast.operators import blocked as bl
from shopcast.session import compact, materialize

BLOCK, WIDTH, TERMS = 1024, 16_384, 1 << 21
#: Blocks of the users without hot products: at least so many, and more for more users or pairs of buyers of a product to a block than these.
BLOCKS, USERS, PAIRS = 32, 1 << 16, 1 << 23


def shared_buyer_counts(buy: DataFrame, mine: DataFrame, products: DataFrame, limit: int, hot: int, least: float = 0, block: int = BLOCK, width: int = WIDTH,
                        info: DataFrame | None = None) -> DataFrame:
    """``user_id, product_id, n``: per user the ``limit`` products with the largest count times ``factor``, at least ``least``; ties by id.

    With ``info`` (``product_id`` and others) also its other columns, as by a join. ``buy``: ``user_id, product_id, lines`` of all users (one row per pair, no nulls); ``mine``: those of the requested users;
    ``products``: ``product_id, factor`` of the products that may be listed. All are read several times: pass written frames.
    """
    tasks = 2 * buy.sparkSession.sparkContext.defaultParallelism
    bits = materialize(hot_bits(buy, hot))
    cool = materialize(mine.join(bits.select("user_id"), "user_id", "left_anti"))
    users = cool.select("user_id").distinct().count()
    out = [] if not users else [_cool_counts(buy, cool, users, products, limit, least, tasks, info)]
    if not out or not bits.isEmpty():
        found = _hot_counts(buy, mine.join(bits.select("user_id"), "user_id", "left_semi"), bits, products, limit, hot, least, block, width, tasks)
        out.append(found if info is None else found.join(info, "product_id").select("user_id", "product_id", "n", *[c for c in info.columns if c != "product_id"]))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _cool_counts(buy: DataFrame, mine: DataFrame, users: int, products: DataFrame, limit: int, least: float, tasks: int, info: DataFrame | None) -> DataFrame:
    """The counts of the ``users`` of ``mine``, who have no hot product: nobody shares one with them, and every product they own has few buyers."""
    asked = mine.groupBy("product_id").agg(F.count(F.lit(1)).alias("asked"))
    pairs = asked.join(buy.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")), "product_id").agg(F.sum(F.col("asked") * F.col("n"))).first()[0] or 0
    grid = bl.Grid(max(min(max(BLOCKS, tasks), math.ceil(users / 64)), math.ceil(users / USERS), math.ceil(pairs / PAIRS)), 1)
    # Products by number in order of their ids, so that ties go by number, too. Those that may not be listed have the factor 0.
    listed = products.groupBy("product_id").agg(F.max("factor").alias("factor"))
    numbers = materialize(global_rank(buy.select("product_id").distinct(), [F.col("product_id")], "nr").join(listed, "product_id", "left")
                          .select("product_id", "nr", F.coalesce("factor", F.lit(0)).alias("factor")))
    where = mine.groupBy("product_id").agg(F.collect_set(grid.block("user_id")).alias("blocks"))
    # Whoever is asked for shares the own products, so the row of a user of the block is among those sent there.
    whole = compact(buy.join(numbers, "product_id").join(where, "product_id", "left").groupBy("user_id")
                    .agg(F.collect_list(F.struct("nr", (F.col("lines") * F.col("factor")).alias("value"))).alias("c"), F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))
                    .join(mine.select("user_id").distinct().withColumn("asked", F.lit(True)), "user_id", "left")
                    .select("user_id", "c.nr", "c.value", "blocks", F.when(F.col("asked"), grid.block("user_id")).otherwise(-1).alias("home")))
    entries, copies = whole.agg(F.coalesce(F.sum(F.size("nr")), F.lit(0)), F.coalesce(F.sum(F.size("nr") * F.size("blocks")), F.lit(0))).first()

    def found(wave: tuple[int, int]) -> DataFrame:
        dealt = whole.mapInArrow(_to_blocks(*wave), "user_id long, block int, blob binary")
        rows = grid.rows(dealt, bl.ROWS, block=F.col("block"), slot=F.lit(0), key=F.col("user_id"), blob=F.col("blob"))
        return grid.run(rows, lambda runs: _shared(runs, limit, least), limit, ordered=False, wave=wave)

    best = compact(*[found(wave) for wave in bl.waves(grid.blocks, copies, entries, tasks)])
    about = numbers.select("nr", "product_id")
    about = about if info is None else about.join(info, "product_id")
    return bl.attach(best, about, "nr", "n").select("user_id", "product_id", F.col("n").cast("long").alias("n"), *[c for c in about.columns if c not in ("nr", "product_id")])


def _to_blocks(low: int, high: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Users' purchases once to each of their blocks low <= block < high: :func:`blocked.pack` of users, whether they are asked for there, numbers of products, these, and their values; by the first user."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            users, (nr, n), (blocks, many) = b.column("user_id").to_numpy(), bl.flat(b.column("nr")), bl.flat(b.column("blocks"))
            value, home, first = bl.flat(b.column("value"))[0], b.column("home").to_numpy(), bl.starts(n)
            row = np.repeat(np.arange(len(n)), many)
            order = np.argsort(blocks, kind="stable")
            order = order[(blocks[order] >= low) & (blocks[order] < high)]
            out = []
            for rows in np.split(row[order], np.flatnonzero(np.diff(blocks[order])) + 1) if len(order) else []:
                block = int(blocks[order[sum(len(x[2]) for x in out)]])
                at, _ = bl.spans(first[rows], n[rows])
                out.append((int(users[rows[0]]), block, rows, bl.pack(users[rows], home[rows] == block, bl.narrow(n[rows]), nr[at].astype(np.int32), bl.narrow(value[at]))))
            if out:
                key, block, _, blob = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(block, pa.int32()), pa.array(blob, pa.binary())], ["user_id", "block", "blob"])

    return deal


def _shared(runs: Iterator[tuple], limit: int, least: float) -> Iterator[tuple]:
    """Best products of one block of users from the purchases of all who share a product with them, in any order."""
    parts = [bl.unpack(blob.as_py()) for _, _, rows in runs for blob in rows.column("blob")]
    if not parts:
        return
    key, asked, size, ids, lines = (np.concatenate(x) for x in zip(*parts, strict=True))
    size = size.astype(np.int64)
    del parts
    first, width = bl.starts(size), int(ids.max()) + 1
    users = np.flatnonzero(asked)
    users = users[np.argsort(key[users])]
    at, owner = bl.spans(first[users], size[users])
    # Own products of the block's users, by product.
    by_product = np.argsort(ids[at], kind="stable")
    product, user = ids[at][by_product], owner[by_product].astype(np.int32)
    own = np.sort(owner * width + ids[at])
    one, other = [], []
    low = 0
    while low < len(key):  # a part of the rows at a time
        high = min(len(key), max(low + 1, int(np.searchsorted(first, first[low] + TERMS, side="right")) - 1))
        part = ids[first[low]:first[high]]
        begin = np.searchsorted(product, part)
        held = np.searchsorted(product, part, side="right") - begin
        where, entry = bl.spans(begin, held)
        pair = np.unique(user[where].astype(np.int64) * len(key) + (low + np.repeat(np.arange(high - low), size[low:high]))[entry])
        u, v = np.divmod(pair, len(key))
        apart = users[u] != v
        one.append(u[apart].astype(np.int32))
        other.append(v[apart].astype(np.int32))
        low = high
    one, other = np.concatenate(one), np.concatenate(other)
    order = np.argsort(one, kind="stable")
    one, other = one[order], other[order]
    del order
    best = bl.Best(len(users), limit)
    edge = np.searchsorted(one, np.arange(len(users) + 1))
    terms = bl.starts(size[other])
    load = terms[edge]
    low = 0
    while low < len(users):  # users with about TERMS terms at a time; a user with more is summed up part by part
        high = max(low + 1, int(np.searchsorted(load, load[low] + TERMS, side="right")) - 1)
        sums = _Sums()
        a, end = int(edge[low]), int(edge[high])
        while a < end:
            b = min(end, max(a + 1, int(np.searchsorted(terms, terms[a] + TERMS, side="right")) - 1))
            where, pair = bl.spans(first[other[a:b]], size[other[a:b]])
            sums.add(one[a:b].astype(np.int64)[pair] * width + ids[where], lines[where].astype(float))
            a = b
        cell, value = sums.total()
        mine = own[np.searchsorted(own, low * width):np.searchsorted(own, high * width)]
        keep = ~bl.find(mine, cell)[1] & (value >= least) & (value > 0)
        u, nr = np.divmod(cell[keep], width)
        best.add(low, high, u, nr, value[keep])
        low = high
    yield best.packed(key[users])


def _hot_counts(buy: DataFrame, mine: DataFrame, bits: DataFrame, products: DataFrame, limit: int, hot: int, least: float, block: int, width: int, tasks: int) -> DataFrame:
    """The counts of the users of ``mine``, who have hot products."""
    grid = bl.Grid.of(mine.select("user_id").distinct().count(), block, products.count(), width, tasks)
    lists = (mine.groupBy("user_id").agg(F.collect_list("product_id").alias("own"), F.first(grid.block("user_id")).alias("block"))
             .join(bits, "user_id", "left"))
    columns = products.groupBy(grid.slot("product_id").alias("slot")).agg(F.collect_list(F.struct("product_id", "factor")).alias("c"))
    # Purchases of each pattern, and of each user, as one packed row per slot of products.
    patterns = (buy.join(bits, "user_id").groupBy("words", "product_id").agg(F.sum("lines").alias("lines"))
                .groupBy("words", grid.slot("product_id").alias("slot")).agg(F.collect_list(F.struct("product_id", "lines")).alias("c")))
    whole = buy.groupBy("user_id", grid.slot("product_id").alias("slot")).agg(F.collect_list(F.struct("product_id", "lines")).alias("c"))
    light = buy.join(hot_products(buy, hot), "product_id", "left_anti").select("product_id", F.col("user_id").alias("other"))
    pairs = (mine.select("product_id", "user_id", grid.block("user_id").alias("block")).join(light, "product_id").where(F.col("other") != F.col("user_id"))
             .groupBy("block", "other").agg(F.collect_set("user_id").alias("users")))
    met = (pairs.join(whole.withColumnRenamed("user_id", "other"), "other").join(bits.withColumnRenamed("user_id", "other"), "other", "left"))
    parts = {"ids": F.col("c.product_id"), "vals": F.col("c.lines")}
    rows = (grid.rows(lists, bl.USERS, block=F.col("block"), key=F.col("user_id"), ids=F.col("own"), bits=F.coalesce("words", F.array().cast("array<long>")))
            .unionByName(grid.rows(columns, bl.COLUMNS, slot=F.col("slot"), ids=F.col("c.product_id"), vals=F.col("c.factor")))
            .unionByName(grid.rows(patterns, bl.ROWS, slot=F.col("slot"), bits=F.col("words"), **parts))
            .unionByName(grid.rows(met, bl.MORE, block=F.col("block"), slot=F.col("slot"), more=F.col("users"),
                                   bits=F.coalesce("words", F.array().cast("array<long>")), **parts)))
    found = grid.run(rows, lambda runs: _counts(runs, limit, least), limit)
    return found.select("user_id", F.col("column").alias("product_id"), F.col("value").cast("long").alias("n"))


def hot_products(buy: DataFrame, hot: int) -> DataFrame:
    """``product_id`` of the products with more than ``hot`` buyers."""
    return buy.groupBy("product_id").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot).select("product_id")


def hot_bits(buy: DataFrame, hot: int) -> DataFrame:
    """``user_id, words``: hot products of each user who has any; words come as place, word, place, word, ..."""
    ranked = global_rank(hot_products(buy, hot), [F.col("product_id")], "nr")
    bit = F.expr("shiftleft(1L, cast((nr - 1) % 64 as int))")
    words = (buy.join(ranked, "product_id").groupBy("user_id", F.floor((F.col("nr") - 1) / 64).alias("place")).agg(F.bit_or(bit).alias("word"))
             .groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("w")))
    return words.select("user_id", F.flatten(F.transform("w", lambda w: F.array(w["place"], w["word"]))).alias("words"))


class _Patterns:
    """Distinct bit patterns, by place: which patterns have a word there, and the words."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        at = bl.starts(lengths)
        numbers: dict[bytes, int] = {}
        #: Number of each row's pattern, -1 without a bit.
        self.of = np.array([numbers.setdefault(words[a:b].tobytes(), len(numbers)) if b > a else -1 for a, b in zip(at, at[1:], strict=False)], np.int64)
        self.n = len(numbers)
        flat = [np.frombuffer(k, np.int64) for k in numbers]
        owner = np.repeat(np.arange(self.n), [len(f) // 2 for f in flat]) if flat else np.zeros(0, np.int64)
        joined = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        self._places = _by_place(joined[::2], joined[1::2], owner)

    def meet(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For every pattern and every row of ``words`` whether they have a bit in common."""
        out = np.zeros((self.n, len(lengths)), bool)
        owner = np.repeat(np.arange(len(lengths)), lengths // 2)
        for place, (other, word) in _by_place(words[::2], words[1::2], owner).items():
            if place in self._places:
                pattern, own = self._places[place]
                out[np.ix_(pattern, other)] |= (own[:, None] & word[None, :]) != 0
        return out


def _by_place(place: np.ndarray, word: np.ndarray, owner: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(place, kind="stable")
    edges = np.flatnonzero(np.diff(place[order])) + 1
    return {int(place[part[0]]): (owner[part], word[part]) for part in np.split(order, edges) if len(part)}


class _Sums:
    """Sums of many (cell, value) pairs, folded whenever many are held."""

    def __init__(self):
        self.cells, self.values, self.held = [], [], 0

    def add(self, cells: np.ndarray, values: np.ndarray) -> None:
        self.cells.append(cells)
        self.values.append(values)
        self.held += len(cells)
        if self.held > 4 * TERMS:
            cells, values = self.total()
            # What is left counts as new only beyond its own size, so that folding stays rare.
            self.cells, self.values, self.held = [cells], [values], min(len(cells), 2 * TERMS)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0)
        cells, of = bl.numbered(np.concatenate(self.cells))
        return cells, np.bincount(of, weights=np.concatenate(self.values))


def _counts(runs: Iterator[tuple], limit: int, least: float) -> Iterator[tuple]:
    """Best products of one block of users over one part of the products."""
    users: list = []
    state = None
    for at, tag, rows in runs:
        if tag == bl.USERS:
            users.append(rows)
            continue
        if state is None:
            state = _Block(users, limit, least)
        state.take(at, tag, rows)
    if state is not None and len(state.ids):
        state.close()
        yield state.best.packed(state.ids)


class _Block:
    def __init__(self, batches: list, limit: int, least: float):
        key = np.concatenate([b.column("key").to_numpy() for b in batches] or [np.zeros(0, np.int64)])
        own, words = ([np.concatenate(x) for x in zip(*(bl.flat(b.column(c)) for b in batches), strict=True)] or [np.zeros(0, np.int64)] * 2 for c in ("ids", "bits"))
        order = np.argsort(key)
        self.ids, self.limit, self.least = key[order], limit, least
        at, _ = bl.spans(bl.starts(own[1])[:-1][order], own[1][order])
        self.own, self.own_of = own[0][at], np.repeat(np.arange(len(order)), own[1][order])
        at, _ = bl.spans(bl.starts(words[1])[:-1][order], words[1][order])
        self.patterns = _Patterns(words[0][at], words[1][order])
        self.best, self.slice = bl.Best(len(key), limit), None

    def take(self, at: int, tag: int, rows) -> None:
        if at != self.slice:
            self.close()
            self.slice, self._columns, self._factors, self.cols = at, [], [], None
        ids, n = bl.flat(rows.column("ids"))
        vals = bl.flat(rows.column("vals"))[0]
        if tag == bl.COLUMNS:
            self._columns.append(ids)
            self._factors.append(vals)
            return
        if self.cols is None:
            self._open()
        col, there = bl.find(self.cols, ids)
        owner = np.repeat(np.arange(len(n)), n)[there]
        meet = self.patterns.meet(*bl.flat(rows.column("bits")))
        if tag == bl.ROWS:
            self._add_patterns(meet, owner, col[there], vals[there])
        else:
            self._add_pairs(meet, np.bincount(owner, minlength=len(n)), col[there], vals[there], *bl.flat(rows.column("more")))

    def _open(self) -> None:
        ids = np.concatenate(self._columns) if self._columns else np.zeros(0, np.int64)
        order = np.argsort(ids)
        self.cols = ids[order]
        self.factor = (np.concatenate(self._factors) if self._factors else np.zeros(0))[order]
        self.light, self.base = _Sums(), np.zeros((self.patterns.n, len(ids)))

    def _add_patterns(self, meet: np.ndarray, owner: np.ndarray, col: np.ndarray, lines: np.ndarray) -> None:
        """Lines of the rows' purchases to every pattern that meets the row's."""
        order = np.argsort(col, kind="stable")
        step = max(1, TERMS // max(1, self.patterns.n))
        for at in range(0, len(order) if self.patterns.n else 0, step):
            part = order[at:at + step]
            first = np.flatnonzero(np.concatenate([[True], np.diff(col[part]) != 0]))
            self.base[:, col[part][first]] += np.add.reduceat(meet[:, owner[part]] * lines[part], first, axis=1)

    def _add_pairs(self, meet: np.ndarray, n: np.ndarray, col: np.ndarray, lines: np.ndarray, users: np.ndarray, per_row: np.ndarray) -> None:
        """Lines of each row's purchases to the row's users, but for those who meet its pattern."""
        row = np.repeat(np.arange(len(per_row)), per_row)
        user, _ = bl.find(self.ids, users)
        if self.patterns.n:
            pattern = self.patterns.of[user]
            apart = (pattern < 0) | ~meet[pattern, row]
            row, user = row[apart], user[apart]
        first, terms = bl.starts(n), bl.starts(n[row])
        low = 0
        while low < len(row):
            high = max(low + 1, int(np.searchsorted(terms, terms[low] + TERMS, side="right")) - 1)
            at, pair = bl.spans(first[row[low:high]], n[row[low:high]])
            self.light.add(user[low:high][pair] * len(self.cols) + col[at], lines[at])
            low = high

    def close(self) -> None:
        """Candidates of the slice's columns."""
        if self.slice is None:
            return
        if self.cols is None:
            self._open()
        width = len(self.cols)
        if not width:
            return
        cell, value = self.light.total()
        col, there = bl.find(self.cols, self.own)
        own = np.unique((self.own_of * width + col)[there])
        extra = []
        if self.patterns.n:
            pattern = self.patterns.of[cell // width]
            value = value + np.where(pattern >= 0, self.base[pattern, cell % width], 0)
            number = np.bincount(own // width, minlength=len(self.ids))
            weighed = self.base * self.factor
            for p in range(self.patterns.n):
                listed = np.flatnonzero(weighed[p] > 0)
                listed = listed[np.argsort(-weighed[p][listed], kind="stable")]
                # A user's best products are among the first ``limit`` and as many as the user owns, or among the light cells.
                extra += [u * width + listed[:self.limit + number[u]] for u in np.flatnonzero(self.patterns.of == p).tolist()]
        if extra:
            more = np.concatenate(extra)
            more = more[~bl.find(cell, more)[1]]
            cell, value = np.concatenate([cell, more]), np.concatenate([value, self.base[self.patterns.of[more // width], more % width]])
            order = np.argsort(cell)
            cell, value = cell[order], value[order]
        value = value * self.factor[cell % width]
        keep = ~bl.find(own, cell)[1] & (value >= self.least) & (value > 0)
        user, col = np.divmod(cell[keep], width)
        self.best.add(0, len(self.ids), user, self.cols[col], value[keep])

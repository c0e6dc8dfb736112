"""Quality scores by supervised subword embeddings.

Method. A text's features are its words (between ASCII white space) and the character
n-grams (code points) of length 3 to 5 of each word with a blank before and after it, hashed
into ``BUCKETS`` rows of a learned embedding table; a word that is the one before it
again (within pieces of about a million characters, in which texts are read) has
row 0 as a further feature, whatever the word. The rows are averaged over the
text, and a softmax layer turns the average into a probability. Table and layer
are learned together by stochastic gradient descent in numpy.

Fitting uses at most ``FIT_ROWS`` labelled texts of each class, those whose ids
hash lowest, whole texts, one of each id; one task learns from their feature counts. The sample
is balanced, so the classes' counts over all labels given enter the softmax as
the prior. Scoring covers all rows and whole texts in one pass; as the average is
linear, a feature's share in the logit is one number of a table of ``BUCKETS``
floats, which is what the tasks get. No shuffle of texts.

Rows: null and empty texts get the score of the prior; an id with labels of both
kinds counts by majority (as often: not at all); labels other than 0 and 1 and
ids without a text are left out; with one class or none, scores are the prior's;
repeated rows are scored each; further columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcast.llm.common import text_pieces, text_slices
from shopcast.llm.hashing import Joined, by_size, segments

BUCKETS, DIM = 1 << 16, 8
FIT_ROWS = 1500
EPOCHS, RATE, SEED = 6, 4.0, 7

_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def features(texts: list[str | None]) -> tuple[Joined, list[tuple[np.ndarray, np.ndarray]]]:
    """The joined texts, and (bucket, byte where it begins) of the words and of the n-grams of each length."""
    j = Joined(texts, ~_SPACE)
    words = segments(j.raw, j.begin, j.end)
    again = np.flatnonzero((words[1:] == words[:-1]) & (j.doc[1:] == j.doc[:-1])) + 1
    out = [((words % np.uint64(BUCKETS)).astype(np.int32), j.begin), (np.zeros(len(again), np.int32), j.begin[again])]
    place, code = characters(j.raw)
    space = _SPACE[j.raw[place]]
    b = np.where(space, 32, code).astype(np.uint32)
    for n in (3, 4, 5):
        size = max(0, len(b) - n + 1)
        h, inner = np.full(size, n, np.uint32), np.ones(size, bool)
        for i in range(n):
            h *= np.uint32(0x01000193)
            h ^= b[i:size + i]
            if 0 < i < n - 1:
                inner &= ~space[i:size + i]
        at = np.flatnonzero(inner)
        h = h[at] * np.uint32(0x85EBCA6B)
        out.append(((h >> np.uint32(16)).astype(np.int32), place[at]))
    return j, out


def characters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each character of UTF-8 bytes begins, and its bytes as one number, the first lowest."""
    place = np.flatnonzero((raw & 0xC0) != 0x80)
    code = raw[place].astype(np.uint32)
    size = np.diff(np.append(place, len(raw)))
    for i in range(1, 4):
        long = np.flatnonzero(size > i)
        code[long] |= raw[place[long] + i].astype(np.uint32) << np.uint32(8 * i)
    return place, code


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    n = np.zeros(BUCKETS, np.int64)
    for piece in text_pieces(text):
        for ids, _ in features([piece])[1]:
            n += np.bincount(ids, minlength=BUCKETS)
    return np.flatnonzero(n).astype(np.int32), n[n > 0].astype(np.int32)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> np.ndarray:
    """Logit of class 1 by bucket, and the bias at the end, from (label, buckets, counts)."""
    draw = np.random.default_rng(seed)
    table = draw.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = draw.uniform(-1, 1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    rows = [(y, i, (c / c.sum()).astype(np.float32)) for y, i, c in rows if len(i)]
    total, step = epochs * len(rows), 0
    for _ in range(epochs):
        for r in draw.permutation(len(rows)):
            y, ids, share = rows[r]
            lr = rate * (1 - step / total)
            step += 1
            x = share @ table[ids]
            z = x @ layer + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y] -= 1
            back = layer @ g
            layer -= 0.1 * lr * np.outer(x, g)
            bias -= 0.1 * lr * g
            table[ids] -= lr * np.outer(share, back)
    return np.append(table @ (layer[:, 1] - layer[:, 0]), bias[1] - bias[0]).astype(np.float32)


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y): one row per id whose labels have a majority."""
    y = F.col(label)
    one = labels.where(y.isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(y.cast("double")).alias("y"))
    return one.where("y <> 0.5").select("doc_id", (F.col("y") > 0.5).cast("int").alias("y"))


def one_text(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, y, text): a row per id of ``ids`` (doc_id, y; few rows) that ``docs`` has; of an id's rows, the text with the smallest hash."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    least = F.min(F.struct(F.col("text").isNull().alias("none"), F.xxhash64("text").alias("hash"), "text")).alias("least")
    return texts.groupBy("doc_id", "y").agg(least).select("doc_id", "y", "least.text")


class Model:
    """``weights``: logit by bucket and the bias; ``prior``: logit of class 1 among all labels."""

    def __init__(self, weights: np.ndarray, prior: float):
        self.weights, self.prior = weights, prior

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Logit of class 1 for each text."""
        pieces = [(i, p) for i, t in enumerate(texts) for p in text_pieces(t)]
        of = np.array([i for i, _ in pieces], np.int64)
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for lo, hi in by_size([p for _, p in pieces]):
            sums, counts = self._sums([p for _, p in pieces[lo:hi]])
            np.add.at(total, of[lo:hi], sums)
            np.add.at(n, of[lo:hi], counts)
        return self.prior + np.where(n > 0, total / np.maximum(n, 1) + self.weights[-1], 0.0)

    def _sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the features' logits, and number of features; both 0 for a text without words."""
        j, parts = features(texts)
        total, n = np.zeros(len(texts)), np.zeros(len(texts))
        for ids, at in parts:
            sums = np.concatenate([[0.0], np.cumsum(self.weights[ids], dtype=np.float64)])
            # A text's n-grams may begin at the blank before it, and end at the blank after it.
            lo, hi = np.searchsorted(at, j.start - 1), np.searchsorted(at, j.stop - 1)
            total += sums[hi] - sums[lo]
            n += hi - lo
        return total, n


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, y) names."""
    n0, n1 = labels.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    prior = math.log((n1 + 0.5) / (n0 + 0.5))
    order = F.xxhash64("doc_id", F.lit(SEED))
    lowest = [labels.where(F.col("y") == y).orderBy(order, "doc_id").limit(fit_rows) for y in (0, 1)]
    # At most 2 * fit_rows ids.
    sample = lowest[0].union(lowest[1])

    def count(batches):
        for b in text_slices(batches):
            got = [counts(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([i.tobytes() for i, _ in got], pa.binary()), pa.array([c.tobytes() for _, c in got], pa.binary())], ["doc_id", "y", "ids", "n"])

    def learn(table: pa.Table) -> pa.Table:
        rows = [(y, np.frombuffer(i, np.int32), np.frombuffer(n, np.int32)) for _, y, i, n in sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "y", "ids", "n")), strict=True))]
        weights = train(rows) if len({r[0] for r in rows}) == 2 else np.zeros(BUCKETS + 1, np.float32)
        return pa.table({"model": pa.array([weights.tobytes()], pa.binary())})

    found = one_text(docs, sample).mapInArrow(count, "doc_id long, y int, ids binary, n binary").groupBy((F.col("y") * 0).alias("all")).applyInArrow(learn, "model binary").collect()
    weights = np.frombuffer(found[0]["model"], np.float32) if found else np.zeros(BUCKETS + 1, np.float32)
    return Model(weights, prior)


def score(model: Model, text: Column) -> Column:
    """Probability of class 1 for each text."""
    weights, prior = model.weights, model.prior

    @F.pandas_udf("double")
    def run(batches: pd.Series) -> pd.Series:
        m = Model(weights, prior)
        z = np.concatenate([m.logits(batches.iloc[i:i + 512].tolist()) for i in range(0, len(batches), 512)]) if len(batches) else np.zeros(0)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -700, 700))))

    return run(text.cast("string"))


def scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, score (0 to 1) and predicted, learned from ``labels`` (doc_id, y)."""
    s = score(fit(docs, labels, fit_rows), F.col("text"))
    return docs.select("doc_id", s.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

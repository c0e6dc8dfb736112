"""Toxicity scores by votes of the nearest labelled examples.

Method. All labelled texts are examples; a text is scored twice and the higher score counts.

1. *Terms*: how a text speaks. Its nearest examples by exact TF-IDF cosine over the
   vocabulary of toxic texts are found in a block-max inverted index: a term's postings are
   cut into blocks of ``BLOCK`` examples with the largest weight of each; blocks are visited
   in descending order of the bound that follows, until the bound falls below the k-th best
   cosine. The neighbours vote with weight 1 / (1.05 - cosine); the share of toxic votes is
   calibrated by a logistic curve fitted on leave-one-out votes of the examples. A text
   without a term has the share of toxic texts among labelled ones without a term.
2. *Copies*: what a text says. All examples whose exact TF-IDF cosine over all words is at
   least ``COPY`` vote with weight 1 / (1.05 - cosine)**3, besides the share above with the
   weight of one example at ``COPY``. A toxic example that holds terms votes only on texts that
   hold one of these, as copies of it that lack them are clean. They are found by the
   text's rare words: with its words in order of rarity, the last ones with a norm of ``REST``
   add at most that to a cosine, so only examples that get ``COPY`` - ``REST`` from the words
   before are compared whole.

The evidence is the neighbours of the score that counts.

Words are runs of letters, lower-cased; a run with letters of a script without spaces counts
by its pairs of letters. Vocabulary: the words whose presence in toxic texts is
not chance (log-likelihood ratio above 2 ln(words tested) + 4, which keeps false
terms rare at any number of words) and whose texts are toxic at a share nearer to 1
than to the share of all texts (so that words which only lean to one side stay out,
however many texts show it). Then, as long as words are found, the same share and a
binomial test with a false discovery rate of ``FALSE`` (among the words of at least 2, 3, ..
6 texts each) over the texts without a term so far: as the terms explain nearly all toxic texts, a word in two or three of the others stands
out. Counted once per group of near copies (texts
whose word triples have the same two smallest hashes), so that a copied text does not make its
words evidence. Without this choice, cosine would compare what texts are about
and not how they speak, which is what the second score is for.

Fitting uses at most ``FIT_ROWS`` labelled texts, those whose ids hash lowest, one text of each id, and
at most ``TERMS`` terms, the best first; these bounds hold the indexes that the
tasks get. Document frequencies of terms are counted over all texts, those of other words
over the examples, and every row is scored.

Rows: null and empty texts have no word; an id with labels of both kinds counts by
majority (as often: not at all); without labels every score is 0.49; ties between neighbours go to the smaller doc_id; repeated rows
are scored each; further columns pass through ``reject``.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcast.llm.common import materialize, text_pieces, text_slices
from shopcast.llm.quality import labelled, one_text

__all__ = ["labelled", "fit", "scores", "reject", "BlockMaxIndex", "CopyIndex", "Model"]

FIT_ROWS, TERMS, K, BLOCK = 20_000, 50_000, 15, 64
#: Cosine over all words from which an example is a near copy.
COPY = 0.75
#: Norm of the most frequent words of a text, which are not looked up to find near copies.
REST = 0.5
#: Share of chance finds among the words that are added to the vocabulary after the first.
FALSE = 0.02
#: Examples whose leave-one-out votes fit the calibration.
CALIBRATION = 2000
SEED = 11
_WORD = re.compile(r"[^\W\d_]+")
#: Thai, Lao, Burmese, Khmer, kana and Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def words(text: str | None) -> Iterator[str]:
    """Words of the text, which is read about a million characters at a time."""
    for piece in text_pieces(text):
        found = _WORD.findall(piece.lower())
        if piece.isascii() or not _UNSPACED.search(piece):
            yield from found
            continue
        for w in found:
            if len(w) > 1 and _UNSPACED.search(w):
                yield from (w[i:i + 2] for i in range(len(w) - 1))
            else:
                yield w


def sketch(ws: list[str]) -> int:
    """The two smallest hashes of a text's word triples, as one number: near copies mostly have the same, texts that share a passage seldom."""
    h = xxhash.xxh64_intdigest
    least = heapq.nsmallest(2, {h(" ".join(t)) for t in zip(ws, ws[1:], ws[2:], strict=False)})
    return h(str(least) if least else " ".join(ws)) >> 1


class BlockMaxIndex:
    """Exact search for the rows of largest inner product among sparse unit vectors with positive weights."""

    def __init__(self, vectors: list[dict[int, float]], block: int = BLOCK):
        self.block, self.n = block, len(vectors)
        self.blocks = -(-len(vectors) // block)
        by_term: dict[int, list[tuple[int, float]]] = {}
        for i, v in enumerate(vectors):
            for t, w in v.items():
                by_term.setdefault(t, []).append((i, w))
        #: Per term: its blocks, their largest weight, and where their postings begin; the postings.
        self.terms = {}
        for t, posts in by_term.items():
            rows, weights = np.array([p[0] for p in posts]), np.array([p[1] for p in posts])
            ids, begin = np.unique(rows // block, return_index=True)
            self.terms[t] = {int(b): k for k, b in enumerate(ids)}, ids, np.maximum.reduceat(weights, begin), np.append(begin, len(rows)), rows, weights

    def search(self, query: dict[int, float], k: int, without: int = -1) -> list[tuple[int, float]]:
        """The k rows of largest product above 0 (ties: the earlier row) and the products."""
        held = [(w, *self.terms[t]) for t, w in query.items() if t in self.terms]
        bound = np.zeros(self.blocks)
        for w, _, ids, most, *_ in held:
            bound[ids] += w * most
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(best) >= k and bound[b] < -best[k - 1][0] - 1e-9:
                break
            sums = np.zeros(self.block)
            for w, place, _, _, begin, rows, weights in held:
                if (p := place.get(b)) is not None:
                    at = slice(begin[p], begin[p + 1])
                    sums[rows[at] - b * self.block] += w * weights[at]
            sums = np.round(sums, 12)  # so that ties do not hang on the order of terms
            bar = -best[k - 1][0] if len(best) >= k else 0.0
            best += [(-float(sums[i]), b * self.block + int(i)) for i in np.flatnonzero((sums >= bar) & (sums > 0)) if b * self.block + i != without]
            best = sorted(best)[:k]
        return [(i, -s) for s, i in best]


def hashed(counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, ascending, and how often each occurs."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, len(counts))
    order = np.argsort(h)
    return h[order], np.fromiter(counts.values(), np.int32, len(counts))[order]


def _narrow(x: np.ndarray) -> np.ndarray:
    """Counts in the smallest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


class Examples:
    """Labelled texts, in order of doc_id: ids, labels, sketches, and of each text the places of its words among all words' hashes, and how often each occurs."""

    def __init__(self, table: pa.Table):
        """``table``: doc_id, y, sketch, words and n (bytes of ``hashed``, n compressed)."""
        small = table.select(["doc_id", "y"])
        place = np.lexsort((small.column("y").to_numpy(), small.column("doc_id").to_numpy()))
        self.ids, self.y, self.sketch = (table.column(c).to_numpy()[place] for c in ("doc_id", "y", "sketch"))
        flat = lambda c, kind, read: np.concatenate([np.zeros(0, kind), *(np.frombuffer(read(table.column(c)[i].as_buffer()), kind) for i in place.tolist())])
        self.begin = np.append(0, np.cumsum([table.column("words")[i].as_buffer().size // 8 for i in place.tolist()], dtype=np.int64))
        self.n, words = flat("n", np.int32, zlib.decompress), flat("words", np.uint64, lambda b: b)
        del table, small
        order = np.argsort(words)
        words = words[order]
        first = np.append(True, words[1:] != words[:-1])[:len(words)]
        self.words, self.term = words[first], np.empty(len(words), np.int32)
        self.term[order] = np.cumsum(first, dtype=np.int32) - 1

    def of(self, terms: list[str]) -> np.ndarray:
        """Per word whether it is one of ``terms``."""
        return np.isin(self.words, np.array([xxhash.xxh64_intdigest(w) for w in terms], np.uint64))

    def rows(self) -> np.ndarray:
        """The text of each of ``term``."""
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.begin))


class CopyIndex:
    """Exact search for all examples whose TF-IDF cosine over all words reaches ``level``."""

    def __init__(self, e: Examples, level: float = COPY, rest: float = REST, terms: dict[str, int] | None = None):
        self.level, self.rest, self.n, self.words = level, rest, len(e.ids), e.words
        df = np.bincount(e.term, minlength=len(e.words))
        self.idf = (np.log((1 + self.n) / (1 + df)) + 1).astype(np.float32)
        # Equal texts are one row.
        held: dict[bytes, int] = {}
        #: Per distinct text: its examples, and its terms.
        self.rows: list[list[tuple[int, int]]] = []
        self.terms: list[frozenset[int]] = []
        place = {xxhash.xxh64_intdigest(w): t for w, t in (terms or {}).items()}
        term = {int(i): place[int(e.words[i])] for i in np.flatnonzero(e.of(list(terms or {})))}
        is_term = np.isin(e.term, np.array(list(term), np.int32))
        kept = []
        for i, (doc_id, y) in enumerate(zip(e.ids.tolist(), e.y.tolist(), strict=True)):
            at = slice(e.begin[i], e.begin[i + 1])
            k = held.setdefault(xxhash.xxh3_128_digest(e.term[at].tobytes() + b"|" + e.n[at].tobytes()), len(self.rows))
            if k == len(self.rows):
                self.rows.append([])
                self.terms.append(frozenset(term[t] for t in e.term[at][is_term[at]].tolist()))
                kept.append(i)
            self.rows[k].append((doc_id, y))
        chosen = np.zeros(len(e.ids), bool)
        chosen[kept] = True
        entries = np.flatnonzero(chosen[e.rows()])
        self.term, self.times = e.term[entries], _narrow(e.n[entries])
        self.begin = np.append(0, np.cumsum(np.diff(e.begin)[chosen]))
        self.posts: np.ndarray | None = None

    def __getstate__(self) -> dict:
        """Without what each task can make anew, which is most of it."""
        times = zlib.compress(self.times.tobytes(), 1), self.times.dtype
        return {k: v for k, v in self.__dict__.items() if k not in ("norm", "post_weight", "post")} | {"posts": None, "times": times}

    def __setstate__(self, state: dict) -> None:
        times, kind = state["times"]
        self.__dict__ |= state | {"times": np.frombuffer(zlib.decompress(times), kind)}

    def _weight(self, at: slice | np.ndarray) -> np.ndarray:
        """Weights of these entries, before their rows are scaled to length 1."""
        weight = np.log(self.times[at], dtype=np.float32)
        weight += 1
        weight *= self.idf[self.term[at]]
        return weight

    def _post(self) -> None:
        """Lengths of the rows, and the entries in order of their terms. Both a part at a time for the sake of memory."""
        self.norm = np.empty(len(self.rows), np.float32)
        for lo in range(0, len(self.rows), 1000):
            begin = self.begin[lo:lo + 1001]
            row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            self.norm[lo:lo + 1000] = np.sqrt(np.bincount(row, self._weight(slice(begin[0], begin[-1]))**2, len(begin) - 1))
        held = np.bincount(self.term, minlength=len(self.words))
        self.post = np.append(0, np.cumsum(held))
        self.posts, self.post_weight = np.empty(len(self.term), np.min_scalar_type(len(self.rows))), np.empty(len(self.term), np.float32)
        step = max(1, len(self.term) // 16)
        edge = np.unique(np.append(np.searchsorted(self.post, np.arange(0, len(self.term), step)), len(self.words)))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            entries = np.flatnonzero((self.term >= lo) & (self.term < hi))
            entries = entries[np.argsort(self.term[entries], kind="stable")]
            row = np.searchsorted(self.begin, entries, "right") - 1
            self.posts[self.post[lo]:self.post[hi]] = row
            self.post_weight[self.post[lo]:self.post[hi]] = self._weight(entries) / self.norm[row]

    def search(self, h: np.ndarray, n: np.ndarray) -> list[tuple[int, float]]:
        """(place in ``rows``, cosine) of the examples that reach the level, the nearest first."""
        if not len(h) or not len(self.words):
            return []
        if self.posts is None:
            self._post()
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[at] == h
        weight = (1 + np.log(n)) * np.where(known, self.idf[at], math.log(1 + self.n) + 1)
        weight /= math.sqrt(weight @ weight)
        at, weight = at[known], weight[known]
        order = np.argsort(-self.idf[at], kind="stable")
        at, weight = at[order], weight[order]
        look = int(np.count_nonzero(np.cumsum(weight[::-1]**2)[::-1] > self.rest**2))
        lo, size = self.post[at[:look]], self.post[at[:look] + 1] - self.post[at[:look]]
        entries = np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)
        sums = np.bincount(self.posts[entries], self.post_weight[entries] * np.repeat(weight[:look], size), len(self.rows))
        rest = math.sqrt(max(0.0, weight[look:] @ weight[look:]))
        found = np.flatnonzero(sums >= self.level - rest - 1e-5)
        if not len(found):
            return []
        place = np.argsort(at)
        words, values = at[place], weight[place]
        cosine = np.zeros(len(found))
        for k, i in enumerate(found.tolist()):
            whole = slice(self.begin[i], self.begin[i + 1])
            own = self.term[whole]  # ascending
            p = np.minimum(np.searchsorted(words, own), len(words) - 1)
            cosine[k] = np.where(words[p] == own, values[p], 0.0) @ (self._weight(whole) / self.norm[i])
        cosine = np.minimum(np.round(cosine, 6), 1.0)
        hit = np.flatnonzero(cosine >= self.level - 1e-6)
        return sorted(zip(found[hit].tolist(), cosine[hit].tolist(), strict=True), key=lambda x: (-x[1], self.rows[x[0]][0][0]))


@dataclass
class Model:
    terms: dict[str, int]
    idf: np.ndarray
    ids: list[int] = field(default_factory=list)  # of the examples
    labels: list[int] = field(default_factory=list)
    index: BlockMaxIndex | None = None
    copies: CopyIndex | None = None
    base: float = 0.0  # score of texts without a term
    curve: tuple[float, float] = (0.0, 0.0)
    k: int = K

    def vector(self, tf: dict[int, int]) -> dict[int, float]:
        v = {t: (1 + math.log(n)) * float(self.idf[t]) for t, n in sorted(tf.items())}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()}

    def tf(self, text: str | None) -> dict[int, int]:
        return Counter(self.terms[w] for w in words(text) if w in self.terms)

    def vote(self, near: list[tuple[int, float]]) -> float:
        weight = [1 / (1.05 - min(s, 1.0)) for _, s in near]
        return sum(w for w, (i, _) in zip(weight, near, strict=True) if self.labels[i]) / sum(weight)

    def score(self, tf: dict[int, int]) -> tuple[float, list[tuple[int, float]]]:
        near = self.index.search(self.vector(tf), self.k) if tf and self.index else []
        if not near:
            return self.base, []
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, a * self.vote(near) + b)))), near

    def copied(self, counts: dict[str, int], tf: dict[int, int]) -> tuple[float, list[tuple[int, int, float]]]:
        """Score by near copies of the text, and the nearest of them: doc_id, label, cosine."""
        near = self.copies.search(*hashed(counts)) if self.copies else []
        held = [(i, c, [(d, y) for d, y in self.copies.rows[i] if not y or not self.copies.terms[i] or self.copies.terms[i] & tf.keys()]) for i, c in near]
        near = [(c, e) for _, c, e in held if e]
        weight = lambda cosine: (1.05 - cosine)**-3
        total = weight(self.copies.level) if near else 1.0
        toxic = total * self.base
        for cosine, e in near:
            total += weight(cosine) * len(e)
            toxic += weight(cosine) * sum(y for _, y in e)
        return toxic / total, [(doc_id, y, c) for c, e in near[:self.k] for doc_id, y in e[:self.k]][:self.k]

    def judge(self, text: str | None, known: dict) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of the text and its evidence: doc_id, label, cosine. ``known`` keeps scores by terms."""
        counts = Counter(words(text))
        tf = {self.terms[w]: n for w, n in counts.items() if w in self.terms}
        key = tuple(sorted(tf.items()))
        if key not in known:
            if len(known) > 20_000:
                known.clear()
            s, near = self.score(dict(key))
            known[key] = s, [(self.ids[i], self.labels[i], c) for i, c in near]
        by_terms, by_copies = known[key], self.copied(counts, tf)
        return by_copies if by_copies[1] and (by_copies[0] > by_terms[0] or not by_terms[1]) else by_terms


def _calibrated(votes: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through votes and labels; targets are drawn in a little (Platt), so one class is enough."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([votes, np.ones(len(votes))], axis=1)
    w = np.array([4.0, -2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (p - target) + 1e-2 * (w - np.array([4.0, -2.0]))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(hess, grad)
    return float(w[0]), float(w[1])


def vocabulary(sample: DataFrame, most: int = TERMS) -> list[str]:
    """Terms of toxic texts, from (y, text)."""

    def run(batches):
        for b in text_slices(batches):
            ws = [list(words(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([sketch(w) for w in ws], pa.int64()), pa.array([sorted(set(w)) for w in ws], pa.list_(pa.string()))], ["y", "sketch", "words"])

    texts = materialize(sample.select("y", "text").mapInArrow(run, "y int, sketch long, words array<string>").dropDuplicates(["sketch", "y"]))
    n0, n1 = texts.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    if not n0 or not n1:
        return []
    found = texts.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    found = materialize(found)
    a, n, rate = F.col("a"), F.col("n"), n1 / (n0 + n1)
    part = lambda x, of: F.when(x > 0, x * F.ln(x / of)).otherwise(0.0)
    # Twice the log-likelihood of the word's and the other texts' shares of toxic ones against one common share.
    ratio = 2 * (part(a, n * rate) + part(n - a, n * (1 - rate)) + part(n1 - a, (n0 + n1 - n) * rate) + part(n0 - n + a, (n0 + n1 - n) * (1 - rate)))
    bar = 2 * math.log(max(1, found.count())) + 4
    best = found.where(a >= n * (1 + rate) / 2).withColumn("ratio", ratio).where(F.col("ratio") > bar).orderBy(F.desc("ratio"), "word").limit(most)
    return sorted(r["word"] for r in best.select("word").collect())


def examples(sample: DataFrame) -> Examples:
    """The labelled texts, from (doc_id, y, text)."""

    def run(batches):
        for b in text_slices(batches):
            ws = [list(words(t)) for t in b.column("text").to_pylist()]
            got = [hashed(Counter(w)) for w in ws]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([sketch(w) for w in ws], pa.int64()), pa.array([h.tobytes() for h, _ in got], pa.binary()), pa.array([zlib.compress(n.tobytes(), 1) for _, n in got], pa.binary())], ["doc_id", "y", "sketch", "words", "n"])

    found = Examples(sample.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, sketch long, words binary, n binary").toArrow())
    pa.default_memory_pool().release_unused()
    return found


def _chance(a: int, n: int, rate: float) -> float:
    """Probability of ``a`` or more toxic ones among ``n`` texts."""
    log = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    return min(1.0, sum(math.exp(log(k)) for k in range(a, n + 1)))


def further(e: Examples, known: list[str], most: int) -> set[int]:
    """Hashes of words that tell the toxic ones among the examples without a ``known`` term or a word found before."""
    one = np.zeros(len(e.ids), bool)
    one[list({(s, y): i for i, s, y in zip(range(len(one) - 1, -1, -1), e.sketch[::-1].tolist(), e.y[::-1].tolist(), strict=True)}.values())] = True  # of near copies, the smallest doc_id
    row, word, y, term, every = e.rows(), e.term, e.y, e.of(known), e.words
    found: list[int] = []
    while len(found) < most:
        free = one & (np.bincount(row[term[word]], minlength=len(one)) == 0)
        left, toxic = int(free.sum()), int(y[free].sum())
        if not 0 < toxic < left:
            break
        rate = toxic / left
        n = np.bincount(word[free[row]], minlength=len(every))
        a = np.bincount(word[(free & (y == 1))[row]], minlength=len(every))
        some = np.flatnonzero((n >= 2) & (a >= 2) & (a >= n * (1 + rate) / 2))
        kinds, of = np.unique(np.stack([a[some], n[some]]), axis=1, return_inverse=True)
        chance = np.array([_chance(int(i), int(k), rate) for i, k in kinds.T])[of.ravel()]
        order = np.lexsort((every[some], chance))
        new = some[:0]
        for least in range(2, 7):  # words of few texts cannot stand out in a small sample and only raise the bar for the others
            held = order[n[some[order]] >= least]
            fine = np.flatnonzero(chance[held] <= FALSE * np.arange(1, len(held) + 1) / max(1, int((n >= least).sum())))
            new = np.union1d(new, some[held[:fine[-1] + 1]]) if len(fine) else new
        if not len(new):
            break
        term[new] = True
        found += every[new].tolist()
    return set(found[:most])


def spelled(sample: DataFrame, hashes: set[int]) -> list[str]:
    """The words of the sample's texts with these hashes."""
    if not hashes:
        return []

    def run(batches):
        for b in text_slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(sorted({w for t in b.column("text").to_pylist() for w in words(t) if xxhash.xxh64_intdigest(w) in hashes}), pa.string())], ["word"])

    return sorted(r["word"] for r in sample.select("text").mapInArrow(run, "word string").distinct().collect())


def term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id and, for the terms that a text has, their numbers and how often they occur."""
    place = {t: i for i, t in enumerate(terms)}

    def run(batches):
        for b in text_slices(batches):
            found = [sorted(Counter(place[w] for w in words(t) if w in place).items()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([[t for t, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[n for _, n in f] for f in found], pa.list_(pa.int32()))], ["doc_id", "terms", "tf"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, terms array<int>, tf array<int>")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, terms: int = TERMS, k: int = K) -> tuple[Model, DataFrame]:
    """The model, and the term counts of all rows of ``docs`` (doc_id, text). ``labels``: doc_id, y."""
    # At most fit_rows ids.
    ids = labels.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(fit_rows)
    labelled_texts = materialize(one_text(docs, ids))
    vocab = vocabulary(labelled_texts, terms)
    every = examples(labelled_texts)
    vocab = sorted({*vocab, *spelled(labelled_texts, further(every, vocab, terms - len(vocab)))})
    counts = materialize(term_counts(docs, vocab))
    n = counts.count()
    df = {r["t"]: r["n"] for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    idf = np.array([math.log((1 + n) / (1 + df.get(i, 0))) + 1 for i in range(len(vocab))])
    model = Model({t: i for i, t in enumerate(vocab)}, idf, k=k)
    sample = term_counts(labelled_texts, vocab).join(labelled_texts.select("doc_id", "y"), "doc_id")
    plain = sample.where(F.size("terms") == 0).agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    model.base = (plain[1] + 0.5) / (plain[0] + 1) if len(every.ids) else 0.49
    model.copies = CopyIndex(every, terms=model.terms)
    # Examples with like terms stand together, so that few blocks have a high bound.
    rows = sorted((r["terms"], r["tf"], r["doc_id"], r["y"]) for r in sample.where(F.size("terms") > 0).select("doc_id", "y", "terms", "tf").collect())
    rows.sort(key=lambda r: (max(r[0], key=lambda t: (idf[t], -t)), r[0], r[2]))
    if rows:
        vectors = [model.vector(dict(zip(r[0], r[1], strict=True))) for r in rows]
        model.ids, model.labels, model.index = [r[2] for r in rows], [r[3] for r in rows], BlockMaxIndex(vectors)
        some = sorted(range(len(rows)), key=lambda i: xxhash.xxh64_intdigest(str(rows[i][2])))[:CALIBRATION]
        near = [(i, model.index.search(vectors[i], k, without=i)) for i in some]
        votes = [(model.vote(f), model.labels[i]) for i, f in near if f]
        model.curve = _calibrated(np.array([v for v, _ in votes]), np.array([y for _, y in votes])) if votes else (4.0, -2.0)
    return model, counts


def scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, k: int = K) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, score (0 to 1), predicted, evidence (the neighbours: doc_id, label, cosine)."""
    model, _ = fit(docs, labels, fit_rows, k=k)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, known = shared.value, {}
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
        for b in text_slices(batches):
            out = [m.judge(t, known) for t in b.column("text").to_pylist()]
            near = [[{"doc_id": d, "label": y, "cosine": c} for d, y, c in o[1]] for o in out]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([o[0] for o in out], pa.float64()), pa.array(near, kind)], ["doc_id", "score", "evidence"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = slim.mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id:long,label:int,cosine:double>>")
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def score(docs: DataFrame, model: Model, text: Column) -> Column:
    """Score of each text of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        m, known = shared.value, {}
        # One text at a time becomes a Python string.
        return pa.array((m.judge(t.as_py(), known)[0] for t in texts), pa.float64())

    return run(text.cast("string"))


def reject(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, k: int = K) -> DataFrame:
    """Rows of ``docs`` with a score under 0.5, all columns."""
    model, _ = fit(docs, labels, fit_rows, k=k)
    return docs.where(score(docs, model, F.col("text")) < 0.5)

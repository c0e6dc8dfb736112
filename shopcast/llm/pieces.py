"""SentencePiece encoding and decoding of whole texts, by a table of each prefix's last token.

Method (merge-type prefix table). The encoding of a text by merges is the one
sequence of pieces in which every piece encodes to itself and every two
neighbours are compatible: the text of both, encoded alone, gives just these two.
So each prefix of a text has one last token, and it is found from those of
shorter prefixes: an Aho-Corasick automaton over the pieces gives the pieces
that end at a position, longest first, and the first that is compatible with the last
token of the prefix before it is the one. The table of these tokens is filled from left to
right, and the ids are read off backwards from its end, in time linear in the text.

Texts are cut where no merge can reach across, so that tables stay short and
frequent words are encoded once per task: before a space mark that follows another
character, where the vocabulary has no piece with a mark inside, and between characters of
groups that no piece links (such as letters and digits). Both are read from the vocabulary file.

Covers ``.model`` files of the merge type with byte fallback, identity
normalization and a space mark put in front (checked; others raise). Ids and decoded
texts are those of the ``sentencepiece`` library, which the tests compare with;
here it only reads the file.

Scale: no shuffle; a task holds one batch of rows, the automaton, and at most
``4 * CACHE`` words and parts of words of at most ``CACHED`` characters with their ids. Long texts are encoded about
``PIECE`` characters at a time, cut at a space.

Rows: null text counts as empty (begin and end ids only, decoded empty);
repeated rows are encoded each; a null doc_id is passed on; null ids decode to an empty text. Further
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.llm.common import PIECE, text_slices
from shopcast.llm.tokens import tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
CACHE, CACHED = 1 << 18, 64
_PAIRS = 1 << 20
_CUT = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")


class Merges:
    """Merging by score, one step at a time, as the definition says: best score first, leftmost of equals. For short texts."""

    def __init__(self, score: dict[str, float]):
        self.score = score

    def __call__(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts


class Automaton:
    """Aho-Corasick automaton over ``words``: ``ends[state]`` lists the words that end where the state is reached, longest first."""

    def __init__(self, words: list[str]):
        self._tree: list[dict[str, int]] = [{}]
        whole: list[int | None] = [None]
        for w, word in enumerate(words):
            state = 0
            for ch in word:
                follow = self._tree[state].get(ch)
                if follow is None:
                    follow = self._tree[state][ch] = len(self._tree)
                    self._tree.append({})
                    whole.append(None)
                state = follow
            whole[state] = w
        self._fail = [0] * len(self._tree)
        self.ends: list[list[int]] = [[] for _ in self._tree]
        queue = deque([0])
        while queue:
            state = queue.popleft()
            if state:
                self.ends[state] = [w for w in (whole[state],) if w is not None] + self.ends[self._fail[state]]
            for ch, follow in self._tree[state].items():
                self._fail[follow] = self._next(self._fail[state], ch) if state else 0
                queue.append(follow)
        #: Steps taken so far, by state and character; a step that isn't there is found by :meth:`step`.
        self.steps: list[dict[str, int]] = [dict(t) for t in self._tree]
        self._learned = 0

    def _next(self, state: int, ch: str) -> int:
        while (follow := self._tree[state].get(ch)) is None:
            if not state:
                return 0
            state = self._fail[state]
        return follow

    def step(self, state: int, ch: str, most: int = 1 << 20) -> int:
        follow = self._next(state, ch)
        if self._learned < most:
            self.steps[state][ch] = follow
            self._learned += 1
        return follow


class Memo(dict):
    """Results of ``make`` for short texts: those of the last ``CACHE`` new texts at least, of twice as many at most."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.older = make, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text) or self.make(text)
        if len(text) <= CACHED:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


def _linked(words: list[str]) -> list[list[str]]:
    """Characters that stand next to each other in some word, closed under this relation: groups of two and more, or a character that follows itself."""
    group = {c: c for w in words for c in w}

    def top(c: str) -> str:
        while group[c] != c:
            group[c] = group[group[c]]
            c = group[c]
        return c

    linked = set()
    for w in words:
        for a, b in zip(w, w[1:], strict=False):
            group[top(a)] = top(b)
            linked |= {a, b}
    out: dict[str, list[str]] = {}
    for c in sorted(linked):
        out.setdefault(top(c), []).append(c)
    return sorted(out.values(), key=lambda g: (-len(g), g))


class Pieces:
    """Encoder and decoder of a sentencepiece model file."""

    def __init__(self, name: str = MODEL):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(tokenizer_path(name), "rb") as f:
            spec.ParseFromString(f.read())
        trainer, norm, kind = spec.trainer_spec, spec.normalizer_spec, pb.ModelProto.SentencePiece
        if trainer.model_type != pb.TrainerSpec.BPE or not trainer.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces \
                or not norm.add_dummy_prefix or not norm.escape_whitespaces or trainer.treat_whitespace_as_suffix or spec.denormalizer_spec.precompiled_charsmap \
                or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in spec.pieces):
            raise ValueError(f"{name} is no merge-type model with byte fallback, identity normalization and a leading space mark")
        ids = {p.piece: i for i, p in enumerate(spec.pieces)}
        score = {p.piece: p.score for p in spec.pieces if p.type == kind.NORMAL}
        self.begin, self.end = ids[trainer.bos_piece], ids[trainer.eos_piece]
        self._byte = [ids[f"<0x{b:02X}>"] for b in range(256)]
        self._merge(score, ids)
        self._prepare_decoder(spec, kind, trainer.unk_surface)
        self._runs = Memo(self._table_ids)
        self._words = Memo(lambda w: self._run_ids(MARK + w))

    # -- encoding --------------------------------------------------------------

    def _merge(self, score: dict[str, float], ids: dict[str, int]) -> None:
        self.merges = Merges(score)
        letters = {c for p in score for c in p}
        # Words of the automaton: pieces that encode to themselves, and the letters of pieces.
        self.text = [p for p in score if len(p) > 1 and self.merges(p) == [p]] + sorted(letters)
        self.size = [len(t) for t in self.text]
        self.automaton = Automaton(self.text)
        # Per word: whether it may follow another one, as far as that was tested.
        self._follows: list[dict[int, bool]] = [{} for _ in self.text]
        self._tested = 0
        self._ends = [[(w, len(self.text[w]), self._follows[w]) for w in ends] for ends in self.automaton.ends]
        self.out = [np.array([ids[t]] if t in score else self._bytes(t), "<u4").tobytes() for t in self.text]
        self._inside = any(a != MARK and b == MARK for p in score for a, b in zip(p, p[1:], strict=False))
        groups = ["[" + "".join(map(re.escape, g)) + "]+" for g in _linked([p.replace(MARK, "") for p in score])]
        self._run = re.compile(f"{MARK}*(?:{'|'.join([*groups, f'[^{MARK}]'])})|{MARK}+")
        self._word = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def _bytes(self, ch: str) -> list[int]:
        return [self._byte[b] for b in ch.encode()]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the texts of words ``a`` and ``b``, encoded together, give these two."""
        known = self._follows[b].get(a)
        if known is None:
            if self._tested >= _PAIRS:
                for tested in self._follows:
                    tested.clear()
                self._tested = 0
            self._tested += 1
            known = self._follows[b][a] = self.merges(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        return known

    def last_tokens(self, text: str) -> list[int]:
        """For every prefix of ``text``, the empty one first, the last word of its encoding; -1 for none and for a character that no piece holds."""
        last, state, at = [-1], 0, 0
        steps, ends = self.automaton.steps, self._ends
        for ch in text:
            follow = steps[state].get(ch)
            state = self.automaton.step(state, ch) if follow is None else follow
            at += 1
            for word, size, tested in ends[state]:
                before = last[at - size]
                if before < 0:
                    break
                good = tested.get(before)
                if self.compatible(before, word) if good is None else good:
                    break
            else:
                word = -1
            last.append(word)
        return last

    def _table_ids(self, text: str) -> bytes:
        """Ids of a run of characters, read off the table of last words from the end."""
        last, parts, at = self.last_tokens(text), [], len(text)
        while at:
            word = last[at]
            if word < 0:
                parts.append(np.array(self._bytes(text[at - 1]), "<u4").tobytes())
                at -= 1
            else:
                parts.append(self.out[word])
                at -= self.size[word]
        return b"".join(reversed(parts))

    def _run_ids(self, word: str) -> bytes:
        return b"".join(map(self._runs.__getitem__, self._run.findall(word)))

    def _marked(self, text: str) -> bytes:
        """Ids of ``text`` with a space mark in front and space marks for spaces."""
        if self._inside:
            return self._table_ids(MARK + text.replace(" ", MARK))
        words = text.split(" ") if "  " not in text and MARK not in text and text[:1] != " " else [w[1:] for w in self._word.findall(MARK + text.replace(" ", MARK))]
        return b"".join(map(self._words.__getitem__, words))

    def encode(self, text: str | None, piece: int = PIECE) -> bytes:
        """Ids of the text, begin and end ids included, as little-endian unsigned 32-bit integers."""
        parts, at = [np.array([self.begin], "<u4").tobytes()], 0
        while text and not self._inside and len(text) - at > piece and (m := _CUT.search(text, at + piece)):
            parts.append(self._marked(text[at:m.start()]))
            at = m.end()
        if text:
            parts.append(self._marked(text[at:]))
        return b"".join([*parts, np.array([self.end], "<u4").tobytes()])

    # -- decoding --------------------------------------------------------------

    def _prepare_decoder(self, spec, kind, unknown: str) -> None:
        plain = {kind.CONTROL: lambda p: "", kind.UNKNOWN: lambda p: unknown, kind.BYTE: lambda p: ""}
        self.surface = [plain.get(p.type, lambda p: p.replace(MARK, " "))(p.piece).encode() for p in spec.pieces]
        self._raw = list(self.surface)
        self._control = np.array([p.type == kind.CONTROL for p in spec.pieces])
        self.is_byte = np.zeros(len(spec.pieces), bool)
        self._value = np.zeros(len(spec.pieces), np.uint8)
        for b, i in enumerate(self._byte):
            self._raw[i], self.is_byte[i], self._value[i] = bytes([b]), True, b
        self._spaced = [p.type == kind.NORMAL and p.piece.startswith(MARK) for p in spec.pieces]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids. Runs of byte pieces are read as UTF-8, a byte that fits in no character as U+FFFD."""
        items = ids.tolist()
        raw = b"".join([self._raw[i] for i in items])
        first = next((i for i in items if self._raw[i]), None)
        drop = first is not None and self._spaced[first]
        try:
            if not self._control[ids[1:-1]].any():  # a control piece inside ends a run of bytes
                return raw.decode()[drop:]
        except UnicodeDecodeError:  # some run of bytes is no text of its own
            pass
        out = [self._broken(ids[a:b]) if self.is_byte[ids[a]] else b"".join([self.surface[i] for i in ids[a:b].tolist()]).decode() for a, b in self._stretches(ids)]
        return "".join(out)[drop:]

    def _stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        kinds = self.is_byte[ids]
        edges = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(ids)]
        return zip(edges, edges[1:], strict=False)

    def _broken(self, ids: np.ndarray) -> str:
        raw, at, out = self._value[ids].tobytes(), 0, []
        while at < len(raw):
            n = 1 if raw[at] < 0xC0 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
            try:
                out.append(raw[at:at + n].decode())
                at += n
            except UnicodeDecodeError:
                out.append("�")
                at += 1
        return "".join(out)


@functools.lru_cache(maxsize=2)
def pieces(name: str) -> Pieces:
    """One per worker process and file."""
    return Pieces(name)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, ids (with begin and end ids)."""

    def run(batches: Iterable[pa.RecordBatch]):
        sp = pieces(model)
        for b in text_slices(batches):
            ids = [np.frombuffer(sp.encode(t), "<u4").astype(np.int32) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _slim(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row of ``rows`` (doc_id, ids): doc_id, text. An id that the model hasn't is an error."""

    def run(batches: Iterable[pa.RecordBatch]):
        sp = pieces(model)
        for b in text_slices(batches):
            texts = [sp.decode(np.array(ids or [], np.int64)) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, same (whether decoding gives the text back)."""

    def run(batches: Iterable[pa.RecordBatch]):
        sp = pieces(model)
        for b in text_slices(batches):
            out: list[tuple] = []
            for t in b.column("text").to_pylist():
                ids = sp.encode(t)
                text = sp.decode(np.frombuffer(ids, "<u4"))
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), text == (t or "")))
            n, a, d, same = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(same, pa.bool_())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same"])

    return _slim(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")

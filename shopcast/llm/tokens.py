"""Token counts of whole texts, with huge texts encoded in overlapping chunks.

Method (overlap resynchronisation). A text of more than ``chunk`` characters is
encoded chunk by chunk, each chunk reaching ``overlap`` characters into the
next. The next chunk starts anywhere, maybe inside a word, so its first tokens
may be wrong. The two encodings are spliced at a position in the overlap that
(a) begins a token in both and (b) is proven stable: white space right after a
character that is not. No branch of the tokenizer's splitting pattern, and no
special token, has white space after another character, so every left-to-right
scan that began before that position ends a match there, and what follows
depends on the rest of the text only. Where the overlap has no such position it
is doubled, up to the rest of the text; the result is that of the whole text.

The proof holds for byte-level BPE with the usual splitting pattern. Other
tokenizer files (other ``.json`` kinds, sentencepiece ``.model``) encode each
text whole.

Engine: ids are those of the ``tokenizers`` library. A plain byte-level BPE
file whose merges are in id order is merged by ``tiktoken`` built from the same
file (same ids, 4 times as fast; the tests compare both); the few texts
with very long runs without white space, or of white space, go to
``tokenizers`` itself.

Rows: null text counts as empty (0 bytes, 0 tokens); repeated rows are counted
each; a null doc_id is passed on; further columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcast.llm.common import text_slices

#: Name in ``public_tokenizers`` or a path that every executor has.
TOKENIZER = "byte_bpe_50k.json"
CHUNK, OVERLAP = 32_768, 256
_STABLE = re.compile(r"(?<=\S)[ \t\r\n]")
_SPACE, _NO_SPACE = re.compile(r"\s"), re.compile(r"\S")


def tokenizer_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """Letters by which byte-level files write bytes: printable Latin-1 stands for itself, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _has_long_run(text: str, window: int = 1000) -> bool:
    """Whether some aligned window is all white space or has none; every run of twice that length has such a window."""
    return any(not _SPACE.search(text, at, at + window) or not _NO_SPACE.search(text, at, at + window) for at in range(0, len(text) - window + 1, window))


class Encoder:
    """Ids as the tokenizer file's library gives them, without begin, end or added special tokens."""

    def __init__(self, name: str = TOKENIZER):
        path = tokenizer_path(name)
        self.fast = self.hf = self.sp = self.lengths = None
        if path.endswith(".model"):
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.hf = Tokenizer.from_file(path)
        self.hf.no_truncation()
        self.hf.no_padding()
        with open(path, encoding="utf-8") as f:
            self._plain_byte_bpe(json.load(f))

    def _plain_byte_bpe(self, spec: dict) -> None:
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
            return
        added = spec.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added):
            return
        special = {t["content"]: t["id"] for t in added}
        letters, vocab = _byte_letters(), model["vocab"]
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        order = [vocab[t] for t in made]
        if len(set(made)) < len(made) or order != sorted(order) or (order and order[0] < 256):
            return
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
        import tiktoken

        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding(os.path.basename(TOKENIZER), pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for t, i in [*ranks.items(), *((k.encode(), v) for k, v in special.items())]:
            self.lengths[i] = len(t)

    def ids(self, text: str) -> list[int]:
        if self.sp is not None:
            return self.sp.encode(text)
        if self.fast is not None and not _has_long_run(text):
            return self.fast.encode(text, allowed_special="all")
        return self.hf.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
        """Ids of the whole text, by overlapping chunks where it is long and the file allows it."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.lengths is None or len(text) <= chunk + overlap:
            return np.asarray(self.ids(text), np.uint32)
        return self._spliced(text, chunk, overlap)

    def _piece(self, text: str, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of text[start:stop], and where each begins, in bytes from ``start``."""
        ids = np.asarray(self.ids(text[start:stop]), np.uint32)
        begins = np.zeros(len(ids), np.int64)
        np.cumsum(self.lengths[ids[:-1]], out=begins[1:])
        return ids, begins

    def _spliced(self, text: str, chunk: int, overlap: int) -> np.ndarray:
        out, at, valid = [], 0, 0  # of the chunk at ``at``, tokens from byte ``valid`` on are right
        ids, begins = self._piece(text, 0, chunk + overlap)
        while at + chunk + overlap < len(text):
            stop, follow = at + chunk + overlap, at + chunk
            ids2, begins2 = self._piece(text, follow, min(len(text), follow + chunk + overlap))
            gap = len(text[at:follow].encode())
            for m in _STABLE.finditer(text, follow, stop):
                if m.start() == follow:
                    continue  # what the next chunk begins with is not known to it
                p2 = len(text[follow:m.start()].encode())
                p = gap + p2
                k, k2 = np.searchsorted(begins, p), np.searchsorted(begins2, p2)
                if k < len(begins) and begins[k] == p and k2 < len(begins2) and begins2[k2] == p2 and p >= valid:
                    out.append(ids[np.searchsorted(begins, valid):k])
                    at, valid, ids, begins = follow, p2, ids2, begins2
                    break
            else:
                overlap *= 2  # no common stable boundary: widen
                ids, begins = self._piece(text, at, min(len(text), at + chunk + overlap))
        out.append(ids[np.searchsorted(begins, valid):])
        return np.concatenate(out)


@functools.lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(name)


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``). No shuffle."""

    def run(batches):
        enc = encoder(tokenizer)
        for b in text_slices(batches):
            n = [len(enc.encode(t, chunk, overlap)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

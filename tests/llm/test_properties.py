"""Properties over generated inputs, without a Spark session."""

import itertools

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shopcast.llm import centroids, divergence, packing, pieces, quality, tokens, topk
from shopcast.llm.hashing import Joined, segments

HF = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODER = tokens.Encoder()
SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
PIECES = pieces.Pieces()
TEXT = st.text(st.one_of(st.sampled_from(" \n\t  '.,<|>aé日1"), st.characters(exclude_categories=["Cs"])), max_size=120)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 20), st.integers(1, 8))
def test_spliced_ids_are_those_of_the_whole_text(text, chunk, overlap):
    want = HF.encode(text, add_special_tokens=False).ids
    assert ENCODER.ids(text) == want
    assert ENCODER.encode(text, chunk, overlap).tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_every_token_is_placed_once_without_gaps(lengths):
    placed = packing.assign(lengths, 16)
    tokens_of = {i: sorted((first, n) for j, first, n, _, _ in placed if j == i) for i in range(len(lengths))}
    for i, parts in tokens_of.items():
        assert [f for f, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) == lengths[i]
    for s in {p[3] for p in placed}:
        parts = sorted((offset, n) for *_, n, t, offset in placed if t == s)
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 16
    assert len({p[3] for p in placed}) == -(-sum(lengths) // 16)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=6, max_size=6), min_size=1, max_size=40), st.integers(1, 7), st.integers(1, 6))
def test_branch_and_bound_finds_the_best(rows, k, block):
    x = np.array(rows, dtype=np.float64)
    found = topk.search(x[:5], x, np.arange(len(x[:5])), np.arange(len(x)), k, block)
    for i, (best, sums) in enumerate(found):
        scores = x @ x[i]
        want = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-scores[j], j))[:k]
        assert best.tolist() == want and sums.tolist() == scores[want].tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab é\n", max_size=20), max_size=8), st.integers(1, 30))
def test_word_hashes_depend_on_the_word_only(texts, span):
    j = Joined(texts, ~quality._SPACE)
    words = [bytes(j.raw[b:e]) for b, e in zip(j.begin, j.end, strict=True)]
    assert words == [w for t in texts for w in t.encode().split()]
    hashes = segments(j.raw, j.begin, j.end, span)
    assert len(set(hashes.tolist())) == len(set(words)) and hashes.tolist() == segments(j.raw, j.begin, j.end).tolist()
    assert j.doc.tolist() == [i for i, t in enumerate(texts) for _ in t.split()]


SPACED = st.lists(st.one_of(st.sampled_from([" ", "  ", "▁", "\n", "\t", "the", "ing", "//", "----", "日本", "執", "😀", "\x00", "<s>", "<0x41>", "é", "e\u0301", " " * 9]), st.integers(259, 31999).map(lambda i: SP.id_to_piece(i).replace("▁", " "))), max_size=25).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.one_of(TEXT, SPACED), st.integers(1, 30))
def test_pieces_are_those_of_the_library(text, piece):
    want = SP.encode(text, add_bos=True, add_eos=True)
    got = np.frombuffer(PIECES.encode(text), "<u4")
    assert got.tolist() == want
    assert PIECES.encode(text, piece) == PIECES.encode(text)
    assert PIECES.decode(got) == SP.decode(want)


@settings(max_examples=300, deadline=None)
@given(st.text("abcthe▁", max_size=40))
def test_table_of_last_tokens_holds_every_prefix(text):
    """The table gives the encoding of every prefix, and it is that of merging step by step."""
    last = PIECES.last_tokens(text)
    for n in range(len(text) + 1):
        at, out = n, []
        while at:
            word = PIECES.text[last[at]]
            out.append(word)
            at -= len(word)
        assert out[::-1] == PIECES.merges(text[:n])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([0, 1, 2]), st.integers(3, 258), st.integers(259, 31999)), max_size=12))
def test_any_ids_decode_as_the_library_does(ids):
    assert PIECES.decode(np.array(ids, np.int64)) == SP.decode(ids)


@pytest.mark.parametrize(("axes", "bits"), [(2, 3), (3, 2), (2, 4), (4, 1), (8, 1)])
def test_the_curve_visits_every_cell_and_moves_one_step_at_a_time(axes, bits):
    cells = np.array(list(itertools.product(range(2**bits), repeat=axes)))
    keys = centroids.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(2 ** (axes * bits)))
    assert set(np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1).tolist()) == {1}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-6, 6), min_size=3, max_size=3), min_size=1, max_size=12), st.lists(st.lists(st.integers(-6, 6), min_size=3, max_size=3), min_size=1, max_size=9), st.sampled_from([1, 2**40]))
def test_the_nearest_centroid_is_never_pruned(vectors, middles, scale):
    v, c = np.array(vectors, np.int64) * scale, np.array(middles, np.int64) * scale
    left = centroids.candidates(v.min(0), v.max(0), c)
    best, d = centroids.nearest(v, c[left])
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c)) for x in v]
    assert [(int(e), int(left[b])) for b, e in zip(best, d, strict=True)] == want


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9), st.integers(1, 13), st.data())
def test_joint_descent_sums_every_pair(rows, columns, data):
    counts = np.array(data.draw(st.lists(st.lists(st.sampled_from([0, 0, 0, 1, 2, 50]), min_size=columns, max_size=columns), min_size=rows, max_size=rows)))
    row, column = np.nonzero(counts)
    sizes = counts.sum(axis=1)
    p = divergence.share(counts, sizes[:, None], columns)
    tree = divergence.Tree(row, column, rows, columns)
    got = divergence.pair_values(tree, row, column, p[row, column], divergence.share(np.zeros(rows, np.int64), sizes, columns), batch=5) if len(row) else None
    want = abs(p[:, None, :] - p[None, :, :]).sum(axis=2)
    if got is not None:
        assert np.array_equal(np.triu(got, 1), np.triu(want, 1))
    seen = {(int(x), int(y), int(z)) for kind, _, a, b, c in tree.descend(7) if kind == "cells" for x, y, z in zip(a, b, c, strict=True)}
    assert seen == {(x, y, z) for x in range(rows) for y in range(x + 1, rows) for z in range(columns) if counts[x, z] or counts[y, z]}


def test_shares_are_exact_beyond_64_bits():
    n = np.array([0, 3, 2**40], np.int64)
    assert divergence.share(n, np.array([2**41] * 3), 7).tolist() == [1 + 10**9 * (int(x) + 5) // (2**41 + 35) for x in n]

"""Each operator against a brute-force version, an exact round trip or held-out labels."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from shopcast.llm import centroids, dedup, divergence, licenses, mixing, packing, pieces, quality, simhash, tokens, topk, toxicity
from shopcast.llm import queries as registered
from shopcast.testing import compare, duck

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WHITE = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_oracle(spark, name):
    out = compare(name, registered.QUERIES[name](spark, SF), duck(SF), registered.ORACLES[name])
    assert out.ok, out.detail
    assert out.rows_spark


# -- mixing ------------------------------------------------------------------------

def _targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, stop at the bound, share what is over again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(w[s] for s in names if s not in full)
        t = {s: most * sizes[s] if s in full else left * w[s] / rest for s in names}
        over = {s for s in names if s not in full and t[s] > most * sizes[s]}
        if not over:
            return t
        full |= over


def _check_mix(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    sizes = {s: sum(r.size for r in g) for s, g in by.items()}
    want = _targets(sizes)
    for s, g in by.items():
        assert {r.source_size for r in g} == {sizes[s]}
        assert all(r.target == pytest.approx(want[s]) and r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in g)
        if sizes[s]:
            assert abs(sum(r.taken for r in g) - want[s]) <= max(r.size for r in g)
            expected = want[s] / sizes[s]
            assert all(int(expected) <= r.copies <= -(-expected // 1) for r in g)


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.plan(docs).collect()
    _check_mix(rows)
    words = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    assert {r.doc_id: r.size for r in rows} == words
    assert sorted(rows) == sorted(mixing.plan(docs.repartition(7)).collect())  # the order of the input doesn't matter
    taken = {r.doc_id: r.copies for r in rows if r.copies}
    assert {r.doc_id: r["count"] for r in mixing.mix(docs).groupBy("doc_id").count().collect()} == taken


def test_mixing_hot_source_and_bounds(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40), "z" if i % 3 else rng.choice(["a", "b", None, "é", "Z"])) for i in range(3000)]
    rows += [(9000 + i, "w " * 5, "tiny") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan(docs)
    _check_mix(plan.collect())
    assert "Python" not in plan._jdf.queryExecution().toString() and "Pandas" not in plan._jdf.queryExecution().toString()


# -- simhash -----------------------------------------------------------------------

def _fingerprint(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in WHITE else c for c in low).split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps, distance=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= distance:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    extra = [(10_000 + i, t) for i, t in enumerate(["A b c d", "É é ÀB Zz zz", "x", "", " \x0b\x0c", "A b C d", "a B c D", "\x1c a \x85 b"])]
    texts = [(r.doc_id, r.text) for r in docs] + extra
    got = sorted(simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    fps = [_fingerprint(t) for _, t in texts]
    assert [r.fingerprint for r in got] == [f"{x:016x}" for x in fps]
    assert [r.component_id for r in got] == [texts[i][0] for i in _components(fps)]


def test_simhash_dense_buckets(spark):
    """Chains of fingerprints, many in one bucket, which is cut into chunks."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        x = b
        for _ in range(rng.randint(0, 30)):
            x ^= 1 << rng.randrange(12) | 1 << rng.randrange(12) | 1 << rng.randrange(64)
            fps.add(x)
    fps |= {base[0] ^ i for i in range(600)}
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    links = [(r.u % 2**64, r.v % 2**64) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket=64).collect()]
    assert all((u ^ v).bit_count() <= 3 for u, v in links)
    place = {x: i for i, x in enumerate(fps)}
    want = _components(fps)
    from shopcast.llm.graph import components
    label = {r.node: r.label for r in components(spark.createDataFrame([(place[u], place[v]) for u, v in links], "u long, v long")).collect()}
    assert [label.get(i, i) for i in range(len(fps))] == want


# -- top-k -------------------------------------------------------------------------

def test_topk_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(900, 20)) * np.linspace(3, 0.1, 20), np.repeat(rng.integers(-2, 3, (5, 20)), 40, axis=0)])
    df = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    v = np.floor(256 * x.astype(np.float32).astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, len(x), 50):
        s = v @ v[q]
        order = sorted((j for j in range(len(x)) if j != q), key=lambda j: (-s[j], j))[:5]
        want += [(q, k + 1, j, int(s[j])) for k, j in enumerate(order)]
    for chunk, queries in ((16_384, 1024), (100, 3), (2, 30)):
        assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, chunk=chunk, queries=queries).collect())) == want


def test_topk_with_bars():
    rng = np.random.default_rng(2)
    x = rng.integers(-40, 40, (500, 24)).astype(np.float64)
    q, own, rank = x[:130], np.arange(130), np.arange(500)
    plain = list(topk.search(q, x, own, rank, 5))
    sums = q @ x.T
    sums[own, own] = -np.inf
    for i, (rows, found) in enumerate(plain):
        assert rows.tolist() == sorted(range(500), key=lambda j: (-sums[i, j], j))[:5] and found.tolist() == sums[i, rows].tolist()
    for shift in (-1.0, 0.0, 1.0):  # of the bars from the fifth product; rows that reach them stay
        bars = np.array([found[4] + shift for _, found in plain])
        for (rows, found), (kept, left), bar in zip(plain, topk.search(q, x, own, rank, 5, bars=bars), bars, strict=True):
            assert kept.tolist() == rows[found >= bar].tolist() and left.tolist() == found[found >= bar].tolist()


def test_topk_of_several_blocks_and_chunks(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(*[F.rand(i) for i in range(4)]).alias("embedding"))
    rows = topk.top_k(df, F.col("vec_id") % 50 == 0, chunk=500, queries=60)
    assert rows.groupBy("query_id").count().where("count = 5").count() == 60


# -- exact dedup -------------------------------------------------------------------

def test_cuckoo_index():
    index, live, rng = dedup.CuckooIndex(2), {}, random.Random(2)
    names = [f"{rng.getrandbits(256):064x}" for _ in range(3000)]
    names += [n[:20] + f"{rng.getrandbits(160):040x}" + n[60:] for n in names[:500]]  # same place and fingerprint, other digest
    for step in range(12_000):
        d = rng.choice(names)
        if rng.random() < 0.3:
            assert index.delete(d) == (live.pop(d, None) is not None)
        else:
            n, i = rng.randint(0, 5), rng.choice([None, rng.randrange(9)])
            index.add(d, 1, n, i)
            old = live.get(d)
            best = (n, i) if old is None or (-n, i is None, i or 0) < (-old[1], old[2] is None, old[2] or 0) else (old[1], old[2])
            live[d] = [1 + (old[0] if old else 0), *best]
        if step % 1000 == 0:
            assert {e[0]: e[1:] for e in index.entries()} == live
    assert {e[0]: e[1:] for e in index.entries()} == live and index.size == len(live)
    assert all(index.get(d) == [d, *live[d]] if d in live else index.get(d) is None for d in names)
    assert index.n_buckets > 2  # it grew


def test_index_update(spark):
    d = lambda rows: dedup.records(spark.createDataFrame(rows, "doc_id long, text string"))
    index = dedup.update(None, d([(1, "a b"), (2, "ab"), (3, "c")]))
    index = dedup.update(index, d([(0, "c"), (5, "e")]), deletes=d([(9, "a  b"), (9, "zz")]))
    assert sorted((r.keep_id, r.n) for r in index.collect()) == [(0, 2), (5, 1)]


# -- tokens and packing ------------------------------------------------------------

@pytest.fixture(scope="module")
def hf():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def _odd_texts():
    rng = random.Random(8)
    parts = ["the ", "Wörter ", "don't", "<|endoftext|>", "  ", "\n\n", "\t", "123,456", " ", " x", "日本語", "🙂", "'ll", "...", "\x00", "a" * 50, " " * 40, "é", "\x1c", "\x85", "İ", "<|endof", "text|>"]
    yield from ("", " ", "\n", "x" * 5000, " " * 5000, "ab " * 4000, "ab" * 4000 + " z", "<|endoftext|>" * 500)
    for _ in range(150):
        yield "".join(rng.choice(parts) for _ in range(rng.randint(1, 400)))


def test_ids_are_the_librarys(hf):
    enc = tokens.Encoder()
    assert enc.fast is not None
    for t in _odd_texts():
        assert enc.ids(t) == hf.encode(t, add_special_tokens=False).ids
    vocab = hf.get_vocab()
    byte = tokens._byte_letters()
    words = [bytes(byte[c] for c in w).decode("utf-8", "ignore") for w in vocab if w != "<|endoftext|>"]
    for w, e in zip(words, hf.encode_batch(words, add_special_tokens=False), strict=True):
        assert enc.fast.encode(w, allowed_special="all") == e.ids


def test_overlaps(hf):
    enc = tokens.Encoder()
    for t in _odd_texts():
        want = hf.encode(t, add_special_tokens=False).ids
        for chunk, overlap in ((7, 3), (64, 16), (500, 1)):
            assert enc.encode(t, chunk, overlap).tolist() == want


def test_token_counts(spark, hf):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(-1, "lang " * 20_000), (-2, "x" * 40_000), (-3, None)]
    got = {r.doc_id: r for r in tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, t), e in zip(rows, hf.encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True):
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), len(e.ids), len(e.ids) > 1024)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name):
    import public_tokenizers
    if name.endswith(".json"):
        from tokenizers import Tokenizer
        want = lambda t: Tokenizer.from_file(public_tokenizers.path(name)).encode(t, add_special_tokens=False).ids
    else:
        import sentencepiece
        want = lambda t: sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name)).encode(t)
    for t in ("Hello there, Wörld", "a b " * 50, ""):
        assert tokens.Encoder(name).encode(t, 20, 5).tolist() == want(t)


def _check_packing(pieces, texts, hf, capacity=1024):
    ids = {i: [*hf.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(ids)
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[i])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[i][at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[i])
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(by_seq) * capacity / sum(map(len, ids.values()))


def test_packing(spark, hf):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert _check_packing(packing.pack(docs).collect(), texts, hf) < 1.01
    assert _check_packing(packing.pack(docs.repartition(3), window=20_000).collect(), texts, hf) < 1.06
    with_ids = packing.pack(docs.limit(50), with_ids=True).collect()
    assert all(len(p.ids) == p.length for p in with_ids)


def test_packing_pads_the_same_in_any_number_of_partitions(spark, hf):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    tokens = sum(len(hf.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts.values())
    for n, window in ((64, packing.WINDOW), (16, 5000)):
        pieces = packing.pack(docs.repartition(n), window=window, with_ids=True).collect()
        used = _check_packing(pieces, texts, hf)
        assert all(len(p.ids) == p.length for p in pieces)
        second = {p.sequence_id for p in pieces if p.sequence_id >= packing.SECOND}
        tasks = len({s >> 33 for s in second})
        # All sequences but one of each task of the second pass are full.
        assert round(used * tokens / 1024) <= -(-tokens // 1024) + tasks - 1
        assert second and (window < packing.WINDOW or tasks == 1)


def test_assignment_is_balanced():
    rng = random.Random(4)
    lengths = [min(1023, 1 + int(rng.expovariate(1 / 150))) for _ in range(4000)]
    placed = packing.assign(lengths, 1024)
    room, cost = {}, {}
    for _, _, n, s, _ in placed:
        room[s] = room.get(s, 0) + n
        cost[s] = cost.get(s, 0) + n + n * n / 1024
    assert max(room.values()) <= 1024 and sum(room.values()) == sum(lengths) and len(room) == -(-sum(lengths) // 1024)
    assert len(placed) < 1.2 * len(lengths)  # few cuts
    in_order, at, fixed = {}, 0, {}
    for n in lengths:  # filled one after the other, for comparison
        while n:
            s, k = at // 1024, min(n, 1024 - at % 1024)
            fixed[s] = fixed.get(s, 0) + k + k * k / 1024
            at, n = at + k, n - k
    assert np.std(list(cost.values())) < np.std(list(fixed.values()))
    assert in_order == {}


# -- toxicity and quality ----------------------------------------------------------

def test_block_max_index():
    rng = random.Random(6)
    vec = lambda: (lambda v: {t: w / sum(x * x for x in v.values()) ** 0.5 for t, w in v.items()})({rng.randrange(30): rng.choice([1.0, 2.0, 0.5]) for _ in range(rng.randint(1, 5))})
    vectors = [vec() for _ in range(500)]
    index = toxicity.BlockMaxIndex(vectors, block=16)
    for _ in range(200):
        q = vec()
        sims = [round(sum(w * v.get(t, 0.0) for t, w in q.items()), 12) for v in vectors]
        want = sorted((i for i, s in enumerate(sims) if s > 0), key=lambda i: (-sims[i], i))[:15]
        got = index.search(q, 15)
        assert [i for i, _ in got] == want and np.allclose([s for _, s in got], [sims[i] for i in want])


def _learned(spark, n=1500):
    """Texts of which those with a word of ``bad`` are toxic; copies of one clean and one toxic text."""
    rng = random.Random(9)
    bad, plain = ["grobian", "schuft", "lump"], ["wort" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(3, 80))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(bad).upper() + rng.choice(["", "!", "**"]))
        rows.append((i, " ".join(words), int(toxic)))
    rows += [(n + i, "an innocent text with rare words zufall beispiel", 0) for i in range(100)]
    rows += [(2 * n + i, "a copied text with curious terms kurios seltsam grobian", 1) for i in range(100)]
    return spark.createDataFrame(rows, "doc_id long, text string, y int")


def test_toxicity_held_out(spark):
    data = _learned(spark)
    got = toxicity.scores(data, data.where("doc_id % 2 = 0").select("doc_id", "y")).join(data, "doc_id").collect()
    held = [r for r in got if r.doc_id % 2]
    assert np.mean([r.predicted == r.y for r in held]) > 0.99
    assert abs(np.mean([r.score for r in held]) - np.mean([r.y for r in held])) < 0.03
    assert all(r.evidence and r.evidence[0].cosine > 0 for r in held if r.predicted)
    clean = spark.createDataFrame([(1, "kurios seltsam terms curious"), (2, "")], "doc_id long, text string")
    model, _ = toxicity.fit(data, data.select("doc_id", "y"))
    assert {"grobian", "schuft", "lump"} <= set(model.terms) and "kurios" not in model.terms  # copies are counted once
    assert toxicity.reject(data, data.select("doc_id", "y")).where("y = 1").count() == 0
    assert clean.where(toxicity.score(clean, model, F.col("text")) < 0.5).count() == 2


def test_toxicity_copies_and_rare_insults(spark):
    rng = random.Random(21)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    text = lambda n=60: [rng.choice(plain) for _ in range(n)]
    rows = [(i, " ".join(text()), 0) for i in range(900)]
    rows += [(1000 + i, " ".join([*text(), rng.choice(["grobian", "schuft"])]), 1) for i in range(100)]
    alone = [(2000 + i, " ".join(text()), 1) for i in range(3)]  # toxic by no word of their own
    rare = [(3000 + i, " ".join([*text(30), "zwiderwurz", *text(30)]), 1) for i in range(3)]
    han = [(4000 + i, "".join(chr(0x4e00 + rng.randrange(900)) for _ in range(40)) + "\u767d\u75f4", 1) for i in range(3)]
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows + alone + rare + han], "doc_id long, y int")
    near = [(5000 + i, " ".join(w if j % 8 else "other" + str(j) for j, w in enumerate(t.split())), 1) for i, (_, t, _) in enumerate(alone)]
    held = [(6000, " ".join([*text(), "ZWIDERWURZ!"]), 1), (6001, "".join(chr(0x5e00 + i) for i in range(40)) + "\u767d\u75f4", 1), *((7000 + i, t, 1) for i, (_, t, _) in enumerate(alone)), *near]
    held += [(8000 + i, " ".join(text()), 0) for i in range(50)] + [(9000, rows[5][1] + " more", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows + alone + rare + han + held], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.scores(docs, labels).collect()}
    assert [d for d, _, y in rows + alone + rare + han + held if got[d].predicted != y] == []
    for i in range(3):
        assert got[7000 + i].evidence[0][:3] == (2000 + i, 1, 1.0) and got[5000 + i].evidence[0].doc_id == 2000 + i
    assert {r.doc_id for r in toxicity.reject(docs, labels).collect()} == {d for d, r in got.items() if not r.predicted}


def test_toxicity_stage_recall(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in registered.op8_toxicity(spark, SF).collect()}
    toxic = [r.doc_id for r in labels.where("toxic = 1").collect()]
    assert all(got[d].predicted for d in toxic if not got[d].held_out)
    assert np.mean([got[d].predicted for d in toxic if got[d].held_out]) > 0.6  # two of six hold no insult and have no labelled copy
    rng = random.Random(23)
    clean = [r for r in docs.join(labels.where("toxic = 0"), "doc_id", "left_semi").where("length(text) > 800").orderBy("doc_id").collect()]
    pool = [w for r in clean for w in r.text.split()]
    planted = [(10**6 + i, rng.sample(pool, 150)) for i in range(4)]  # toxic by no single word
    planted += [(10**6 + 10 + i, [*rng.sample(pool, 60), "zwiderwurz", *rng.sample(pool, 60)]) for i in range(5)]
    near = [(2 * 10**6 + d, [x if j % 10 else "changed" + str(j) for j, x in enumerate(w)]) for d, w in planted[:4]]
    rare = [(3 * 10**6, [*rng.sample(pool, 150), "Zwiderwurz!"])]
    more = spark.createDataFrame([(d, " ".join(w)) for d, w in [*planted, *[(4 * 10**6 + d, w) for d, w in planted], *near, *rare]], "doc_id long, text string")
    labels.select("doc_id", "toxic").union(spark.createDataFrame([(d, 1) for d, _ in planted], "doc_id long, toxic int")).write.parquet(f"{tmp_path}/labels.parquet")
    every = docs.unionByName(more.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("x").alias("source"), F.length("text").cast(dict(docs.dtypes)["n_chars"]).alias("n_chars")))
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, every, str(tmp_path)).collect()}
    assert kept & {r.doc_id for r in more.collect()} == set() and kept & set(toxic) == set()
    assert {r.doc_id for r in labels.where("toxic = 0").collect()} <= kept


def test_a_labelled_id_that_repeats_is_one_example(spark):
    data = _learned(spark, 300)
    labels, again = data.select("doc_id", "y"), data.where("doc_id = 7").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("n")
    assert toxicity.fit(data.union(again), labels)[0].copies.n == labels.count()
    models = [quality.fit(d, labels) for d in (data, data.union(again))]
    assert (models[0].weights == models[1].weights).all()


def test_copy_index_against_brute_force():
    rng = random.Random(22)
    texts = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(400)]
    texts += [[w for w in t if rng.random() > 0.2] for t in texts]
    held = [toxicity.hashed(toxicity.Counter(t)) for t in texts]
    table = pa.table({"doc_id": range(500), "y": pa.array([0] * 500, pa.int32()), "sketch": range(500), "words": [h.tobytes() for h, _ in held[:500]], "n": [zlib.compress(n.tobytes()) for _, n in held[:500]]})
    index = toxicity.CopyIndex(toxicity.Examples(table), 0.7)
    df = toxicity.Counter(w for t in texts[:500] for w in set(t))
    def vector(t):
        v = {w: (1 + np.log(n)) * (np.log(501 / (1 + df[w])) + 1) for w, n in toxicity.Counter(t).items()}
        return {w: x / sum(y * y for y in v.values()) ** 0.5 for w, x in v.items()}
    vectors = [vector(t) for t in texts]
    for q, h in zip(vectors, held, strict=True):
        cos = [sum(x * v.get(w, 0.0) for w, x in q.items()) for v in vectors[:500]]
        got = {d: c for i, c in index.search(*h) for d, _ in index.rows[i]}
        assert got.keys() == {i for i, c in enumerate(cos) if c >= 0.7} and all(abs(cos[i] - c) < 1e-5 for i, c in got.items())


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = registered.op5_quality_classifier(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert docs.count() == registered.op5_quality_classifier(spark, SF).count()


def test_toxicity_query(spark):
    got = registered.op8_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.9
    assert not [r for r in got if r.predicted and not r.toxic]


def test_long_texts_are_read_in_pieces(monkeypatch):
    from shopcast.llm import common
    rng = random.Random(3)
    text = " ".join(rng.choice(["Ab", "cd\n", "x" * 30, "é!", "trash"]) for _ in range(3000)) + " \x0b"
    monkeypatch.setattr(common.text_pieces, "__defaults__", (1 << 40,))
    whole = simhash.fingerprint(text), quality.counts(text), list(toxicity.words(text))
    assert whole[0] == _fingerprint(text)
    for size in (1, 50, 1000):
        monkeypatch.setattr(common.text_pieces, "__defaults__", (size,))
        pieces = list(common.text_pieces(text))
        assert "".join(pieces) == text and len(pieces) > 3
        assert simhash.fingerprint(text) == whole[0] and list(toxicity.words(text)) == whole[2]
        ids, n = quality.counts(text)
        same = (whole[1][0] > 0).sum()  # all but bucket 0, the word that comes again
        assert ids[ids > 0].tolist() == whole[1][0][whole[1][0] > 0].tolist() and len(ids[ids > 0]) == same
        assert n[ids > 0].tolist() == whole[1][1][whole[1][0] > 0].tolist()


def test_features_of_joined_texts_are_those_of_each():
    texts = ["One two two\nthree", "", None, " a  b ", "ünï cödé", "x" * 300]
    model = quality.Model(np.random.default_rng(0).normal(size=quality.BUCKETS + 1).astype(np.float32), -0.5)
    alone = [model.logits([t])[0] for t in texts]
    assert np.allclose(model.logits(texts), alone) and alone[1] == alone[2] == -0.5
    ids, n = quality.counts(texts[0])
    assert np.isclose(alone[0], -0.5 + (model.weights[ids] @ n) / n.sum() + model.weights[-1])


# -- licenses ----------------------------------------------------------------------

def test_licenses(spark):
    rng = random.Random(12)
    words = [w for t in licenses.TEMPLATES.values() for w in t.split()] + [f"w{i}" for i in range(100)]
    texts, planted = [], []
    for i in range(300):
        parts = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            name = rng.choice(sorted(licenses.TEMPLATES))
            at = rng.randint(0, len(parts))
            notice = licenses.TEMPLATES[name].split()
            if len(notice) > 30 and i % 2:
                notice[rng.randrange(len(notice))] = "CHANGED"
            parts[at:at] = notice
            planted.append((i, name))
        texts.append(" ".join(parts).upper() if i % 5 == 0 else " \n".join(parts))
    texts += ["", None, "y" * 100_000]
    library = licenses.Library(licenses.TEMPLATES)
    every = library.scan(texts, exhaustive=True)
    assert library.scan(texts) == every
    assert [m[0:2] for i in range(len(texts)) for m in [(i, *x[1:]) for x in library.scan([texts[i]])]] == [m[0:2] for m in every]
    assert {(d, n) for d, n, *_ in every} >= {p for p in planted}
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == every
    for r in got[:50]:
        assert licenses.Shingles([(texts[r.doc_id]).encode()[r.begin_byte:r.end_byte].decode()]).words.size >= 4  # an SPDX line has four words


def test_licenses_do_not_depend_on_windows():
    rng = random.Random(31)
    library, every = licenses.Library(licenses.TEMPLATES), licenses.TEMPLATES
    notice = every["Apache-2.0-header"].split()
    edited = notice[:15] + [f"new{i}" for i in range(12)] + notice[15:]
    for before in range(70):  # all places in the windows
        text = " ".join([f"w{i}" for i in range(before)] + edited + ["end"])
        got = [m for m in library.scan([text]) if m[1] == "Apache-2.0-header"]
        assert len(got) == 1 and got[0][2] == 23 / 27 and text[got[0][3]:got[0][4]] == " ".join(edited)
        assert [(0, *m[1:]) for m in library.scan(["x " * before, text]) if m[1] == "Apache-2.0-header"] == got
    assert [m[1] for m in library.scan([" ".join(notice + notice + ["and"] + notice)])].count("Apache-2.0-header") == 3
    for _ in range(60):  # a brute force over the whole text: which templates it holds
        name = rng.choice(sorted(every))
        words = every[name].split()
        for _ in range(rng.randint(0, 2)):
            words.insert(rng.randrange(len(words)), " ".join(["more"] * rng.randint(1, 12)))
        words = " ".join([f"w{i}" for i in range(rng.randint(0, 90))] + words).split()
        plain = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
        want = set()
        for other, text in every.items():
            n = min(5, len(plain(text)))
            own, there = ({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} for w in (plain(text), plain(" ".join(words))))
            if len(own & there) / len(own) >= 0.8:
                want.add(other)
        assert {m[1] for m in library.scan([" ".join(words)])} == want


# -- pipeline ----------------------------------------------------------------------

def test_pipeline_against_brute_force(spark, hf, tmp_path):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{n}")
        before, docs = docs.collect(), spark.read.parquet(f"{tmp_path}/{n}")
        rows = docs.collect()
        if name != "packing":
            assert docs.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]
            assert set(rows) <= set(before)
        kept[name] = {r.doc_id for r in rows}
        if name == "toxicity":
            toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic == 0}
            assert toxic & {r.doc_id for r in before} <= kept[name]  # clean ones stay
        if name == "exact_dedup":
            best = {}
            for r in sorted(before, key=lambda r: (-len(r.text), r.doc_id)):
                best.setdefault("".join(c for c in r.text if c not in WHITE), r.doc_id)
            assert kept[name] == set(best.values()) and len(rows) == len(best)
        if name == "simhash_near_dedup":
            order = sorted(before, key=lambda r: r.doc_id)
            comp = _components([_fingerprint(r.text) for r in order])
            assert kept[name] == {order[i].doc_id for i in set(comp)} and len(rows) == len(set(comp))
        if name == "source_mixing":
            plan = {r.doc_id: r.copies for r in mixing.plan(spark.read.parquet(f"{tmp_path}/{n - 1}")).collect()}
            _check_mix(mixing.plan(spark.read.parquet(f"{tmp_path}/{n - 1}")).collect())
            assert len(rows) == sum(plan.values())
        if name == "packing":
            assert sum(r.length for r in rows) == sum(len(hf.encode(r.text, add_special_tokens=False).ids) + 1 for r in before)
            seqs = {}
            for r in rows:
                seqs[r.sequence_id] = seqs.get(r.sequence_id, 0) + r.length
            assert max(seqs.values()) <= 1024
    final = corpus_pipeline.run(spark, SF)
    assert final.count() == docs.count()


# -- centroid clustering -----------------------------------------------------------

def _lloyd(vectors, k, rounds, scale=1024, seed=3):
    x = [(i, [int(np.floor(scale * np.float64(np.float32(c)))) for c in v]) for i, v in vectors]
    c = [v for _, v in sorted(x, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in x]
        c = [[sum(col) // of.count(j) for col in zip(*(v for (_, v), z in zip(x, of, strict=True) if z == j), strict=True)] if j in of else m for j, m in enumerate(c)]
    return sorted((i, *nearest(v)[::-1], hashlib.sha256(",".join(map(str, c[nearest(v)[1]])).encode()).hexdigest()) for i, v in x)


@pytest.mark.parametrize("spread", [0.02, 2.0])
def test_centroids_brute_force(spark, spread):
    """Grouped vectors, where boxes settle most blocks, and scattered ones; a third of the rows is one vector."""
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(6, 5)) * 3
    x = np.concatenate([m + rng.normal(size=(60, 5)) * spread for m in middles] + [np.repeat(middles[:1], 180, axis=0)])
    vectors = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(5)
    got = centroids.cluster(df, k=7, rounds=4, dims=5).collect()
    assert sorted((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got) == _lloyd(vectors, 7, 4)
    for c in {r.cluster for r in got}:
        assert {r.cluster_inertia for r in got if r.cluster == c} == {sum(r.distance for r in got if r.cluster == c)}
    table = centroids.blocks(topk.scaled(df, 1024), 5, 16).collect()
    assert sum(r.n for r in table) == len(x) and all(r.n <= 16 for r in table)
    left = [len(centroids.candidates(np.array(r.lo), np.array(r.hi), np.floor(1024 * middles).astype(np.int64))) for r in table]
    if spread < 1:
        assert np.mean(left) < 2


# -- sentencepiece -----------------------------------------------------------------

def test_pieces_of_whole_documents(spark):
    import public_tokenizers
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    texts |= {10_000: "日本執" * 40_000, 10_001: "a" * 300_000, 10_002: " " * 5000 + "x", 10_003: ("wörd " * 100_000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ids = {i: sp.encode(t, add_bos=True, add_eos=True) for i, t in texts.items()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.round_trip(docs).collect()}
    assert got == {i: (len(x), sha(np.array(x, "<u4").tobytes()), sha(sp.decode(x).encode())) for i, x in ids.items()}
    encoded = pieces.encode(docs)
    assert {r.doc_id: r.ids for r in encoded.collect()} == ids
    assert {r.doc_id: r.text for r in pieces.decode(encoded).collect()} == {i: sp.decode(x) for i, x in ids.items()}


# -- source divergence -------------------------------------------------------------

def _audit(rows, min_docs, top=50):
    def words(t):
        return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    docs = [(g or "", s or "", words(t)) for t, g, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = [t for t in {t for d in mine for t in d[2]} if sum(t in d[2] for d in mine) >= min_docs]
        count = {s: {t: sum(d[2].count(t) for d in mine if d[1] == s) for t in kept} for s in {d[1] for d in mine}}
        whole = {t: sum(c[t] for c in count.values()) for t in kept}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        ps, q = {s: p(c) for s, c in count.items()}, p(whole)
        for s in ps:
            pairs = sorted((-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode()) for o in ps if o != s)
            lead = sorted((q[t] - ps[s][t], t.encode()) for t in kept if count[s][t] and ps[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, n) for part, g in (("pair", pairs), ("term", lead)) for n, (v, i) in enumerate(g, 1)]
    return sorted(out)


@pytest.mark.parametrize(("rows", "columns"), [(512, 4096), (3, 7)])
def test_divergence_brute_force(spark, rows, columns):
    """In one tile and in many bands and slices; one source has a third of the rows, some have one without terms."""
    rng = random.Random(4)
    vocabulary = ["a", "B", "éa", "Éa", "ÀZz", "日本", "x" * 300, *(f"w{chr(97 + i)}" for i in range(26))]
    data = []
    for i in range(600):
        source = "hot" if i % 3 == 0 else rng.choice(["s1", "s2", "é", "Z", None, "s10", "s3", "s4"])
        text = None if i % 50 == 1 else rng.choice([" ", "7", "\n", "--"]).join(rng.choice(vocabulary[:rng.randint(2, len(vocabulary))]) for _ in range(rng.randint(0, 30)))
        data.append((text, rng.choice(["en", "en", "de", None]), source))
    data += [("", "en", "empty"), ("alone once", "fr", "one"), (None, "fr", "two")]
    df = spark.createDataFrame(data, "text string, lang string, source string").repartition(6)
    got = sorted(tuple(r) for r in divergence.audit(df, min_docs=10, rows=rows, columns=columns).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == _audit(data, 10)
    assert any(r[2] == "term" for r in got) and any(r[0] == "fr" and r[4] == 0 for r in got)


def test_divergence_passes_counts_on_when_a_task_holds_many(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = sorted(divergence.term_counts(docs).collect())
    assert sorted(divergence.term_counts(docs, 100).collect()) == want
    assert divergence.terms("Aé b1C\x00日") == ["aé".encode(), b"b", b"c", "日".encode()]
    small = spark.createDataFrame([(t, "en", "s") for t in ("one two one", "Two three", None)], "text string, lang string, source string").coalesce(1)
    assert sorted((r.term, r.n, r.docs) for r in divergence.term_counts(small).collect()) == [("", 0, 0), ("one", 2, 1), ("three", 1, 1), ("two", 2, 2)]
    assert len(want) == len({(r.lang, r.source, r.term) for r in want})


def test_plain_notices_are_found(spark):
    """Notices as projects write them, among other words; each is found by its license, and nothing in the words alone."""
    notices = {"Licensed under the GNU Lesser General Public License": "LGPL", "SPDX-License-Identifier: MIT": "MIT", "Released under the BSD 2-Clause License.": "BSD-2-Clause",
               "This is free and unencumbered software released into the public domain.": "Unlicense", "Licensed under the MIT license": "MIT", "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
               "under the terms of the GNU Affero General Public License": "AGPL", "Licensed under CC BY-SA 4.0": "CC-BY-SA", "distributed under the ISC license": "ISC",
               "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA", **{t: k for k, t in licenses.NOTICES.items()}}
    rows = [(2 * i + j, f"alpha beta gamma {t} delta epsilon" if j else "alpha beta gamma under the terms agreed, released in public delta") for i, t in enumerate(notices) for j in (0, 1)]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    for i, (t, name) in enumerate(notices.items()):
        assert any(g.startswith(name) for g in got.get(2 * i + 1, ())), t
        assert 2 * i not in got


def _quality_features(text):
    """Buckets of a text by the method's words: words, repeated words, and 3- to 5-grams of code points of each word between blanks."""
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]", text or "") if w]

    def of_word(w):
        h = (sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 2**64) for i, b in enumerate(w.encode())) + len(w.encode())) % 2**64
        h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 % 2**64
        return (h ^ (h >> 29)) % quality.BUCKETS

    def of_gram(g):
        h = len(g)
        for c in g:
            h = (h * 0x01000193 % 2**32) ^ int.from_bytes(c.encode(), "little")
        return (h * 0x85EBCA6B % 2**32) >> 16

    out = [of_word(w) for w in words] + [0 for a, b in zip(words, words[1:], strict=False) if a == b]
    return out + [of_gram(f" {w} "[i:i + n]) for w in words for n in (3, 4, 5) for i in range(len(w) + 3 - n)]


def test_quality_brute_force():
    """Features and logits rebuilt from the method's text alone, in scripts of one to four bytes a character."""
    rng = random.Random(2)
    letters = ["a", "b", "Z", "é", "ß", "日", "本", "語", "😀", "𝄞", "\x00", "\u2003"]
    texts = ["", None, " \n", "a", "日本語 日本語", "one one two"] + [rng.choice([" ", "  ", "\n", "\t\x0b"]).join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    weights = np.random.default_rng(1).normal(size=quality.BUCKETS + 1).astype(np.float32)
    got = quality.Model(weights, -0.7).logits(texts)
    for t, z in zip(texts, got, strict=True):
        f = _quality_features(t)
        assert z == pytest.approx(-0.7 + (float(np.mean(weights[f].astype(float))) + float(weights[-1]) if f else 0.0), abs=1e-6)
        ids, n = quality.counts(t)
        assert dict(zip(ids.tolist(), n.tolist(), strict=True)) == {b: f.count(b) for b in set(f)}
    assert len(_quality_features("日本語")) == 1 + 3 + 2 + 1


def test_toxicity_reject_reads_texts_as_arrow_arrays(spark):
    """A batch's texts stay in Arrow and become Python strings one at a time; as a pandas series all of them would be strings at once."""
    from pyspark.util import PythonEvalType

    docs = spark.createDataFrame([(i, f"word{i % 3} vile thing" if i % 2 else None) for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(12)], "doc_id long, y int")
    out = toxicity.reject(docs, labels)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert f"], {PythonEvalType.SQL_SCALAR_ARROW_UDF}" in plan
    kept = {r.doc_id for r in out.collect()}
    assert kept <= set(range(12)) and kept == {r.doc_id for r in toxicity.scores(docs, labels).where("score < 0.5").collect()}

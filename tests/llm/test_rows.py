"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shopcast.llm import centroids, chat, dedup, divergence, licenses, mixing, packing, pieces, quality, simhash, tokens, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `__id` string, Label int, copies int, kept string, `a.b` array<map<string,int>>"
LONG = "word " * 30_000 + "x" * 5000
ROWS = [(1, "Same text here", "en", "a"), (2, "Same  text\there", "en", "a"), (3, None, None, None), (4, "", "en", "b"), (None, "no id at all", "en", "b"),
        (None, None, None, None), (5, LONG, "en", "a"), (6, " \n\t ", "en", None), (7, "one", "en", "c"), (7, "one", "en", "c"), (7, "two", "en", "c"), (8, "Same text here", "en", "d")]


def _docs(spark, rows):
    return spark.createDataFrame([(*r, None, "clash", 1, 2, "x", [{"k": 1}]) for r in rows], SCHEMA)


def _labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, y int")


OPERATORS = {
    "mixing": lambda s, d: mixing.plan(d), "mix": lambda s, d: mixing.mix(d), "simhash": lambda s, d: simhash.near_duplicates(d), "simhash_keep": lambda s, d: simhash.keep_one(d),
    "quality": lambda s, d: quality.scores(d, _labels(s, [(1, 1), (7, 0), (99, 1)])), "quality_unlabelled": lambda s, d: quality.scores(d, _labels(s)),
    "dedup": lambda s, d: dedup.groups(d), "dedup_keep": lambda s, d: dedup.keep_unique(d), "packing": lambda s, d: packing.pack(d, with_ids=True),
    "toxicity": lambda s, d: toxicity.scores(d, _labels(s, [(1, 1), (7, 0), (99, 1)])), "toxicity_unlabelled": lambda s, d: toxicity.scores(d, _labels(s)), "reject": lambda s, d: toxicity.reject(d, _labels(s, [(1, 1), (7, 0)])),
    "tokens": lambda s, d: tokens.count_tokens(d), "licenses": lambda s, d: licenses.scan(d),
    "pieces": lambda s, d: pieces.round_trip(d), "pieces_ids": lambda s, d: pieces.decode(pieces.encode(d)), "divergence": lambda s, d: divergence.audit(d), "divergence_all": lambda s, d: divergence.audit(d, min_docs=1),
}
PER_ROW = {"mixing", "simhash", "quality", "quality_unlabelled", "dedup", "toxicity", "toxicity_unlabelled", "tokens", "pieces", "pieces_ids"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = _docs(spark, ROWS)
    out = OPERATORS[name](spark, docs)
    rows = out.collect()
    if name in PER_ROW:
        assert len(rows) == len(ROWS)
    if name in ("mix", "simhash_keep", "dedup_keep", "reject"):
        assert out.schema.names == docs.schema.names
    if name == "dedup_keep":  # texts without white space: same, "", no id, long, one, two
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 2), (False, 5), (False, 6), (False, 7), (False, 7), (True, 0)]
    if name == "dedup":
        assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows if r.doc_id in (1, 2, 8)} == {(1, 2, 3, False), (2, 2, 3, True), (8, 2, 3, False)}
        assert {(r.doc_id, r.keep_id, r.group_size) for r in rows if r.group_size == 4} == {(3, 6, 4), (4, 6, 4), (6, 6, 4), (None, 6, 4)}
    if name == "simhash":
        assert {r.fingerprint for r in rows if r.doc_id in (3, 4, 6)} == {"0" * 16}
        assert {r.component_id for r in rows if r.doc_id in (1, 2, 8)} == {1}
    if name == "tokens":
        assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (3, 4)} == {(3, 0, 0), (4, 0, 0)}
        assert [r.over_limit for r in rows if r.doc_id == 5] == [True]
    if name == "pieces":
        assert {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {2} and all(r.same for r in rows)
    if name == "pieces_ids":
        assert sorted((r.doc_id or 0, r.text) for r in rows) == sorted((r[0] or 0, r[1] or "") for r in ROWS)
    if name == "divergence":  # no term is in 30 documents
        assert {(r.lang, r.source, r.item, r.value) for r in rows if r.source == "a"} == {("en", "a", s, 0) for s in ("b", "", "c", "d")}
        assert {r.part for r in rows} == {"pair"} and [r.item for r in sorted(rows, key=lambda r: r["rank"]) if r.source == "a"] == ["", "b", "c", "d"]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, _docs(spark, [])).collect() == []


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (7, 0, 0), (8, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (ROWS, []):
        docs = _docs(spark, rows)
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{len(rows)}_{n}"
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            again = spark.read.parquet(path)
            if n < len(corpus_pipeline.STAGES) - 1:
                assert again.schema.names == docs.schema.names, name
            docs = again
        assert (docs.count() > 0) == bool(rows)


def test_chat_rows(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (3, 1, "assistant", "yes"), (4, 0, "user", None), (5, None, None, "late"), (5, 0, "user", "hi"),
             (None, 0, "user", "alone"), (6, 0, "user", "h" * 100_000), (7, 1, "user", "tie b"), (7, 1, "user", "tie a")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, TURNS string")
    out = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert set(out) == {1, 4, 5, None, 6, 7}
    assert out[1].n_copies == 2
    assert out[1].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    assert [out[1].text[s.begin:s.end] for s in out[1].spans] == ["hi", "yes"]
    assert [t.text for t in out[5].turns] == ["hi", "late"]
    assert sorted(t.text for t in out[7].turns) == ["tie a", "tie b"]
    assert chat.format_chats(df.limit(0)).collect() == []


def test_topk_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(50, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0]), (8, [0.5, 0.25, 9.0]), (50, [1.0, 0.5]), (None, [2.0, 2.0]), (9, [-1.0, -1.0]), (0, None)]
    df = spark.createDataFrame([(*v, "x", 1) for v in vectors], "vec_id long, embedding array<float>, score string, uid int")
    rows = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    one = [(None, 2 * 256 * 384), (1, 256 * 256 + 128 * 128), (50, 256 * 256 + 128 * 128), (7, 256 * 256), (8, 256 * 128 + 128 * 64)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rows) == sorted((50, i + 1, *x) for i, x in enumerate(one) for _ in range(2))
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    huge = spark.createDataFrame([(0, [3e30, 1.0]), (1, [3e30, 1.0]), (2, [-3e30, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in topk.top_k(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63))]


def test_centroid_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [1.0]), (8, [0.5, 0.25, 9.0]), (None, [-2.0, -2.0]), (9, [-1.0, -1.0]), (9, [-1.0, 1.0])]
    df = spark.createDataFrame([(*v, "x", 1) for v in vectors], "vec_id long, embedding array<float>, cluster string, uid int")
    rows = centroids.cluster(df, k=3, dims=2).collect()
    assert sorted((r.vec_id or 0) for r in rows) == [0, 1, 1, 9, 9]
    assert {r.inertia for r in rows} == {sum(r.distance for r in rows)}
    assert centroids.cluster(df.limit(0), dims=2).collect() == []
    assert centroids.cluster(df, dims=5).collect() == []
    few = centroids.cluster(df, k=8, dims=2).collect()  # fewer vectors than clusters: all are starts
    assert {r.distance for r in few} == {0} and len({r.cluster for r in few}) == 4
    huge = spark.createDataFrame([(0, [3e30, 1.0]), (1, [3e30, 1.0]), (2, [-3e30, 1.0]), (3, [-3e30, 1.0])], "vec_id long, embedding array<float>")
    assert {r.distance for r in centroids.cluster(huge, k=1, dims=2).collect()} <= {2**63 - 1} and len(centroids.cluster(huge, k=2, dims=2).collect()) == 4

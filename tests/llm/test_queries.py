"""Queries against SQL, and every operator on odd and empty tables."""

import pytest
from pyspark.sql import functions as F

from pagemill.llm import dac, divergence, langid, mixing, ordinal, pii, simhash, suffix, topk, transducer
from pagemill.llm.queries import ORACLES, PIECES, QUERIES, WORDS, key_for_checks
from tests.conftest import normal

ALL = {
    "op1": mixing.mixed, "op2": langid.language_id, "op3": lambda d: pii.pseudonymised(d, "k"), "op4": divergence.quality, "op6": suffix.score,
    "op7": simhash.near_duplicates, "op8": lambda d: dac.roundtrip(d, WORDS), "op9": lambda d: transducer.encoded(d, PIECES),
}
STAGES = {"op1": mixing.sampled, "op3": lambda d: pii.in_place(d, "k"), "op4": divergence.keep_good, "op7": simhash.keep_one}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir, duck):
    assert normal(QUERIES[name](spark, sf_dir).toPandas()) == normal(duck.execute(ORACLES[name]).df())


def test_all_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}


@pytest.mark.parametrize("name", sorted(ALL))
def test_odd_rows(name, odd_docs):
    rows = ALL[name](odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert sorted(r.doc_id or 0 for r in rows) == [0, 0, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    by = {r.doc_id: r for r in rows}
    if name == "op2":
        assert (by[2].lang_pred, by[2].score) == ("und", 0.0) and by[5].lang_pred == "und" and all(0 <= r.score <= 1 for r in rows)
    if name == "op4":
        assert by[2].n_words == by[3].n_words == by[5].n_words == 0 and by[4].n_words == 180_000 and by[4].base_failed and not by[2].kept
    if name == "op6":
        assert by[2].n_tokens == by[5].n_tokens == 1 and by[4].n_tokens == 180_001
    if name == "op7":
        assert by[2].fingerprint == by[5].fingerprint == "0" * 16 and by[5].component_id == 2
    if name == "op8":
        assert by[2].n_tokens == 1
    if name == "op9":
        assert by[2].decoded == "" and by[6].decoded == "漢字 😀 \U0001f600 é"


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_table(name, no_docs, odd_docs):
    out = ALL[name](no_docs)
    assert out.count() == 0 and out.columns == ALL[name](odd_docs).columns


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_keep_columns(name, odd_docs, no_docs):
    out = STAGES[name](odd_docs)
    assert out.columns == odd_docs.columns and out.filter("topic <> '<topic>' or __q <> '<__q>'").count() == 0
    assert STAGES[name](no_docs).count() == 0


def test_ordinal_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 1, 0), (8, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    assert ordinal.classify(odd_docs, labels).count() == 11
    assert ordinal.classify(odd_docs, labels.limit(0)).filter("kept or grade is not null").count() == 0
    assert ordinal.classify(no_docs, labels).count() == 0


def test_top_k_odd(spark):
    rows = [(20, [1.0, float("nan")]), (40, None), (60, [1.0, None]), (None, [1.0, 1.0]), (80, [1.0, 2.0]), (80, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [1.0]), (4, []), (100, [1e9, 1e9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(c) for c in ("id", "v", "n", "ids", "score", "rank", "query_id")})
    got = topk.top_k(df, lambda i: i % 20 == 0, 3).filter("query_id = 80").orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 100), (2, 1), (3, 2)]
    assert topk.top_k(df.limit(0), lambda i: i % 20 == 0, 3).count() == 0
    assert topk.top_k(df, lambda i: i < 0, 3).count() == 0


def test_top_k_of_repeated_ids(spark):
    """An id counts once, with its best score, as query and as candidate; equal scores go to the smaller id."""
    import numpy as np

    rng = np.random.default_rng(9)
    rows = [(int(i), rng.integers(-3, 4, 5).astype(float).tolist()) for i in rng.integers(0, 60, 400)]
    rows += rows[:50] + [(20, [1.0] * 5)] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = {}
    for q, x in rows:
        if q % 20 == 0:
            for d, y in rows:
                if d != q:
                    s = sum(int(64 * a) * int(64 * b) for a, b in zip(x, y))
                    want.setdefault(q, {})[d] = max(s, want.get(q, {}).get(d, s))
    got = {}
    for r in topk.top_k(df, lambda i: i % 20 == 0, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: sorted(found.items(), key=lambda f: (-f[1], f[0]))[:7] for q, found in want.items()}


def test_queries_over_whole_tables(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name, q in QUERIES.items():
        if name.split("_")[0] not in ("op5",):
            assert q(spark, sf_dir).select("doc_id").distinct().count() == n


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() <= docs.count() and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "pseudonyms", "mix", "encode"]
    kept = out.select("doc_id").distinct()
    assert kept.count() == out.count()
    good = divergence.quality(docs).filter("kept").select("doc_id")
    assert kept.join(good, "doc_id", "left_anti").count() == 0
    at_hand = pii.in_place(docs, key_for_checks(spark)).join(kept, "doc_id").select("doc_id", F.col("text").alias("t"))
    assert out.join(at_hand, "doc_id").filter("decoded <> t").count() == 0


def test_pipeline_of_odd_tables(spark, odd_docs, no_docs, sf_dir):
    """Nulls, empty and long texts, repeats, clashing columns and no rows through every stage."""
    import corpus_pipeline

    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != "encode":
                assert out.columns == docs.columns
                docs = out
        assert out.columns == ["doc_id", "n_ids", "ids", "decoded"] and out.count() == docs.count()


def test_labels_with_clashing_columns(spark, odd_docs):
    clash = ("grade", "text", "bucket", "tail", "held_out", "__n", "__at", "key")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (8, 0, 1)], "doc_id long, quality int, toxic int").withColumns({c: F.lit("x") for c in clash})
    assert ordinal.classify(odd_docs, labels).count() == 11


def test_tokens_of_clashing_columns(spark, odd_docs):
    assert transducer.encoded(odd_docs.withColumns({c: F.lit(1) for c in ("ids", "n_ids", "decoded")}), PIECES).count() == 11

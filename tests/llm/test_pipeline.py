"""Mixing against plain arithmetic, and the stages of the pipeline."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from groundwork.llm import mixing, pieces, simhash
from groundwork.llm.queries import PIECE_MODEL
from tests.llm.conftest import SF


def test_raking_meets_all_targets_as_plain_arithmetic_does(spark):
    rng = np.random.default_rng(1)
    rows = [(s, l, t, int(rng.integers(10, 1000))) for s in ("a", "b", None) for l in ("x", "y") for t in ("p", "q") if (s, l, t) != ("a", "x", "q")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    wanted = {"source": {"a": 0.5, "b": 0.3, None: 0.2}, "lang": {"x": 0.4, "y": 0.6}, "topic": {"p": 0.7, "q": 0.3}}
    tables = {d: spark.createDataFrame(list(v.items()), "value string, target double") for d, v in wanted.items()}
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(cells, tables, mixing.Mix(tolerance=1e-8, sweeps=100)).collect()}
    want = {r[:3]: float(r[3]) for r in rows}
    for _ in range(200):
        for i, d in enumerate(wanted):
            sums = {v: sum(w for k, w in want.items() if k[i] == v) for v in wanted[d]}
            want = {k: w * wanted[d][k[i]] / sums[k[i]] for k, w in want.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_probabilities_meet_the_budget(spark):
    rows = [("a", 100, 0.7), ("b", 1000, 0.2), ("c", 5000, 0.1), ("d", 10, 0.0)]
    cells = spark.createDataFrame(rows, "source string, tokens long, weight double")
    got = mixing.calibrated(cells, mixing.Mix(keep=0.5)).collect()
    assert abs(sum(r.probability * r.tokens for r in got) - 0.5 * 6110) < 1e-3
    assert {r.source: r.probability for r in got}["d"] == 0 and {r.source: r.probability for r in got}["a"] == 1


def test_odd_rows_are_mixed(spark, odd_documents):
    got = mixing.mixed(odd_documents)
    assert got.count() == odd_documents.count() and set(odd_documents.columns) <= set(got.columns)
    assert got.filter("doc_id = 4").select("_kept").distinct().count() == 1
    assert mixing.mixed(odd_documents.limit(0)).count() == 0


def test_kept_tokens_are_near_the_budget(spark, documents):
    got = mixing.mixed(documents).agg(F.sum(F.when(F.col("_kept"), F.col("_tokens"))).alias("k"), F.sum("_tokens").alias("n"),
                                      F.sum(F.col("_tokens") * F.col("_probability")).alias("e")).first()
    assert abs(got.e / got.n - 0.8) < 1e-3 and abs(got.k / got.n - 0.8) < 0.1


def test_stages_take_effect(spark, documents, odd_documents):
    odd = odd_documents.select(documents.columns).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    docs = documents.union(odd)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if name != "tokens":
            assert docs.columns == before.columns
        docs = docs.cache()
        assert 0 < docs.count() <= before.count()
        if name == "language":
            assert docs.filter("doc_id in (1000001, 1000002, 1000003, 1000006)").isEmpty()
            clean = before.filter("length(text) > 200 and lang is not null")
            assert docs.join(clean, "doc_id", "left_semi").count() >= 0.995 * clean.count()
        if name == "near_duplicates":
            assert simhash.classes(docs).select("class_root").distinct().count() == docs.count()
            assert docs.count() == simhash.classes(before).select("class_root").distinct().count()
        if name == "personal_data":
            assert docs.filter("text rlike '[a-z0-9]@[a-z0-9]+[.]'").isEmpty() and docs.count() == before.count()
        if name == "tokens":
            own = pieces.encode(before, __import__("public_tokenizers").path(PIECE_MODEL))
            assert own.select("doc_id", "ids").exceptAll(docs.select("doc_id", "ids")).isEmpty()


def test_an_empty_table_passes(spark, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwork.functions import text
from groundwork.functions.embedding import embed, hashed_terms
from groundwork.operators import cells, fusion, index, keyword, nearest
from groundwork.operators.ranking import first_of_each
from tests.fixture import questions, tickets


def _words(spark, texts):
    rows = spark.createDataFrame([(f"INC-2026-{i:05d}", t) for i, t in enumerate(texts)], "ticket_id string, search_text string")
    return rows


def _brute_nearest(ids, vectors, asked, k):
    out = []
    for name, q in asked:
        scored = []
        for i, v in zip(ids, vectors):
            n = np.linalg.norm(v) * np.linalg.norm(q)
            if n > 0:
                scored.append((round(1 - float(np.dot(v, q)) / n, 6) + 0.0, i))
        out += [(name, r, i, abs(d)) for r, (d, i) in enumerate(sorted(scored)[:k], start=1)]
    return sorted(out)


def test_ties_filters_and_missing_direction(spark):
    rows = tickets(spark)
    asked = questions(spark, ("q", "pump", [1.0, 0.0, 0.0, 0.0])).withColumns(
        {"severity": F.lit(None).cast("string"), "domain": F.lit(None).cast("string"), "resolved_only": F.lit(False)})
    plain = [(r["rank"], r["ticket_id"]) for r in nearest.nearest(rows, asked, 3).orderBy("rank").collect()]
    assert plain == [(1, "INC-2026-04000"), (2, "INC-2026-04001"), (3, "INC-2026-04002")]
    fixed = asked.withColumn("resolved_only", F.lit(True)).withColumn("domain", F.lit("Energy"))
    inside = [r["ticket_id"] for r in nearest.nearest(rows, fixed, 5).orderBy("rank").collect()]
    assert inside == ["INC-2026-04004", "INC-2026-04005"]
    low = asked.withColumn("severity", F.lit("Low"))
    everything = nearest.nearest(rows, low, 50).collect()
    assert {r["ticket_id"] for r in everything} == {
        r["ticket_id"] for r in rows.filter("severity = 'Low' AND ticket_id <> 'INC-2026-04015'").collect()}


@pytest.mark.parametrize("max_questions", [4096, 2])
def test_nearest_equals_brute_force_with_many_copies(spark, max_questions):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    vectors[:100] = vectors[0]
    ids = [f"INC-2026-{i:05d}" for i in rng.permutation(300)]
    asked = [(f"q{i}", rng.normal(size=8).astype(np.float32)) for i in range(5)] + [("copy", vectors[0])]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], "ticket_id string, embedding array<float>").repartition(5)
    qs = questions(spark, *[(n, "", v.tolist()) for n, v in asked])
    got = sorted((r["question_id"], r["rank"], r["ticket_id"], r["distance"])
                 for r in nearest.nearest(corpus, qs, 7, max_questions).collect())
    want = _brute_nearest(ids, vectors.astype(np.float64), [(n, v.astype(np.float64)) for n, v in asked], 7)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-6)


def test_embedder_is_the_callers_and_gets_batches(spark):
    def lengths(texts):
        assert len(texts) <= 3
        return np.array([[len(t), len(texts)] for t in texts])

    rows = spark.createDataFrame([(f"{i}", "x" * i) for i in range(10)], "id string, t string").coalesce(1)
    done = {r["id"]: r["embedding"] for r in embed(rows, "t", lengths, 2, batch=3).collect()}
    assert done["7"] == [7.0, 3.0] and done["9"] == [9.0, 1.0]
    assert np.allclose(np.linalg.norm(hashed_terms(16)(["a b c", "Ålgård"]), axis=1), 1.0)
    assert not hashed_terms(16)(["...", ""]).any()


def test_keyword_terms_and_phrases(spark):
    rows = tickets(spark)
    terms = spark.createDataFrame([(t,) for t in ["ERR-5012", "shaking", "vibration", "Ålgård", "pay pay", "at high load", "err 50", "..."]], "term string")
    counts = {r["term"]: r["total_matches"] for r in keyword.keyword_count(rows, terms).collect()}
    assert counts == {"ERR-5012": 4, "shaking": 0, "vibration": 1, "Ålgård": 0, "pay pay": 1, "at high load": 1, "err 50": 0, "...": 0}
    shown = keyword.keyword_search(rows, terms, 2).filter("term = 'ERR-5012'").orderBy("rank").collect()
    assert [(r["rank"], r["ticket_id"]) for r in shown] == [(1, "INC-2026-04000"), (2, "INC-2026-04001")]


def test_stems_and_stop_words(spark):
    words = spark.createDataFrame([("flies",), ("eies",), ("shoes",), ("buses",), ("glass",), ("status",), ("pumps",), ("the",)], "w string")
    stems = {r[0]: r[1] for r in words.select("w", text.stem(F.col("w"))).collect()}
    assert stems == {"flies": "fly", "eies": "eie", "shoes": "shoe", "buses": "buse", "glass": "glass",
                     "status": "status", "pumps": "pump", "the": "the"}
    assert words.select(F.array_join(text.normal_terms(text.tokens(F.lit("The pumps of Ålgård"))), "|")).first()[0] == "pump|ålgård"


def test_all_terms_and_web_matches(spark):
    rows = _words(spark, ["pumps and bearings", "pump", "bearing of a pump", "in data of license", "ins"])
    qs = spark.createDataFrame([("1", "the pump bearing"), ("2", "of the"), ("3", "ins")], "question_id string, question string")
    assert sorted(map(tuple, keyword.match_all(rows, qs).collect())) == [
        ("1", "INC-2026-00000"), ("1", "INC-2026-00002"), ("3", "INC-2026-00004")]
    web = spark.createDataFrame([
        ("must", ["pump"], None, None, ["bearing"]), ("any", None, ["bearing", "data"], None, None),
        ("phrase", None, None, "data of license", None), ("mixed", ["pump"], ["bearings"], "bearing", None), ("not", None, None, None, ["pump"]),
        ("anynot", None, ["pump", "data"], None, ["bearings"])],
        "question_id string, must array<string>, any_of array<string>, phrase string, must_not array<string>")
    got = sorted(map(tuple, keyword.web_matches(rows, web).collect()))
    assert got == [("any", "INC-2026-00000"), ("any", "INC-2026-00002"), ("any", "INC-2026-00003"), ("anynot", "INC-2026-00001"), ("anynot", "INC-2026-00003"),
                   ("mixed", "INC-2026-00000"), ("mixed", "INC-2026-00002"), ("must", "INC-2026-00001"), ("phrase", "INC-2026-00003")]


@pytest.fixture(scope="module")
def random_texts(spark):
    rng = random.Random(5)
    vocabulary = ["pump", "bearing", "load", "noise", "till", "card", "hot", "the", "of"]
    texts = [" ".join(rng.choices(vocabulary, weights=range(9, 0, -1), k=rng.randint(1, 30))) for _ in range(60)] + ["noise till"] * 30
    qs = [("a", "pump bearing"), ("b", "card hot till"), ("c", "noise"), ("d", "of the"), ("e", "absent pump")]
    return texts, qs, _words(spark, texts), spark.createDataFrame(qs, "question_id string, question string")


def _covers(words, terms):
    spans = []
    for lo in range(len(words)):
        for hi in range(lo, len(words)):
            if set(terms) <= set(words[lo:hi + 1]):
                spans.append((lo, hi))
                break
    return [s for s in spans if not any(o != s and o[0] >= s[0] and o[1] <= s[1] for o in spans)]


@pytest.mark.parametrize("held", [True, False])
def test_cover_density_equals_brute_force(spark, random_texts, monkeypatch, held):
    texts, qs, rows, asked = random_texts
    if not held:
        monkeypatch.setattr(keyword, "MAX_QUERIES", 0)
    want = {}
    for name, q in qs:
        terms = [w for w in q.split() if w not in text.STOP_WORDS]
        for i, t in enumerate(texts):
            spans = _covers(t.split(), terms) if terms else []
            if spans:
                want[name, f"INC-2026-{i:05d}"] = round(sum(1 / (hi - lo + 1) for lo, hi in spans), 6)
    got = {(r[0], r[1]): r[2] for r in keyword.cover_density(rows, asked).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[key] - want[key]) < 2e-6 for key in want)


@pytest.mark.parametrize("weights", [20_000, 0])
def test_bm25_equals_brute_force_and_its_top(spark, random_texts, monkeypatch, weights):
    texts, qs, rows, asked = random_texts
    monkeypatch.setattr(keyword, "MAX_WEIGHTS", weights)
    monkeypatch.setattr(keyword, "PAIR_BATCH", 7)
    docs = [Counter(w for w in t.split() if w not in text.STOP_WORDS) for t in texts]
    lengths = [len(t.split()) for t in texts]
    mean = sum(lengths) / len(lengths)
    want = {}
    for name, q in qs:
        for i, d in enumerate(docs):
            score = 0.0
            for term in q.split():
                df = sum(1 for x in docs if x[term])
                if d[term]:
                    score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * d[term] * 2.2 / (d[term] + 1.2 * (0.25 + 0.75 * lengths[i] / mean))
            if score:
                want[name, f"INC-2026-{i:05d}"] = score
    got = {(r[0], r[1]): r[2] for r in keyword.bm25(rows, asked).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[key] - want[key]) < 1e-6 for key in want)
    for name, _ in qs:
        best = sorted((-round(s, 6), i) for (q, i), s in want.items() if q == name)[:8]
        top = keyword.best_bm25(rows, asked, 8).filter(F.col("question_id") == name).orderBy("rank").collect()
        assert [r["ticket_id"] for r in top] == [i for _, i in best]


def test_fusion_gives_nothing_for_a_missing_side(spark):
    one = spark.createDataFrame([("q", "both", 1), ("q", "left", 2)], "question_id string, ticket_id string, rank int")
    two = spark.createDataFrame([("q", "right", 1), ("q", "both", 2)], "question_id string, ticket_id string, rank int")
    got = {r["ticket_id"]: r["rrf"] for r in fusion.fuse(one, two, digits=5).collect()}
    assert got == {"both": round(1 / 61 + 1 / 62, 5), "left": round(1 / 62, 5), "right": round(1 / 61, 5)}


def test_hybrid_finds_code_and_symptom(spark):
    rows = tickets(spark)
    asked = questions(spark, ("q", "ERR-5012 bearing", [1.0, 0.0, 0.0, 0.0]))
    top = fusion.hybrid_search(rows, rows, asked, 3).orderBy("rank").collect()
    assert top[0]["ticket_id"] == "INC-2026-04001" and [r["rank"] for r in top] == [1, 2, 3]
    scores = [r["rrf"] for r in fusion.hybrid_by_hand(rows, rows, asked, 16).collect()]
    assert all(0 < s <= round(2 / 61, 5) for s in scores)


def test_bucketed_postings_need_no_shuffle(spark):
    postings = keyword.build_postings(tickets(spark))
    keyword.store_postings(postings, "postings_by_ticket", 4)
    try:
        stored = spark.table("postings_by_ticket")
        counted = keyword.term_frequencies(stored)
        assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, keyword.term_frequencies(postings).collect()))
    finally:
        spark.sql("DROP TABLE postings_by_ticket")


def test_workers_round_halves_up_as_the_ranking_does():
    best = nearest.Best(1, 1)
    best.offer(np.array(["a", "b"], object), np.array([[0.1234565, 0.1234560]]), np.array([0]))
    assert list(best.ids[0]) == ["b"]


def test_every_scope_narrows_the_scan(spark):
    rows = tickets(spark)
    scopes = [{"domain": "Energy", "severity": "High"}, {"domain": "Retail", "severity": None}]
    inside = nearest.within_reach(rows, scopes)
    assert {r["domain"] for r in inside.collect()} == {"Energy", "Retail"}
    assert inside.count() == rows.filter(F.col("domain").isin("Energy", "Retail")).count()
    assert nearest.within_reach(rows, [*scopes, {"domain": None}]).count() == rows.count()
    assert nearest.within_reach(rows, []).count() == rows.count()


def test_one_key_with_very_many_rows_is_ranked_in_parts(spark):
    rows = spark.range(5000).select(F.lit("q").alias("question_id"), F.format_string("t%05d", "id").alias("ticket_id"), (F.col("id") % 7).alias("step"))
    got = first_of_each(rows, "question_id", ["step", "ticket_id"], 4).orderBy("rank").collect()
    assert [(r["rank"], r["ticket_id"]) for r in got] == [(1, "t00000"), (2, "t00007"), (3, "t00014"), (4, "t00021")]


def test_terms_counted_in_the_row_equal_the_postings(spark):
    rows = tickets(spark).unionByName(tickets(spark).limit(1).withColumns({"ticket_id": F.lit("none"), "search_text": F.lit("")}))
    names = ["ticket_id", "doc_len", "term", "tf"]
    counted = keyword.term_frequencies(keyword.build_postings(rows)).select(*names)
    assert sorted(map(tuple, keyword.terms_of_each(rows).select(*names).collect())) == sorted(map(tuple, counted.collect()))
    assert "Exchange" not in keyword.terms_of_each(tickets(spark))._jdf.queryExecution().executedPlan().toString()


def test_bm25_beyond_the_matrix_bound_is_the_same(spark, monkeypatch):
    rows = tickets(spark)
    asked = questions(spark, ("a", "pump vibration at high load", [1.0, 0.0, 0.0, 0.0]), ("b", "checkout payment", [1.0, 0.0, 0.0, 0.0]))
    few = sorted(map(tuple, keyword.bm25(rows, asked).collect()))
    monkeypatch.setattr(keyword, "MAX_MATRIX", 0)
    assert few and sorted(map(tuple, keyword.bm25(rows, asked).collect())) == few


@pytest.fixture(scope="module")
def stored_index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "keyword")
    index.build_index(tickets(spark), path, folders=8)
    return index.open_index(spark, path)


INDEXED_TEXTS = ["pump", "the bus", "noise on the bus", "pay pay", "pumps shudder", "", "of the", "nowhere to be found", "printer stops mid sale"]


@pytest.mark.parametrize("bound", [20_000, 0])
def test_searches_of_the_index_equal_those_of_the_texts(spark, stored_index, monkeypatch, bound):
    monkeypatch.setattr(index, "MAX_WANTED", bound)  # at 0 nothing is broadcast
    rows = tickets(spark)
    asked = spark.createDataFrame([(str(i), text) for i, text in enumerate(INDEXED_TEXTS)], "question_id string, question string")
    searches = [(index.phrase_matches, keyword.phrase_matches), (index.match_all, keyword.match_all)]
    if bound:
        searches += [(index.bm25, keyword.bm25), (index.cover_density, keyword.cover_density)]
    for there, here in searches:
        got, want = (sorted(map(tuple, found.collect())) for found in (there(stored_index, asked), here(rows, asked)))
        assert want and got == want, there.__name__
    if not bound:
        return
    terms = asked.select(F.col("question").alias("term"))
    assert sorted(map(tuple, index.keyword_count(stored_index, terms).collect())) == sorted(map(tuple, keyword.keyword_count(rows, terms).collect()))
    assert sorted(map(tuple, index.keyword_search(stored_index, rows, terms).collect())) == sorted(map(tuple, keyword.keyword_search(rows, terms).collect()))


def test_the_index_is_read_by_folder_and_texts_are_not(spark, stored_index):
    one = spark.createDataFrame([("q", "printer")], "question_id string, question string")
    plan = index.bm25(stored_index, one)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all(re.search(r"PartitionFilters: \[[^\]]*part#\d+ (=|IN)", line) for line in scans)
    assert "regexp_extract_all" not in plan and "hits" not in plan


def test_an_index_of_nothing_finds_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    index.build_index(tickets(spark).limit(0), path, folders=2)
    asked = spark.createDataFrame([("q", "printer stops")], "question_id string, question string")
    empty = index.open_index(spark, path)
    assert index.phrase_matches(empty, asked).isEmpty() and index.bm25(empty, asked).isEmpty()

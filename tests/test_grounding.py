from pyspark.sql import functions as F

from groundwork.operators import expectations, grounding
from tests.fixture import questions, tickets


def test_contexts_of_both_sides(spark):
    rows = tickets(spark)
    asked = questions(spark, ("q", "A pump is shaking, what fixed it?", [1.0, 0.0, 0.0, 0.0]))
    sides = {r["side"]: r for r in grounding.compare_prompts(rows, rows, asked, 2).collect()}
    assert sides["keyword"]["n_tickets"] == 0 and sides["keyword"]["context"] == grounding.NO_TICKETS
    assert sides["semantic"]["context"] == (
        "INC-2026-04000 | Maritime | MV Kvitøy | ERR-5012 | Critical | resolved in 4.0 h\n"
        "  title: Pump noise\n  reported: trembling pump\n  resolution: Aligned the shaft\n"
        "INC-2026-04001 | Maritime | MV Kvitøy | ERR-5012 | High | resolved in 10.0 h\n"
        "  title: Pump shudder\n  reported: bearing knocking at high load\n  resolution: Replaced the bearing")
    assert sides["semantic"]["prompt"].startswith("Tickets from our system:\n\nINC-2026-04000")
    assert sides["semantic"]["prompt"].endswith("\n\nQuestion: A pump is shaking, what fixed it?")


def test_open_ticket_and_short_form(spark):
    rows = tickets(spark)
    block = rows.filter("ticket_id = 'INC-2026-04003'").select(grounding.long_block()).first()[0]
    assert "resolved in None h" in block and block.endswith("resolution: still open")
    asked = questions(spark, ("q", "hot?", [0.0, 1.0, 0.0, 0.0]))
    row = grounding.answer_prompts(rows, rows, asked, 1).first()
    assert row["prompt"] == ("Tickets from our system:\nINC-2026-04005 | Transformer warm\n  reported: bearing of the fan\n"
                             "  fixed by:  Cleaned the fan\n\nQuestion: hot?")


def test_compare_answers_and_citations(spark):
    rows = tickets(spark)
    asked = questions(spark, ("q", "A pump is shaking, what fixed it?", [1.0, 0.0, 0.0, 0.0]),
                      ("k", "printer stops", [0.0, 0.0, 0.0, 1.0]))
    compared = grounding.compare(rows, rows, asked, 2)
    found = {(r["question_id"], r["side"]): r for r in compared.collect()}
    assert found["q", "keyword"]["answer"] == grounding.NO_RECORD and found["q", "keyword"]["citations"] == []
    assert [tuple(c) for c in found["q", "semantic"]["citations"]] == [("INC-2026-04000", True), ("INC-2026-04001", True)]
    contrast = {r["name"]: r["passed"] for r in expectations.retrieval_contrast(compared).collect()}
    assert contrast == {"q": True, "k": False}


def test_a_model_that_invents(spark):
    rows = tickets(spark)
    asked = questions(spark, ("q", "A pump is shaking", [1.0, 0.0, 0.0, 0.0]))
    compared = grounding.compare(rows, rows, asked, 2, model=lambda pairs: ["See INC-2026-99999." for _ in pairs])
    assert {r["side"]: [tuple(c) for c in r["citations"]] for r in compared.collect()} == {
        "keyword": [("INC-2026-99999", False)], "semantic": [("INC-2026-99999", False)]}
    assert not expectations.retrieval_contrast(compared).first()["passed"]


def test_citation_order_and_verdict(spark):
    said = spark.createDataFrame([
        ("a", "INC-2026-04009 then INC-2026-77777, again INC-2026-04009 and INC-2026-04000"), ("b", "none"), ("c", "INC-2026-04000")],
        "answer_id string, answer string")
    checked = grounding.verify(grounding.citations(said, "answer_id"), tickets(spark))
    assert sorted(map(tuple, checked.filter("answer_id = 'a'").collect())) == [
        ("a", 1, "INC-2026-04009", True), ("a", 2, "INC-2026-77777", False), ("a", 3, "INC-2026-04000", True)]
    verdicts = {r["answer_id"]: tuple(r[1:]) for r in grounding.verdict(checked, "answer_id").collect()}
    assert verdicts == {"a": (3, 2, "INC-2026-77777", False), "c": (1, 1, "", True)}


def test_count_expectations(spark):
    rows = tickets(spark)
    assert expectations.row_count("loaded", rows, rows).first()["passed"]
    assert not expectations.row_count("loaded", rows.limit(3), rows).first()["passed"]
    expected = spark.createDataFrame([("ERR-5012", 4), ("shaking", 0), ("pump", 99)], "term string, expected long")
    assert {r["name"]: r["passed"] for r in expectations.term_counts(rows, expected).collect()} == {
        "ERR-5012": True, "shaking": True, "pump": False}
    result = rows.select(F.lit("q").alias("question_id"), "error_code")
    assert expectations.top_composition(result).first()["actual"] == 4

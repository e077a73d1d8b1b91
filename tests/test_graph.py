import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwork.operators import analytics, expectations, graph, similarity
from groundwork.operators.blocks import join_blocks
from tests.fixture import questions, tickets


def _brute_edges(rows, threshold, per_ticket):
    edges = set()
    for a, code_a, va in rows:
        near = []
        for b, code_b, vb in rows:
            n = np.linalg.norm(va) * np.linalg.norm(vb)
            if a != b and code_a != code_b and n > 0:
                d = round(1 - float(np.dot(va, vb)) / n, 6)
                if d < threshold:
                    near.append((abs(d), b))
        edges |= {(a, b) for _, b in sorted(near)[:per_ticket]}
    return edges


@pytest.mark.parametrize("pivots,block_rows,per_ticket,visited", [(1, 4000, 2, 0.5), (5, 7, 2, 1.0), (12, 40, 3, 1.0), (12, 30, 2, 0.0)])
def test_similar_edges_equal_brute_force_with_copies(spark, monkeypatch, pivots, block_rows, per_ticket, visited):
    monkeypatch.setattr(similarity, "MAX_VISITED", visited)
    rng = np.random.default_rng(pivots)
    vectors = rng.normal(size=(150, 5)).astype(np.float32)
    vectors[:50] = vectors[0]
    vectors[50:60] = vectors[50]
    vectors[149] = 0
    codes = [f"ERR-{1000 + int(c)}" for c in rng.choice(4, size=150, p=[0.7, 0.1, 0.1, 0.1])]
    ids = [f"INC-2026-{i:05d}" for i in rng.permutation(150)]
    df = spark.createDataFrame([(i, c, v.tolist()) for i, c, v in zip(ids, codes, vectors)],
                               "ticket_id string, error_code string, embedding array<float>")
    edges = similarity.similar_to(df, 0.35, per_ticket, pivots, block_rows).collect()
    got = {(r["src"], r["dst"]) for r in edges}
    assert len(edges) == len(got)
    assert got == _brute_edges(list(zip(ids, codes, vectors.astype(np.float64))), 0.35, per_ticket)


def test_clustered_vectors_meet_few_others(spark, monkeypatch):
    pairs = []

    def counted(left, right, left_id, right_id, pair, schema, block_rows, left_counts, right_counts):
        n = min(len(left_counts), len(right_counts))
        pairs.append(int((left_counts[:n] * right_counts[:n]).sum()))
        return join_blocks(left, right, left_id, right_id, pair, schema, block_rows, left_counts, right_counts)

    monkeypatch.setattr(similarity, "join_blocks", counted)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    vectors = (centres[np.arange(800) % 40] + 0.05 * rng.normal(size=(800, 16))).astype(np.float32)
    rows = [(f"t{i:04d}", f"c{i // 40 % 3}", v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "ticket_id string, error_code string, embedding array<float>")
    got = {(r["src"], r["dst"]) for r in similarity.similar_to(df, 0.40, 2, 40).collect()}
    assert got == _brute_edges([(i, c, vectors[n].astype(np.float64)) for n, (i, c, _) in enumerate(rows)], 0.40, 2)
    assert len(pairs) == 2 and sum(pairs) < 800 * 800 / 8


def test_threshold_is_strict_and_codes_differ(spark):
    df = spark.createDataFrame([("a", "X", [1.0, 0.0]), ("b", "X", [1.0, 0.01]), ("c", "Y", [0.6, 0.8]), ("d", "Z", [0.8, 0.6])],
                               "ticket_id string, error_code string, embedding array<double>")
    at = {(r["src"], r["dst"]) for r in similarity.similar_to(df, 0.40).collect()}
    assert ("a", "c") not in at and ("a", "d") in at and ("a", "b") not in at
    above = {(r["src"], r["dst"]) for r in similarity.similar_to(df, 0.400001).collect()}
    assert ("a", "c") in above


def test_edges_fan_out_by_name(spark):
    edges = graph.declared_edges(tickets(spark)).filter("src = 'INC-2026-04011' AND label = 'ON'").collect()
    assert {r["dst"] for r in edges} == {"Payments/Shared", "Retail/Shared"}


def test_walks_count_paths(spark):
    rows = tickets(spark)
    similar = spark.createDataFrame(
        [("INC-2026-04000", "INC-2026-04004"), ("INC-2026-04001", "INC-2026-04004"), ("INC-2026-04001", "INC-2026-04006")], "src string, dst string")
    reached = {(r["asset"]): r for r in graph.walk_by_meaning(rows, similar).filter("code = 'ERR-5012'").collect()}
    assert reached["Substation Ålgård"]["tickets"] == 2 and reached["Substation Ålgård"]["avg_hours"] == 8.0
    assert reached["Substation Nord"]["tickets"] == 1 and reached["Substation Nord"]["avg_hours"] is None
    counts = {r["label"]: r["n"] for r in graph.graph_counts(rows, similar).collect()}
    # 18 ON edges: two tickets on a name with two nodes each
    assert counts == {"asset": 9, "team": 6, "code": 7, "ticket": 16, "edges": 18 + 16 + 16 + 3}


def test_expand_flags_order_and_hours(spark):
    rows = tickets(spark)
    similar = spark.createDataFrame(
        [("INC-2026-04000", "INC-2026-04004"), ("INC-2026-04001", "INC-2026-04005"), ("INC-2026-04001", "INC-2026-04012")], "src string, dst string")
    # MV Skarv has open tickets only; reach it by meaning too, from a ticket of its own code
    similar = similar.union(spark.createDataFrame([("INC-2026-04002", "INC-2026-04008")], similar.schema))
    asked = questions(spark, ("q", "pump", [1.0, 0.0, 0.0, 0.0]))
    expanded = graph.in_display_order(graph.expand(rows, rows, asked, similar)).collect()
    shown = [(r["asset"], r["tickets"], r["related"], r["avg_hours"], r["in_search"], r["kind"]) for r in expanded]
    assert shown == [
        ("MV Kvitøy", 2, 0, 7.0, True, "found"),
        ("MV Skarv", 2, 0, None, True, "found"),
        ("Gateway A", 0, 1, 1.5, False, "meaning"),
        ("Substation Ålgård", 0, 2, 5.0, False, "meaning"),
        ("Till 9", 0, 1, 6.0, False, "meaning"),
    ]
    df = graph.expand(rows, rows, asked, similar)
    assert graph.new_assets(df).count() == 3 and graph.meaning_only(df).count() == 3
    assert expectations.kinds_agree(df).first()["passed"]
    reach = expectations.graph_reach(df).first()
    assert (reach["actual"], reach["domains"], reach["passed"]) == (3, 3, True)


def test_hours_fall_back_to_the_meaning_walk(spark):
    rows = tickets(spark)
    similar = spark.createDataFrame([("INC-2026-04002", "INC-2026-04003")], "src string, dst string")
    fixed = rows.withColumn("resolved_hours", F.when(F.col("ticket_id") == "INC-2026-04003", 9.0).otherwise(F.col("resolved_hours")))
    fixed = fixed.withColumn("error_code", F.when(F.col("ticket_id") == "INC-2026-04003", "ERR-5013").otherwise(F.col("error_code")))
    asked = questions(spark, ("q", "pump", [1.0, 0.0, 0.0, 0.0]))
    row = graph.expand(fixed, fixed, asked, similar).filter("asset = 'MV Skarv'").first()
    assert row["by_code"] and row["avg_hours"] == 9.0 and row["tickets"] == 1 and row["related"] == 1


def test_no_seeds_give_nothing(spark):
    rows = tickets(spark)
    asked = questions(spark, ("q", "nothing", [0.0, 0.0, 0.0, 0.0]))
    similar = spark.createDataFrame([], "src string, dst string")
    assert graph.expand(rows, rows, asked, similar).count() == 0


def test_aggregates(spark):
    rows = tickets(spark)
    asked = questions(spark, ("q", "grid", [0.0, 1.0, 0.0, 0.0]))
    groups = [(r["team"], r["tickets"], r["avg_hours"], r["urgent"]) for r in analytics.semantic_aggregate(rows, rows, asked, 5).collect()]
    assert groups[0] == ("Field", 2, None, 0)  # no known hours sorts first among equals
    assert sum(g[1] for g in groups) == 5
    facets = [(r["facet"], r["value"]) for r in analytics.facets(rows).collect()]
    assert facets == [("severity", s) for s in ("Critical", "High", "Medium", "Low", "Odd")] + [
        ("domain", d) for d in ("Energy", "Maritime", "Payments", "Retail")]
    by_domain = [(r["domain"], r["n"]) for r in analytics.count_by_domain(rows).collect()]
    assert by_domain[0] == (None, 16) and by_domain[1] == ("Energy", 4)
    assert analytics.resolved(rows).count() == 11
    assert analytics.where(rows).count() == 16
    assert analytics.where(rows, "High", "Retail", True).count() == 2
    assert analytics.first_ticket(rows).first()["ticket_id"] == "INC-2026-04000"
    assert analytics.frequency_profile(rows, "error_code").first()["error_code"] == "ERR-3002"

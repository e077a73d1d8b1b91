"""What Spark sizes too low is not sent to every task."""

from pyspark.sql import functions as F

from groundwork.llm import components, simhash
from groundwork.session import materialise


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_fingerprints_are_never_sent_whole(spark):
    nodes = materialise(spark.range(2000).select(F.xxhash64("id").alias("fp")))
    plan = plan_of(simhash.links(nodes))
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_labels_beyond_the_bound_are_never_sent_whole(spark, monkeypatch):
    plans = []

    def noted(df):
        plans.append(plan_of(df))
        return materialise(df)

    monkeypatch.setattr(components, "materialise", noted)
    monkeypatch.setattr(components, "fits", lambda rows: False)
    links = spark.createDataFrame([(a, a + 1) for a in range(1, 9)] + [(20, 30)], "a long, b long")
    got = {tuple(r) for r in components.components(links).collect()}
    assert got == {(n, 1) for n in range(1, 10)} | {(20, 20), (30, 20)}
    assert len(plans) > 3 and not any("Broadcast" in plan for plan in plans)

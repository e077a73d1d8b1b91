"""Expected tokens against the targets, on the given rows and on skewed ones."""

import warnings

import pytest
from pyspark.sql import functions as F

from groundwork.llm import mixing
from groundwork.llm.queries import op9_mixing
from tests.llm.conftest import SF


def shares_off(rows):
    """The largest relative distance of a share of expected tokens from its target, in plain arithmetic."""
    worst = 0.0
    for d in ("source", "lang", "topic"):
        own, all_of = {}, {}
        for r in rows:
            own[r[d]] = own.get(r[d], 0.0) + r.n_tokens * r.probability
            all_of[r[d]] = all_of.get(r[d], 0) + r.n_tokens
        wanted = {v: n**0.7 for v, n in all_of.items()}
        for v in own:
            want = wanted[v] / sum(wanted.values())
            worst = max(worst, abs(own[v] / sum(own.values()) - want) / want)
    return worst


def test_query_meets_every_target(spark):
    rows = op9_mixing(spark, SF).collect()
    assert shares_off(rows) < 0.001
    kept = sum(r.n_tokens * r.probability for r in rows) / sum(r.n_tokens for r in rows)
    assert 0.1 < kept <= 0.8 and max(r.probability for r in rows) <= 1


def test_skewed_sources_meet_every_target(spark, documents):
    skewed = documents.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").otherwise(F.col("source")))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        got = mixing.mixed(skewed, mixing.Mix(meet_targets=True)).select(
            "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.col("_probability").alias("probability")).collect()
    assert shares_off(got) < 0.001


def test_missed_targets_are_reported(spark, documents):
    with pytest.warns(UserWarning, match="miss their targets"):
        mixing.mixed(documents)

"""Calls to a model that fails, is slow and has limits."""

import os
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from groundwork.functions import calls
from groundwork.functions.calls import Bucket, Limits

FAST = Limits(texts_a_batch=4, texts_a_task=8, first_wait=0.0, attempts=3)


def logged(folder, behave=lambda text, tries: None):
    """A model that notes every text it answers, and asks `behave` whether to."""
    def call(texts):
        for text in texts:
            name = os.path.join(folder, "tries-" + text.replace(" ", "_"))
            with open(name, "a") as out:
                out.write("x")
            behave(text, os.path.getsize(name))
        for text in texts:
            with open(os.path.join(folder, f"said-{uuid.uuid4().hex}"), "w") as out:
                out.write(text)
        return [text.upper() for text in texts]

    return call


def said(folder):
    return Counter(open(os.path.join(folder, n)).read() for n in os.listdir(folder) if n.startswith("said-"))


@pytest.fixture
def rows(spark):
    return spark.range(60).select("id", F.concat(F.lit("text "), (F.col("id") % 50).cast("string")).alias("t"))


def test_each_text_is_called_once_over_all_runs(spark, rows, tmp_path):
    folder, path = str(tmp_path), str(tmp_path / "ledger")
    first = calls.with_answers(rows.filter("id < 30"), "t", logged(folder), path, limits=FAST)
    assert {r.answer for r in first.collect()} == {f"TEXT {i}" for i in range(30)} and set(said(folder).values()) == {1}
    whole = calls.with_answers(rows, "t", logged(folder), path, limits=FAST)
    assert whole.columns == ["id", "t", "answer"] and whole.count() == 60
    assert all(r.answer == r.t.upper() for r in whole.collect())
    calls.with_answers(rows, "t", logged(folder), path, limits=FAST).count()
    assert len(said(folder)) == 50 and set(said(folder).values()) == {1}


def test_faults_that_pass_are_tried_again_and_others_are_kept_apart(spark, rows, tmp_path):
    folder, path = str(tmp_path), str(tmp_path / "ledger")

    def behave(text, tries):
        if text.endswith("7") and tries < 3:
            raise ConnectionError("busy")
        if text == "text 13":
            raise ValueError("refused")

    got = {r.t: r.answer for r in calls.with_answers(rows, "t", logged(folder, behave), path, limits=FAST).collect()}
    assert got.pop("text 13") is None and len(got) == 49 and all(a == t.upper() for t, a in got.items())
    errors = calls.ledger(spark, path).filter("error is not null").collect()
    assert [e.error for e in errors] == ["ValueError: refused"]
    answers = said(folder)
    again = calls.with_answers(rows, "t", logged(folder), path, limits=FAST)
    assert again.filter("answer is null").isEmpty()
    assert said(folder) == answers + Counter({"text 13": 1})  # the second run asks for nothing else


def test_a_lost_worker_costs_only_unfinished_tasks(spark, tmp_path):
    folder, path = str(tmp_path), str(tmp_path / "ledger")
    rows = spark.range(64).select(F.concat(F.lit("text "), "id").alias("t"))

    def behave(text, tries):
        if text == "text 40" and not os.path.exists(os.path.join(folder, "repaired")):
            import time

            time.sleep(8)  # the others end meanwhile
            os._exit(1)

    with pytest.raises(Exception):
        calls.with_answers(rows, "t", logged(folder, behave), path, limits=Limits(texts_a_task=8))
    kept = {r.digest for r in calls.ledger(spark, path).collect()}
    assert 30 < len(kept) < 64
    before = said(folder)
    open(os.path.join(folder, "repaired"), "w").close()
    got = calls.with_answers(rows, "t", logged(folder, behave), path, limits=Limits(texts_a_task=8))
    assert got.filter("answer is null").isEmpty() and got.count() == 64
    digests = {r.t: r.d for r in rows.select("t", F.sha2("t", 256).alias("d")).collect()}
    done = said(folder)
    assert all(done[t] == before[t] == 1 for t, d in digests.items() if d in kept)


def test_vectors_and_odd_texts(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x" * 100_000, "c"), (3, "x" * 100_000, "c")], "n int, t string, digest string")
    got = calls.with_answers(rows, "t", lambda texts: [[float(len(t)), 1.0] for t in texts], str(tmp_path / "l"), "array<float>", "vector")
    assert sorted((r.n, r.vector[0], r.digest) for r in got.collect()) == [(1, 0.0, "a"), (2, 0.0, "b"), (3, 1e5, "c"), (3, 1e5, "c")]
    assert calls.with_answers(rows.limit(0), "t", lambda texts: 1 / 0, str(tmp_path / "m")).count() == 0


def test_batches_keep_to_both_bounds():
    limits = Limits(tokens_a_batch=10, texts_a_batch=3, count=len)
    texts = ["aaaa", "bbbb", "cccc", "d" * 30, "e", "f", "g", "h"]
    assert list(calls.batches_of(texts, limits)) == [[0, 1], [2], [3], [4, 5, 6], [7]]
    assert list(calls.batches_of([], limits)) == []


def test_the_rate_is_kept():
    now = [0.0]

    def sleep(seconds):
        now[0] += seconds

    bucket = Bucket(100.0, lambda: now[0], sleep)
    for _ in range(50):
        bucket.take(37)
    assert 50 * 37 / 100 - 1.0 <= now[0] <= 50 * 37 / 100
    limits, tries = Limits(attempts=4, first_wait=8.0, longest_wait=20.0), []

    def fails(texts):
        tries.append(now[0])
        raise ConnectionError("busy")

    start = now[0]
    assert calls.answered(["x"], fails, limits, Bucket(1e9, lambda: now[0], sleep)) == [(None, "ConnectionError: busy")]
    assert len(tries) == 4 and 4 + 8 + 10 <= now[0] - start <= 8 + 16 + 20

"""Approximate search by cells: recall against brute force, the exact bound, and odd corpora."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwork.operators import cells
from groundwork.operators.nearest import nearest


def corpus_of(spark, vectors):
    rows = [(f"t{i:05d}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "ticket_id string, embedding array<float>")


def asked_of(spark, vectors):
    rows = [(f"q{i}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "question_id string, q_vector array<float>")


def built(spark, corpus, path, k=5):
    cells.build_cells(corpus, str(path), k)
    return cells.open_cells(spark, str(path))


def rows_of(df):
    return sorted((r.question_id, r.rank, r.ticket_id, r.distance) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(60, 16))

    def draw(n):
        return middle[rng.integers(60, size=n)] + 0.25 * rng.normal(size=(n, 16))

    return draw


@pytest.mark.parametrize("size", [400, 4000])
def test_recall_on_vectors_without_clusters(spark, tmp_path, size):
    rng = np.random.default_rng(size)
    found = built(spark, corpus_of(spark, rng.normal(size=(size, 24))), tmp_path / "cells")
    report = cells.access_report(found, asked_of(spark, rng.normal(size=(60, 24)))).collect()
    assert len(report) == 60 and np.mean([r.recall for r in report]) >= 0.9
    assert np.mean([r.candidates for r in report]) < 0.9 * size


def test_clusters_are_searched_alone_and_less_of_a_larger_corpus(spark, tmp_path, clustered):
    share = []
    for size in (500, 5000):
        found = built(spark, corpus_of(spark, clustered(size)), tmp_path / f"cells{size}")
        report = cells.access_report(found, asked_of(spark, clustered(50))).collect()
        assert np.mean([r.recall for r in report]) >= 0.9
        share.append(np.mean([r.candidates for r in report]) / size)
    assert share[1] < share[0] < 0.5 and share[1] < 0.15


def test_whole_radius_is_exact_and_reads_only_folders_of_its_cells(spark, tmp_path, clustered):
    corpus, asked = corpus_of(spark, clustered(1500)), asked_of(spark, clustered(7))
    found = built(spark, corpus, tmp_path / "cells")
    want = rows_of(nearest(corpus, asked, 8))
    assert rows_of(cells.approximate_nearest(found.exact(), asked, 8)) == want
    assert found.rows.count() == 1500 and found.cells.agg(F.sum("n")).first()[0] == 1500
    batch = cells._Asked(asked)
    first = batch.first_cells(found, 5)
    assert "PartitionFilters: [part" in batch.visit(found, first, 5)._jdf.queryExecution().toString()
    # Every ticket lies within the radius of its cell.
    assert found.rows.join(found.cells.select("cell", "radius"), "cell").filter("steps > radius").isEmpty()


def test_batches_of_questions_give_the_same(spark, tmp_path, clustered, monkeypatch):
    found = built(spark, corpus_of(spark, clustered(600)), tmp_path / "cells")
    asked = asked_of(spark, clustered(30))
    whole = rows_of(cells.approximate_nearest(found, asked))
    monkeypatch.setattr(cells, "MAX_QUESTIONS", 8)
    monkeypatch.setattr(cells, "MAX_NAMED", 1)
    assert rows_of(cells.approximate_nearest(found, asked)) == whole


def test_copies_zero_vectors_and_empty_tables(spark, tmp_path):
    rng = np.random.default_rng(1)
    vectors = np.concatenate([np.tile(rng.normal(size=(1, 6)), (300, 1)), rng.normal(size=(100, 6)), np.zeros((20, 6))])
    corpus = corpus_of(spark, vectors)
    asked = asked_of(spark, np.concatenate([vectors[:2], rng.normal(size=(5, 6)), np.zeros((1, 6))]))
    found = built(spark, corpus, tmp_path / "cells")
    assert found.rows.count() == 400
    assert rows_of(cells.approximate_nearest(found.exact(), asked)) == rows_of(nearest(corpus, asked, 5))
    assert cells.approximate_nearest(found, asked.limit(0)).count() == 0
    none = built(spark, corpus.limit(0), tmp_path / "none")
    assert cells.approximate_nearest(none, asked).count() == 0
    few = corpus_of(spark, rng.normal(size=(3, 6)))
    assert rows_of(cells.approximate_nearest(built(spark, few, tmp_path / "few"), asked)) == rows_of(nearest(few, asked, 5))


def test_recall_of_the_given_tables(spark):
    from groundwork.plans import registry

    for sf in ("sf0.001", "sf0.01"):
        report = registry.queries()["v7_access_report"](spark, f"/root/testdata/{sf}").collect()
        assert np.mean([r.recall for r in report]) >= 0.9

"""Both searches against brute force, and their odd cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwork.llm import cross_polytope, kd_shards
from groundwork.llm.queries import op1_nearest, op8_exact_search
from tests.compare import connect, differences
from tests.llm.conftest import SF


def vectors_of(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)


def test_approximate_search_has_recall_and_exact_scores(spark):
    ids, rows = vectors_of(spark)
    found = {}
    for r in op1_nearest(spark, SF).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for at in np.flatnonzero(ids % 20 == 0):
        scores = rows @ rows[at]
        scores[at] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[:20]])
        got = sorted(found[ids[at]])
        assert [g[0] for g in got] == list(range(1, 21))
        assert [(-g[2], g[1]) for g in got] == sorted((-g[2], g[1]) for g in got)
        for _, vec_id, score in got:
            assert vec_id != ids[at] and abs(score - scores[np.searchsorted(ids, vec_id)]) < 1e-12
        hits += len(best & {g[1] for g in got})
        total += 20
    assert hits / total >= 0.9


def test_exact_search_equals_sql(spark):
    from groundwork.llm.queries import oracle_sql
    assert differences(connect(SF), oracle_sql()["op8_exact_search"], op8_exact_search(spark, SF)) is None


@pytest.fixture(scope="module")
def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.5]), (1, [1.0, 0.0, 0.5]), (2, [1.0, 0.0, 0.5]), (2, [1.0, 0.0, 0.5]), (3, None), (4, [nan, 0.0, 0.0]),
            (5, [inf, 0.0, 0.0]), (6, [None, 0.0, 0.0]), (7, []), (8, [0.0, 0.0, 0.0]), (9, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (10, [-1.0, -3.0, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.withColumns({"id": F.lit(1), "vector": F.lit("x"), "rank": F.lit(2), "score": F.lit(3), "floor": F.lit(4), "block_cell": F.lit(5)})


@pytest.mark.parametrize("operator,has_zero", [(cross_polytope, False), (kd_shards, True)])
def test_odd_vectors(spark, odd_vectors, operator, has_zero):
    got = operator.search(odd_vectors, odd_vectors, k=3).collect()
    by_query = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in got}}
    assert set(by_query) <= {0, 1, 2, 8, 10} and (8 in by_query) == has_zero
    assert [v for v, _ in by_query[0]] == ([1, 2, 2] if has_zero else [1, 2, 10])  # ties by id
    assert [v for v, _ in by_query[2]][:2] == [0, 1]
    assert operator.search(odd_vectors.limit(0), odd_vectors.limit(0)).count() == 0


def test_small_shards_and_leaves_give_the_same(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = df.filter(F.col("vec_id") % 25 == 0)
    want = kd_shards.search(df, asked).collect()
    assert sorted(want) == sorted(kd_shards.search(df, asked, shard_rows=60).collect())


def test_hadamard_keeps_lengths():
    rows = np.random.default_rng(1).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(cross_polytope.hadamard(rows), axis=1), np.linalg.norm(rows, axis=1))
    assert np.allclose(cross_polytope.hadamard(cross_polytope.hadamard(rows)), rows)

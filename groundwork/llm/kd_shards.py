"""Exact top-k search by inner product with one k-d tree for each shard.

Rows are cut into shards of bounded size. A shard's tree splits at medians down to small leaves, each
with the tight bounding box of its rows. For a query, the largest inner product a box allows bounds all
its rows; leaves are visited best bound first, until the bound falls below the k-th score known so far.

That k-th score is propagated: every query first searches one shard, and its k-th score there is a
valid floor for all other shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import best_rows, matrix, usable_vectors
from groundwork.operators.blocks import join_blocks

SHARD_ROWS = 8192
LEAF_ROWS = 128
HIT = "query_id long, vec_id long, score long"
NO_HITS = pa.table({name: pa.array([], pa.int64()) for name in ("query_id", "vec_id", "score")})


def leaves(rows: np.ndarray, leaf_rows: int = LEAF_ROWS) -> list[np.ndarray]:
    """Row numbers of each leaf: split at the median of the widest side until a leaf is small enough.

    The split is by position, so any number of equal rows is still halved.
    """
    done, open_nodes = [], [np.arange(len(rows))]
    while open_nodes:
        node = open_nodes.pop()
        if len(node) <= leaf_rows:
            done.append(node)
            continue
        part = rows[node]
        widest = int(np.argmax(part.max(0) - part.min(0)))
        half = len(node) // 2
        order = np.argpartition(part[:, widest], half)
        open_nodes += [node[order[:half]], node[order[half:]]]
    return done


class Tree:
    """The leaves of a shard with their boxes; rows are kept leaf by leaf."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
        parts = leaves(rows, leaf_rows)
        order = np.concatenate(parts)
        self.ids, self.rows = ids[order], rows[order]
        self.ends = np.cumsum([len(p) for p in parts])
        self.starts = self.ends - np.array([len(p) for p in parts])
        self.low = np.minimum.reduceat(self.rows, self.starts, axis=0)
        self.high = np.maximum.reduceat(self.rows, self.starts, axis=0)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each box allows, for each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def best(self, query_id: int, query: np.ndarray, bound: np.ndarray, floor: float, k: int):
        """The k best (score, id) at or above `floor`, best first, ties to the smaller id; own id left out."""
        scores, ids = np.zeros(0), np.zeros(0, np.int64)
        for leaf in np.argsort(-bound, kind="stable"):
            if bound[leaf] < floor:
                break
            span = slice(self.starts[leaf], self.ends[leaf])
            found = self.rows[span] @ query
            near = (found >= floor) & (self.ids[span] != query_id)
            if not near.any():
                continue
            scores, ids = np.concatenate([scores, found[near]]), np.concatenate([ids, self.ids[span][near]])
            if len(scores) >= k:
                order = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[order], ids[order]
                floor = max(floor, scores[-1])
        order = np.lexsort((ids, -scores))[:k]
        return scores[order], ids[order]


def in_shard(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """All queries of a block against the tree of one shard."""
    if not left.num_rows or not right.num_rows:
        return NO_HITS
    tree = Tree(right["id"].to_numpy(), matrix(right["vector"]))
    asked, ids, floors = matrix(left["vector"]), left["id"].to_numpy(), left["floor"].to_numpy()
    out = []
    for at in range(0, len(asked), 1024):
        bounds = tree.bounds(asked[at : at + 1024])
        for i in range(len(bounds)):
            score, found = tree.best(ids[at + i], asked[at + i], bounds[i], floors[at + i], k)
            out.append((np.full(len(found), ids[at + i]), found, score.astype(np.int64)))
    return pa.table({name: np.concatenate([o[j] for o in out]) for j, name in enumerate(("query_id", "vec_id", "score"))})


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, row_id: str = "vec_id", vector: str = "embedding",
           shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest integer inner product, its own id left out.

    Components are first turned into floor(1024 x) (of x as a double; sums stay exact while components
    are below 2**20). Rows whose id or vector is null, empty, of another length than most, or holds a
    null or non-finite component take no part; zero vectors do. Repeated rows are candidates each; a
    query id that occurs twice is searched once. Ties go to the smaller vec_id. An empty table gives an
    empty result.
    """
    def steps(x):
        return F.floor(x * 1024).cast("double")

    rows = usable_vectors(vectors, row_id, vector, steps, zero_allowed=True)
    asked = usable_vectors(queries, row_id, vector, steps, zero_allowed=True)
    asked = asked.groupBy("id").agg(F.min("vector").alias("vector"))
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.col("id"), F.lit("shard")), F.lit(shards)).cast("int"))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        return in_shard(left, right, k)

    # First pass: each query in one shard. The cell is the shard, so queries are spread over all of them.
    first = asked.withColumn("block_cell", F.pmod(F.xxhash64(F.col("id"), F.lit("first")), F.lit(shards)).cast("int"))
    first = first.withColumn("floor", F.lit(float("-inf")))
    own = join_blocks(first, rows.withColumnRenamed("shard", "block_cell"), "id", "id", pair, HIT, shard_rows)
    floors = own.groupBy("query_id").agg(F.min("score").cast("double").alias("floor"), F.count("*").alias("n"))
    floors = floors.filter(F.col("n") >= k).select(F.col("query_id").alias("id"), "floor")
    # Second pass: every query in every shard, from that floor up.
    asked = asked.join(floors, "id", "left").na.fill(float("-inf"), ["floor"]).withColumn("block_cell", F.lit(0))
    rows = rows.drop("shard").withColumn("block_cell", F.lit(0))
    hits = join_blocks(asked, rows, "id", "id", pair, HIT, shard_rows)
    ranked = best_rows(hits, "query_id", [F.col("score").desc(), F.col("vec_id")], k, "vec_id")
    return ranked.select("query_id", "rank", "vec_id", "score")

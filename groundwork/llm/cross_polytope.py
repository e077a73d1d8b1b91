"""Approximate nearest neighbours by cross-polytope hashing.

Each table turns unit vectors by a fast pseudo-rotation (three rounds of random signs and a Hadamard
transform) and hashes them to the nearest signed axis. A query probes the signed axes nearest to it in
every table. Candidates meet their queries in blocks of a bucket and are ranked by the exact inner
product of the original vectors.

Every row is indexed in `tables` buckets. A bucket of any size is cut into equal blocks, so none is
dropped or capped and no task holds more than a block of each side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import as_lists, best_rows, matrix, usable_vectors
from groundwork.operators.blocks import join_blocks

HIT = "query_id long, vec_id long, score double"
# Above the rounding error of a double inner product of unit-size vectors, relative to the vectors' lengths.
SLACK = 1e-9


@dataclass(frozen=True)
class Hashing:
    """`tables` independent rotations; `probes` signed axes visited in each; `seed` of the random signs."""

    tables: int = 10
    probes: int = 12
    seed: int = 42

    def rotated(self, unit: np.ndarray, number: int) -> np.ndarray:
        """Unit vectors padded to a power of two and turned by rotation `number`."""
        size = 1 << max(1, (unit.shape[1] - 1).bit_length())
        turned = np.zeros((len(unit), size))
        turned[:, : unit.shape[1]] = unit
        signs = np.random.default_rng([self.seed, number]).choice([-1.0, 1.0], (3, size))
        for row in signs:
            turned = hadamard(turned * row)
        return turned

    def nearest_axes(self, unit: np.ndarray, number: int, count: int) -> np.ndarray:
        """For each row the `count` nearest signed axes: axis 2i is +e_i, axis 2i + 1 is -e_i."""
        turned = self.rotated(unit, number)
        signed = np.stack([turned, -turned], 2).reshape(len(turned), -1)
        return np.argsort(-signed, axis=1, kind="stable")[:, : min(count, signed.shape[1])]


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The orthonormal fast Hadamard transform of each row."""
    n, size = rows.shape
    out, half = rows, 1
    while half < size:
        pairs = out.reshape(n, size // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, size)
        half *= 2
    return out / np.sqrt(size)


def bucketed(vectors: DataFrame, hashing: Hashing, count: int) -> DataFrame:
    """One row for each vector and bucket: block_cell, id, vector. `count` axes in each table."""

    def run(batches):
        for batch in batches:
            rows = matrix(batch.column("vector"))
            if not len(rows):
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            # Scaled by the largest component first, so that squares of very large ones stay finite.
            unit = rows / np.abs(rows).max(1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            for number in range(hashing.tables):
                axes = hashing.nearest_axes(unit, number, count)
                width = axes.shape[1]
                cells = axes.astype(np.int32) + np.int32(number * 2 * (1 << max(1, (rows.shape[1] - 1).bit_length())))
                yield pa.record_batch([pa.array(cells.ravel()), pa.array(np.repeat(ids, width)),
                                       as_lists(np.repeat(rows, width, 0))], ["block_cell", "id", "vector"])

    return vectors.select("id", "vector").mapInArrow(run, "block_cell int, id long, vector array<double>")


def scored(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> pa.Table:
    """The k best rows of a block for each query of a block, other than the query's own.

    A matrix product finds who may be among the k best; a sum in fixed order gives the score, so copies
    of a vector score alike wherever they lie.
    """
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lengths = np.linalg.norm(rows, axis=1).max()
    with np.errstate(over="ignore", invalid="ignore"):
        for at in range(0, len(queries), 256):
            own = queries[at : at + 256]
            rough = own @ rows.T
            rough[query_ids[at : at + 256, None] == row_ids[None, :]] = -np.inf
            kept = min(k, rough.shape[1])
            floor = np.partition(rough, rough.shape[1] - kept, axis=1)[:, rough.shape[1] - kept]
            floor = floor - SLACK * np.linalg.norm(own, axis=1) * lengths
            who, what = np.nonzero((rough >= floor[:, None]) & (rough > -np.inf))
            exact = (own[who] * rows[what]).sum(1)
            # Ties beyond the k best: only the k first by (score, id) can be in the result.
            order = np.lexsort((row_ids[what], -exact, who))
            who, what, exact = who[order], what[order], exact[order]
            first = np.searchsorted(who, who)
            cut = np.arange(len(who)) - first < k
            hits.append((query_ids[at + who[cut]], row_ids[what[cut]], exact[cut]))
    return pa.table({"query_id": np.concatenate([h[0] for h in hits]), "vec_id": np.concatenate([h[1] for h in hits]),
                     "score": np.concatenate([h[2] for h in hits])})


NO_HITS = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, hashing: Hashing = Hashing(),
           row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, its own id left out.

    `vectors` and `queries` both hold `row_id` and `vector`; other columns are ignored. Rows whose id is
    null, or whose vector is null, empty, zero, of another length than most, or holds a null or
    non-finite component, take no part. An id that occurs twice is found once, by its best vector, and
    searched once, by the vector that sorts first. Ties go to the smaller vec_id. An empty
    table gives an empty result.
    """
    rows = usable_vectors(vectors, row_id, vector)
    asked = usable_vectors(queries, row_id, vector).groupBy("id").agg(F.min("vector").alias("vector"))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return NO_HITS
        return scored(matrix(left["vector"]), left["id"].to_numpy(), matrix(right["vector"]), right["id"].to_numpy(), k)

    hits = join_blocks(bucketed(asked, hashing, hashing.probes), bucketed(rows, hashing, 1), "id", "id", pair, HIT)
    # The same row is found through several tables.
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best_rows(hits, "query_id", [F.col("score").desc(), F.col("vec_id")], k, "vec_id")
    return ranked.select("query_id", "rank", "vec_id", "score")

"""Join two sides of vectors block by block, with no task larger than a block of each.

Rows meet when they share `block_cell`. A cell of any size is cut into blocks of about `block_rows`
rows on both sides, and every left block meets every right block of its cell exactly once, as one
group of a cogroup. So a cell with a third of all rows is many equal groups, not one large one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 4000
# Tasks of one join; beyond it a task takes several pairs of blocks, one after the other.
MAX_PARTS = 20_000


def cell_counts(rows: DataFrame) -> np.ndarray:
    """Rows in each cell, by number. The driver holds one figure for each cell, never a row."""
    counted = rows.groupBy("block_cell").count().toArrow()
    cells = counted.column("block_cell").to_numpy()
    counts = np.zeros(int(cells.max()) + 1 if len(cells) else 1, np.int64)
    counts[cells] = counted.column("count").to_numpy()
    return counts


def join_blocks(left: DataFrame, right: DataFrame, left_id: str, right_id: str,
                pair: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block_rows: int = BLOCK_ROWS,
                left_counts: np.ndarray | None = None, right_counts: np.ndarray | None = None) -> DataFrame:
    """Apply `pair` to each (left block, right block) of each cell; both sides have `block_cell`."""
    left_counts = cell_counts(left) if left_counts is None else left_counts
    right_counts = cell_counts(right) if right_counts is None else right_counts
    cells = max(len(left_counts), len(right_counts))

    def blocks(counts: np.ndarray) -> Column:
        number = np.zeros(cells, np.int64)
        number[: len(counts)] = -(-counts // block_rows)
        return F.element_at(F.lit([int(n) for n in number]), F.col("block_cell") + 1)

    def spread(rows: DataFrame, row_id: str, own: str, own_blocks: Column, other: str, other_blocks: Column) -> DataFrame:
        return (
            rows.filter(other_blocks > 0)
            .withColumn(f"{own}_block", F.pmod(F.xxhash64(row_id), own_blocks).cast("int"))
            .withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), other_blocks - 1)))
        )

    # Work grows with the product of the block sizes and not with bytes, so the partitions are not
    # merged by their bytes: there are as many as pairs of
    # blocks, but no fewer than a shuffle has and no more than MAX_PARTS.
    keys = ["block_cell", "left_block", "right_block"]
    pairs = np.zeros(cells, np.int64)
    pairs[: len(left_counts)] = -(-left_counts // block_rows)
    pairs[: len(right_counts)] *= -(-right_counts // block_rows)
    pairs[len(right_counts):] = 0
    at_least = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(max(int(pairs.sum()), at_least), MAX_PARTS)
    lefts = spread(left, left_id, "left", blocks(left_counts), "right", blocks(right_counts))
    rights = spread(right, right_id, "right", blocks(right_counts), "left", blocks(left_counts))
    return (
        lefts.repartition(parts, *keys).groupBy(*keys)
        .cogroup(rights.repartition(parts, *keys).groupBy(*keys))
        .applyInArrow(pair, schema)
    )

"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.session import ship

SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a given table, with this package at hand for its Python workers."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def best_rows(rows: DataFrame, key: str, order: list[Column], k: int, spread_by: str) -> DataFrame:
    """The first `k` rows of each key with their `rank` from 1.

    Rows of a key are first cut to k in each of SALTS parts, so one key with very many rows is never
    ranked by one task.
    """
    salted = rows.withColumn("_part", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)))
    part = Window.partitionBy(key, "_part").orderBy(*order)
    salted = salted.withColumn("_at", F.row_number().over(part)).filter(F.col("_at") <= k).drop("_at", "_part")
    whole = Window.partitionBy(key).orderBy(*order)
    return salted.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)


def usable_vectors(rows: DataFrame, row_id: str, vector: str, scale: Callable[[Column], Column] | None = None,
                   zero_allowed: bool = False) -> DataFrame:
    """(id, vector): rows with an id and a vector of the commonest length without null, NaN or infinity.

    The vector comes as array<double>, after `scale`, a function of a column, is applied to its
    components if it is given.
    """
    kept = rows.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = kept.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    length = kept.select(F.mode(F.size("vector"), deterministic=True).alias("n")).first().n
    kept = kept.filter(F.size("vector") == F.lit(length or 0))
    if not zero_allowed:
        kept = kept.filter(F.exists("vector", lambda x: x != 0))
    return kept if scale is None else kept.withColumn("vector", F.transform("vector", scale))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(column) == 0:
        return np.zeros((0, 0))
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def as_lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of lists of doubles."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def row_key(row_id: Column, text: Column) -> Column:
    """Two 64-bit hashes: rows with the same id and text share it, and no others in practice."""
    return F.concat(F.hex(F.xxhash64(text, row_id)), F.hex(F.xxhash64(F.lit(1), row_id, text)))

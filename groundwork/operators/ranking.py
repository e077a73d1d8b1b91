"""The first k rows of each key, whatever the number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def first_of_each(rows: DataFrame, key: str, order: list[Column | str], k: int, spread_by: str = "ticket_id") -> DataFrame:
    """`rows` with `rank` from 1, down to rank `k` of each key.

    The rows of a key are first cut to k in each of PARTS parts, so the last step ranks at most
    k x PARTS rows for a key even where every task of a large scan hands in k of its own.
    """
    parts = Window.partitionBy(key, "part").orderBy(*order)
    whole = Window.partitionBy(key).orderBy(*order)
    return (rows.withColumn("part", F.pmod(F.xxhash64(spread_by), F.lit(PARTS)))
            .withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= k).drop("part")
            .withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k))

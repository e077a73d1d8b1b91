"""Checked broadcasts: a side is broadcast only after its row count has been bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Rows of a few hundred bytes each, so tens of megabytes at most.
MAX_BROADCAST_ROWS = 100_000


def fits(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """True when `df` has at most `max_rows` rows; reads no more than one row beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


def held(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """`df` as a local table if it has at most `max_rows` rows, and whether it has.

    For the question side of a search: it is computed once here instead of in every join it is part
    of. No more than one row beyond the bound is ever fetched.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True

"""Upserts by key, and putting a new version of a table in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions.vectors import from_text, to_text


def upsert_replace(target: DataFrame, batch: DataFrame, key: str = "ticket_id") -> DataFrame:
    """Rows of `batch` take the place of rows with the same key, whole."""
    return target.join(batch.select(key), key, "left_anti").unionByName(batch)


def upsert_embedding(target: DataFrame, batch: DataFrame, key: str = "ticket_id",
                     column: str = "embedding") -> DataFrame:
    """Rows with a known key only take a new `column`; rows with a new key are added whole."""
    t, b = target.alias("t"), batch.alias("b")
    known, given = F.col(f"t.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()

    def value(name: str):
        if name == column:
            return F.when(given, F.col(f"b.{name}")).otherwise(F.col(f"t.{name}"))
        # an existing null stays null, so the key decides and not the value
        return F.when(known, F.col(f"t.{name}")).otherwise(F.col(f"b.{name}"))

    joined = t.join(b, F.col(f"t.{key}") == F.col(f"b.{key}"), "full_outer")
    return joined.select(*[value(name).alias(name) for name in target.columns])


def publish(rows: DataFrame, table: str, new_path: str) -> None:
    """Write a new version beside the one being read, then point the table at it."""
    spark = rows.sparkSession
    rows.write.mode("errorifexists").parquet(new_path)
    if spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{new_path}'")
        spark.catalog.refreshTable(table)
    else:
        spark.catalog.createTable(table, path=new_path, source="parquet")


def export_vectors(rows: DataFrame, path: str, column: str = "embedding", mode: str = "errorifexists") -> None:
    """Vectors as text with seven decimals, for stores that take text."""
    rows.withColumn(column, to_text(column)).write.mode(mode).parquet(path)


def import_vectors(spark: SparkSession, path: str, column: str = "embedding") -> DataFrame:
    return spark.read.parquet(path).withColumn(column, from_text(column))

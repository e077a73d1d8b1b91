"""A table that takes upserts without being rewritten: base parts by key range, change files, a manifest for each version.

A table is a folder. Its rows are cut by ranges of the key into parts, and each part is a folder of files. An upsert
writes its own rows, by the same ranges, and a new manifest that lists the folders of all parts; no file that is
there is touched. A reader takes a version: parts without changes are read as they are, the others are merged by key.
Compaction writes the parts that have changes anew and leaves the others. A manifest is written once, under the number
of its version, so of two writers that start from one version the second fails and nothing of the first is lost.

Keys are unique and not null in the table and in a batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE, REPLACE, COLUMN = "base", "replace", "column"
# Parts of a new table unless the caller names another number, and keys drawn for each to find the ranges.
PARTS, DRAWN = 64, 50
MANIFEST = "part int, kind string, sequence int, folder string, n bigint"


@dataclass(frozen=True)
class Versions:
    """A table at `path` with the key and the column that `upsert_column` sets."""

    spark: SparkSession
    path: str
    key: str
    column: str

    def manifest(self, version: int | None = None) -> tuple[int, DataFrame]:
        """The number of a version, the last unless it is given, and its parts."""
        every = self.spark.read.schema(f"{MANIFEST}, version int").parquet(f"{self.path}/manifest")
        at = every.agg(F.max("version")).first()[0] if version is None else version
        return at, every.filter((F.col("version") == at) & (F.col("part") >= 0)).drop("version")

    def _commit(self, entries: list[tuple], version: int) -> None:
        # The folder must not be there: this is what makes the second of two writers fail. A line that is no part
        # stands for a version without rows.
        self.spark.createDataFrame([*entries, (-1, BASE, version, "", 0)], MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/version={version}")

    def _part(self) -> Column:
        """The part of a key: the number of bounds up to it. There are as many bounds as parts."""
        bounds = self.spark.read.parquet(f"{self.path}/bounds").orderBy("bound").toArrow().column("bound").to_pylist()
        return _part_of(bounds, F.col(self.key))

    def _write(self, rows: DataFrame, kind: str, sequence: int) -> list[tuple]:
        """Files of `rows` by part, and the manifest's entries for them."""
        folder = f"{kind}-{sequence}-{uuid.uuid4().hex}"
        placed = rows.withColumn("part", self._part()).repartitionByRange("part", self.key)
        placed.sortWithinPartitions("part", self.key).write.partitionBy("part").parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType())]))
        counted = written.parquet(f"{self.path}/{folder}").groupBy("part").count().collect()  # one row for each part
        return [(r["part"], kind, sequence, f"{folder}/part={r['part']}", r["count"]) for r in counted]

    def _entries(self, version: int | None = None) -> tuple[int, list[tuple]]:
        at, rows = self.manifest(version)
        return at, [tuple(r) for r in rows.collect()]

    def upsert_replace(self, batch: DataFrame) -> None:
        """Rows of the batch take the place of rows with the same key, whole."""
        self._upsert(batch, REPLACE)

    def upsert_column(self, batch: DataFrame) -> None:
        """Rows with a known key only take a new `column`; rows with a new key are added whole."""
        self._upsert(batch, COLUMN)

    def _upsert(self, batch: DataFrame, kind: str) -> None:
        version, entries = self._entries()
        changes = self._write(batch.select(*self.schema().names), kind, version + 1)
        self._commit(entries + changes, version + 1)

    def schema(self):
        return self.spark.read.parquet(f"{self.path}/empty").schema

    def _folders(self, entries: list[tuple]) -> DataFrame:
        """The rows of some folders with the kind and sequence of each."""
        rows = None
        for kind, sequence in sorted({(e[1], e[2]) for e in entries}):
            paths = [f"{self.path}/{e[3]}" for e in entries if (e[1], e[2]) == (kind, sequence)]
            read = self.spark.read.schema(self.schema()).parquet(*paths)
            read = read.withColumns({"_kind": F.lit(kind), "_sequence": F.lit(sequence)})
            rows = read if rows is None else rows.unionByName(read)
        return rows

    def _merged(self, entries: list[tuple]) -> DataFrame:
        """The rows of parts with changes: the last whole row of a key, with the last value of the column.

        A change of the column counts as a whole row only where there is no other, and then the earliest does.
        """
        names = self.schema().names
        whole = F.when(F.col("_kind") == COLUMN, -F.col("_sequence")).otherwise(F.col("_sequence"))
        rest = F.struct(*[F.col(n) for n in names if n not in (self.key, self.column)])
        found = self._folders(entries).groupBy(self.key).agg(
            F.max_by(rest, whole).alias("_rest"), F.max_by(F.struct(self.column), F.col("_sequence")).alias("_last"))
        return found.select(*[F.col(self.key) if n == self.key else F.col(f"_last.{n}") if n == self.column else F.col(f"_rest.{n}").alias(n)
                              for n in names])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version. Parts without changes are not shuffled."""
        return self._read(self._entries(version)[1])

    def _read(self, entries: list[tuple]) -> DataFrame:
        changed = {e[0] for e in entries if e[1] != BASE}
        still = [e for e in entries if e[0] not in changed]
        touched = [e for e in entries if e[0] in changed]
        rows = self.spark.createDataFrame([], self.schema())
        if still:
            rows = self._folders(still).drop("_kind", "_sequence")
        return rows.unionByName(self._merged(touched)) if touched else rows

    def compact(self) -> None:
        """Write the parts that have changes as base parts; the others stay as they are."""
        version, entries = self._entries()
        changed = {e[0] for e in entries if e[1] != BASE}
        if changed:
            rows = self._merged([e for e in entries if e[0] in changed])
            self._commit([e for e in entries if e[0] not in changed] + self._write(rows, BASE, version + 1), version + 1)

    def release(self) -> list[str]:
        """Delete the folders that the last version does not list; older versions can no longer be read then. Returns
        what was deleted. For times when nobody writes."""
        at, entries = self._entries()
        used = {e[3] for e in entries}
        every = self.spark.read.schema(f"{MANIFEST}, version int").parquet(f"{self.path}/manifest")
        old = sorted({r.folder for r in every.filter("part >= 0").select("folder").distinct().collect()} - used)
        versions = [r.version for r in every.select("version").distinct().collect() if r.version != at]
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in [*old, *[f"manifest/version={v}" for v in versions]]:
            place = jvm(f"{self.path}/{name}")
            place.getFileSystem(conf).delete(place, True)
        return old


def _part_of(bounds: list, key: Column) -> Column:
    limits = np.array(bounds, dtype=object if bounds and isinstance(bounds[0], str) else None)

    @F.arrow_udf("int")
    def part(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            if column.null_count:
                raise ValueError("a key is null")
            values = column.to_numpy(zero_copy_only=False)
            yield pa.array(np.searchsorted(limits, values, side="right") if len(limits) else np.zeros(len(values), int), pa.int32())

    return part(key)


def create(rows: DataFrame, path: str, key: str, column: str, parts: int = PARTS) -> Versions:
    """A new table of `rows` in a new folder that all executors reach. Ranges hold about the same number of keys."""
    spark = rows.sparkSession
    table = Versions(spark, path, key, column)
    drawn = rows.select(key).orderBy(F.xxhash64(key), key).limit(parts * DRAWN).toArrow().column(key).to_pylist()
    drawn = sorted(set(drawn))
    cuts = sorted({drawn[len(drawn) * i // parts] for i in range(1, parts)} if drawn else set())
    spark.createDataFrame([(c,) for c in cuts], rows.select(F.col(key).alias("bound")).schema).coalesce(1).write.mode("errorifexists").parquet(f"{path}/bounds")
    rows.limit(0).write.parquet(f"{path}/empty")
    table._commit(table._write(rows, BASE, 0), 0)
    return table


def open_versions(spark: SparkSession, path: str, key: str, column: str) -> Versions:
    return Versions(spark, path, key, column)

"""A keyword index that takes new, changed and deleted tickets without being built anew.

The index is a row of segments. A change writes one segment, with the postings of its own tickets only, and says which
tickets of earlier segments are dead from now on. What the dead tickets add to the statistics is written with them, as
negative counts, so the frequencies, the number of tickets and their mean length of a version are plain sums and equal
those of an index that is built anew from the tickets of that version. `at` gives a version as a `KeywordIndex`, and every
search of index.py and impact.py runs on it.

Tables, all in one folder: `postings` by segment and folder of the stem, `documents` by segment (the stems of each ticket,
sorted by id), `deaths` and `frequencies` by change and segment, and a manifest for each version: what each change
adds to each segment in tickets and tokens. A change reads the lists of `documents` to find its dead tickets, and
neither texts nor postings of others. Nothing that is there is rewritten. The manifest is written last and only
once under its number: a change that fails leaves no trace in it, and of two that start from one version the second fails.

Merging puts segments of about the same size together, without their dead tickets, so that there are few of them.

Ticket ids are unique and not null in a batch (else ValueError, and nothing changes). A null text is an empty one.
A deleted id that the index lacks is no error.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators.index import POSTINGS, KeywordIndex, folder_of, folders_for, postings_by_stem, stems_of

# So many segments of about one size are merged; sizes are alike within a factor of it.
FANOUT = 8
STEMS = "array<struct<stem:string,tf:int>>"
SCHEMAS = {
    "postings": f"segment string, {POSTINGS}",
    "documents": f"ticket_id string, doc_len int, stems {STEMS}, segment string",
    "deaths": f"ticket_id string, doc_len int, stems {STEMS}, change string, segment string",
    "frequencies": "part int, stem string, df bigint, n_tickets bigint, change string, segment string",
    "manifest": "change string, segment string, size bigint, tokens bigint, folders int, version int",
}


@dataclass(frozen=True)
class Entry:
    """What a change adds to a segment: its tickets where the segment is its own, else less the dead ones."""

    change: str
    segment: str
    size: int
    tokens: int


@dataclass(frozen=True)
class Segments:
    spark: SparkSession
    path: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def _entries(self, version: int | None = None) -> tuple[int, int, list[Entry]]:
        """The number of a version, the last unless it is given, the number of folders, and the entries."""
        every = self._table("manifest")
        at = every.agg(F.max("version")).first()[0] if version is None else version
        rows = every.filter(F.col("version") == at).collect()  # a few for each segment
        if not rows:
            raise ValueError(f"no version {at} of the index")
        return at, rows[0].folders, [Entry(r.change, r.segment, r.size, r.tokens) for r in rows]

    def _commit(self, version: int, folders: int, entries: list[Entry]) -> None:
        rows = [(e.change, e.segment, e.size, e.tokens, folders) for e in entries]
        schema = SCHEMAS["manifest"].removesuffix(", version int")
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/version={version}")

    def _of(self, table: str, entries: list[Entry]) -> DataFrame:
        """The rows of a table that belong to some entries; other folders are not read."""
        rows = self._table(table).filter(F.col("segment").isin(sorted({e.segment for e in entries})))
        by_change = "change" in rows.columns
        return rows.filter(F.col("change").isin(sorted({e.change for e in entries}))) if by_change else rows

    def _alive(self, table: str, entries: list[Entry]) -> DataFrame:
        """Rows of `postings` or `documents` less those of dead tickets. A ticket dies in one segment at a time."""
        deaths = [e for e in entries if e.change != e.segment]
        rows = self._of(table, entries)
        if not deaths:
            return rows
        return rows.join(self._of("deaths", deaths).select("segment", "ticket_id"), ["segment", "ticket_id"], "left_anti")

    def _write(self, name: str, documents: DataFrame, postings: DataFrame, folders: int) -> Entry:
        """A segment with its frequencies."""
        documents = documents.select("ticket_id", "doc_len", "stems")
        documents.repartitionByRange("ticket_id").sortWithinPartitions("ticket_id").write.parquet(f"{self.path}/documents/segment={name}")
        placed = postings.select("stem", "ticket_id", "doc_len", "tf", "hits", folder_of(F.col("stem"), folders).alias("part"))
        (placed.repartitionByRange("part", "stem", "ticket_id").sortWithinPartitions("part", "stem", "ticket_id")
         .write.partitionBy("part").parquet(f"{self.path}/postings/segment={name}"))
        own = Entry(name, name, 0, 0)
        counted = self._of("postings", [own]).groupBy("part", "stem").agg(
            F.count_if(F.col("tf") > 0).alias("df"), F.count("*").alias("n_tickets"))
        counted.sortWithinPartitions("part").write.parquet(f"{self.path}/frequencies/change={name}/segment={name}")
        total = self._of("documents", [own]).agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("tokens")).first()
        return Entry(name, name, total.n, total.tokens)

    def _checked(self, name: str) -> None:
        ids = self._of("documents", [Entry(name, name, 0, 0)]).groupBy("ticket_id").count()
        if not ids.filter(F.col("ticket_id").isNull() | (F.col("count") > 1)).isEmpty():
            raise ValueError("a batch has a null ticket id or one ticket id twice")

    def _bury(self, name: str, ids: DataFrame, entries: list[Entry], folders: int) -> list[Entry]:
        """Write the living tickets of `ids` as dead, with their negative counts."""
        found = self._alive("documents", entries).join(ids, "ticket_id", "left_semi")
        (found.select("ticket_id", "doc_len", "stems", "segment")
         .write.partitionBy("segment").parquet(f"{self.path}/deaths/change={name}"))
        dead = self._table("deaths").filter(F.col("change") == name)
        held = dead.select("segment", F.inline("stems")).groupBy("segment", folder_of(F.col("stem"), folders).alias("part"), "stem")
        counted = held.agg((-F.count_if(F.col("tf") > 0)).alias("df"), (-F.count("*")).alias("n_tickets"))
        counted.write.mode("append").partitionBy("segment").parquet(f"{self.path}/frequencies/change={name}")
        lost = dead.groupBy("segment").agg(F.count("*").alias("n"), F.sum("doc_len").alias("tokens")).collect()
        return [Entry(name, r.segment, -r.n, -r.tokens) for r in lost]

    def change(self, upserted: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Add the tickets of `upserted` (ticket_id, search_text), in place of those with the same ids, and take out
        those of `deleted` (ticket_id). An id in both is upserted."""
        version, folders, entries = self._entries()
        name = uuid.uuid4().hex
        batch = self.spark.createDataFrame([], "ticket_id string, search_text string") if upserted is None else upserted
        own = self._write(name, stems_of(batch), postings_by_stem(batch), folders)
        self._checked(name)
        ids = self._of("documents", [own]).select("ticket_id")
        gone = ids if deleted is None else ids.unionByName(deleted.select("ticket_id"))
        self._commit(version + 1, folders, [*entries, own, *self._bury(name, gone, entries, folders)])

    def at(self, version: int | None = None) -> KeywordIndex:
        """A version, the last unless it is given, for the searches of index.py and impact.py."""
        _, folders, entries = self._entries(version)
        frequencies = self._of("frequencies", entries).groupBy("part", "stem").agg(
            F.sum("df").alias("df"), F.sum("n_tickets").alias("n_tickets")).filter(F.col("n_tickets") > 0)
        size, tokens = sum(e.size for e in entries), sum(e.tokens for e in entries)
        return KeywordIndex(self._alive("postings", entries).drop("segment"), frequencies, folders, size, tokens / size if size else 0.0)

    def sizes(self, version: int | None = None) -> dict[str, int]:
        """The living tickets of each segment."""
        sizes: dict[str, int] = defaultdict(int)
        for e in self._entries(version)[2]:
            sizes[e.segment] += e.size
        return dict(sizes)

    def merge(self, fanout: int = FANOUT, everything: bool = False) -> int:
        """Merge segments of about one size where there are `fanout` of them, or all; returns how many were merged."""
        tiers: dict[int, list[str]] = defaultdict(list)
        for name, size in self.sizes().items():
            tiers[0 if everything else int(math.log(max(size, 1), fanout))].append(name)
        merged = 0
        for _, names in sorted(tiers.items()):
            if len(names) >= (2 if everything else fanout):
                version, folders, entries = self._entries()
                some = [e for e in entries if e.segment in names]
                own = self._write(uuid.uuid4().hex, self._alive("documents", some), self._alive("postings", some), folders)
                self._commit(version + 1, folders, [e for e in entries if e.segment not in names] + [own])
                merged += len(names)
        return merged

    def release(self) -> list[str]:
        """Delete what the last version does not list; older versions can no longer be read then. Returns the folders.
        For times when nobody writes."""
        at, _, entries = self._entries()
        history = self._table("manifest").select("change", "segment", "version").distinct().collect()
        segments = {r.segment for r in history} - {e.segment for e in entries}
        changes = {r.change for r in history} - {e.change for e in entries}
        old = [f"{table}/segment={s}" for s in sorted(segments) for table in ("documents", "postings")]
        old += [f"{table}/change={c}" for c in sorted(changes) for table in ("deaths", "frequencies")]
        old += [f"manifest/version={v}" for v in sorted({r.version for r in history} - {at})]
        context = self.spark.sparkContext
        for name in old:
            place = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
        return old


def create(tickets: DataFrame, path: str, folders: int | None = None) -> Segments:
    """A new index of `tickets` (ticket_id, search_text) in a new folder that all executors reach, as one segment."""
    made = Segments(tickets.sparkSession, path)
    folders = folders or folders_for(tickets.count())
    name = uuid.uuid4().hex
    own = made._write(name, stems_of(tickets), postings_by_stem(tickets), folders)
    made._checked(name)
    tickets.sparkSession.createDataFrame([], SCHEMAS["deaths"]).write.partitionBy("change", "segment").parquet(f"{path}/deaths")
    made._commit(0, folders, [own])
    return made


def open_segments(spark: SparkSession, path: str) -> Segments:
    return Segments(spark, path)

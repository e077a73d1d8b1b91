"""Near-duplicates by SimHash: fingerprints are embedded as bit counts of their segments.

A fingerprint of 64 bits is cut into segments, and the number of bits set in each segment is a point.
The Manhattan distance of two points is never more than the Hamming distance of their fingerprints, so
all links lie within that radius in the grid. Points within distance 2 share a grid cell at distance at
most 1 from both: every distinct fingerprint is put into its own cell and the cells next to it, cells
are joined by equality, and pairs are verified exactly.

Equal fingerprints are one node from the start, so a group of copies of any size costs one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import row_key
from groundwork.llm.components import components
from groundwork.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \\x09-\\x0D"
BITS = 64
SEGMENTS = 16
MAX_DISTANCE = 2
# Hashes whose bits are counted at once, so a very long text needs no more memory than this.
CHUNK = 1 << 16


def shingle_hashes(text: Column, words: int) -> Column:
    """XXH64 with seed 42 of every shingle; the whole sequence if it has fewer words; empty if none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    # regexp_replace first: a leading separator would otherwise give an empty word.
    found = F.filter(F.split(lowered, f"[{SPACE}]+"), lambda w: w != "")

    def hashed(all_words: Column) -> Column:
        count = F.greatest(F.size(all_words) - (words - 1), F.lit(1))
        many = F.transform(F.sequence(F.lit(0), count - 1),
                           lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(all_words, i + j) for j in range(words)])))
        return F.when(F.size(all_words) == 0, F.array().cast("array<bigint>")).otherwise(many)

    # One evaluation of the words for all shingles: a one-element array carries them.
    return F.element_at(F.transform(F.array(found), hashed), 1)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: bit i is set if it is set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    set_bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(set_bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row_key, fp (the fingerprint as a signed long) for every row. A null or blank text has 0."""

    def run(batches):
        for batch in batches:
            column = batch.column("hashes")
            values = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            fps = [majority(values[s:e]) if e > s else 0 for s, e in zip(starts, ends)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("row_key"), pa.array(fps, pa.int64())],
                                  ["doc_id", "row_key", "fp"])

    hashed = docs.select(F.col(row_id).cast("long").alias("doc_id"), row_key(F.col(row_id), F.col(text)).alias("row_key"),
                         shingle_hashes(F.col(text), words).alias("hashes"))
    return hashed.mapInArrow(run, "doc_id long, row_key string, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """a, b with a < b: pairs of distinct fingerprints (column fp) at Hamming distance MAX_DISTANCE or less.

    The cell of a point and its neighbours carry `shift`: 0 for the own cell, +s or -s for one step in
    segment s. A pair at Manhattan distance 0 meets in the own cells only, at 1 in the own cell of one
    and a shifted cell of the other, at 2 in cells shifted differently.
    """
    width = BITS // SEGMENTS
    mask = (1 << width) - 1
    counts = F.array(*[F.bit_count(F.shiftrightunsigned("fp", s * width).bitwiseAND(F.lit(mask))).cast("long")
                       for s in range(SEGMENTS)])
    points = distinct.select("fp", counts.alias("counts"))
    # Counts of 0 to 4, one step beyond on either side: base 8 keeps cells apart.
    packed = F.aggregate("counts", F.lit(0).cast("long"), lambda cell, c: cell * 8 + c + 1)
    points = points.select("fp", packed.alias("cell"))
    steps = [F.struct(F.lit(0).alias("shift"), F.lit(0).cast("long").alias("step"))]
    steps += [F.struct(F.lit(sign * (s + 1)).alias("shift"), F.lit(sign * 8 ** (SEGMENTS - 1 - s)).cast("long").alias("step"))
              for s in range(SEGMENTS) for sign in (1, -1)]
    cells = points.select("fp", "cell", F.explode(F.array(*steps)).alias("s"))
    cells = cells.select("fp", (F.col("cell") + F.col("s.step")).alias("cell"), F.col("s.shift").alias("shift"))
    left = cells.select(F.col("fp").alias("a"), F.col("shift").alias("sa"), "cell")
    right = cells.select(F.col("fp").alias("b"), F.col("shift").alias("sb"), F.col("cell").alias("cell_b"))
    own_a, own_b = F.col("sa") == 0, F.col("sb") == 0
    once = (own_a & own_b) | (own_a & ~own_b) | (~own_a & ~own_b & (F.col("sa") != F.col("sb")))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    near = (F.col("cell") == F.col("cell_b")) & (apart <= MAX_DISTANCE) & (F.col("a") < F.col("b")) & once
    # Both sides have 33 rows for each that Spark counts on, so neither is ever sent whole.
    found = left.join(right.hint("merge"), near)
    return found.select("a", "b").distinct()


def classes(docs: DataFrame, words: int = 3, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row_key, fp, component_id, class_root for every row: its fingerprint and the smallest doc_id
    reachable by links. class_root names the component even where it has no doc_id.

    Fingerprints link at MAX_DISTANCE differing bits or fewer. Null and blank texts have fingerprint 0,
    which links like any other. A row without doc_id keeps a null there but belongs to its component; if
    no row of a component has a doc_id, component_id is null. Repeated rows stay. An empty table gives
    an empty result. Columns other than the two named are ignored.
    """
    prints = materialise(fingerprints(docs, words, row_id, text))
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes))
    joined = nodes.join(roots.hint("merge"), nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = joined.join(smallest, "root").select("fp", "component_id", F.col("root").alias("class_root"))
    return prints.join(placed, "fp").select("doc_id", "row_key", "fp", "component_id", "class_root")


def one_of_each(docs: DataFrame, words: int = 3, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of one row of each component: the one with the smallest doc_id (a null comes last), then
    the smallest hash. Of rows with the same id and text one stays. The rules of `classes` hold."""
    return first_of_each(docs, classes(docs, words, row_id, text), row_id, text)


def first_of_each(docs: DataFrame, found: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that `one_of_each` keeps, for the classes in `found` (doc_id, row_key, class_root)."""
    own = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key"))
    first = found.groupBy("class_root").agg(F.min_by("row_key", own).alias("_key"))
    keyed = docs.withColumn("_key", row_key(F.col(row_id), F.col(text)))
    return keyed.join(first.select("_key"), "_key", "left_semi").dropDuplicates(["_key"]).drop("_key")


def as_hex(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

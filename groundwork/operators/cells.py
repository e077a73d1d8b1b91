"""Approximate search over a corpus stored by cell, and reports that compare two result sets.

Build. Centres are vectors of the corpus, about twice the square root of its size, and a few of them are
coarse. A ticket goes to its nearest coarse centre and from there to the nearest of the centres that belong to
it, so a task holds the coarse centres, or the centres of one group, and none holds all. Each cell keeps its
radius, the largest angle between its centre and a ticket. Rows lie in folders by coarse centre, in order of
cell.

Search. A question first looks into its nearest cells, until these hold a few times k tickets. The k-th distance
found there is its reach. A cell at angle a with radius r holds nothing within a reach t if a - r > t: this
bound is exact, but vectors of many dimensions lie near the rim of no cell, so it rules out few. So cells with
a - share * r <= t are read, and the share of the radius is learned when the corpus is stored: tickets drawn
from it ask, their true neighbours are found by a scan, and the share is the smallest that would reach all but
a few of these. With a share of 1 the search is exact.

Angles are whole millionths of a radian and the share is in thousandths, so any engine takes the same cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.functions.numbers import six_places
from groundwork.functions.vectors import shorten
from groundwork.operators.blocks import BLOCK_ROWS, cell_counts, join_blocks
from groundwork.operators.nearest import HITS, MAX_QUESTIONS, Best, in_pieces, matrix, nearest, unit
from groundwork.operators.ranking import first_of_each
from groundwork.schema import TOP_K
from groundwork.session import materialise

LEAST_CELLS, LEAST_COARSE = 16, 4
# Tickets for each wanted neighbour that a question meets before its reach is known.
FIRST_ROWS = 8
# Tickets that ask when the share is learned, and how many of 1,000 of their neighbours it must reach.
SAMPLE, REACHED = 128, 980
WHOLE_RADIUS = 1000
# An angle beyond all others, for questions that have not met k tickets; and what rounding may hide.
ANY_ANGLE, SLACK = 4_000_000, 2
# Bits of (cell, question) that the driver and each task hold at once: 64 MB.
MAX_BITS = 1 << 29
ROWS_AT_ONCE = 1024
MAX_NAMED = 2000
STORED = "ticket_id string, embedding array<float>, part int, cell int, steps bigint"


_NOTHING = pa.schema([("ticket_id", pa.string()), ("embedding", pa.list_(pa.float32())), ("part", pa.int32()),
                      ("cell", pa.int32()), ("steps", pa.int64())]).empty_table()


@dataclass(frozen=True)
class Cells:
    """rows (part, cell, ticket_id, embedding, steps to the centre), cells (part, cell, centre, n, radius), and the share
    of a radius that counts, in thousandths."""

    rows: DataFrame
    cells: DataFrame
    share: int

    def exact(self) -> "Cells":
        return replace(self, share=WHOLE_RADIUS)


def cells_for(rows: int) -> int:
    """Cells grow with the corpus: a cell has about half as many rows as there are cells."""
    return max(LEAST_CELLS, 2 * math.isqrt(rows))


def coarse_for(centres: int) -> int:
    return max(LEAST_COARSE, math.isqrt(centres))


def angle_steps(cosines: np.ndarray) -> np.ndarray:
    """Angles in millionths, half up."""
    return np.floor(np.arccos(np.clip(cosines, -1.0, 1.0)) * 1e6 + 0.5).astype(np.int64)


def reach_steps(distance: np.ndarray) -> np.ndarray:
    """The angle of a distance that was rounded to six places, with all that rounding may hide."""
    return angle_steps(1.0 - distance - 1e-6) + SLACK


def _draw(corpus: DataFrame, size: int) -> tuple[pa.Table, list[str]]:
    """(ticket_id, cell) of the tickets that give centres, and the ids of those that ask. A random draw by hash
    that any engine can repeat; only ids leave the corpus."""
    wanted = cells_for(size)
    ids = corpus.select("ticket_id").orderBy(F.md5("ticket_id"), "ticket_id").limit(wanted + SAMPLE).toArrow().column("ticket_id")
    first = ids[:wanted]
    return pa.table({"ticket_id": first, "cell": pa.array(np.arange(len(first), dtype=np.int32))}), ids[wanted:].to_pylist()


def _placed(corpus: DataFrame, centres: DataFrame) -> DataFrame:
    """STORED: each ticket in the nearest cell of its nearest coarse centre; ties to the smaller number."""
    spark = corpus.sparkSession
    coarse = centres.orderBy("cell").limit(coarse_for(centres.count())).toArrow()
    numbers = coarse.column("cell").to_numpy()
    shared = spark.sparkContext.broadcast(unit(matrix(coarse.column("embedding"))))

    def nearest_coarse(column: pa.Array) -> np.ndarray:
        return np.argmin(angle_steps(unit(matrix(column)) @ shared.value.T), axis=1)

    @F.arrow_udf("int")
    def group(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(nearest_coarse(column) if len(column) else [], pa.int32())

    @F.arrow_udf("int")
    def own_group(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for vectors, cells in columns:
            if not len(cells):
                yield pa.array([], pa.int32())
                continue
            cells = cells.to_numpy()
            own = np.minimum(np.searchsorted(numbers, cells), len(numbers) - 1)
            yield pa.array(np.where(numbers[own] == cells, own, nearest_coarse(vectors)), pa.int32())

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("cell")
        centre, cell = unit(matrix(right.column("embedding"))), right.column("cell").to_numpy()
        parts = []
        for at in range(0, left.num_rows, ROWS_AT_ONCE):
            rows = left.slice(at, ROWS_AT_ONCE)
            steps = angle_steps(unit(matrix(rows.column("embedding"))) @ centre.T)
            best = steps.argmin(axis=1)
            parts.append(pa.table({
                "ticket_id": rows.column("ticket_id"), "embedding": rows.column("embedding"),
                "part": rows.column("block_cell"), "cell": pa.array(cell[best], pa.int32()),
                "steps": pa.array(steps[np.arange(len(best)), best], pa.int64())}))
        return pa.concat_tables(parts) if parts else _NOTHING

    fine = materialise(centres.withColumn("block_cell", own_group("embedding", "cell")))
    sizes = cell_counts(fine)
    rows = corpus.withColumn("block_cell", group("embedding"))
    # A block of centres holds the largest group, so every ticket meets all centres of its group at once.
    return join_blocks(rows, fine, "ticket_id", "cell", place, STORED, max(BLOCK_ROWS, int(sizes.max())), right_counts=sizes)


def build_cells(corpus: DataFrame, path: str, k: int = TOP_K) -> None:
    """Store `corpus` (ticket_id, embedding) by cell in a new folder that all executors reach, and learn the share of a
    radius for searches of k. Tickets without direction are near nothing and are not stored."""
    spark = corpus.sparkSession
    corpus = corpus.select("ticket_id", "embedding").filter(F.exists("embedding", lambda x: x != 0))
    drawn, asking = _draw(corpus, corpus.count())
    named = spark.createDataFrame(drawn, "ticket_id string, cell int")
    # Copies of a vector are one centre.
    centres = materialise(corpus.join(F.broadcast(named), "ticket_id").groupBy("embedding").agg(F.min("cell").alias("cell")))
    placed = materialise(_placed(corpus, centres))
    order = ["part", "cell", "ticket_id"]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("part").parquet(f"{path}/rows")
    counted = placed.groupBy("part", "cell").agg(F.count("*").alias("n"), F.max("steps").alias("radius"))
    counted.join(centres.withColumnRenamed("embedding", "centre"), "cell").write.parquet(f"{path}/cells")
    found = Cells(spark.read.schema(STORED).parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells"), WHOLE_RADIUS)
    share = _learned(found, corpus, asking, k)
    spark.createDataFrame([(share, k)], "share int, k int").write.parquet(f"{path}/learned")


def open_cells(spark: SparkSession, path: str) -> Cells:
    return Cells(spark.read.schema(STORED).parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells"),
                 spark.read.parquet(f"{path}/learned").first().share)


def _learned(found: Cells, corpus: DataFrame, asking: list[str], k: int) -> int:
    """The share that reaches REACHED of 1,000 true neighbours of the tickets that ask, themselves left out."""
    spark = corpus.sparkSession
    questions = corpus.filter(F.col("ticket_id").isin(asking)).select(F.col("ticket_id").alias("question_id"), F.col("embedding").alias("q_vector"))
    asked = _Asked(questions)
    if not asked.names:
        return WHOLE_RADIUS
    own = F.col("question_id") != F.col("ticket_id")
    true = first_of_each(nearest(corpus, questions, k + 1).drop("rank").filter(own), "question_id", ["distance", "ticket_id"], k)
    cell_of = found.rows.select("ticket_id", "cell").join(F.broadcast(true.select("question_id", "ticket_id")), "ticket_id")
    pairs = cell_of.select("question_id", "cell").toArrow()  # SAMPLE x k
    first = asked.first_cells(found, k)
    met = first_of_each(asked.visit(found, first, k + 1).filter(own), "question_id", ["distance", "ticket_id"], k)
    reach = asked.reach(met.toArrow(), k)
    wanted = sorted(set(pairs.column("cell").to_pylist()))
    cells = found.cells.filter(F.col("cell").isin(wanted)).select("cell", "centre", "radius").toArrow().sort_by("cell")
    radius = cells.column("radius").to_numpy()
    number = {name: i for i, name in enumerate(asked.names)}
    q = np.array([number[name] for name in pairs.column("question_id").to_pylist()])
    c = np.searchsorted(cells.column("cell").to_numpy(), pairs.column("cell").to_numpy())
    centres = unit(matrix(cells.column("centre")))
    angle = angle_steps((asked.vectors[q] * centres[c]).sum(axis=1))
    visited = np.array([i in first.get(int(cell), ()) for i, cell in zip(q, pairs.column("cell").to_numpy())], bool)
    needed = np.where(visited | (radius[c] == 0), 0, np.ceil((angle - reach[q]) * 1000 / np.maximum(radius[c], 1)))
    at = -(-REACHED * len(needed) // 1000) - 1
    return int(np.clip(np.sort(needed)[at], 0, WHOLE_RADIUS))


def _routes(vectors: np.ndarray, most: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(question, cell, n, steps): at least the `most` nearest cells of each question, from a piece of the cells at a time."""
    for batch in in_pieces(batches):
        cell = batch.column("cell").to_numpy()
        steps = angle_steps(vectors @ unit(matrix(batch.column("centre"))).T)
        # Angle and number in one integer, so ties fall to the smaller number.
        key = steps * (int(cell.max(initial=0)) + 1) + cell
        near = np.argsort(key, axis=1)[:, :most]
        question = np.repeat(np.arange(len(near), dtype=np.int32), near.shape[1])
        near = near.reshape(-1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(question), pa.array(cell[near], pa.int32()), batch.column("n").take(pa.array(near)),
             pa.array(steps[question, near])], names=["question", "cell", "n", "steps"])


def _within(vectors: np.ndarray, reach: np.ndarray, share: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, bits): the questions whose reach meets each cell, one bit for each, from a piece of the cells at a time."""
    for batch in in_pieces(batches):
        steps = angle_steps(vectors @ unit(matrix(batch.column("centre"))).T)
        radius = batch.column("radius").to_numpy()
        meets = steps * 1000 - share * radius <= reach[:, None] * 1000
        some = np.flatnonzero(meets.any(axis=0))
        bits = [np.packbits(meets[:, i]).tobytes() for i in some]
        yield pa.RecordBatch.from_arrays([batch.column("cell").take(pa.array(some)), pa.array(bits, pa.binary())], names=["cell", "bits"])


class _Asked:
    """A bounded batch of questions, held by the driver and sent to every task."""

    def __init__(self, questions: DataFrame):
        rows = questions.select("question_id", "q_vector").filter(F.exists("q_vector", lambda x: x != 0)).orderBy("question_id").toArrow()
        self.names = rows.column("question_id").to_pylist()
        self.vectors = unit(matrix(rows.column("q_vector")))
        self.spark = questions.sparkSession
        self.shared = self.spark.sparkContext.broadcast(self.vectors)

    def first_cells(self, found: Cells, k: int) -> dict[int, np.ndarray]:
        """The questions that look into each cell first: the nearest cells, until they hold FIRST_ROWS * k tickets."""
        shared, most = self.shared, FIRST_ROWS * k
        routes = found.cells.select("cell", "centre", "n").mapInArrow(
            lambda batches: _routes(shared.value, most, batches), "question int, cell int, n bigint, steps bigint")
        near = first_of_each(routes, "question", ["steps", "cell"], most, spread_by="cell")
        before = F.sum("n").over(Window.partitionBy("question").orderBy("steps", "cell")) - F.col("n")
        rows = near.withColumn("before", before).filter(F.col("before") < most).select("question", "cell").toArrow()
        routed: dict[int, list[int]] = {}
        for question, cell in zip(*[c.to_pylist() for c in rows.columns]):
            routed.setdefault(cell, []).append(question)
        return {cell: np.sort(np.array(asking)) for cell, asking in routed.items()}

    def reach(self, hits: pa.Table, k: int) -> np.ndarray:
        """The angle of each question's k-th hit; of any size, where there are fewer."""
        number = {name: i for i, name in enumerate(self.names)}
        reach = np.full(len(self.names), ANY_ANGLE, np.int64)
        last = hits.filter(pc.equal(hits.column("rank"), k))
        for name, distance in zip(last.column("question_id").to_pylist(), last.column("distance").to_pylist()):
            reach[number[name]] = reach_steps(np.array([distance]))[0]
        return reach

    def cells_in_reach(self, found: Cells, reach: np.ndarray) -> dict[int, np.ndarray]:
        """The questions that must look into each cell, one bit for each while on the way."""
        shared, share = self.shared, found.share
        rows = found.cells.select("cell", "centre", "radius").mapInArrow(
            lambda batches: _within(shared.value, reach, share, batches), "cell int, bits binary").toArrow()
        return {cell: np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(self.names)))
                for cell, bits in zip(*[c.to_pylist() for c in rows.columns])}

    def visit(self, found: Cells, routed: dict[int, np.ndarray], k: int) -> DataFrame:
        """(question_id, ticket_id, distance): at least the k nearest tickets of each question in the cells it is routed to.

        The folders of these cells are a filter on the partition column, so other files are not read.
        """
        names, shared = self.names, self.shared
        routes = self.spark.sparkContext.broadcast(routed)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(names), k)
            for batch in in_pieces(batches):
                cell = batch.column("cell").to_numpy()
                cuts = np.flatnonzero(np.diff(cell)) + 1
                for start, end in zip([0, *cuts], [*cuts, len(cell)]):
                    which = routes.value.get(int(cell[start])) if end > start else None
                    if which is None or not len(which):
                        continue
                    rows = batch.slice(start, end - start)
                    ids = np.array(rows.column("ticket_id").to_pylist(), dtype=object)
                    order = np.argsort(ids.astype(str), kind="stable")
                    vectors = unit(matrix(rows.column("embedding")))[order]
                    best.offer(ids[order], 1.0 - shared.value[which] @ vectors.T, which)
            yield best.table(names)

        numbers = sorted(cell for cell, which in routed.items() if len(which))
        parts = [r.part for r in found.cells.filter(F.col("cell").isin(numbers)).select("part").distinct().collect()]
        rows = found.rows.filter(F.col("part").isin(parts))
        if len(numbers) <= MAX_NAMED:  # a longer list costs more than it skips, and rows of other cells are passed over
            rows = rows.filter(F.col("cell").isin(numbers))
        hits = rows.select("cell", "ticket_id", "embedding").mapInArrow(run, HITS)
        return hits.withColumn("distance", six_places(F.col("distance")))


def _batches(found: Cells, questions: DataFrame) -> Iterator[_Asked]:
    """The questions in batches that a task can hold, by a hash of their id; each reads its cells once."""
    bound = min(MAX_QUESTIONS, max(64, MAX_BITS // max(1, found.cells.count())))
    parts = -(-questions.count() // bound)
    for part in range(parts):
        yield _Asked(questions.filter(F.pmod(F.xxhash64("question_id"), F.lit(parts)) == part) if parts > 1 else questions)


def _searched(found: Cells, questions: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(question_id, rank, distance, ticket_id), and (question_id, candidates): the tickets that each question met."""
    spark = questions.sparkSession
    sizes = dict(zip(*[c.to_pylist() for c in found.cells.select("cell", "n").toArrow().columns]))
    hits = spark.createDataFrame([], HITS)
    visited: list[tuple[str, int]] = []
    for asked in _batches(found, questions):
        if not asked.names or not sizes:
            continue
        first = asked.first_cells(found, k)
        met = first_of_each(asked.visit(found, first, k), "question_id", ["distance", "ticket_id"], k).toArrow()  # questions x k
        later = asked.cells_in_reach(found, asked.reach(met, k))
        for cell, which in first.items():
            later[cell] = np.setdiff1d(later.get(cell, np.zeros(0, np.int64)), which)
        seen = np.zeros(len(asked.names), np.int64)
        for routed in (first, later):
            for cell, which in routed.items():
                seen[which] += sizes[cell]
        visited += zip(asked.names, seen.tolist())
        known = spark.createDataFrame(met.select(["question_id", "ticket_id", "distance"]), HITS)
        hits = hits.unionByName(known).unionByName(asked.visit(found, later, k))
    ranked = first_of_each(hits, "question_id", ["distance", "ticket_id"], k)
    return (ranked.select("question_id", "rank", "distance", "ticket_id"),
            spark.createDataFrame(visited, "question_id string, candidates bigint"))


def approximate_nearest(found: Cells, questions: DataFrame, k: int = TOP_K) -> DataFrame:
    """(question_id, rank, distance, ticket_id) from the cells within reach only."""
    return _searched(found, questions, k)[0]


def overlap(exact: DataFrame, other: DataFrame, k: int) -> DataFrame:
    """(question_id, k, overlap, recall): how much of the exact top k the other result holds."""
    keys = ["question_id", "ticket_id"]
    kept = exact.select(*keys).join(other.select(*keys).withColumn("kept", F.lit(1)), keys, "left")
    return kept.groupBy("question_id").agg(
        F.lit(k).alias("k"), F.count("kept").alias("overlap"),
        F.round(F.count("kept") / F.count("*"), 6).alias("recall"))


def access_report(found: Cells, questions: DataFrame, k: int = TOP_K) -> DataFrame:
    """Exact against approximate for each question: overlap, recall and tickets met."""
    hits, met = _searched(found, questions, k)
    return overlap(nearest(found.rows.select("ticket_id", "embedding"), questions, k), hits, k).join(met, "question_id")


def width_report(corpus: DataFrame, questions: DataFrame, narrow: int, k: int = TOP_K) -> DataFrame:
    """The same questions at full width and at a prefix of `narrow` values."""
    short = nearest(corpus.withColumn("embedding", shorten("embedding", narrow)),
                    questions.withColumn("q_vector", shorten("q_vector", narrow)), k)
    return overlap(nearest(corpus, questions, k), short, k)

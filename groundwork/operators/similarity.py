"""Edges between tickets that read alike but carry different codes, exactly, for a large corpus.

For each ticket: the nearest `per_ticket` others with another code and a distance below a threshold.

Copies. Tickets with the same vector and code have the same neighbours, so they are one source. As
targets, the first `per_ticket` ids of the first `per_ticket + 1` codes of a vector hold every answer:
leaving out any one code still leaves `per_ticket` of the smallest ids. So a vector shared by a third
of all tickets is one source for each code and a handful of targets, and no pairs of copies arise.

Pruning. Vectors are assigned to the nearest of some pivots. Angles obey the triangle inequality, so
a source at angle a from a pivot can only reach targets at an angle between a - t and a + t from it.
A source looks into its own cell first. From then on t is the angle of the last of its `per_ticket` hits
there, or the threshold's if it has fewer, and it visits just the cells whose range meets that band.

If most sources would visit most cells there is nothing to prune, and all is one cell.

Blocks. Each cell is cut into equal blocks (see blocks.py), so a crowded cell is many small tasks. One cell of all rows
has larger blocks, a fixed number of them, as each row is shuffled once for each block of the other side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions.numbers import six_place_steps, six_places
from groundwork.operators.blocks import BLOCK_ROWS, cell_counts, join_blocks
from groundwork.operators.nearest import matrix, unit
from groundwork.schema import SIMILAR_MAX_DISTANCE, SIMILAR_PER_TICKET
from groundwork.session import materialise

# At most 1024 pivots are held by the driver and by each task, whatever the corpus size.
MAX_PIVOTS = 1024
# Beyond this share of visited cells, pruning costs more than it saves.
MAX_VISITED = 0.5
# All rows as one cell are cut in this many blocks on each side, until a block has as many rows as a task may hold (of
# 64 values, 75 MB).
MAX_BLOCKS, MAX_BLOCK_ROWS = 6, 250_000
# Copies of a row in the search inside cells, in the mean.
MEAN_BLOCKS = 1.5
_SLACK = 1e-6
# Sources and targets whose products a task holds at once, the first targets of a block, and the sources that go through
# the tiles together.
_CHUNK, _TILE, _FIRST_TILE, _SOURCES = 512, 2048, 256, 8192
# What six places and the reach's rounding may hide.
_NEAR = 2e-6


def _distinct_vectors(base: DataFrame, per_ticket: int) -> DataFrame:
    """The first ids of each (vector, code), numbered by `place`, and the order of codes in a vector."""
    vector = ["vector_key", "embedding"]
    first_ids = Window.partitionBy(*vector, "error_code").orderBy("ticket_id")
    whole = Window.partitionBy(*vector, "error_code")
    codes = Window.partitionBy(*vector).orderBy("first_id")
    return (
        base.withColumn("place", F.row_number().over(first_ids)).filter(F.col("place") <= per_ticket)
        .withColumn("first_id", F.min("ticket_id").over(whole))
        .withColumn("code_place", F.dense_rank().over(codes))
    )


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit(vectors) @ pivots.T, -1.0, 1.0))


def _in_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot as `block_cell` and the angle to it."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles = _angles(matrix(batch.column("embedding")), pivots)
                cell = angles.argmin(axis=1)
                batch = batch.append_column("block_cell", pa.array(cell.astype(np.int32)))
                yield batch.append_column("angle", pa.array(angles[np.arange(len(cell)), cell]))

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(assign, f"{columns}, block_cell int, angle double")


def _meets(batch: pa.RecordBatch, pivots: np.ndarray, nearest: np.ndarray, farthest: np.ndarray) -> np.ndarray:
    """Which other cells each source has to look into: those whose range of angles meets its own reach."""
    angles = _angles(matrix(batch.column("embedding")), pivots)
    gap = np.maximum(angles - farthest, nearest - angles)
    meets = gap <= batch.column("reach").to_numpy()[:, None] + _SLACK
    meets[np.arange(len(meets)), batch.column("own_cell").to_numpy()] = False
    return meets


def _visit_counts(rows: DataFrame, pivots: np.ndarray, nearest: np.ndarray, farthest: np.ndarray) -> np.ndarray:
    """Visits of each cell. A batch gives one figure for a cell, so no vector moves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                visits = _meets(batch, pivots, nearest, farthest).sum(axis=0)
                cell = np.nonzero(visits)[0]
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(visits[cell].astype(np.int64))],
                                                 names=["block_cell", "visits"])

    counted = rows.select("embedding", "reach", "own_cell").mapInArrow(count, "block_cell int, visits long")
    counted = counted.groupBy("block_cell").agg(F.sum("visits").alias("visits")).toArrow()
    counts = np.zeros(len(pivots), np.int64)
    counts[counted.column("block_cell").to_numpy()] = counted.column("visits").to_numpy()
    return counts


def _visits(rows: DataFrame, pivots: np.ndarray, nearest: np.ndarray, farthest: np.ndarray) -> DataFrame:
    """One row for each other cell that a source has to look into."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, cell = np.nonzero(_meets(batch, pivots, nearest, farthest))
                yield batch.take(pa.array(row)).append_column("block_cell", pa.array(cell.astype(np.int32)))

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(visit, f"{columns}, block_cell int")


def _reach(distance: Column) -> Column:
    """The angle of a distance to six places, with half a step for its rounding."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1.0 - (distance + 1e-6))))


def _block_rows(rows: int) -> int:
    """Rows of a block where all rows are one cell. A row is copied once for each block of the other side, so the number of
    blocks is held at MAX_BLOCKS, and what is shuffled grows with the rows, until a block is as large as a task may hold."""
    return max(BLOCK_ROWS, min(MAX_BLOCK_ROWS, -(-rows // MAX_BLOCKS)))


def _cell_block_rows(sources: np.ndarray, targets: np.ndarray, whole: int) -> int:
    """Rows of a block inside cells: from BLOCK_ROWS on, doubled until a row is copied for MEAN_BLOCKS blocks of its cell in the
    mean, and `whole` at most. So what is shuffled there grows with the rows, however unequal the cells are."""
    cells = min(len(sources), len(targets))
    sources, targets, rows = sources[:cells], targets[:cells], BLOCK_ROWS
    while rows < whole:
        copies = (sources * -(-targets // rows)).sum() + (targets * -(-sources // rows)).sum()
        if copies <= MEAN_BLOCKS * (sources.sum() + targets.sum()):
            break
        rows *= 2
    return min(rows, max(whole, BLOCK_ROWS))


def _first_of_rows(row: np.ndarray, step: np.ndarray, place: np.ndarray, distance: np.ndarray, n: int, k: int):
    """The first k of each row by step and place, as three matrices of n rows; infinite steps where a row has fewer."""
    order = np.lexsort((place, step, row))
    row, step, place, distance = row[order], step[order], place[order], distance[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    kept = rank < k
    out = np.full((n, k), np.inf), np.zeros((n, k), np.int64), np.zeros((n, k))
    for into, values in zip(out, (step, place, distance)):
        into[row[kept], rank[kept]] = values[kept]
    return out


def _single_error(dims: int) -> float:
    """More than the product of two unit vectors can be off in single precision: a rounding for each value and each sum."""
    return (dims + 8) * 2.0 ** -24


def _places(flags: np.ndarray) -> np.ndarray:
    """np.flatnonzero of many flags of which few are set: eight of them are looked at together."""
    whole = len(flags) // 8 * 8
    eights = np.flatnonzero(flags[:whole].view(np.uint64))
    near = (eights[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate((near[flags[near]], whole + np.flatnonzero(flags[whole:])))


def _products(sources: np.ndarray, targets: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The products of some pairs in double precision; all are made where a fair part of them is asked for, so that no more
    values are copied than a matrix of all has."""
    if len(row) * sources.shape[1] > len(sources) * len(targets):
        return (sources @ targets.T)[row, place]
    return np.einsum("ij,ij->i", sources[row], targets[place])


def _near_in_block(max_distance: float, per_ticket: int):
    """For each source of a block, its nearest targets with another code.

    Targets are met in tiles in the order of their ids. A product is looked at again only if it is as near as the last hit
    of its source so far, or as the reach that the source brings. Products are made in single precision first, with a margin
    for all that its rounding can hide; those that pass are made again in double precision, and these alone decide.
    """

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        names = np.array(left.column("ticket_id").to_pylist(), dtype=object)
        ids = np.array(right.column("target_id").to_pylist(), dtype=object)
        order = np.argsort(ids.astype(str), kind="stable")
        ids, targets = ids[order], right.column("target_embedding").take(pa.array(order)).combine_chunks()
        numbers: dict[str, int] = {}
        code = np.array([numbers.setdefault(c, len(numbers)) for c in left.column("error_code").to_pylist()])
        other = np.array([numbers.setdefault(c, len(numbers)) for c in right.column("target_code").to_pylist()])[order]
        bounds = np.full(len(names), float(max_distance))
        if "reach" in left.column_names:
            bounds = np.minimum(bounds, 1.0 - np.cos(left.column("reach").to_numpy()))
        cuts = [0, *range(_FIRST_TILE, len(ids), _TILE), len(ids)] if len(ids) > _FIRST_TILE else [0, len(ids)]
        out: list[list] = [[], [], []]
        for start in range(0, len(names) if len(ids) else 0, _SOURCES):
            group = slice(start, start + _SOURCES)
            sources = unit(matrix(left.column("embedding").slice(start, _SOURCES)))
            single, bound = sources.astype(np.float32), bounds[group].copy()
            best = np.full((len(sources), per_ticket), np.inf), np.zeros((len(sources), per_ticket), np.int64), np.zeros((len(sources), per_ticket))
            for low, high in zip(cuts, cuts[1:]):
                tile = unit(matrix(targets.slice(low, high - low)))
                single_tile = np.ascontiguousarray(tile.T, dtype=np.float32)
                floor = (1.0 - bound - _NEAR - _single_error(tile.shape[1])).astype(np.float32)[:, None]
                parts = []
                for at in range(0, len(sources), _CHUNK):
                    part = slice(at, at + _CHUNK)
                    passed = _places((single[part] @ single_tile >= floor[part]).ravel())
                    if len(passed):
                        row, place = np.divmod(passed, high - low)
                        parts.append((row + at, place, _products(sources[part], tile, row, place)))
                if not parts:
                    continue
                row, place, cosines = (np.concatenate(x) for x in zip(*parts))
                distance = 1.0 - cosines
                step = six_place_steps(distance)
                valid = ((distance <= bound[row] + _NEAR) & (code[group][row] != other[low:high][place]) & (step / 1e6 < max_distance))
                touched, row = np.unique(row[valid], return_inverse=True)
                new = _first_of_rows(row, step[valid], place[valid] + low, distance[valid], len(touched), per_ticket)
                found = [np.hstack((x[touched], y)) for x, y in zip(best, new)]
                first = np.argsort(found[0], axis=1, kind="stable")[:, :per_ticket]  # ids of earlier tiles are smaller
                for into, x in zip(best, found):
                    into[touched] = np.take_along_axis(x, first, axis=1)
                bound = np.minimum(bound, best[0][:, -1] / 1e6)
            row, rank = np.nonzero(np.isfinite(best[0]))
            out[0].append(names[group][row])
            out[1].append(ids[best[1][row, rank]])
            out[2].append(best[2][row, rank])
        source, target, distance = (np.concatenate(x) if x else np.zeros(0, object) for x in out)
        return pa.table({"source": pa.array(source, pa.string()), "dst": pa.array(target, pa.string()),
                         "distance": pa.array(distance, pa.float64())})

    return near


def similar_to(tickets: DataFrame, max_distance: float = SIMILAR_MAX_DISTANCE,
               per_ticket: int = SIMILAR_PER_TICKET, pivots: int | None = None,
               block_rows: int | None = None) -> DataFrame:
    """(src, dst, distance to six places), at most `per_ticket` edges out of each ticket.

    `tickets` has ticket_id, error_code and embedding. Distances are compared after rounding to six
    places, strictly below `max_distance`; of equal distances the smaller ticket id is nearer.
    """
    base = materialise(tickets.select("ticket_id", "error_code", "embedding")
                       .withColumn("vector_key", F.xxhash64("embedding")))
    distinct = materialise(_distinct_vectors(base, per_ticket))
    sources = distinct.filter(F.col("place") == 1).select("ticket_id", "error_code", "embedding")
    targets = distinct.filter(F.col("code_place") <= per_ticket + 1).select(
        F.col("ticket_id").alias("target_id"), F.col("error_code").alias("target_code"), "embedding")

    wanted = pivots or max(1, min(MAX_PIVOTS, int(np.sqrt(distinct.count()) / 4)))
    directed = F.exists("embedding", lambda x: x != 0)
    chosen = (distinct.filter(directed & (F.col("place") == 1) & (F.col("code_place") == 1))
              .select("embedding", "vector_key").orderBy("vector_key").limit(wanted).toArrow())
    schema = "src string, dst string, distance double"
    if chosen.num_rows == 0:
        return tickets.sparkSession.createDataFrame([], schema)
    centres = unit(matrix(chosen.column("embedding")))

    placed = _in_cells(targets.filter(directed), centres)
    ranges = placed.groupBy("block_cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).toArrow()
    nearest, farthest = np.full(len(centres), np.inf), np.full(len(centres), -np.inf)
    cells = ranges.column("block_cell").to_numpy()
    nearest[cells], farthest[cells] = ranges.column("low").to_numpy(), ranges.column("high").to_numpy()

    # First each source looks into its own cell. The distance of its last hit there is its reach from then
    # on; a source with fewer hits keeps the threshold's.
    within = placed.drop("angle").withColumnRenamed("embedding", "target_embedding")
    placed_sources = _in_cells(sources.filter(directed), centres).drop("angle")
    source_counts, target_counts = cell_counts(placed_sources), cell_counts(within)
    whole = block_rows or _block_rows(max(source_counts.sum(), target_counts.sum()))
    block_rows = block_rows or (_cell_block_rows(source_counts, target_counts, whole) if len(cells) > 1 else whole)
    near, schema = _near_in_block(max_distance, per_ticket), "source string, dst string, distance double"
    by_source = Window.partitionBy("source").orderBy("step", "dst")

    def first(hits: DataFrame) -> DataFrame:
        stepped = hits.withColumn("step", six_places(F.col("distance")))
        return stepped.withColumn("place", F.row_number().over(by_source)).filter(F.col("place") <= per_ticket)

    found = join_blocks(placed_sources, within, "ticket_id", "target_id", near, schema, block_rows, source_counts, target_counts)
    if len(cells) > 1:
        inside = materialise(first(found))
        found = inside.select("source", "dst", "distance")
        own = inside.filter(F.col("place") == per_ticket).select(F.col("source").alias("ticket_id"), F.col("step").alias("last"))
        reached = materialise(placed_sources.withColumnRenamed("block_cell", "own_cell").join(own, "ticket_id", "left")
                              .withColumn("reach", _reach(F.coalesce("last", F.lit(float(max_distance))))).drop("last"))
        visit_counts = _visit_counts(reached, centres, nearest, farthest)
        if visit_counts.sum() > min(MAX_VISITED * len(cells), 2 * MAX_BLOCKS) * source_counts.sum():
            # vectors without clusters: cells would only repeat every source, so there is one cell, whose blocks copy
            # each row no more than MAX_BLOCKS times
            visits, within = reached.withColumn("block_cell", F.lit(0)), within.withColumn("block_cell", F.lit(0))
            visit_counts, target_counts = np.array([source_counts.sum()]), np.array([target_counts.sum()])
            found = join_blocks(visits, within, "ticket_id", "target_id", near, schema, whole, visit_counts, target_counts)
        else:
            visits = _visits(reached, centres, nearest, farthest)
            found = found.unionByName(join_blocks(visits, within, "ticket_id", "target_id", near, schema,
                                                  block_rows, visit_counts, target_counts))
    edges = first(found).select("source", "dst", F.col("step").alias("distance"))

    # Every ticket takes the edges of the source with its vector and code, at most `per_ticket` in a
    # list. Sources are one row for each key, so a vector with very many tickets is split as skew.
    listed = edges.groupBy("source").agg(F.collect_list(F.struct("dst", "distance")).alias("edges"))
    known_by = sources.select(F.col("ticket_id").alias("source"), F.xxhash64("embedding").alias("vector_key"),
                              "error_code", "embedding").join(listed, "source")
    members = base.join(known_by, ["vector_key", "error_code", "embedding"])
    return members.select(F.col("ticket_id").alias("src"), F.inline("edges"))

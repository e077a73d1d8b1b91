"""Exact nearest neighbours of a batch of questions over the whole corpus.

The questions are few and the corpus is large, so the corpus never moves: each task reads its own
part once, multiplies Arrow batches with the question matrix and keeps k rows for each question.
Only those leave the task. A window picks the final k. When the questions do not fit the checked
bound, both sides are cut into blocks of equal size and joined block by block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions.numbers import round_exact, six_place_steps, six_places
from groundwork.functions.vectors import cosine_distance
from groundwork.operators.blocks import join_blocks
from groundwork.operators.ranking import first_of_each
from groundwork.schema import TICKET_COLUMNS, TOP_K
from groundwork.sizing import MAX_BROADCAST_ROWS, fits

# 4096 questions of 3072 doubles are 100 MB, the most that is sent to every executor.
MAX_QUESTIONS = 4096
_QUESTION_CHUNK = 512
# Tickets that meet a chunk of questions at once: 4 MB for each matrix of distances, however large an Arrow batch is.
_TICKET_CHUNK = 1024
_SCOPE = ("severity", "domain", "resolved_only", "cells")
HITS = "question_id string, ticket_id string, distance double"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column of equal lengths as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; a row without direction becomes NaN and so is never near anything."""
    length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(length == 0, np.nan, length)


class Best:
    """The k nearest rows so far for each question, ordered by six-place distance, then id."""

    def __init__(self, n_questions: int, k: int):
        self.k = k
        self.ids = [np.zeros(0, object)] * n_questions
        self.distances = [np.zeros(0)] * n_questions
        self.worst = np.full(n_questions, np.inf)

    def add(self, question: int, ids: np.ndarray, distances: np.ndarray) -> None:
        ids = np.concatenate([self.ids[question], ids])
        distances = np.concatenate([self.distances[question], distances])
        order = np.lexsort((ids.astype(str), six_place_steps(distances)))[: self.k]
        self.ids[question], self.distances[question] = ids[order], distances[order]
        if len(order) == self.k:
            self.worst[question] = six_place_steps(distances[order[-1]])

    def offer(self, ids: np.ndarray, distances: np.ndarray, which: np.ndarray) -> None:
        """Distances of the questions numbered `which` (rows) to the tickets `ids` (columns, in order).

        NaN means that the ticket is no candidate.
        """
        steps = six_place_steps(distances)
        for row in np.nonzero((steps <= self.worst[which, None]).any(axis=1))[0]:
            valid = np.nonzero(steps[row] <= self.worst[which[row]])[0]
            if len(valid) > self.k:
                # distance and position in one integer, so ties fall to the smaller id
                key = steps[row, valid].astype(np.int64) * len(ids) + valid
                valid = valid[np.argpartition(key, self.k - 1)[: self.k]]
            self.add(which[row], ids[valid], distances[row, valid])

    def table(self, names: list[str]) -> pa.RecordBatch:
        counts = [len(x) for x in self.ids]
        asked = np.repeat(np.array(names, dtype=object), counts)
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, object)
        distances = np.concatenate(self.distances) if self.distances else np.zeros(0)
        return pa.RecordBatch.from_arrays(
            [pa.array(asked, pa.string()), pa.array(ids, pa.string()), pa.array(distances, pa.float64())],
            names=["question_id", "ticket_id", "distance"],
        )


def _true(flags: pa.Array) -> np.ndarray:
    return pc.fill_null(flags, False).to_numpy(zero_copy_only=False)


def _rows_in_scope(batch: pa.RecordBatch, scope: dict) -> np.ndarray:
    keep = np.ones(batch.num_rows, bool)
    for name in ("severity", "domain"):
        if scope.get(name) is not None:
            keep &= _true(pc.equal(batch.column(name), scope[name]))
    if scope.get("resolved_only"):
        keep &= _true(pc.not_equal(batch.column("resolution"), ""))
    if scope.get("cells") is not None:
        keep &= np.isin(batch.column("cell").to_numpy(zero_copy_only=False), scope["cells"])
    return np.nonzero(keep)[0]


def in_pieces(batches: Iterable[pa.RecordBatch], rows: int = _TICKET_CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `rows` at most, none of them empty."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _scan(names: list[str], asked: np.ndarray, scopes: list[tuple[dict, np.ndarray]], k: int,
          batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    best = Best(len(names), k)
    for batch in in_pieces(batches):
        ids = np.array(batch.column("ticket_id").to_pylist(), dtype=object)
        vectors = unit(matrix(batch.column("embedding")))
        order = np.argsort(ids.astype(str), kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        ids, vectors = ids[order], vectors[order]
        for scope, which in scopes:
            rows = np.sort(place[_rows_in_scope(batch, scope)])
            for start in range(0, len(which) if len(rows) else 0, _QUESTION_CHUNK):
                part = which[start:start + _QUESTION_CHUNK]
                best.offer(ids[rows], 1.0 - asked[part] @ vectors[rows].T, part)
    yield best.table(names)


def _scope_columns(questions: DataFrame) -> list[str]:
    return [c for c in _SCOPE if c in questions.columns]


def _corpus_columns(scope: list[str]) -> list[str]:
    named = {"severity": "severity", "domain": "domain", "resolved_only": "resolution", "cells": "cell"}
    return ["ticket_id", "embedding", *[named[c] for c in scope]]


def within_reach(corpus: DataFrame, scopes: list[dict]) -> DataFrame:
    """The tickets that some scope allows, as a filter that reaches the scan; all, if one scope allows all.

    Only the fields are named that every scope restricts, so the filter is as short as the fields have values.
    """
    for name in ("severity", "domain"):
        wanted = {scope.get(name) for scope in scopes}
        if wanted and None not in wanted:
            corpus = corpus.filter(F.col(name).isin(sorted(wanted)))
    if scopes and all(scope.get("resolved_only") for scope in scopes):
        corpus = corpus.filter(F.col("resolution") != "")
    return corpus


def candidates(corpus: DataFrame, questions: DataFrame, k: int, max_questions: int = MAX_QUESTIONS) -> DataFrame:
    """At least the k nearest in-scope tickets of each question: (question_id, ticket_id, distance)."""
    scope = _scope_columns(questions)
    sample = questions.select("question_id", "q_vector", *scope).limit(max_questions + 1).toArrow()
    corpus = corpus.select(*_corpus_columns(scope))
    if sample.num_rows > max_questions:
        return _candidates_by_block(corpus, questions, scope, k)
    if sample.num_rows == 0:
        return corpus.sparkSession.createDataFrame([], HITS)

    names = sample.column("question_id").to_pylist()
    scopes = _group_scopes(sample.select(scope).to_pylist() if scope else [{}] * len(names))
    shared = corpus.sparkSession.sparkContext.broadcast(unit(matrix(sample.column("q_vector"))))

    corpus = within_reach(corpus, [values for values, _ in scopes])
    return corpus.mapInArrow(lambda batches: _scan(names, shared.value, scopes, k, batches), HITS)


def _group_scopes(rows: list[dict]) -> list[tuple[dict, np.ndarray]]:
    """Questions that share the same filters, so each filter is tested once for each batch."""
    groups: dict[tuple, list[int]] = {}
    for row, values in enumerate(rows):
        key = tuple((name, tuple(v) if isinstance(v, list) else v) for name, v in values.items())
        groups.setdefault(key, []).append(row)
    return [(dict(key), np.array(members)) for key, members in groups.items()]


def _candidates_by_block(corpus: DataFrame, questions: DataFrame, scope: list[str], k: int) -> DataFrame:
    """Questions beyond the bound: equal blocks of both sides, k rows kept for each block pair."""

    def nearest_in_block(left: pa.Table, right: pa.Table) -> pa.Table:
        names = left.column("question_id").to_pylist()
        asked = unit(matrix(left.column("q_vector")))
        scopes = _group_scopes(left.select(scope).to_pylist() if scope else [{}] * len(names))
        return pa.Table.from_batches(_scan(names, asked, scopes, k, iter(right.to_batches())))

    return join_blocks(
        questions.select("question_id", "q_vector", *scope).withColumn("block_cell", F.lit(0)),
        corpus.withColumn("block_cell", F.lit(0)),
        "question_id", "ticket_id", nearest_in_block, HITS)


def nearest(corpus: DataFrame, questions: DataFrame, k: int = TOP_K, max_questions: int = MAX_QUESTIONS) -> DataFrame:
    """The k nearest tickets of each question: (question_id, rank, ticket_id, distance to six places).

    `corpus` has ticket_id and embedding; `questions` has question_id and q_vector, and optionally
    severity, domain, resolved_only (or cells): filters that are met before ranking, never after.
    """
    found = candidates(corpus, questions, k, max_questions).withColumn("step", six_places(F.col("distance")))
    return (
        first_of_each(found, "question_id", ["step", "ticket_id"], k)
        .select("question_id", "rank", "ticket_id", F.col("step").alias("distance"),
                F.col("distance").alias("raw_distance"))
    )


def with_ticket(hits: DataFrame, tickets: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Ticket columns for k hits of each question; the tickets stay in place if the hits are proven few."""
    few = fits(questions.select("question_id"), MAX_BROADCAST_ROWS // k)
    return tickets.select(*TICKET_COLUMNS).join(F.broadcast(hits) if few else hits, "ticket_id")


def search(tickets: DataFrame, corpus: DataFrame, questions: DataFrame, k: int = TOP_K) -> DataFrame:
    """`nearest` with the thirteen ticket columns."""
    hits = nearest(corpus, questions, k).drop("raw_distance")
    return with_ticket(hits, tickets, questions, k).select("question_id", "rank", "distance", *TICKET_COLUMNS)


def plain_english_search(tickets: DataFrame, corpus: DataFrame, questions: DataFrame, k: int = TOP_K) -> DataFrame:
    """Text in, rows out: ranked on the distance to six places, shown to four."""
    hits = nearest(corpus, questions, k).withColumn("distance", round_exact(F.col("raw_distance"), 4))
    return (with_ticket(hits.drop("raw_distance"), tickets, questions, k)
            .select("question_id", "rank", "distance", *TICKET_COLUMNS))


def vector_search(tickets: DataFrame, corpus: DataFrame, vector: Column, k: int = TOP_K) -> DataFrame:
    """One question against the corpus, all in JVM expressions: a top-k of the scan, whose k rows meet the tickets.

    (rank, distance, ticket columns)."""
    measured = corpus.select("ticket_id", six_places(cosine_distance(F.col("embedding"), vector)).alias("distance"))
    first = measured.orderBy(F.col("distance").asc_nulls_last(), "ticket_id").limit(k)
    near = first.filter(F.col("distance").isNotNull())
    ranked = near.withColumn("rank", F.row_number().over(Window.orderBy("distance", "ticket_id")))  # k rows
    return tickets.select(*TICKET_COLUMNS).join(F.broadcast(ranked), "ticket_id").select("rank", "distance", *TICKET_COLUMNS)

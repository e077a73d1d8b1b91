"""Periodic runs of words by seeds and extension along diagonals.

A run with smallest period q is a stretch of consecutive words in which words q apart are identical, at
least LEAST_WORDS words and LEAST_TURNS periods long, that no neighbouring word extends.

Periods are taken by level: level j holds q from 2^j to 2^(j+1)-1. Every run of that level has the same
words at lag q over at least 3*2^j places (5 at level 0), its minimum guaranteed overlap, so grams of that
many words are indexed. Such a gram is no shorter than q, hence inside a run two successive occurrences of
it are exactly q apart (a nearer one would make a divisor of q the period). Successive occurrences in the
same document are therefore all seeds that are needed, at most one for each word and level. A seed is
extended along its diagonal, the places with equal words at lag q, and a table holds for each lag how far it
is covered, so that no later seed of the same stretch is extended again.

Grams are named exactly, not hashed: the name of a gram is the rank of the pair of names of its two halves.
A place whose gram does not recur in its document can be in no longer recurring gram and drops out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 6
LEAST_TURNS = 4
# Words of the documents that are searched at once; a longer document is searched alone, whole.
WORDS_AT_ONCE = 1 << 19
# Places whose words are compared at once when a seed is extended.
STEP = 256

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _named(left: np.ndarray, right: np.ndarray, places: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, names): the places where the pair of names recurs, with a number for each distinct pair."""
    pairs = left * np.int64(total) + right
    _, names, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    recurs = counts[names] > 1
    return places[recurs], names[recurs]


def _gram(names: np.ndarray, places: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams made of the gram at each place and the one `shift` places on, where both recur."""
    places = places[places + shift < len(names)]
    places = places[names[places + shift] >= 0]
    return _named(names[places], names[places + shift], places, len(names))


def _agreeing(codes: np.ndarray, at: int, lag: int) -> int:
    """The first place from `at` on that differs from the one `lag` further, or has none."""
    size, step, last = STEP, at, len(codes) - lag
    while step < last:
        end = min(step + size, last)
        differs = codes[step:end] != codes[step + lag : end + lag]
        if differs.any():
            return step + int(differs.argmax())
        step, size = end, size * 2
    return last


def _agreeing_before(codes: np.ndarray, at: int, lag: int) -> int:
    """The first place of the stretch of agreeing places that ends at `at`."""
    size, end = STEP, at
    while end > 0:
        start = max(0, end - size)
        differs = codes[start:end] != codes[start + lag : end + lag]
        if differs.any():
            return end - int(differs[::-1].argmax())
        end, size = start, size * 2
    return 0


def _extended(codes: np.ndarray, seeds: np.ndarray, lags: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of every run with a seed. Seeds are given by place."""
    furthest: dict[int, int] = {}
    for at, lag in zip(seeds.tolist(), lags.tolist()):
        if at < furthest.get(lag, 0):
            continue
        end = _agreeing(codes, at, lag)
        start = _agreeing_before(codes, at, lag)
        furthest[lag] = end
        length = end - start + lag
        if length >= max(LEAST_WORDS, LEAST_TURNS * lag):
            yield start, length, lag


def runs_in(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start, then period.

    Several documents can be searched as one sequence if no number is in two of them: then no gram
    across a boundary recurs, and no run crosses one.
    """
    names = np.full(len(codes), -1, np.int64)
    places, found = _named(codes, np.zeros(len(codes), np.int64), np.arange(len(codes)), 1)
    names[places] = found
    width, runs = 1, []

    def widen() -> None:
        nonlocal names, places, width
        places, found = _gram(names, places, width)
        names = np.full(len(codes), -1, np.int64)
        names[places] = found
        width *= 2

    level = 0
    while len(places):
        shortest = 1 << level
        overlap = max(LEAST_WORDS - 1, (LEAST_TURNS - 1) * shortest)
        while 2 * width <= overlap and len(places):
            widen()
        at, gram = _gram(names, places, overlap - width)
        order = np.lexsort((at, gram))
        at, gram = at[order], gram[order]
        lags = np.diff(at)
        seeds = (gram[1:] == gram[:-1]) & (lags >= shortest) & (lags < 2 * shortest)
        starts, lags = at[:-1][seeds], lags[seeds]
        by_place = np.argsort(starts)
        starts, lags = starts[by_place], lags[by_place]
        # Of seeds on successive places with one lag only the first is tried.
        first = np.ones(len(starts), bool)
        first[1:] = (np.diff(starts) != 1) | (np.diff(lags) != 0)
        runs += _extended(codes, starts[first], lags[first])
        level += 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _searched(texts: list[bytes]) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """The words and runs of each text. bytes.split() cuts at space and 0x09 to 0x0D."""
    words = [text.split() for text in texts]
    ends = np.cumsum([0] + [len(w) for w in words])
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for doc in words for w in doc), np.int64, int(ends[-1]))
    document = np.repeat(np.arange(len(words)), np.diff(ends))
    found = runs_in(document * len(number) + ids)
    whose = np.searchsorted(ends, [r[0] for r in found], side="right") - 1
    runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for doc, (start, length, period) in zip(whose.tolist(), found):
        runs[doc].append((start - int(ends[doc]), length, period))
    return list(zip(words, runs))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those that a run holds after its first period."""
    if runs:
        kept = bytearray(repeat(1, len(words)))
        for start, length, period in runs:
            kept[start + period : start + length] = bytes(length - period)
        words = [w for w, keep in zip(words, kept) if keep]
    return b" ".join(words)


def _batches(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Texts in groups of about WORDS_AT_ONCE words, by a bound on their number from the size."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) // 2 > WORDS_AT_ONCE:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text) // 2 + 1
    if group:
        yield group


def periodic_runs(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period), collapsed for every row.

    Words are separated by space and 0x09 to 0x0D. A null, empty or blank text has no words, no runs and an
    empty collapsed text. Texts of any length are searched whole. Repeated rows and rows without an id stay.
    Of runs that tie in start both are listed, the smaller period first. An empty table gives an empty
    result. Columns other than the two named are ignored.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            texts = (t.as_py() or b"" for t in batch.column(1))
            for group in _batches(texts):
                found = _searched(group)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids.slice(at, len(group)), "n_words": pa.array([len(w) for w, _ in found], pa.int64()),
                    "runs": _as_structs([runs for _, runs in found]),
                    "collapsed": pa.array([collapsed(w, r) for w, r in found], pa.binary()).cast(pa.string())})
                at += len(group)

    rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def _as_structs(runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    ends = np.cumsum([0] + [len(r) for r in runs]).astype(np.int32)
    flat = np.array([r for doc in runs for r in doc], np.int64).reshape(-1, 3)
    values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(ends), values)

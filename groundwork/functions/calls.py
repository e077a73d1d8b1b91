"""Calls to a model outside Spark: batches by a budget of tokens, a rate, retries, and a ledger of what is done.

The ledger is a table of (digest, answer, error). A text is known by its SHA-256, so equal texts are one call, and a
later run calls only for texts without an answer. Texts are cut into small tasks, and the files of a task are in the
ledger as soon as it ends, also when the job fails later: a lost executor or a stopped run costs the calls of
unfinished tasks and no others.

Each task keeps to its share of the rate. A batch that fails is tried again after growing waits; if it still fails it
is halved, so one text that the model refuses does not take others with it. What fails in the end is noted as an
error and tried again by the next run.
"""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from groundwork.session import materialise

Call = Callable[[Sequence[str]], Sequence]


def about_tokens(text: str) -> int:
    """A cautious guess where the model's own count is not at hand."""
    return len(text) // 3 + 1


@dataclass(frozen=True)
class Limits:
    """What a model allows. `at_once` is the number of tasks that run at the same time, which share the rate;
    `texts_a_task` bounds what a lost executor can cost."""

    tokens_a_batch: int = 8000
    texts_a_batch: int = 64
    tokens_a_minute: float = math.inf
    at_once: int = 8
    texts_a_task: int = 512
    attempts: int = 5
    first_wait: float = 1.0
    longest_wait: float = 60.0
    count: Callable[[str], int] = about_tokens


class Bucket:
    """Tokens that flow in at a rate, up to a second's worth. Taking more than there are waits until they have come."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.clock, self.sleep = rate, clock, sleep
        self.level, self.last = 0.0, clock()

    def take(self, tokens: int) -> None:
        if self.rate == math.inf:
            return
        now = self.clock()
        self.level = min(self.rate, self.level + (now - self.last) * self.rate) - tokens
        self.last = now
        if self.level < 0:
            self.sleep(-self.level / self.rate)


def batches_of(texts: Sequence[str], limits: Limits) -> Iterator[list[int]]:
    """Places of texts, in order, in batches within both bounds; a text beyond the budget is a batch of its own."""
    batch, size = [], 0
    for place, text in enumerate(texts):
        tokens = limits.count(text)
        if batch and (size + tokens > limits.tokens_a_batch or len(batch) == limits.texts_a_batch):
            yield batch
            batch, size = [], 0
        batch.append(place)
        size += tokens
    if batch:
        yield batch


def answered(texts: Sequence[str], call: Call, limits: Limits, bucket: Bucket) -> list[tuple[object, str | None]]:
    """(answer, None) or (None, error) for each text of a batch."""
    error = ""
    for attempt in range(limits.attempts):
        bucket.take(sum(map(limits.count, texts)))
        try:
            answers = list(call(texts))
            if len(answers) != len(texts):
                raise ValueError(f"{len(answers)} answers for {len(texts)} texts")
            return [(a, None) for a in answers]
        except Exception as problem:  # whatever a client raises: it is kept in the ledger
            error = f"{type(problem).__name__}: {problem}"
            if attempt < limits.attempts - 1:
                # Waits differ, so that tasks that were turned away together do not come back together.
                bucket.sleep(min(limits.longest_wait, limits.first_wait * 2 ** attempt) * random.uniform(0.5, 1.0))
    if len(texts) == 1:
        return [(None, error)]
    half = len(texts) // 2
    return [*answered(texts[:half], call, limits, bucket), *answered(texts[half:], call, limits, bucket)]


def ledger(spark: SparkSession, path: str, answer: str = "string") -> DataFrame:
    """(digest, answer, error) of all calls so far. `answer` is the type of an answer."""
    schema = f"digest string, answer {answer}, error string"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)  # so that there is one
    return spark.read.schema(schema).parquet(path)


def with_answers(rows: DataFrame, text: str, call: Call, path: str, answer: str = "string", into: str = "answer",
                 limits: Limits = Limits()) -> DataFrame:
    """Add `into`, what `call` says to the column `text`, from the ledger at `path`; null where the call failed.

    A null text counts as empty. `call` takes a list of texts and gives as many answers of the type `answer`.
    The folder of the ledger must be one that all executors reach, and belongs to one model.
    """
    spark = rows.sparkSession
    said = F.coalesce(F.col(text), F.lit(""))
    keyed = rows.withColumn("_digest", F.sha2(said, 256))
    done = ledger(spark, path, answer).filter("error is null").select("digest").distinct()
    open_texts = keyed.select(F.col("_digest").alias("digest"), said.alias("text")).dropDuplicates(["digest"])
    todo = materialise(open_texts.join(done, "digest", "left_anti"))
    schema = f"digest string, answer {answer}, error string"
    share = limits.tokens_a_minute / 60 / limits.at_once

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Bucket(share)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for places in batches_of(texts, limits):
                found = answered([texts[i] for i in places], call, limits, bucket)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("digest").take(pa.array(places)), pa.array([a for a, _ in found], kind), pa.array([e for _, e in found], pa.string())],
                    names=["digest", "answer", "error"])

    kind = to_arrow_type(T.StructType.fromDDL(schema)["answer"].dataType)
    parts = -(-todo.count() // limits.texts_a_task)
    if parts:
        called = todo.repartition(parts, "digest").mapInArrow(run, schema)
        # By the second algorithm a task's files are final when the task ends, not when the job does.
        called.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("append").parquet(path)
    known = ledger(spark, path, answer).filter("error is null").dropDuplicates(["digest"])
    return keyed.join(known.select(F.col("digest").alias("_digest"), F.col("answer").alias(into)), "_digest", "left").drop("_digest")


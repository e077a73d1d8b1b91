"""Prompt context from retrieved tickets, answers from a supplied model, and checked citations."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions.calls import Limits, with_answers
from groundwork.operators.keyword import keyword_hits
from groundwork.operators.nearest import nearest, with_ticket
from groundwork.schema import ANSWER_POOL, CITATION_PATTERN, TICKET_COLUMNS
from groundwork.session import materialise

# Instructions and wording given to the model.
SYSTEM_LONG = (
    "You are an operations support assistant for an industrial services company. "
    "Answer the engineer's question in at most 120 words, using only the tickets "
    "provided below. Cite the ticket IDs you relied on, in the form INC-2026-01234. "
    "If no tickets are provided, say plainly that we have no record of this "
    "happening before, and stop."
)
SYSTEM_SHORT = (
    "You are an operations support assistant. Answer in at most 100 words, using only the tickets "
    "provided. Cite the ticket IDs you relied on."
)
NO_TICKETS = "(the search returned no tickets)"
STILL_OPEN = "still open"
NO_RECORD = "We have no record of this happening before."

Model = Callable[[Sequence[tuple[str, str]]], Sequence[str]]


def long_block() -> Column:
    """A ticket as the model reads it, with all its facts."""
    hours = F.coalesce(F.col("resolved_hours").cast("string"), F.lit("None"))
    head = F.concat_ws(" | ", "ticket_id", "domain", "asset", "error_code", "severity",
                       F.concat(F.lit("resolved in "), hours, F.lit(" h")))
    return F.concat_ws("\n", head,
                       F.concat(F.lit("  title: "), "title"),
                       F.concat(F.lit("  reported: "), "description"),
                       F.concat(F.lit("  resolution: "),
                                F.coalesce(F.nullif("resolution", F.lit("")), F.lit(STILL_OPEN))))


def short_block() -> Column:
    """A resolved ticket: what was reported and what fixed it."""
    return F.concat_ws("\n", F.concat_ws(" | ", "ticket_id", "title"),
                       F.concat(F.lit("  reported: "), "description"),
                       F.concat(F.lit("  fixed by:  "), "resolution"))


def context(hits: DataFrame, asked: DataFrame, block: Column, *keys: str) -> DataFrame:
    """One text for each row of `asked`: the blocks of its tickets in rank order.

    `hits` holds at most k tickets for each key, so a group is small whatever the corpus is.
    """
    gathered = hits.groupBy(*keys).agg(
        F.count("*").alias("n_tickets"),
        F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda b: b["block"]), "\n")
    return asked.join(gathered, list(keys), "left").select(
        *asked.columns, F.coalesce("n_tickets", F.lit(0)).cast("bigint").alias("n_tickets"),
        F.when(F.col("n_tickets") > 0, text).otherwise(NO_TICKETS).alias("context"))


def prompts(contexts: DataFrame, system: str = SYSTEM_LONG, gap: str = "\n\n") -> DataFrame:
    """Add the instruction and the prompt made of context and question."""
    return contexts.withColumn("system", F.lit(system)).withColumn(
        "prompt", F.concat(F.lit(f"Tickets from our system:{gap}"), "context", F.lit("\n\nQuestion: "), "question"))


def both_sides(tickets: DataFrame, corpus: DataFrame, questions: DataFrame, k: int = ANSWER_POOL) -> DataFrame:
    """The same questions by keyword and, among resolved tickets only, by meaning."""
    keyword = keyword_hits(tickets, questions, k).withColumn("side", F.lit("keyword"))
    scoped = questions.withColumn("resolved_only", F.lit(True))
    semantic = nearest(corpus, scoped, k).select("question_id", "ticket_id", "rank", F.lit("semantic").alias("side"))
    hits = keyword.select("question_id", "ticket_id", "rank", "side").unionByName(semantic)
    return with_ticket(hits, tickets, questions, 2 * k).select("question_id", "side", "rank", *TICKET_COLUMNS)


def compare_prompts(tickets: DataFrame, corpus: DataFrame, questions: DataFrame, k: int = ANSWER_POOL) -> DataFrame:
    """A prompt for each question and side, also where a side found nothing."""
    hits = both_sides(tickets, corpus, questions, k)
    asked = questions.select("question_id", "question", F.explode(F.array(F.lit("keyword"), F.lit("semantic"))).alias("side"))
    return prompts(context(hits, asked, long_block(), "question_id", "side"))


def answer_prompts(tickets: DataFrame, corpus: DataFrame, questions: DataFrame, k: int = ANSWER_POOL) -> DataFrame:
    """A prompt for each question from the nearest resolved tickets in the short form."""
    hits = nearest(corpus, questions.withColumn("resolved_only", F.lit(True)), k)
    asked = questions.select("question_id", "question")
    return prompts(context(with_ticket(hits, tickets, questions, k), asked, short_block(), "question_id"), SYSTEM_SHORT, "\n")


def extractive(pairs: Sequence[tuple[str, str]]) -> list[str]:
    """A stand-in for a model: cites every ticket of the prompt in order."""
    answers = []
    for _, prompt in pairs:
        ids = list(dict.fromkeys(re.findall(CITATION_PATTERN, prompt)))
        answers.append(f"This was seen in {', '.join(ids)}." if ids else NO_RECORD)
    return answers


def _said(system: pa.Array, prompt: pa.Array, model: Model, batch: int) -> pa.Array:
    said = []
    for i in range(0, len(prompt), batch):
        said += model(list(zip(system.slice(i, batch).to_pylist(), prompt.slice(i, batch).to_pylist())))
    return pa.array(said, pa.string())


def generate(prompted: DataFrame, model: Model = extractive, batch: int = 64) -> DataFrame:
    """Add `answer` from `model`, called with batches of (instruction, prompt); no more are Python strings at once."""

    @F.arrow_udf("string")
    def answers(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for system, prompt in columns:
            yield _said(system, prompt, model, batch)

    return prompted.withColumn("answer", answers("system", "prompt"))


def generate_once(prompted: DataFrame, path: str, model: Model = extractive, limits: Limits = Limits()) -> DataFrame:
    """The same with a ledger at `path`: within the limits of a model, and never asking twice for an answer that is there.

    Prompts with equal instruction and text are one call. `answer` is null where the model failed at every try.
    """
    def call(texts: Sequence[str]) -> Sequence[str]:
        return model([tuple(json.loads(t)) for t in texts])

    asked = prompted.withColumn("_call", F.to_json(F.array("system", "prompt")))
    return with_answers(asked, "_call", call, path, limits=limits).drop("_call")


def citations(answers: DataFrame, *keys: str) -> DataFrame:
    """Each cited id once, in the order of first mention: keys, position, ticket_id."""
    found = F.array_distinct(F.regexp_extract_all("answer", F.lit(f"({CITATION_PATTERN})"), F.lit(1)))
    return answers.select(*keys, F.posexplode(found).alias("position", "ticket_id")).withColumn(
        "position", F.col("position") + 1)


def verify(cited: DataFrame, tickets: DataFrame) -> DataFrame:
    """Add `exists`. Only the cited ids of the tickets take part in the last join."""
    known = (tickets.select("ticket_id").join(cited.select("ticket_id").distinct(), "ticket_id", "left_semi")
             .withColumn("known", F.lit(True)))
    return cited.join(known, "ticket_id", "left").select(
        *cited.columns, F.coalesce("known", F.lit(False)).alias("exists"))


def verdict(checked: DataFrame, *keys: str) -> DataFrame:
    """For each answer: how many citations, how many verified, which fail."""
    failing = F.array_sort(F.collect_list(F.when(~F.col("exists"), F.struct("position", "ticket_id"))))
    return checked.groupBy(*keys).agg(
        F.count("*").alias("cited"), F.count_if("exists").alias("verified"),
        F.array_join(F.transform(failing, lambda x: x["ticket_id"]), ", ").alias("failing")
    ).withColumn("all_ok", F.col("cited") == F.col("verified"))


def compare(tickets: DataFrame, corpus: DataFrame, questions: DataFrame, k: int = ANSWER_POOL,
            model: Model = extractive) -> DataFrame:
    """Both answers to each question with their citations checked.

    Answers are written once before the check, so no model is called twice.
    """
    answered = materialise(generate(compare_prompts(tickets, corpus, questions, k), model)
                           .select("question_id", "side", "n_tickets", "answer"))
    checked = verify(citations(answered, "question_id", "side"), tickets)
    listed = checked.groupBy("question_id", "side").agg(
        F.array_sort(F.collect_list(F.struct("position", "ticket_id", "exists"))).alias("listed"))
    cited = F.transform("listed", lambda c: F.struct(c["ticket_id"].alias("ticket_id"), c["exists"].alias("exists")))
    none = F.array().cast("array<struct<ticket_id:string,exists:boolean>>")
    return answered.join(listed, ["question_id", "side"], "left").select(
        "question_id", "side", "n_tickets", "answer", F.coalesce(cited, none).alias("citations"))

"""Tickets, questions and answers derived from the given tables.

Every document is one ticket and every benchmark passage is one question; no row is left out.
The expressions are plain SQL that Spark and DuckDB read alike, so the checks inline the same text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions.embedding import embed, hashed_terms
from groundwork.functions.text import embedding_text, search_text

DIMS = 64

_ESTATE = "cast(substr(source, 4) AS int)"
_DOMAIN = f"concat('D', {_ESTATE} % 4)"
_VARIANT = "CASE WHEN n_chars % 8 < 5 THEN 0 WHEN n_chars % 8 < 7 THEN 1 ELSE 2 END"


def _id_from(number: str) -> str:
    """`INC-year-number`. From number 797,400,000 on the year has five digits and is no citation any more:
    `tickets` fails there rather than lose citations."""
    return (f"concat('INC-', cast(2026 + floor(({number}) / 100000) AS bigint), '-', "
            f"lpad(cast(({number}) % 100000 AS varchar(20)), 5, '0'))")


TICKET_ID = _id_from("doc_id")
LAST_NUMBER = (10_000 - 2026) * 100_000

TICKET_EXPRESSIONS = {
    "ticket_id": TICKET_ID,
    "domain": _DOMAIN,
    "asset": f"concat({_DOMAIN}, '-A', {_ESTATE})",
    "component": f"concat('COMP-', {_ESTATE} % 4, '-', {_VARIANT})",
    "error_code": f"concat('ERR-', 1000 + 100 * ({_ESTATE} % 4) + {_VARIANT})",
    "severity": "CASE WHEN n_chars % 10 = 0 THEN 'Critical' WHEN n_chars % 10 < 4 THEN 'High' "
                "WHEN n_chars % 10 < 8 THEN 'Medium' ELSE 'Low' END",
    "status": "CASE n_chars % 6 WHEN 0 THEN 'In Progress' WHEN 1 THEN 'Closed' ELSE 'Resolved' END",
    "team": f"concat({_DOMAIN}, '-T', doc_id % 3)",
    "title": "split_part(text, chr(10), 1)",
    "description": "substr(text, length(split_part(text, chr(10), 1)) + 2)",
    "resolution": "CASE WHEN n_chars % 6 = 0 THEN '' ELSE concat('Fixed: ', split_part(text, chr(10), -1)) END",
    "resolved_hours": "CASE WHEN n_chars % 6 = 0 THEN NULL ELSE round(cast(n_chars AS double) / 100, 1) END",
}
OPENED_AT = "timestampadd(MINUTE, 15 * (doc_id % 24000), timestamp_ntz'2026-01-06 06:00:00')"

# Citations that an assistant turn might make, some of them to tickets that do not exist.
ANSWER_TEXT = (f"concat(text, ' See ', {_id_from('conv_id')}, ', ', {_id_from('3 * conv_id + turn')}, ' and ', "
               f"{_id_from('conv_id')}, '.')")
ANSWER_ID = "concat('C', conv_id, '-', turn)"

# The questions asked of each kind of search.
CATALOGUE = {
    "keyword": ["ERR-5012", "bearing", "shaking", "vibration"],
    "vector": [
        "equipment shaking when running hard",
        "customers cannot pay at the checkout",
        "we stopped receiving readings from a remote site",
        "ERR-5012",
    ],
    "filtered": [
        "equipment shaking when running hard",
        "customers cannot pay at the checkout",
        "something is overheating",
    ],
    "hybrid": [
        "ERR-5012 vibration at high load",
        "printer stops mid sale ERR-6250",
        "pump knocking under load",
    ],
    "grounded": [
        "A pump is vibrating badly above 80 percent load. Has this happened before, and what fixed it?",
        "A transformer is running hotter than the others on the same bus. What should we check first?",
        "Card payments are being declined more often than normal. What did we do about it last time?",
    ],
    "plain": [
        "vibration and noise from a pump at high load",
        "payments are failing at the checkout",
        "equipment running too hot",
    ],
    "graph": [
        "the terminal freezes in the middle of a transaction",
        "readings stopped arriving from a remote location",
        "equipment running too hot",
        "vibration and noise from a pump at high load",
    ],
}
# Words and phrases that occur in the given texts, next to the catalogue's own terms.
COMMON_TERMS = ["the", "of the", "and to the", "license", "data", "ERR-1002", "ERR-1301"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Over all cores, for work on whole texts, when a scan has fewer splits than there are cores.

    Such a table is smaller than one split (spark.sql.files.maxPartitionBytes) for each core, which
    bounds what is dealt out. A larger one has more splits, however few its files, and stays in place.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def tickets(spark: SparkSession, sf_dir: str, whole_text: bool = False) -> DataFrame:
    """One ticket for each document: a single scan, no join; unused columns are pruned.

    `whole_text` says that the query reads every text, not only short columns.
    """
    documents = table(spark, sf_dir, "documents")
    columns = [f"{sql} AS {name}" for name, sql in TICKET_EXPRESSIONS.items()]
    columns[0] = (f"CASE WHEN doc_id >= {LAST_NUMBER} THEN raise_error('doc_id too large for a ticket id') "
                  f"ELSE {TICKET_ID} END AS ticket_id")
    columns.insert(1, f"{OPENED_AT} AS opened_at")
    return (spread(documents) if whole_text else documents).selectExpr(*columns)


def with_search_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("search_text", search_text())


def with_embedding(rows: DataFrame, dims: int = DIMS) -> DataFrame:
    return embed(rows.withColumn("embedding_text", embedding_text()), "embedding_text", hashed_terms(dims), dims)


def questions(spark: SparkSession, sf_dir: str, panel: str) -> DataFrame:
    """The catalogue's questions for one kind of search and every benchmark passage."""
    asked = spark.createDataFrame(pa.table({
        "question_id": [f"{panel}-{i}" for i, _ in enumerate(CATALOGUE[panel], start=1)],
        "question": CATALOGUE[panel],
    }))
    passages = table(spark, sf_dir, "benchmark").selectExpr(
        "concat('bench-', item_id) AS question_id", "text AS question")
    return passages.unionByName(asked)


def with_vector(asked: DataFrame, dims: int = DIMS) -> DataFrame:
    return embed(asked, "question", hashed_terms(dims), dims, into="q_vector")


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pa.table({"term": CATALOGUE["keyword"] + COMMON_TERMS}))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return said.selectExpr(f"{ANSWER_ID} AS answer_id", f"{ANSWER_TEXT} AS answer")


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors as tickets of their own: id, code (the label) and vector."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        f"{_id_from('vec_id')} AS ticket_id", "concat('ERR-', 1000 + label) AS error_code", "embedding")

"""From raw documents to token ids: five stages, each an operator of groundwork.llm on all that is left."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm import compression_language, disclosure, mixing, pieces, simhash
from groundwork.llm.queries import PIECE_MODEL
from groundwork.session import materialise, ship

# A margin below this is no decision: clear text of any learned language has several times as much.
MIN_MARGIN = 0.004


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear. Learned from those that name theirs; a missing name is filled in."""
    ship(spark)
    model = compression_language.fit(docs)
    judged = compression_language.predict(docs, model, MIN_MARGIN, carry=tuple(docs.columns))
    kept = judged.filter(~F.col("rejected")).withColumn("lang", F.coalesce("lang", "lang_pred"))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id. Near are fingerprints of three-word
    shingles that differ in two bits at most."""
    ship(spark)
    return simhash.one_of_each(docs).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what discloses it replaced; n_chars follows."""
    found = disclosure.marked(docs)
    changed = F.size("_spans") > 0
    text = F.when(changed, disclosure.sanitised(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))
    found = found.withColumn("text", text).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target shares of sources, languages and topics, of as many tokens as these allow."""
    return mixing.mixed(docs, mixing.Mix(meet_targets=True)).filter("_kept").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding gives the text back."""
    ship(spark)
    encoded = pieces.encode(docs, public_tokenizers.path(PIECE_MODEL))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
          ("mixture", mixture), ("tokens", tokens)]

# Compression, learned automata and hashes of segments have no counterpart in SQL: tests/llm checks the
# stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what a stage keeps is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs)
    return docs

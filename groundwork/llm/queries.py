"""The operators of this package as queries over whole tables, and the SQL that they must equal."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm import (
    compression_language,
    conversations,
    cross_polytope,
    disclosure,
    grammar_secrets,
    host_boilerplate,
    kd_shards,
    mixing,
    periodic_runs,
    pieces,
    simhash,
    url_rules,
    word_pieces,
)
from groundwork.llm.common import table

PIECE_MODEL = "piece_bpe_32k.model"
WORD_VOCABULARY = "word_bpe_49k.json"


def joined_spans(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_columns(spans: Column, kinds: tuple[str, ...], base: int) -> list[Column]:
    """The counts of the first `base` kinds, the hash of their spans, and all spans."""
    counts = [F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{kinds[k]}") for k in range(base)]
    own = F.filter(spans, lambda s: s["kind"] < base)
    return [*counts, F.sha2(joined_spans(own, kinds), 256).alias("base_sha256"), joined_spans(spans, kinds).alias("spans")]


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return cross_polytope.search(rows, rows.filter(F.col("vec_id") % 20 == 0), k=20)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grammar_secrets.secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", *span_columns(F.col("spans"), grammar_secrets.KINDS, 3))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = docs.withColumn("held_out", out)
    model = compression_language.fit(docs.filter(~F.col("held_out")))
    return compression_language.predict(docs.drop("lang"), model, carry=("doc_id", "held_out"))


def piece_digests(docs: DataFrame) -> DataFrame:
    def columns(codec: pieces.Codec, ids, texts):
        sizes, digests, decoded = [], [], []
        for text in texts:
            encoded = codec.with_ends(text.as_py())
            sizes.append(len(encoded))
            digests.append(hashlib.sha256(encoded.tobytes()).hexdigest())
            decoded.append(hashlib.sha256(codec.decode_bytes(encoded)).hexdigest())
        return {"doc_id": ids, "n_tokens": pa.array(sizes, pa.int64()), "ids_sha256": pa.array(digests, pa.string()),
                "decoded_sha256": pa.array(decoded, pa.string())}

    return pieces.mapped(docs, public_tokenizers.path(PIECE_MODEL), "doc_id", "text",
                         "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.marked(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", *span_columns(F.col("_spans"), disclosure.KINDS, 4))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages", "page_id", "url"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op8_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return kd_shards.search(rows, rows.filter(F.col("vec_id") % 100 == 0), k=10)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), mixing.Mix(meet_targets=True))
    return found.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
                        F.col("_probability").alias("probability"), F.col("_kept").alias("kept"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_boilerplate.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op11_word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    def columns(codec: word_pieces.Codec, ids, texts):
        sizes, digests, decoded = [], [], []
        for text in texts:
            encoded = codec.encode(text.as_py())
            sizes.append(len(encoded))
            digests.append(hashlib.sha256(codec.decimal(encoded).encode()).hexdigest())
            decoded.append(hashlib.sha256(codec.decode(encoded).encode()).hexdigest())
        return {"doc_id": ids, "n_tokens": pa.array(sizes, pa.int64()), "ids_sha256": pa.array(digests, pa.string()),
                "decoded_sha256": pa.array(decoded, pa.string())}

    return word_pieces.mapped(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(WORD_VOCABULARY),
                              "doc_id", "text", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Texts of a tenth of the documents, by a hash of the id, repeat a stretch of their words to the end."""
    words = F.filter(F.split("text", "[ \\x09-\\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(places, lambda i: F.get(w, i)), " ")).otherwise("")

    once = F.element_at(F.transform(F.array(words), repeated), 1)
    return docs.withColumn("text", F.when(h % 10 == 0, once).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_periods(table(spark, sf_dir, "documents", "doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    # The greatest length first, then the smallest start, then the smallest period.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    found = found.withColumn("longest", longest)
    length, period = F.col("longest.length"), -F.col("longest.shorter")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.before")).alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults: by a hash of a row's place it is dropped, emptied, cut off its stops, repeated or a user's."""
    rows = conversations.prepared(rows)
    place = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = rows.withColumn("h", F.crc32(F.concat_ws(":", *place)) % 20).filter("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies)).drop("col")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = conversations.repair(damaged(rows)).withColumnRenamed("conv_id", "c")
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    figures = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *figures, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_nearest, op2_secrets, op3_language, op4_pieces, op5_personal_data, op6_url_rules, op7_simhash,
           op8_exact_search, op9_mixing, op10_main_text, op11_word_pieces, op12_periodic_runs, op13_conversations, pipeline]
    return {query.__name__: query for query in own}


OP8_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_search": OP8_SQL}

"""Keyword search: phrases, all-terms and structured matches, BM25 and cover density.

A batch of queries is matched in one pass over the texts, which are never shuffled. Each query has an
anchor, the rarest term it needs. A document meets a query only if it holds the anchor, so the
distinct terms of a document are joined with the (small) table of anchors, and the full condition is
tested on the pairs that are left, inside the row that already holds the text. Anchors are rare by
construction, so a stop word that occurs in every document never multiplies rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions.text import is_stop_word, normal_terms, normal_words, padded, phrase_text, stem, tokens
from groundwork.operators.nearest import HITS, Best, with_ticket
from groundwork.operators.ranking import first_of_each
from groundwork.schema import FUSION_DEPTH, TICKET_COLUMNS, TOP_K
from groundwork.sizing import fits, held

# The most queries of a batch that are looked up in each text where it lies.
MAX_QUERIES = 4096
# The most (query, term) weights that every task holds, and the most numbers in one of its arrays.
MAX_WEIGHTS = 20_000
MAX_CELLS_HELD = 1_000_000
# The most numbers in the matrix of term and query weights (64 MB), which is dense.
MAX_MATRIX = 8_000_000
PAIR_BATCH = 100_000


def _text() -> Column:
    """A ticket without a search text has no words, as in the index."""
    return F.coalesce("search_text", F.lit(""))


def raw_words(tickets: DataFrame) -> DataFrame:
    """(ticket_id, words, body): lower-cased tokens of the search text, and the same as one string."""
    return tickets.select("ticket_id", tokens(_text()).alias("words")).withColumn("body", padded("words"))


def normalised_words(tickets: DataFrame) -> DataFrame:
    """The same with stems for tokens and stop words left empty."""
    words = normal_words(tokens(_text())).alias("words")
    return tickets.select("ticket_id", words).withColumn("body", padded("words"))


def _holds(term: Column) -> Column:
    """The body holds the term. Stops at the first occurrence and needs no table of the words."""
    return F.contains("body", F.concat(F.lit(" "), term, F.lit(" ")))


def build_postings(tickets: DataFrame) -> DataFrame:
    """(ticket_id, doc_len, term, pos): every token of every ticket."""
    words = raw_words(tickets)
    return words.select("ticket_id", F.size("words").alias("doc_len"), F.posexplode("words").alias("pos", "term"))


def term_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("ticket_id", "term", "doc_len").agg(F.count("*").alias("tf"))


def terms_of_each(tickets: DataFrame) -> DataFrame:
    """(ticket_id, doc_len, term, tf), counted inside the row that holds the words: they are sorted, and a
    term's count is the distance from its first place to that of the next term."""
    words = raw_words(tickets).select("ticket_id", F.size("words").alias("doc_len"), F.sort_array("words").alias("words"))
    places = F.when(F.col("doc_len") > 0, F.sequence(F.lit(0), F.col("doc_len") - 1)).otherwise(F.array().cast("array<int>"))
    firsts = words.withColumn("firsts", F.filter(places, lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1))))
    counts = F.transform("firsts", lambda at, i: F.struct(
        F.get("words", at).alias("term"), (F.coalesce(F.get("firsts", i + 1), F.col("doc_len")) - at).cast("bigint").alias("tf")))
    return firsts.select("ticket_id", "doc_len", F.inline(counts))


def store_postings(postings: DataFrame, name: str, buckets: int) -> None:
    """A table bucketed by ticket, so grouping by (ticket, anything) needs no shuffle."""
    postings.write.mode("overwrite").bucketBy(buckets, "ticket_id").sortBy("ticket_id", "term").saveAsTable(name)


def vocabulary(tickets: DataFrame) -> DataFrame:
    """(term, stem, is_stop): the distinct tokens of the corpus and their normal form."""
    terms = raw_words(tickets).select(F.explode(F.array_distinct("words")).alias("term")).distinct()
    return terms.select("term", stem(F.col("term")).alias("stem"), is_stop_word(F.col("term")).alias("is_stop"))


def _sided(few: bool):
    return F.broadcast if few else (lambda df: df)


def _anchored(documents: DataFrame, queries: DataFrame, needed: str) -> DataFrame:
    """Pairs of a document and a query whose rarest needed term the document holds, each once.

    `documents` has ticket_id, words and body; `queries` has question_id and the array `needed`.
    """
    queries, few = held(queries, MAX_QUERIES)
    wanted = queries.select("question_id", F.explode(F.array_distinct(needed)).alias("anchor"))
    few = few and fits(wanted)  # queries may be few and long
    terms = documents.select("ticket_id", F.explode(F.array_distinct("words")).alias("anchor"))
    frequency = (terms.join(_sided(few)(wanted.select("anchor").distinct()), "anchor")
                 .groupBy("anchor").agg(F.count("*").alias("df")))
    rarest = Window.partitionBy("question_id").orderBy(F.coalesce("df", F.lit(0)), "anchor")
    anchors = (wanted.join(frequency, "anchor", "left").withColumn("place", F.row_number().over(rarest))
               .filter((F.col("place") == 1) & F.col("df").isNotNull()).select("question_id", "anchor"))
    if few:
        # One row for each query. Cutting the words down to anchors before they are exploded keeps
        # the body from being copied for every word of its document.
        anchors, _ = held(anchors, MAX_QUERIES)
        every = anchors.agg(F.collect_set("anchor")).scalar()
        near = documents.withColumn("anchor", F.explode(F.array_intersect("words", every)))
        return near.join(F.broadcast(queries.join(anchors, "question_id")), "anchor").drop("anchor")
    pairs = terms.join(anchors, "anchor").drop("anchor")
    return pairs.join(queries, "question_id").join(documents, "ticket_id")


def phrase_matches(tickets: DataFrame, queries: DataFrame, text: str = "question", normalise: bool = False) -> DataFrame:
    """(question_id, ticket_id) where the search text holds the tokens of the query side by side."""
    documents = normalised_words(tickets) if normalise else raw_words(tickets)
    words = normal_words(tokens(text)) if normalise else tokens(text)
    asked = queries.select("question_id", words.alias("phrase"))
    asked = asked.withColumn("needed", F.filter("phrase", lambda w: w != ""))
    pairs = _anchored(documents, asked, "needed")
    return pairs.filter(F.contains("body", phrase_text("phrase"))).select("question_id", "ticket_id")


def keyword_hits(tickets: DataFrame, queries: DataFrame, k: int = TOP_K, text: str = "question",
                 normalise: bool = False) -> DataFrame:
    """The first k matches of each query by ticket id: (question_id, ticket_id, rank)."""
    return first_of_each(phrase_matches(tickets, queries, text, normalise), "question_id", ["ticket_id"], k)


def keyword_search(tickets: DataFrame, terms: DataFrame, k: int = TOP_K) -> DataFrame:
    """(term, rank, ticket columns) for each term or phrase in `terms`."""
    asked = terms.select(F.col("term").alias("question_id"), F.col("term").alias("question"))
    hits = keyword_hits(tickets, asked, k)
    return (with_ticket(hits, tickets, asked, k)
            .select(F.col("question_id").alias("term"), "rank", *TICKET_COLUMNS))


def keyword_count(tickets: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, total_matches): all matches of each term, 0 included."""
    asked = terms.select(F.col("term").alias("question_id"), F.col("term").alias("question"))
    counts = phrase_matches(tickets, asked).groupBy("question_id").agg(F.count("*").alias("n"))
    return (terms.join(counts.withColumnRenamed("question_id", "term"), "term", "left")
            .select("term", F.coalesce("n", F.lit(0)).cast("bigint").alias("total_matches")))


def _normal_queries(queries: DataFrame, text: str) -> DataFrame:
    return queries.select("question_id", F.array_distinct(normal_terms(tokens(text))).alias("needed"))


def _all_terms(tickets: DataFrame, queries: DataFrame, text: str) -> DataFrame:
    pairs = _anchored(normalised_words(tickets), _normal_queries(queries, text), "needed")
    return pairs.filter(F.forall("needed", _holds))


def match_all(tickets: DataFrame, queries: DataFrame, text: str = "question") -> DataFrame:
    """(question_id, ticket_id) where every term of the query occurs, stemmed, stop words aside."""
    return _all_terms(tickets, queries, text).select("question_id", "ticket_id")


def web_matches(tickets: DataFrame, queries: DataFrame) -> DataFrame:
    """(question_id, ticket_id) for structured queries.

    `queries` has question_id and the arrays must, any_of and must_not and the string phrase, each
    nullable. A query needs a term in must, phrase or any_of; one with only must_not matches nothing.
    """
    empty = F.array().cast("array<string>")

    def terms_of(name: str) -> Column:
        joined = F.array_join(F.coalesce(F.col(name), empty), " ")
        return F.array_distinct(normal_terms(tokens(joined)))

    asked = queries.select(
        "question_id",
        terms_of("must").alias("q_must"), terms_of("any_of").alias("q_any"), terms_of("must_not").alias("q_not"),
        normal_words(tokens(F.coalesce("phrase", F.lit("")))).alias("in_phrase"),
    ).withColumn("needed", F.array_union("q_must", F.filter("in_phrase", lambda w: w != "")))
    # a phrase of nothing but stop words asks for nothing, and every body holds the empty string
    asked = asked.withColumn("q_phrase", F.when(F.trim(phrase_text("in_phrase")) == "", F.lit(""))
                             .otherwise(phrase_text("in_phrase")))

    asked, few = held(asked, MAX_QUERIES)
    documents = normalised_words(tickets)
    narrow = _anchored(documents, asked.filter(F.size("needed") > 0), "needed").filter(
        F.forall("q_must", _holds) & ((F.size("q_any") == 0) | F.exists("q_any", _holds))
        & F.contains("body", "q_phrase") & ~F.exists("q_not", _holds))

    # Alternatives alone are broad: their pairs are as many as the result, so each pair is kept small.
    broad = asked.filter((F.size("needed") == 0) & (F.size("q_any") > 0))
    roles = (broad.select("question_id", F.explode("q_any").alias("term"), F.lit(False).alias("banned"))
             .unionByName(broad.select("question_id", F.explode("q_not").alias("term"), F.lit(True).alias("banned"))))
    few = few and fits(roles)
    terms = documents.select("ticket_id", F.explode(F.array_distinct("words")).alias("term"))
    pairs = terms.join(_sided(few)(roles), "term").groupBy("question_id", "ticket_id").agg(
        F.bool_or("banned").alias("banned"))
    return (narrow.select("question_id", "ticket_id")
            .unionByName(pairs.filter(~F.col("banned")).select("question_id", "ticket_id")))


def _collection(tickets: DataFrame) -> tuple[Column, Column]:
    """Number of tickets and mean length in tokens, as scalar subqueries."""
    lengths = tickets.select(F.size(tokens(_text())).alias("doc_len"))
    return lengths.agg(F.count("*").cast("double")).scalar(), lengths.agg(F.avg("doc_len")).scalar()


def inverse_frequency(df: Column, size: Column) -> Column:
    return F.log(1 + (size - df + 0.5) / (df + 0.5))


def _wanted_terms(queries: DataFrame, text: str) -> tuple[DataFrame, bool]:
    return held(_normal_queries(queries, text).select("question_id", F.explode("needed").alias("term")), MAX_WEIGHTS)


def _pairs_of(scores: np.ndarray, names: pa.Array, ids: pa.Array) -> Iterator[pa.RecordBatch]:
    """All positive scores of a (query, ticket) matrix as rows, in batches of moderate size."""
    query, ticket = np.nonzero(scores > 0)
    for start in range(0, len(query), PAIR_BATCH):
        q, t = query[start:start + PAIR_BATCH], ticket[start:start + PAIR_BATCH]
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(q)), ids.take(pa.array(t)), pa.array(-scores[q, t])],
            names=["question_id", "ticket_id", "distance"])


def _scored_in_place(tickets: DataFrame, wanted: DataFrame, depth: int | None, k1: float, b: float) -> DataFrame:
    """(question_id, ticket_id, score) without moving a text: each task multiplies its term counts with
    the matrix of query weights. With `depth`, it keeps that many rows for each query; else all."""
    size, mean_length = _collection(tickets)
    documents = normalised_words(tickets)
    frequency = (documents.select(F.explode(F.array_distinct("words")).alias("term"))
                 .join(F.broadcast(wanted.select("term").distinct()), "term")
                 .groupBy("term").agg(F.count("*").alias("df")))
    weights = wanted.join(frequency, "term").select(
        "question_id", "term", inverse_frequency(F.col("df"), size).alias("idf"), mean_length.alias("mean")).toArrow()
    if weights.num_rows == 0:
        return tickets.sparkSession.createDataFrame([], "question_id string, ticket_id string, score double")

    names, terms = pc.unique(weights.column("question_id")), pc.unique(weights.column("term"))
    if len(terms) * len(names) > MAX_MATRIX:
        return _scored_by_join(tickets, wanted, k1, b)
    matrix = np.zeros((len(terms), len(names)))
    matrix[pc.index_in(weights.column("term"), value_set=terms).to_numpy(),
           pc.index_in(weights.column("question_id"), value_set=names).to_numpy()] = weights.column("idf").to_numpy()
    shared = tickets.sparkSession.sparkContext.broadcast((names.to_pylist(), terms.to_pylist(), matrix))
    mean, rows = weights.column("mean")[0].as_py(), max(1, MAX_CELLS_HELD // max(len(terms), len(names)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms, matrix = shared.value
        name_array, term_array = pa.array(names, pa.string()), pa.array(terms, pa.string())
        best, every = Best(len(names), depth or 1), np.arange(len(names))
        for batch in batches:
            order = pc.sort_indices(batch.column("ticket_id"))
            for start in range(0, batch.num_rows, rows):
                part = batch.take(order.slice(start, rows))
                words = part.column("words")
                lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False)
                term = pc.index_in(words.flatten(), value_set=term_array)
                row = np.repeat(np.arange(len(lengths)), lengths)[term.is_valid().to_numpy(zero_copy_only=False)]
                at = row * len(terms) + term.drop_null().to_numpy()
                tf = np.bincount(at, minlength=len(lengths) * len(terms)).reshape(len(lengths), -1)
                gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths / mean)[:, None])
                scores = (gain @ matrix).T
                if depth is None:
                    yield from _pairs_of(scores, name_array, part.column("ticket_id"))
                else:
                    ids = np.array(part.column("ticket_id").to_pylist(), dtype=object)
                    best.offer(ids, np.where(scores > 0, -scores, np.nan), every)
        if depth is not None:
            yield best.table(names)

    found = documents.select("ticket_id", "words").mapInArrow(score, HITS)
    return found.select("question_id", "ticket_id", F.round(-F.col("distance"), 6).alias("score"))


def _scored_by_join(tickets: DataFrame, wanted: DataFrame, k1: float, b: float) -> DataFrame:
    """The same for more weights than a task can hold. Only occurrences of query terms leave the scan,
    counted within each task first."""
    documents = normalised_words(tickets).withColumn("doc_len", F.size("words"))
    size, mean_length = _collection(tickets)
    occurrences = documents.select("ticket_id", "doc_len", F.explode("words").alias("term"))
    found = (occurrences.join(wanted.select("term").distinct(), "term")
             .groupBy("ticket_id", "doc_len", "term").agg(F.count("*").alias("tf")))
    frequency = found.groupBy("term").agg(F.count("*").alias("df"))
    weighted = wanted.join(frequency, "term").select("question_id", "term", inverse_frequency(F.col("df"), size).alias("idf"))

    gain = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / mean_length))
    return (found.join(weighted, "term").groupBy("question_id", "ticket_id")
            .agg(F.round(F.sum(gain), 6).alias("score")))


def bm25(tickets: DataFrame, queries: DataFrame, text: str = "question", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(question_id, ticket_id, score) of every ticket with a query term (Robertson and Zaragoza 2009)."""
    wanted, few = _wanted_terms(queries, text)
    return _scored_in_place(tickets, wanted, None, k1, b) if few else _scored_by_join(tickets, wanted, k1, b)


def best_bm25(tickets: DataFrame, queries: DataFrame, depth: int = FUSION_DEPTH, text: str = "question",
              k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The first `depth` tickets of each query by BM25: (question_id, ticket_id, score, rank)."""
    wanted, few = _wanted_terms(queries, text)
    scores = _scored_in_place(tickets, wanted, depth, k1, b) if few else _scored_by_join(tickets, wanted, k1, b)
    return best_first(scores, depth)


def cover_score(matched: Column, terms: Column) -> Column:
    """The sum over minimal covers of one over their length (after Clarke, Cormack and Tudhope 2000).

    `matched` has pos and term (from 1) of the matched places of a text in order, `terms` is the number
    of terms. It is folded inside the row.
    """
    start = F.struct(F.array_repeat(F.lit(-1), terms).alias("last"), F.lit(-1).alias("low"), F.lit(0.0).alias("score"))

    def step(acc: Column, place: Column) -> Column:
        last = F.transform(acc["last"], lambda x, i: F.when(i + 1 == place["term"], place["pos"]).otherwise(x))
        return F.struct(last.alias("last"), acc["low"].alias("low"), acc["score"].alias("score"), place["pos"].alias("pos"))

    def cover(acc: Column) -> Column:
        low = F.array_min(acc["last"])
        gain = F.when(low > acc["low"], 1.0 / (acc["pos"] - low + 1)).otherwise(0.0)
        return F.struct(acc["last"].alias("last"), F.greatest(low, acc["low"]).alias("low"),
                        (acc["score"] + gain).alias("score"))

    def fold(acc: Column, place: Column) -> Column:
        return F.element_at(F.transform(F.array(step(acc, place)), cover), 1)

    return F.aggregate(matched, start, fold, lambda acc: acc["score"])


def cover_density(tickets: DataFrame, queries: DataFrame, text: str = "question") -> DataFrame:
    """(question_id, ticket_id, score) of every ticket with all query terms, by how close they stand."""
    at = F.transform("words", lambda w, i: F.struct(F.array_position("needed", w).alias("term"), i.alias("pos")))
    score = cover_score(F.filter(at, lambda p: p["term"] > 0), F.size("needed"))
    return _all_terms(tickets, queries, text).select("question_id", "ticket_id", F.round(score, 6).alias("score"))


def best_first(scores: DataFrame, depth: int = FUSION_DEPTH) -> DataFrame:
    """Rank by score, best first, down to `depth`."""
    return first_of_each(scores, "question_id", [F.col("score").desc(), "ticket_id"], depth)

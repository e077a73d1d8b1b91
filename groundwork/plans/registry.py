"""Every operator as a query over the given tables, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions import numbers, text, vectors
from groundwork.functions.embedding import embed, hashed_terms
from groundwork.operators import analytics, cells, expectations, fusion, graph, grounding, impact, index, keyword, nearest, similarity
from groundwork.schema import ANSWER_POOL, FUSION_DEPTH, TICKET_COLUMNS, TICKET_SCHEMA
from groundwork.session import materialise, shared_folder, ship
from groundwork.sizing import held
from groundwork.sources import given, versions
from groundwork.sources.tickets import clean_values, read_raw, read_store, read_tickets, store, to_ticket, write_csv

STORED_THRESHOLD = 0.65
NARROW = given.DIMS // 2
# Codes whose first vectors are broadcast.
MAX_CODES = 10_000
LONE_QUESTION = given.CATALOGUE["vector"][0]


class Setting:
    """The given tables in the forms that the operators take. Everything is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def tickets(self) -> DataFrame:
        return given.tickets(self.spark, self.sf_dir)

    @property
    def whole(self) -> DataFrame:
        return given.tickets(self.spark, self.sf_dir, whole_text=True)

    @property
    def searchable(self) -> DataFrame:
        return given.with_search_text(self.whole)

    @property
    def corpus(self) -> DataFrame:
        return given.with_embedding(self.whole)

    @property
    def stored(self) -> DataFrame:
        return given.stored_vectors(self.spark, self.sf_dir)

    @property
    def answers(self) -> DataFrame:
        return given.answers(self.spark, self.sf_dir)

    @property
    def terms(self) -> DataFrame:
        return given.terms(self.spark)

    def questions(self, panel: str) -> DataFrame:
        return given.questions(self.spark, self.sf_dir, panel)

    def asked(self, panel: str) -> DataFrame:
        return given.with_vector(self.questions(panel))

    def new_path(self, what: str) -> str:
        return f"{shared_folder(self.spark)}/groundwork-{what}-{uuid.uuid4().hex}"

    def similar(self) -> DataFrame:
        return similarity.similar_to(self.corpus)

    def expanded(self) -> DataFrame:
        """Every text is embedded once, for the seeds and for the edges."""
        corpus = materialise(self.corpus.select("ticket_id", "error_code", "embedding"))
        return graph.expand(self.tickets, corpus, self.asked("graph"), similarity.similar_to(corpus))


def scoped(questions: DataFrame) -> DataFrame:
    """Filters for each question, some absent, taken from the length of its text."""
    n = F.length("question")
    return questions.withColumns({
        "severity": F.when(n % 3 == 0, "High").when(n % 3 == 1, "Low"),
        "domain": F.when(n % 5 < 2, F.concat(F.lit("D"), (n % 4).cast("string"))),
        "resolved_only": n % 2 == 0,
    })


def web_queries(questions: DataFrame) -> DataFrame:
    """Three structured queries from all words of each question: all but the last and not the last; the
    whole question as a phrase; the last and any of the others."""
    words = questions.select("question_id", text.tokens("question").alias("w"))
    none, nothing = F.array().cast("array<string>"), F.lit(None).cast("string")
    first = F.filter("w", lambda _, i: i < F.size("w") - 1)
    last = F.filter("w", lambda _, i: i == F.size("w") - 1)

    def kind(name, must, any_of, phrase, must_not):
        return words.select(F.concat_ws("/", "question_id", F.lit(name)).alias("question_id"), must.alias("must"),
                            any_of.alias("any_of"), phrase.alias("phrase"), must_not.alias("must_not"))

    return (kind("must", first, first, nothing, last)
            .unionByName(kind("phrase", none, none, F.array_join("w", " "), none))
            .unionByName(kind("any", last, first, nothing, none)))


def _values(rows: DataFrame, vector: str, *keys: str) -> DataFrame:
    """A vector as one row for each place.

    The outer form: for the other one Spark adds a filter on the size of the vector and pushes it down to the scan, so
    an embedder would run twice. An empty vector's row without a place is dropped after it.
    """
    placed = rows.select(*keys, F.posexplode_outer(vector).alias("dim", "value")).filter(F.col("dim").isNotNull())
    return placed.withColumn("value", F.round(F.col("value").cast("double"), 6))


def _csv(g: Setting) -> str:
    path = g.new_path("csv")
    write_csv(g.whole, path)
    return path


def s1_read_tickets(g: Setting) -> DataFrame:
    """Tickets written as CSV and read back, typed."""
    return read_tickets(g.spark, _csv(g), encoded=True)


def s2_write_tickets(g: Setting) -> DataFrame:
    """The written fields as text: id, title, description and resolution, and the hours as they stand in the file."""
    return read_raw(g.spark, _csv(g), encoded=True).select(
        "ticket_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "description", "resolution")],
        F.coalesce(F.col("resolved_hours").try_cast("double"), F.lit(-1.0)).alias("hours"))


def _stored(g: Setting) -> str:
    path = g.new_path("store")
    store(g.tickets, path)
    return path


def s13_create_and_recreate(g: Setting) -> DataFrame:
    """Rows after creation, after a second creation that must change nothing, and after recreation without D0."""
    path = g.new_path("store")
    counts = []
    for step, (rows, recreate) in enumerate([(g.tickets, False), (g.tickets.filter("domain = 'D1'"), False),
                                             (g.tickets.filter("domain <> 'D0'"), True)]):
        store(rows, path, recreate)
        counts.append(materialise(read_store(g.spark, path).groupBy("domain").agg(F.count("*").alias("n")))
                      .withColumn("step", F.lit(step)))
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).select("step", "domain", "n")


def s14_one_domain(g: Setting) -> DataFrame:
    """One domain of the stored tickets: a filter on the partition column."""
    return read_store(g.spark, _stored(g)).filter(F.col("domain") == "D1").select(*TICKET_COLUMNS)


def s3_to_ticket(g: Setting) -> DataFrame:
    raw = g.whole.select(*[F.col(c).cast("string").alias(c) for c in TICKET_COLUMNS])
    return to_ticket(raw)


def s4_embedding_text(g: Setting) -> DataFrame:
    return g.whole.select("ticket_id", text.embedding_text().alias("embedding_text"))


def s5_search_text(g: Setting) -> DataFrame:
    return g.searchable.select("ticket_id", "search_text")


def s6_embed_batch(g: Setting) -> DataFrame:
    rows = g.whole.select("ticket_id", text.embedding_text().alias("embedding_text"))
    done = embed(rows, "embedding_text", hashed_terms(NARROW), NARROW)
    return done.select("ticket_id", F.size("embedding").alias("dims"), vectors.to_text("embedding").alias("vector_text"))


def s7_hashed_embedding(g: Setting) -> DataFrame:
    return _values(g.corpus, "embedding", "ticket_id")


def s8_embed_questions(g: Setting) -> DataFrame:
    shown = g.asked("vector").select("question_id", F.size("q_vector").alias("dims"), vectors.preview("q_vector").alias("first"))
    return (shown.select("question_id", "dims", F.posexplode_outer("first").alias("dim", "value"))
            .filter(F.col("dim").isNotNull()))


def s9_truncate(g: Setting) -> DataFrame:
    return _values(g.stored.select("ticket_id", vectors.shorten("embedding", NARROW).alias("v")), "v", "ticket_id")


def s10_vector_text(g: Setting) -> DataFrame:
    out = g.stored.select("ticket_id", vectors.to_text("embedding").alias("vector_text"))
    out = out.withColumn("back", vectors.from_text("vector_text"))
    weighted = F.transform("back", lambda x, i: x.cast("double") * (i + 1))
    total = F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x)
    return out.select("ticket_id", "vector_text", F.size("back").alias("values_read_back"), F.round(total, 5).alias("weighted_sum"))


def _target_and_batch(g: Setting) -> tuple[DataFrame, DataFrame]:
    """The given vectors, and the same vectors under other keys: about half of them are known keys."""
    target = given.table(g.spark, g.sf_dir, "embeddings").select("vec_id", "label", "embedding")
    batch = target.select((2 * F.col("vec_id")).alias("vec_id"), (F.col("label") + 100).alias("label"), "embedding")
    return target, batch


def _merged(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", "label", vectors.to_text("embedding").alias("vector_text"))


def _table(g: Setting, target: DataFrame) -> versions.Versions:
    return versions.create(target, g.new_path("versions"), "vec_id", "embedding", parts=16)


def s11_upsert_replace(g: Setting) -> DataFrame:
    """Half of the batch, compacted, then the other half: base parts and change files are read together."""
    target, batch = _target_and_batch(g)
    table = _table(g, target)
    table.upsert_replace(batch.filter("vec_id % 4 = 0"))
    table.compact()
    table.upsert_replace(batch.filter("vec_id % 4 <> 0"))
    return _merged(table.read())


def s12_upsert_embedding(g: Setting) -> DataFrame:
    target, batch = _target_and_batch(g)
    table = _table(g, target)
    table.upsert_column(batch.filter("vec_id % 4 = 0"))
    table.compact()
    table.upsert_column(batch.filter("vec_id % 4 <> 0"))
    return _merged(table.read())


def s15_postings(g: Setting) -> DataFrame:
    return keyword.terms_of_each(g.searchable)


def p1_projection(g: Setting) -> DataFrame:
    return analytics.project(g.tickets)


def p2_filter(g: Setting) -> DataFrame:
    return analytics.where(g.tickets, severity="High", domain="D1", resolved_only=True).select("ticket_id", "domain", "severity")


def p3_resolved(g: Setting) -> DataFrame:
    return analytics.resolved(g.tickets).select("ticket_id", "resolution")


def p4_key_lookup(g: Setting) -> DataFrame:
    first = grounding.citations(g.answers, "answer_id").filter(F.col("position") == 1)
    return analytics.lookup(g.tickets, first).select("ticket_id", "asset", "status")


def p5_key_set(g: Setting) -> DataFrame:
    return analytics.lookup(g.tickets, grounding.citations(g.answers, "answer_id")).select("ticket_id", "domain", "error_code")


def p6_clean_values(g: Setting) -> DataFrame:
    return clean_values(g.tickets).select("ticket_id", "opened_at", "resolved_hours")


def p7_kinds(g: Setting) -> DataFrame:
    return g.expanded().groupBy("question_id", "kind").agg(F.count("*").alias("assets"))


def k1_keyword_search(g: Setting) -> DataFrame:
    return keyword.keyword_search(g.searchable, g.terms)


def k2_keyword_count(g: Setting) -> DataFrame:
    lone = g.terms.filter(F.col("term") == "of the")
    return keyword.keyword_count(g.searchable, lone)


def k3_term_counts(g: Setting) -> DataFrame:
    return keyword.keyword_count(g.searchable, g.terms)


def k4_match_all(g: Setting) -> DataFrame:
    return keyword.match_all(g.searchable, g.questions("hybrid"))


def k5_web_matches(g: Setting) -> DataFrame:
    return keyword.web_matches(g.searchable, web_queries(g.questions("hybrid")))


def k6_bm25(g: Setting) -> DataFrame:
    """The first tickets of each question. `keyword.bm25` gives every ticket with any of its words."""
    return keyword.best_bm25(g.searchable, g.questions("hybrid"))


def k7_cover_density(g: Setting) -> DataFrame:
    return keyword.cover_density(g.searchable, g.questions("hybrid"))


def _indexed(g: Setting) -> index.KeywordIndex:
    path = g.new_path("index")
    index.build_index(g.searchable, path)
    return index.open_index(g.spark, path)


def k1_indexed_search(g: Setting) -> DataFrame:
    return index.keyword_search(_indexed(g), g.whole, g.terms)


def k3_indexed_counts(g: Setting) -> DataFrame:
    return index.keyword_count(_indexed(g), g.terms)


def k4_indexed_match_all(g: Setting) -> DataFrame:
    return index.match_all(_indexed(g), g.questions("hybrid"))


def keyword_blocks(g: Setting) -> impact.Blocks:
    """The keyword index with its blocks, built and opened."""
    path = g.new_path("index")
    index.build_index(g.searchable, path)
    impact.build_blocks(index.open_index(g.spark, path), path)
    return impact.open_blocks(g.spark, path)


def k6_indexed_bm25(g: Setting) -> DataFrame:
    return impact.best_bm25(keyword_blocks(g), g.questions("hybrid"))


def k7_indexed_cover_density(g: Setting) -> DataFrame:
    return index.cover_density(_indexed(g), g.questions("hybrid"))


def k8_vocabulary(g: Setting) -> DataFrame:
    return keyword.vocabulary(g.searchable)


def v1_cosine_distance(g: Setting) -> DataFrame:
    """Each given vector against the first vector of its code."""
    first = g.stored.groupBy("error_code").agg(F.min_by("embedding", "ticket_id").alias("first"))
    distance = numbers.six_places(vectors.cosine_distance(F.col("embedding"), F.col("first")))
    first, few = held(first, MAX_CODES)
    return g.stored.join(F.broadcast(first) if few else first, "error_code").select("ticket_id", distance.alias("distance"))


def v2_vector_search(g: Setting) -> DataFrame:
    vector = F.lit([float(np.float32(x)) for x in hashed_terms(given.DIMS)([LONE_QUESTION])[0]])
    return nearest.vector_search(g.tickets, g.corpus, vector).select(F.lit("vector-1").alias("question_id"), "*")


def v3_filtered_search(g: Setting) -> DataFrame:
    return nearest.search(g.tickets, g.corpus, scoped(g.asked("filtered")))


def v4_plain_english(g: Setting) -> DataFrame:
    return nearest.plain_english_search(g.tickets, g.corpus, g.asked("plain"))


def v5_batch_topk(g: Setting) -> DataFrame:
    return nearest.search(g.tickets, g.corpus, g.asked("vector"))


def stored_cells(g: Setting, corpus: DataFrame | None = None) -> cells.Cells:
    """The corpus stored by cell."""
    path = g.new_path("cells")
    cells.build_cells(materialise(g.corpus.select("ticket_id", "embedding")) if corpus is None else corpus, path)
    return cells.open_cells(g.spark, path)


def v6_approximate(g: Setting) -> DataFrame:
    return cells.approximate_nearest(stored_cells(g), g.asked("vector"))


def v6_every_cell(g: Setting) -> DataFrame:
    """With the whole radius of every cell the search is exact."""
    return cells.approximate_nearest(stored_cells(g).exact(), g.asked("vector"))


def v7_access_report(g: Setting) -> DataFrame:
    return cells.access_report(stored_cells(g), g.asked("vector"))


def v8_width_report(g: Setting) -> DataFrame:
    return cells.width_report(g.corpus, g.asked("vector"), NARROW)


def h1_hybrid_search(g: Setting) -> DataFrame:
    return fusion.hybrid_search(g.searchable, g.corpus, g.asked("hybrid"))


def h2_hybrid_by_hand(g: Setting) -> DataFrame:
    return fusion.hybrid_by_hand(g.searchable, g.corpus, g.asked("hybrid"))


def h1_indexed_hybrid(g: Setting) -> DataFrame:
    corpus = materialise(g.corpus.select("ticket_id", "embedding"))
    return fusion.hybrid_indexed(keyword_blocks(g), g.whole, corpus, g.asked("hybrid"))


def h2_indexed_by_hand(g: Setting) -> DataFrame:
    corpus = materialise(g.corpus.select("ticket_id", "embedding"))
    return fusion.by_hand_indexed(_indexed(g), g.whole, corpus, g.asked("hybrid"))


def h3_candidates(g: Setting) -> DataFrame:
    asked = g.asked("hybrid")
    semantic = nearest.nearest(g.corpus, asked, FUSION_DEPTH).select("question_id", "ticket_id", "rank", F.lit("semantic").alias("side"))
    lexical = keyword.best_first(keyword.cover_density(g.searchable, asked)).select("question_id", "ticket_id", "rank", F.lit("lexical").alias("side"))
    return semantic.unionByName(lexical)


def h4_rank_only(g: Setting) -> DataFrame:
    return h1_hybrid_search(g).select("question_id", "rank", "ticket_id")


def a1_total(g: Setting) -> DataFrame:
    return analytics.total(g.tickets)


def a2_count_by_domain(g: Setting) -> DataFrame:
    return analytics.count_by_domain(g.tickets)


def a3_distinct(g: Setting) -> DataFrame:
    return analytics.distinct_values(g.tickets, "severity")


def a4_facets(g: Setting) -> DataFrame:
    return analytics.facets(g.tickets)


def a5_semantic_aggregate(g: Setting) -> DataFrame:
    return analytics.semantic_aggregate(g.tickets, g.corpus, g.asked("plain"))


def a6_urgent(g: Setting) -> DataFrame:
    return g.tickets.groupBy("domain").agg(F.count("*").alias("tickets"), analytics.urgent_count().alias("urgent"))


def a7_average_hours(g: Setting) -> DataFrame:
    return g.tickets.groupBy("asset", "status").agg(numbers.average_hours(F.col("resolved_hours")).alias("avg_hours"))


def a8_text_aggregate(g: Setting) -> DataFrame:
    """The ids and titles of each question's resolved tickets as one text, nearest first."""
    asked = g.asked("plain").withColumn("resolved_only", F.lit(True))
    hits = nearest.with_ticket(nearest.nearest(g.corpus, asked, ANSWER_POOL), g.tickets, asked, ANSWER_POOL)
    lines = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" | ", "ticket_id", "title").alias("line"))))
    return hits.groupBy("question_id").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("lines"))


def a9_frequency(g: Setting) -> DataFrame:
    return analytics.frequency_profile(g.tickets, "error_code")


def a10_graph_counts(g: Setting) -> DataFrame:
    return graph.graph_counts(g.tickets, g.similar())


def a11_composition(g: Setting) -> DataFrame:
    return analytics.composition(v5_batch_topk(g))


def t2_first_ticket(g: Setting) -> DataFrame:
    return analytics.first_ticket(g.tickets)


def g1_nodes(g: Setting) -> DataFrame:
    none = F.lit(None).cast("string").alias("component")
    assets = graph.asset_nodes(g.tickets).select(F.lit("Asset").alias("label"), "name", "domain", none)
    teams = graph.team_nodes(g.tickets).select(F.lit("Team").alias("label"), "name", "domain", none)
    codes = graph.code_nodes(g.tickets).select(F.lit("Code").alias("label"), F.col("code").alias("name"), "domain", "component")
    return assets.unionByName(teams).unionByName(codes)


def g2_ticket_nodes(g: Setting) -> DataFrame:
    return graph.ticket_nodes(g.tickets)


def g3_declared_edges(g: Setting) -> DataFrame:
    return graph.declared_edges(g.tickets)


def g4_similar_to(g: Setting) -> DataFrame:
    return g.similar().withColumn("label", F.lit("SIMILAR_TO"))


def g4_similar_stored_vectors(g: Setting) -> DataFrame:
    return similarity.similar_to(g.stored, STORED_THRESHOLD).withColumn("label", F.lit("SIMILAR_TO"))


def g5_walk_by_code(g: Setting) -> DataFrame:
    return graph.walk_by_code(g.tickets)


def g6_walk_by_meaning(g: Setting) -> DataFrame:
    return graph.walk_by_meaning(g.tickets, g.similar())


def g7_seeds(g: Setting) -> DataFrame:
    return graph.seeds_of(g.tickets, g.corpus, g.asked("graph"))


def g7_expand(g: Setting) -> DataFrame:
    return graph.in_display_order(g.expanded())


def g8_new_assets(g: Setting) -> DataFrame:
    return graph.new_assets(g.expanded()).select("question_id", "asset", "domain", "kind")


def r1_long_context(g: Setting) -> DataFrame:
    return grounding.compare_prompts(g.searchable, g.corpus, g.asked("grounded")).select("question_id", "side", "n_tickets", "context")


def r2_short_context(g: Setting) -> DataFrame:
    return grounding.answer_prompts(g.searchable, g.corpus, g.asked("plain")).select("question_id", "n_tickets", "context")


def r3_prompts(g: Setting) -> DataFrame:
    return grounding.answer_prompts(g.searchable, g.corpus, g.asked("plain")).select("question_id", "system", "prompt")


def r4_answers(g: Setting) -> DataFrame:
    prompted = grounding.answer_prompts(g.searchable, g.corpus, g.asked("plain"))
    return grounding.generate(prompted).select("question_id", "answer")


def r4_answers_once(g: Setting) -> DataFrame:
    """A run that is stopped after half of the questions, and one that asks the rest."""
    prompted = materialise(grounding.answer_prompts(g.searchable, g.corpus, g.asked("plain")))
    path = g.new_path("answers")
    grounding.generate_once(prompted.filter("length(question_id) % 2 = 0"), path)
    return grounding.generate_once(prompted, path).select("question_id", "answer")


def r5_compare(g: Setting) -> DataFrame:
    compared = grounding.compare(g.searchable, g.corpus, g.asked("grounded"))
    return compared.select(
        "question_id", "side", "n_tickets", "answer", F.size("citations").alias("cited"),
        F.size(F.filter("citations", lambda c: c["exists"])).alias("verified"))


def r6_citations(g: Setting) -> DataFrame:
    return grounding.citations(g.answers, "answer_id")


def r7_verify(g: Setting) -> DataFrame:
    return grounding.verify(r6_citations(g), g.tickets)


def r8_verdict(g: Setting) -> DataFrame:
    return grounding.verdict(r7_verify(g), "answer_id")


def q1_row_counts(g: Setting) -> DataFrame:
    """The written tables against their source."""
    documents = given.table(g.spark, g.sf_dir, "documents")
    return (expectations.row_count("tickets", read_store(g.spark, _stored(g)), documents)
            .unionByName(expectations.row_count("ticket nodes", materialise(graph.ticket_nodes(g.tickets)), documents)))


def q2_term_counts(g: Setting) -> DataFrame:
    """Codes are found as often as tickets carry them; a word that is absent is found in none."""
    carried = g.tickets.groupBy(F.col("error_code").alias("term")).agg(F.count("*").alias("expected"))
    absent = g.terms.filter(F.col("term") == "shaking").withColumn("expected", F.lit(0).cast("bigint"))
    return expectations.term_counts(g.searchable, carried.unionByName(absent))


def q3_top_composition(g: Setting) -> DataFrame:
    return expectations.top_composition(v5_batch_topk(g))


def q4_graph_reach(g: Setting) -> DataFrame:
    return expectations.graph_reach(g.expanded())


def q5_retrieval_contrast(g: Setting) -> DataFrame:
    return expectations.retrieval_contrast(grounding.compare(g.searchable, g.corpus, g.asked("grounded")))


def q5_answers_cited(g: Setting) -> DataFrame:
    return expectations.answers_cited(grounding.compare(g.searchable, g.corpus, g.asked("grounded")))


def q6_stored_schema(g: Setting) -> DataFrame:
    """The columns of the stored tickets against the contract."""
    return expectations.schema(read_store(g.spark, _stored(g)), TICKET_SCHEMA)


def q7_kinds_agree(g: Setting) -> DataFrame:
    return expectations.kinds_agree(g.expanded())


_QUERIES = [
    s1_read_tickets, s2_write_tickets, s13_create_and_recreate, s14_one_domain, s3_to_ticket, s4_embedding_text, s5_search_text, s6_embed_batch, s7_hashed_embedding, s8_embed_questions,
    s9_truncate, s10_vector_text, s11_upsert_replace, s12_upsert_embedding, s15_postings,
    p1_projection, p2_filter, p3_resolved, p4_key_lookup, p5_key_set, p6_clean_values, p7_kinds,
    k1_keyword_search, k2_keyword_count, k3_term_counts, k4_match_all, k5_web_matches, k6_bm25, k7_cover_density,
    k1_indexed_search, k3_indexed_counts, k4_indexed_match_all, k6_indexed_bm25, k7_indexed_cover_density,
    k8_vocabulary,
    v1_cosine_distance, v2_vector_search, v3_filtered_search, v4_plain_english, v5_batch_topk, v6_approximate,
    v6_every_cell, v7_access_report, v8_width_report,
    h1_hybrid_search, h1_indexed_hybrid, h2_hybrid_by_hand, h2_indexed_by_hand, h3_candidates, h4_rank_only,
    a1_total, a2_count_by_domain, a3_distinct, a4_facets, a5_semantic_aggregate, a6_urgent, a7_average_hours,
    a8_text_aggregate, a9_frequency, a10_graph_counts, a11_composition, t2_first_ticket,
    g1_nodes, g2_ticket_nodes, g3_declared_edges, g4_similar_to, g4_similar_stored_vectors, g5_walk_by_code,
    g6_walk_by_meaning, g7_seeds, g7_expand, g8_new_assets,
    r1_long_context, r2_short_context, r3_prompts, r4_answers, r4_answers_once, r5_compare, r6_citations, r7_verify, r8_verdict,
    q1_row_counts, q2_term_counts, q3_top_composition, q4_graph_reach, q5_retrieval_contrast,
    q5_answers_cited, q6_stored_schema, q7_kinds_agree,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query):
        return lambda spark, sf_dir: query(Setting(spark, sf_dir))

    return {query.__name__: bind(query) for query in _QUERIES}

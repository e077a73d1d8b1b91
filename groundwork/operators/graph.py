"""The estate as a property graph: nodes, edges, and walks that lead from a question to assets.

Walks do not follow single edges. Tickets are counted by (code, asset) first, so what meets the node
tables is one row for each pair of values, however many tickets there are, and a code or asset that
holds a third of all tickets is one row too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions.numbers import round_exact
from groundwork.operators.nearest import nearest, with_ticket
from groundwork.schema import GRAPH_SEEDS
from groundwork.session import materialise
from groundwork.sizing import MAX_BROADCAST_ROWS, held


def asset_nodes(tickets: DataFrame) -> DataFrame:
    return tickets.select(F.col("asset").alias("name"), "domain").distinct()


def team_nodes(tickets: DataFrame) -> DataFrame:
    return tickets.select(F.col("team").alias("name"), "domain").distinct()


def code_nodes(tickets: DataFrame) -> DataFrame:
    return tickets.select(F.col("error_code").alias("code"), "component", "domain").distinct()


def ticket_nodes(tickets: DataFrame) -> DataFrame:
    """Hours are null while a ticket is open, never 0."""
    return tickets.select(
        F.col("ticket_id").alias("id"), "asset", "team", F.col("error_code").alias("code"),
        "severity", "status", F.col("resolved_hours").alias("hours"))


def declared_edges(tickets: DataFrame) -> DataFrame:
    """ON, BY and CODED edges (src, dst, label) in one pass over the tickets. They match on the name
    alone, so a name that two domains share gets an edge to both nodes."""
    ends = F.array(*[F.struct(F.lit(label).alias("label"), F.col(key).alias("name"))
                     for label, key in (("ON", "asset"), ("BY", "team"), ("CODED", "error_code"))])
    named = tickets.select("ticket_id", "domain", "component", F.inline(ends))
    # a code is a node for each component it has
    part = F.when(F.col("label") == "CODED", F.col("component"))
    nodes, few = held(named.select("label", "name", F.col("domain").alias("node_domain"), part.alias("part")).distinct(),
                      MAX_BROADCAST_ROWS)
    edges = named.join(F.broadcast(nodes) if few else nodes, ["label", "name"])
    return edges.select(F.col("ticket_id").alias("src"), F.concat_ws("/", "node_domain", "name", "part").alias("dst"), "label")


def estate(tickets: DataFrame) -> DataFrame:
    """Tickets counted by all the values that nodes are made of, written once.

    One row for each combination in use, so all nodes, counts and walks by code come from one pass
    over the tickets. The node functions take it in place of tickets.
    """
    return materialise(tickets.groupBy("domain", "asset", "team", "error_code", "component").agg(
        F.count("*").alias("n"), F.sum(F.col("resolved_hours").cast("decimal(28,6)")).alias("hours"),
        F.count("resolved_hours").alias("known")))


def graph_counts(tickets: DataFrame, similar: DataFrame) -> DataFrame:
    """(label, n) for each kind of node, and all edges together."""
    counted = estate(tickets)

    def nodes(df: DataFrame, label: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")

    def edges(key: str, df: DataFrame, name: str) -> DataFrame:
        per_value = counted.groupBy(key).agg(F.sum("n").alias("n"))
        return per_value.join(df.select(F.col(name).alias(key)), key).select("n")

    every = (edges("asset", asset_nodes(counted), "name")
             .unionByName(edges("team", team_nodes(counted), "name"))
             .unionByName(edges("error_code", code_nodes(counted), "code"))
             .unionByName(similar.agg(F.count("*").alias("n"))))
    return (nodes(asset_nodes(counted), "asset").unionByName(nodes(team_nodes(counted), "team"))
            .unionByName(nodes(code_nodes(counted), "code"))
            .unionByName(counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("ticket").alias("label"), "n"))
            .unionByName(every.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("edges").alias("label"), "n")))


def _walk(pairs: DataFrame, counted: DataFrame) -> DataFrame:
    """Counted (code, asset) pairs to their nodes: code, asset, domain, tickets, avg_hours."""
    codes = code_nodes(counted).groupBy("code").agg(F.count("*").alias("code_copies"))
    summed = pairs.groupBy("error_code", "asset").agg(*[F.sum(c).alias(c) for c in ("n", "hours", "known")])
    joined = (summed.join(codes, F.col("error_code") == F.col("code"))
              .join(asset_nodes(counted).withColumnRenamed("name", "node"), F.col("asset") == F.col("node")))
    mean = F.sum("hours").cast("double") / F.nullif(F.sum("known").cast("double"), F.lit(0.0))
    return joined.groupBy("code", "asset", "domain").agg(
        F.sum(F.col("n") * F.col("code_copies")).alias("tickets"), round_exact(mean, 1).alias("avg_hours"))


def walk_by_code(tickets: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """From each code over its tickets to their assets."""
    counted = estate(tickets) if counted is None else counted
    return _walk(counted, counted)


def walk_by_meaning(tickets: DataFrame, similar: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """From each code over its tickets and their similar tickets to the assets of those.

    A ticket reached over two edges counts twice: `tickets` counts paths, and the mean is over paths.
    Edges are counted by (code, reached ticket) before they meet the reached tickets, so a ticket
    that very many others point to is one row for each code.
    """
    counted = estate(tickets) if counted is None else counted
    codes = tickets.select(F.col("ticket_id").alias("src"), "error_code")
    reached = tickets.select(F.col("ticket_id").alias("dst"), "asset", "resolved_hours")
    steps = similar.select("src", "dst").join(codes, "src").groupBy("error_code", "dst").agg(F.count("*").alias("n"))
    paths = steps.join(reached, "dst").select(
        "error_code", "asset", "n",
        (F.col("resolved_hours").cast("decimal(18,6)") * F.col("n").cast("decimal(19,0)")).alias("hours"),
        F.when(F.col("resolved_hours").isNotNull(), F.col("n")).otherwise(0).alias("known"))
    return _walk(paths, counted)


def kind() -> Column:
    """How an asset is drawn: reached by meaning only, found by the search, or new."""
    return (F.when(F.col("by_meaning_only"), "meaning").when(F.col("in_search"), "found").otherwise("new"))


def seeds_of(tickets: DataFrame, corpus: DataFrame, questions: DataFrame, seeds: int = GRAPH_SEEDS) -> DataFrame:
    """(question_id, rank, ticket_id, asset, error_code): the tickets that `expand` walks from."""
    hits = nearest(corpus, questions, seeds)
    return with_ticket(hits, tickets, questions, seeds).select("question_id", "rank", "ticket_id", "asset", "error_code")


def expand(tickets: DataFrame, corpus: DataFrame, questions: DataFrame, similar: DataFrame,
           seeds: int = GRAPH_SEEDS) -> DataFrame:
    """From each question over its nearest tickets to every asset with the same fault.

    The fault is the code of the first seed. An asset is reached by code, by meaning, or both.
    """
    found = seeds_of(tickets, corpus, questions, seeds)
    codes = found.filter(F.col("rank") == 1).select("question_id", F.col("error_code").alias("code"))
    seen = found.select("question_id", "asset").distinct().withColumn("seen", F.lit(True))

    counted = estate(tickets)
    by_code = walk_by_code(tickets, counted).join(codes, "code").select(
        "question_id", "asset", "domain", F.col("tickets").alias("n_code"), F.col("avg_hours").alias("h_code"))
    by_meaning = walk_by_meaning(tickets, similar, counted).join(codes, "code").select(
        "question_id", "asset", "domain", F.col("tickets").alias("n_meaning"), F.col("avg_hours").alias("h_meaning"))
    merged = by_code.join(by_meaning, ["question_id", "asset", "domain"], "full_outer")
    flagged = (merged.join(codes, "question_id").join(seen, ["question_id", "asset"], "left").select(
        "question_id", "code", "asset", "domain",
        F.coalesce("n_code", F.lit(0)).cast("bigint").alias("tickets"),
        F.coalesce("n_meaning", F.lit(0)).cast("bigint").alias("related"),
        F.coalesce("h_code", "h_meaning").alias("avg_hours"),
        F.coalesce("seen", F.lit(False)).alias("in_search"),
        F.col("n_code").isNotNull().alias("by_code"),
        F.col("n_code").isNull().alias("by_meaning_only")))
    return flagged.withColumn("kind", kind())


def in_display_order(expanded: DataFrame) -> DataFrame:
    return expanded.orderBy("question_id", "by_meaning_only", F.col("tickets").desc(), "asset")


def new_assets(expanded: DataFrame) -> DataFrame:
    """Assets that none of the seeds was raised against."""
    return expanded.filter(~F.col("in_search"))


def meaning_only(expanded: DataFrame) -> DataFrame:
    """Assets that no fault code leads to."""
    return expanded.filter("by_meaning_only")

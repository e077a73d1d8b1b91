"""Counts, facets and aggregates over the corpus and over search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions.numbers import average_hours
from groundwork.operators.nearest import nearest, with_ticket
from groundwork.schema import AGGREGATE_POOL, SEVERITY_ORDER, TICKET_COLUMNS, URGENT


def urgent_count() -> Column:
    return F.count_if(F.col("severity").isin(URGENT))


def project(tickets: DataFrame) -> DataFrame:
    return tickets.select(*TICKET_COLUMNS)


def where(tickets: DataFrame, severity: str | None = None, domain: str | None = None,
          resolved_only: bool = False) -> DataFrame:
    """Tickets that meet every filter given; an absent filter is no filter."""
    if severity:
        tickets = tickets.filter(F.col("severity") == severity)
    if domain:
        tickets = tickets.filter(F.col("domain") == domain)
    return resolved(tickets) if resolved_only else tickets


def resolved(tickets: DataFrame) -> DataFrame:
    """Tickets with a resolution; null and '' both count as none."""
    return tickets.filter(F.col("resolution") != "")


def lookup(tickets: DataFrame, keys: DataFrame) -> DataFrame:
    """Tickets whose id is in `keys`."""
    return tickets.join(keys.select("ticket_id"), "ticket_id", "left_semi")


def total(tickets: DataFrame) -> DataFrame:
    return tickets.agg(F.count("*").alias("total"))


def count_by_domain(tickets: DataFrame) -> DataFrame:
    """Tickets in each domain, and in all of them (domain null)."""
    counts = tickets.rollup("domain").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("domain").asc_nulls_first())


def distinct_values(tickets: DataFrame, column: str) -> DataFrame:
    return tickets.select(column).distinct()


def facets(tickets: DataFrame) -> DataFrame:
    """Values to filter by: severities in order of urgency (unknown last), domains A to Z."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col("value")), F.lit(0))
    severities = tickets.select(F.lit("severity").alias("facet"), F.col("severity").alias("value")).distinct()
    domains = tickets.select(F.lit("domain").alias("facet"), F.col("domain").alias("value")).distinct()
    ordered = severities.withColumn("place", F.when(place == 0, 9).otherwise(place - 1).cast("int"))
    return (ordered.unionByName(domains.withColumn("place", F.lit(0)))
            .orderBy(F.col("facet").desc(), "place", "value"))


def first_ticket(tickets: DataFrame) -> DataFrame:
    return project(tickets).orderBy("ticket_id").limit(1)


def summarise(matches: DataFrame, *keys: str) -> DataFrame:
    """Count, mean hours and urgent count of a set of tickets by `keys`."""
    return matches.groupBy(*keys).agg(
        F.count("*").alias("tickets"),
        average_hours(F.col("resolved_hours")).alias("avg_hours"),
        urgent_count().alias("urgent"),
    )


def semantic_aggregate(tickets: DataFrame, corpus: DataFrame, questions: DataFrame,
                       pool: int = AGGREGATE_POOL) -> DataFrame:
    """The nearest `pool` tickets of each question, by domain and team. A team with no known
    hours sorts before the others of the same size, as a null does first on a descending sort."""
    matches = with_ticket(nearest(corpus, questions, pool), tickets, questions, pool)
    return summarise(matches, "question_id", "domain", "team").orderBy(
        "question_id", F.col("tickets").desc(), F.col("avg_hours").desc_nulls_first(), "domain", "team")


def frequency_profile(tickets: DataFrame, column: str) -> DataFrame:
    """Rarest value first."""
    return tickets.groupBy(column).agg(F.count("*").alias("n")).orderBy("n", column)


def composition(result: DataFrame, column: str = "error_code") -> DataFrame:
    """How many of each question's results carry each value."""
    return result.groupBy("question_id", column).agg(F.count("*").alias("n"))

"""Sanitising personal data by what terms disclose, with column expressions only.

Fixed patterns find the base spans: mail addresses, network addresses, card and phone numbers. Their
distinct values are the protected entities. Terms that stand near an entity may reveal it as well: the
pointwise mutual information of a term and an entity, estimated from all texts, says how much of the
entity's own information content the term gives away. A term that gives away more than the threshold
is removed, or generalised to its shape.

Both counts are taken over the whole corpus. A context is the words around one entity in one text, and
equal contexts count once, so copies of a text are no evidence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import row_key
from groundwork.session import materialise

KINDS = ("email", "ip", "card", "phone", "term")
# The contract's patterns. Possessive repeats and the look-behind change no match: they only keep a long
# run of characters from being tried again from each of its places, and deep recursion out of groups.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"[\p{L}\p{N}_'-]+"
SPAN = "array<struct<kind:int,start:long,end:long>>"
# A card number has no more digits.
MOST_DIGITS = 19


@dataclass(frozen=True)
class Disclosure:
    """`window` words on either side of an entity; `support` distinct contexts that a term and an entity
    must share; `threshold`: the share of the entity's information that a term may give away."""

    window: int = 5
    support: int = 3
    threshold: float = 0.8


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(number))

    def added(total: Column, place: Column) -> Column:
        digit = F.substr(number, place, F.lit(1)).cast("int")
        double = F.pmod(F.length(number) - place, F.lit(2)) == 1
        return total + F.when(~double, digit).when(digit > 4, digit * 2 - 9).otherwise(digit * 2)

    return F.pmod(F.aggregate(places, F.lit(0), added), F.lit(10)) == 0


def is_ip(value: Column) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p).cast("int") <= 255))


def is_card(value: Column) -> Column:
    number = digits(value)
    size = F.length(number)
    return size.between(13, MOST_DIGITS) & luhn(F.when(size <= MOST_DIGITS, number).otherwise(""))


def is_phone(value: Column) -> Column:
    return F.length(digits(value)).between(9, 15)


def matches(text: Column, pattern: str, possible: Column) -> Column:
    """value, start, end of each leftmost non-overlapping match. The pieces between matches give places.

    `possible` is a cheap condition without which a text has no match.
    """
    shape = "array<struct<value:string,start:long,end:long>>"
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    paired = F.zip_with(values, between, lambda v, b: F.struct(v.alias("value"), F.length(b).alias("gap")))
    # The text after the last match has no value beside it.
    paired = F.filter(paired, lambda p: p["value"].isNotNull())

    def step(done: Column, p: Column) -> Column:
        start = done["at"] + p["gap"]
        end = start + F.length(p["value"])
        return F.struct(end.cast("long").alias("at"), F.concat(
            done["found"], F.array(F.struct(p["value"].alias("value"), start.cast("long").alias("start"), end.cast("long").alias("end")))
        ).alias("found"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(shape).alias("found"))
    return F.when(possible, F.aggregate(paired, first, step, lambda d: d["found"])).otherwise(F.array().cast(shape))


def base_spans(text: Column) -> Column:
    """kind, value, start, end of the base spans of a text that is not null, by kind and start."""
    shape = "array<struct<kind:int,value:string,start:long,end:long>>"
    finders = [(EMAIL, text.contains("@"), None), (IP, text.rlike(r"[0-9]\.[0-9]+\."), is_ip),
               (CARD, text.rlike("[0-9]"), is_card), (PHONE, text.rlike(r"\+[0-9]"), is_phone)]
    lists = []
    for kind, (pattern, possible, check) in enumerate(finders):
        found = matches(text, pattern, possible)
        if check is not None:
            found = F.filter(found, lambda m: check(m["value"]))
        lists.append(F.transform(found, lambda m: F.struct(
            F.lit(kind).alias("kind"), m["value"].alias("value"), m["start"].alias("start"), m["end"].alias("end"))))
    return F.concat(*lists).cast(shape)


def entity(span: Column) -> Column:
    """What a base span names: a mail address in lower case, or the digits of a number."""
    return F.when(span["kind"] == 0, F.lower(span["value"])).otherwise(digits(span["value"]))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_'-]+"), lambda w: (F.length(w) >= 3) & w.rlike(r"\p{L}"))


def context(text: Column, span: Column, window: int) -> Column:
    """The distinct words on both sides of a span, sorted.

    They are looked for in as many characters on either side as `window` words of 16 take; a word cut
    by that edge is left out.
    """
    reach = window * 16
    start, end = span["start"].cast("int"), span["end"].cast("int")
    before = F.substring(text, F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach)))
    after = F.substring(text, end + 1, F.lit(reach))
    before = F.when(start > reach, F.regexp_replace(before, r"^[\p{L}\p{N}_'-]+", "")).otherwise(before)
    after = F.when(F.length(after) == reach, F.regexp_replace(after, r"[\p{L}\p{N}_'-]+$", "")).otherwise(after)
    left, right = words_of(before), words_of(after)
    return F.array_sort(F.array_distinct(F.concat(F.reverse(F.slice(F.reverse(left), 1, window)), F.slice(right, 1, window))))


def protected(docs: DataFrame, window: int, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_key and near (entity, context) of the rows that hold an entity."""
    rows = docs.select(F.col(row_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.select("_id", "_text", base_spans(F.col("_text")).alias("base")).filter(F.size("base") > 0)
    near = F.transform("base", lambda b: F.struct(entity(b).alias("entity"), context(F.col("_text"), b, window).alias("context")))
    return rows.select(row_key(F.col("_id"), F.col("_text")).alias("_key"), near.alias("near"))


def disclosing_terms(found: DataFrame, docs: DataFrame, how: Disclosure = Disclosure(), text: str = "text") -> DataFrame:
    """entity, term, gives: terms whose mutual information with an entity is at least the threshold share
    of the entity's information content.

    With n texts, c contexts of the entity, t texts holding the term and b contexts holding both:
    PMI = log(b n / (c t)), content = log(n / c), gives = PMI / content.
    """
    near = materialise(found.select(F.explode("near").alias("x")).select("x.entity", "x.context").distinct())
    totals = near.groupBy("entity").agg(F.count("*").alias("c")).filter(F.col("c") >= how.support)
    both = near.select("entity", F.explode("context").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("b"))
    both = materialise(both.filter(F.col("b") >= how.support).join(totals, "entity"))
    # Words are counted before they meet the terms that stand near an entity: joining first would make a
    # row for each text that holds a common word.
    held = docs.select(F.explode(F.array_distinct(words_of(F.coalesce(F.col(text), F.lit(""))))).alias("term"))
    spread = held.groupBy("term").agg(F.count("*").alias("t"))
    n = float(max(docs.count(), 1))
    scored = both.join(spread, "term")
    pmi = F.log(F.col("b") * F.lit(n) / (F.col("c") * F.col("t")))
    content = F.log(F.lit(n) / F.col("c"))
    return scored.select("entity", "term", F.when(content > 0, pmi / content).alias("gives")).filter(F.col("gives") >= how.threshold)


def marked(docs: DataFrame, how: Disclosure = Disclosure(), row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of every row, and _spans (kind, start, end; by kind and start).

    kind is an index of KINDS, start and end are code points, end exclusive. Spans of kind `term` mark
    the words, in texts that hold the entity, that disclose it; they never overlap a base span. A null
    text counts as empty. Rows with a null id and repeated rows stay; an empty table gives an empty
    result. Columns of any other name are kept (names that begin with `_` are the operator's own).
    """
    found = materialise(protected(docs, how.window, row_id, text))
    terms = materialise(disclosing_terms(found, docs, how, text).select("entity", "term"))
    # Which rows hold an entity together with terms that disclose it: only keys are joined.
    listed = found.select("_key", F.explode("near").alias("x")).select("_key", "x.entity").distinct()
    listed = materialise(listed.join(terms, "entity").groupBy("_key").agg(F.collect_set("term").alias("_terms")))
    own = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("_key", row_key(F.col(row_id), own)).join(listed, "_key", "left")
    rows = rows.withColumn("_base", base_spans(own))
    word = matches(own, WORD, F.col("_terms").isNotNull())
    hit = F.filter(word, lambda m: F.array_contains(F.col("_terms"), F.lower(m["value"])) &
                   ~F.exists("_base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    hit = F.transform(hit, lambda m: F.struct(F.lit(4).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    base = F.transform("_base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    spans = F.concat(base, F.coalesce(hit, F.array().cast(SPAN))).cast(SPAN)
    return rows.withColumn("_spans", spans).drop("_key", "_terms", "_base")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced: base spans by their kind in brackets, terms by [TERM].

    Overlapping spans become one, named after the one that starts first (then the first kind).
    """
    shape = "array<struct<kind:int,start:long,end:long>>"

    def merge(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        overlaps = (F.size(done) > 0) & (s["start"] < F.get(done, F.size(done) - 1)["end"])
        joined = F.struct(last["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(overlaps, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(
            F.concat(done, F.array(s)))

    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    ordered = F.transform(by_start, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    merged = F.aggregate(ordered, F.array().cast(shape), merge)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def rewrite(done: Column, s: Column) -> Column:
        kept = F.substr(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        return F.struct(s["end"].alias("at"), F.concat(done["out"], F.array(kept, F.get(names, s["kind"]))).alias("out"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    rest = F.aggregate(merged, first, rewrite, lambda d: F.concat(F.concat_ws("", d["out"]), F.substr(text, (d["at"] + 1).cast("int"))))
    return F.when(F.size(spans) == 0, text).otherwise(rest)

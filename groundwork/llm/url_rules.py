"""URL filtering by association rules, with column expressions and Spark's own FP-growth only.

Fixed host and path rules label part of the urls. FP-growth mines which combinations of url tokens go
with a label; rules pruned by support and confidence then judge the urls that no fixed rule fits. Rules
are found through an inverted index: each is filed under its rarest token.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Verdict, host and path of the contract's rules.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
LABEL = "verdict="
DEFAULT = "allow"


@dataclass(frozen=True)
class Mining:
    """Support and confidence that a rule must have, and the most tokens on its left side.

    `support` is a share of all labelled urls. Tokens that are rarer can be in no rule.
    """

    support: float = 0.002
    confidence: float = 0.6


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; and from there up to ?, # or the end."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(whole, parts, 1), UPPER, LOWER), F.regexp_extract(whole, parts, 2)


def fixed_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fixed rule that fits; both null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for label, own, start in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule = F.when(fits, F.lit(own + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(label)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """What an url says: labels of its host by place from the right, words of its path (numbers as #),
    names of its parameters, its scheme, and whether it has a fragment. Each once, sorted."""
    labels = F.reverse(F.split(host, r"\."))
    by_place = F.transform(F.filter(labels, lambda x: x != ""), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), x))
    words = F.filter(F.split(F.regexp_replace(F.translate(path, UPPER, LOWER), "[0-9]+", "#"), "[/._-]+"), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    scheme = F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?)://", 1), UPPER, LOWER)
    return F.array_sort(F.array_distinct(F.concat(
        by_place, F.transform(words, lambda x: F.concat(F.lit("p="), x)), F.transform(names, lambda x: F.concat(F.lit("q="), x)),
        F.array(F.concat(F.lit("s="), scheme)), F.when(F.coalesce(url, F.lit("")).contains("#"), F.array(F.lit("f"))).otherwise(F.array().cast("array<string>")))))


def mine(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """left (sorted tokens), verdict, confidence, support, file_under: the rules whose right side is a label.

    `labelled` has tokens and verdict. A rule is kept only if no part of its left side gives the same
    verdict with at least the same confidence (such a longer rule decides nothing). Every rule is filed
    under the token of its left side that is rarest among the labelled urls.
    """
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(LABEL), F.col("verdict")))).alias("items"))
    if baskets.isEmpty():
        return baskets.sparkSession.createDataFrame([], "left array<string>, verdict string, confidence double, support double, file_under string")
    model = FPGrowth(itemsCol="items", minSupport=mining.support, minConfidence=mining.confidence).fit(baskets)
    rules = model.associationRules.filter(F.get("consequent", F.lit(0)).startswith(LABEL) & ~F.exists("antecedent", lambda x: x.startswith(LABEL)))
    rules = materialise(rules.select(F.array_sort("antecedent").alias("left"),
                                     F.substring(F.get("consequent", F.lit(0)), len(LABEL) + 1, 100).alias("verdict"), "confidence", "support"))
    short = rules.select("left", F.explode("left").alias("gone"), "verdict", "confidence")
    part = short.select("left", "verdict", "confidence", F.array_remove(F.col("left"), F.col("gone")).alias("part"))
    shorter = rules.select(F.col("left").alias("part"), "verdict", F.col("confidence").alias("c"))
    idle = part.join(shorter, ["part", "verdict"]).filter(F.col("c") >= F.col("confidence")).select("left", "verdict").distinct()
    kept = rules.join(idle, ["left", "verdict"], "left_anti")
    often = labelled.select(F.explode("tokens").alias("token")).groupBy("token").count()
    filed = kept.select("left", "verdict", F.explode("left").alias("token")).join(often, "token")
    filed = filed.groupBy("left", "verdict").agg(F.min_by("token", F.struct("count", "token")).alias("file_under"))
    return materialise(kept.join(filed, ["left", "verdict"]).select("left", "verdict", "confidence", "support", "file_under"))


def judge(pages: DataFrame, mining: Mining = Mining(), row_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, confidence for every row.

    rule and verdict are those of the longest fixed rule that fits. Where none does, rule is null, and
    the mined rule of highest confidence (then support, then tokens in order) gives the verdict and its
    confidence; `allow` if no mined rule fits. Null urls and urls without :// have an empty host and path.
    Repeated rows and rows with a null id stay; an empty table gives an empty result. Other columns are
    ignored.
    """
    address = F.col(url)
    rows = pages.select(F.col(row_id).cast("long").alias("page_id"), address.alias("_url"))
    host, path = host_and_path(F.col("_url"))
    rows = rows.select("page_id", "_url", host.alias("host"), path.alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("fixed"),
                       tokens(F.col("_url"), F.col("host"), F.col("path")).alias("tokens"))
    labelled = rows.filter(F.col("fixed").isNotNull()).select("tokens", F.col("fixed").alias("verdict"))
    rules = mine(labelled, mining)
    # Urls with the same tokens are judged once.
    kinds = rows.filter(F.col("fixed").isNull()).select("tokens").distinct()
    at = kinds.select("tokens", F.explode("tokens").alias("file_under"))
    fits = at.join(rules, "file_under").filter(F.size(F.array_except("left", "tokens")) == 0)
    best = fits.groupBy("tokens").agg(F.max(F.struct("confidence", "support", "left", "verdict")).alias("best"))
    best = best.select(F.col("tokens").alias("kind"), F.col("best.verdict").alias("mined"), F.col("best.confidence").alias("confidence"))
    joined = rows.join(best, (rows.tokens == best.kind) & rows.fixed.isNull(), "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("fixed", "mined", F.lit(DEFAULT)).alias("verdict"),
                         F.when(F.col("fixed").isNull(), F.col("confidence")).alias("confidence"))

"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell: source, language and topic. The cell weights are raked in turn to the target
share of every source, language and topic until all three hold. Each document is then kept with the
probability its cell's weight calls for, scaled so that the expected tokens meet the budget. Where a cell
has too few tokens for both, `Mix.meet_targets` says whether the targets or the budget give way.

Cells are a table like any other: every step is a join of cells with the totals of one dimension, and is
written to the shared folder. The chance of a document is a hash of its id and text, so a run can be
repeated, and a lost executor changes nothing.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.session import materialise

DIMENSIONS = ("source", "lang", "topic")
# A text's topic is the one whose words occur most; `general` if none does. Ties go to the first.
TOPICS = {
    "law": "license|licence|copyright|warranty|rights|terms|law",
    "access": "password|passwd|secret|token|api_key|apikey|key|login",
    "contact": "mail|email|phone|call|contact|address|tel",
    "code": "def|class|import|return|function|void|int|const",
}
GENERAL = "general"
MARKS = r"""[\s.,;:!?()"'=]+"""


@dataclass(frozen=True)
class Mix:
    """`keep`: share of all tokens to keep, in expectation. `flatten`: a target is a share of today's
    tokens to this power, so 1 keeps the mixture and 0 makes all values of a dimension equal. Raking
    ends when no factor changes by more than `tolerance` (relative) in a sweep, after `sweeps` at most.
    `meet_targets`: `keep` is an upper bound, lowered so far that no probability has to be cut at 1, and the
    expected tokens follow all targets. Otherwise `keep` holds and cells that are cut at 1 miss theirs.
    A share that is off its target by more than `report` (relative) gives a warning."""

    keep: float = 0.8
    flatten: float = 0.7
    tolerance: float = 1e-4
    sweeps: int = 30
    meet_targets: bool = False
    report: float = 0.01


def content(text: Column) -> Column:
    """tokens (words, at least 1) and topic of a text that is not null."""
    known = [w for names in TOPICS.values() for w in names.split("|")]

    def counted(words: Column) -> Column:
        hits = F.filter(words, lambda w: w.isin(*known))

        def best(found: Column) -> Column:
            counts = [F.struct(F.size(F.filter(found, lambda w: w.isin(*names.split("|")))).alias("n"), F.lit(-place).alias("place"),
                               F.lit(name).alias("topic")) for place, (name, names) in enumerate(TOPICS.items())]
            return F.when(F.size(found) == 0, GENERAL).otherwise(F.array_max(F.array(*counts))["topic"])

        return F.struct(F.greatest(F.size(words), F.lit(1)).cast("long").alias("tokens"),
                        F.element_at(F.transform(F.array(hits), best), 1).alias("topic"))

    # One-element arrays carry the words and the hits, so a text is cut into words once.
    return F.element_at(F.transform(F.array(F.split(F.lower(F.trim(text)), MARKS)), counted), 1)


def described(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns and _topic, _tokens, _chance (in [0, 1), from the id and text)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    hashed = F.shiftrightunsigned(F.xxhash64(F.col(row_id), whole, F.lit("mixing")), 11)
    rows = docs.withColumns({"_content": content(whole), "_chance": hashed.cast("double") / F.lit(float(1 << 53))})
    return rows.withColumns({"_topic": F.col("_content.topic"), "_tokens": F.col("_content.tokens")}).drop("_content")


def shares(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """value, target of one dimension: its share of tokens to the given power, scaled to a sum of 1."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").cast("double").alias("tokens"))
    sums = sums.withColumn("target", F.pow(F.col("tokens"), F.lit(power)))
    total = sums.agg(F.sum("target").alias("s")).first().s
    return materialise(sums.select("value", (F.col("target") / F.lit(total or 1.0)).alias("target")))


def rake(cells: DataFrame, targets: dict[str, DataFrame], mix: Mix = Mix()) -> DataFrame:
    """cells with `weight`: tokens times one factor for each dimension, so that all targets are met.

    `cells` has the dimensions and tokens; each target table has value and target, which should sum to 1
    over the values that occur. A value without a target gets weight 0. In turn, the factors of a
    dimension are set to its targets divided by what tokens and the other factors sum to.
    """
    factors = {d: None for d in targets}
    for sweep in range(mix.sweeps):
        worst = 0.0
        for d, wanted in targets.items():
            others = {o: f for o, f in factors.items() if o != d}
            sums = weighted(cells, others).groupBy(F.col(d).alias("value")).agg(F.sum("weight").alias("s"))
            wanted = wanted.select(F.col("value").alias("t_value"), "target")
            new = sums.join(wanted, sums.value.eqNullSafe(wanted.t_value), "left").select(
                "value", F.when(F.col("s") > 0, F.coalesce("target", F.lit(0.0)) / F.col("s")).otherwise(0.0).alias("factor"))
            old = factors[d]
            if old is None:
                new, worst = new.withColumn("off", F.lit(None).cast("double")), float("inf")
            else:
                old = old.select(F.col("value").alias("o_value"), F.col("factor").alias("o_factor"))
                off = F.when((F.col("factor") > 0) & (F.col("o_factor") > 0), F.abs(F.log(F.col("factor") / F.col("o_factor"))))
                new = new.join(old, F.col("value").eqNullSafe(F.col("o_value")), "left").select("value", "factor", off.alias("off"))
            factors[d] = materialise(new)
            if old is not None:
                worst = max(worst, factors[d].agg(F.max("off").alias("off")).first().off or 0.0)
        if worst <= mix.tolerance:
            break
    return weighted(cells, factors)


def weighted(cells: DataFrame, factors: dict[str, DataFrame | None]) -> DataFrame:
    """cells with `weight`: tokens times the factors there are so far."""
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for d, factor in factors.items():
        if factor is not None:
            own = factor.select(F.col("value").alias("_value"), F.col("factor").alias("_factor"))
            out = out.join(own, F.col(d).eqNullSafe(F.col("_value"))).withColumn("weight", F.col("weight") * F.col("_factor")).drop("_value", "_factor")
    return out


def calibrated(weighted: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """cells with `probability`: min(1, scale * weight / tokens), the scale chosen so that the expected
    tokens are the share `mix.keep` of all (or all that have weight, if that is less). With
    `mix.meet_targets` the scale is at most the one at which the first cell reaches 1."""
    ratio = F.col("weight") / F.col("tokens")
    sums = weighted.agg(F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("weight") > 0, F.col("tokens"))).alias("can"), F.max(ratio).alias("top"),
                       F.sum("weight").alias("weight")).first()
    if not sums.tokens or not sums.can:
        return weighted.withColumn("probability", F.lit(0.0))
    if mix.meet_targets:
        scale = min(mix.keep * sums.tokens / sums.weight, 1.0 / sums.top)
        return weighted.withColumn("probability", F.least(F.lit(1.0), ratio * F.lit(scale)))
    budget, scale = min(mix.keep * sums.tokens, float(sums.can)), mix.keep * sums.tokens
    while True:  # each round fixes the cells that reach 1, so there are at most as many as cells; in practice a few
        full = ratio * F.lit(scale) >= 1
        state = weighted.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"),
                             F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        need = budget - state.full
        new = need / state.open if state.open > 0 and need > 0 else scale
        if new <= scale * (1 + 1e-9):
            break
        scale = new
    return weighted.withColumn("probability", F.round(F.least(F.lit(1.0), ratio * F.lit(scale)), 9))


def marginals(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """dimension, value, target, share: what each value is to have and has of the expected tokens, for cells with
    `probability`. A value without a target has target 0, one without tokens share 0."""
    total = cells.agg(F.sum(F.col("tokens") * F.col("probability")).alias("s")).first().s or 1.0
    out = None
    for d, wanted in targets.items():
        sums = cells.groupBy(F.col(d).alias("_v")).agg((F.sum(F.col("tokens") * F.col("probability")) / F.lit(total)).alias("share"))
        both = sums.join(wanted.select("value", "target"), F.col("_v").eqNullSafe(F.col("value")), "full")
        both = both.select(F.lit(d).alias("dimension"), F.coalesce("value", "_v").alias("value"),
                           F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("share", F.lit(0.0)).alias("share"))
        out = both if out is None else out.union(both)
    return out


def warn_of_unmet(cells: DataFrame, targets: dict[str, DataFrame], mix: Mix) -> None:
    """A warning with the number of shares that miss their target and the worst of them."""
    off = F.abs(F.col("share") - F.col("target")) / F.greatest("target", F.lit(1e-12))
    missed = marginals(cells, targets).withColumn("off", off).filter(F.col("off") > mix.report)
    worst = missed.agg(F.count("*").alias("n"), F.max_by(F.struct("dimension", "value", "target", "share"), "off").alias("w")).first()
    if worst.n:
        warnings.warn(f"{worst.n} shares miss their targets; the worst is {worst.w.dimension} {worst.w.value}: "
                      f"{worst.w.share:.4f} for {worst.w.target:.4f}", stacklevel=3)


def mixed(docs: DataFrame, mix: Mix = Mix(), row_id: str = "doc_id", text: str = "text",
          targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """All columns of every row, and _topic, _tokens, _probability, _kept.

    The tables of `targets` (value, target) may fix the shares of source, lang or topic; the others follow
    `mix.flatten`. A null source or language is a value of its own; a null or empty text has one token and
    topic `general`; a null id takes part. Repeated rows share their fate. An empty table gives an empty
    result. Other columns are kept (names that begin with `_` are the operator's own).
    """
    rows = described(docs, row_id, text)
    cells = materialise(rows.groupBy(F.col("source"), F.col("lang"), F.col("_topic").alias("topic")).agg(F.sum("_tokens").alias("tokens")))
    wanted = {d: (targets or {}).get(d) or shares(cells, d, mix.flatten) for d in DIMENSIONS}
    drawn = materialise(calibrated(materialise(rake(cells, wanted, mix)), mix))
    warn_of_unmet(drawn, wanted, mix)
    chances = drawn.select(
        F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("topic").alias("_t"), F.col("probability").alias("_probability"))
    joined = rows.join(chances, F.col("source").eqNullSafe(F.col("_s")) & F.col("lang").eqNullSafe(F.col("_l")) & (F.col("_topic") == F.col("_t")), "left")
    joined = joined.withColumn("_kept", F.col("_chance") < F.coalesce("_probability", F.lit(0.0)))
    return joined.drop("_s", "_l", "_t", "_chance")

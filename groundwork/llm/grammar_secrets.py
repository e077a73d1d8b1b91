"""Secret scans with formats learned by grammar inference.

Three fixed patterns find the base secrets. Their values are the labelled credentials: a prefix tree of
their character classes is built, and states whose outgoing frequencies do not differ significantly
are merged, which gives a probabilistic automaton for each kind of credential. Every long token of
every text is then scored by the likelihood of its format under the best automaton against that of
ordinary long tokens, and those that look like a credential are added.

All distinct values count. Spark counts the prefixes of all of them, and the tree has those that at least one in
`Bounds.evidence` values shares; it alone is merged on the driver. Then all values walk through the merged
automata whole, which gives the counts, and all are scored, which gives the threshold. With up to
`Bounds.evidence` values of a kind the tree has every prefix. All texts are scanned whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.session import materialise

KINDS = ("assign", "access", "hex", "format")
# The patterns that the contract gives.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# `[0-9a-f]+` of 32 or more: matches are maximal runs, and shorter ones are dropped.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
LONG_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
FOUND = ("base array<struct<kind:int,start:long,end:long,value:string>>, "
         "tokens array<struct<start:long,end:long,value:string>>")
DIGIT, ASCII_LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


@dataclass(frozen=True)
class Bounds:
    """How fine and how strict the automata are: a prefix is a state of the tree from one in `evidence` values on and up to
    `characters` long."""

    evidence: int = 1000
    characters: int = 64
    confidence: float = 0.05
    accepted: float = 0.9


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the base secrets, by start and then kind."""
    found = [(0, m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= 16]
    found += [(2, m.start(), m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[1], f[0]))


def long_tokens(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of tokens with a letter and a digit that touch no base span."""
    covered: list[list[int]] = []
    for _, start, end, _ in base:
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    out, at = [], 0
    for m in LONG_TOKEN.finditer(text):
        value = m.group().rstrip(".=-")
        start, end = m.start(), m.start() + len(value)
        if len(value) < 16 or not (DIGIT.search(value) and ASCII_LETTER.search(value)):
            continue
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        if at == len(covered) or covered[at][0] >= end:
            out.append((start, end, value))
    return out


def scan(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """doc_id, base, tokens for every row, from its whole text."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            base, tokens = [], []
            for value in batch.column("text"):
                content = value.as_py() or ""
                found = base_spans(content)
                base.append([dict(zip(("kind", "start", "end", "value"), f)) for f in found])
                tokens.append([dict(zip(("start", "end", "value"), t)) for t in long_tokens(content, found)])
            span = [("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]
            yield pa.record_batch([batch.column("doc_id"), pa.array(base, pa.list_(pa.struct([("kind", pa.int32()), *span]))),
                                   pa.array(tokens, pa.list_(pa.struct(span)))], ["doc_id", "base", "tokens"])

    return docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id long, {FOUND}")


CLASS = {c: "d" for c in "0123456789"} | {c: "a" for c in "abcdef"} | {c: "l" for c in "ghijklmnopqrstuvwxyz"}
CLASS |= {c: "A" for c in "ABCDEF"} | {c: "U" for c in "GHIJKLMNOPQRSTUVWXYZ"}
CLASSES = str.maketrans(CLASS)
# Classes and marks that a token can hold, and its end: what an unseen step is smoothed over.
NEXT = (*sorted(set(CLASS.values())), *"+/_.=-", "")
SYMBOLS = len(NEXT)
# The kind number of ordinary tokens among the values, how many lengths of prefixes are counted at once, and the cells of
# scores in which a quantile is found.
ORDINARY, DEPTH, CELLS = len(KINDS), 16, 1000


@dataclass
class State:
    """How often the state was reached and ended in, and its successors. A successor that is too rare for the tree is
    counted in `taken` alone."""

    reached: int = 0
    ended: int = 0
    steps: dict[str, "State"] = field(default_factory=dict)
    taken: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic automaton over character classes, learned by merging prefix-tree states.

    `steps` and `counts` have one dict for each state: the state that a symbol leads to, and how often it was taken, with ""
    for the end. A step that the merged tree lacks, because too few values took it to tell its end from any other state,
    leads to the start, as the merging of a state without evidence does.
    """

    def __init__(self, values: Iterable[str], bounds: Bounds = Bounds()):
        words = [value.translate(CLASSES) for value in values]
        tree = State()
        for word in words:
            state = tree
            state.reached += 1
            for c in word[: bounds.characters]:
                state.taken[c] = state.taken.get(c, 0) + 1
                state = state.steps.setdefault(c, State())
                state.reached += 1
            if len(word) > bounds.characters:
                c = word[bounds.characters]
                state.taken[c] = state.taken.get(c, 0) + 1
            else:
                state.ended += 1
        self._learn(tree, bounds)
        self.recount(Counter(step for word in words for step in self.walk(word)))

    @classmethod
    def of_prefixes(cls, prefixes: Iterable[tuple[str, int, dict[str, int]]], bounds: Bounds = Bounds()) -> Automaton:
        """From (prefix, values that begin so, how many of them go on with each symbol or end); shorter ones first, and every
        prefix after its own. The counts of the merged states are still to come: `recount`."""
        self, nodes = cls.__new__(cls), {}
        for prefix, reached, following in prefixes:
            state = nodes[prefix] = State(reached, following.get("", 0), {}, {c: n for c, n in following.items() if c and n})
            if prefix:
                nodes[prefix[:-1]].steps[prefix[-1]] = state
        self._learn(nodes[""], bounds)
        return self

    def _learn(self, tree: State, bounds: Bounds) -> None:
        self.factor = math.sqrt(0.5 * math.log(2 / bounds.confidence))
        kept = self._merged(tree)
        numbers = {id(state): i for i, state in enumerate(kept)}
        self.states = len(kept)
        self.steps = [{c: numbers[id(y)] for c, y in x.steps.items()} for x in kept]
        self.counts: list[dict[str, int]] = [{} for _ in kept]

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        """Hoeffding: whether two observed frequencies are too far apart to be the same probability."""
        return n > 0 and m > 0 and abs(f / n - g / m) > self.factor * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _alike(self, a: State, b: State) -> bool:
        """Whether two states and all that follows both are statistically compatible."""
        waiting, seen = [(a, b)], set()
        while waiting:
            x, y = waiting.pop()
            if x is y or (id(x), id(y)) in seen:
                continue
            seen.add((id(x), id(y)))
            if self._differ(x.ended, x.reached, y.ended, y.reached):
                return False
            for c in x.taken.keys() | y.taken.keys():
                if self._differ(x.taken.get(c, 0), x.reached, y.taken.get(c, 0), y.reached):
                    return False
                if c in x.steps and c in y.steps:
                    waiting.append((x.steps[c], y.steps[c]))
        return True

    def _fold(self, into: State, tree: State) -> None:
        """Adds a subtree's counts to a state and its successors."""
        waiting = [(into, tree)]
        while waiting:
            x, y = waiting.pop()
            x.reached += y.reached
            x.ended += y.ended
            for c, n in y.taken.items():
                x.taken[c] = x.taken.get(c, 0) + n
                if c in x.steps and c in y.steps:
                    waiting.append((x.steps[c], y.steps[c]))
                elif c in y.steps:
                    x.steps[c] = y.steps[c]

    def _merged(self, start: State) -> list[State]:
        """Kept states are compared with the successors that are not yet kept, most frequent first."""
        kept, numbers = [start], {id(start)}
        while True:
            edge = [(x, c) for x in kept for c, y in x.steps.items() if id(y) not in numbers]
            if not edge:
                return kept
            x, c = max(edge, key=lambda e: e[0].taken[e[1]])
            new = x.steps[c]
            for k in kept:
                if self._alike(k, new):
                    x.steps[c] = k
                    self._fold(k, new)
                    break
            else:
                kept.append(new)
                numbers.add(id(new))

    def walk(self, word: str) -> Iterator[tuple[int, str]]:
        """(state, symbol) of a word of classes to its end."""
        state = 0
        for c in word:
            yield state, c
            state = self.steps[state].get(c, 0)
        yield state, ""

    def recount(self, taken: dict[tuple[int, str], int]) -> None:
        """The counts of all walks, in place of any before."""
        self.counts = [{} for _ in self.steps]
        for (state, c), n in taken.items():
            self.counts[state][c] = n
            if c:
                self.steps[state].setdefault(c, 0)
        self.reached = [sum(counts.values()) for counts in self.counts]

    def score(self, value: str) -> float:
        """Mean log2 likelihood for each character, with unseen steps smoothed."""
        word, state, total = value.translate(CLASSES), 0, 0.0
        for c in (*word, ""):
            counts, n = ({}, 0) if state is None else (self.counts[state], self.reached[state])
            total += math.log2((counts.get(c, 0) + 1 / SYMBOLS) / (n + 1))
            state = None if state is None else self.steps[state].get(c)
        return total / (len(word) + 1)


@dataclass
class Formats:
    """One automaton for each kind of credential, one for ordinary tokens, and the score to reach."""

    credentials: list[Automaton]
    ordinary: Automaton
    threshold: float

    def score(self, value: str) -> float:
        """How much likelier the format is as a credential than as an ordinary token, in bits a character."""
        return max(a.score(value) for a in self.credentials) - self.ordinary.score(value)


def learn(credentials: dict[int, list[str]], ordinary: list[str], bounds: Bounds = Bounds()) -> Formats | None:
    """Formats from labelled values that are at hand; `learned` takes them from a table. The threshold is the score that the
    share `bounds.accepted` of the credentials reach, and above that of every ordinary token. None without credentials."""
    automata = [Automaton(values, bounds) for _, values in sorted(credentials.items()) if values]
    if not automata:
        return None
    formats = Formats(automata, Automaton(ordinary, bounds), 0.0)
    reached = sorted((formats.score(v) for values in credentials.values() for v in values), reverse=True)
    low = reached[min(len(reached) - 1, int(bounds.accepted * len(reached)))]
    formats.threshold = max([low, 0.0, *(formats.score(v) for v in ordinary)])
    return formats


def labelled_values(found: DataFrame) -> DataFrame:
    """kind, value: all distinct values of each kind, and all distinct ordinary tokens (words, numbers and addresses joined by
    marks, so without letters and digits in turn) as one kind more."""
    base = found.select(F.explode("base").alias("b")).select(F.col("b.kind").alias("kind"), F.col("b.value").alias("value"))
    tokens = found.select(F.explode("tokens").alias("t")).select(F.lit(ORDINARY).alias("kind"), F.col("t.value").alias("value"))
    plain = tokens.filter(~F.col("value").rlike("[A-Za-z][0-9]+[A-Za-z]|[0-9][A-Za-z]+[0-9]|[a-z][A-Z]+[a-z]"))
    return base.filter(F.length("value") >= 16).union(plain).distinct()


def frequent_prefixes(values: DataFrame, sizes: dict[int, int], bounds: Bounds) -> dict[int, list[tuple[str, int, dict[str, int]]]]:
    """By kind, the prefixes of classes that at least one in `bounds.evidence` of its values has, shorter ones first, counted
    over all values. A prefix of a frequent one is frequent, so lengths are counted DEPTH at a time and the later ones only for
    values with a frequent prefix: at most `bounds.evidence` rows of each length and kind reach the driver."""
    spark = values.sparkSession
    words = values.select("kind", F.translate("value", "".join(CLASS), "".join(CLASS.values())).alias("word"))
    least = F.element_at(F.create_map(*[F.lit(x) for kind, n in sizes.items() for x in (kind, -(-n // bounds.evidence))]), F.col("kind"))
    counts = [F.count_if(F.col("next") == c).alias(f"n{i}") for i, c in enumerate(NEXT)]
    out: dict[int, list[tuple[str, int, dict[str, int]]]] = {kind: [] for kind in sizes}
    low = 0
    while low <= bounds.characters:
        high = min(low + DEPTH, bounds.characters)
        rows = words.filter(F.length("word") >= low).select(
            "kind", "word", F.explode(F.sequence(F.lit(low), F.least(F.length("word"), F.lit(high)))).alias("n"))
        rows = rows.select("kind", F.expr("substring(word, 1, n)").alias("prefix"), F.expr("substring(word, n + 1, 1)").alias("next"))
        counted = rows.groupBy("kind", "prefix").agg(F.count("*").alias("reached"), *counts).filter(F.col("reached") >= least)
        found = sorted(counted.collect(), key=lambda r: (len(r.prefix), r.prefix))
        for r in found:
            out[r.kind].append((r.prefix, r.reached, {c: r[f"n{i}"] for i, c in enumerate(NEXT)}))
        longest = [(r.kind, r.prefix) for r in found if len(r.prefix) == high]
        if not longest:
            break
        frontier = spark.createDataFrame(longest, "kind int, head string")
        words = words.withColumn("head", F.substring("word", 1, high)).join(F.broadcast(frontier), ["kind", "head"], "left_semi")
        words, low = words.select("kind", "word"), high + 1
    return out


def count_walks(values: DataFrame, automata: dict[int, Automaton]) -> None:
    """Sets the counts of each automaton from the walks of all values of its kind, each to its end. A task holds one count for
    each step of the automata."""
    shared = values.sparkSession.sparkContext.broadcast(automata)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: Counter[tuple[int, int, str]] = Counter()
        for batch in batches:
            for kind, value in zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist()):
                taken.update((kind, *step) for step in shared.value[kind].walk(value.translate(CLASSES)))
        keys = list(taken)
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                               pa.array([k[2] for k in keys], pa.string()), pa.array([taken[k] for k in keys], pa.int64())],
                              ["kind", "state", "symbol", "n"])

    rows = values.mapInArrow(run, "kind int, state int, symbol string, n long").groupBy("kind", "state", "symbol").agg(F.sum("n").alias("n"))
    counts: dict[int, dict[tuple[int, str], int]] = {kind: {} for kind in automata}
    for r in rows.collect():
        counts[r.kind][r.state, r.symbol] = r.n
    for kind, automaton in automata.items():
        automaton.recount(counts[kind])


def nth_largest(scores: DataFrame, n: int) -> float:
    """The score at place `n`, from 0, in falling order. Cells of scores are counted, and the one that holds the place is cut
    again, until it has few distinct scores."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    while True:
        inside = scores.filter(F.col("score").between(low, high))
        cells = inside.groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).limit(CELLS + 1).collect()
        few = len(cells) <= CELLS
        if not few:
            cell = F.floor((F.col("score") - low) / ((high - low) / CELLS))
            cells = inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
            cells = cells.orderBy(F.desc("cell")).collect()
        for cell in cells:
            if n < cell.n:
                break
            n -= cell.n
        if few:
            return cell.score
        low, high = cell.low, cell.high


def learned(found: DataFrame, bounds: Bounds = Bounds()) -> Formats | None:
    """As `learn`, from all values in the result of `scan`: counted, walked and scored where they lie."""
    values = materialise(labelled_values(found))
    sizes = {r.kind: r["count"] for r in values.groupBy("kind").count().collect()}
    credentials = sorted(set(sizes) - {ORDINARY})
    if not credentials:
        return None
    prefixes = frequent_prefixes(values, sizes, bounds)
    automata = {kind: Automaton.of_prefixes(prefixes[kind], bounds) for kind in sizes}
    count_walks(values, automata)
    formats = Formats([automata[kind] for kind in credentials], automata.get(ORDINARY) or Automaton([], bounds), 0.0)
    shared = found.sparkSession.sparkContext.broadcast(formats)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("kind"), pa.array([shared.value.score(v) for v in batch.column("value").to_pylist()], pa.float64())],
                                  ["kind", "score"])

    scores = materialise(values.mapInArrow(run, "kind int, score double"))
    size = sum(sizes[kind] for kind in credentials)
    low = nth_largest(scores.filter(F.col("kind") != ORDINARY), min(size - 1, int(bounds.accepted * size)))
    formats.threshold = max(low, 0.0, scores.filter(F.col("kind") == ORDINARY).agg(F.max("score")).first()[0] or 0.0)
    return formats


def secrets(docs: DataFrame, bounds: Bounds = Bounds(), row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans (array of kind, start, end, by start and then kind) for every row.

    kind is an index of KINDS; start and end are code points, end exclusive. Base spans are always
    there; `format` spans are those that the learned automata add, never over a base span. A null text
    counts as empty and has no spans. Repeated rows and rows with a null doc_id stay. Without any base
    secret in the whole table nothing can be learned and nothing is added. An empty table gives an empty
    result. Other columns are ignored.
    """
    found = materialise(scan(docs, row_id, text))
    formats = docs.sparkSession.sparkContext.broadcast(learned(found, bounds))

    def run(batches: Iterable[pa.RecordBatch]):
        model = formats.value
        for batch in batches:
            spans = []
            for base, tokens in zip(batch.column("base"), batch.column("tokens")):
                own = [(b["kind"], b["start"], b["end"]) for b in base.as_py()]
                if model:
                    own += [(3, t["start"], t["end"]) for t in tokens.as_py() if model.score(t["value"]) > model.threshold]
                own.sort(key=lambda s: (s[1], s[0]))
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in own])
            kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return found.mapInArrow(run, "doc_id long, spans array<struct<kind:int,start:long,end:long>>")

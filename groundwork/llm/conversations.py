"""Repair of the structure of conversations at least cost, by block tables (the Four Russians' method).

A conversation is in order if its roles read `(s?(ua)+)?` by their first letters: at most one system turn, then
pairs of user and assistant. What follows is decided by one of four states: nothing yet (0), a system turn (1),
a user's turn (2), an answer (3); 0 and 3 may end. Rows are kept (cost 0), given another role (2) or deleted
(3), and turns without text are inserted (2); rows that end in the middle cost 1 unless they are deleted, blank
and repeated rows must be deleted.

Let f(s) be the least cost of all that follows a place, from state s. Two places whose vectors f differ by a
constant have the same cheapest edits, so vectors are normalised by their least entry, and few are left: they
are found by taking every symbol of a row from every vector found so far. For each of them and each block of
BLOCK symbols the vector before the block and the constant are looked up in a table that is filled once. A
conversation is read in blocks from its end; only the vectors between blocks are kept. Then each block in turn
is expanded backward from the vector after it, and traced forward from the state in which it is entered: the
first letter that costs no more than the least is taken, so ties give the audit that is least in ASCII.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice, product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.session import materialise

BLOCK = 4
ROWS_AT_ONCE = 1000
KEEP, OTHER_ROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
SPACES = " \t\n\x0b\x0c\r"
# Faults of a row, and the letter of its symbol: role s, u, a or another, and fault, from "A" on.
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
ROLES = "sua"
FIRST = ord("A")
# From each state: the state after a system turn, a user's turn, an answer (-1: not in order).
NEXT = [(1, 2, -1), (-1, 2, -1), (-1, -1, 3), (-1, 2, -1)]
# From each state the state that an inserted or renamed turn leads to: its role is settled.
ALTERNATE = [2, 2, 3, 2]
Costs = tuple[int, int, int, int]


def symbol(role: Column, fault: Column) -> Column:
    """One letter for the role's first letter and the fault of a row."""
    kind = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.substring(role, 1, 1)), F.lit(0)) - 1
    return F.char(FIRST + 4 * F.when(kind < 0, F.lit(3)).otherwise(kind) + fault)


def _relaxed(g: list[float]) -> list[float]:
    """Costs after insertions. Two in a row lead back to where they began, so one step each way is enough."""
    f2, f3 = min(g[2], INSERT + g[3]), min(g[3], INSERT + g[2])
    return [min(g[0], INSERT + f2), min(g[1], INSERT + f2), f2, f3]


def _edits(row: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row, by letter."""
    kind, fault = divmod(ord(row) - FIRST, 4)
    found = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        more = CUT_SHORT if fault == TRUNCATED else 0
        if kind < 3 and NEXT[state][kind] >= 0:
            found.append(("K", KEEP + more, NEXT[state][kind]))
        found.append(("R", OTHER_ROLE + more, ALTERNATE[state]))
    return found


def _before(row: str, after: Costs) -> Costs:
    """The costs before a row, from those after it."""
    f = _relaxed([min(cost + after[to] for _, cost, to in _edits(row, state)) for state in range(4)])
    return f[0], f[1], f[2], f[3]


def _normal(costs: Costs) -> tuple[Costs, int]:
    least = min(costs)
    return (costs[0] - least, costs[1] - least, costs[2] - least, costs[3] - least), least


AT_END, _ = _normal(tuple(_relaxed([0, float("inf"), float("inf"), 0])))
ALPHABET = [chr(FIRST + i) for i in range(16)]


@dataclass
class Tables:
    """vectors: all normalised cost vectors; single, whole: for a row, and for a block, the number of the vector
    before it and the constant, by the number of the vector after it."""

    vectors: list[Costs] = field(default_factory=list)
    single: list[dict[str, tuple[int, int]]] = field(default_factory=list)
    whole: list[dict[str, tuple[int, int]]] = field(default_factory=list)
    traced: dict[tuple[int, str, int], tuple[str, int]] = field(default_factory=dict)

    def step_back(self, rows: str, number: int) -> tuple[int, int]:
        total = 0
        for row in reversed(rows):
            number, more = self.single[number][row]
            total += more
        return number, total


@lru_cache(maxsize=1)
def tables() -> Tables:
    """Filled once for a worker. The vectors are closed under all rows, so every conversation stays within them."""
    made = Tables()
    numbers = {AT_END: 0}
    made.vectors.append(AT_END)
    for after in made.vectors:  # grows while it is read
        steps = {}
        for row in ALPHABET:
            before, more = _normal(_before(row, after))
            if before not in numbers:
                numbers[before] = len(made.vectors)
                made.vectors.append(before)
            steps[row] = numbers[before], more
        made.single.append(steps)
    # Rows that must be deleted are alike, whatever their role and fault: blocks are over the rows that differ.
    distinct = [row for row in ALPHABET if same(row) == row]
    blocks = ["".join(rows) for rows in product(distinct, repeat=BLOCK)]
    made.whole = [{block: made.step_back(block, number) for block in blocks} for number in range(len(made.vectors))]
    return made


def same(row: str) -> str:
    """The row that stands for all that are treated alike."""
    return chr(FIRST + BLANK) if (ord(row) - FIRST) % 4 in (BLANK, DUPLICATE) else row


ALIKE = str.maketrans({row: same(row) for row in ALPHABET})


def _trace(made: Tables, rows: str, after: int, state: int) -> tuple[str, int]:
    """The cheapest edits of a few rows from a state, least in ASCII, and the state behind them."""
    key = after, rows, state
    known = made.traced.get(key)
    if known:
        return known
    costs = [made.vectors[after]]
    for row in reversed(rows):
        costs.append(_before(row, costs[-1]))
    costs.reverse()
    audit, entered = "", state
    for at, row in enumerate(rows):
        while True:
            choices = [(letter, cost + costs[at + 1][to], to, True) for letter, cost, to in _edits(row, state)]
            choices.append(("I", INSERT + costs[at][ALTERNATE[state]], ALTERNATE[state], False))
            letter, _, state, done = min((c for c in choices if c[1] == costs[at][state]), key=lambda c: c[0])
            audit += letter
            if done:
                break
    made.traced[key] = audit, state
    return made.traced[key]


def cheapest(rows: str) -> tuple[int, str]:
    """The least cost of a repair, and the letters of its edits in order; of equal costs the least in ASCII."""
    made = tables()
    rows = rows.translate(ALIKE)
    number, total = 0, min(_relaxed([0, float("inf"), float("inf"), 0]))
    cuts = list(range(len(rows) % BLOCK, len(rows), BLOCK))
    behind = []
    for at in reversed(cuts):
        behind.append(number)
        number, more = made.whole[number][rows[at : at + BLOCK]]
        total += more
    first = rows[: len(rows) % BLOCK]
    parts, state = [], 0
    start, more = made.step_back(first, number)
    cost = total + more + made.vectors[start][0]
    audit, state = _trace(made, first, number, state)
    parts.append(audit)
    for at, after in zip(cuts, reversed(behind)):
        audit, state = _trace(made, rows[at : at + BLOCK], after, state)
        parts.append(audit)
    while state in (1, 2):
        parts.append("I")
        state = ALTERNATE[state]
    return int(cost), "".join(parts)


def _kinds(rows: str) -> tuple[int, int, int, int]:
    """How many rows are blank, duplicate and truncated, and how many neighbours have roles out of order."""
    faults = [sum(rows.count(ROW) for ROW in ALPHABET[fault::4]) for fault in (BLANK, DUPLICATE, TRUNCATED)]
    roles = rows.translate(str.maketrans({row: "suax"[i // 4] for i, row in enumerate(ALPHABET)}))
    # No legal pair overlaps itself, so counting them without overlap finds all.
    return *faults, max(0, len(roles) - 1) - sum(roles.count(pair) for pair in ("su", "ua", "au"))


def labelled(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, key (a digest of the text), copies, row (the symbol of the first copy), more (that of the
    others), for every distinct row; rows has conv_id, turn, role and text without nulls in the last two.

    Equal rows are counted before anything is joined. Of equal role and text in a conversation the first by
    turn, null first, is no duplicate. A text is told by its SHA-256, so no text is shuffled.
    """
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    found = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("key"), last.alias("last"))
    found = found.groupBy("conv_id", "turn", "role", "key", "last").agg(F.count("*").alias("copies"))
    found = materialise(found)
    placed = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    first = found.groupBy("conv_id", "role", "key").agg(F.count("*").alias("n"), F.min(placed).alias("first"))
    # Few rows have an equal one in another turn: the others need no join.
    first = first.filter("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"), "first")
    joined = found.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k")), "left")
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    blank, ends = F.col("last") == "", F.col("last").isin(".", "!", "?")
    fault = F.when(blank, BLANK).when(again, DUPLICATE).when(~ends, TRUNCATED).otherwise(CLEAN)
    return joined.select("conv_id", "turn", "role", "key", "copies", symbol(F.col("role"), fault).alias("row"),
                         symbol(F.col("role"), F.when(blank, BLANK).otherwise(DUPLICATE)).alias("more"))


ORDER = ["turn", "role", "key"]


def sequences(rows: DataFrame) -> DataFrame:
    """conv_id, rows: the symbols of each conversation by turn (null first), role and digest, one letter a row.

    Rows are sorted over all tasks by conversation and turn, so a conversation with very many rows is cut
    over several; each hands on the letters of its part, and only these are put together.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, first, parts = None, True, []
        for batch in batches:
            for conv_id, row, more, copies in zip(*[c.to_pylist() for c in batch.columns]):
                if first or conv_id != whose:
                    if parts:
                        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([whose], pa.int64()), "letters": ["".join(parts)]})
                    whose, first, parts = conv_id, False, []
                parts.append(row + more * (copies - 1))
        if parts:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([whose], pa.int64()), "letters": ["".join(parts)]})

    ordered = rows.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    cut = ordered.select("conv_id", "row", "more", "copies").mapInArrow(run, "conv_id long, letters string")
    cut = cut.withColumn("task", F.spark_partition_id())
    parts = F.transform(F.array_sort(F.collect_list(F.struct("task", "letters"))), lambda p: p["letters"])
    return cut.groupBy("conv_id").agg(F.array_join(parts, "").alias("rows"))


def plans(found: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, audit for each sequence."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            counts = list(zip(*map(_kinds, rows))) or [()] * 4
            edits = list(zip(*map(cheapest, rows))) or [()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(edits[0], pa.int64()), pa.array(edits[1], pa.string())],
                names=["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    return found.mapInArrow(run, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


class _Repair:
    """Applies the letters of one conversation to its rows, one after the other."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _alternate(self) -> str:
        self.state = ALTERNATE[self.state]
        return "user" if self.state == 2 else "assistant"

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit.startswith("I", self.at):
            self.at += 1
            yield self._alternate(), ""

    def rows(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = NEXT[self.state][ROLES.index(role[0])]
            yield role, text
        elif letter == "R":
            yield self._alternate(), text


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text: the rows of all conversations after repair."""
    def run(batches):
        for conv_id, turns in _streamed(batches):
            placed = enumerate(turns)
            while found := list(islice(placed, ROWS_AT_ONCE)):
                yield pa.RecordBatch.from_pydict({
                    "conv_id": pa.array([conv_id] * len(found), pa.int64()), "place": pa.array([i for i, _ in found], pa.int64()),
                    "role": pa.array([r for _, (r, _) in found], pa.string()), "text": pa.array([t for _, (_, t) in found], pa.string())})

    return _by_conversation(rows, planned).mapInArrow(run, "conv_id long, place long, role string, text string")


def digests(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of `role:text` of the repaired rows, joined by line ends.

    A digest is taken in the order of the text, so one task reads a conversation from its first row to its
    last; it holds no more than one batch of rows and the letters of the edits.
    """
    def run(batches):
        for conv_id, turns in _streamed(batches):
            digest, empty = hashlib.sha256(), True
            for role, text in turns:
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv_id], pa.int64()), "repaired_sha256": [digest.hexdigest()]})

    return _by_conversation(rows, planned).mapInArrow(run, "conv_id long, repaired_sha256 string")


def _by_conversation(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The edits of each conversation, then its rows in order."""
    none = F.lit(None)
    edits = planned.select("conv_id", F.col("audit").alias("text"), F.lit(False).alias("is_row"), none.cast("long").alias("turn"),
                           none.cast("string").alias("role"), none.cast("string").alias("key"))
    own = rows.select("conv_id", "text", F.lit(True).alias("is_row"), "turn", "role", F.sha2("text", 256).alias("key"))
    order = ["conv_id", "is_row", *ORDER]
    return (edits.unionByName(own).repartition("conv_id").sortWithinPartitions(*order)
            .select("conv_id", "is_row", "role", "text"))


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str, str]]]]:
    """Each conversation of a sorted task with an iterator over its repaired turns, which must be used up."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    ahead = next(rows, None)

    def turns(audit: str) -> Iterator[tuple[str, str]]:
        nonlocal ahead
        repair = _Repair(audit)
        ahead = next(rows, None)
        while ahead is not None and ahead[1]:
            yield from repair.rows(ahead[2], ahead[3])
            ahead = next(rows, None)
        yield from repair.inserted()

    while ahead is not None:
        yield ahead[0], turns(ahead[3])


def gaps(rows: DataFrame) -> DataFrame:
    """conv_id, gaps: how many turns between the first and the last are missing; 0 where no turn is given."""
    missing = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    return rows.groupBy("conv_id").agg(F.coalesce(missing, F.lit(0)).cast("long").alias("gaps"))


def prepared(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of every row; a null role or text is one space."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conversation.

    Takes (conv_id, turn, role, text). A null role or text is one space: such a text is blank. Rows without a
    conv_id are one conversation. Rows come by turn, null first; rows of one turn by role, then by the
    SHA-256 of their text, so equal rows are side by side. Of edits that cost the same the letters that are
    least in ASCII are taken. Texts of any length count whole. An empty table gives an empty result.
    Columns other than the four named are ignored. `repaired` gives the rows themselves.
    """
    rows = prepared(rows)
    planned = materialise(plans(sequences(labelled(rows))))
    joined = planned.withColumnRenamed("conv_id", "c").join(gaps(rows), F.col("c").eqNullSafe(F.col("conv_id"))).drop("c")
    digest = digests(rows, planned).withColumnRenamed("conv_id", "c")
    return joined.join(digest, F.col("c").eqNullSafe(F.col("conv_id"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")

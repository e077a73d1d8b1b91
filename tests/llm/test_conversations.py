"""Repair of conversations against brute force, and the query row by row."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from groundwork.llm import conversations, queries
from tests.llm.conftest import SF


def plain_repair(rows):
    """(cost, audit, repaired rows) of (role, text, fault), the least over all edits, then over all audits."""
    @lru_cache(None)
    def best(i, last, inserted):
        found = []
        if i == len(rows):
            if last in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            cost, audit, out = best(i + 1, last, 0)
            found.append((cost + 3, "D" + audit, out))
            if fault not in ("blank", "duplicate"):
                for new, price, letter in ((role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")):
                    if new and last + new[0] in ("s", "u", "su", "ua", "au"):
                        cost, audit, out = best(i + 1, new[0], 0)
                        found.append((cost + price + (fault == "truncated"), letter + audit, ((new, text), *out)))
        if inserted < 3:
            for new in ("user", "assistant"):
                if last + new[0] in ("u", "su", "ua", "au"):
                    cost, audit, out = best(i, new[0], inserted + 1)
                    found.append((cost + 2, "I" + audit, ((new, ""), *out)))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def plain_faults(rows):
    seen, found = set(), []
    for role, text in rows:
        words = re.sub("[\x20\x09-\x0d]", "", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated"
        seen.add((role, text))
        found.append((role, text, fault))
    return found


def plain_rows(table):
    """All rows of the query. Rows of one turn come by role and digest."""
    groups = {}
    for r in table.select("conv_id", "turn", "role", "text").collect():
        role, text = (" " if v is None else v for v in (r.role, r.text))
        name = ":".join(" " if v is None else str(v) for v in (r.conv_id, r.turn))
        h = zlib.crc32(name.encode()) % 20
        group = groups.setdefault(r.conv_id, [])
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        group += [(r.turn, role, text)] * {0: 0, 3: 2}.get(h, 1)
    out = []
    for conv_id, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        faults = plain_faults([r[1:] for r in rows])
        cost, audit, repaired = plain_repair(tuple(faults))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:]))
        counts = [sum(f[2] == kind for f in faults) for kind in ("blank", "duplicate", "truncated")]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv_id, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=repr)


def test_cost_and_audit_equal_brute_force():
    rng = random.Random(1)
    faults = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
    for _ in range(1500):
        rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), "", rng.choice(["", "", *faults]))
                for _ in range(rng.randrange(16))]
        letters = "".join(chr(65 + 4 * "sua".find(r[0][0]) + faults[r[2]] + (16 if r[0] == "tool" else 0)) for r in rows)
        assert conversations.cheapest(letters) == plain_repair(tuple(rows))[:2]


def test_one_long_conversation():
    """Blocks of a conversation of 100,000 rows cost what the rows cost one by one."""
    rng = random.Random(2)
    letters = "".join(rng.choice(conversations.ALPHABET) for _ in range(100_000))
    costs = (0.0, 4.0, 2.0, 0.0)
    for row in reversed(letters):
        costs = conversations._before(row, costs)
    cost, audit = conversations.cheapest(letters)
    assert cost == costs[0] and len(re.sub("I", "", audit)) == len(letters)


def test_query_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    got = sorted((tuple(r) for r in queries.op13_conversations(spark, SF).collect()), key=repr)
    assert got == plain_rows(table) and len(got) == 100


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, roles of other and of no letter, blank and repeated rows, several rows of a turn, a long
    text, a conversation of 300 rows of two texts, and columns named as the operator's own."""
    rng = random.Random(5)
    rows = [(None, 1, "user", "a."), (None, None, None, None), (1, None, "user", "Hi."), (1, 2, None, "x"), (1, 3, "", "y."), (2, 1, "user", None),
            (3, 7, "user", "Same."), (3, 7, "user", "Same."), (3, 7, "assistant", "Same."), (3, 9, "user", "Same."), (3, 2**62, "tool", "t!"),
            (4, 0, "system", " \x0b"), (5, 0, "user", "long " * 100_000), (5, 1, "assistant", "end.\n\t"), (6, 0, "user", "no-break\xa0")]
    rows += [(7, rng.randrange(280), rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "1 as key", "'x' as row", "2 as copies", "3 as audit", "4 as h", "5 as c")


def query(spark, table, path):
    table.write.parquet(f"{path}/conversations.parquet")
    return sorted((tuple(r) for r in queries.op13_conversations(spark, str(path)).collect()), key=repr)


def test_odd_rows(spark, odd, tmp_path):
    assert query(spark, odd, tmp_path / "odd") == plain_rows(odd)


def test_all_rows_dropped_and_no_rows(spark, odd, tmp_path):
    n = next(n for n in range(10**6) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    gone = spark.createDataFrame([(n, 0, "user", "Gone.")], "conv_id long, turn long, role string, text string")
    assert query(spark, gone, tmp_path / "gone") == [(n, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert query(spark, odd.limit(0), tmp_path / "none") == []


def test_a_conversation_cut_over_many_tasks(spark, odd):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = conversations.labelled(conversations.prepared(odd))
    found = {r.conv_id: r.rows for r in conversations.sequences(rows).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found[7]) == 300 and sum(map(len, found.values())) == odd.count()


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "Hello."), (1, 2, "user", "Bye."), (1, 3, "user", " ")],
                                 "conv_id long, turn long, role string, text string")
    planned = conversations.plans(conversations.sequences(conversations.labelled(rows)))
    got = [(r.place, r.role, r.text) for r in conversations.repaired(rows, planned).orderBy("place").collect()]
    cost, audit, want = plain_repair(tuple(plain_faults([("assistant", "Hello."), ("user", "Bye."), ("user", " ")])))
    assert got == [(i, r, t) for i, (r, t) in enumerate(want)] and planned.first().audit == audit and planned.first().cost == cost

"""Periodic runs against brute force, and the query row by row."""

import hashlib
import random
import re
import zlib

import numpy as np

from groundwork.llm import periodic_runs, queries
from tests.llm.conftest import SF


def plain_runs(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            stretch = w[i : j + q]
            if j > i and len(stretch) >= max(6, 4 * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                found.append((i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        w = [rng.randrange(rng.choice([1, 2, 2, 3, 5, 30])) for _ in range(rng.randrange(150))]
        for _ in range(rng.randrange(4)):  # runs inside and across one another
            if len(w) > 8:
                a, p = rng.randrange(len(w)), rng.randrange(1, len(w) // 4)
                for i in range(a + p, min(len(w), a + p * rng.randrange(3, 9))):
                    w[i] = w[i - p]
        assert periodic_runs.runs_in(np.array(w, np.int64)) == plain_runs(w)


def test_long_stretches():
    assert periodic_runs.runs_in(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert periodic_runs.runs_in(np.arange(100_000) % 20_001) == [(0, 100_000, 20_001)]
    fibonacci = "a", "ab"
    while len(fibonacci[1]) < 3000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert periodic_runs.runs_in(np.frombuffer(fibonacci[1].encode(), np.uint8).astype(np.int64)) == plain_runs(fibonacci[1])


def plain_digest(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = plain_runs(w)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    s, length, q = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
        "".join(f"{a},{b},{c}\n" for a, b, c in runs), " ".join(x for i, x in enumerate(w) if i not in dropped))]
    return (doc_id, len(runs), s, length, q, 1000 * length // q if q else None, *sha)


def plain_rows(docs, longest=3000):
    return sorted((plain_digest(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()
                   if len((r.text or "").split()) <= longest), key=repr)


def rows_of(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    return queries.op12_periodic_runs(spark, str(path)).collect()


def test_query_equals_brute_force(spark, documents):
    got = {tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()}
    want = plain_rows(documents, 700)
    assert len(got) == documents.count() and len(want) > 800 and set(want) <= got
    assert sum(r[1] > 0 for r in want) > 50


def test_odd_rows(spark, odd_documents, tmp_path):
    """Null and blank texts, a null id, one text of 20,000 words (a run of period 2), repeated rows."""
    got = rows_of(spark, odd_documents, tmp_path / "odd")
    assert sorted((tuple(r) for r in got if r.doc_id != 5), key=repr) == plain_rows(odd_documents)
    long = next(r for r in got if r.doc_id == 5)
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 40_000, 2, 20_000_000)
    assert long.collapsed_sha256 == hashlib.sha256(b"long words").hexdigest()
    assert rows_of(spark, odd_documents.limit(0), tmp_path / "none") == []


def test_general_interface(spark):
    rows = spark.createDataFrame([(1, "x a b a b a b a b a b y y y y y y", 7)], "doc_id long, text string, runs int")
    got = periodic_runs.periodic_runs(rows).first()
    assert [tuple(r) for r in got.runs] == [(1, 10, 2), (11, 6, 1)] and got.collapsed == "x a b y" and got.n_words == 17

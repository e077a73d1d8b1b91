"""A keyword index that takes changes against one that is built anew."""

import random

import pytest

from groundwork.operators import index, keyword, segments

WORDS = [f"w{i}" for i in range(50)] + ["the", "pumps", "pump", "cities", "city"]
SCHEMA = "ticket_id string, search_text string"


def _text(rng):
    return " ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(len(WORDS))], k=rng.randrange(0, 30)))


def _files(tmp_path):
    return {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}


@pytest.fixture
def asked(spark):
    texts = ["w0 w1", "w3", "the pump", "city w2 w0", "w49 w48", "absent", "w1 the w0"]
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "question_id string, question string").cache()


def _same(spark, got, rows):
    """Postings, statistics and frequencies equal those of the tickets as they are, so every search does."""
    texts = spark.createDataFrame(sorted(rows.items()), SCHEMA)
    fields = ["stem", "ticket_id", "doc_len", "tf", "hits"]
    want = index.postings_by_stem(texts).select(fields).collect()
    assert sorted(map(repr, got.postings.select(fields).collect())) == sorted(map(repr, want))
    counts = {}
    for r in want:
        df, n = counts.get(r.stem, (0, 0))
        counts[r.stem] = df + (r.tf > 0), n + 1
    found = got.frequencies.select("stem", "df", "n_tickets").collect()
    assert len(found) == len(counts) and {r.stem: (r.df, r.n_tickets) for r in found} == counts
    lengths = [r.doc_len for r in index.words_by_stem(texts).select("doc_len").collect()]
    assert (got.size, got.mean_length) == (len(rows), sum(lengths) / len(rows))


def test_changes_equal_a_new_index(spark, tmp_path, asked):
    rng = random.Random(5)
    rows = {f"t{i:03d}": _text(rng) for i in range(120)}
    made = segments.create(spark.createDataFrame(sorted(rows.items()), SCHEMA), str(tmp_path / "i"), folders=4)
    _same(spark, made.at(), rows)
    before = dict(rows)
    for step in range(2):
        there = _files(tmp_path / "i")
        # some new, some changed (a few of them for the second time), one without words, some gone, one of both
        batch = {f"t{i:03d}": _text(rng) for i in [*range(step * 10, step * 10 + 20), 200 + step]} | {"t119": None}
        gone = [f"t{i:03d}" for i in range(60 + step * 5, 70 + step * 5)] + ["t119", "unknown"]
        made.change(spark.createDataFrame(sorted(batch.items()), SCHEMA), spark.createDataFrame([(g,) for g in gone], "ticket_id string"))
        rows = {k: v for k, v in rows.items() if k not in gone} | batch
        now = _files(tmp_path / "i")
        assert all(now.get(p) == at for p, at in there.items())  # nothing that was there is rewritten
    _same(spark, made.at(), rows)
    _same(spark, made.at(0), before)  # an earlier version stays as it was
    assert len(made.sizes()) == 3 and sum(made.sizes().values()) == len(rows)
    assert made.merge(fanout=8) == 0  # too few of one size
    assert made.merge(everything=True) == 3 and len(made.sizes()) == 1
    assert made.release() and made.release() == []
    opened = segments.open_segments(spark, str(tmp_path / "i"))
    texts = spark.createDataFrame(sorted(rows.items()), SCHEMA)
    assert sorted(map(tuple, index.bm25(opened.at(), asked).collect())) == sorted(map(tuple, keyword.bm25(texts, asked).collect()))
    _same(spark, opened.at(), rows)
    with pytest.raises(ValueError):
        opened.at(0)
    # after a merge a change finds its dead tickets in the merged segment
    opened.change(deleted=spark.createDataFrame([("t001",), ("t002",)], "ticket_id string"))
    rows = {k: v for k, v in rows.items() if k not in ("t001", "t002")}
    _same(spark, opened.at(), rows)


def test_small_segments_are_merged_and_the_large_one_stays(spark, tmp_path):
    rng = random.Random(6)
    rows = {f"t{i:03d}": _text(rng) for i in range(80)}
    made = segments.create(spark.createDataFrame(sorted(rows.items()), SCHEMA), str(tmp_path / "i"), folders=4)
    large = set(made.sizes())
    for i in range(2):
        batch = {f"t{i:03d}": _text(rng)}
        made.change(spark.createDataFrame(sorted(batch.items()), SCHEMA))
        rows |= batch
    assert made.merge(fanout=2) == 2
    assert large < set(made.sizes()) and sorted(made.sizes().values()) == [2, 78]
    _same(spark, made.at(), rows)


def test_a_bad_batch_changes_nothing_and_nothing_can_be_indexed(spark, tmp_path, asked):
    made = segments.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "i"), folders=2)
    assert index.bm25(made.at(), asked).isEmpty() and made.at().size == 0
    for bad in ([("a", "w0"), ("a", "w1")], [(None, "w0")]):
        with pytest.raises(ValueError):
            made.change(spark.createDataFrame(bad, SCHEMA))
    made.change()
    assert made.at().size == 0
    made.change(spark.createDataFrame([("a", "w0 w1", 7)], f"{SCHEMA}, segment int"))  # a column with a name of the index's own
    assert [r.ticket_id for r in index.match_all(made.at(), asked.filter("question_id = 'q0'")).collect()] == ["a"]

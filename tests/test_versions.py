"""Upserts by change files: what is touched, what is read, and what a second writer meets."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from groundwork.sources import merge, versions

SCHEMA = "id long, title string, embedding array<float>"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/b*/part=*/*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(2000).select("id", F.concat(F.lit("t"), "id").alias("title"), F.array(F.col("id").cast("float")).alias("embedding"))
    return versions.create(rows, str(tmp_path / "table"), "id", "embedding", parts=20)


def test_a_small_batch_rewrites_only_touched_parts(spark, table):
    before = files(table.path)
    assert len(before) >= 20 and table.read().count() == 2000
    batch = spark.createDataFrame([(i, "new", [0.0]) for i in range(500, 520)], SCHEMA)
    table.upsert_replace(batch)
    assert files(table.path) == before  # no base file is touched
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 3  # parts as they are, and base and changes of the touched ones
    assert table.read().filter("title = 'new'").count() == 20 and table.read().count() == 2000
    table.compact()
    _, entries = table._entries()
    new = {e for e in files(table.path) - before}
    assert all(e[1] == "base" for e in entries) and {f.split("/part=")[1].split("/")[0] for f in new} <= {"4", "5"}
    assert sum(e[2] == 0 for e in entries) >= 18  # the other parts are the files of the first version
    assert table.read().filter("title = 'new'").count() == 20 and table.read().count() == 2000


def test_versions_stay_readable_until_released(spark, table):
    table.upsert_replace(spark.createDataFrame([(7, "seven", [7.5]), (9999, "added", [1.0])], SCHEMA))
    table.compact()
    assert [table.read(v).count() for v in (0, 1, 2)] == [2000, 2001, 2001]
    assert table.read(0).filter("id = 7").first().title == "t7" and table.read(1).filter("id = 7").first().title == "seven"
    want = rows_of(table.read())
    gone = table.release()
    assert len(gone) >= 2 and not any(os.path.exists(f"{table.path}/{f}") for f in gone)
    again = versions.open_versions(spark, table.path, "id", "embedding")
    assert rows_of(again.read()) == want and again.manifest()[0] == 2


def test_the_second_of_two_writers_fails(spark, table):
    version, entries = table._entries()
    table.upsert_replace(spark.createDataFrame([(1, "first", [0.0])], SCHEMA))
    with pytest.raises(Exception, match="[Ee]xists"):
        table._commit(entries, version + 1)
    assert table.read().filter("title = 'first'").count() == 1


def test_many_mixed_upserts_equal_plain_ones(spark, tmp_path):
    rng = random.Random(3)
    state = spark.createDataFrame([(i, f"t{i}", [float(i)]) for i in range(40)], SCHEMA)
    table = versions.create(state, str(tmp_path / "table"), "id", "embedding", parts=5)
    for step in range(6):
        batch = spark.createDataFrame([(i, rng.choice([f"s{step}", None]), [float(step)]) for i in rng.sample(range(60), 12)], SCHEMA)
        if rng.random() < 0.5:
            table.upsert_replace(batch)
            state = merge.upsert_replace(state, batch, "id")
        else:
            table.upsert_column(batch)
            state = merge.upsert_embedding(state, batch, "id")
        state = spark.createDataFrame(state.collect(), SCHEMA)
        if step == 3:
            table.compact()
        assert rows_of(table.read()) == rows_of(state)


def test_text_keys_empty_tables_and_null_keys(spark, tmp_path):
    schema = "k string, v string, note string"
    table = versions.create(spark.createDataFrame([], schema), str(tmp_path / "none"), "k", "v")
    assert table.read().count() == 0
    table.compact()
    table.upsert_column(spark.createDataFrame([("b", "1", "x"), ("a", None, "y")], schema))
    table.upsert_column(spark.createDataFrame([("a", "2", "z")], schema))
    assert rows_of(table.read()) == [("a", "2", "y"), ("b", "1", "x")]
    table.upsert_replace(spark.createDataFrame([], schema))
    assert table.read().count() == 2
    words = versions.create(spark.createDataFrame([(w, w, w) for w in "ab é 日 zz 😀 y".split()], schema), str(tmp_path / "words"), "k", "v", parts=3)
    words.upsert_replace(spark.createDataFrame([("é", "new", None)], schema))
    assert words.read().count() == 6 and words.read().filter("v = 'new'").count() == 1
    with pytest.raises(Exception, match="key is null"):
        words.upsert_replace(spark.createDataFrame([(None, "x", "y")], schema))

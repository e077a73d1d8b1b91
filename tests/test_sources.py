import pytest
from pyspark.sql import functions as F

from groundwork.functions.vectors import from_text, to_text
from groundwork.operators.expectations import schema
from groundwork.schema import TICKET_COLUMNS, TICKET_SCHEMA
from groundwork.sources import merge
from groundwork.sources.tickets import read_raw, read_store, read_tickets, store, to_ticket, write_csv
from tests.fixture import tickets


@pytest.mark.parametrize("encoded", [True, False])
def test_csv_round_trip_keeps_text_and_types(spark, tmp_path, encoded):
    text = ' two\nlines, "quoted" and C:\\new\\\\s '
    rows = tickets(spark).withColumn("description", F.when(F.col("ticket_id") == "INC-2026-04001", text).otherwise(F.col("description")))
    path = str(tmp_path / "csv")
    write_csv(rows, path, encoded=encoded)
    back = {r["ticket_id"]: r for r in read_tickets(spark, path, multi_line=not encoded, encoded=encoded).collect()}
    assert len(back) == 16
    assert back["INC-2026-04001"]["description"] == text
    assert back["INC-2026-04000"]["asset"] == "MV Kvitøy"
    assert back["INC-2026-04002"]["resolution"] == "" and back["INC-2026-04003"]["resolution"] == ""
    assert back["INC-2026-04003"]["resolved_hours"] is None
    assert back["INC-2026-04001"]["resolved_hours"] == 10.0


def test_minutes_without_zone_and_nan_hours(spark, tmp_path):
    path = str(tmp_path / "one.csv")
    with open(path, "w", encoding="utf-8") as out:
        out.write(",".join(TICKET_COLUMNS) + "\n")
        out.write("INC-2026-00001,2026-01-06T06:15,D,a,c,ERR-1,Low,Closed,t,,words,,NaN\n")
    row = to_ticket(read_raw(spark, path)).first()
    assert row["opened_at"].isoformat() == "2026-01-06T06:15:00"
    assert row["resolved_hours"] is None and row["title"] == "" and row["search_text"] == "words ERR-1"


def test_store_is_kept_unless_recreated_and_prunes_domains(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = tickets(spark).drop("search_text")
    store(rows, path)
    store(rows.limit(1), path)
    assert read_store(spark, path).count() == 16
    plan = read_store(spark, path).filter("domain = 'Energy'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(domain" in plan
    store(rows.limit(1), path, recreate=True)
    assert read_store(spark, path).count() == 1


def test_upserts(spark):
    target = spark.createDataFrame([("a", "old", None, [1.0]), ("b", "keep", "x", [2.0])],
                                   "ticket_id string, title string, note string, embedding array<float>")
    batch = spark.createDataFrame([("a", "new", "given", [9.0]), ("c", "added", "y", [3.0])], target.schema)
    replaced = {r[0]: tuple(r[1:]) for r in merge.upsert_replace(target, batch).collect()}
    assert replaced == {"a": ("new", "given", [9.0]), "b": ("keep", "x", [2.0]), "c": ("added", "y", [3.0])}
    updated = {r[0]: tuple(r[1:]) for r in merge.upsert_embedding(target, batch).collect()}
    assert updated == {"a": ("old", None, [9.0]), "b": ("keep", "x", [2.0]), "c": ("added", "y", [3.0])}


def test_publish_points_the_table_at_the_new_version(spark, tmp_path):
    target = spark.createDataFrame([("a", [1.0])], "ticket_id string, embedding array<float>")
    merge.publish(target, "published", str(tmp_path / "v1"))
    try:
        current = spark.table("published")
        added = spark.createDataFrame([("b", [2.0])], target.schema)
        merge.publish(merge.upsert_replace(current, added), "published", str(tmp_path / "v2"))
        assert {r[0] for r in spark.table("published").collect()} == {"a", "b"}
    finally:
        spark.sql("DROP TABLE IF EXISTS published")


def test_vector_text(spark, tmp_path):
    rows = spark.createDataFrame([("a", [0.12345678, -1.0, 0.0])], "ticket_id string, embedding array<float>")
    assert rows.select(to_text("embedding")).first()[0] == "[0.1234568,-1.0000000,0.0000000]"
    merge.export_vectors(rows, str(tmp_path / "text"))
    back = merge.import_vectors(spark, str(tmp_path / "text")).first()["embedding"]
    assert [round(x, 6) for x in back] == [0.123457, -1.0, 0.0]
    assert rows.select(F.size(from_text(to_text("embedding")))).first()[0] == 3


def test_schema_expectation(spark):
    checked = {r["name"]: r for r in schema(tickets(spark).drop("team"), TICKET_SCHEMA).collect()}
    assert len(checked) == len(TICKET_COLUMNS)
    assert not checked["team"]["passed"] and checked["team"]["actual"] is None
    assert all(r["passed"] for name, r in checked.items() if name != "team")

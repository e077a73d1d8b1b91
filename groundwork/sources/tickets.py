"""Reading, typing and storing tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions.numbers import parse_hours
from groundwork.functions.text import search_text
from groundwork.schema import RAW_SCHEMA, TICKET_COLUMNS


# A field on one line: a line end or backslash becomes a backslash and a letter. Decoded in this order,
# the backslash last, as every other one in an encoded field is followed by n or r.
_ON_ONE_LINE = (("\n", "\\n"), ("\r", "\\r"), ("\\", "\\s"))


def _replaced(column: str, pairs: list[tuple[str, str]]) -> Column:
    out = F.col(column)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def read_raw(spark: SparkSession, path: str, multi_line: bool = False, encoded: bool = False) -> DataFrame:
    """A ticket CSV as text columns.

    By default a record is one line, so a large file is read by many tasks. `encoded` decodes line ends
    as `write_csv` writes them. `multi_line` allows quoted line ends; then each file is one task's work.
    """
    raw = spark.read.schema(RAW_SCHEMA).csv(path, header=True, multiLine=multi_line, quote='"', escape='"')
    if not encoded:
        return raw
    decode = [(new, old) for old, new in _ON_ONE_LINE]
    return raw.select(*[_replaced(c, decode).alias(c) for c in raw.columns])


def to_ticket(raw: DataFrame) -> DataFrame:
    """Typed tickets with `search_text`: absent text is '', absent or NaN hours are null."""
    texts = [c for c in TICKET_COLUMNS if c not in ("opened_at", "resolved_hours")]
    typed = {c: F.coalesce(F.col(c), F.lit("")) for c in texts}
    typed["opened_at"] = F.col("opened_at").cast("timestamp_ntz")
    typed["resolved_hours"] = parse_hours(F.col("resolved_hours"))
    return raw.select(*[typed[c].alias(c) for c in TICKET_COLUMNS]).withColumn("search_text", search_text())


def read_tickets(spark: SparkSession, path: str, multi_line: bool = False, encoded: bool = False) -> DataFrame:
    return to_ticket(read_raw(spark, path, multi_line, encoded)).select(*TICKET_COLUMNS)


def write_csv(tickets: DataFrame, path: str, mode: str = "errorifexists", encoded: bool = True) -> None:
    """Tickets as CSV with a header, each on one line (`encoded`) or with line ends as they are."""
    encode = [_ON_ONE_LINE[2], *_ON_ONE_LINE[:2]] if encoded else []
    texts = {name for name, kind in tickets.dtypes if kind == "string"}
    rows = tickets.select(*[_replaced(c, encode if c in texts else []).alias(c) for c in TICKET_COLUMNS])
    rows.write.mode(mode).csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def store(tickets: DataFrame, path: str, recreate: bool = False) -> None:
    """Parquet by domain, sorted by severity inside each file so row groups can be skipped.

    Without `recreate` an existing table is left as it is. A domain is spread over the tasks
    that hold its rows, so a domain with a third of all tickets is not one task's work.
    """
    (
        tickets.sortWithinPartitions("domain", "severity")
        .write.mode("overwrite" if recreate else "ignore")
        .partitionBy("domain")
        .parquet(path)
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def clean_values(tickets: DataFrame) -> DataFrame:
    """Values as they leave the store: times as ISO text, numbers as doubles."""
    return tickets.withColumns({
        "opened_at": F.date_format("opened_at", "yyyy-MM-dd'T'HH:mm:ss"),
        "resolved_hours": F.col("resolved_hours").cast("double"),
    })

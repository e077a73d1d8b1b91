"""The ticket record: column order, types and the constants that go with it."""

from __future__ import annotations

from pyspark.sql import types as T

# Column order of a ticket, severity order, search defaults.
TICKET_COLUMNS = [
    "ticket_id",
    "opened_at",
    "domain",
    "asset",
    "component",
    "error_code",
    "severity",
    "status",
    "team",
    "title",
    "description",
    "resolution",
    "resolved_hours",
]
SEVERITY_ORDER = ["Critical", "High", "Medium", "Low"]
URGENT = ["Critical", "High"]
TOP_K = 5
AGGREGATE_POOL = 50
ANSWER_POOL = 8
FUSION_DEPTH = 50
FUSION_CONSTANT = 60
GRAPH_SEEDS = 3
SIMILAR_MAX_DISTANCE = 0.40
SIMILAR_PER_TICKET = 2
CITATION_PATTERN = r"INC-\d{4}-\d{4,5}"

_TYPES = {"opened_at": T.TimestampNTZType(), "resolved_hours": T.DoubleType()}

TICKET_SCHEMA = T.StructType(
    [T.StructField(name, _TYPES.get(name, T.StringType())) for name in TICKET_COLUMNS]
)

# A CSV holds text only; typing happens in `to_ticket`.
RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in TICKET_COLUMNS])

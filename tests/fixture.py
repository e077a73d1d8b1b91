"""Sixteen hand-made tickets with four-dimensional vectors, for the cases that decide semantics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from groundwork.functions.text import search_text
from groundwork.schema import TICKET_COLUMNS

# id, domain, asset, code, severity, team, title, description, resolution, hours, vector
ROWS = [
    # two tickets at equal distance from everything
    ("04001", "Maritime", "MV Kvitøy", "ERR-5012", "High", "Deck", "Pump shudder", "bearing knocking at high load", "Replaced the bearing", 10.0, [1.0, 0.0, 0.0, 0.0]),
    ("04000", "Maritime", "MV Kvitøy", "ERR-5012", "Critical", "Deck", "Pump noise", "trembling pump", "Aligned the shaft", 4.0, [1.0, 0.0, 0.0, 0.0]),
    # an unknown severity, and text that is null or blank
    ("04002", "Maritime", "MV Skarv", "ERR-5012", "Odd", "Deck", "", "vibration near the pump", None, None, [0.9, 0.1, 0.0, 0.0]),
    ("04003", "Maritime", "MV Skarv", "ERR-5012", "Low", "Engine", "Vibrations", "", "", None, [0.8, 0.2, 0.0, 0.0]),
    # two tickets of one code near the first ones: both walk to Substation Ålgård
    ("04004", "Energy", "Substation Ålgård", "ERR-3001", "High", "Grid", "Transformer hot", "humming and shudder on the bus", "Cooled it", 8.0, [0.95, 0.3, 0.0, 0.0]),
    ("04005", "Energy", "Substation Ålgård", "ERR-3001", "Low", "Grid", "Transformer warm", "bearing of the fan", "Cleaned the fan", 2.0, [0.0, 1.0, 0.0, 0.0]),
    # a team with open tickets only
    ("04006", "Energy", "Substation Nord", "ERR-3001", "Low", "Field", "Bus noise", "noise on the bus", "", None, [0.1, 0.9, 0.0, 0.0]),
    ("04007", "Energy", "Substation Nord", "ERR-3002", "Medium", "Field", "Meter silent", "no readings", "", None, [0.0, 0.8, 0.2, 0.0]),
    ("04008", "Payments", "Gateway A", "ERR-6250", "Critical", "Cards", "Cards declined", "customers cannot pay", "Restarted", 1.5, [0.0, 0.0, 1.0, 0.0]),
    ("04009", "Payments", "Gateway A", "ERR-6250", "High", "Cards", "Card declines", "pay pay pay cannot", "Restarted", 2.5, [0.0, 0.0, 0.9, 0.1]),
    ("04010", "Payments", "Shared", "ERR-6251", "Low", "Cards", "Slow", "slow gateway", "Tuned", 3.0, [0.0, 0.0, 0.7, 0.7]),
    # an asset name that two domains share
    ("04011", "Retail", "Shared", "ERR-7001", "High", "Tills", "Till frozen", "terminal freezes", "Rebooted", 5.0, [0.0, 0.0, 0.1, 1.0]),
    ("04012", "Retail", "Till 9", "ERR-7001", "High", "Tills", "Printer stops", "printer stops mid sale", "New printer", 6.0, [0.0, 0.0, 0.0, 1.0]),
    ("04013", "Retail", "Till 9", "ERR-7001", "Low", "Tills", "Printer jam", "paper jam", "", None, [0.0, 0.1, 0.0, 1.0]),
    ("04014", "Retail", "Till 8", "ERR-7002", "Low", "Tills", "Quiet", "nothing heard", "Checked", 7.0, [0.5, 0.5, 0.5, 0.5]),
    # no direction: cannot be found by meaning
    ("04015", "Retail", "Till 8", "ERR-7002", "Low", "Tills", "Empty", "zero", "Checked", 7.5, [0.0, 0.0, 0.0, 0.0]),
]


def frame() -> pd.DataFrame:
    rows = []
    for number, domain, asset, code, severity, team, title, description, resolution, hours, vector in ROWS:
        rows.append({
            "ticket_id": f"INC-2026-{number}", "opened_at": pd.Timestamp("2026-01-06 06:15"), "domain": domain, "asset": asset,
            "component": f"of {code}", "error_code": code, "severity": severity,
            "status": "Resolved" if resolution else "In Progress", "team": team, "title": title,
            "description": description, "resolution": resolution, "resolved_hours": hours, "embedding": vector})
    return pd.DataFrame(rows)


def tickets(spark: SparkSession) -> DataFrame:
    schema = ", ".join(f"{c} {'double' if c == 'resolved_hours' else 'timestamp_ntz' if c == 'opened_at' else 'string'}"
                       for c in TICKET_COLUMNS) + ", embedding array<float>"
    rows = [tuple(None if v is None or (isinstance(v, float) and pd.isna(v)) else v for v in r)
            for r in frame()[[*TICKET_COLUMNS, "embedding"]].itertuples(index=False)]
    rows = [tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in rows]
    return spark.createDataFrame(rows, schema).withColumn("search_text", search_text())


def questions(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), "question_id string, question string, q_vector array<float>")

"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


ENGINES = ("ai-slop", "code-quality", "security", "reachability", "redundancy")
SEVERITIES = ("error", "warning", "info")


def event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings made of events: the user is the file, the event type the rule, the id gives engine, severity and line."""
    e = table(spark, sf_dir, "events")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file_path"), pick(ENGINES, 5).alias("engine"), F.concat(F.lit("app/"), F.col("event_type")).alias("rule"),
        pick(SEVERITIES, 3).alias("severity"), (F.col("event_id") % 97 + 1).cast("int").alias("line"), (F.col("event_id") % 7 == 0).alias("style"), F.col("event_id").alias("ordinal"), "value",
    )


EVENT_FINDINGS_SQL = """
f AS (SELECT 'u' || user_id AS file_path, ['ai-slop','code-quality','security','reachability','redundancy'][event_id % 5 + 1] AS engine,
      'app/' || event_type AS rule, ['error','warning','info'][event_id % 3 + 1] AS severity, (event_id % 97 + 1)::INT AS line,
      event_id % 7 = 0 AS style, event_id AS ordinal, value FROM events)
"""

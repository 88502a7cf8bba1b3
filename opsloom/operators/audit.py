"""Append-only audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.operators.ordering import top_rows

AUDIT_SCHEMA = ("event_type string, user_name string, entity_type string, entity_id string, details string, "
                "created_at timestamp")
# Counters and the event types they add up.
COUNTERS = {
    "actions_proposed": ("action_proposed",),
    "actions_approved": ("action_approved",),
    "actions_rejected": ("action_rejected",),
    "actions_executed": ("action_executed",),
    "workflows_executed": ("workflow_run", "morning_review_run"),
    "reports_generated": ("report_generated",),
}


def append_events(events: DataFrame, path: str) -> None:
    """Append; the event date is the partition, so lists by date read few files."""
    events.withColumn("event_date", F.to_date("created_at")).write.mode("append").partitionBy("event_date").parquet(path)


def query_event(spark: SparkSession, result, row_count: int, user_name: str, created_at) -> DataFrame:
    """Audit row of a guarded query (:class:`opsloom.operators.safe_sql.QueryResult`)."""
    import json

    details = json.dumps({"sql": result.sql, "rows": row_count, "duration_ms": result.duration_ms,
                          "success": result.success, "error": result.error})
    return spark.createDataFrame([("sql_query", user_name, "query", None, details, created_at)], AUDIT_SCHEMA)


def list_events(events: DataFrame, event_type: str | None = None, entity_type: str | None = None,
                user_name: str | None = None, limit: int | None = None) -> DataFrame:
    """Filtered events; with ``limit`` the newest ones."""
    if event_type:
        events = events.filter(F.col("event_type") == event_type)
    if entity_type:
        events = events.filter(F.col("entity_type") == entity_type)
    if user_name:
        events = events.filter(F.col("user_name").ilike(f"%{user_name}%"))
    return top_rows(events, limit, F.desc("created_at"), "event_type", "entity_id")


def event_breakdown(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


def audit_stats(events: DataFrame) -> DataFrame:
    """Total and named counters, one row."""
    def counter(types: tuple[str, ...]) -> Column:
        return F.count(F.when(F.col("event_type").isin(*types), 1))

    return events.agg(F.count(F.lit(1)).alias("total_audit_events"),
                      *[counter(types).alias(name) for name, types in COUNTERS.items()])

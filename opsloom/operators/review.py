"""Morning review and report: the one-row and section summaries over all other operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.functions.columns import money_sum, stable_round

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
KPI_STATUSES = ("GOOD", "WARNING", "CRITICAL")


def _count(column: str, value: str) -> Column:
    return F.count(F.when(F.col(column) == value, 1))


def exception_summary(exceptions: DataFrame) -> DataFrame:
    """Open exceptions by severity and their total impact, one row."""
    return exceptions.filter(F.col("status") == "OPEN").agg(
        F.count(F.lit(1)).alias("total_open"), *[_count("severity", s).alias(f"open_{s.lower()}") for s in SEVERITIES],
        stable_round(F.coalesce(money_sum("financial_impact"), F.lit(0.0)), 2).alias("total_financial_impact"))


def kpi_summary(board: DataFrame) -> DataFrame:
    return board.agg(F.count(F.lit(1)).alias("total_kpis"),
                     *[_count("status", s).alias(f"kpi_{s.lower()}") for s in KPI_STATUSES])


def morning_review(scores: DataFrame, board: DataFrame, exceptions: DataFrame, sla: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row: mean data health, KPI statuses, open exceptions, SLA summary, anomaly count.

    Each part is already one row and comes in as a scalar.
    """
    health = scores.agg(F.coalesce(stable_round(F.avg("overall_score"), 1), F.lit(100.0)).alias("data_health_score"))

    def one_row(df: DataFrame) -> Column:
        return df.select(F.struct(*df.columns).alias("r")).scalar()

    parts = {"_kpi": kpi_summary(board), "_exc": exception_summary(exceptions), "_sla": sla,
             "_ano": anomalies.agg(F.count(F.lit(1)).alias("anomalies_detected"))}
    combined = health.withColumns({name: one_row(df) for name, df in parts.items()})
    fields = [F.col(f"{name}.{c}") for name, df in parts.items() for c in df.columns]
    return combined.select("data_health_score", *fields)


def report_sections(spark: SparkSession, period: str, generated_at: str, board: DataFrame | None = None,
                    exceptions: DataFrame | None = None, actions: DataFrame | None = None,
                    sla: DataFrame | None = None) -> dict[str, DataFrame]:
    """The report's sections; a part that is not given is left out.

    Write them with :func:`opsloom.sources.files.write_report`.
    """
    sections = {"metadata": spark.createDataFrame([(period, generated_at)], "period string, generated_at string")}
    if board is not None:
        sections["kpis"] = board
    if exceptions is not None:
        sections["exceptions"] = exceptions.filter(F.col("status") == "OPEN").select(
            "exception_id", "title", "severity", "entity_type", "financial_impact", "priority_score", "status")
    if actions is not None:
        sections["actions"] = actions.select("action_id", "title", "priority", "owner", "status", "action_type")
    if sla is not None:
        sections["sla"] = sla
    return sections


def executive_summary(scores: DataFrame, exceptions: DataFrame, actions: DataFrame, sla: DataFrame) -> DataFrame:
    """Six (position, label, value) rows."""
    def row(position: int, label: str, df: DataFrame, value: Column) -> DataFrame:
        return df.select(F.lit(position).alias("position"), F.lit(label).alias("label"), value.cast("string").alias("value"))

    health = scores.agg(F.coalesce(stable_round(F.avg("overall_score"), 1), F.lit(100.0)).alias("v"))
    open_exceptions = exceptions.filter(F.col("status") == "OPEN").agg(F.count(F.lit(1)).alias("v"))
    open_actions = actions.filter(F.col("status") != "COMPLETED").agg(F.count(F.lit(1)).alias("v"))
    return reduce(DataFrame.unionByName, [
        row(1, "Overall Data Health Score", health, F.concat(F.col("v").cast("string"), F.lit("%"))),
        row(2, "Active Open Exceptions", open_exceptions, F.col("v")),
        row(3, "Open Action Items", open_actions, F.col("v")),
        row(4, "SLA Breached Entities", sla, F.col("breached_count")),
        row(5, "SLA At-Risk Entities", sla, F.col("at_risk_count")),
        row(6, "Total SLA Exposure", sla, F.concat(F.lit("$"), F.format_number("financial_exposure", 2))),
    ])

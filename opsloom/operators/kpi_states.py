"""Daily partial states of metrics, stored beside a table, and the KPI board over them instead of over the facts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.operators.kpi import Metric, default_kpis, kpi_board
from opsloom.operators.safe_sql import validate_formula
from opsloom.session import cut_lineage, file_system

MERGES = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class State:
    """A part of a metric that merges: ``formula`` over the rows of a day, and how days and batches go together."""

    name: str
    formula: str
    merge: str = "sum"


class StateTable:
    """States of one fact table under ``folder``, by day of ``time_column`` and batch.

    A batch of new rows adds its own states for the days that it touches; a repeated batch replaces itself. Facts are read
    once, when they arrive. :meth:`compact` puts the batches of each day together.
    """

    def __init__(self, spark: SparkSession, folder: str, time_column: str, states: Sequence[State]):
        if unknown := {s.merge for s in states} - set(MERGES):
            raise ValueError(f"states merge by sum, min or max, not {sorted(unknown)}")
        self.spark, self.folder, self.time_column, self.states = spark, folder, time_column, list(states)

    def add(self, rows: DataFrame, batch: int) -> None:
        """States of newly arrived rows; rows without a time count on no day and are left out."""
        parts = [F.expr(validate_formula(self.spark, s.formula)).alias(s.name) for s in self.states]
        found = rows.filter(F.col(self.time_column).isNotNull()).groupBy(F.to_date(self.time_column).alias("day")).agg(*parts)
        self._write(found, batch)

    def _write(self, found: DataFrame, batch: int) -> None:
        target, files = file_system(self.spark, f"{self.folder}/batch={batch}")
        if files.exists(target):
            files.delete(target, True)
        found.write.parquet(f"{self.folder}/batch={batch}")

    def read(self) -> DataFrame:
        """One row a day."""
        stored = self.spark.read.parquet(self.folder)
        return stored.groupBy("day").agg(*[MERGES[s.merge](s.name).alias(s.name) for s in self.states])

    def compact(self, last_batch: int) -> None:
        """Put all batches up to ``last_batch`` into it; they must not be repeated afterwards."""
        stored = self.spark.read.parquet(self.folder).filter(F.col("batch") <= last_batch)
        merged = cut_lineage(stored.groupBy("day").agg(*[MERGES[s.merge](s.name).alias(s.name) for s in self.states]))
        folder, files = file_system(self.spark, self.folder)
        old = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("batch=") and int(f.getPath().getName()[6:]) < last_batch]
        self._write(merged, last_batch)
        for path in old:
            files.delete(path, True)


def default_states(as_of: str) -> dict[str, tuple[str, list[State], list[Metric]]]:
    """table -> (time column, states, metrics over the states) for the standard metrics that have a time."""
    now = f"TIMESTAMP_NTZ '{as_of}'"
    known = {m.code: m for m in default_kpis(as_of)}
    over = lambda code, formula: replace(known[code], formula=formula, time_column="day")
    share = "SUM({0}) / SUM({1}) * 100"
    return {
        "orders": ("order_date", [State("revenue", "SUM(total_amount)"), State("orders", "COUNT(*)")],
                   [over("REV", "SUM(revenue)"), over("ORD_VOL", "SUM(orders)")]),
        "shipments": ("ship_date", [State("late", "SUM(CASE WHEN actual_delivery > estimated_delivery THEN 1.0D ELSE 0.0D END)"), State("shipped", "COUNT(*)")],
                      [over("LATE_RATE", share.format("late", "shipped"))]),
        "invoices": ("due_date", [State("overdue", f"SUM(CASE WHEN due_date < {now} AND lower(status) != 'paid' THEN unpaid_amount ELSE 0.0D END)")],
                     [over("OVERDUE_INV", "SUM(overdue)")]),
        "support_tickets": ("created_at", [State("breached", f"SUM(CASE WHEN lower(status) != 'resolved' AND sla_deadline < {now} THEN 1.0D ELSE 0.0D END)"),
                                           State("tickets", "COUNT(*)")], [over("SLA_BREACH", share.format("breached", "tickets"))])}


def board_from_states(tables: dict[str, StateTable], metrics: Sequence[Metric]) -> DataFrame:
    """The KPI board with days as time points; ``metrics`` have formulas over the states and ``day`` as their time. No fact is
    read."""
    return kpi_board({name: table.read() for name, table in tables.items()}, list(metrics))

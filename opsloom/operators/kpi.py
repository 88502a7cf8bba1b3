"""Metrics given as SQL aggregate expressions: value, trend, sparkline and status."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.functions.columns import as_of_literal
from opsloom.operators.ordering import with_position
from opsloom.operators.safe_sql import validate_formula

SPARKLINE_POINTS = 8


@dataclass(frozen=True)
class Metric:
    """``formula`` is an aggregate expression over ``source_table``.

    Write ratios with double literals (``1.0D``): an average of decimal literals
    is kept to five digits by Spark.
    """

    code: str
    name: str
    source_table: str
    formula: str
    time_column: str | None = None
    aggregation: str = "sum"
    target_value: float | None = None
    warning_threshold: float | None = None
    critical_threshold: float | None = None
    comparison_direction: str = "higher_is_better"
    owner: str | None = None
    grain: str | None = None


def default_kpis(as_of: str) -> list[Metric]:
    """Six standard metrics over the operations tables, judged at ``as_of``."""
    now = f"TIMESTAMP_NTZ '{as_of}'"
    # Targets and thresholds of the standard metrics.
    return [
        Metric("REV", "Total Revenue", "orders", "SUM(total_amount)", "order_date", "sum",
               150000.0, 50000.0, 20000.0, "higher_is_better", "Finance Operations"),
        Metric("ORD_VOL", "Total Orders", "orders", "COUNT(*)", "order_date", "count",
               500.0, 200.0, 100.0, "higher_is_better", "Fulfillment Operations"),
        Metric("LATE_RATE", "Late Delivery Rate", "shipments",
               "AVG(CASE WHEN actual_delivery > estimated_delivery THEN 1.0D ELSE 0.0D END) * 100", "ship_date", "rate",
               2.0, 6.0, 12.0, "lower_is_better", "Logistics Operations"),
        Metric("OVERDUE_INV", "Overdue Invoices", "invoices",
               f"SUM(CASE WHEN due_date < {now} AND lower(status) != 'paid' THEN unpaid_amount ELSE 0.0D END)",
               "due_date", "sum", 5000.0, 25000.0, 50000.0, "lower_is_better", "Accounts Receivable"),
        Metric("SLA_BREACH", "SLA Breach Rate", "support_tickets",
               f"AVG(CASE WHEN lower(status) != 'resolved' AND sla_deadline < {now} THEN 1.0D ELSE 0.0D END) * 100",
               "created_at", "rate", 1.0, 5.0, 10.0, "lower_is_better", "Customer Support"),
        Metric("LOW_STOCK", "Low Stock Inventory", "inventory",
               "COUNT(CASE WHEN quantity_on_hand <= reorder_level THEN 1 END)", None, "count",
               0.0, 4.0, 10.0, "lower_is_better", "Supply Chain"),
    ]


def _checked(spark: SparkSession, metric: Metric) -> Column:
    return F.expr(validate_formula(spark, metric.formula)).cast("double")


def _time(metric: Metric) -> Column:
    if metric.grain is None:
        return F.col(metric.time_column)
    return F.date_trunc(metric.grain, F.col(metric.time_column))


def metric_value(df: DataFrame, metric: Metric) -> DataFrame:
    """The formula over the whole table, null as 0, two digits."""
    value = _checked(df.sparkSession, metric)
    return df.agg(F.round(F.coalesce(value, F.lit(0.0)), 2).alias("value"))


def metric_series(df: DataFrame, metric: Metric) -> DataFrame:
    """The formula per time point, in time order."""
    value = _checked(df.sparkSession, metric)
    return (
        df.filter(F.col(metric.time_column).isNotNull()).groupBy(_time(metric).alias("period"))
        .agg(value.alias("value")).orderBy("period")
    )


def status_of(metric: Metric, value: Column) -> Column:
    """GOOD, WARNING or CRITICAL; a value on a threshold is still the better class."""
    def beyond(threshold: float | None) -> Column:
        if threshold is None:
            return F.lit(False)
        return value < threshold if metric.comparison_direction == "higher_is_better" else value > threshold
    return F.when(beyond(metric.critical_threshold), "CRITICAL").when(beyond(metric.warning_threshold), "WARNING") \
        .otherwise("GOOD")


def _flat_sparkline(current: Column) -> Column:
    return F.array(*[
        F.struct(F.lit(f"P{i + 1}").alias("label"), F.round(current * (0.95 + 0.02 * i), 2).alias("value"))
        for i in range(5)])


def _trends(axes: list[tuple[DataFrame, list[Metric]]]) -> DataFrame:
    """_axis, _code, points, previous and spark of every metric; the metrics of an axis share a time column and its grain.

    Every axis is one aggregation. The points of all axes are then sorted together: time points can be as many as rows
    (microsecond stamps), so positions come from one range-partitioned sort.
    """
    points = []
    for i, (df, metrics) in enumerate(axes):
        values = F.array(*[_checked(df.sparkSession, m).alias(m.code) for m in metrics])
        points.append(df.filter(F.col(metrics[0].time_column).isNotNull()).groupBy(_time(metrics[0]).alias("_t")).agg(values.alias("_values"))
                      .withColumn("_axis", F.lit(i)))
    by_type: dict[str, list[DataFrame]] = defaultdict(list)
    for one in points:
        by_type[one.schema["_t"].dataType.simpleString()].append(one)
    placed = reduce(DataFrame.unionByName, [
        with_position(reduce(DataFrame.unionByName, same), ["_axis", "_t"], "_pos").withColumn("_t", F.col("_t").cast("string")) for same in by_type.values()])
    # one row per axis
    spans = F.broadcast(placed.groupBy("_axis").agg(F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("points")))
    codes = [F.array(*map(F.lit, [m.code for m in metrics])) for _, metrics in axes]
    code = reduce(lambda found, i: F.when(F.col("_axis") == i, codes[i]).otherwise(found), range(len(codes)), F.lit(None))
    cells = placed.join(spans, "_axis").withColumn("_pos", F.col("_pos") - F.col("_start")).select(
        "_axis", "_pos", "_t", "points", F.inline(F.arrays_zip(code.alias("_code"), F.col("_values").alias("_value"))).alias("_code", "_value"))
    half = F.when(F.col("_pos") < F.floor(F.col("points") / 2), F.col("_value"))
    step = F.greatest(F.lit(1), F.floor(F.col("points") / SPARKLINE_POINTS))
    # at most 15 points are kept, whatever the length of the series
    spark = F.sort_array(F.collect_list(F.when(F.col("_pos") % step == 0, F.struct(
        "_pos", F.substring("_t", 1, 10).alias("label"), F.coalesce(F.round("_value", 2), F.lit(0.0)).alias("value")))))
    return cells.groupBy("_axis", "_code", "points").agg(F.sum(half).alias("_sum"), F.avg(half).alias("_avg"), spark.alias("spark"))


def kpi_board(tables: dict[str, DataFrame], metrics: list[Metric]) -> DataFrame:
    """All metrics, one row each.

    Each source table is aggregated once for the current values of all its metrics and once for each of its time axes; the
    trends of all axes go through one sort.
    """
    by_table: dict[str, list[Metric]] = defaultdict(list)
    for metric in metrics:
        if metric.source_table not in tables:
            raise ValueError(f"table {metric.source_table!r} not found")
        by_table[metric.source_table].append(metric)
    parts, axes = [], []
    for table, group in by_table.items():
        df = tables[table]
        wide = df.agg(*[F.round(F.coalesce(_checked(df.sparkSession, m), F.lit(0.0)), 2).alias(m.code) for m in group])
        axis_of: dict[tuple, int] = {}
        for m in group:
            if m.time_column is not None:
                key = (m.time_column, m.grain)
                if key not in axis_of:
                    axis_of[key] = len(axes)
                    axes.append((df, []))
                axes[axis_of[key]][1].append(m)
        parts.append(wide.select(F.inline(F.array(*[_board_row(m, axis_of.get((m.time_column, m.grain))) for m in group]))))
    board = reduce(DataFrame.unionByName, parts)
    if axes:
        # one row per metric
        trends = F.broadcast(_trends(axes))
        board = board.join(trends, (F.col("_axis") == F.col("_of")) & (F.col("_code") == F.col("code")), "left")
    else:
        board = board.withColumns({"points": F.lit(0), "_sum": F.lit(0.0), "_avg": F.lit(0.0), "spark": F.lit(None).cast(
            "array<struct<_pos:bigint,label:string,value:double>>")})
    # a metric without a time axis is its own previous value; one with a single point has 0
    enough = F.coalesce(F.col("points") > 1, F.lit(False))
    now = F.col("current_value")
    half = F.when(F.col("_summed"), F.col("_sum")).otherwise(F.col("_avg"))
    previous = F.when(F.col("_of").isNull(), now).when(enough, F.coalesce(F.round(half, 2), F.lit(0.0))).otherwise(0.0)
    board = board.withColumns({"previous_value": previous, "_shown": F.when(F.col("_of").isNotNull() & enough, F.col("spark"))})
    before = F.col("previous_value")
    return board.select(
        "code", "name", "owner", "target_value", "current_value", "previous_value",
        F.round(now - before, 2).alias("abs_change"),
        F.when(before != 0, F.round(F.try_divide(now - before, F.abs(before)) * 100, 2)).otherwise(0.0).alias("pct_change"),
        "status",
        F.coalesce(F.transform("_shown", lambda p: F.struct(p["label"].alias("label"), p["value"].alias("value"))),
                   _flat_sparkline(now)).alias("sparkline"),
    )


def _board_row(m: Metric, axis: int | None) -> Column:
    current = F.col(m.code)
    return F.struct(
        F.lit(m.code).alias("code"), F.lit(m.name).alias("name"), F.lit(m.owner).cast("string").alias("owner"),
        F.lit(m.target_value).cast("double").alias("target_value"), current.alias("current_value"),
        status_of(m, current).alias("status"), F.lit(axis).cast("int").alias("_of"), F.lit("sum" in m.aggregation).alias("_summed"))


def calendar_compare(df: DataFrame, metric: Metric, as_of: str, period: str = "month") -> DataFrame:
    """The formula over the calendar period that holds ``as_of`` and over the one before, with change and status, one row.

    Only the rows of the two periods leave the scan.
    """
    start = F.date_trunc(period, as_of_literal(as_of))
    step = F.expr({"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTH",
                   "year": "INTERVAL 1 YEAR"}[period])
    time = F.col(metric.time_column)
    value = _checked(df.sparkSession, metric)
    by_period = df.filter((time >= start - step) & (time < start + step)).groupBy((time >= start).alias("_now")).agg(value.alias("_v"))
    now = F.round(F.coalesce(F.max(F.when(F.col("_now"), F.col("_v"))), F.lit(0.0)), 2)
    before = F.round(F.coalesce(F.max(F.when(~F.col("_now"), F.col("_v"))), F.lit(0.0)), 2)
    both = by_period.agg(now.alias("current_value"), before.alias("previous_value"))
    change = F.try_divide(F.col("current_value") - F.col("previous_value"), F.abs("previous_value")) * 100
    return both.select(F.lit(metric.code).alias("code"), F.lit(period).alias("period"), "current_value", "previous_value",
                       F.round(F.col("current_value") - F.col("previous_value"), 2).alias("abs_change"), F.round(change, 2).alias("pct_change"),
                       status_of(metric, F.col("current_value")).alias("status"))


def evaluate_metric(df: DataFrame, metric: Metric) -> DataFrame:
    return kpi_board({metric.source_table: df}, [metric])


def snapshot_metrics(board: DataFrame, path: str, period: str, taken_at: str) -> None:
    """Append the board to the snapshot history at ``path``."""
    board.select(
        "code", F.lit(period).alias("period_label"), "current_value", "previous_value", "pct_change", "status",
        "sparkline", F.lit(taken_at).cast("timestamp").alias("created_at"),
    ).write.mode("append").parquet(path)


def test_formula(df: DataFrame, formula: str) -> DataFrame:
    """Dry run of a formula: one row, number or text, errors are raised."""
    checked = F.expr(validate_formula(df.sparkSession, formula))
    return df.select(checked.alias("sample_result")).limit(1)


test_formula.__test__ = False  # not a pytest case

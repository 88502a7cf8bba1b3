"""Group-by, pivot, correlation, rolling and resampled analytics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.columns import as_timestamp, is_numeric
from opsloom.operators.ordering import exact_quantiles, rolling_rows

# Aggregates with a mergeable Spark function. median, first and last are built separately.
AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max,
    "std": F.stddev_samp, "var": F.var_samp, "nunique": F.count_distinct,
}


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    for name in names:
        if name not in df.columns:
            raise ValueError(f"column {name!r} not found")


def _aggregate(name: str, column: str, order_by: Sequence[str] | None) -> Column:
    if name in AGGREGATES:
        return AGGREGATES[name](F.col(column))
    if name in ("first", "last"):
        if not order_by:
            raise ValueError(f"{name!r} needs order_by: rows of a DataFrame have no order")
        present = F.when(F.col(column).isNotNull(), F.struct(*order_by))
        pick = F.min_by if name == "first" else F.max_by
        return pick(F.col(column), present)
    raise ValueError(f"unknown aggregate {name!r}")


def group_by_analysis(df: DataFrame, group_cols: Sequence[str], aggregations: dict[str, Sequence[str]],
                      order_by: Sequence[str] | None = None) -> DataFrame:
    """``{column: [aggregate, ...]}`` per group as ``column_aggregate``, sorted by key.

    Rows with a null key are dropped. ``median`` is exact and is computed by
    distributed ranking, then joined by key.
    """
    require_columns(df, [*group_cols, *aggregations])
    keyed = df.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in group_cols]))
    simple, medians, names = [], [], []
    for column, functions in aggregations.items():
        for function in functions:
            names.append(f"{column}_{function}")
            if function == "median":
                medians.append(column)
            else:
                simple.append(_aggregate(function, column, order_by).alias(f"{column}_{function}"))
    result = keyed.groupBy(*group_cols).agg(*simple) if simple else keyed.select(*group_cols).distinct()
    for column in medians:
        middle = exact_quantiles(keyed, column, {f"{column}_median": 0.5}, group_cols)
        result = result.join(middle, list(group_cols), "left")
    return result.select(*group_cols, *names).orderBy(*group_cols)


def pivot_analysis(df: DataFrame, index_col: str, columns_col: str, values_col: str, agg_func: str = "sum",
                   pivot_values: Sequence | None = None) -> DataFrame:
    """One row per index value, one column per value of ``columns_col``; empty cells are 0.

    Give ``pivot_values`` to save the job that discovers them.
    """
    require_columns(df, [index_col, columns_col, values_col])
    keyed = df.filter(F.col(index_col).isNotNull() & F.col(columns_col).isNotNull())
    grouped = keyed.groupBy(index_col).pivot(columns_col, list(pivot_values) if pivot_values else None)
    pivoted = grouped.agg(_aggregate(agg_func, values_col, None))
    return pivoted.na.fill(0).orderBy(index_col)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 3) -> DataFrame:
    """Pearson matrix, one row per metric; pairs are complete pairwise, undefined cells are 0."""
    wanted = columns or df.columns
    names = [f.name for f in df.schema.fields if f.name in wanted and is_numeric(f.dataType)]
    if len(names) < 2:
        raise ValueError("at least two numeric columns are needed for a correlation")
    cast = df.select(*[F.col(n).cast("double").alias(n) for n in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    # every pair in the same single pass
    values = cast.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])

    def cell(a: str, b: str) -> Column:
        name = f"{a}|{b}" if (a, b) in pairs else f"{b}|{a}"
        value = F.col(f"`{name}`")
        return F.coalesce(F.round(F.when(~F.isnan(value), value), digits), F.lit(0.0)).alias(b)

    rows = F.array(*[F.struct(F.lit(a).alias("metric"), *[cell(a, b) for b in names]) for a in names])
    return values.select(F.inline(rows))


def rolling_average(df: DataFrame, date_col: str, value_col: str, window: int = 7, *,
                    order_by: Sequence[str], partition_cols: Sequence[str] = ()) -> DataFrame:
    """Mean of the current and the previous ``window - 1`` rows in date order.

    ``order_by`` breaks ties between equal dates and must end in a unique column; without one the rows of a day would have
    no order, and the result none that can be repeated.
    """
    if not order_by:
        raise ValueError("order_by must name the columns that order rows of one date")
    require_columns(df, [date_col, value_col, *order_by, *partition_cols])
    types = {f.name: f.dataType for f in df.schema.fields}
    name = f"{value_col}_rolling_avg_{window}"
    dated = (
        df.select(*dict.fromkeys([*partition_cols, date_col, value_col, *order_by]))
        .withColumn("_ts", as_timestamp(date_col, types[date_col])).filter(F.col("_ts").isNotNull())
    )
    rolled = rolling_rows(
        dated, list(partition_cols), ["_ts", *order_by], window - 1,
        lambda w: {name: F.round(F.avg(value_col).over(w.rowsBetween(-(window - 1), 0)), 2)})
    return rolled.select(*partition_cols, *order_by, F.date_format("_ts", "yyyy-MM-dd").alias(date_col), value_col, name)


def subtotals(df: DataFrame, columns: Sequence[str], aggregates: dict[str, Column], sets: str | Sequence[Sequence[str]] = "rollup") -> DataFrame:
    """Aggregates for several groupings of ``columns`` in one pass: a rollup, a cube, or the grouping sets given.

    ``level`` is Spark's grouping id: a bit for each column, the first the highest, set where the row is a total over it. A
    column is null there; ``level`` tells it from a null value. Rows are expanded before the map-side aggregation.
    """
    require_columns(df, columns)
    cols = [F.col(f"`{c}`") for c in columns]
    if sets == "rollup":
        grouped = df.rollup(*cols)
    elif sets == "cube":
        grouped = df.cube(*cols)
    elif isinstance(sets, str):
        raise ValueError(f"sets must be rollup, cube or lists of columns, not {sets!r}")
    else:
        if unknown := {c for one in sets for c in one} - set(columns):
            raise ValueError(f"grouping sets use {sorted(unknown)}, which are not among the columns")
        grouped = df.groupingSets([[F.col(f"`{c}`") for c in one] for one in sets], *cols)
    return grouped.agg(F.grouping_id().cast("int").alias("level"), *[a.alias(n) for n, a in aggregates.items()])


def period_end(ts: Column, frequency: str) -> Column:
    """Last day of the period: the day itself, the week's Sunday, the month's last day."""
    day = F.to_date(ts)
    if frequency == "D":
        return day
    if frequency == "W":
        return F.next_day(F.date_sub(day, 1), "SUN")
    if frequency == "M":
        return F.last_day(day)
    raise ValueError(f"frequency must be D, W or M, not {frequency!r}")


def resample(df: DataFrame, date_col: str, value_col: str, frequency: str = "D", agg_func: str = "sum") -> DataFrame:
    """Aggregate per calendar period, empty periods included, with the change to the previous one.

    Empty periods show 0. The change of a mean-like aggregate is taken against the
    last period that has a value; it is null when that value is 0.
    """
    require_columns(df, [date_col, value_col])
    types = {f.name: f.dataType for f in df.schema.fields}
    ts = as_timestamp(date_col, types[date_col])
    periods = (
        df.select(period_end(ts, frequency).alias("_p"), value_col).filter(F.col("_p").isNotNull())
        .groupBy("_p").agg(_aggregate(agg_func, value_col, None).cast("double").alias("_v"))
    )
    step = {"D": "interval 1 day", "W": "interval 7 days", "M": "interval 1 month"}[frequency]
    # months step from first days, as stepping month ends would drift
    first, last = (F.min("_p"), F.max("_p")) if frequency != "M" else (
        F.trunc(F.min("_p"), "month"), F.trunc(F.max("_p"), "month"))
    span = periods.agg(first.alias("_a"), last.alias("_b")).filter(F.col("_a").isNotNull())
    calendar = span.select(F.explode(F.sequence("_a", "_b", F.expr(step))).alias("_c"))
    calendar = calendar.select((F.last_day("_c") if frequency == "M" else F.col("_c")).alias("_p"))
    empty = F.lit(0.0) if agg_func in ("sum", "count", "nunique") else F.lit(None).cast("double")
    filled = calendar.join(periods, "_p", "left").select(
        "_p", F.round(F.coalesce("_v", empty), 2).alias("_v"))
    # one row per calendar period, so these windows are bounded by the calendar
    order = Window.orderBy("_p")
    carried = filled.withColumn("_c", F.last("_v", ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    previous = F.lag("_c").over(order)
    change = F.try_divide(F.col("_c") - previous, previous)
    return carried.select(
        F.date_format("_p", "yyyy-MM-dd").alias(date_col),
        F.coalesce("_v", F.lit(0.0)).alias(value_col),
        F.when(previous.isNull(), F.lit(0.0)).otherwise(F.round(F.round(change, 4) * 100, 4)).alias("pct_change"),
    ).orderBy(date_col)


def time_series_stats(resampled: DataFrame, date_col: str, value_col: str, frequency: str, agg_func: str) -> DataFrame:
    """Total periods and latest value of a resampled series, one row."""
    return resampled.agg(
        F.count(F.lit(1)).alias("total_periods"),
        F.coalesce(F.max_by(value_col, date_col), F.lit(0.0)).alias("latest_value"),
    ).withColumns({"frequency": F.lit(frequency), "agg_func": F.lit(agg_func)})


def group_stats(grouped: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    return grouped.agg(F.count(F.lit(1)).alias("groups_count")).withColumn("grouped_by", F.lit(", ".join(group_cols)))

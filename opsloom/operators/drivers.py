"""Root-cause attribution: which dimension values carry the volume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.columns import stable_round
from opsloom.operators.analytics import subtotals
from opsloom.operators.ordering import first_per_group, top_rows
from opsloom.operators.profile import few_valued_columns, value_counts
from opsloom.session import cut_lineage

MIN_SEGMENTS, MAX_SEGMENTS = 2, 20
TOP_SEGMENTS = 3

# Columns that never explain anything.
NOT_DIMENSIONS = ("id", "created_at", "updated_at")


def investigation_target(problem: str, tables: Sequence[str]) -> tuple[str, str]:
    """(table, metric column) that a problem description is about."""
    text = problem.lower()
    if "refund" in text or "return" in text:
        return ("invoices", "unpaid_amount") if "invoices" in tables else ("orders", "amount")
    if "delay" in text or "late" in text:
        return "orders", "order_id"
    if "ticket" in text or "sla" in text:
        return ("support_tickets", "ticket_id") if "support_tickets" in tables else ("orders", "order_id")
    return "orders", "amount"


def _dimension_counts(df: DataFrame, metric: str | None) -> DataFrame:
    """(dimension, ordinal, segment, volume) of columns with 2 to 20 distinct values, and the row total."""
    columns = [c for c in df.columns if c != metric and c not in NOT_DIMENSIONS]
    counts = value_counts(df, few_valued_columns(df, columns, MAX_SEGMENTS))
    suitable = counts.groupBy("column_name").agg(F.count("value").alias("_distinct"), F.sum("n").alias("_total")) \
        .filter(F.col("_distinct").between(MIN_SEGMENTS, MAX_SEGMENTS))
    ordinal = F.lit(None).cast("int")
    for i, c in enumerate(columns):
        ordinal = F.when(F.col("column_name") == c, F.lit(i)).otherwise(ordinal)
    return counts.filter(F.col("value").isNotNull()).join(suitable, "column_name").select(
        F.col("column_name").alias("dimension"), ordinal.alias("ordinal"), F.col("value").alias("segment"),
        F.col("n").alias("volume"), "_distinct", "_total")


def candidate_dimensions(df: DataFrame, metric: str | None = None) -> DataFrame:
    return _dimension_counts(df, metric).groupBy("dimension", "ordinal").agg(
        F.first("_distinct").alias("segments"))


def attribute_drivers(df: DataFrame, table_name: str, metric: str | None = None, k: int = TOP_SEGMENTS) -> DataFrame:
    """The ``k`` largest segments of every candidate dimension; ``is_primary`` marks the first dimension."""
    counts = _dimension_counts(df, metric)
    primary = counts.agg(F.min("ordinal").alias("o")).scalar()
    share = stable_round(F.col("volume").cast("double") / F.col("_total") * 100, 1)
    top = first_per_group(counts, ["dimension"], [F.desc("volume"), F.col("segment")], k, "rank")
    return top.withColumn("share_percentage", share).select(
        "dimension", "rank", "segment", "volume", "share_percentage",
        F.concat("segment", F.lit(" has "), F.col("volume").cast("string"), F.lit(f" of the {table_name}, "),
                 F.col("share_percentage").cast("string"), F.lit("%")).alias("explanation"),
        (F.col("ordinal") == primary).alias("is_primary"))


def explained_share(drivers: DataFrame) -> DataFrame:
    return drivers.groupBy("dimension", "is_primary").agg(
        stable_round(F.sum("share_percentage"), 1).alias("explained_share_percentage"))


def attribute_change(df: DataFrame, period: Column, dimensions: Sequence[str], metric: Column, k: int | None = None) -> DataFrame:
    """What each combination of up to three dimensions adds to the change of a metric between two periods.

    ``period`` is "before" or "after" (other rows do not count), ``metric`` an expression that is summed. Columns: the
    dimensions (null: any), level (see :func:`opsloom.operators.analytics.subtotals`), before, after, change,
    share_percentage of the whole change. One pass over a cube; sums are decimals.

    A combination is left out where dropping one of its dimensions gives the same figures: the wider one says it all. ``k``
    keeps the largest changes, ties by the dimensions' texts; by default all are returned.
    """
    if not 1 <= len(dimensions) <= 3:
        raise ValueError("give one to three dimensions")
    amount = lambda name: F.coalesce(F.sum(F.when(F.col("_period") == name, F.col("_metric"))), F.lit(0)).cast("decimal(18,2)")
    named = [F.coalesce(F.col(f"`{d}`").cast("string"), F.lit("(none)")).alias(d) for d in dimensions]
    rows = df.select(*named, period.alias("_period"), metric.cast("decimal(18,2)").alias("_metric")).filter(F.col("_period").isin("before", "after"))
    cube = cut_lineage(subtotals(rows, dimensions, {"before": amount("before"), "after": amount("after")}, "cube"))
    # each combination beside those that have one dimension less
    wider = []
    for i, d in enumerate(dimensions):
        bit = 1 << (len(dimensions) - 1 - i)
        others = [o for o in dimensions if o != d]
        fixed = F.col("level").bitwiseAND(F.lit(bit)) == 0
        wider.append(F.when(fixed, F.struct((F.col("level") + bit).alias("level"), *[F.col(f"`{o}`").alias(o) if o in others else F.lit(None).cast("string").alias(o)
                                                                                    for o in dimensions])))
    key = lambda: F.xxhash64("level", *[F.coalesce(F.col(f"`{d}`"), F.lit("")) for d in dimensions])
    keyed = cube.withColumn("_key", key())
    parents = keyed.select("_key", F.explode(F.array_compact(F.array(*wider))).alias("_w"), "before", "after")
    parent_key = F.xxhash64("_w.level", *[F.coalesce(F.col("_w").getField(d), F.lit("")) for d in dimensions])
    same = parents.withColumn("_parent", parent_key).join(
        keyed.select(F.col("_key").alias("_parent"), F.col("before").alias("_b"), F.col("after").alias("_a")), "_parent").filter("before = _b AND after = _a")
    kept = keyed.join(same.select("_key").distinct(), "_key", "left_anti")
    total = cube.filter(F.col("level") == (1 << len(dimensions)) - 1).agg(F.max(F.col("after") - F.col("before"))).scalar()
    change = (F.col("after") - F.col("before")).cast("decimal(18,2)")
    out = kept.select(*dimensions, "level", F.col("before").cast("double").alias("before"), F.col("after").cast("double").alias("after"),
                      change.cast("double").alias("change"),
                      F.coalesce(stable_round(F.try_divide(change.cast("double"), total.cast("double")) * 100, 1), F.lit(0.0)).alias("share_percentage"))
    return top_rows(out, k, F.desc(F.abs("change")), *dimensions, "level")


def policy_snippet(content: Column, chars: int | None = None) -> Column:
    """The best policy passage; with ``chars`` its beginning, for a display."""
    return content if chars is None else F.concat(F.substring(content, 1, chars), F.lit("..."))

"""Order-dependent work without a single-task window.

A window without a partition key (or with one hot key) sends its whole input to
one task. The functions here range-partition on the full sort key instead, so
the load is even whatever the key distribution, and stay exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from opsloom.session import cut_lineage

# Rows per window task in rolling_rows.
BLOCK_ROWS = 1_000_000
# Rows of a group that meet its one row in one task; larger groups are dealt to parts of about so many rows.
PART_ROWS = 1_000_000


def deal_parts(rows: DataFrame, keys: Sequence[str], part_rows: int = PART_ROWS) -> DataFrame:
    """keys and ``_parts`` of the groups beyond ``part_rows`` rows: at most one row for each ``part_rows`` rows."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_dealt"))
    return sizes.filter(F.col("_dealt") > part_rows).select(*keys, F.ceil(F.col("_dealt") / part_rows).cast("long").alias("_parts"))


def join_groups(rows: DataFrame, per_group: DataFrame, keys: Sequence[str], salt: Column, how: str = "inner",
                part_rows: int = PART_ROWS) -> DataFrame:
    """Join rows with few rows per group. Only the rows of groups beyond ``part_rows`` are dealt to parts, in proportion to
    their number, by ``salt`` (repeatable, varied within a group); only the rows of ``per_group`` that meet them are copied.

    The hot groups are found by a count that is combined before the shuffle, and broadcast: one row for each ``part_rows``
    rows at most.
    """
    hot = F.broadcast(deal_parts(rows, keys, part_rows))
    last = F.coalesce("_parts", F.lit(1).cast("long")) - 1
    parts = per_group.join(hot, list(keys), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("_parts")
    dealt = rows.join(hot, list(keys), "left").withColumn("_salt", F.pmod(salt, last + 1).cast("long")).drop("_parts")
    return dealt.join(parts, [*keys, "_salt"], how).drop("_salt")


def range_sorted(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Globally sorted, with ``_part`` = range partition number, written out.

    The checkpoint pins the partition layout: the per-partition totals and the
    rows they are joined to must come from the same layout.
    """
    laid_out = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = laid_out.withColumn("_mid", F.monotonically_increasing_id())
    return cut_lineage(numbered.withColumn("_part", F.shiftright("_mid", 33)))


def with_position(df: DataFrame, order: Sequence[str | Column], position: str = "_pos") -> DataFrame:
    """Add the 0-based position of every row in the total order ``order``.

    ``order`` must end in a unique column to make the result repeatable. Only the
    per-partition counts are windowed on one task: one row per range partition.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    pinned = range_sorted(df, cols)
    counts = pinned.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # at most one row per range partition, so the broadcast is bounded
    return (
        pinned.join(F.broadcast(offsets), "_part")
        .withColumn(position, F.col("_offset") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid", "_part", "_offset")
    )


def rolling_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    preceding: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Row-frame window columns over ``keys``/``order``, evenly distributed.

    Rows are cut into blocks of ``block_rows`` consecutive positions; each block
    also receives the ``preceding`` rows before it, which is all that a frame of
    that length can reach. ``columns`` gets the ordered window spec and returns
    the columns to add; its frames must look back at most ``preceding`` rows.
    """
    if block_rows <= preceding:
        raise ValueError("block_rows must exceed the frame length")
    indexed = with_position(df, [*keys, *order])
    home = F.floor(F.col("_pos") / F.lit(block_rows)).cast("long")
    spills = F.col("_pos") % F.lit(block_rows) >= F.lit(block_rows - preceding)
    copies = (
        indexed.withColumn("_home", home)
        .withColumn("_block", F.explode(
            F.when(spills, F.array(F.col("_home"), F.col("_home") + 1))
            .otherwise(F.array(F.col("_home")))))
    )
    ordered = Window.partitionBy("_block", *keys).orderBy("_pos")
    windowed = copies.withColumns(columns(ordered))
    return windowed.filter(F.col("_block") == F.col("_home")).drop("_home", "_block", "_pos")


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """1-based row number within each group, whatever the group size.

    A group is contiguous in the total order, so its number is the distance to the
    group's first position, which is a map-side combined minimum.
    """
    indexed = with_position(df, [*keys, *order], "_pos")
    starts = indexed.groupBy(*keys).agg(F.min("_pos").alias("_start"))
    return (
        join_groups(indexed, starts, keys, F.col("_pos")).withColumn(name, F.col("_pos") - F.col("_start") + 1)
        .drop("_pos", "_start")
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    fractions: dict[str, float],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per fraction.

    Equal values are collapsed to (value, count) first, so a value that makes up
    most of the table is one row. The distinct values are range-partitioned and
    ranked by cumulative counts; no group is ever held in one task.
    Groups without any non-null value are absent.
    """
    keys = list(keys)
    counted = (
        df.select(*keys, F.col(value).cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    )
    pinned = range_sorted(counted, [F.col(k) for k in keys] + [F.col("_v")]).drop("_mid")
    per_part = pinned.groupBy(*keys, "_part").agg(F.sum("_n").alias("_in_part"))
    # one row per (group, partition it spans): a hot group has at most #partitions rows
    spans = Window.partitionBy(*keys)
    offsets = per_part.select(
        *keys, "_part",
        F.coalesce(F.sum("_in_part").over(
            spans.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_in_part").over(spans).alias("_total"),
    )
    inside = Window.partitionBy("_part", *keys).orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranked = (
        pinned.withColumn("_cum", F.sum("_n").over(inside))
        .join(offsets, ["_part", *keys])
        .withColumn("_last", F.col("_offset") + F.col("_cum") - 1)
        .withColumn("_first", F.col("_last") - F.col("_n") + 1)
    )

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("_first") <= rank) & (rank <= F.col("_last")), F.col("_v")))

    picks: list[Column] = [F.max("_total").alias("_total")]
    for name, q in fractions.items():
        target = F.lit(q) * (F.col("_total") - 1)
        picks.append(value_at(F.floor(target)).alias(f"_lo_{name}"))
        picks.append(value_at(F.ceil(target)).alias(f"_hi_{name}"))
    bounds = ranked.groupBy(*keys).agg(*picks)
    out: list[Column] = [F.col(k) for k in keys]
    for name, q in fractions.items():
        target = F.lit(q) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (target - F.floor(target))).alias(name))
    return bounds.select(*out)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                    rank: str = "_rank") -> DataFrame:
    """The first ``k`` rows of each group, with their rank.

    Spark limits each map task to ``k`` rows per group before the shuffle
    (WindowGroupLimit), so a hot group does not reach one task whole.
    """
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)


def top_rows(df: DataFrame, k: int | None, *order) -> DataFrame:
    """The first ``k`` rows in an order with unique ties; all rows, in no order, for None."""
    return df if k is None else df.orderBy(*order).limit(k)

"""Join shapes the analytics need beyond a plain equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.operators.ordering import PART_ROWS, deal_parts, join_groups, range_sorted
from opsloom.session import cut_lineage


def interval_join(points: DataFrame, intervals: DataFrame, ts: str, start: str, end: str, unit: str = "month") -> DataFrame:
    """Pairs with ``start <= ts < end``, as an equi-join on calendar buckets.

    Each interval is copied to the buckets it covers, so an interval matches a
    point in exactly one bucket and no pair is tested twice. The points of a bucket
    are dealt to several parts, so a crowded month is not one task.
    """
    bucketed_points = points.withColumn("_bucket", F.date_trunc(unit, ts).cast("date"))
    covered = F.sequence(
        F.date_trunc(unit, start).cast("date"), F.date_trunc(unit, end).cast("date"), F.expr(f"interval 1 {unit}"))
    bucketed_intervals = intervals.withColumn("_bucket", F.explode(covered))
    joined = join_groups(bucketed_points, bucketed_intervals, ["_bucket"], _row_hash(points))
    return joined.filter((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).drop("_bucket")


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float | None = None,
               part_rows: int = PART_ROWS, totals: dict[str, Column] | None = None) -> DataFrame:
    """Pairs with ``low <= value < high`` of numeric or timestamp columns, as an equi-join on buckets.

    With ``width`` there is one size of bucket; choose it near the usual length of a range, as a range is copied to each
    bucket that it covers. Without, every range goes to the buckets of its own length's power of two, of which it covers at
    most two or three; a point looks into one bucket of each size that occurs. However mixed the lengths are, a range then
    covers a good part of its buckets, so the pairs tested are few beside the pairs found.

    Buckets with more than ``part_rows`` points or ranges are split on that side, and the other side is copied to the parts,
    so that no task meets a hot bucket whole. Null, NaN and empty ranges, and null and NaN points, match nothing.

    The pairs can be as many as points times ranges. With ``totals`` (name: whole number or decimal of a point) they are not
    made: the result has one row per range that matches, with the sums of these over its points, see :func:`_range_totals`.
    """
    axis = lambda df, c: _axis(F.col(c), df.schema[c].dataType)
    some = lambda c: c.isNotNull() & ~F.isnan(c)
    at, start, end = axis(points, value), axis(ranges, low), axis(ranges, high)
    filled = ranges.filter(some(start) & some(end) & (start < end))
    given = points.filter(some(at))
    if totals is not None:
        return _range_totals(given, filled, value, low, high, totals)
    if width is not None:
        size = F.lit(float(width))
        sized = filled.withColumn("_size", size)
        looked = given.withColumn("_size", size)
    else:
        # an infinite length has one bucket, the whole axis
        length = F.when(end - start < float("inf"), F.pow(F.lit(2.0), F.ceil(F.log2(end - start)))).otherwise(float("inf"))
        sized = cut_lineage(filled.withColumn("_size", length))
        # one row per power of two that occurs among doubles: 2,100 at most
        sizes = sorted(r[0] for r in sized.select("_size").distinct().collect())
        looked = given.withColumn("_size", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<double>")))
    bucket = lambda c: F.when(F.col("_size") < float("inf"), F.floor(c / F.col("_size")).cast("long")).otherwise(F.lit(0).cast("long"))
    copies = sized.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    looked = looked.withColumn("_bucket", bucket(at))
    keys = ["_size", "_bucket"]
    left, right = (F.broadcast(deal_parts(df, keys, part_rows).withColumnRenamed("_parts", name)) for df, name in ((looked, "_p"), (copies, "_r")))
    parts = lambda name: F.coalesce(name, F.lit(1).cast("long"))
    every = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), parts(name) - 1))
    looked = (looked.join(left, keys, "left").join(right, keys, "left")
              .withColumn("_i", F.pmod(_row_hash(points), parts("_p"))).withColumn("_j", every("_r")).drop("_p", "_r"))
    copies = (copies.join(left, keys, "left").join(right, keys, "left")
              .withColumn("_j", F.pmod(_row_hash(ranges), parts("_r"))).withColumn("_i", every("_p")).drop("_p", "_r"))
    joined = looked.join(copies, [*keys, "_i", "_j"])
    return joined.filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop(*keys, "_i", "_j")


def _range_totals(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, totals: dict[str, Column]) -> DataFrame:
    """The columns of ``ranges`` and the sums of ``totals`` over each range's points, for ranges with a point.

    Points and both ends of all ranges are sorted together; a range's sum is the running sum before its end less that before
    its start. The work is that of a sort, however many pairs there are. Equal ranges go together until the end.
    """
    sums = {f"_sum{i}": c for i, c in enumerate(totals.values())}
    weighed = points.select(F.col(value).alias("_at"), F.lit(1).alias("_side"), _row_hash(points).alias("_spread"),
                            F.lit(1).cast("long").alias("_n"), *[c.alias(s) for s, c in sums.items()])
    row = F.struct(*[F.col(f"`{c}`") for c in ranges.columns])
    distinct = ranges.groupBy(row.alias("_range")).agg(F.count(F.lit(1)).alias("_copies"))
    # an end stands before the points at its value, which are not below it
    ends = [distinct.select(F.col("_range").getField(c).alias("_at"), F.lit(0).alias("_side"), F.xxhash64("_range").alias("_spread"),
                            "_range", "_copies", F.lit(sign).alias("_sign")) for c, sign in ((low, -1), (high, 1))]
    both = weighed.unionByName(ends[0].unionByName(ends[1]), allowMissingColumns=True)
    sorted_rows = range_sorted(both, [F.col("_at"), F.col("_side"), F.col("_spread")])
    names = ["_n", *sums]
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_part = sorted_rows.groupBy("_part").agg(*[F.sum(c).alias(c) for c in names])
    # one row per range partition, so the broadcast is bounded
    offsets = per_part.select("_part", *[F.sum(c).over(before).alias(f"_before{c}") for c in names])
    running = sorted_rows.select("_part", "_mid", "_range", "_copies", "_sign", *[F.sum(c).over(inside).alias(c) for c in names])
    signed = lambda c: F.sum(F.col("_sign") * (F.coalesce(c, F.lit(0)) + F.coalesce(f"_before{c}", F.lit(0))))
    found = running.filter("_sign IS NOT NULL").join(F.broadcast(offsets), "_part").groupBy("_range", "_copies").agg(
        *[signed(c).alias(c) for c in names]).filter("_n > 0")
    copied = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return copied.select("_range.*", *[F.col(s).alias(name) for s, name in zip(sums, totals)])


def _axis(column, kind: T.DataType):
    """A number to measure lengths by: timestamps and dates in microseconds."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    return column.cast("double")


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, tie: Sequence[str] = (),
               prefix: str = "", within: str | None = None) -> DataFrame:
    """Every row of ``left`` with the last row of ``right`` of the same keys whose time is not after its own, or nulls.

    Of right rows with one time the last by ``tie`` counts (by content where that leaves several). ``within`` is the longest
    time back, as an interval ("7 days"). Columns of ``right`` but its keys follow, with ``prefix`` before their names. Null
    keys and times match nothing.

    Both sides are sorted together by key and time over range partitions, so a hot key is spread over many. Inside a partition
    the last right row is carried forward; over the borders it goes by one row per partition.
    """
    names = {f.name: prefix + f.name for f in right.schema.fields if f.name not in keys}
    if clash := set(names.values()) & set(left.columns):
        raise ValueError(f"columns of both sides are named {sorted(clash)}; give a prefix")
    row = lambda df, names: F.struct(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    whole = {c: c for c in left.columns}
    usable = F.lit(True)
    for c in [*keys, left_time]:
        usable = usable & F.col(f"`{c}`").isNotNull()
    key = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keys)]
    by = [f"_k{i}" for i in range(len(keys))]
    kind = left.schema[left_time].dataType
    order_of = F.struct(*[F.col(f"`{c}`") for c in tie]) if tie else F.lit(0)
    ours = left.filter(usable).select(*key, F.col(left_time).alias("_t"), row(left, whole).alias("_l"))
    theirs = right.select(*key, F.col(right_time).cast(kind).alias("_t"), order_of.alias("_tie"), row(right, names).alias("_r"))
    for c in [*by, "_t"]:
        theirs = theirs.filter(F.col(c).isNotNull())
    both = theirs.withColumn("_side", F.lit(0)).unionByName(ours.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    # equal times: right rows first; the content spreads rows that are equal in all else
    both = both.withColumn("_spread", F.xxhash64(F.coalesce(F.to_json("_l"), F.to_json("_r"))))
    order = [F.col(c) for c in (*by, "_t", "_side", "_tie", "_spread")]
    sorted_rows = range_sorted(both, order)
    seen = Window.partitionBy("_part", *by).orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = sorted_rows.withColumn("_found", F.last("_r", ignorenulls=True).over(seen))
    # of each partition: the last right row of its last key, for the partitions that go on with that key
    ends = sorted_rows.groupBy("_part").agg(
        F.min_by(F.struct(*by), "_mid").alias("_first"), F.max_by(F.struct(*by), "_mid").alias("_key"))
    tails = sorted_rows.filter("_side = 0").join(F.broadcast(ends.select("_part", "_key")), "_part").filter(F.struct(*by) == F.col("_key")).groupBy(
        "_part").agg(F.max_by("_r", "_mid").alias("_tail"))
    steps = ends.join(tails, "_part", "left")
    marks = steps.select("_part", "_key", "_tail", F.lit(1).alias("_at")).unionByName(
        steps.select("_part", F.col("_first").alias("_key"), F.lit(None).cast(steps.schema["_tail"].dataType).alias("_tail"), F.lit(0).alias("_at")))
    before = Window.partitionBy("_key").orderBy("_part", "_at").rowsBetween(Window.unboundedPreceding, -1)
    brought = marks.withColumn("_brought", F.last("_tail", ignorenulls=True).over(before)).filter("_at = 0").select("_part", "_key", "_brought")
    # one row per range partition, so the broadcast is bounded
    joined = carried.filter("_side = 1").withColumn("_key", F.struct(*by)).join(F.broadcast(brought), ["_part", "_key"], "left")
    found = F.coalesce("_found", "_brought")
    if within is not None:
        found = F.when(found.getField(names[right_time]).cast(kind) >= F.col("_t") - F.expr(f"interval {within}"), found)
    matched = joined.select("_l.*", found.alias("_m"))
    rest = left.filter(~usable).withColumn("_m", F.lit(None).cast(matched.schema["_m"].dataType))
    return matched.unionByName(rest).select(*whole, *[F.col("_m").getField(n).alias(n) for n in names.values()])


def _row_hash(df: DataFrame):
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)])


def case_insensitive_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on ``lower(key)``; the left spelling of the key is kept."""
    lower = F.lower(F.col(key).cast("string"))
    return (
        left.withColumn("_k", lower)
        .join(right.withColumn("_k", lower).drop(key), "_k", how).drop("_k")
    )


def anti_join_keys(source: DataFrame, source_key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose non-null key is missing from the target: ``NOT IN`` over non-null values."""
    keys = target.select(F.col(target_key).alias(source_key)).filter(F.col(source_key).isNotNull()).distinct()
    return source.filter(F.col(source_key).isNotNull()).join(keys, source_key, "left_anti")

"""Structured Streaming versions of refresh, rule evaluation and windowed KPIs.

All run to the end of the present input with ``availableNow`` and go on from
their checkpoint at the next start, so they can be scheduled or left running.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from opsloom.operators.rules import Rule, apply_status_events, evaluate_table_rules, merge_exceptions
from opsloom.session import cut_lineage, file_system, scratch_folder


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one flow's state under the shared checkpoint folder; it goes when the driver ends. A flow that is
    to go on in another session needs a folder of its own."""
    return scratch_folder(spark, name)


def read_folder_stream(spark: SparkSession, directory: str, schema: T.StructType, pattern: str = "*.parquet",
                       files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(directory)


def incremental_refresh(source: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append the files that arrived since the last run to the table folder ``target``."""
    return (
        source.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def dedupe_events(source: DataFrame, key: Sequence[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """First arrival of each key within the watermark."""
    return source.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) \
        .dropDuplicatesWithinWatermark(list(key))


def windowed_kpi(source: DataFrame, ts: str, formulas: dict[str, Column], size: str = "1 day", slide: str | None = None,
                 delay: str = "1 hour", keys: Sequence[str] = ()) -> DataFrame:
    """Aggregates per tumbling (or sliding) window; a window is final once the watermark passes its end.

    A watermark needs a TIMESTAMP column, so wall-clock stamps are cast first.
    """
    stamped = source.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    grouped = stamped.groupBy(window.alias("w"), *keys).agg(*[c.alias(n) for n, c in formulas.items()])
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *formulas)


class ExceptionStore:
    """Exceptions of a stream under one folder, in buckets by rule and entity.

    A batch reads the newest version of the buckets that it touches and writes their next version, so what it reads does not
    grow with the batches before it. Older versions of a written bucket are removed, but for the one that the batch started
    from: a repeated batch starts from it again and overwrites its own version, so a retry changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark = spark
        self.path = path
        self.buckets = buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("rule_name", "entity_id"), F.lit(self.buckets)).cast("int")

    def _versions(self, bucket: int) -> list[tuple[int, str]]:
        folder, files = file_system(self.spark, f"{self.path}/bucket={bucket}")
        if not files.exists(folder):
            return []
        found = [str(f.getPath().getName()) for f in files.listStatus(folder)]
        return sorted((int(name.split("=")[1]), f"{self.path}/bucket={bucket}/{name}") for name in found if name.startswith("version="))

    def folders(self, before: int, buckets: Sequence[int] | None = None) -> list[str]:
        """The newest version below ``before`` of each of the buckets (all by default)."""
        newest = [[path for version, path in self._versions(b) if version < before][-1:] for b in (range(self.buckets) if buckets is None else buckets)]
        return [path for found in newest for path in found]

    def _state(self, before: int, buckets: Sequence[int] | None = None) -> DataFrame | None:
        folders = self.folders(before, buckets)
        return self.spark.read.parquet(*folders) if folders else None

    def read(self, before_batch: int) -> DataFrame | None:
        """State left by the batches before ``before_batch``, which is the last one or the one after it."""
        return self._state(2 * before_batch)

    def _update(self, changes: DataFrame, version: int, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
        keyed = cut_lineage(changes)
        touched = sorted(r[0] for r in keyed.select(self._bucket().alias("b")).distinct().collect())  # at most one a bucket
        if not touched:
            return
        merged = merge(self._state(version, touched), keyed)
        merged.withColumns({"bucket": self._bucket(), "version": F.lit(version)}).repartition("bucket").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(self.path)
        for bucket in touched:
            for _, path in self._versions(bucket)[:-2]:
                folder, files = file_system(self.spark, path)
                files.delete(folder, True)

    def merge(self, found: DataFrame, batch_id: int) -> None:
        """Merge the exceptions that a batch found: open ones are updated, closed ones come back under a new id."""
        self._update(found, 2 * batch_id, lambda old, new: merge_exceptions(new.limit(0) if old is None else old.select(*new.columns), new))

    def apply_status(self, events: DataFrame, after_batch: int) -> None:
        """Status events (rule_name, entity_id, exception_id, status, ts) on the state that ``after_batch`` left."""
        def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
            if old is None:
                raise ValueError("no exception of these rules and entities is stored")
            return apply_status_events(old, new)
        self._update(events, 2 * after_batch + 1, merge)


def continuous_rules(source: DataFrame, rules: Sequence[Rule], as_of: str, store: ExceptionStore,
                     checkpoint: str) -> StreamingQuery:
    """Rules compiled to one filter on the stream; each micro-batch is merged into the store."""
    found = evaluate_table_rules(source, list(rules), as_of)
    return (
        found.writeStream.foreachBatch(lambda batch, batch_id: store.merge(batch, batch_id))
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


def windows_with_corrections(source: DataFrame, ts: str, formulas: dict[str, Column], folder: str, size: str = "1 day",
                             delay: str = "1 hour", keys: Sequence[str] = ()) -> StreamingQuery:
    """Windowed aggregates that late rows correct: every batch works out anew the windows that its rows fall into.

    Rows go to ``folder``/rows, by the day their window starts on and batch; those that come after the watermark (the latest
    time seen less ``delay``) has passed their window's end are marked late. A batch then aggregates the rows of the touched
    days only, late ones included, and replaces these days in ``folder``/windows. A repeated batch overwrites its own rows.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        window = F.window(F.col(ts).cast("timestamp"), size)
        rows = batch.filter(F.col(ts).isNotNull()).withColumn("_w", window)
        seen = f"{folder}/seen"
        target, files = file_system(spark, seen)
        known = spark.read.parquet(seen).filter(F.col("batch") < batch_id).agg(F.max("latest")).first()[0] if files.exists(target) else None
        mark = F.lit(known).cast("timestamp") - F.expr(f"interval {delay}")
        late = F.coalesce(F.col("_w.end") <= mark, F.lit(False))
        stored = cut_lineage(rows.withColumns({"late": late, "window_start": F.col("_w.start"), "window_end": F.col("_w.end")}).drop("_w"))
        stored.withColumns({"day": F.to_date("window_start"), "batch": F.lit(batch_id)}).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{folder}/rows")
        stored.agg(F.max(F.col(ts).cast("timestamp")).alias("latest")).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(seen)
        days = [r[0] for r in stored.select(F.to_date("window_start")).distinct().collect()]  # the days of one batch
        if days:
            # partition columns that look like dates are read as such
            again = spark.read.parquet(f"{folder}/rows").filter(F.col("day").isin(days))
            totals = again.groupBy("day", "window_start", "window_end", *keys).agg(
                *[c.alias(n) for n, c in formulas.items()], F.count(F.when(F.col("late"), 1)).alias("late_rows"))
            totals.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{folder}/windows")

    return source.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def last_batch(query: StreamingQuery) -> int:
    """Number of the last batch that ran; an availableNow run ends with it."""
    progress = query.lastProgress
    return progress["batchId"] if progress else -1

"""Warehouse tables: load, list, preview, refresh."""

from __future__ import annotations

import re
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_table_name(name: str) -> str:
    """File name to table name: stem, lower case, separators to ``_``."""
    stem = PurePath(name).stem.strip().lower()
    return re.sub(r"\W", "", re.sub(r"[ \-.]", "_", stem))


def normalized_names(names: list[str]) -> list[str]:
    """Strip, lower, blanks/dashes/dots to ``_``; later duplicates get ``_2``, ``_3`` ..."""
    taken: set[str] = set()
    result = []
    for raw in names:
        base = re.sub(r"[ \-.]", "_", raw.strip().lower())
        candidate, n = base, 1
        while candidate in taken:
            n += 1
            candidate = f"{base}_{n}"
        taken.add(candidate)
        result.append(candidate)
    return result


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normalized_names(df.columns))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities in floating columns become null."""
    fixed = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{field.name}`")
            bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
            fixed[field.name] = F.when(~bad, c)
    return df.withColumns(fixed) if fixed else df


def load_tables(spark: SparkSession, directory: str, names: list[str] | None = None,
                register: bool = True) -> dict[str, DataFrame]:
    """Read ``<directory>/<name>.parquet`` (a file or a folder) for each name and register temp views."""
    if names is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true") \
            .option("pathGlobFilter", "*.parquet").load(directory)
        found = files.select(F.regexp_extract("path", r"([^/]+)\.parquet(?:/|$)", 1).alias("name")).distinct()
        names = sorted(r.name for r in found.collect())  # table names
    tables = {n: spark.read.parquet(f"{directory}/{n}.parquet") for n in names}
    if register:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables


def load_table(df: DataFrame, name: str, mode: str = "overwrite",
               partition_by: list[str] | None = None) -> DataFrame:
    """Normalise column names and save as a managed table; returns the stored table."""
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode must be overwrite or append, not {mode!r}")
    writer = normalize_columns(df).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    table = clean_table_name(name)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def list_tables(spark: SparkSession) -> DataFrame:
    """User tables and views, one row each."""
    rows = [(t.name, bool(t.isTemporary)) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_name string, is_view boolean").orderBy("table_name")


def query_table(spark: SparkSession, sql: str, args: dict | list | None = None) -> DataFrame:
    """Query text with named (``:name``) or positional (``?``) bound parameters."""
    return spark.sql(sql, args=args) if args else spark.sql(sql)


def preview(df: DataFrame, rows: int = 20, order_by: list[str] | None = None) -> DataFrame:
    """Some rows of a table for a display; with ``order_by`` (unique ties) the first ones."""
    shown = nan_to_null(df)
    return (shown.orderBy(*order_by) if order_by else shown).limit(rows)


def refresh_summary(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Row counts before and after a refresh and their difference."""
    both = previous.select(F.lit(0).alias("_now")).unionAll(current.select(F.lit(1).alias("_now")))
    counts = both.agg(
        F.count(F.when(F.col("_now") == 0, 1)).alias("previous_rows"),
        F.count(F.when(F.col("_now") == 1, 1)).alias("current_rows"),
    )
    return counts.withColumn("row_diff", F.col("current_rows") - F.col("previous_rows"))


def refresh_source(spark: SparkSession, table: str, fresh: DataFrame) -> DataFrame:
    """Replace ``table`` by ``fresh`` and report the row diff.

    Row counts are taken before the overwrite, as the old rows are gone after it.
    """
    previous_rows = spark.table(table).count() if spark.catalog.tableExists(table) else 0
    stored = load_table(fresh, table)
    return stored.agg(
        F.lit(previous_rows).cast("long").alias("previous_rows"),
        F.count(F.lit(1)).alias("current_rows"),
    ).withColumn("row_diff", F.col("current_rows") - F.col("previous_rows"))


def spread_scan(df: DataFrame) -> DataFrame:
    """A file scan with at least one partition per core.

    A small table may be one unsplittable file; CPU-heavy text or Python work on it
    would then run in one task. Scans that already have enough partitions, as any
    large one does, stay where they are. Use on plain scans only: the partition
    count of a plan with shuffles is not known before it runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def list_sources(sources: DataFrame, workspace_id: str | None = None) -> DataFrame:
    if workspace_id is None:
        return sources
    return sources.filter(F.col("workspace_id") == workspace_id)

"""Keyed change capture between two states of a table, and a refresh that writes only what changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.operators.analytics import require_columns
from opsloom.session import cut_lineage, file_system


def _digests(df: DataFrame, keys: Sequence[str], columns: Sequence[str], side: str) -> DataFrame:
    """One row per key: the number of rows, and of each column a digest that does not depend on their order."""
    digest = lambda c: F.expr(f"bit_xor(xxhash64({c!r}, `{c}` IS NULL, `{c}`))")
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.struct(F.count(F.lit(1)).alias("n"), *[digest(c).alias(c) for c in columns]).alias(side))


def row_changes(previous: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys, ``change`` (inserted, deleted or changed) and ``changed_columns`` (in name order) of each key whose rows differ.

    One full-outer join of 64-bit digests by column; the rows themselves are not shuffled. Keys compare null-safe. Columns that
    one side lacks count as null there. Rows that share a key compare as a whole, in no order; another number of them is a
    change of its own, named ``(rows)``.
    """
    require_columns(previous, keys)
    require_columns(current, keys)
    columns = sorted((set(previous.columns) | set(current.columns)) - set(keys))

    def side(df: DataFrame, name: str) -> DataFrame:
        full = df.withColumns({c: F.lit(None) for c in columns if c not in df.columns})
        found = _digests(full, keys, columns, name)
        # null keys take part in the join
        return found.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("_key"), name).withColumn("_hash", F.xxhash64(F.to_json("_key")))

    old, new = side(previous, "_old"), side(current, "_new")
    both = old.join(new.withColumnRenamed("_key", "_other"), (F.col("_key").eqNullSafe(F.col("_other"))) & (old["_hash"] == new["_hash"]), "full_outer")
    inserted, deleted = F.col("_old").isNull(), F.col("_new").isNull()
    differs = lambda c: F.when(F.col("_old").getField(c) != F.col("_new").getField(c), F.lit("(rows)" if c == "n" else c))
    names = F.array_compact(F.array(*[differs(c) for c in ["n", *columns]]))
    changed = both.withColumns({
        "change": F.when(inserted, "inserted").when(deleted, "deleted").otherwise("changed"),
        "changed_columns": F.when(inserted | deleted, F.array().cast("array<string>")).otherwise(names)})
    kept = changed.filter(inserted | deleted | (F.size("changed_columns") > 0))
    return kept.select(F.coalesce("_key", "_other").alias("_key"), "change", "changed_columns").select("_key.*", "change", "changed_columns")


def change_summary(changes: DataFrame) -> DataFrame:
    """One row: inserted, deleted and changed keys."""
    return changes.agg(*[F.count(F.when(F.col("change") == c, 1)).alias(c) for c in ("inserted", "deleted", "changed")])


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).cast("int")


def refresh_keyed(spark: SparkSession, folder: str, fresh: DataFrame, keys: Sequence[str], buckets: int = 64) -> DataFrame:
    """Bring the table in ``folder`` to the state ``fresh`` and return the changes as :func:`row_changes` gives them.

    The table lies in buckets by key, and only buckets that hold a change are written; the others' files stay as they are.
    """
    target, files = file_system(spark, folder)
    stored = files.exists(target)
    fresh = cut_lineage(fresh)
    previous = read_keyed(spark, folder) if stored else fresh.limit(0)
    changes = cut_lineage(row_changes(previous, fresh, keys))
    touched = sorted(r[0] for r in changes.select(_bucket(keys, buckets).alias("b")).distinct().collect())  # at most one a bucket
    laid = fresh.withColumn("bucket", _bucket(keys, buckets)).filter(F.col("bucket").isin(touched))
    laid.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    left = {r[0] for r in laid.select("bucket").distinct().collect()}
    for bucket in set(touched) - left:  # all its keys are gone
        gone, _ = file_system(spark, f"{folder}/bucket={bucket}")
        files.delete(gone, True)
    return changes


def read_keyed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop("bucket")

"""Spelling variants among the values of text columns, by deletion neighbourhoods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.operators.analytics import require_columns
from opsloom.session import cut_lineage

MIN_LENGTH = 4


def _without_one(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.char_length(text))))


def neighbourhood(text: Column, edits: int) -> Column:
    """The text and all that is left of it after up to ``edits`` deletions."""
    reached = F.array(text)
    for _ in range(edits):
        reached = F.array_distinct(F.concat(reached, F.flatten(F.transform(F.filter(reached, lambda x: F.char_length(x) > 0), _without_one))))
    return reached


def near_values(values: DataFrame, edits: int = 1, min_length: int = MIN_LENGTH) -> DataFrame:
    """(column_name, norm, other) of each two values of a column within ``edits`` edits of each other, both ways.

    Two texts that near have a text in common that both reach by deletions, so one equi-join on (column, reached text) finds
    all of them, and the distance is checked on what it finds. No two values are compared otherwise.
    """
    if edits not in (1, 2):
        raise ValueError("edits must be 1 or 2")
    long = values.filter(F.char_length("norm") >= min_length).select("column_name", "norm")
    reached = long.withColumn("_part", F.explode(neighbourhood(F.col("norm"), edits)))
    pairs = reached.join(reached.withColumnRenamed("norm", "other"), ["column_name", "_part"]).filter("norm < other")
    near = pairs.select("column_name", "norm", "other").distinct().filter(F.levenshtein("norm", "other") <= edits)
    return near.unionByName(near.select("column_name", F.col("other").alias("norm"), F.col("norm").alias("other")))


def category_variants(df: DataFrame, columns: Sequence[str], edits: int = 1, min_length: int = MIN_LENGTH) -> DataFrame:
    """column_name, value, n, canonical, group_values, group_rows of each value that belongs to a group of spellings.

    Values that are the same without case and outer blanks are one spelling, and spellings within ``edits`` edits of each other
    are linked; a group is what hangs together. Its canonical value is the most frequent one (ties: the smallest). Shorter
    spellings than ``min_length`` are linked with nothing else. Nulls are no values.
    """
    require_columns(df, columns)
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    counts = df.select(cells).filter("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts.withColumn("norm", F.lower(F.trim("value"))))
    spellings = counts.groupBy("column_name", "norm").agg(F.sum("n").alias("_n"))
    links = cut_lineage(near_values(spellings, edits, min_length))
    # a spelling's label is the best one it has heard of: the more rows the better, then the smaller text
    best = F.struct((-F.col("_n")).alias("rank"), F.col("norm").alias("text"))
    labels = cut_lineage(spellings.withColumn("label", best).select("column_name", "norm", "label"))
    while True:
        heard = links.join(labels.select("column_name", F.col("norm").alias("other"), F.col("label").alias("_heard")), ["column_name", "other"])
        told = heard.groupBy("column_name", "norm").agg(F.min("_heard").alias("_heard"))
        now = labels.join(told, ["column_name", "norm"], "left").withColumn("_best", F.least("label", F.coalesce("_heard", "label")))
        # and what that one's own label is, which doubles the reach of a round
        onward = labels.select("column_name", F.col("norm").alias("_at"), F.col("label").alias("_next"))
        now = now.withColumn("_at", F.col("_best.text")).join(onward, ["column_name", "_at"]).withColumn("_best", F.least("_best", "_next"))
        now = cut_lineage(now.select("column_name", "norm", F.col("_best").alias("label"), (F.col("_best") != F.col("label")).alias("_moved")))
        labels = now.drop("_moved")
        if now.filter("_moved").isEmpty():
            break
    grouped = counts.join(labels, ["column_name", "norm"]).withColumn("_group", F.col("label.text"))
    groups = grouped.groupBy("column_name", "_group").agg(
        F.count(F.lit(1)).alias("group_values"), F.sum("n").alias("group_rows"),
        F.min(F.struct((-F.col("n")).alias("rank"), F.col("value").alias("value"))).alias("_top")).filter("group_values > 1")
    return grouped.join(groups, ["column_name", "_group"]).select(
        "column_name", "value", "n", F.col("_top.value").alias("canonical"), "group_values", "group_rows")

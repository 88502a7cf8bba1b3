"""Isolation forest: trees fitted on bounded samples in parallel, whole table scored where it lies.

Fitting and path lengths are the only per-row Python in the library; Spark
samples, ranks, distributes the trees and finds the threshold.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.operators.ordering import exact_quantiles
from opsloom.session import cut_lineage

# Workers get the fitting and scoring code with the task: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES = 100
SAMPLE_ROWS = 256
# Rows that are kept for a tree's draw, as a multiple of its sample, before the smallest are taken.
THINNING = 4
CONTAMINATION = 0.05
MIN_ROWS = 15
SEED = 42

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, depth double, sample int"


def average_path(n):
    """Expected depth of an unsuccessful search among ``n`` values."""
    n = np.asarray(n, dtype=float)
    large = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, large, np.where(n == 2, 1.0, 0.0))


def _grow(rows: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """One isolation tree as (node, feature, threshold, left, right, depth, rows); leaves have feature -1."""
    limit = int(np.ceil(np.log2(max(len(rows), 2))))
    nodes: list[list] = []
    waiting = [(rows, 0, None, None)]
    while waiting:
        part, depth, parent, side = waiting.pop()
        number = len(nodes)
        if parent is not None:
            nodes[parent][side] = number
        spread = part.max(axis=0) - part.min(axis=0)
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(part) <= 1 or usable.size == 0:
            nodes.append([number, -1, 0.0, -1, -1, float(depth + average_path(len(part))), len(rows)])
            continue
        feature = int(rng.choice(usable))
        low, high = part[:, feature].min(), part[:, feature].max()
        threshold = float(rng.uniform(low, high))
        goes_left = part[:, feature] <= threshold
        nodes.append([number, feature, threshold, -1, -1, 0.0, len(rows)])
        waiting.append((part[~goes_left], depth + 1, number, 4))
        waiting.append((part[goes_left], depth + 1, number, 3))
    return [tuple(n) for n in nodes]


def fit_trees(sample: DataFrame, columns: Sequence[str], seed: int = SEED) -> DataFrame:
    """One group of at most a sample's rows per tree; nodes as rows."""
    names = list(columns)

    def fit(key, pdf):
        tree = int(key[0])
        rows = pdf.sort_values(["_draw", *names], kind="stable")[names].to_numpy(dtype=float)
        nodes = _grow(rows, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "depth", "sample"])
        out.insert(0, "tree", tree)
        return out

    # a fixed partition number keeps AQE from packing all trees into one task
    parts = min(TREES, sample.sparkSession.sparkContext.defaultParallelism)
    return sample.repartition(parts, "tree").groupBy("tree").applyInPandas(fit, NODE_SCHEMA)


def draw_samples(values: DataFrame, key: Sequence[str], columns: Sequence[str], trees: int = TREES, rows: int = SAMPLE_ROWS,
                 seed: int = SEED) -> DataFrame:
    """``rows`` rows for each tree, drawn by a hash of seed, tree and row.

    A row takes part in as many draws as are needed for every tree to have twice its sample to choose from, each time
    under another tree; in a large table that is one. The draw does not depend on how the table is partitioned. Equal rows
    have equal hashes, so they are drawn together.
    """
    n = values.count()
    times = min(trees, max(1, -(-2 * trees * rows // max(n, 1))))
    row = F.xxhash64(F.lit(seed), *key, *columns)
    dealt = values.select(*columns, row.alias("_row"), F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("_time")).withColumn(
        "tree", F.pmod(F.pmod("_row", F.lit(trees)) + F.col("_time"), F.lit(trees)).cast("int")).withColumn(
        "_draw", F.pmod(F.xxhash64("tree", "_row"), F.lit(1 << 40)))
    share = THINNING * rows * trees / max(n * times, 1)
    if share < 1:
        dealt = dealt.filter(F.col("_draw") < int(share * (1 << 40)))
    order = Window.partitionBy("tree").orderBy("_draw", *columns)
    return dealt.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= rows).select("tree", "_draw", *columns)


def _model(nodes: pd.DataFrame) -> list[dict[str, np.ndarray]]:
    trees = []
    for _, part in nodes.sort_values(["tree", "node"]).groupby("tree"):
        trees.append({c: part[c].to_numpy() for c in ("feature", "threshold", "left", "right", "depth", "sample")})
    return trees


def _scores(trees: list[dict[str, np.ndarray]], rows: np.ndarray) -> np.ndarray:
    """Normality score per row, -1 (isolated at once) to 0; lower is more abnormal."""
    total = np.zeros(len(rows))
    index = np.arange(len(rows))
    for tree in trees:
        at = np.zeros(len(rows), dtype=np.int64)
        while True:
            feature = tree["feature"][at]
            inner = feature >= 0
            if not inner.any():
                break
            value = rows[index, np.where(inner, feature, 0)]
            step = np.where(value <= tree["threshold"][at], tree["left"][at], tree["right"][at])
            at = np.where(inner, step, at)
        total += tree["depth"][at]
    mean_depth = total / max(len(trees), 1)
    scale = float(average_path(trees[0]["sample"][0])) or 1.0
    return -np.power(2.0, -mean_depth / scale)


def score_rows(values: DataFrame, nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``score`` to every row; the model is at most two nodes for each sampled row."""
    trees = _model(nodes.toPandas())  # bounded by the sample size, not by the data
    if not trees:
        return values.withColumn("score", F.lit(None).cast("double"))
    names = list(columns)

    def score(batches):
        for pdf in batches:
            pdf["score"] = _scores(trees, pdf[names].to_numpy(dtype=float))
            yield pdf

    schema = values.withColumn("score", F.lit(0.0)).schema
    return values.mapInPandas(score, schema)


def isolation_forest_scores(df: DataFrame, columns: Sequence[str], seed: int = SEED, trees: int = TREES,
                            sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """record_id, date, the columns and the score of every complete row, written out once."""
    from opsloom.operators.anomaly import date_column, id_column

    key, date = id_column(df), date_column(df)
    record = F.col(f"`{key}`").cast("string") if key else F.sha2(F.to_json(F.struct(*df.columns)), 256)
    # positional names: a column may be called like one of ours
    inner = [f"_c{i}" for i in range(len(columns))]
    values = df.select(
        record.alias("record_id"), (F.col(f"`{date}`").cast("string") if date else F.lit(None).cast("string")).alias("date"),
        *[F.col(f"`{c}`").cast("double").alias(i) for c, i in zip(columns, inner)]).na.drop(subset=inner)
    nodes = fit_trees(draw_samples(values, ["record_id"], inner, trees, sample_rows, seed), inner, seed)
    return cut_lineage(score_rows(values, nodes, inner))


def isolation_forest_anomalies(df: DataFrame, columns: Sequence[str], table_name: str,
                               contamination: float = CONTAMINATION, seed: int = SEED, trees: int = TREES,
                               sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The ``contamination`` share of rows with the lowest scores, reported on the first column. ``trees`` trees are fitted
    on ``sample_rows`` rows each."""
    from opsloom.operators.anomaly import ANOMALY_COLUMNS

    if len(columns) < 2:
        raise ValueError("an isolation forest needs at least two numeric columns")
    scored = isolation_forest_scores(df, columns, seed, trees, sample_rows)
    limits = exact_quantiles(scored, "score", {"cut": contamination})
    stats = scored.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("_c0").alias("mean")).alias("s"))
    judged = scored.withColumn("_cut", limits.select("cut").scalar()).withColumn("_s", stats.scalar())
    flagged = judged.filter((F.col("_s.n") >= MIN_ROWS) & (F.col("score") < F.col("_cut")))
    x, mean = F.col("_c0"), F.col("_s.mean")
    return flagged.select(
        F.lit(table_name).alias("table_name"), F.lit(columns[0]).alias("column_name"), F.lit("isolation_forest").alias("method"),
        F.round(x, 2).alias("observed_value"), F.round(mean * 0.5, 2).alias("expected_min"),
        F.round(mean * 1.5, 2).alias("expected_max"), F.round(x - mean, 2).alias("deviation"),
        F.coalesce(F.round((x - mean) / F.abs(F.when(mean == 0, 1.0).otherwise(mean)) * 100, 2), F.lit(0.0)).alias("deviation_percentage"),
        "record_id", "date",
        F.array(F.lit("perhaps: the values are rare in this combination"), F.lit("perhaps: the row mixes up two records")).alias("potential_drivers"),
        F.lit(False).alias("is_verified_impact"),
        F.create_map(F.lit("anomaly_score"), F.round("score", 3)).alias("details"),
    ).select(*ANOMALY_COLUMNS)

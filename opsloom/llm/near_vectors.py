"""Embedding near-dedup by int8 tile products with error bounds (operator 2).

Vectors are scaled to length 1 and quantised to int8 with a scale of their own; the length of what quantisation took away
is kept as a bound. The product of two quantised vectors then bounds their cosine from both sides. Vectors of a label are
dealt to blocks, and each pair of blocks is one tile. In a tile the int8 products are exact integers; pairs surely above
or below the threshold are settled by the bounds, and only the pairs in between are recomputed in double precision.

A tile returns, for each vector, how many others it is linked with there and an edge of a spanning forest of the links,
never the pairs. Equal vectors of a label count as one, with their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.components import components
from opsloom.llm.ngram_join import forest, sorted_groups
from opsloom.session import cut_lineage

BLOCK = 1024  # vectors per side of a tile
EXACT_SUM = 1024  # int8 products of so many dimensions add up exactly in float32
#: Covers the rounding of float32 in bounds that are below 2 in size.
SLACK = 1e-5
ROWS = 4096  # pairs recomputed at once


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows of length 1: int8 codes, scales, lengths of the coded vectors, lengths of the errors (rounded up)."""
    scale = np.abs(unit).max(axis=1) / 127
    scale[scale == 0] = 1
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(coded, axis=1) * (1 + 1e-12), np.linalg.norm(unit - coded, axis=1) * (1 + 1e-12) + 1e-12


def linked(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of rows whose cosine in double precision is at least ``threshold``. The rows are finite
    and not zero."""
    sides = []
    for x in (left, right):
        # the largest component first, so that squares neither overflow nor vanish
        x = x / np.abs(x).max(axis=1, keepdims=True)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        sides.append((unit, *quantise(unit)))
    (u, a, sa, na, ea), (v, b, sb, nb, eb) = sides
    product = np.zeros((len(left), len(right)), np.float32)
    for d in range(0, a.shape[1], EXACT_SUM):
        product += a[:, d:d + EXACT_SUM].astype(np.float32) @ b[:, d:d + EXACT_SUM].astype(np.float32).T
    product *= sa[:, None].astype(np.float32)
    product *= sb[None, :].astype(np.float32)
    # |u.v - coded product| <= |eu||v'| + |u'||ev| + |eu||ev|, of which the block's largest is taken
    error = ea * nb.max() + na * eb.max() + ea * eb.max() + SLACK
    sure = product >= (threshold + error[:, None]).astype(np.float32) + np.float32(SLACK)
    row, col = np.nonzero((product >= (threshold - error[:, None]).astype(np.float32) - np.float32(SLACK)) & ~sure)
    for at in range(0, len(row), ROWS):
        i, j = row[at:at + ROWS], col[at:at + ROWS]
        sure[i, j] = np.einsum("ij,ij->i", u[i], v[j]) >= threshold
    return sure


def _tiles(threshold: float):
    def run(batches):
        for group in sorted_groups(batches, ["part", "low", "high"]):
            side, rep, copies = (group[c].to_numpy() for c in ("block", "rep", "copies"))
            values = group["vector"].combine_chunks()
            values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
            matrix = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rep), -1)
            low, high = group["low"][0].as_py(), group["high"][0].as_py()
            first, second = np.flatnonzero(side == low), np.flatnonzero(side == high)
            if low == high:
                found = linked(matrix, matrix, threshold)
                found |= found.T
                np.fill_diagonal(found, False)
                names, counts, both = rep, found @ copies, found
            else:
                if not len(first) or not len(second):
                    continue
                found = linked(matrix[first], matrix[second], threshold)
                names = np.concatenate([rep[first], rep[second]])
                counts = np.concatenate([found @ copies[second], found.T @ copies[first]])
                n, m = found.shape
                both = np.zeros((n + m, n + m), bool)
                both[:n, n:], both[n:, :n] = found, found.T
            edges = dict(forest(both, names))
            rows = np.flatnonzero(counts)
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[rows]), pa.array(counts[rows]), pa.array([edges.get(int(names[i])) for i in rows], pa.int64())],
                    ["rep", "n", "edge"])
    return run


def _usable(vector: Column) -> Column:
    """Not null, not zero, and every component finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0)


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable) and kept (vec_id is that)
    of each row of ``vectors``.

    Two vectors link when their labels are equal and not null, they have the same number of dimensions, and the cosine in
    double precision is at least ``threshold``. Null, empty and zero vectors and those with null or non-finite components
    link with nothing. Rows that share a vec_id are vectors of their own that share a component. Rows with null vec_id link
    with nothing and have null in component_id and kept. Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.col("embedding").cast("array<double>").alias("vector"))
    usable = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(_usable(F.col("vector")), F.lit(False)))
    # equal vectors as one; hashing the vector splits a hot label over tasks
    classes = cut_lineage(usable.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
                          .withColumn("part", F.xxhash64("label", F.size("vector"))))
    blocks = classes.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = classes.join(blocks, "part").withColumn("block", F.pmod(F.xxhash64("vector"), "blocks").cast("int"))
    # the exchange carries single precision where that holds the vector exactly
    tiled = (placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("part", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "copies", "vector"))
    found = cut_lineage(tiled.repartition("part", "low", "high").sortWithinPartitions("part", "low", "high")
                        .mapInArrow(_tiles(threshold), "rep long, n long, edge long"))
    totals = found.groupBy("rep").agg(F.sum("n").alias("others"))
    reached = components(found.select("rep", "edge"), "rep", "edge").withColumnRenamed("component", "reached")
    of_class = (classes.join(totals, "rep", "left").join(reached, F.col("rep") == F.col("node"), "left")
                .select(F.col("label").alias("of_label"), F.col("vector").alias("of_vector"), F.col("copies"),
                        F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("reached", "rep").alias("component")))
    joined = rows.join(of_class, (F.col("label") == F.col("of_label")) & (F.col("vector") == F.col("of_vector")) & F.col("vec_id").isNotNull(), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return joined.select("vec_id", F.coalesce(F.col("others") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
                         component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))

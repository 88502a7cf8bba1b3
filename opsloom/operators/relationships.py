"""Foreign-key candidates between tables and their confidence by value overlap."""

from __future__ import annotations

from collections import namedtuple
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.operators.ordering import first_per_group
from opsloom.operators.profile import catalog_of
from opsloom.session import cut_lineage

EDGE = ["source_table", "source_column", "target_table", "target_column"]
Edge = namedtuple("Edge", EDGE)
# Hashes of a column's sketch, and hashes that must be comparable before a pair is ruled out.
SKETCH = 1024
EVIDENCE = 16
# Columns told apart by the bits of one long.
BITS = 63
# Confidence of the naming rules and of the overlap classes.
SAME_ID_CONFIDENCE = 0.90
NAMED_KEY_CONFIDENCE = 0.85
FULL_OVERLAP = 0.95
PARTIAL_OVERLAP = 0.5
VERIFIED_CONFIDENCE = 0.8


def candidate_relationships(catalog: DataFrame) -> DataFrame:
    """Edges whose names suggest a key: three naming rules, each an equi-join of the column catalog."""
    source = catalog.select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"))
    target = catalog.select(F.col("table_name").alias("target_table"), F.col("column_name").alias("target_column"))
    singular = F.rtrim(F.col("target_table"), F.lit("s"))
    other = F.col("source_table") != F.col("target_table")

    def rule(targets: DataFrame, expected: Column, confidence: float, number: int) -> DataFrame:
        keyed = targets.withColumn("source_column", expected)
        return source.join(keyed, "source_column").filter(other).select(
            *EDGE, F.lit(confidence).alias("confidence"), F.lit(number).alias("rule"))

    same = rule(target.filter(F.col("target_column").endswith("_id")), F.col("target_column"), SAME_ID_CONFIDENCE, 1)
    by_id = rule(target.filter(F.col("target_column") == "id"), F.concat(singular, F.lit("_id")), NAMED_KEY_CONFIDENCE, 2)
    prefixed = rule(target, F.concat(singular, F.lit("_"), F.col("target_column")), NAMED_KEY_CONFIDENCE, 3)
    union = reduce(DataFrame.unionByName, [same, by_id, prefixed])
    # the first rule that applies to an edge decides
    return union.groupBy(*EDGE).agg(F.min_by("confidence", "rule").alias("confidence"))


def _overlaps(spark: SparkSession, tables: dict[str, DataFrame], edges: list) -> DataFrame:
    """Distinct source keys of each edge and how many exist in the target.

    Every table is scanned once for all its key columns. A key goes through one shuffle, with one bit for each column that
    holds it, so a task holds one row per key however many columns and edges there are. What is left is one row per set of
    columns that occurs together.
    """
    columns: list[tuple[str, str]] = sorted(
        {(e.source_table, e.source_column) for e in edges} | {(e.target_table, e.target_column) for e in edges})
    number = {column: i for i, column in enumerate(columns)}
    words = [f"_in{w}" for w in range(-(-len(columns) // BITS))]
    bits = lambda i: [F.lit(1 << i % BITS if i // BITS == w else 0).cast("long").alias(name) for w, name in enumerate(words)]
    scans = []
    for table in sorted({t for t, _ in columns}):
        cells = F.array(*[F.struct(F.col(f"`{c}`").cast("string").alias("_key"), *bits(number[(table, c)])) for t, c in columns if t == table])
        scans.append(tables[table].select(F.inline(cells)))
    per_key = reduce(DataFrame.unionByName, scans).filter(F.col("_key").isNotNull()).groupBy("_key").agg(*[F.bit_or(w).alias(w) for w in words])
    sets = per_key.groupBy(*words).agg(F.count(F.lit(1)).alias("_keys"))
    # catalog metadata: one row per edge
    used = spark.createDataFrame([(i, number[(e.source_table, e.source_column)], number[(e.target_table, e.target_column)]) for i, e in enumerate(edges)],
                                 "_edge int, _source int, _target int")
    holds = lambda c: F.getbit(F.array(*words)[F.floor(F.col(c) / BITS).cast("int")], F.col(c) % BITS) == 1
    return sets.join(F.broadcast(used), holds("_source")).groupBy("_edge").agg(
        F.sum("_keys").alias("source_distinct"), F.sum(F.when(holds("_target"), F.col("_keys")).otherwise(0)).alias("overlap"))


def discover_relationships(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Candidate edges with confidence adjusted by the share of source keys found in the target."""
    # the candidates are catalog metadata: at most a few rows per pair of columns
    edges = candidate_relationships(catalog_of(spark, tables)).orderBy(*EDGE).collect()
    numbered = spark.createDataFrame(
        [(i, *[e[c] for c in EDGE], e.confidence) for i, e in enumerate(edges)],
        "_edge int, source_table string, source_column string, target_table string, target_column string, confidence double")
    if not edges:
        return numbered.drop("_edge").withColumn("is_verified", F.lit(False))
    joined = numbered.join(_overlaps(spark, tables, edges), "_edge", "left")
    ratio = F.col("overlap") / F.col("source_distinct")
    base = F.col("confidence")
    adjusted = (
        F.when(F.col("source_distinct").isNull(), base)
        .when(ratio >= FULL_OVERLAP, F.least(F.lit(0.98), base + 0.08))
        .when(ratio >= PARTIAL_OVERLAP, F.round(base * ratio, 2))
        .otherwise(F.round(base * 0.5, 2))
    )
    return joined.select(*EDGE, F.round(adjusted, 4).alias("confidence")).withColumn(
        "is_verified", F.col("confidence") >= VERIFIED_CONFIDENCE)


def _kind(data_type: T.DataType) -> str | None:
    """Columns of one kind can hold the same keys."""
    if isinstance(data_type, T.IntegralType):
        return "number"
    if isinstance(data_type, T.StringType):
        return "text"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return None


def value_sketches(tables: dict[str, DataFrame], size: int = SKETCH) -> DataFrame:
    """table_name, column_name, kind, hash: of each key-like column the ``size`` smallest hashes of its distinct values, with
    the numbers of its distinct values and of its non-null rows.

    Sketches of parts of a table merge: the smallest hashes of both, again cut to ``size``. One scan a table.
    """
    scans, known = [], []
    for table, df in sorted(tables.items()):
        columns = [(f.name, kind) for f in df.schema.fields if (kind := _kind(f.dataType))]
        if columns:
            cells = F.array(*[F.struct(F.lit(i).alias("_column"), F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.col(f"`{c}`").cast("string"))).alias("hash"))
                              for i, (c, _) in enumerate(columns, len(known))])
            known += [(i, table, c, kind) for i, (c, kind) in enumerate(columns, len(known))]
            scans.append(df.select(F.inline(cells)).filter("hash IS NOT NULL"))
    if not scans:
        raise ValueError("no table has a column of whole numbers, texts or times")
    values = cut_lineage(reduce(DataFrame.unionByName, scans).groupBy("_column", "hash").agg(F.count(F.lit(1)).alias("_rows")))
    sizes = values.groupBy("_column").agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("_rows").alias("filled_rows"))
    least = first_per_group(values, ["_column"], [F.col("hash")], size, "_rank").drop("_rank", "_rows")
    # catalog metadata: one row per column
    names = tables[known[0][1]].sparkSession.createDataFrame(known, "_column int, table_name string, column_name string, kind string")
    return least.join(sizes, "_column").join(F.broadcast(names), "_column").select(
        "table_name", "column_name", "kind", "hash", "distinct_values", "filled_rows")


def discover_by_values(spark: SparkSession, tables: dict[str, DataFrame], least_overlap: float = FULL_OVERLAP, least_values: int = 2,
                       size: int = SKETCH) -> DataFrame:
    """Edges whose source values lie in a unique target column of another table, whatever the columns are called.

    Columns: the edge, source_distinct, overlap and confidence (their ratio, at least ``least_overlap``). Sketches rule pairs
    out: of the source's hashes up to the largest of the target's sketch, at least half must be in it. Pairs with too few such
    hashes to tell are not ruled out. What is left is checked exactly, each table read once more. Sources need
    ``least_values`` different values.
    """
    sketches = cut_lineage(value_sketches(tables, size))
    reach = sketches.groupBy("table_name", "column_name", "kind", "distinct_values", "filled_rows").agg(F.max("hash").alias("_last"))
    # catalog metadata: one row per column
    columns = [r.asDict() for r in reach.collect()]
    targets = [c for c in columns if c["distinct_values"] == c["filled_rows"]]
    sources = [c for c in columns if c["distinct_values"] >= least_values]
    pairs = [(i, s, t) for i, (s, t) in enumerate((s, t) for s in sources for t in targets if s["table_name"] != t["table_name"] and s["kind"] == t["kind"])]
    empty = "source_table string, source_column string, target_table string, target_column string, source_distinct long, overlap long, confidence double"
    if not pairs:
        return spark.createDataFrame([], empty)
    asked = spark.createDataFrame(
        [(i, s["table_name"], s["column_name"], t["table_name"], t["column_name"], t["_last"] if t["distinct_values"] > size else (1 << 63) - 1) for i, s, t in pairs],
        "_edge int, table_name string, column_name string, _table string, _column string, _limit long")
    hashes = sketches.select("table_name", "column_name", "hash")
    theirs = hashes.select(F.col("table_name").alias("_table"), F.col("column_name").alias("_column"), "hash", F.lit(1).alias("_there"))
    compared = hashes.join(F.broadcast(asked), ["table_name", "column_name"]).filter("hash <= _limit").join(theirs, ["_table", "_column", "hash"], "left")
    told = {r[0]: (r.seen, r.there) for r in compared.groupBy("_edge").agg(F.count(F.lit(1)).alias("seen"), F.count("_there").alias("there")).collect()}
    hopeful = [(i, s, t) for i, s, t in pairs if told.get(i, (0, 0))[0] < EVIDENCE or 2 * told[i][1] >= told[i][0]]
    if not hopeful:
        return spark.createDataFrame([], empty)
    edges = [Edge(s["table_name"], s["column_name"], t["table_name"], t["column_name"]) for _, s, t in hopeful]
    numbered = spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], "_edge int, " + ", ".join(f"{c} string" for c in EDGE))
    ratio = F.col("overlap") / F.col("source_distinct")
    return numbered.join(_overlaps(spark, tables, edges), "_edge").filter(ratio >= least_overlap).select(
        *EDGE, "source_distinct", "overlap", F.round(ratio, 4).alias("confidence"))


def upsert_relationships(existing: DataFrame, found: DataFrame) -> DataFrame:
    """New confidence for known edges (their verified flag stays), new edges added."""
    old = existing.select(*EDGE, F.col("confidence").alias("_c"), F.col("is_verified").alias("_v"))
    return found.join(old, EDGE, "full_outer").select(
        *EDGE, F.coalesce("confidence", "_c").alias("confidence"), F.coalesce("_v", "is_verified").alias("is_verified"))

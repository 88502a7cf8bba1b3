"""CSV, JSON, text and JDBC reads; CSV and report sinks."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.sources.tables import nan_to_null, normalize_columns, normalized_names

DELIMITERS = (",", ";", "\t", "|")
SNIFF_LINES = 20


def _first_lines(spark: SparkSession, path: str) -> list[str]:
    return [r.value for r in spark.read.text(path).limit(SNIFF_LINES).collect() if r.value.strip()]


def _delimiter_of(lines: list[str]) -> str:
    best, best_fields = ",", 1
    for delimiter in DELIMITERS:
        counts = {line.count(delimiter) for line in lines}
        fields = min(counts, default=0) + 1
        if len(counts) == 1 and fields > best_fields:
            best, best_fields = delimiter, fields
    return best


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that splits the first lines into the same, largest number of fields."""
    return _delimiter_of(_first_lines(spark, path))


def read_csv_table(spark: SparkSession, path: str, delimiter: str | None = None,
                   schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with header. Give ``schema`` for large files: inference reads them twice.

    Names come from the header line itself, as Spark renames headers that differ only by case.
    """
    lines = _first_lines(spark, path)
    separator = delimiter or _delimiter_of(lines)
    reader = spark.read.option("header", True).option("sep", separator)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    header = next(csv.reader(lines[:1], delimiter=separator), [])
    if schema is None and len(header) == len(df.columns):
        df = df.toDF(*normalized_names(header))
    return nan_to_null(normalize_columns(df))


def _leaf_columns(schema: T.StructType, parents: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    leaves = []
    for field in schema.fields:
        path = (*parents, field.name)
        if isinstance(field.dataType, T.StructType):
            leaves.extend(_leaf_columns(field.dataType, path))
        else:
            leaves.append((path, field.dataType))
    return leaves


def flatten_struct(df: DataFrame) -> DataFrame:
    """Nested structs become top-level columns ``parent_child``; arrays stay arrays."""
    columns = []
    for path, _ in _leaf_columns(df.schema):
        reference = ".".join(f"`{p}`" for p in path)
        columns.append(F.col(reference).alias(".".join(path)))
    return normalize_columns(df.select(*columns))


def read_json_table(spark: SparkSession, path: str, multi_line: bool = False,
                    schema: T.StructType | str | None = None) -> DataFrame:
    """JSON list of objects, object holding such a list, or a single object.

    For an object, its first list-valued key is the table (Spark infers fields in
    name order). The default reads newline-delimited JSON, which splits; ``multi_line=True``
    reads a file that is one JSON value, in one task.
    """
    reader = spark.read.option("multiLine", multi_line)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(path)
    if "_corrupt_record" in df.columns or not df.columns:
        raise ValueError("unsupported JSON structure: expected an array of objects or an object")
    lists = [f.name for f in df.schema.fields
             if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if lists:
        df = df.select(F.inline(F.col(f"`{lists[0]}`")))
    return flatten_struct(df)


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: filename, file_type, text.

    Undecodable bytes are dropped, as the source files may mix encodings.
    """
    raw = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    replacement = F.lit("\ufffd")  # what invalid bytes turn into
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), replacement, F.lit(""))
    return raw.select(
        name.alias("filename"),
        F.lower(F.element_at(F.split(name, r"\."), -1)).alias("file_type"),
        text.alias("text"),
    )


def read_jdbc_tables(
    spark: SparkSession,
    url: str,
    tables: Sequence[str],
    properties: dict[str, str] | None = None,
    partitioning: dict[str, tuple[str, int, int, int]] | None = None,
) -> dict[str, DataFrame]:
    """One lazy DataFrame per database table.

    ``partitioning`` maps a table to (column, lower, upper, partitions) so that
    it is read by that many parallel range queries. The driver jar is the user's.
    """
    frames = {}
    for table in tables:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
        for key, value in (properties or {}).items():
            reader = reader.option(key, value)
        if partitioning and table in partitioning:
            column, lower, upper, parts = partitioning[table]
            reader = (reader.option("partitionColumn", column).option("lowerBound", lower)
                      .option("upperBound", upper).option("numPartitions", parts))
        frames[table] = normalize_columns(reader.load())
    return frames


def mask_connection_uri(uri: Column) -> Column:
    """``scheme://user:secret@host`` to ``scheme://user:********@host``.

    Greedy up to the last ``@``, so a password that contains ``@`` is hidden too.
    """
    return F.regexp_replace(uri, r"^([^:]+://[^:@]+)(:.*)?@", r"$1:********@")


def _text_columns(df: DataFrame) -> DataFrame:
    """CSV cannot hold nested values: write them as JSON text."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[
        F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested)
        else F.col(f"`{f.name}`") for f in df.schema.fields])


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    _text_columns(df).write.mode(mode).option("header", True).csv(path)


def write_report(sections: dict[str, DataFrame], path: str, mode: str = "overwrite") -> list[str]:
    """Each section to ``<path>/json/<name>`` and ``<path>/csv/<name>``."""
    written = []
    for name, df in sections.items():
        df.write.mode(mode).json(f"{path}/json/{name}")
        export_csv(df, f"{path}/csv/{name}", mode)
        written.append(name)
    return written

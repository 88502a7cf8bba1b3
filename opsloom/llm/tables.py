"""Tables of a data folder, and column checks shared by the operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, folds: int) -> Column:
    """Fold of a document: crc32 of its id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(folds))


def rows_and_text(docs: DataFrame, text=lambda column: column) -> DataFrame:
    """Every row whole in one column, and its text beside it, so that no added column can clash with one of the table's."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), text(docs["text"].cast("string")).alias("text"))


def filter_rows(docs: DataFrame, keep, text=lambda column: column) -> DataFrame:
    """Rows of ``docs`` by ``keep``: batches of (row, text) in, pairs of a batch and its mask out. A narrow step."""
    packed = rows_and_text(docs, text)

    def run(batches):
        for part, mask in keep(batches):
            part = part.filter(pa.array(mask))
            if part.num_rows:
                yield part.select(["row"])

    return packed.mapInArrow(run, T.StructType([packed.schema["row"]])).select("row.*")

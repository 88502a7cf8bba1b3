"""The corpus pipeline: documents in, token ids out, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept. The first four return the
columns of documents; what they decide takes effect in the rows or texts that they return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.bpe import encode_decode
from opsloom.llm.cover_dedup import remove_repeated_windows
from opsloom.llm.decontaminate import drop_contaminated
from opsloom.llm.neighbours import keep_quality
from opsloom.llm.ngram_join import jaccard_components
from opsloom.llm.suite import vocabulary
from opsloom.llm.tables import table
from opsloom.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is 1. Null and empty texts get the share of good documents, so they stay or go
    together; an empty table stays empty."""
    return keep_quality(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies: five-word shingles, similarity 0.8 or
    more. Rows that share a doc_id stay or go together; rows without doc_id stay; texts without words are no one's copy."""
    found = jaccard_components(docs, size=5, percent=80)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("of"))
    # rows that share a doc_id count as one document: one of them that leads its group keeps all
    gone = gone.join(found.filter("doc_id = component_id").select(F.col("doc_id").alias("of")), "of", "left_anti")
    return docs.join(gone.hint("merge"), docs["doc_id"] == F.col("of"), "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 50-word windows that start in a document with a smaller doc_id, too. Texts that lose
    nothing are unchanged; a document that loses all its words goes; n_chars follows the text."""
    found = remove_repeated_windows(docs, size=50, rows=True).filter("n_removed < n_words OR n_words = 0")
    kept = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    changed = {"text": kept, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*(changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: five-word shingles, similarity 0.8 or more."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), threshold=0.8)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded of each document."""
    return encode_decode(docs, vocabulary())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what each returns is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

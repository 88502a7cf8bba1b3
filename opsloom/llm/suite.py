"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm import oracles
from opsloom.llm.bpe import encode_decode
from opsloom.llm.bwt_dedup import remove_repeated_bytes
from opsloom.llm.cover_dedup import remove_repeated_windows
from opsloom.llm.decontaminate import contaminated
from opsloom.llm.language import identify
from opsloom.llm.longest_match import token_counts
from opsloom.llm.max_sketch import ranked_documents
from opsloom.llm.near_vectors import near_vectors
from opsloom.llm.neighbours import quality_scores
from opsloom.llm.ngram_join import jaccard_components
from opsloom.llm.skip_chain import KINDS, personal_spans, span_text
from opsloom.llm.spelling import spelling_groups
from opsloom.llm.tables import table
from opsloom.llm.text_density import extract_main_text


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _sha256(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), folds=4, held=2, spans=False)


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_bytes(table(spark, sf_dir, "documents"), size=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", _sha256("kept").alias("kept_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_windows(table(spark, sf_dir, "documents"), size=50)
    return found.select("doc_id", "n_words", "n_removed", _sha256("kept_text").alias("kept_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_decode(table(spark, sf_dir, "documents"), vocabulary())
    return found.select("doc_id", "n_tokens", _sha256("ids").alias("ids_sha256"), _sha256("decoded").alias("decoded_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, threshold=0.3)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.8)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"), least_length=6, least_count=5, ratio=5, every=199)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_spans(table(spark, sf_dir, "documents"))
    base = found.withColumn("base", F.filter("spans", lambda s: ~s["added"]))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return base.select("doc_id", *counts, F.sha2(span_text("base").cast("binary"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_language_id, op2_near_vectors, op3_html_extraction, op4_ngram_jaccard_join, op5_suffix_dedup, op6_substring_dedup,
        op7_bpe, op8_quality, op9_decontamination, op10_token_counts, op11_ranked_search, op12_spelling_groups,
        op13_personal_data)}


def oracle_sql() -> dict[str, str]:
    return {"op2_near_vectors": oracles.OP2, "op4_ngram_jaccard_join": oracles.OP4, "op5_suffix_dedup": oracles.OP5,
            "op6_substring_dedup": oracles.OP6, "op11_ranked_search": oracles.OP11,
            "op12_spelling_groups": oracles.OP12}

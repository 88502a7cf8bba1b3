"""Sections, pages, overlapping chunks and document statistics.

A document is one row, so everything up to the chunks is a narrow transformation:
sections, pages and chunks are built as arrays inside the row and exploded once.
No shuffle, and page and chunk numbers are simply array positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.text import strip, words

PAGE_WORDS = 400
CHUNK_WORDS = 250
OVERLAP_WORDS = 40
SECTION_BREAK = r"\n(?=#{1,3}\s+)"
HEADER = r"^#{1,3}\s+(.+)"


def _sections(text: Column) -> Column:
    """array<struct<title, text>>; text without a header of its own is titled "General"."""
    parts = F.filter(F.transform(F.split(text, SECTION_BREAK), strip), lambda s: s != "")

    def titled(section: Column) -> Column:
        header = strip(F.regexp_extract(section, HEADER, 1))
        return F.struct(F.when(header != "", header).otherwise("General").alias("title"), section.alias("text"))

    return F.transform(parts, titled)


def _starts(n: Column, step: int) -> Column:
    """Where windows over ``n`` words begin; one at least."""
    return F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))


def _pages(sections: Column, page: Callable[[Column, Column, Column], Column]) -> Column:
    """``page(title, words, start)`` of each page, in document order; ``words`` are those of its section."""
    def of_section(section: Column) -> Column:
        # an array of one binds the words once; a transform copies what it returns, so they do not leave it
        return F.flatten(F.transform(F.array(words(section["text"])), lambda w: F.transform(
            _starts(F.size(w), PAGE_WORDS), lambda start: page(section["title"], w, start))))

    return F.flatten(F.transform(sections, of_section))


def _joined(all_words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(all_words, start + 1, n), " ")


def _chunks(sections: Column, size: int, overlap: int) -> Column:
    """array<struct<page, title, content, tokens>>, in document order. Each is cut from its section at once."""
    def page(title: Column, all_words: Column, start: Column) -> Column:
        n = F.least(F.size(all_words) - start, F.lit(PAGE_WORDS))
        starts = F.when(n <= size, F.array(F.lit(0))).otherwise(_starts(n, size - overlap))
        return F.transform(starts, lambda at: piece(title, all_words, start + at, F.least(n - at, F.lit(size))))

    def piece(title: Column, all_words: Column, start: Column, tokens: Column) -> Column:
        return F.struct(title.alias("title"), _joined(all_words, start, tokens).alias("content"), tokens.alias("tokens"))

    return F.flatten(F.transform(_pages(sections, page), lambda pieces, i: F.transform(pieces, lambda c: F.struct(
        (i + 1).alias("page"), c["title"].alias("title"), c["content"].alias("content"), c["tokens"].alias("tokens")))))


def split_sections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, section_index, section_title, section_text."""
    exploded = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(_sections(F.col(text))).alias("section_index", "_s"))
    return exploded.select("doc_id", "section_index", F.col("_s.title").alias("section_title"),
                           F.col("_s.text").alias("section_text"))


def paginate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Estimated pages of 400 words; page numbers run over the document."""
    pages = _pages(_sections(F.col(text)), lambda title, all_words, start: F.struct(
        title.alias("title"), _joined(all_words, start, F.lit(PAGE_WORDS)).alias("text")))
    exploded = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(pages).alias("_i", "_p"))
    return exploded.select("doc_id", (F.col("_i") + 1).alias("page_number"), F.col("_p.title").alias("section_title"),
                           F.col("_p.text").alias("page_text"))


def chunk_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_words: int = CHUNK_WORDS,
                    overlap_words: int = OVERLAP_WORDS) -> DataFrame:
    """One chunk per short page, else windows of ``chunk_words`` overlapping by ``overlap_words``."""
    # one expression: columns of their own for sections and pages would copy every word
    chunks = _chunks(_sections(F.col(text)), chunk_words, overlap_words)
    exploded = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(chunks).alias("chunk_index", "_c"))
    return exploded.select(
        F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        "doc_id", "chunk_index", F.col("_c.page").alias("page_number"), F.col("_c.title").alias("section_title"),
        F.col("_c.content").alias("content"), F.col("_c.tokens").alias("token_count"))


def document_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(
        F.max("page_number").alias("total_pages"), F.count(F.lit(1)).alias("total_chunks"),
        F.sum("token_count").alias("token_count"))


def citation(filename: Column, page: Column, section: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Source: "), filename), F.concat(F.lit("Page: "), page.cast("string")),
                       F.concat(F.lit("Section: "), F.coalesce(section, F.lit("General"))))


def replace_documents(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks after re-indexing: documents in ``fresh`` lose their old chunks."""
    renewed = fresh.select("doc_id").distinct()
    return chunks.join(renewed, "doc_id", "left_anti").unionByName(fresh)

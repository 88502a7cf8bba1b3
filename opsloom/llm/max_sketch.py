"""Ranked lexical search by hashed max-sketches (operator 11).

A document's sketch is an array of coordinates, as many as its different terms need. Every term's impact in the document goes
to the coordinate that the term hashes to, and a coordinate keeps the largest. A query reads the coordinates of its terms:
what it finds is never less than a term's own impact, so the weighted sum bounds the document's score from above. The bounds
of a slice of documents for all queries are one batched lookup and one segmented sum.

Documents are then scored exactly in descending order of their bounds, until a query's next bound is below the score that
its k-th best document has reached. The scores reached carry over from slice to slice of a task, so that most documents are
ruled out by their bounds alone. Every task returns its k best for each query, and the best of all are ranked by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.llm.words import U64, slices, split_words

#: Bytes of query text that one pass over the documents takes; more queries take several passes.
PASS_BYTES = 8 << 20
#: Coordinates for each different term of a document, so that few queries read a coordinate that is not their own.
ROOM = 16
#: Numbers held at once by sketches and by lookups.
CELLS = 1 << 22
#: Documents that a query scores exactly before it looks at its threshold again; doubled from round to round.
FIRST_ROUND = 32
PARTS = 64
IS_TERM = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    IS_TERM[_low:_high + 1] = True


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts (only A-Z lower-cased), and the first of each text."""
    words = split_words(texts, ~IS_TERM)
    return words.hashes(lower=True), words.first


@dataclass
class Queries:
    """Queries as (term, times) entries, grouped by query. ``weights`` has one weight a term."""

    ids: list[int | None]
    terms: np.ndarray   # different terms of all queries, sorted hashes
    query: np.ndarray   # each entry's query, ascending
    term: np.ndarray    # each entry's place in ``terms``
    times: np.ndarray
    weights: np.ndarray | None = None

    @staticmethod
    def build(rows: list[tuple[int | None, str | None]]) -> Queries:
        hashes, first = term_hashes(pa.array([text for _, text in rows], pa.string()))
        terms, term = np.unique(hashes, return_inverse=True)
        query = np.repeat(np.arange(len(rows)), np.diff(first))
        pairs, times = np.unique(np.stack([query, term], axis=1).astype(np.int64), axis=0, return_counts=True)
        return Queries([i for i, _ in rows], terms, pairs[:, 0], pairs[:, 1], times.astype(np.int64))


@dataclass
class Terms:
    """Different terms of each document of a slice, in the order of (document, hash)."""

    doc: np.ndarray
    hash: np.ndarray
    times: np.ndarray
    length: np.ndarray  # terms of each document, repeats included

    @staticmethod
    def of(texts: pa.Array) -> Terms:
        hashes, first = term_hashes(texts)
        length = np.diff(first)
        doc = np.repeat(np.arange(len(length)), length)
        order = np.lexsort((hashes, doc))
        hashes = hashes[order]
        new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else doc
        return Terms(doc[new], hashes[new], np.diff(np.append(new, len(doc))), length)

    def known(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that hold one of the sorted ``terms``, and which."""
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(terms, self.hash), len(terms) - 1)
        rows = np.flatnonzero(terms[at] == self.hash)
        return rows, at[rows]

    def impacts(self, documents: int, terms: int) -> np.ndarray:
        """What each row adds to a score for each unit of weight; ``documents`` and ``terms`` are those of the whole table."""
        m = 75 + (25 * self.length * documents) // max(1, terms)
        return (1_000_000_000 * self.times) // (1000 * self.times + 12 * m[self.doc])


def _statistics(queries):
    """Over texts: how many documents hold each query term (its place), documents with a term (-1), and all terms (-2)."""
    def run(batches):
        asked = queries.value
        holding, documents, terms = np.zeros(len(asked.terms), np.int64), 0, 0
        for part in (p for batch in batches for p in slices(batch)):
            found = Terms.of(part.column("text"))
            holding += np.bincount(found.known(asked.terms)[1], minlength=len(holding))
            documents, terms = documents + int((found.length > 0).sum()), terms + int(found.length.sum())
        held = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([held, [-1, -2]])), pa.array(np.concatenate([holding[held], [documents, terms]]))],
                                         ["term", "n"])
    return run


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def sketches(found: Terms, impacts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, their sketches), documents with as many coordinates together: the smallest power of two with ROOM
    coordinates for each different term. A term's coordinate is its hash modulo their number."""
    distinct = np.bincount(found.doc, minlength=len(found.length))
    first = np.cumsum(distinct) - distinct
    power = np.where(distinct > 0, np.ceil(np.log2(np.maximum(ROOM * distinct, 1))).astype(np.int64), -1)
    for p in np.unique(power[power >= 0]).tolist():
        width = 1 << p
        docs = np.flatnonzero(power == p)
        for some in (docs[i:i + max(1, CELLS // width)] for i in range(0, len(docs), max(1, CELLS // width))):
            n = distinct[some]
            of = np.repeat(np.arange(len(some)), n)
            rows = np.repeat(first[some], n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            folded = np.zeros((len(some), width), np.int64)
            np.maximum.at(folded.reshape(-1), of * width + (found.hash[rows] & U64(width - 1)).astype(np.int64), impacts[rows])
            yield some, folded


class Best:
    """The k best documents of each query so far: equal scores by ascending id, null ids last."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries = k, queries
        self.query, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        self.none = np.zeros(0, bool)
        self.threshold = np.ones(queries, np.int64)  # a score of 0 is no match

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        query, score, doc, none = (np.concatenate(pair) for pair in zip((self.query, self.score, self.doc, self.none), (query, score, doc, none)))
        order = np.lexsort((doc, none, -score, query))
        order = order[score[order] > 0]
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order], side="left")
        order, place = order[place < self.k], place[place < self.k]
        self.query, self.score, self.doc, self.none = query[order], score[order], doc[order], none[order]
        full = place == self.k - 1
        self.threshold[self.query[full]] = self.score[full]


class Scorer:
    """Exact scores of pairs of a slice."""

    def __init__(self, asked: Queries, found: Terms, impacts: np.ndarray):
        rows, term = found.known(asked.terms)
        self.asked, self.impacts = asked, impacts[rows]
        self.keys = found.doc[rows] * len(asked.terms) + term
        self.first = np.searchsorted(asked.query, np.arange(len(asked.ids) + 1))

    def scores(self, doc: np.ndarray, query: np.ndarray) -> np.ndarray:
        n = np.diff(self.first)[query]
        pair = np.repeat(np.arange(len(doc)), n)
        entry = np.repeat(self.first[query], n) + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        key = doc[pair] * len(self.asked.terms) + self.asked.term[entry]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        held = self.keys[at] == key
        pair, entry, at = pair[held], entry[held], at[held]
        total = np.zeros(len(doc), np.int64)
        np.add.at(total, pair, self.asked.weights[self.asked.term[entry]] * self.asked.times[entry] * self.impacts[at])
        return total


def bounds(asked: Queries, folded: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, upper bounds (documents, queries)) for as many queries at once as the lookups leave room for. Queries
    without terms are left out at the ends, and bounded by 0 between."""
    first = np.searchsorted(asked.query, np.arange(len(asked.ids) + 1))
    at, queries = 0, len(asked.ids)
    coordinate = (asked.terms & U64(folded.shape[1] - 1)).astype(np.int64)[asked.term]
    factor = (asked.weights[asked.term] * asked.times)
    while at < queries:
        room = first[at] + max(1, CELLS // len(folded))
        to = max(at + 1, int(np.searchsorted(first, room, side="right")) - 1)
        entries = slice(first[at], first[to])
        looked = folded[:, coordinate[entries]] * factor[entries]
        # a last column of zeros, so that queries without terms at the end have a place to start
        looked = np.concatenate([looked, np.zeros((len(folded), 1), np.int64)], axis=1)
        total = np.add.reduceat(looked, first[at:to] - first[at], axis=1)
        total[:, first[at + 1:to + 1] == first[at:to]] = 0
        yield at, total
        at = to


def _ranked(queries, statistics, k: int, counters=None):
    def run(batches):
        asked = queries.value
        documents, terms = statistics
        best = Best(len(asked.ids), k)
        for part in (p for batch in batches for p in slices(batch)):
            column = part.column("doc_id")
            ids, none = column.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(column.is_null())
            found = Terms.of(part.column("text"))
            if not len(found.doc):
                continue
            impacts = found.impacts(documents, terms)
            scorer = Scorer(asked, found, impacts)
            if not len(scorer.keys):
                continue
            for docs, folded in sketches(found, impacts):
                for at, upper in bounds(asked, folded):
                    _rescore(best, scorer, docs, ids, none, at, upper)
        yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array([asked.ids[q] for q in best.query.tolist()], pa.int64()),
                                          pa.array(best.doc, mask=best.none), pa.array(best.score)], ["query", "item_id", "doc_id", "score"])
    return run


def _rescore(best: Best, scorer: Scorer, docs: np.ndarray, ids: np.ndarray, none: np.ndarray, at: int, upper: np.ndarray) -> int:
    """Scores documents in descending order of their bounds until the bounds are below the thresholds; returns how many
    pairs were scored."""
    row, query = np.nonzero(upper >= best.threshold[at:at + upper.shape[1]])
    bound = upper[row, query]
    order = np.lexsort((-bound, query))
    row, query, bound = row[order], query[order] + at, bound[order]
    place = np.arange(len(row)) - np.searchsorted(query, query, side="left")
    low, step, scored = 0, FIRST_ROUND, 0
    while len(row):
        now = place < low + step
        doc = docs[row[now]]
        best.add(query[now], scorer.scores(doc, query[now]), ids[doc], none[doc])
        scored += int(now.sum())
        low, step = low + step, 2 * step
        left = ~now & (bound >= best.threshold[query])
        row, query, bound, place = row[left], query[left], bound[left], place[left]
    return scored


def _passes(items: DataFrame):
    """Queries in parts of about PASS_BYTES of text. Every row is a query of its own, repeated rows too."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // PASS_BYTES))
    for k in range(passes):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).orderBy("item_id", "text").collect()
        yield k, Queries.build([tuple(r) for r in rows])


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 for each item (all, if fewer), ranked from 1,
    equal scores by ascending doc_id.

    Terms are maximal runs of ASCII letters, digits and non-ASCII characters, only A-Z lower-cased. A term's weight is
    floor(1000 ln((2 N + 2) / (2 df + 1))) for N documents with a term, df of which hold it; a document adds
    w * (10**9 tf div (1000 tf + 12 m)) for each of the item's terms, repeats included, with m = 75 + 25 n N div L for n terms in the
    document and L in all. All but the logarithm is 64-bit integer arithmetic, and the result is exact but for collisions of
    64-bit hashes of terms.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are not read. Null and empty texts have no terms:
    such documents count nowhere and are never found, such items have no rows. A null doc_id is ranked behind others of equal
    score. Rows that share a doc_id are documents of their own, rows that share an item_id queries of their own, each with
    its ranks. An empty table on either side gives an empty result. Texts are taken whole.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    parts = []
    for number, queries in _passes(items):
        sent = spark.sparkContext.broadcast(queries)
        counts = dict(docs.mapInArrow(_statistics(sent), "term long, n long").groupBy("term").agg(F.sum("n")).collect())
        documents, terms = counts.get(-1, 0), counts.get(-2, 0)
        queries.weights = np.array([weight(documents, counts.get(t, 0)) for t in range(len(queries.terms))], np.int64)
        found = docs.mapInArrow(_ranked(spark.sparkContext.broadcast(queries), (documents, terms), k),
                                "query long, item_id long, doc_id long, score long")
        parts.append(found.withColumn("pass", F.lit(number)))
    found = reduce(DataFrame.unionByName, parts).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    # the best of some tasks first, so that no query's rows of all tasks meet in one
    for keys in (["pass", "query", "part"], ["pass", "query"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")

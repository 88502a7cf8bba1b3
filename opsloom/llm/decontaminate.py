"""Benchmark decontamination with SimHash windows and a multi-index (operator 9).

Each document is read in windows as long as a benchmark item. The SimHash of a window is looked up among those of the
items of that length: the 64 bits are cut into four blocks, and of two fingerprints within the radius at least one block
differs in at most a quarter of the radius, so looking up all block values that near finds every fingerprint within the
radius. Candidates are verified by the exact weighted similarity of five-word shingles.

Only windows that could pass the verification are fingerprinted: the shingles that they share with items of their length
must make up the threshold's share of their weight, which running sums tell for every window of a document at once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.tables import filter_rows
from opsloom.llm.words import U64, slices, split_words, word_windows

SHINGLE = 5
BITS, BLOCKS = 64, 4
#: Two windows at a similarity of 0.8 differ in 9.7 bits on average, with a deviation of 2.9.
RADIUS = 19
#: Bytes of benchmark text that one pass over the documents takes; a larger benchmark takes several passes.
PASS_BYTES = 32 << 20
BIT = U64(1) << np.arange(BITS, dtype=U64)


def simhash(hashes: np.ndarray, weights: np.ndarray) -> np.uint64:
    """64 bits: for each, the sign of the weighted vote of the shingles' hashes."""
    votes = np.where((hashes[:, None] & BIT) != 0, weights[:, None], -weights[:, None]).sum(axis=0)
    return (BIT[votes > 0]).sum(dtype=U64)


def weighted_similarity(left: dict[int, float], right: dict[int, float]) -> float:
    """Sum of the smaller over sum of the larger weights of all shingles."""
    low = sum(min(w, right[s]) for s, w in left.items() if s in right)
    high = sum(left.values()) + sum(right.values()) - low
    return low / high if high else 0.0


def bag(hashes: np.ndarray, weights: np.ndarray) -> dict[int, float]:
    found: Counter = Counter()
    for h, w in zip(hashes.tolist(), weights.tolist()):
        found[h] += w
    return dict(found)


def _near(bits: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in chosen) for k in range(radius + 1) for chosen in combinations(range(bits), k)], U64)


class MultiIndex:
    """All fingerprints within a Hamming radius, by lookups of blocks."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius, self.width = prints, radius, BITS // BLOCKS
        self.masks = _near(self.width, radius // BLOCKS)
        self.tables = []
        for block in range(BLOCKS):
            values = self._block(prints, block)
            order = np.argsort(values, kind="stable")
            self.tables.append((values[order], order))
        self._present: list[np.ndarray] = []  # of each block: a bit for each of its values that occurs; made where it is used

    def _block(self, prints: np.ndarray, block: int) -> np.ndarray:
        return (prints >> U64(block * self.width)) & U64((1 << self.width) - 1)

    def within(self, one: np.uint64) -> np.ndarray:
        """Numbers of the fingerprints within the radius of ``one``."""
        if not self._present:
            for values, _ in self.tables:
                self._present.append(np.zeros(1 << self.width - 3, np.uint8))
                np.bitwise_or.at(self._present[-1], values >> U64(3), np.uint8(1) << (values & U64(7)).astype(np.uint8))
        found = []
        for block, (values, order) in enumerate(self.tables):
            wanted = self._block(np.array([one], U64), block)[0] ^ self.masks
            wanted = wanted[self._present[block][wanted >> U64(3)] >> (wanted & U64(7)).astype(np.uint8) & 1 == 1]
            low, high = np.searchsorted(values, wanted), np.searchsorted(values, wanted, side="right")
            found.extend(order[a:b] for a, b in zip(low[high > low], high[high > low]))
        if not found:
            return np.zeros(0, np.int64)
        near = np.unique(np.concatenate(found))
        return near[np.bitwise_count(self.prints[near] ^ one) <= self.radius]


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, hash, weight) of all five-word shingles, and the word counts. A shingle weighs as many bytes as
    its words have; texts of 1 to 4 words have one shingle."""
    words = split_words(texts)
    text, at, hashes = word_windows(words.hashes(lower=True), words.first, SHINGLE)
    sizes = np.concatenate([[0], np.cumsum(words.end - words.start)])
    weights = sizes[np.minimum(at + SHINGLE, words.first[1:][text])] - sizes[at]
    return text, at - words.first[text], hashes, weights.astype(np.float64), words.counts


@dataclass
class Items:
    """Benchmark items of one pass; at most about PASS_BYTES of text."""

    ids: list[int]
    words: np.ndarray
    bags: list[dict[int, float]]
    known: np.ndarray  # sorted shingles of all items
    sizes_of: tuple[np.ndarray, np.ndarray]  # of each known shingle: the word counts of the items that hold it, and where they start
    by_size: dict[int, tuple[np.ndarray, MultiIndex]]

    @staticmethod
    def build(rows: list[tuple[int, str]], radius: int) -> Items:
        text, _, hashes, weights, words = shingles(pa.array([r[1] for r in rows], pa.string()))
        cuts = np.searchsorted(text, np.arange(len(rows) + 1))
        parts = [(hashes[a:b], weights[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        prints = np.array([simhash(*p) for p in parts], U64)
        by_size = {int(m): (np.flatnonzero(words == m), MultiIndex(prints[words == m], radius)) for m in np.unique(words) if m}
        known, at = np.unique(hashes, return_inverse=True)
        pairs = np.unique(np.stack([at, words[text]]), axis=1)
        sizes_of = pairs[1], np.searchsorted(pairs[0], np.arange(len(known) + 1))
        return Items([r[0] for r in rows], words, [bag(*p) for p in parts], known, sizes_of, by_size)

    def matches(self, n: int, hashes: np.ndarray, weights: np.ndarray, hit: np.ndarray, known: np.ndarray, threshold: float
                ) -> dict[int, tuple[float, int]]:
        """Of one text with ``n`` words: item number -> (best similarity, first word of the first such window). ``hit``:
        places of shingles that some item holds, ``known``: their numbers among these."""
        found: dict[int, tuple[float, int]] = {}
        all_sum = np.concatenate([[0], np.cumsum(weights)])
        sizes, first = self.sizes_of
        counts = first[known + 1] - first[known]
        place = np.repeat(hit, counts)
        size = sizes[np.arange(len(place)) + np.repeat(first[known] - (np.cumsum(counts) - counts), counts)]
        for m in np.unique(size).tolist():
            if (m < SHINGLE or n < SHINGLE) and m != n:
                continue
            numbers, index = self.by_size[m]
            length = max(1, min(m, n) - SHINGLE + 1)
            starts = np.arange(len(hashes) - length + 1)
            own_weights = np.zeros(len(hashes))
            here = place[size == m]
            own_weights[here] = weights[here]
            hit_sum = np.concatenate([[0], np.cumsum(own_weights)])
            share = hit_sum[starts + length] - hit_sum[starts]
            # rounding must not lose a window
            for x in np.flatnonzero(share >= threshold * (all_sum[starts + length] - all_sum[starts]) - 1e-6):
                window = slice(int(x), int(x) + length)
                own = None
                for k in index.within(simhash(hashes[window], weights[window])):
                    own = own or bag(hashes[window], weights[window])
                    item = int(numbers[k])
                    similarity = weighted_similarity(own, self.bags[item])
                    if similarity >= threshold and similarity > found.get(item, (0.0, 0))[0]:
                        found[item] = (similarity, int(x))
        return found


def _found(batches, items: Items, threshold: float):
    """(slice, row, matches) of each row with a match, and (slice, -1, {}) after each slice."""
    for batch in batches:
        for part in slices(batch):
            text, _, hashes, weights, counts = shingles(part.column("text"))
            at = np.minimum(np.searchsorted(items.known, hashes), max(len(items.known) - 1, 0))
            hit = items.known[at] == hashes if len(items.known) else np.zeros(len(hashes), bool)
            cuts = np.searchsorted(text, np.arange(part.num_rows + 1))
            for i in np.unique(text[hit]).tolist():
                rows = slice(cuts[i], cuts[i + 1])
                places = np.flatnonzero(hit[rows])
                if found := items.matches(int(counts[i]), hashes[rows], weights[rows], places, at[rows][places], threshold):
                    yield part, i, found
            yield part, -1, {}


def _matched(items, threshold: float):
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())

    def run(batches):
        out = []
        for part, i, found in _found(batches, items.value, threshold):
            if i >= 0:
                doc = part.column("doc_id")[i].as_py()
                out.extend((doc, items.value.ids[k], s, x) for k, (s, x) in sorted(found.items()))
            elif out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)],
                                                 ["doc_id", "item_id", "similarity", "first_word"])
                out = []
    return run


def _clean(items, threshold: float):
    def run(batches):
        gone = []
        for part, i, _ in _found(batches, items.value, threshold):
            if i >= 0:
                gone.append(i)
            else:
                keep = np.ones(part.num_rows, bool)
                keep[gone] = False
                yield part, keep
                gone = []
    return run


def _passes(benchmark: DataFrame, radius: int):
    """The benchmark's items, broadcast in parts of about PASS_BYTES of text."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).filter("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // PASS_BYTES))
    for k in range(passes):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).distinct().orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(Items.build([tuple(r) for r in rows], radius))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, first_word: the benchmark items that each document holds, with the best similarity of an
    item-sized window and where the first such window starts.

    Texts are compared in lower case. Items with fewer than five words only match a document that is that
    sequence; a document shorter than an item is one window. Null and empty texts match nothing; null ids of items are
    kept as such. Rows that share a doc_id (or item_id) give one row with the best of them. An empty table on either side
    gives an empty result. Texts are taken whole; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text")).filter("text IS NOT NULL")
    parts = [docs.mapInArrow(_matched(items, threshold), "doc_id long, item_id long, similarity double, first_word long")
             for items in _passes(benchmark, radius)]
    found = reduce(DataFrame.unionByName, parts)
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("at")))
    return (found.groupBy("doc_id", "item_id").agg(best.alias("best"))
            .select("doc_id", "item_id", "best.similarity", (-F.col("best.at")).alias("first_word")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, unchanged and with all their columns, that hold no benchmark item; matches, nulls and empty
    tables as in ``contaminated``."""
    for items in _passes(benchmark, radius):
        docs = filter_rows(docs, _clean(items, threshold), F.lower)
    return docs

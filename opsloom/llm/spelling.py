"""Groups spelling variants by dense prefix-suffix tiling (operator 12).

Words that differ by one edit have all but one segment of their letters in common: with the longer word cut into three
segments, the edit lies in one of them, and what stands before and after it is the same in both words. So a word is dealt,
for its own length and for the length of words one longer, to one group for each segment, named by the rest of the word.
A group becomes a dense tile: code points in matrices padded on the right and on the left, the common prefix of every pair
counted along the first and its common suffix along the second. A pair is one edit apart where both together reach the
longer length minus one; it counts in the tile of the segment that its common prefix ends in, so each pair counts once.
Groups beyond ``BLOCK`` words are dealt into blocks, and every pair of blocks is a tile of its own.

Only sums and the best neighbour of each word leave a tile, never its pairs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.words import slices
from opsloom.session import cut_lineage

SEGMENTS = 3
#: Words of a group that are compared as one tile; larger groups are compared by pairs of blocks of about this size.
BLOCK = 1024
#: Pairs that are held in memory at once.
PAIRS = 1 << 21
#: Different words that a task counts before it hands them on.
HELD_WORDS = 300_000
LETTERS = "A-Za-zÀ-ÿ"
TILE_ROWS = "word string, n_near long, best_n long, best string"


def vary(prefix: int, word: str, every: int) -> str:
    """``word`` without one code point where ``every`` divides h, the crc32 of a document's prefix carried on over it."""
    h = crc32(word.encode(), prefix)
    return word if h % every else word[:h % len(word)] + word[h % len(word) + 1:]


def _counted(least: int, every: int | None):
    runs = re.compile(f"[{LETTERS}]{{{least},}}")

    def rows(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    def run(batches):
        found: Counter = Counter()
        for part in (p for batch in batches for p in slices(batch)):
            for doc, text in zip(part.column("doc").to_pylist(), pc.ascii_lower(part.column("text")).to_pylist()):
                here = Counter(runs.findall(text))
                if every is None:
                    found.update(here)
                else:
                    prefix = crc32(f"{doc}:".encode())
                    for word, n in here.items():
                        word = vary(prefix, word, every)
                        if len(word) >= least:
                            found[word] += n
                if len(found) > HELD_WORDS:
                    yield rows(found)
                    found = Counter()
        yield rows(found)
    return run


def word_counts(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int | None = None) -> DataFrame:
    """word, n: the words of all texts with at least ``least_length`` letters and ``least_count`` occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with only A-Z lower-cased. With ``every``, an occurrence loses a
    letter where ``every`` divides h = crc32("<doc_id>:<word>"), the one at h modulo its length (a null doc_id is empty text).
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text"))
    counted = texts.filter("text IS NOT NULL").mapInArrow(_counted(least_length, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _groups(word: str = "word") -> Column:
    """For each group of a word: its key, the length c of the longer words in it, and the segment's first and last place."""
    each = []
    for extra in (0, 1):
        for segment in range(SEGMENTS):
            c = f"(char_length({word}) + {extra})"
            lo, hi = f"({c} * {segment} div {SEGMENTS})", f"({c} * {segment + 1} div {SEGMENTS})"
            rest = f"substring({word}, 1, int({lo})), substring({word}, int(char_length({word}) - ({c} - {hi}) + 1))"
            each.append(F.expr(f"struct(xxhash64({c}, {segment}, {rest}) AS key, CAST({c} AS BIGINT) AS c, {lo} AS lo, {hi} AS hi)"))
    return F.array(*each)


def _matrices(words: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words of at most ``c`` letters, padded on the right and on the left, and their lengths."""
    left = np.ascontiguousarray(words.astype(f"U{c}")).view(np.uint32).reshape(len(words), c)
    lengths = (left != 0).sum(axis=1)
    right = np.take_along_axis(left, (np.arange(c)[None, :] - (c - lengths)[:, None]) % c, axis=1)  # the pad goes in front
    return left, right, lengths


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places that the rows of ``a`` and ``b`` have in common from the first on: (tiles, rows of a, rows of b)."""
    alive = np.ones((a.shape[0], a.shape[1], b.shape[1]), bool)
    common = np.zeros(alive.shape, np.int32)
    for j in range(a.shape[2]):
        alive &= a[:, :, None, j] == b[:, None, :, j]
        if not alive.any():
            break
        common += alive
    return common


def compare(words: np.ndarray, rank: np.ndarray, side: np.ndarray, used: np.ndarray, c: int, lo: np.ndarray, hi: np.ndarray,
            cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense comparison of tiles of one shape. ``words``, ``rank``, ``side`` and ``used`` are (tiles, rows); the rest is one
    value a tile, but ``c``, the longer length. In a ``cross`` tile only rows of different sides are compared. Returns for
    each row the number of near rows and the least rank among them (the largest integer if there is none)."""
    tiles, m = words.shape
    left, right, lengths = _matrices(words.ravel(), c)
    left, right, lengths = left.reshape(tiles, m, c), right[:, ::-1].reshape(tiles, m, c), lengths.reshape(tiles, m)
    none = np.iinfo(np.int64).max
    counts, best = np.zeros((tiles, m), np.int64), np.full((tiles, m), none)
    strip = max(1, PAIRS // (tiles * m))
    for at in range(0, m, strip):
        rows = slice(at, at + strip)
        prefix = _common(left[:, rows], left)
        near = prefix + _common(right[:, rows], right) >= c - 1
        near &= used[:, rows, None] & used[:, None, :]
        near &= (lengths[:, rows, None] == c) | (lengths[:, None, :] == c)  # two shorter words meet in their own group
        near &= (prefix >= lo[:, None, None]) & (prefix < hi[:, None, None])
        near &= ~cross[:, None, None] | (side[:, rows, None] != side[:, None, :])
        near &= prefix < np.maximum(lengths[:, rows, None], lengths[:, None, :])  # not the word itself
        counts[:, rows] = near.sum(axis=2)
        best[:, rows] = np.where(near, rank[:, None, :], none).min(axis=2)
    return counts, best


def _compared(key: np.ndarray, word: np.ndarray, n: np.ndarray, side: np.ndarray, c: np.ndarray, lo: np.ndarray, hi: np.ndarray,
              cross: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Whole tiles, rows in the order of their keys: those of one length and about one size are compared together."""
    order = np.lexsort((word, -n))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(first, len(key)))
    shape = np.where(sizes > 1, np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64), 0)
    for width, power in sorted({(int(w), int(p)) for w, p in zip(c[first], shape) if p}):
        chosen = np.flatnonzero((c[first] == width) & (shape == power))
        m = int(sizes[chosen].max())
        step = max(1, PAIRS // max(m * m, m * width))
        for tiles in (chosen[i:i + step] for i in range(0, len(chosen), step)):
            used = np.arange(m)[None, :] < sizes[tiles][:, None]
            at = np.where(used, first[tiles][:, None] + np.arange(m)[None, :], first[tiles][:, None])
            head = first[tiles]
            counts, best = compare(word[at], rank[at], side[at], used, width, lo[head], hi[head], cross[head])
            found = counts > 0
            if found.any():
                rows, other = at[found], order[best[found]]
                yield pa.RecordBatch.from_arrays([pa.array(word[rows], pa.string()), pa.array(counts[found]), pa.array(n[other]),
                                                  pa.array(word[other], pa.string())], ["word", "n_near", "best_n", "best"])


def _tiles(batches):
    """Over rows sorted by tile: the near words of each row. What is held is one batch and the tile that it ends in."""
    names = ("tile", "word", "n", "side", "c", "lo", "hi", "cross")
    held = None
    for batch in batches:
        now = [batch.column(x).to_numpy(zero_copy_only=False) for x in names]
        now[1] = now[1].astype(str)
        if held is not None:
            now = [np.concatenate(pair) for pair in zip(held, now)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1], side="left"))
        held = [x[cut:] for x in now]
        if cut:
            yield from _compared(*(x[:cut] for x in now))
    if held is not None:
        yield from _compared(*held)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, best_n, best: for each word that has near words, their number and the one of largest n (ties: the
    smallest in code-point order). ``words`` has different words and their n. Two words are near if one insertion, deletion
    or replacement of a code point leads from one to the other."""
    dealt = cut_lineage(words.select("word", "n", F.explode(_groups()).alias("g")).select("word", "n", "g.*"))
    sizes = (dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.char_length("word") == F.col("c")).alias("full"))
             .filter("size > 1 AND full").select("key", "size"))
    rows = cut_lineage(dealt.join(sizes, "key"))
    row = ["word", "n", "c", "lo", "hi"]
    small = rows.filter(F.col("size") <= block).select(F.col("key").alias("tile"), F.lit(0).alias("side"), F.lit(False).alias("cross"), *row)
    blocks = F.ceil(F.col("size") / block).cast("int")
    large = (rows.filter(F.col("size") > block).withColumn("side", F.pmod(F.xxhash64("word", F.lit(1)), blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select(F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")).alias("tile"), "side",
                     (F.col("side") != F.col("other")).alias("cross"), *row))
    tiles = [t.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles, TILE_ROWS) for t in (small, large)]
    best = F.min(F.struct((-F.col("best_n")).alias("order"), "best"))
    found = tiles[0].unionByName(tiles[1]).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.order")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: forms followed to the last. Every round doubles the steps that are followed; n grows along them, so there
    is no way back."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("of"), F.col("root").alias("next"))
        moved = cut_lineage(now.join(onward, F.col("root") == F.col("of"), "left")
                            .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return now


def spelling_groups(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, every: int | None = None,
                    block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of ``word_counts``: the near word of largest n if that is at least
    ``ratio`` times the word's own (else null), where following forms ends (the word itself if it has none), occurrences of
    the word, number of near words, and occurrences of the form.

    ``docs`` has doc_id and text; other columns are not read. Null and empty texts have no words; rows that are repeated or
    share a doc_id count each; an empty table, or one without words frequent enough, gives an empty result. Among near words
    with equal n the smallest in code-point order is the form. Texts are taken whole, words of any length; all are compared.
    """
    words = cut_lineage(word_counts(docs, least_length, least_count, every))
    near = near_words(words, block)
    found = (words.join(near, "word", "left")
             .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best", "best_n")
             .withColumn("follows", F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False)))
             .select("word", F.when(F.col("follows"), F.col("best")).alias("form"), "n", "n_near",
                     F.when(F.col("follows"), F.col("best_n")).alias("form_n")))
    found = cut_lineage(found)
    return (found.join(_roots(found.filter("form IS NOT NULL")), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))

"""Substring dedup with difference-cover anchors (operator 6).

A difference cover modulo v holds, for any two residues, a common shift that takes both into the cover. So two equal
windows of ``size`` words share an aligned anchor: a run of size - v + 1 words that starts at a cover position in both.
Only runs at cover positions are hashed and shuffled.

Anchors that occur in several documents are extended in two steps. First to the reach of all windows around the anchor:
where a smaller document has the same reach, every window in it is removed at once. What is left (the ends of matches)
is extended window by window. Equal rows of a batch leave it once, so a passage in a third of all documents does not
gather in one task.

Ranges, lo to hi, are of window starts and not of words: ranges that are known from different smaller documents are joined
where they touch, and no window may come to lie in a joined range that was in none of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom.llm.words import U64, Rolling, mix, signed, slices, split_words
from opsloom.session import cut_lineage

#: Perfect difference sets: every non-zero residue is a difference of two elements exactly once. Fixed values.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
ROWS = "key long, u long, doc long, lo long, hi long"
RANGES = "doc long, lo long, hi long, fine boolean"


def period_for(size: int) -> int:
    """The longest period that leaves anchors of at least two fifths of a window (and of one word)."""
    fitting = [v for v in COVERS if size - v + 1 >= max(1, 2 * size // 5)]
    return max(fitting) if fitting else 1


def cover_positions(counts: np.ndarray, first: np.ndarray, size: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, word) of each cover position where an anchor fits; only texts with at least one window."""
    cover = np.array(COVERS.get(period, (0,)))
    per_text = np.where(counts >= size, counts - (size - period + 1) + 1, 0)
    text = np.repeat(np.arange(len(counts)), per_text)
    at = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    keep = np.isin(at % period, cover)
    return text[keep], at[keep]


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each document with overlapping and touching ones joined."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    number = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    top = int(hi.max()) + 1
    reach = np.maximum.accumulate(hi + number * top) - number * top
    start = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] > reach[:-1])])
    end = np.append(np.flatnonzero(start)[1:] - 1, len(doc) - 1)
    return doc[start], lo[start], reach[end]


def combined(key: np.ndarray, u: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Batches for the shuffle: of equal (key, u) only those of the smallest document; the others' ranges are known to be
    removed and pass as rows with null u."""
    order = np.lexsort((doc, u, key))
    key, u, doc, lo, hi = key[order], u[order], doc[order], lo[order], hi[order]
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (u[1:] != u[:-1])])) if len(key) else np.zeros(0, int)
    least = np.repeat(doc[start], np.diff(np.append(start, len(key))))
    out = doc > least
    ship = np.flatnonzero(~out)
    for at in range(0, len(ship), 200_000):
        rows = ship[at:at + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(signed(key[rows])), pa.array(signed(u[rows])), pa.array(doc[rows]),
                                          pa.array(lo[rows]), pa.array(hi[rows])], ["key", "u", "doc", "lo", "hi"])
    gone, a, b = merged(doc[out], lo[out], hi[out])
    if len(gone):
        yield pa.RecordBatch.from_arrays([pa.array(signed(mix(gone.view(U64), 3))), pa.nulls(len(gone), pa.int64()),
                                          pa.array(gone), pa.array(a), pa.array(b)], ["key", "u", "doc", "lo", "hi"])


def _anchors(size: int, period: int):
    length, back = size - period + 1, period - 1

    def run(batches):
        for batch in batches:
            found = []
            for part in slices(batch):
                words = split_words(part.column("text"))
                counts, ids = words.counts, part.column("doc").to_numpy(zero_copy_only=False)
                rolled = Rolling(words.hashes())
                text, at = cover_positions(counts, words.first, size, period)
                base, n = words.first[text], counts[text]
                lo, hi = np.maximum(at - back, 0), np.minimum(at, n - size) + 1
                # the anchor's place in its reach is part of the reach's hash
                reach = mix(rolled.windows(base + lo, base + hi + size - 1) + (at - lo).astype(U64), 4)
                found.append((rolled.windows(base + at, base + at + length), reach, ids[text], lo, hi))
            if found:
                yield from combined(*map(np.concatenate, zip(*found)))
    return run


def _removed(fine: bool):
    """Over rows sorted by key, u and doc: ranges to remove (a smaller document has the same u), and with ``fine`` the
    ranges of the smallest document of each u where the key has several u."""
    def run(batches):
        held = [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)]  # rows of the last key carried on; the last: already told
        for batch in batches:
            if not batch.num_rows:
                continue
            passing = np.asarray(batch.column("u").is_null())
            cols = [batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("key", "u", "doc", "lo", "hi")]
            out = [[c[passing] for c in cols[2:]]]
            now = [np.concatenate([h, c[~passing]]) for h, c in zip(held, cols)]
            told = np.concatenate([held[5], np.zeros(len(now[0]) - len(held[5]), bool)])
            key, u, doc, lo, hi = now
            asked = np.zeros(0, int)
            if len(key):
                new_key = np.concatenate([[True], key[1:] != key[:-1]])
                new_u = new_key | np.concatenate([[True], u[1:] != u[:-1]])
                starts = np.flatnonzero(new_u)
                least = np.repeat(doc[starts], np.diff(np.append(starts, len(key))))
                gone = (doc > least) & ~told
                out.append([c[gone] for c in (doc, lo, hi)])
                key_starts = np.flatnonzero(new_key)
                runs = np.add.reduceat(new_u.astype(int), key_starts)
                several = np.repeat(runs, np.diff(np.append(key_starts, len(key)))) > 1
                if fine:
                    asked = np.flatnonzero((doc == least) & several & ~told)
                # of the last key: the first row of its first and last run, and what may yet be asked for
                last = key_starts[-1]
                keep = np.zeros(len(key), bool)
                keep[[last, starts[-1]]] = True
                if fine and runs[-1] == 1:
                    keep[last:] |= doc[last:] == least[last:]
                held = [c[keep] for c in now] + [(told | several | (not fine))[keep]]
            doc2, lo2, hi2 = merged(*map(np.concatenate, zip(*out)))
            want, a, b = merged(doc[asked], lo[asked], hi[asked]) if len(asked) else (doc2[:0], lo2[:0], hi2[:0])
            if len(doc2) or len(want):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([doc2, want])), pa.array(np.concatenate([lo2, a])), pa.array(np.concatenate([hi2, b])),
                     pa.array(np.arange(len(doc2) + len(want)) >= len(doc2))], ["doc", "lo", "hi", "fine"])
    return run


def _windows(size: int):
    """Window rows of the ranges that are asked for, without the windows that a smaller document is known to hold."""
    def run(batches):
        for batch in batches:
            found = []
            for part in slices(batch):
                words = split_words(part.column("text"))
                rolled, ids = Rolling(words.hashes()), part.column("doc").to_numpy(zero_copy_only=False)
                ranges = part.column("ranges").to_pylist()
                for i, n in enumerate(words.counts):
                    mark = np.zeros(n + 1, np.int64)
                    for r in ranges[i]:
                        if r["fine"] and r["lo"] + size <= n:
                            mark[r["lo"]] += 1
                            mark[min(r["hi"], n - size + 1)] -= 1
                    wanted = np.cumsum(mark) > 0
                    for r in ranges[i]:
                        if not r["fine"]:
                            wanted[r["lo"]:max(r["lo"], min(r["hi"], n - size + 1))] = False
                    at = np.flatnonzero(wanted)
                    hashes = rolled.windows(words.first[i] + at, words.first[i] + at + size)
                    # the second code, of the same words by another sum, makes 128 bits
                    found.append((hashes, ids[i], at, words.first[i] + at))
                if found and len(found[-1]) == 4:
                    second = Rolling(mix(words.hashes(), 21))
                    found = [f if len(f) == 5 else (f[0], second.windows(f[3], f[3] + size), np.full(len(f[2]), f[1]), f[2], f[2] + 1)
                             for f in found]
            if found:
                yield from combined(*map(np.concatenate, zip(*found)))
    return run


def _kept(size: int):
    """The words that no window of the ranges covers."""
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            n_words, n_removed, kept = [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                words = (text or "").encode().split()  # the six white-space bytes
                n_words.append(len(words))
                gone = 0
                if ranges and words:
                    mark = np.zeros(len(words) + 1, np.int64)
                    for r in ranges:
                        if r["lo"] < len(words):
                            mark[r["lo"]] += 1
                            mark[min(r["hi"] + size - 1, len(words))] -= 1
                    out = np.cumsum(mark[:-1]) > 0
                    gone = int(out.sum())
                    words = [words[i] for i in np.flatnonzero(~out)]
                n_removed.append(gone)
                kept.append(b" ".join(words).decode())
            rest = [batch.column(c) for c in batch.schema.names if c not in ("text", "ranges")]
            names = [c for c in batch.schema.names if c not in ("text", "ranges")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(kept, pa.string())], [*names, "n_words", "n_removed", "kept_text"])
    return run


def remove_repeated_windows(docs: DataFrame, size: int = 50, period: int | None = None, rows: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of each document: the words left when each word is removed that a window
    of ``size`` words covers whose words also start in a document with a smaller doc_id.

    ``docs`` has doc_id and text; other columns are not read. Windows are judged on the input, words are compared
    unchanged, kept words are joined by one space. Null and empty texts have no words. Documents with fewer than ``size``
    words keep all. Rows with null doc_id keep all their words and are no one's earlier copy. Rows that share a doc_id do
    not remove from each other; what is removed from one of them is removed from all. Texts are taken whole. With ``rows``
    there is a further column ``row``, the input row with all its columns.
    """
    period = period or period_for(size)
    # without nulls in the key, both joins below read the same shuffle of the texts
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("doc"), F.col("doc_id").isNull().alias("no_id"),
                        F.col("text").cast("string").alias("text"),
                        *([F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")] if rows else []))
    whole = ["row"] if rows else []
    anchors = keyed.filter("NOT no_id AND text IS NOT NULL").select("doc", "text").mapInArrow(_anchors(size, period), ROWS)
    ranges = cut_lineage(anchors.repartition("key").sortWithinPartitions("key", "u", "doc").mapInArrow(_removed(True), RANGES))
    by_doc = lambda df, fine: df.groupBy("doc").agg(  # noqa: E731  as many as a document's words at most
        F.collect_list(F.struct("lo", "hi", *fine)).alias("ranges"), F.max("fine").alias("any_fine"))
    asked = by_doc(ranges, ["fine"]).filter("any_fine").select(F.col("doc").alias("of"), "ranges")
    texts = keyed.repartition("doc")
    windows = (texts.join(asked, F.col("doc") == F.col("of")).filter("NOT no_id").select("doc", "text", "ranges", *whole)
               .mapInArrow(_windows(size), ROWS))
    more = windows.repartition("key").sortWithinPartitions("key", "u", "doc").mapInArrow(_removed(False), RANGES)
    gone = by_doc(ranges.filter("NOT fine").unionByName(more), []).select(F.col("doc").alias("of"), "ranges")
    found = (texts.join(gone, (F.col("doc") == F.col("of")) & ~F.col("no_id"), "left")
             .select(F.when(~F.col("no_id"), F.col("doc")).alias("doc_id"), *whole, "text", "ranges"))
    kept = T.StructType([f for f in found.schema if f.name not in ("text", "ranges")]
                        + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return found.mapInArrow(_kept(size), kept)

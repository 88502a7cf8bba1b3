"""Exact substring dedup by merging Burrows-Wheeler transforms (operator 5).

Every window of ``size`` bytes has an anchor, the place with the least hash of a run of bytes inside the window. Equal
windows have equal anchors at the same place in them, so they meet where anchors are grouped by their hash. Anchors that
occur once hold no repeat; where all that surrounds an anchor (the union of its windows) occurs again, all its windows
are repeated. Both are settled by counting. What is left are different surroundings of the same anchor.

Those strings are read as sequences of symbols, a symbol being the hash of ``size / DEPTH`` bytes, one sequence for each
offset. Shards of them get a Burrows-Wheeler transform each. The transforms are merged by interleave refinement: a round
takes the order by h symbols to the order by h + 1 symbols, reading only the transforms, and marks where a common prefix
ends. After DEPTH rounds the intervals that still hold several suffixes are the repeated windows. No suffix is sorted
again in the merge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.cover_dedup import merged
from opsloom.llm.words import BYTE_CODES, U64, Rolling, mix, signed, slices, text_bytes
from opsloom.session import cut_lineage

#: Strings of an anchor that one task takes together; more are split by longer anchors until they fit.
MOST_STRINGS = 4000
#: Bytes of strings that are merged at once, and of a shard among them.
MERGE_BYTES, SHARD_BYTES = 1 << 20, 1 << 18
KEYED = "key long, u long, doc long, lo long, hi long, again boolean"


def depth_for(size: int) -> int:
    """Symbols to a window."""
    return next(d for d in (4, 5, 3, 2, 1) if size % d == 0)


def anchors(data: np.ndarray, bounds: np.ndarray, size: int, run: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of the texts in ``data``: (text, hash of the anchor, hash of the union of its windows, first
    byte of the first window, end of the last window, the anchor's first byte), bytes counted from the text's start.
    Neighbouring windows with the same anchor go together."""
    none = np.zeros(0, np.int64)
    if len(data) < size:
        return none, none.view(U64), none.view(U64), none, none, none
    rolled = Rolling(BYTE_CODES[data])
    at = np.arange(len(data) - run + 1)
    least, place, reach, width = rolled.windows(at, at + run), at.astype(np.int32), 1, size - run + 1
    while reach < width:  # the leftmost least hash of ever wider ranges
        step = min(reach, width - reach)
        right = least[step:] < least[:-step]
        least, place = np.where(right, least[step:], least[:-step]), np.where(right, place[step:], place[:-step])
        reach += step
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:len(place)]
    start = np.flatnonzero(np.arange(len(place)) + size <= bounds[1:][text])
    if not len(start):
        return none, none.view(U64), none.view(U64), none, none, none
    text, place, least = text[start], place[start], least[start]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(first[1:], len(start)) - 1
    lo, hi, text = start[first], start[last] + size, text[first]
    around = mix(rolled.windows(lo, hi) + (place[first] - lo).astype(U64), 4)
    return text, least[first], around, lo - bounds[text], hi - bounds[text], place[first] - bounds[text]


def counted(key: np.ndarray, u: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Batches for the shuffle. Of equal (key, u) one row leaves with ``again`` set; the ranges of all of them are repeated
    and pass as rows with null u."""
    order = np.lexsort((lo, doc, u, key))
    key, u, doc, lo, hi = (c[order] for c in (key, u, doc, lo, hi))
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (u[1:] != u[:-1])])) if len(key) else np.zeros(0, int)
    counts = np.diff(np.append(first, len(key)))
    names = ["key", "u", "doc", "lo", "hi", "again"]
    for at in range(0, len(first), 200_000):
        rows = first[at:at + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(signed(key[rows])), pa.array(signed(u[rows])), pa.array(doc[rows]), pa.array(lo[rows]),
                                          pa.array(hi[rows]), pa.array(counts[at:at + 200_000] > 1)], names)
    several = np.repeat(counts > 1, counts)
    gone, a, b = merged(doc[several], lo[several], hi[several])
    if len(gone):
        yield pa.RecordBatch.from_arrays([pa.array(signed(mix(gone.view(U64), 3))), pa.nulls(len(gone), pa.int64()), pa.array(gone),
                                          pa.array(a), pa.array(b), pa.array(np.ones(len(gone), bool))], names)


def _anchor_rows(size: int, run: int):
    def rows(batches):
        for batch in batches:
            found = []
            for part in slices(batch):
                data, bounds = text_bytes(part.column("text"))
                text, key, u, lo, hi, _ = anchors(data, bounds, size, run)
                found.append((key, u, part.column("doc").to_numpy(zero_copy_only=False)[text], lo, hi))
            if found:
                yield from counted(*map(np.concatenate, zip(*found)))
    return rows


def settle(batches):
    """Over rows sorted by key, u and ``again`` (set first): ranges that are repeated (key null), and one row of each u of
    the keys that have several. Rows of one key and u need not be held together, only the first of them and the key's."""
    names = ["key", "doc", "lo", "hi"]
    held = None  # (key, u, doc, lo, hi, again, u is settled, row is told) of the last row, the first of its u
    opened = None  # the same of the first u of the last key, if it is the only one so far
    for batch in batches:
        if not batch.num_rows:
            continue
        passing = np.asarray(batch.column("u").is_null())
        key, u, doc, lo, hi = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)[~passing] for c in ("key", "u", "doc", "lo", "hi"))
        again = batch.column("again").to_numpy(zero_copy_only=False)[~passing].astype(bool)
        gone = [tuple(batch.column(c).to_numpy(zero_copy_only=False)[passing] for c in ("doc", "lo", "hi"))]
        asked = []
        n = len(key)
        if n:
            same_u = np.concatenate([[held is not None and held[0] == key[0] and held[1] == u[0]], (key[1:] == key[:-1]) & (u[1:] == u[:-1])])
            same_key = np.concatenate([[held is not None and held[0] == key[0]], key[1:] == key[:-1]])
            first = np.flatnonzero(~same_u)
            # rows after the first of a u are repeated, and so is the first
            later = same_u & ~again
            gone.append((doc[later], lo[later], hi[later]))
            followed = np.zeros(n, bool)
            followed[np.flatnonzero(same_u[1:])] = True
            followed &= ~same_u & ~again
            gone.append((doc[followed], lo[followed], hi[followed]))
            if same_u[0] and not held[5] and not held[6]:
                gone.append(tuple(np.array([x]) for x in held[2:5]))
                held = (*held[:6], True)
            # one row of each u, from keys with several
            new_key = np.flatnonzero(~same_key)
            number = np.cumsum(~same_key)  # 0: the key carried on
            u_count = np.bincount(number[first], minlength=number[-1] + 1) if len(first) else np.zeros(number[-1] + 1, int)
            carried = u_count[0] > 0 and held is not None
            if carried and opened is not None:
                asked.append(tuple(np.array([opened[i]]) for i in (0, 2, 3, 4)))
                opened = None
            several = u_count > 1
            several[0] = carried
            rows = first[several[number[first]]]
            asked.append((key[rows], doc[rows], lo[rows], hi[rows]))
            if len(first):
                at = first[-1]
                held = (key[at], u[at], doc[at], lo[at], hi[at], again[at], bool(followed[at]))
            if len(new_key):
                at = new_key[-1]
                opened = (key[at], u[at], doc[at], lo[at], hi[at]) if u_count[-1] == 1 else None
        doc2, lo2, hi2 = merged(*map(np.concatenate, zip(*gone)))
        key3, doc3, lo3, hi3 = map(np.concatenate, zip(*asked)) if asked else (doc2[:0],) * 4
        if len(doc2) or len(doc3):
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.nulls(len(doc2), pa.int64()), pa.array(key3, pa.int64())]),
                 *(pa.array(np.concatenate(p), pa.int64()) for p in ((doc2, doc3), (lo2, lo3), (hi2, hi3)))], names)


def _strings(batches):
    """The bytes of the ranges that are asked for: key, doc, lo, bytes."""
    for batch in (part for whole in batches for part in slices(whole)):
        out = []
        for doc, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "asked"))):
            data = text.encode()
            out.extend((r["key"], doc, r["lo"], data[r["lo"]:r["hi"]]) for r in asked if r["hi"] <= len(data))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                             ["key", "doc", "lo", "bytes"])


class Shard:
    """Sorted suffixes of the symbol sequences of some strings, and their Burrows-Wheeler transform. Symbol 0 ends a
    sequence; ends are in the order of the sequences."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, depth: int):
        """``symbols`` of all sequences, each ended by a 0, which stand at ``ends``."""
        n = len(symbols)
        end_of = np.repeat(ends, np.diff(np.concatenate([[-1], ends])))
        keys = [symbols[np.minimum(np.arange(n) + d, end_of)] for d in range(depth)]
        self.order = np.lexsort(keys[::-1])
        before = np.concatenate([[0], symbols[:-1]])  # a sequence's first symbol follows another's end, 0
        self.transform = before[self.order]
        self.sequences = len(ends)


def _stable_order(codes: np.ndarray) -> np.ndarray:
    """Stable order of codes below 2**32 by two counting passes of 16 bits."""
    low = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    if int(codes.max(initial=0)) < 1 << 16:
        return low
    return low[np.argsort((codes[low] >> 16).astype(np.uint16), kind="stable")]


def merge(shards: list[Shard], depth: int) -> list[np.ndarray]:
    """For each shard, the interval of each of its sorted suffixes among all suffixes: equal numbers for suffixes that have
    their first ``depth`` symbols in common; suffixes with an end among these have an interval of their own."""
    transform = np.concatenate([s.transform for s in shards])
    sizes = np.array([len(s.transform) for s in shards])
    ends = np.repeat(np.arange(len(shards)), [s.sequences for s in shards]).astype(np.uint16)
    interleave = np.repeat(np.arange(len(shards)), sizes).astype(np.uint16)
    interval = np.zeros(len(transform), np.int64)
    for _ in range(depth):
        # the i-th place of a shard in the interleave is its i-th sorted suffix
        places = np.argsort(interleave, kind="stable")
        symbol = np.empty(len(transform), transform.dtype)
        symbol[places] = transform
        source = np.flatnonzero(symbol)
        source = source[_stable_order(symbol[source])]
        first = np.concatenate([[True], (symbol[source][1:] != symbol[source][:-1]) | (interval[source][1:] != interval[source][:-1])]) if len(source) else np.zeros(0, bool)
        interleave = np.concatenate([ends, interleave[source]])
        interval = np.cumsum(np.concatenate([np.ones(len(ends), bool), first]))
    places = np.argsort(interleave, kind="stable")
    return np.split(interval[places], np.cumsum(sizes)[:-1])


def repeated_windows(strings: list[bytes], size: int) -> list[np.ndarray]:
    """For each string, the starts of its windows of ``size`` bytes that also start elsewhere in the strings."""
    depth = depth_for(size)
    width = size // depth
    # symbols of every sequence of every string, string by string
    data = np.frombuffer(b"".join(strings), np.uint8)
    lengths = np.array([len(s) for s in strings], np.int64)
    base = np.cumsum(lengths) - lengths
    rolled = Rolling(BYTE_CODES[data])
    string_parts, start_parts, sizes_parts = [], [], []
    for offset in range(width):
        # the sequence takes every width-th place from offset on, up to the last symbol of the last window
        windows = np.where(lengths - size >= offset, (lengths - size - offset) // width + 1, 0)
        string_parts.append(np.arange(len(strings)))
        start_parts.append(base + offset)
        sizes_parts.append(np.where(windows > 0, windows + depth - 1, 0))
    string, start, count = (np.stack(p, axis=1).ravel() for p in (string_parts, start_parts, sizes_parts))
    string, start, count = string[count > 0], start[count > 0], count[count > 0]
    if not len(count):
        return [np.zeros(0, np.int64) for _ in strings]
    rows = count + 1
    first = np.cumsum(rows) - rows
    step = np.arange(int(rows.sum())) - np.repeat(first, rows)
    at = np.repeat(start, rows) + step * width
    is_end = step == np.repeat(count, rows)
    hashes = rolled.windows(at[~is_end], at[~is_end] + width)
    _, codes = np.unique(hashes, return_inverse=True)
    symbols = np.zeros(len(at), np.uint32)
    symbols[~is_end] = codes + 1
    # shards of whole strings
    shard_of = base[string] // SHARD_BYTES
    cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], shard_of[1:] != shard_of[:-1]])), [len(string)]])
    shards, at_row = [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        low, high = first[a], first[b - 1] + rows[b - 1]
        shards.append(Shard(symbols[low:high], first[a:b] + count[a:b] - low, depth))
        at_row.append(low)
    intervals = np.empty(len(symbols), np.int64)
    for shard, low, found in zip(shards, at_row, merge(shards, depth)):
        intervals[low + shard.order] = found
    again = np.bincount(intervals)[intervals] > 1
    of = np.repeat(string, rows)[again]
    starts = at[again] - base[of]
    order = np.lexsort((starts, of))
    return np.split(starts[order], np.searchsorted(of[order], np.arange(1, len(strings))))


def _merged_classes(size: int):
    """Over rows sorted by key: the repeated ranges. Whole keys are taken together up to MERGE_BYTES."""
    def found(doc, lo, strings):
        out = []
        for d, at, starts in zip(doc, lo, repeated_windows(strings, size)):
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) > 1)
                a, b = starts[np.concatenate([[0], cut + 1])], starts[np.append(cut, len(starts) - 1)] + size
                out.append((np.full(len(a), d), at + a, at + b))
        if out:
            doc, lo, hi = merged(*map(np.concatenate, zip(*out)))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(doc), pa.int64()), pa.array(doc), pa.array(lo), pa.array(hi)], ["key", "doc", "lo", "hi"])

    def run(batches):
        doc, lo, strings, size_now, last = [], [], [], 0, None
        for batch in batches:
            for k, d, a, s in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "lo", "bytes"))):
                if k != last and size_now >= MERGE_BYTES:
                    yield from found(doc, lo, strings)
                    doc, lo, strings, size_now = [], [], [], 0
                last = k
                doc.append(d)
                lo.append(a)
                strings.append(s)
                size_now += len(s)
        if strings:
            yield from found(doc, lo, strings)
    return run


def _cells(size: int, run: int, width: int):
    """Strings cut by the distance from a window's start to its anchor, ``width`` distances to a cell. What all windows of a
    cell have in common, which is longer than the anchor, is the new key."""
    def rows(batches):
        for batch in batches:
            strings = batch.column("bytes").to_pylist()
            data, lengths = np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings], np.int64)
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            text, _, _, _, _, place = anchors(data, bounds, size, run)  # all windows of a string have one anchor
            out = []
            for i, p in zip(text.tolist(), place.tolist()):
                far, near = p, p - (len(strings[i]) - size)
                for cell in range(near // width, far // width + 1):
                    a, b = max(cell * width, near), min(cell * width + width - 1, far)
                    out.append((i, p - b, p - a + size, p - cell * width, p - (cell * width + width - 1) + size, cell))
            if not out:
                continue
            row, lo, hi, low, high, cell = (np.array(c, np.int64) for c in zip(*out))
            rolled, base = Rolling(BYTE_CODES[data]), bounds[row]
            common = mix(rolled.windows(base + low, base + high) + cell.astype(U64), 6)
            around = mix(rolled.windows(base + lo, base + hi) + (low - lo).astype(U64), 4)
            doc, start = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc", "lo"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(common)), pa.array(signed(around)), pa.array(doc), pa.array(start + lo), pa.array(start + hi),
                 pa.array([strings[i][x:y] for i, x, y in zip(row.tolist(), lo.tolist(), hi.tolist())], pa.binary())],
                ["key", "u", "doc", "lo", "hi", "bytes"])
    return rows


def _split(strings: DataFrame, size: int, run: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Strings under longer keys, and the ranges that this alone shows to be repeated."""
    cells = cut_lineage(strings.mapInArrow(_cells(size, run, width), "key long, u long, doc long, lo long, hi long, bytes binary"))
    each = cells.groupBy("key", "u").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "lo")).alias("one"))
    several = each.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("key")
    kept = each.join(several, "key", "left_semi").select("key", "u", "one.doc", "one.lo")
    longer = cells.join(kept, ["key", "u", "doc", "lo"], "left_semi").select("key", "doc", "lo", "bytes").dropDuplicates(["key", "doc", "lo"])
    ranges = cells.join(each.filter("n > 1").select("key", "u"), ["key", "u"], "left_semi").select("doc", "lo", "hi")
    return longer, ranges


def _kept(batches):
    for batch in (part for whole in batches for part in slices(whole)):
        out = []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
            data = (text or "").encode()
            kept, at, spans = [], 0, 0
            if ranges:
                _, lo, hi = merged(np.zeros(len(ranges), np.int64), *(np.minimum([r[k] for r in ranges], len(data)) for k in ("lo", "hi")))
                for a, b in zip(lo.tolist(), hi.tolist()):
                    if a < b:
                        kept.append(data[at:a])
                        at, spans = b, spans + 1
            kept.append(data[at:])
            left = b"".join(kept)
            out.append((len(data), len(data) - len(left), spans, left))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))] if out else
                                         [batch.column("doc_id"), *(pa.array([], k) for k in kinds)],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeated_bytes(docs: DataFrame, size: int = 400, run: int | None = None, most_strings: int = MOST_STRINGS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes left) of each document: every byte goes
    that a string of ``size`` bytes covers which also starts anywhere else, in the same document or another.

    ``docs`` has doc_id and text; other columns are not read. Strings are judged on the input and never cross documents.
    Null and empty texts have no bytes; documents with fewer than ``size`` bytes keep all, as do rows with null doc_id, which
    are no one's other copy either. Of rows that share a doc_id each is a text of its own, and what is removed from one of
    them is removed from all. Texts are taken whole. ``run``: bytes of an anchor, three quarters of ``size`` by default;
    ``most_strings``: different surroundings of an anchor that one task takes.
    """
    run = run or max(1, 3 * size // 4)
    # without nulls in the key, both joins below read the same shuffle of the texts
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("doc"), F.col("doc_id").isNull().alias("no_id"),
                        F.col("text").cast("string").alias("text"))
    rows = keyed.filter("NOT no_id AND text IS NOT NULL").select("doc", "text").mapInArrow(_anchor_rows(size, run), KEYED)
    ranged = "key long, doc long, lo long, hi long"
    settled = cut_lineage(rows.repartition("key").sortWithinPartitions("key", "u", F.desc("again")).mapInArrow(settle, ranged))
    open_ = settled.filter("key IS NOT NULL")
    texts = keyed.repartition("doc")
    asked = open_.groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("key", "lo", "hi")).alias("asked"))
    strings = (texts.join(asked, F.col("doc") == F.col("of")).filter("NOT no_id").select("doc", "text", "asked")
               .mapInArrow(_strings, "key long, doc long, lo long, bytes binary"))
    done = settled.filter("key IS NULL").select("doc", "lo", "hi")
    crowded = lambda df: df.groupBy("key").count().filter(F.col("count") > most_strings).select("key")
    width, large = size - run + 1, cut_lineage(crowded(open_))
    ready = []
    while width > 1 and not large.isEmpty():
        # the strings of crowded anchors are written once a round; a window alone as its key ends it
        strings = cut_lineage(strings)
        ready.append(strings.join(large, "key", "left_anti"))
        width = (width + 1) // 2
        strings, ranges = _split(strings.join(large, "key", "left_semi"), size, run, width)
        strings = cut_lineage(strings)
        done = done.unionByName(cut_lineage(ranges))
        large = cut_lineage(crowded(strings))
    for part in [*ready, strings]:
        found = part.repartition("key").sortWithinPartitions("key").mapInArrow(_merged_classes(size), ranged)
        done = done.unionByName(found.select("doc", "lo", "hi"))
    gone = done.groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    return (texts.join(gone, (F.col("doc") == F.col("of")) & ~F.col("no_id"), "left")
            .select(F.when(~F.col("no_id"), F.col("doc")).alias("doc_id"), "text", "ranges")
            .mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))

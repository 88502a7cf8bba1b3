"""N-gram Jaccard join with PartEnum signatures (operator 4).

Two documents link when the Jaccard similarity of their sets of word shingles reaches a threshold. Sets of similar size
share a size band. Two sets of a band that link differ in at most k elements. The hashed element domain is cut into n1
groups, in at least one of which they differ in at most k2 = k // n1 elements. Each group is cut into parts, and choices of
parts are enumerated that hold no difference in one case at least: all pairs of k + 2 parts for a small k, single parts of
k2 + 1 + spare for a larger one. Linked sets so share a signature, the content of a choice. No linked pair is missed.

An empty part tells nothing. A set whose empty parts in a group are no more than the spare ones leaves them out: if it
shared nothing else there with a linked set, both would have more than the spare ones. With each signature goes a parity
sketch of its group: two sketches differ in no more bits than the groups do in elements, so pairs whose sketches differ in
more than k2 bits need not be looked at.

Sets that share signatures form clusters. Inside a cluster every pair is compared exactly, in tiles of bounded size whose
tasks return a spanning forest of the links, never the pairs. Copies of a set count as one set throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.components import components
from opsloom.llm.words import U64, mix, signed, slices, split_words, word_windows
from opsloom.session import cut_lineage

#: Per side of a tile: sets, and shingles of all sets.
TILE_SETS, TILE_SHINGLES = 1024, 1_000_000
#: Shingles that so many sets of a tile share are counted by matrix products, FEATURES at once; others pair by pair.
DENSE, FEATURES = 32, 2048
#: Elements in which linked sets may differ in a group, about, and in a small band.
GROUP_DIFFERENCES, FEW = 8, 2
#: A sketch is this many bits, the rest of the word says how many bits may differ; all of these: any number.
SKETCH_BITS, ANY = 58, 63
#: Sets of one signature whose sketches are compared; more count as near each other until they are verified.
MOST_COMPARED = 20_000
#: Signatures that are worked on together before the shuffle.
AT_ONCE = 1_000_000


def text_sets(batch: pa.RecordBatch, size: int, column: str = "text") -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) for each row; words are compared with A-Z in lower case."""
    done = 0
    for part in slices(batch, column):
        words = split_words(part.column(column))
        text, _, hashes = word_windows(words.hashes(lower=True), words.first, size)
        cuts = np.searchsorted(text, np.arange(part.num_rows + 1))
        for i in range(part.num_rows):
            yield done + i, np.unique(hashes[cuts[i]:cuts[i + 1]])
        done += part.num_rows


def set_key(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set."""
    return tuple(int(signed(mix(elements, salt).sum(dtype=U64, keepdims=True))[0]) for salt in (11, 12))


class Bands:
    """Size bands and the signatures of a set. ``percent`` is the threshold in hundredths."""

    def __init__(self, percent: int):
        self.percent, self.lower = percent, [1]
        self.shapes: dict[int, tuple[int, int, int, int, int]] = {}

    def of(self, size: int) -> int:
        while self.lower[-1] <= size:
            # the largest size that a set of the band's smallest size may link with
            self.lower.append(self.lower[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.lower, size, side="right")) - 1

    def most_differences(self, band: int) -> int:
        """Of a linked pair whose smaller set lies in ``band``."""
        top = self.lower[band + 1] - 1
        both = top + top * 100 // self.percent
        return both * (100 - self.percent) // (100 + self.percent)

    def shape(self, band: int) -> tuple[int, int, int, int, int]:
        """Groups, parts of each, parts in a signature, spare parts of a group, differences in the best group."""
        k = self.most_differences(band)
        if k <= FEW:
            return 1, k + 2, 2, 0, k
        groups = max(1, round(k / GROUP_DIFFERENCES))
        best, spare = k // groups, 1
        while True:  # half as many spare parts again as are empty in a set of the band's largest size
            parts = best + 1 + spare
            if spare >= 1.5 * parts * math.exp(-(self.lower[band + 1] - 1) / groups / parts) + 0.5 or spare > best:
                return groups, parts, 1, spare, best
            spare += 1

    def signatures(self, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of a set, and with each the differences allowed and the sketch of its group."""
        band, keys, values = self.of(len(elements)), [], []
        # a set is compared with smaller sets of the band below, too
        for instance in (band - 1, band) if band else (band,):
            if instance not in self.shapes:
                self.shapes[instance] = self.shape(instance)
            groups, parts, together, spare, best = self.shapes[instance]
            n = groups * parts
            mixed = mix(elements, 1000 + instance)
            part = (mixed % U64(n)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(n + 1))
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(elements[order], 7), dtype=U64)])
            codes = mix(sums[ends[1:]] - sums[ends[:-1]] + np.arange(n, dtype=U64), 8).reshape(groups, parts)
            bits = U64(1) << (mix(mixed[order], 9) % U64(SKETCH_BITS))
            parity = np.concatenate([np.zeros(1, U64), np.bitwise_xor.accumulate(bits)])[ends[::parts]]
            value = (parity[1:] ^ parity[:-1]) | U64(min(best, ANY) << SKETCH_BITS)
            tag = U64(instance * 1315423911 + together)
            if together == 1:
                filled = np.diff(ends).reshape(groups, parts) > 0
                told = filled | ((parts - filled.sum(axis=1)) > spare)[:, None]
                keys.append(mix(codes[told] + tag, 10))
                values.append(np.repeat(value, told.sum(axis=1)))
            else:
                keys.append(mix(codes[0][np.array(list(combinations(range(parts), together)))].sum(axis=1, dtype=U64) + tag, 10))
                values.append(np.repeat(value, len(keys[-1])))
        return np.concatenate(keys), np.concatenate(values)


def near(value: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether two sketches differ in no more bits than allowed."""
    allowed = np.maximum(value, other) >> U64(SKETCH_BITS)
    return (allowed == ANY) | (np.bitwise_count((value ^ other) & U64((1 << SKETCH_BITS) - 1)) <= allowed)


def near_forest(value: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, other node) that join the sets of one signature whose sketches are near, directly or through others."""
    left, right, free = [], [], np.arange(len(node))
    while len(free):
        queue, root = [free[0]], node[free[0]]
        free = free[1:]
        while queue and len(free):
            hit = near(value[queue.pop()], value[free])
            found, free = free[hit], free[~hit]
            queue.extend(found)
            left.append(node[found])
            right.append(np.full(len(found), root))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def near_sets(key: np.ndarray, node: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, other node) that join, within each signature, the sets whose sketches are near; rows are sorted by
    signature and node. Of signatures with more than MOST_COMPARED sets all are joined."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(key)))
    found = []
    few = np.repeat((count > 1) & (count <= 16), count)
    rows, last = np.flatnonzero(few), np.repeat(start + count, count)
    for step in range(1, 16):
        rows = rows[rows + step < last[rows]]
        pair = rows[near(value[rows], value[rows + step])]
        found.append((node[pair + step], node[pair]))
    for a, c in zip(start[count > 16], count[count > 16]):
        own = slice(a, a + c)
        if c > MOST_COMPARED:
            found.append((node[own][1:], np.full(c - 1, node[a])))
        else:
            found.append(near_forest(value[own], node[own]))
    left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    other = left != right
    return tuple(np.unique(np.stack([left[other], right[other]]), axis=1))


def _keys(size: int):
    def run(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            keys = np.zeros((2, batch.num_rows), np.int64)
            for i, elements in text_sets(batch, size):
                n[i] = len(elements)
                keys[:, i] = set_key(elements)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(keys[0]), pa.array(keys[1])],
                                             ["doc_id", "n_shingles", "set_a", "set_b"])
    return run


def _signed_sets(size: int, percent: int):
    """Signature rows (key, node, value) of some texts, and edge rows (null, node, other) for their sets that are near. Of
    sets with the same signature and sketch one leaves, and of a signature with many sets one that is near to any."""
    names = ["key", "node", "value"]

    def gathered(batches):
        bands = Bands(percent)
        keys, nodes, values, seen, rows = [], [], [], set(), 0
        for batch in batches:
            for _, elements in text_sets(batch, size):
                node = set_key(elements)[0]
                if len(elements) and node not in seen:
                    seen.add(node)
                    own, value = bands.signatures(elements)
                    keys.append(signed(own))
                    values.append(value)
                    nodes.append(np.full(len(own), node))
                    rows += len(own)
                if rows >= AT_ONCE:
                    yield np.concatenate(keys), np.concatenate(nodes), np.concatenate(values)
                    keys, nodes, values, seen, rows = [], [], [], set(), 0
        if keys:
            yield np.concatenate(keys), np.concatenate(nodes), np.concatenate(values)

    def run(batches):
        for key, node, value in gathered(batches):
            order = np.lexsort((node, key))
            left, right = near_sets(key[order], node[order], value[order])
            order = np.lexsort((node, value, key))
            k, v = key[order], value[order]
            new_key = np.concatenate([[True], k[1:] != k[:-1]])
            first = new_key | np.concatenate([[True], v[1:] != v[:-1]])
            starts = np.flatnonzero(new_key)
            crowded = np.add.reduceat(first.astype(np.int64), starts) > MOST_COMPARED
            many = np.repeat(crowded, np.diff(np.append(starts, len(k))))
            value[order[many]] = U64(ANY << SKETCH_BITS)
            # in the order of the sets, where neighbouring rows have much in common
            ships = np.sort(order[np.where(many, new_key, first)])
            for at in range(0, len(ships), 200_000):
                rows = ships[at:at + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(node[rows]), pa.array(signed(value[rows]))], names)
            if len(left):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(left), pa.int64()), pa.array(left), pa.array(right)], names)
    return run


def _bucket_edges(batches):
    """Rows sorted by key and node: edges between the sets with the same key that are near; edge rows pass."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)]
    for batch in batches:
        if not batch.num_rows:
            continue
        passing = np.asarray(batch.column("key").is_null())
        node, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "value"))
        key = batch.column("key").fill_null(0).to_numpy(zero_copy_only=False)
        now = [np.concatenate(p) for p in zip(held, (key[~passing], node[~passing], value[~passing].view(U64)))]
        left, right = near_sets(*now)
        # the last key may go on; a crowded one is carried on by its first set
        last = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        held = [c[last:] for c in now]
        if len(held[0]) > MOST_COMPARED:
            held = [held[0][:1], held[1][:1], np.array([ANY << SKETCH_BITS], U64)]
        pairs = np.unique(np.stack([np.concatenate([node[passing], left]), np.concatenate([value[passing], right])]), axis=1)
        if pairs.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["node", "center"])


def _sets(size: int):
    def run(batches):
        for batch in batches:
            packed = [None] * batch.num_rows
            wanted = batch.column("set_a").to_pylist()
            for i, elements in text_sets(batch, size):
                if set_key(elements)[0] == wanted[i]:  # not another text under the same doc_id
                    packed[i] = elements.tobytes()
            names = [n for n in batch.schema.names if n not in ("text", "set_a")]
            found = pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(packed, pa.binary())], [*names, "elements"])
            yield found.filter(found.column("elements").is_valid())
    return run


def sorted_groups(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Groups of rows that are sorted by ``keys``, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            here = tuple(c[a] for c in cols)
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = here
    if held:
        yield pa.Table.from_batches(held)


def links(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix of the pairs that reach the threshold, from exact intersection sizes."""
    n, m = len(left), len(right)
    sizes = np.array([len(x) for x in (*left, *right)])
    _, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row, side = np.repeat(np.arange(n + m), sizes), np.repeat(np.arange(n + m) >= n, sizes)
    # how many sets of either side hold a shingle; those of one side only do not matter
    in_left, in_right = np.bincount(at[~side], minlength=at.max(initial=0) + 1), np.bincount(at[side], minlength=at.max(initial=0) + 1)
    shared = (in_left > 0) & (in_right > 0)
    if left is right:
        shared &= in_left > 1
    common = np.zeros((n, m))
    if left is right:
        np.fill_diagonal(common, sizes[:n])
    dense = shared & (np.maximum(in_left, in_right) >= DENSE)
    number = np.cumsum(dense) - 1
    for low in range(0, int(dense.sum()), FEATURES):
        mine = dense[at] & (number[at] >= low) & (number[at] < low + FEATURES)
        part = np.zeros((n + m, FEATURES), np.float32)
        part[row[mine], number[at[mine]] - low] = 1
        product = part[:n] @ part[n:].T
        if left is right:
            np.fill_diagonal(product, 0)
        common += product
    sparse = shared & ~dense
    sides = []
    for mine in (sparse[at] & ~side, sparse[at] & side):
        order = np.argsort(at[mine], kind="stable")
        sides.append(row[mine][order])
    per_left, per_right = in_left[sparse], in_right[sparse]
    # every row of a shingle's left sets with every row of its right sets
    first_left, first_right = np.cumsum(per_left) - per_left, np.cumsum(per_right) - per_right
    times = np.repeat(per_right, per_left)
    a = np.repeat(sides[0], times)
    start = np.repeat(np.repeat(first_right, per_left), times)
    b = sides[1][start + np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)] - n
    cell = a * m + b
    if left is right:
        cell = cell[a != b]
    common += np.bincount(cell, minlength=n * m).reshape(n, m)
    union = sizes[:n, None] + sizes[None, n:] - common
    return (100 * common >= percent * union) & (union > 0)


def forest(linked: np.ndarray, names: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest (name, smaller name) of a symmetric boolean matrix; at most one edge per name."""
    root, edges, free = {}, [], np.ones(len(names), bool)
    for i in np.argsort(names, kind="stable"):
        if not free[i]:
            continue
        free[i], queue = False, [i]
        while queue:
            new = np.flatnonzero(linked[queue.pop()] & free)
            free[new] = False
            queue.extend(new)
            edges.extend((int(names[j]), int(names[i])) for j in new)
    return edges


def _tiles(percent: int):
    def run(batches):
        for group in sorted_groups(batches, ["cluster", "low", "high"]):
            reps, sides = group["rep"].to_numpy(), group["block"].to_numpy()
            sets = [np.frombuffer(x, U64) for x in group["elements"].to_pylist()]
            low, high = group["low"][0].as_py(), group["high"][0].as_py()
            first, second = np.flatnonzero(sides == low), np.flatnonzero(sides == high)
            if low == high:
                linked, names = links(sets, sets, percent) if len(sets) > 1 else np.zeros((1, 1), bool), reps
            else:
                cross = links([sets[i] for i in first], [sets[i] for i in second], percent)
                n, m = cross.shape
                linked = np.zeros((n + m, n + m), bool)
                linked[:n, n:], linked[n:, :n] = cross, cross.T
                names = np.concatenate([reps[first], reps[second]])
            edges = forest(linked, names)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()),
                                                  pa.array([e[1] for e in edges], pa.int64())], ["left", "right"])
    return run


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) of each document.

    ``docs`` has doc_id and text; other columns are not read. Null or wordless texts have an empty set and link with
    nothing. Texts with 1 to ``size`` - 1 words have one shingle. Rows with the same doc_id each give a row, and count as
    linked only if their sets link; rows with null doc_id are kept with their own component null. An empty table gives
    an empty result. Texts are taken whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = cut_lineage(docs.mapInArrow(_keys(size), "doc_id long, n_shingles long, set_a long, set_b long"))
    classes = (keyed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b", "n_shingles")
               .agg(F.min("doc_id").alias("rep")))
    signed_rows = docs.filter("text IS NOT NULL AND doc_id IS NOT NULL").select("text").mapInArrow(
        _signed_sets(size, percent), "key long, node long, value long")
    # edge rows have no key; they are dealt by their node
    dealt = F.coalesce("key", F.xxhash64("node", "value"))
    candidates = (signed_rows.repartition(dealt).sortWithinPartitions("key", "node")
                  .mapInArrow(_bucket_edges, "node long, center long").distinct())
    clusters = components(candidates, "node", "center").withColumnRenamed("component", "cluster")
    # one row per different set of a cluster; its blocks are dealt by hash
    members = cut_lineage(classes.join(clusters, F.col("set_a") == F.col("node")).select("cluster", "rep", "set_a", "n_shingles"))
    blocks = members.groupBy("cluster").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE_SETS, F.sum("n_shingles") / TILE_SHINGLES))
                                            .cast("int").alias("blocks"))
    placed = (members.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
              .select("cluster", "rep", "set_a", "block", "blocks"))
    # a merge join at every size: members grow with the documents
    packed = (docs.join(placed.hint("merge"), F.col("doc_id") == F.col("rep")).select("cluster", "rep", "block", "blocks", "set_a", "text")
              .mapInArrow(_sets(size), "cluster long, rep long, block int, blocks int, elements binary"))
    tiled = (packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                     "block", "rep", "elements"))
    found = (tiled.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")
             .mapInArrow(_tiles(percent), "left long, right long"))
    reached = components(found, "left", "right")
    of_class = classes.join(reached, F.col("rep") == F.col("node"), "left").select(
        F.col("set_a").alias("a"), F.col("set_b").alias("b"), F.col("n_shingles").alias("n"),
        F.coalesce("component", "rep").alias("component"))
    joined = keyed.join(of_class, (F.col("set_a") == F.col("a")) & (F.col("set_b") == F.col("b"))
                        & (F.col("n_shingles") == F.col("n")), "left")
    return joined.select("doc_id", "n_shingles",
                         F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))

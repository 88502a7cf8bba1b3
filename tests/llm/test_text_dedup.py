"""Operators 4, 5 and 6 and the components below them against brute force."""

from __future__ import annotations

import random
import re

import pytest

from opsloom.llm.bwt_dedup import remove_repeated_bytes, repeated_windows
from opsloom.llm.components import components
from opsloom.llm.cover_dedup import COVERS, remove_repeated_windows
from opsloom.llm.ngram_join import Bands, jaccard_components, near
from opsloom.llm.words import split_words, word_windows

from conftest import sentence


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_copies(rng, n):
    """Texts with exact copies, light and heavy edits, shared passages, short texts."""
    out, passage = [], sentence(rng, 70)
    while len(out) < n:
        base = sentence(rng, rng.choice([1, 2, 3, 4, 9, 15, 40, 150, 400]))
        out.append(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = base.split(" ")
            for _ in range(rng.choice([0, 1, 2, 5])):
                w[rng.randrange(len(w))] = sentence(rng, 1)
            out.append(" ".join(w) if rng.random() < 0.8 else " ".join(w).upper())
        if rng.random() < 0.3:
            out.append(base + " " + passage + " " + sentence(rng, 20))
    return out[:n]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)] + [(7, 7), (None, 3)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    clean = [(a, b) for a, b in edges if a is not None and a != b]
    assert found == roots({n for e in clean for n in e}, clean)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_jaccard(rows, size, percent):
    sets = {}
    for doc, text in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    edges = []
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    edges.append((a, b))
    return {d: (len(s), c) for (d, s), c in zip(sets.items(), roots(sets, edges).values())}


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard(frame, size, percent):
    rows = list(enumerate(near_copies(random.Random(size), 300)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame(rows), size, percent).collect()}
    assert found == brute_jaccard(rows, size, percent)


def test_signatures_never_miss(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for percent in (50, 80, 90):
        bands = Bands(percent)
        for _ in range(300):
            n = int(rng.integers(1, 900))
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            both, only = int(rng.integers(0, n + 1)), int(rng.integers(0, n))
            b = np.concatenate([a[:both], rng.integers(0, 2**63, only).astype(np.uint64)])
            if len(b) and 100 * both >= percent * (n + only):
                left, right = (dict(zip(*map(list, bands.signatures(np.unique(x))))) for x in (a, b))
                assert any(near(left[k], right[k]) for k in left.keys() & right.keys()), (percent, n, both, only)


def test_jaccard_odd_rows(frame, odd_rows):
    found = jaccard_components(frame(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    got = {r.doc_id: r for r in found}
    assert got[1].n_shingles == got[2].n_shingles == got[3].n_shingles == 0
    assert {got[d].component_id for d in (4, 5)} == {4} and got[None].component_id is None
    assert all(got[d].component_id == d for d in (1, 2, 3, 13))
    assert jaccard_components(frame([])).count() == 0


def brute_windows(rows, size):
    first, out = {}, {}
    for doc, text in sorted(rows):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first.setdefault(tuple(w[i:i + size]), doc) < doc:
                gone[i:i + size] = [True] * size
        out[doc] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("size,period", [(50, None), (50, 21), (12, 7), (5, None), (1, None)])
def test_cover_dedup(frame, size, period):
    rng = random.Random(size)
    texts = near_copies(rng, 120) + ["a b " * 60, "a b " * 45 + "c", " b  a\t" * 70]
    rows = list(zip(rng.sample(range(10_000), len(texts)), texts))
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeated_windows(frame(rows), size, period).collect()}
    assert found == brute_windows(rows, size)


def test_cover_dedup_windows_across_two_earlier_documents(frame):
    """Document 3 is made of parts of 1 and 2; the windows across its two parts start first in it, and 4 has them."""
    w = sentence(random.Random(6), 600).split()
    for first, second in ((200, 200), (200, 180), (230, 170)):  # parts that touch or overlap
        rows = [(1, w[:first] + w[500:510]), (2, w[510:520] + w[second:400]), (3, w[:400]), (4, w[520:530] + w[160:240] + w[530:540])]
        rows = [(doc, " ".join(text)) for doc, text in rows]
        want = brute_windows(rows, 50)
        assert want[3][1] == 400 and want[4][1] == 80
        found = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeated_windows(frame(rows), 50).collect()}
        assert found == want, (first, second)


def test_covers_hold_every_difference():
    for period, cover in COVERS.items():
        for i in range(period):
            for j in range(period):
                assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


def test_cover_dedup_odd_rows(frame, odd_rows):
    found = remove_repeated_windows(frame(odd_rows), rows=True).collect()
    assert len(found) == len(odd_rows)
    got = {r.doc_id: r for r in found}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and got[1].kept_text == ""
    assert got[12].n_removed > 1000 and got[8].n_removed == 0 and got[None].n_removed == 0
    assert got[10].n_removed == 0  # its repeats are its own
    assert got[4].row.key == 3 and got[4].row.text == "a"
    assert remove_repeated_windows(frame([])).count() == 0


def brute_bytes(rows, size):
    seen = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - size + 1):
            seen.setdefault(b[i:i + size], []).append((doc, i))
    gone = {doc: set() for doc, _ in rows}
    for places in seen.values():
        if len(places) > 1:
            for doc, i in places:
                gone[doc].update(range(i, i + size))
    out = {}
    for doc, text in rows:
        b = (text or "").encode()
        spans = sum(1 for i in gone[doc] if i - 1 not in gone[doc])
        out[doc] = (len(b), len(gone[doc]), spans, bytes(x for i, x in enumerate(b) if i not in gone[doc]))
    return out


@pytest.mark.parametrize("size,most", [(400, 4000), (60, 4000), (60, 2), (37, 3), (8, 2)])
def test_bwt_dedup(frame, size, most):
    rng = random.Random(size)
    texts = near_copies(rng, 100) + ["a" * 1000, "a" * 999 + "b", "ab" * 300 + "éé" * 250, "é" * 30]
    rows = list(enumerate(texts))
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeated_bytes(frame(rows), size, most_strings=most).collect()}
    assert found == brute_bytes(rows, size)


def test_merged_transforms():
    """Many shards, and windows repeated within and across them."""
    import opsloom.llm.bwt_dedup as module

    rng, kept = random.Random(2), module.SHARD_BYTES
    try:
        for shard, size in ((50, 20), (300, 35), (10_000, 12)):
            module.SHARD_BYTES = shard
            strings = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 60))) * rng.choice([1, 1, 3]) for _ in range(60)]
            places = {}
            for i, s in enumerate(strings):
                for x in range(len(s) - size + 1):
                    places.setdefault(s[x:x + size], []).append((i, x))
            want = {p for found in places.values() if len(found) > 1 for p in found}
            assert {(i, int(x)) for i, starts in enumerate(repeated_windows(strings, size)) for x in starts} == want
    finally:
        module.SHARD_BYTES = kept


def test_bwt_dedup_odd_rows(frame, odd_rows):
    found = remove_repeated_bytes(frame(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    got = {r.doc_id: r for r in found}
    assert got[1].n_bytes == got[2].n_bytes == 0 and bytes(got[1].kept) == b""
    assert got[9].n_removed == 50_000 and got[10].n_removed == 80_000
    assert got[12].n_removed == 9000 and got[8].n_removed == 9000 and got[None].n_removed == 0
    assert remove_repeated_bytes(frame([])).count() == 0


def test_words_match_the_pattern():
    import pyarrow as pa

    texts = ["", None, "a\x0bb\x0cc", "  x y ", "end ", "é b"]
    found = split_words(pa.array(texts))
    assert found.counts.tolist() == [len(words(t)) for t in texts]
    text, at, hashes = word_windows(found.hashes(), found.first, 2)
    assert text.tolist() == [2, 2, 3, 4, 5] and len(set(hashes.tolist())) == 5

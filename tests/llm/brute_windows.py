"""Benchmark items in documents by comparing every window with every item, in plain Python."""

from __future__ import annotations

import re


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def _bag(words):
    found = {}
    for i in range(max(1, len(words) - 4)) if words else ():
        shingle = tuple(words[i:i + 5])
        found[shingle] = found.get(shingle, 0) + sum(len(w.encode()) for w in shingle)
    return found


def similarity(a, b):
    low = sum(min(w, b[s]) for s, w in a.items() if s in b)
    high = sum(a.values()) + sum(b.values()) - low
    return low / high if high else 0.0


def best_windows(docs, items):
    """(doc, item) -> best similarity of a window as long as the item, above 0."""
    bags = [(i, _words(text), _bag(_words(text))) for i, text in items]
    out = {}
    for doc, text in docs:
        words = _words(text)
        have = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        for item, asked, bag in bags:
            m, n = len(asked), len(words)
            if not m or not n or (min(m, n) < 5 and m != n) or have.isdisjoint(bag):
                continue
            windows = [words[i:i + m] for i in range(max(1, n - m + 1))]
            best = max(similarity(_bag(w), bag) for w in windows)
            if best > 0:
                out[doc, item] = max(best, out.get((doc, item), 0.0))
    return out

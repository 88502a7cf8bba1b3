"""Operators 11, 12 and 13 against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from opsloom.llm import max_sketch, skip_chain, spelling
from opsloom.llm.max_sketch import Best, Queries, Scorer, Terms, bounds, ranked_documents, sketches
from opsloom.llm.skip_chain import KINDS, Model, base_spans, learn, luhn, marginals, personal_spans
from opsloom.llm.spelling import near_words, spelling_groups, word_counts

from conftest import sentence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# -- ranked search -------------------------------------------------------------------------------------------------------

def ranked_by_hand(docs, items, k):
    terms = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    terms = [(d, c) for d, c in terms if c]
    total = sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        asked = TERM.findall((text or "").translate(LOWER))
        scored = []
        for doc, c in terms:
            m = 100 - 25 + (25 * sum(c.values()) * len(terms)) // total
            score = sum(math.floor(1000 * math.log((2 * len(terms) + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in asked if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank + 1, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def searched():
    rng = random.Random(11)
    words = ["".join(rng.choice("abé4") for _ in range(rng.randint(1, 3))) for _ in range(60)] + ["Σ", "ÀB", "x_y"]
    text = lambda n: " ".join(rng.choice(words) if rng.random() < 0.8 else words[0].upper() for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(400)]
    docs += [(i, docs[3][1]) for i in range(1000, 1300)]  # copies: ties by doc_id
    items = [(i, text(rng.randint(1, 12))) for i in range(12)]
    return docs, items


def test_ranked_documents(spark, frame, odd_rows, searched):
    docs, items = searched
    docs = docs + odd_rows
    items = items + [(3, items[3][1]), (70, None), (71, "..."), (None, items[0][1]), (72, "zz not there zz"), (73, odd_rows[9][1][:400])]
    asked = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, doc_id string, score int")
    for k in (1, 20, 2000):
        assert in_order(ranked_documents(frame(docs), asked, k).collect()) == in_order(ranked_by_hand(docs, items, k))


def test_ranked_documents_in_passes_and_empty(spark, frame, searched, monkeypatch):
    docs, items = searched
    asked = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(max_sketch, "PASS_BYTES", 60)
    monkeypatch.setattr(max_sketch, "CELLS", 500)
    assert in_order(ranked_documents(frame(docs), asked, 5).collect()) == in_order(ranked_by_hand(docs, items, 5))
    assert ranked_documents(frame(docs).limit(0), asked, 5).count() == 0
    assert ranked_documents(frame(docs), asked.limit(0), 5).count() == 0
    assert ranked_documents(frame([(1, None), (2, "")]), asked, 5).count() == 0


def test_sketches_bound_scores_and_spare_work():
    rng = random.Random(12)
    words = [sentence(rng, 1) for _ in range(3000)]
    texts = [" ".join(words[min(int(rng.expovariate(0.004)), 2999)] for _ in range(rng.randint(5, 300))) for _ in range(600)]
    asked = Queries.build([(i, " ".join(texts[i].split()[:30])) for i in range(40)] + [(99, "")])
    found = Terms.of(pa.array(texts))
    held = np.bincount(found.known(asked.terms)[1], minlength=len(asked.terms))
    asked.weights = np.array([max_sketch.weight(600, int(h)) for h in held], np.int64)
    impacts = found.impacts(600, int(found.length.sum()))
    scorer, best, scored = Scorer(asked, found, impacts), Best(41, 20), 0
    for docs, folded in sketches(found, impacts):
        for at, upper in bounds(asked, folded):
            doc, query = (x.ravel() for x in np.meshgrid(docs, np.arange(at, at + upper.shape[1]), indexing="ij"))
            assert (upper.ravel() >= scorer.scores(doc, query)).all()
            scored += max_sketch._rescore(best, scorer, docs, np.arange(600), np.zeros(600, bool), at, upper)
    assert scored < 0.5 * 600 * 40


# -- spelling variants ---------------------------------------------------------------------------------------------------

def near_by_hand(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def groups_by_hand(docs, least, count, ratio, every):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= count}
    near = defaultdict(list)
    for a, b in itertools.combinations(sorted(n), 2):
        if near_by_hand(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted(((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n), key=repr)


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(13)
    letters = "abÀé"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(250)]
    words += ["a" * i for i in range(3, 30)] + ["kettle", "ketle", "kettel", "kettles", "ketttle", "b" * 700, "b" * 350 + "a" + "b" * 349, "b" * 701]
    docs = [(i, " ".join(words[int(len(words) * rng.random() ** 3)].upper() if rng.random() < 0.1 else words[int(len(words) * rng.random() ** 3)]
                         for _ in range(60))) for i in range(150)]
    return docs + [(500 + i, f"{'b' * 700} {'b' * 350}a{'b' * 349}x{i}") for i in range(9)]


@pytest.mark.parametrize("block", [3, 40, spelling.BLOCK])
def test_spelling_groups(frame, odd_rows, spelled, block):
    docs = spelled + odd_rows + [(900, "one;ten," * 40), (901, "çâble 1çâble-çâble×÷"), (None, "kettle")] * 5
    got = spelling_groups(frame(docs), least_length=3, least_count=2, ratio=2, every=7, block=block).collect()
    assert sorted(map(tuple, got), key=repr) == groups_by_hand(docs, 3, 2, 2, 7)


def test_spelling_roots_and_ties(frame):
    texts = ["planet " * 200, "planes " * 30, "plates " * 5, "garden " * 50, "gardes " * 7, "gardet " * 7, "gardez " * 1, "barden " * 50]
    got = {r.word: tuple(r)[1:] for r in spelling_groups(frame(list(enumerate(texts)))).collect()}
    assert got["planes"] == ("planet", "planet", 30, 2, 200)
    assert got["plates"] == ("planes", "planet", 5, 1, 30)
    assert got["gardes"] == ("garden", "garden", 7, 2, 50)
    assert got["garden"] == (None, "garden", 50, 3, None) and got["barden"] == (None, "barden", 50, 1, None)
    assert "gardez" not in got
    for none in ([], [(1, None), (2, ""), (3, "abc " * 9)]):
        assert spelling_groups(frame(none)).count() == 0


def test_words_are_counted_in_parts(spark, frame, spelled, monkeypatch):
    whole = {r.word: r.n for r in word_counts(frame(spelled), 3, 1).collect()}
    monkeypatch.setattr(spelling, "HELD_WORDS", 10)
    assert {r.word: r.n for r in word_counts(frame(spelled), 3, 1).collect()} == whole
    assert near_words(word_counts(frame(spelled), 3, 1)).filter("n_near < 1").count() == 0


# -- personal data -------------------------------------------------------------------------------------------------------

RULES = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
         r"\+[0-9][\x20().0-9-]+[0-9]")


def base_by_hand(text):
    out = []
    for k, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            checked = sum(d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(digits[::-1])) % 10 == 0
            if (k == 0 or k == 1 and all(int(p) <= 255 for p in m[0].split(".")) or k == 2 and 12 <= len(digits) <= 19 and checked
                    or k == 3 and 9 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_follow_the_rules():
    rng = random.Random(14)
    pieces = ["a", "b.", "@", "1", "23", "256", ".", "-", " ", "+", "(", ")", "é", "\n", "4539 1488 0343 6467", "a@b.c", "1.2.3.4", "٣", "_", "%", "+1 (555) 123-4567"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25)))
        assert base_spans(text) == base_by_hand(text), text
    for long in ("a" * 30_000 + "@", "a@" * 20_000, "1." * 30_000, "1" * 30_000, "+1" + "(" * 30_000, "@a" * 20_000, "a@b." * 10_000, "1 " * 30_000):
        base_spans(long)


def test_marginals_are_exact_on_trees():
    rng = np.random.default_rng(15)
    labels, nodes = 4, 6
    node = rng.normal(size=(nodes, labels))
    left, right = np.array([0, 0, 3, 3, 1]), np.array([1, 2, 0, 4, 5])
    pair = rng.normal(size=(3, labels, labels))
    kind = np.array([0, 1, 2, 1, 0])
    total = np.zeros((nodes, labels))
    for y in itertools.product(range(labels), repeat=nodes):
        weight = math.exp(sum(node[i, y[i]] for i in range(nodes)) + sum(pair[k, y[a], y[b]] for a, b, k in zip(left, right, kind)))
        for i in range(nodes):
            total[i, y[i]] += weight
    got = np.exp(marginals(node, left, right, kind, pair))
    assert got == pytest.approx(total / total.sum(axis=1, keepdims=True), abs=1e-3)
    assert np.exp(marginals(node, left[:0], right[:0], kind[:0], pair)).sum(axis=1) == pytest.approx(1)


CARDS = ["4539148803436467", "4556737586899855", "5425233430109903"]


@pytest.fixture(scope="module")
def learnt(spark):
    rng = random.Random(16)
    kinds = [lambda: f"{sentence(rng, 1)}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", lambda: ".".join(str(rng.randint(1, 250)) for _ in range(4)),
             lambda: rng.choice(CARDS), lambda: f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"]
    docs = [(i, " ".join(f"{sentence(rng, 8)} {rng.choice(kinds)()}" for _ in range(3)) + f" {sentence(rng, 3)} {rng.randint(1, 99_999)} {sentence(rng, 2)}.") for i in range(300)]
    return learn(spark.createDataFrame(docs, "doc_id long, text string"))


def found_in(spark, model, text):
    row = personal_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    return [(s.kind, text[s.start:s.end], s.added) for s in row.spans]


def test_the_field_adds_what_the_rules_miss(spark, learnt):
    assert all(luhn(c) for c in CARDS)
    text = f"we took {CARDS[0]} for it. {sentence(random.Random(1), 60)} and {CARDS[1]} {CARDS[0]} again"
    assert base_spans(text) == [(8, 2, 24)]  # the two at the end run together for the rule
    assert [(k, t) for k, t, added in found_in(spark, learnt, text) if added] == [("card", CARDS[1]), ("card", CARDS[0])]
    text = "call +1 (826) 555-4081 190.137.223.204 now"
    assert base_spans(text) == [(23, 1, 38)]
    assert ("phone", "+1 (826) 555-4081", True) in found_in(spark, learnt, text)
    text = "call +1 (826) 555-4081 now. or later, " + "word " * 200 + "(826) 555-4081 it is"
    assert found_in(spark, learnt, text) == [("phone", "+1 (826) 555-4081", False), ("phone", "(826) 555-4081", True)]


def test_the_field_leaves_the_rest_alone(spark, learnt):
    for text in ("in 1999 and 2004, 12 of 34,000 people; see 3.4 and (826).", "version 1.2.3 at 10:30, chapter 4-5", "order 4539148803436468 and 99.99",
                 "ip 300.1.2.3 or 1.2.3", "a @ b, @name and x@y", "+12 +3 (4) 5-6"):
        assert found_in(spark, learnt, text) == []


def test_skip_edges_carry_labels():
    """Of two equal tokens the one with no evidence of its own follows the other; without the edge it does not."""
    model = Model.from_counts([(0, skip_chain.shape("<x>"), 0, 1), (2, 3, 1, 500)])
    labels = skip_chain.LABELS
    node = np.full((2, labels), math.log(0.01))
    node[:, 0] = math.log(0.9)
    node[0] = skip_chain.NEVER
    node[0, 5] = 0.0  # observed: the first token of a card
    none = np.zeros(0, np.int64)
    alone = np.exp(marginals(node, none, none, none, model.pair))
    linked = np.exp(marginals(node, np.array([0]), np.array([1]), np.array([4]), model.pair))
    assert alone[1, 0] > 0.8 and linked[1, 5] + linked[1, 6] > 0.8


def test_personal_spans_of_odd_rows(spark, frame, odd_rows):
    rng = random.Random(17)
    docs = odd_rows + [(20, f"{CARDS[0]} " * 3000), (21, "a@b.c " * 2000), (22, "(1) " * 5000), (22, " +1 (555) 123-4567 " * 300), (23, "é" + CARDS[2]),
                       (24, " ".join(str(rng.randint(0, 10**rng.randint(1, 17))) for _ in range(4000)))]
    rows = personal_spans(frame(docs)).collect()
    assert len(rows) == len(docs)
    texts = defaultdict(list)
    for doc, text in docs:
        texts[doc].append([(a, KINDS[k], z) for a, k, z in base_by_hand(text or "")])
    for r in rows:
        base = [(s.start, s.kind, s.end) for s in r.spans if not s.added]
        assert base in texts[r.doc_id]
        order = [(s.start, KINDS.index(s.kind)) for s in r.spans]
        assert order == sorted(order)
        taken = [(s.start, s.end) for s in r.spans if not s.added]
        assert not any(s.added and any(s.start < z and a < s.end for a, z in taken) for s in r.spans)
    assert personal_spans(frame([])).count() == 0
    repeated = personal_spans(frame(docs).repartition(7)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, repeated))


def test_op13_digests(spark, tmp_path):
    import hashlib

    from opsloom.llm.suite import op13_personal_data

    docs = [(1, f"x a.b@c.de 1.2.3.4, {CARDS[0]}, +1 (555) 123-4567"), (2, None), (3, "none")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op13_personal_data(spark, str(tmp_path)).collect()}
    spans = "email:2:10,ip:11:18,card:20:36,phone:38:55"
    assert tuple(got[1])[1:] == (1, 1, 1, 1, hashlib.sha256(spans.encode()).hexdigest(), spans)
    assert tuple(got[2])[1:] == tuple(got[3])[1:] == (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")

"""Operators 1, 7, 8 and 10: learnt models and tokenizers."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from opsloom.llm.bpe import Encoder, MergeTable, encode_decode
from opsloom.llm.language import Labeller, Model, identify, learn, viterbi
from opsloom.llm.longest_match import LongestMatch, token_counts
from opsloom.llm.neighbours import keep_quality, quality_scores
from opsloom.llm.subwords import END, byte_characters, chunk_words, read_vocabulary, text_chunks
from opsloom.llm.suite import vocabulary

from conftest import sentence

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "a", "ΑΣ ΟΔΟΣ Σ", "İstanbul ½²³ Ⅷ 日本語 é", "a\x1cb\x85c\xa0d", "<|endoftext|>x<|startoftext|> <|END",
       "<|endoftext|>'S it's I'LL don't", "a" * 3000, "aaaa aaa bbbb" * 20, "\U0001f600\U0001f600 __ -- ..", "a\x00b", "́x"]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    found = tokenizers.Tokenizer.from_file(vocabulary())
    found.no_padding()
    found.no_truncation()
    return found


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    mixed = ["".join(rng.choice("aàbcΣ'st <|>12½ \n\té日\U0001f44d_-") for _ in range(80)) for _ in range(300)]
    return ODD + mixed + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()]


def test_encoding_equals_the_library(texts, library):
    table = MergeTable(vocabulary())
    encoder = Encoder(table)
    for a in range(0, len(texts), 40):
        for text, ids in zip(texts[a:a + 40], encoder.encode(texts[a:a + 40])):
            want = library.encode(text or "", add_special_tokens=False).ids
            assert ids.tolist() == want, text
            assert table.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_encoding_of_a_table(frame, odd_rows, library):
    rows = [*odd_rows, *((100 + i, t) for i, t in enumerate(ODD))]
    found = encode_decode(frame(rows), vocabulary()).collect()
    assert len(found) == len(rows)
    for (doc, text), r in zip(sorted(rows, key=str), sorted(found, key=lambda r: str((r.doc_id,)))):
        assert r.n_tokens * 4 == len(r.ids)
    by_id = {r.doc_id: r for r in found}
    for doc, text in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(by_id[doc].ids, "<u4").tolist() == want
        assert hashlib.sha256(by_id[doc].decoded.encode()).digest() == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).digest()
    assert encode_decode(frame([]), vocabulary()).count() == 0


def greedy(pieces, word):
    marks = byte_characters()
    s = [marks[b] for b in word]
    s[-1] += END
    n = at = 0
    while at < len(s):
        to = next(k for k in range(len(s), at, -1) if "".join(s[at:k]) in pieces)
        at, n = to, n + 1
    return n


def test_longest_match_equals_greedy(texts):
    pieces = set(read_vocabulary(vocabulary())["ids"])
    words = list({w.encode() for t in texts if t and len(t) < 20_000 for c in text_chunks(t) for w in chunk_words(c)})[:4000]
    assert LongestMatch(list(pieces)).counts(words).tolist() == [greedy(pieces, w) for w in words]


def test_longest_match_with_failures():
    """A small vocabulary in which long partial matches fail again and again."""
    marks, rng = byte_characters(), random.Random(4)
    pieces = [*marks, *(m + END for m in marks), "abcabd", "abc", "bcabca", "caa", "aaaab", "aab" + END, "abcabcabd" + END]
    words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    assert LongestMatch(pieces).counts(words).tolist() == [greedy(set(pieces), w) for w in words]
    with pytest.raises(ValueError):
        LongestMatch(["a"])


def test_token_counts_of_a_table(frame, odd_rows):
    found = token_counts(frame(odd_rows), vocabulary()).collect()
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in found}
    assert len(found) == len(odd_rows) and got[1] == got[2] == got[3] == (0, 0) and got[4] == (1, 1)
    assert got[10] == (20_000, 20_000 * greedy(set(read_vocabulary(vocabulary())["ids"]), b"wer"))
    assert token_counts(frame([]), vocabulary()).count() == 0


def test_viterbi_is_optimal():
    rng = np.random.default_rng(6)
    for _ in range(60):
        counts = rng.integers(0, 6, 5)
        scores = rng.normal(0, 2, (int(counts.sum()), 3))
        found, at = viterbi(scores, counts, 1.5), 0
        for c in counts:
            own, part = found[at:at + c], scores[at:at + c]
            worth = lambda labels: sum(part[i, x] for i, x in enumerate(labels)) - 1.5 * sum(a != b for a, b in zip(labels, labels[1:]))
            assert worth(own) == pytest.approx(max((worth(p) for p in itertools.product(range(3), repeat=int(c))), default=0))
            at += c


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = identify(docs, spans=False).join(docs, "doc_id").filter("held_out").select("lang", "lang_pred", "score").collect()
    assert len(found) > 20 and sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_spans_of_a_mixed_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = learn(docs)
    one = {r.lang: r.text for r in docs.filter("length(text) > 1500 AND lang IN ('de', 'es')").collect()}
    text = " ".join(one["de"].split()[:60]) + " " + " ".join(one["es"].split()[:40])
    names, score, spans = Labeller(model, 8.0).documents([text])
    assert [s["lang"] for s in spans[0]] == ["de", "es"] and names == ["de"] and 0.4 < score[0] < 0.9


def test_scripts_narrow_the_languages():
    words = ["abc", "где", "你好"]
    uses = np.zeros((len(__import__("opsloom.llm.language", fromlist=["x"]).SCRIPT_NAMES), 2), bool)
    names = __import__("opsloom.llm.language", fromlist=["x"]).SCRIPT_NAMES
    uses[names.index("latin"), 0] = uses[names.index("cyrillic"), 1] = True
    scores = Model(["en", "ru"], np.full((1 << 16, 2), -5.0), uses).word_scores(words)
    assert scores[0, 0] > scores[0, 1] and scores[1, 1] > scores[1, 0] and scores[2, 0] == scores[2, 1]


def test_language_odd_rows(frame, odd_rows):
    found = identify(frame(odd_rows)).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(odd_rows)
    assert all(got[d].lang_pred == "und" and got[d].score == 0 and got[d].spans == [] for d in (1, 2, 3, 6, 7))
    assert got[4].lang_pred in ("en", "fr") and got[None].held_out is None
    assert got[8].held_out == (zlib.crc32(b"8") % 4 == 2)
    assert all(r.lang_pred == "und" for r in identify(frame([(1, "abc", None), (2, None, "en")])).collect())
    assert identify(frame([])).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").select("quality", "predicted").collect()
    assert sum(r.quality == r.predicted for r in found) >= 0.95 * len(found)
    assert all(r.predicted == 1 for r in found if r.quality == 1)


def test_quality_odd_rows(spark, frame, odd_rows):
    labels = [(8, 1, 0), (9, 0, 0), (9, 0, 0), (12, 1, 0), (10, None, 0), (None, 1, 0), (999, 0, 0), (6, 2, 0), (1, 1, 0), (4, 0, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = quality_scores(frame(odd_rows), table).collect()
    assert len(found) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert len({r.score for r in found if r.doc_id in (1, 2, 13)}) == 1
    kept = keep_quality(frame(odd_rows), table)
    assert kept.columns == frame(odd_rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in found if r.predicted)
    none = table.filter("quality = 7")
    assert {r.score for r in quality_scores(frame(odd_rows), none).collect()} == {0.5}
    assert quality_scores(frame([]), table).count() == 0 and keep_quality(frame([]), none).count() == 0


def test_quality_scores_by_hand(spark):
    """Features, nearest neighbours and votes worked out one by one."""
    from opsloom.llm import neighbours as nb

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    features, known = nb.labelled_sample(docs.select(docs.doc_id.cast("long").alias("doc_id"), "text"), labels, "quality", 5, 3000)
    wanted = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(known) == sum(1 for d in wanted if texts.get(d) is not None)
    assert known.sum() == sum(q for d, q in wanted.items() if texts.get(d) is not None)

    def by_hand(text):
        data, half = text.encode(), nb.FEATURES // 2
        found = np.zeros(nb.FEATURES)
        kinds = bytes(65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b >= 128 else 48 if 48 <= b < 58 else b for b in data)
        for at, width, values in ((0, half, data), (half, half - len(nb.REPEATS), kinds)):
            for i in range(len(values) - 2):
                gram = (values[i] << 16 | values[i + 1] << 8 | values[i + 2]) * 2654435761 % 2**32
                found[at + (gram >> 8) % width] += 1
        found = np.log1p(found)
        words = text.encode().split()
        if words:
            share = sum(a == b for a, b in zip(words, words[1:])) / len(words)
            found[nb.FEATURES - len(nb.REPEATS) + min(int(np.searchsorted(nb.REPEATS, share)), len(nb.REPEATS) - 1)] = nb.REPEAT_WEIGHT
        return found

    space = nb.Space.fit(features, known)
    vectors = space.vectors.astype(np.float64)
    scores = {r.doc_id: r.score for r in quality_scores(docs, labels).collect()}
    for doc in sorted(texts)[:60]:
        if not texts[doc]:
            continue
        x = by_hand(texts[doc]) * space.weights
        x = x / np.linalg.norm(x) @ space.projection.astype(np.float64)
        similar = vectors @ (x / np.linalg.norm(x))
        nearest = sorted(range(len(known)), key=lambda i: -similar[i])[:nb.NEIGHBOURS]
        votes = [max(similar[i], 0) ** 4 for i in nearest]
        assert scores[doc] == pytest.approx(sum(v * known[i] for v, i in zip(votes, nearest)) / sum(votes), abs=0.02)

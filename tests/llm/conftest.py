from __future__ import annotations

import random

import pytest

EXTRA = "row string, key long, score double, ranges string, doc long, node long, held_out string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("aeioubdgkmnrst") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with further columns whose names operators use themselves."""
    def build(rows, languages=("en", "fr")):
        full = []
        for i, (doc, text, *lang) in enumerate(rows):
            lang = lang[0] if lang else languages[i % len(languages)]
            full.append((doc, text, lang, "s", None if text is None else len(text), "x", i, 0.5, "y", 7, 8, "z"))
        return spark.createDataFrame(full, SCHEMA)
    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and blank texts, no words, one letter, ties, repeated rows, null ids, very long texts."""
    rng = random.Random(5)
    long = sentence(rng, 30_000)
    return [(1, None), (2, ""), (3, " \n\t\x0b "), (4, "a"), (5, "a"), (5, "a"), (6, "... --- !!!"), (7, "12 34"), (None, "null id " + sentence(rng, 80)),
            (8, long), (9, "x" * 50_000), (10, "wer " * 20_000), (11, "é́ नमस्ते 你好 \U0001f600"),
            (12, long[:9000]), (13, None), (-5, sentence(rng, 120)), (2**62, sentence(rng, 120))]

"""Language identification with script ranges and Viterbi spans (operator 1).

The script of a word, told by code-point ranges, narrows the languages to those that use it. Each word is scored for each
of them by its letter trigrams. Viterbi over the words of a text, with a penalty for each switch, labels spans of one
language, so that texts of several languages come apart.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.tables import fold
from opsloom.llm.words import slices

#: Script ranges by first code point; fixed values of the Unicode blocks. The last range is everything beyond.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"),
    (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xA720, "latin"),
    (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"))
_SCRIPT_AT = np.array([s[0] for s in SCRIPTS])
SCRIPT_NAMES = sorted({s[1] for s in SCRIPTS})
_SCRIPT_NUMBER = np.array([SCRIPT_NAMES.index(s[1]) for s in SCRIPTS])
WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
#: Documented bound of the learning sample: about so many documents of each language, chosen by a hash of their id.
SAMPLE = 1000
#: The model has a table for each language, so their number is bounded.
MOST_LANGUAGES = 500
#: A script counts as one of a language's from this share of its words.
SCRIPT_SHARE = 0.02
SWITCH = 8.0  # penalty, in natural logarithms
REMEMBERED = 200_000
UNDETERMINED = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    if not text:
        return []
    return [w for w in WORD.findall(text.lower()) if w[0].isalpha() or any(map(str.isalpha, w))]


def trigram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of words, one centred on each letter with a space at both ends; where each word's start; the script
    of each word's first letter."""
    joined = " " + " ".join(words) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    centre = np.flatnonzero(codes[1:-1] != 32) + 1
    mixed = (codes[centre - 1] * np.uint32(0x9E3779B1)) ^ (codes[centre] * np.uint32(0x85EBCA77)) ^ (codes[centre + 1] * np.uint32(0xC2B2AE3D))
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(lengths) - lengths
    script = _SCRIPT_NUMBER[np.searchsorted(_SCRIPT_AT, codes[centre[first]], side="right") - 1]
    return (mixed >> np.uint32(16)).astype(np.int64), first, script


@dataclass
class Model:
    """Languages, logarithmic trigram probabilities (bounded by BUCKETS a language), and which scripts each uses."""

    languages: list[str]
    scores: np.ndarray  # BUCKETS x languages
    uses: np.ndarray  # scripts x languages

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Logarithmic scores of words by language; a language that does not use the word's script is far behind, unless
        no language uses it."""
        bucket, first, script = trigram_buckets(words)
        found = np.add.reduceat(self.scores[bucket], first, axis=0)
        allowed = self.uses[script]
        return np.where(allowed | ~allowed.any(axis=1, keepdims=True), found, found - 50)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word of many texts at once: ``scores`` of all their words, ``counts`` words in each. The sum
    of the scores less ``penalty`` for each switch is the largest possible; of equal ones the first language stays."""
    labels = np.zeros(len(scores), np.int64)
    if not len(scores):
        return labels
    order = np.argsort(-counts, kind="stable")
    sizes, first = counts[order], (np.cumsum(counts) - counts)[order]
    sums = np.zeros((len(order), scores.shape[1]))
    came = np.zeros(scores.shape, np.int16)  # the label of the word before, for each label
    alive = len(order)
    stay = np.arange(scores.shape[1])
    for step in range(int(sizes[0])):
        alive = int(np.searchsorted(-sizes[:alive], -step, side="left"))
        at, now = first[:alive] + step, sums[:alive]
        if step:
            top = now.argmax(axis=1)
            best = now[np.arange(alive), top][:, None] - penalty
            switch = best > now
            came[at] = np.where(switch, top[:, None], stay)
            now = np.where(switch, best, now)
        sums[:alive] = now + scores[at]
    last = sums.argmax(axis=1)
    for step in range(int(sizes[0]) - 1, -1, -1):
        alive = int(np.searchsorted(-sizes, -step, side="left"))
        at = first[:alive] + step
        labels[at] = last[:alive]
        last[:alive] = came[at, last[:alive]]
    return labels


class Labeller:
    """Words of texts with their labels; remembers the scores of words."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))
        self.lengths = np.zeros(0, np.int64)

    def of(self, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, and of all words in a row: labels, lengths, scores."""
        if len(self.known) > REMEMBERED:
            self.__init__(self.model, self.penalty)
        lists = [words_of(t) for t in texts]
        flat = list(chain.from_iterable(lists))
        new = list(dict.fromkeys(w for w in flat if w not in self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.scores = np.concatenate([self.scores, self.model.word_scores(new)])
            self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, new), np.int64, len(new))])
        rows = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return lists, viterbi(self.scores[rows], counts, self.penalty), self.lengths[rows], self.scores[rows]

    def documents(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[list[dict]]]:
        """Language, score and spans (first word, words, language) of each text."""
        lists, labels, lengths, scores = self.of(texts)
        names, n = self.model.languages, len(self.model.languages)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        text = np.repeat(np.arange(len(lists)), counts)
        letters = np.bincount(text * n + labels, weights=lengths, minlength=len(lists) * n).reshape(len(lists), n)
        top = letters.argmax(axis=1)
        total = letters.sum(axis=1)
        share = np.where(total > 0, letters[np.arange(len(lists)), top] / np.where(total > 0, total, 1), 0.0)
        # how sure the words of the chosen language's spans are of it
        chosen = labels == top[text]
        fit = np.zeros((len(lists), n))
        np.add.at(fit, text[chosen], scores[chosen])
        fit = np.exp(fit - fit.max(axis=1, keepdims=True))
        sure = fit[np.arange(len(lists)), top] / fit.sum(axis=1)
        spans = []
        first = np.cumsum(counts) - counts
        for a, c in zip(first.tolist(), counts.tolist()):
            own = labels[a:a + c]
            cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if c else np.zeros(0, int)
            spans.append([{"first_word": int(x), "n_words": int(y), "lang": names[own[x]]} for x, y in zip(cuts, np.diff(np.append(cuts, c)))])
        return [names[t] if c else UNDETERMINED for t, c in zip(top, counts)], np.where(counts > 0, share * sure, 0.0), spans


def learn(docs: DataFrame, lang: str = "lang", sample: int = SAMPLE) -> Model:
    """From about ``sample`` documents of each language; rows without text or language teach nothing."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col("text").cast("string").alias("text")
                        ).filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("doc_id"))
    sizes = known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPT_NAMES), 0), bool))
    # of n documents of a language those whose hash lies in the lowest sample / n of its range, so about ``sample``
    limits = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample / r["count"]) * (1 << 32))))
    chosen = known.filter(F.pmod("h", F.lit(1 << 32)) < limits[F.col("lang")]).select("lang", "text")

    def count(batches):
        for batch in batches:
            for part in slices(batch):
                tables: dict[str, np.ndarray] = {}
                for name, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    words = words_of(text)
                    if words:
                        bucket, _, script = trigram_buckets(words)
                        own = tables.setdefault(name, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                        own += np.bincount(np.concatenate([bucket, BUCKETS + script]), minlength=len(own))
                for name, own in tables.items():
                    at = np.flatnonzero(own)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["lang", "at", "n"])

    # at most BUCKETS rows and a few a language
    rows = chosen.mapInArrow(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in rows})
    counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    for r in rows:
        counts[r["at"], languages.index(r["lang"])] = r["n"]
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    scores = np.log((grams + 0.3) / (grams.sum(axis=0) + 0.3 * BUCKETS))
    return Model(languages, scores, scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1))


def identify(docs: DataFrame, lang: str = "lang", folds: int = 4, held: int = 2, sample: int = SAMPLE, penalty: float = SWITCH,
             spans: bool = True) -> DataFrame:
    """doc_id, held_out, lang_pred, score and, with ``spans``, the spans (first_word, n_words, lang) of each whole text.

    Learns from rows with text and language whose crc32(doc_id as text) modulo ``folds`` is not ``held``, about ``sample``
    of each language. lang_pred is the language with the most letters in its spans; score is its share of the letters
    times how surely its words are of it. Texts without a letter, null texts, and all texts where nothing could be learnt
    get ``und``, score 0 and no spans. held_out is null where doc_id is. Repeated rows get the same values; other columns
    are not read.
    """
    train = docs.filter(fold(F.col("doc_id").cast("long"), folds) != held)
    model = docs.sparkSession.sparkContext.broadcast(learn(train, lang, sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        labeller = Labeller(model.value, penalty)
        for batch in batches:
            for part in slices(batch):
                column = part.column("text").to_pylist()
                if model.value.languages:
                    names, score, found = labeller.documents(column)
                else:
                    names, score, found = [UNDETERMINED] * len(column), np.zeros(len(column)), [[] for _ in column]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(found, kind)],
                    ["doc_id", "lang_pred", "score", "spans"])

    found = texts.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<first_word:long,n_words:long,lang:string>>")
    return found.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "lang_pred", "score", *(["spans"] if spans else []))

"""What the two tokenizer operators share: the vocabulary file, chunks of a text between white space, and their words.

A chunk is a maximal run of characters that are not white space; words never cross chunks, so each different chunk of a
task is worked on once.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from itertools import chain

import numpy as np
import regex

#: Unicode white space as ranges of code points; fixed values.
SPACES = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
          (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
SPACE = "".join(f"{chr(a)}-{chr(b)}" for a, b in SPACES)
#: Python's split() also cuts at these, and they are no white space here.
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
CHUNK = regex.compile(f"[^{SPACE}]+")
#: The file's own pattern of words, over lower-cased text; fixed value.
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
#: Chunks that a task remembers before it starts anew.
REMEMBERED = 300_000
END = "</w>"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """Of a tokenizers file with word ends: ids of the pieces, merges in order, ids of the special strings."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
    return {"ids": file["model"]["vocab"], "merges": merges,
            "special": {t["content"]: t["id"] for t in file["added_tokens"] if t["special"]}}


def text_chunks(text: str | None) -> list[str]:
    if not text:
        return []
    return CHUNK.findall(text) if SEPARATORS.search(text) else text.split()


def lowered(text: str) -> str:
    text = unicodedata.normalize("NFC", text)
    # letter by letter where str.lower() would look at the neighbours
    return text.lower() if "\u03a3" not in text else "".join(c.lower() for c in text)


def chunk_words(chunk: str) -> list[str]:
    return WORD.findall(lowered(chunk))


class ChunkNumbers:
    """Numbers the chunks of texts; ``learn`` is told the new ones in the order of their numbers."""

    def __init__(self, learn: Callable[[list[str]], None], forget: Callable[[], None]):
        self.known: dict[str, int] = {}
        self.learn, self.forget = learn, forget

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all chunks, and the first chunk of each text (length texts + 1)."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.forget()
        lists = [text_chunks(t) for t in texts]
        flat = list(chain.from_iterable(lists))
        new = list(dict.fromkeys(c for c in flat if c not in self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.learn(new)
        first = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
        return np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat)), first


class Ragged:
    """Arrays of different lengths, one after the other."""

    def __init__(self, kind: type):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.flat, self.first = np.zeros(0, self.kind), np.zeros(1, np.int64)

    def extend(self, flat: np.ndarray, counts: np.ndarray) -> None:
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
        self.flat = np.concatenate([self.flat, flat.astype(self.kind)])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of the given rows one after the other, and their lengths."""
        counts = self.first[rows + 1] - self.first[rows]
        shift = np.repeat(self.first[rows] - (np.cumsum(counts) - counts), counts)
        return self.flat[np.arange(len(shift)) + shift], counts

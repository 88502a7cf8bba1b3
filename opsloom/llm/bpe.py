"""BPE encoding and decoding in batched numpy merge rounds (operator 7).

The symbols of many words lie in one flat array. In each round every word merges all places of its lowest-rank pair; ranks
are found by binary search over the sorted pair keys. Words without a pair leave the array, so later rounds are short.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.subwords import END, ChunkNumbers, Ragged, byte_characters, chunk_words, read_vocabulary
from opsloom.llm.words import slices


class MergeTable:
    """A vocabulary as arrays. Its size is that of the vocabulary file, so it may be broadcast."""

    def __init__(self, path: str):
        read = read_vocabulary(path)
        ids, self.special = read["ids"], read["special"]
        self.size = max([*ids.values(), *self.special.values()]) + 1
        marks = byte_characters()
        # two symbols for each byte: within a word, and at its end
        self.start = np.array([[ids[c] for c in marks], [ids[c + END] for c in marks]])
        left, right = (np.array([ids[m[i]] for m in read["merges"]], np.int64) for i in (0, 1))
        made = np.array([ids["".join(m)] for m in read["merges"]], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order, made
        self.tokens = [b""] * self.size
        for token, number in chain(ids.items(), self.special.items()):
            self.tokens[number] = token.encode()

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has; words are not empty."""
        counts = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.zeros(len(data), int)
        ends[np.cumsum(counts) - 1] = 1
        symbols, word = self.start[ends, data], np.repeat(np.arange(len(words)), counts)
        done_symbols, done_words = [], []
        none = len(self.made)
        while len(symbols):
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.full(len(symbols), none)
            rank[:-1] = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.rank[at], none)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lengths = np.diff(np.append(first, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, first), lengths)
            open_ = least < none
            if not open_.all():
                done_symbols.append(symbols[~open_])
                done_words.append(word[~open_])
                symbols, word, rank, least = symbols[open_], word[open_], rank[open_], least[open_]
                if not len(symbols):
                    break
            here = rank == least
            # of a run of places, which overlap, every other one from the left
            places = np.flatnonzero(here)
            run = np.flatnonzero(np.concatenate([[True], np.diff(places) != 1]))
            offset = np.arange(len(places)) - np.repeat(run, np.diff(np.append(run, len(places))))
            places = places[offset % 2 == 0]
            symbols[places] = self.made[least[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            symbols, word = symbols[keep], word[keep]
        word = np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return np.concatenate(done_symbols)[order], np.bincount(word, minlength=len(words))

    def decode(self, ids: np.ndarray) -> bytes:
        """The file names no decoder: tokens as written, joined by one space."""
        return b" ".join(map(self.tokens.__getitem__, ids.tolist()))


class Encoder:
    """Encodes texts with a merge table; remembers the ids of chunks."""

    def __init__(self, table: MergeTable):
        self.table, self.ids = table, Ragged(np.uint32)
        self.chunks = ChunkNumbers(self._learn, self.ids.clear)
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(table.special, key=len, reverse=True))) + ")") if table.special else None

    def _learn(self, chunks: list[str]) -> None:
        words: dict[bytes, int] = {}
        parts, counts = [], []  # word numbers of the chunks; a special string counts down from -1
        special = list(self.table.special)
        for chunk in chunks:
            found = []
            for piece in self.cuts.split(chunk) if self.cuts and "<" in chunk else (chunk,):
                if piece in self.table.special:
                    found.append(-1 - special.index(piece))
                else:
                    found.extend(words.setdefault(w.encode("utf-8", "surrogatepass"), len(words)) for w in chunk_words(piece))
            parts.extend(found)
            counts.append(len(found))
        of_words = Ragged(np.uint32)
        if words:
            of_words.extend(*self.table.merge(list(words)))
        of_words.extend(np.array([self.table.special[s] for s in special], np.uint32), np.ones(len(special), np.int64))
        parts = np.array(parts, np.int64)
        rows = np.where(parts < 0, len(words) - 1 - parts, parts)
        flat, lengths = of_words.take(rows)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        self.ids.extend(flat, np.diff(ends[bounds]))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        numbers, first = self.chunks.of(texts)
        flat, counts = self.ids.take(numbers)
        ends = np.concatenate([[0], np.cumsum(counts)])[first]
        return np.split(flat, ends[1:-1]) if len(texts) else []


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit, as binary) and decoded of each text of ``docs``.

    ``path`` names a tokenizers file of the word-end kind. Ids equal the library's without added special tokens, truncation
    or padding; strings of special tokens in a text become their ids. ``decoded`` equals the library's decode with special
    tokens kept. Null and empty texts have no ids and an empty text. Every row of ``docs`` gives a row; other columns than
    doc_id and text are not read. Texts are taken whole.
    """
    table = docs.sparkSession.sparkContext.broadcast(MergeTable(path))

    def run(batches):
        encoder = Encoder(table.value)
        for batch in batches:
            for part in slices(batch):
                ids = encoder.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                     pa.array([table.value.decode(x).decode() for x in ids], pa.string())],
                    ["doc_id", "n_tokens", "ids", "decoded"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string"))

"""Token counts with a linear longest-match automaton (operator 10).

Greedy word-piece tokenization takes the longest piece that starts a word, then the longest that starts the rest. The
automaton is a trie of the pieces with a failure link for each node: where a node has no next symbol, the link says in
which node the match goes on, and a precomputed count how many tokens are popped on the way. So each symbol is read once
and no piece is ever built. The words of many texts step through the automaton together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.subwords import END, ChunkNumbers, byte_characters, chunk_words, read_vocabulary
from opsloom.llm.words import slices

#: Symbols: the bytes within a word, then the bytes that end one.
SYMBOLS = 512


class LongestMatch:
    """The automaton as arrays; their size follows the vocabulary, so they may be broadcast. Every byte must be a piece,
    within a word and at its end."""

    def __init__(self, pieces: list[str]):
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        child: list[dict[int, int]] = [{}]
        is_piece = [False]
        for piece in pieces:
            closes = piece.endswith(END) and piece != END
            symbols = [byte_of[c] for c in (piece[:-len(END)] if closes else piece)]
            if closes:
                symbols[-1] += 256
            node = 0
            for s in symbols:
                if s not in child[node]:
                    child[node][s] = len(child)
                    child.append({})
                    is_piece.append(False)
                node = child[node][s]
            is_piece[node] = True
        missing = [s for s in range(SYMBOLS) if s not in child[0] or not is_piece[child[0][s]]]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        link, popped = [0] * len(child), [0] * len(child)
        queue = [0]
        for node in queue:  # breadth first
            for s, at in child[node].items():
                queue.append(at)
                if is_piece[at]:
                    link[at], popped[at] = 0, 1
                    continue
                state, count = link[node], popped[node]
                while s not in child[state]:
                    count += popped[state]
                    state = link[state]
                link[at], popped[at] = child[state][s], count
        edges = sorted((node * SYMBOLS + s, at) for node, out in enumerate(child) for s, at in out.items())
        self.edge = np.array([e[0] for e in edges], np.int64)
        self.to = np.array([e[1] for e in edges], np.int64)
        self.link, self.popped = np.array(link, np.int64), np.array(popped, np.int64)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """How many pieces each word has; words are not empty."""
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        first = np.cumsum(lengths) - lengths
        data[first + lengths - 1] += 256
        first, sizes = first[order], lengths[order]
        state, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        alive = len(words)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            alive = int(np.searchsorted(-sizes[:alive], -step, side="left"))  # words longer than step
            symbol, todo = data[first[:alive] + step], np.arange(alive)
            while len(todo):
                key = state[todo] * SYMBOLS + symbol[todo]
                at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
                found = self.edge[at] == key
                state[todo[found]] = self.to[at[found]]
                todo = todo[~found]
                count[todo] += self.popped[state[todo]]
                state[todo] = self.link[state[todo]]
        while (state > 0).any():  # what is left open at the end
            count += np.where(state > 0, self.popped[state], 0)
            state = self.link[state]
        out = np.empty(len(words), np.int64)
        out[order] = count
        return out


class Counter:
    """Pieces of whole texts; remembers the counts of chunks."""

    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton
        self.words, self.pieces = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.chunks = ChunkNumbers(self._learn, self._forget)

    def _forget(self) -> None:
        self.words = self.pieces = np.zeros(0, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        numbers: dict[bytes, int] = {}
        lists = [[numbers.setdefault(w.encode("utf-8", "surrogatepass"), len(numbers)) for w in chunk_words(c)] for c in chunks]
        counts = self.automaton.counts(list(numbers))
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = np.fromiter((n for x in lists for n in x), np.int64, int(sizes.sum()))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        sums = np.concatenate([[0], np.cumsum(counts[flat])])
        self.words = np.concatenate([self.words, sizes])
        self.pieces = np.concatenate([self.pieces, sums[ends[1:]] - sums[ends[:-1]]])

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        numbers, first = self.chunks.of(texts)
        both = []
        for table in (self.words, self.pieces):
            sums = np.concatenate([[0], np.cumsum(table[numbers])])
            both.append(sums[first[1:]] - sums[first[:-1]])
        return both[0], both[1]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words and n_tokens (greedy longest-match pieces) of each whole text of ``docs``.

    ``path`` names a vocabulary file of the word-end kind: a piece with a word end only matches at the end of a word, the
    others only before it. Words are those of the file's own pattern over lower-cased text; its merges are not used. Null
    and empty texts count 0. Every row gives a row; other columns than doc_id and text are not read.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(LongestMatch(list(read_vocabulary(path)["ids"])))

    def run(batches):
        counter = Counter(automaton.value)
        for batch in batches:
            for part in slices(batch):
                words, pieces = counter.of(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words), pa.array(pieces)],
                                                 ["doc_id", "n_words", "n_tokens"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, n_words long, n_tokens long"))

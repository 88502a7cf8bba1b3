"""Personal data by fixed rules and a skip-chain conditional random field (operator 13).

The rules give the base spans. The field labels the tokens of a document that hold a digit or an ``@``: outside, or the first
or a later token of an email address, an ip address, a card or a phone number. Tokens of base spans are observed. Its factors:

* node: the kinds that a token's shape has (its runs of digits by length, its signs, whether its digits pass Luhn);
* chain: between neighbouring tokens, whether a span of a kind goes on;
* skip: between distant tokens that are equal or similar (the same last digits, the same name before the ``@``), whether
  they agree on the kind.

All three are learnt piece by piece from counts over all documents, with the base spans as labels. Loopy message passing then
carries what is known about one mention to its other mentions: a number that the rules miss, because it stands beside another
or is written in another way, gets the kind of the mentions that they find, and its shape's kind where there is none.

Both passes are narrow steps over the documents; what the driver sees is bounded by the shapes' buckets.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.words import slices

KINDS = ("email", "ip", "card", "phone")
LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN, MARK = re.compile(r"\S+"), re.compile(r"[0-9@]")
EDGES = "\"'`<>[]{}|,;:!?*#$%&=~_/\\."
#: Shapes are counted in so many buckets.
BUCKETS = 1 << 14
#: Weight of the overall shares beside a shape's own counts, and of 0.9 beside a skip edge's share of agreement.
PRIOR, AGREE = 2.0, (9.0, 1.0)
ROUNDS, DAMPING, ENOUGH = 30, 0.3, 1e-4
LABELS = 1 + 2 * len(KINDS)  # outside, then first and later token of each kind
KIND_OF = np.array([0, *(1 + k for k in range(len(KINDS)) for _ in range(2))])
NEVER = -60.0
SPAN = "struct<kind:string,start:int,end:int,added:boolean>"


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[::-1][::2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[::-1][1::2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_quad(text: str) -> bool:
    return all(len(part.lstrip("0")) < 4 and int(part.lstrip("0") or 0) <= 255 for part in text.split("."))


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses, in time linear in the text: the name is what can be one before an ``@``, after the last address."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            found.append((start, done))
        at = text.find("@", done)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of what the fixed rules find, sorted."""
    found = [(a, 0, z) for a, z in emails(text)]
    found += [(m.start(), 1, m.end()) for m in QUAD.finditer(text) if _is_quad(m[0])]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if _is_card(m[0])]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


@dataclass
class Tokens:
    """The marked tokens of some documents in order; -1 stands for a kind that is not observed, or for no group."""

    doc: list[int]
    start: list[int]
    end: list[int]
    text: list[str]
    joined: list[bool]  # one space apart from the token before, which is a marked one too
    kind: list[int]     # observed kind
    first: list[bool]   # an observed span starts here

    @staticmethod
    def of(texts: list[tuple[int, str]], spans: list[list[tuple[int, int, int]]]) -> Tokens:
        out = Tokens([], [], [], [], [], [], [])
        for (doc, text), known in zip(texts, spans):
            ended, at = -2, 0
            for m in TOKEN.finditer(text):
                if not MARK.search(m[0]):
                    continue
                core = m[0].strip(EDGES)
                if not MARK.search(core):
                    continue
                start = m.start() + m[0].index(core)
                if core[0] == "(" and (")" not in core or core[-1] == ")" and len(_digits(core)) > 6):
                    core, start = core[1:], start + 1
                if core[-1] == ")" and "(" not in core:
                    core = core[:-1]
                end = start + len(core)
                while at < len(known) and known[at][2] <= start:
                    at += 1
                over = next((s for s in known[at:at + len(KINDS)] if s[0] < end and s[2] > start), None)
                out.doc.append(doc)
                out.start.append(start)
                out.end.append(end)
                out.text.append(core)
                out.joined.append(start == ended + 1 and text[ended] == " ")
                out.kind.append(over[1] if over else -1)
                out.first.append(bool(over) and over[0] >= start)
                ended = end
        return out

    def skips(self) -> tuple[list[tuple[int, int]], list[int]]:
        """Pairs of tokens of a document with the same name: neighbouring mentions, and each mention that is not observed with
        the first that is. With each pair its type: equal or similar, for addresses, long and short numbers."""
        groups: dict[tuple[int, str], list[int]] = {}
        for i, (doc, text) in enumerate(zip(self.doc, self.text)):
            if name := _name(text):
                groups.setdefault((doc, name), []).append(i)
        pairs, types = [], []
        for (_, name), members in groups.items():
            if len(members) < 2:
                continue
            seen = next((p for p, i in enumerate(members) if self.kind[i] >= 0), None)
            links = list(zip(members, members[1:]))
            if seen is not None:
                links += [(members[seen], i) for p, i in enumerate(members) if self.kind[i] < 0 and abs(p - seen) > 1]
            for i, j in links:
                pairs.append((i, j))
                types.append(2 * (0 if "@" in name else 1 if len(name) > 6 else 2) + (self.text[i] != self.text[j]))
        return pairs, types


def _name(text: str) -> str:
    """What equal and similar tokens have in common; empty for tokens that tell too little."""
    if "@" in text:
        local = text[:text.index("@")].lower()
        return local + "@" if len(local) > 2 else ""
    digits = _digits(text)
    if len(digits) < 3:
        return ""
    return text.lower() if any(c.isalpha() for c in text) else digits[-10:]


def shape(text: str) -> int:
    """Bucket of a token's shape."""
    if "@" in text:
        sign = "@." if "." in text[text.index("@"):] else "@"
    elif re.fullmatch(r"[0-9]+(\.[0-9]+){3}", text):
        sign = "quad" if _is_quad(text) else "no quad"
    else:
        sign = re.sub("[^\\W\\d_]+", "a", re.sub("[0-9]+", lambda m: f"<{len(m[0])}>", text))
        sign = (sign if len(sign) < 33 else "long") + ("+" if _is_card(text) else "")
    return crc32(sign.encode()) % BUCKETS


def _marked(batch: pa.RecordBatch):
    """Texts of a slice that the rules or the field can find something in, with their base spans."""
    holds = np.asarray(pc.fill_null(pc.match_substring_regex(batch.column("text"), "[0-9@]"), False))
    rows = np.flatnonzero(holds).tolist()
    texts = list(zip(rows, batch.column("text").take(pa.array(rows, pa.int64())).to_pylist()))
    return texts, [base_spans(text) for _, text in texts]


def _counted(batches):
    """Rows (factor, place, outcome, n): 0 node by shape and kind; 1 chain by kind and whether it goes on; 2 skip by type and
    whether the kinds agree."""
    found: Counter = Counter()
    for part in (p for batch in batches for p in slices(batch)):
        tokens = Tokens.of(*_marked(part))
        kind = tokens.kind
        found.update((0, shape(text), 1 + k) for text, k in zip(tokens.text, kind))
        for i in range(1, len(kind)):
            if tokens.joined[i] and kind[i - 1] >= 0:
                found[1, kind[i - 1], int(kind[i] == kind[i - 1] and not tokens.first[i])] += 1
        for (i, j), t in zip(*tokens.skips()):
            if kind[i] >= 0 or kind[j] >= 0:
                found[2, t, int(kind[i] == kind[j])] += 1
    columns = list(zip(*((*key, n) for key, n in found.items()))) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["factor", "place", "outcome", "n"])


@dataclass
class Model:
    """Logarithms of the field's factors: ``node`` (buckets, kinds with outside first), ``pair`` (chain, then skip types;
    labels, labels)."""

    node: np.ndarray
    pair: np.ndarray

    @staticmethod
    def from_counts(rows) -> Model:
        kinds = 1 + len(KINDS)
        node, on, agree = np.zeros((BUCKETS, kinds)), np.ones((len(KINDS), 2)), np.tile(np.array(AGREE[::-1]), (6, 1))
        for factor, place, outcome, n in rows:
            (node, on, agree)[factor][place, outcome] += n
        shares = (node.sum(axis=0) + 1) / (node.sum() + kinds)
        node = np.log((node + PRIOR * shares) / (node.sum(axis=1, keepdims=True) + PRIOR))
        goes_on = on[:, 1] / on.sum(axis=1)
        chain = np.zeros((LABELS, LABELS))
        for k in range(len(KINDS)):
            first, later = 1 + 2 * k, 2 + 2 * k
            chain[:, later] = NEVER
            for y in (first, later):
                chain[y] += np.log(1 - goes_on[k])
                chain[y, later] = np.log(goes_on[k])
        for k in range(len(KINDS)):  # nothing but its own kind goes on
            others = [y for y in range(LABELS) if KIND_OF[y] != 1 + k]
            chain[others, 2 + 2 * k] = NEVER
        share = agree[:, 1] / agree.sum(axis=1)
        same = KIND_OF[:, None] == KIND_OF[None, :]
        skip = np.where(same[None], np.log(share)[:, None, None], np.log((1 - share) / len(KINDS))[:, None, None])
        return Model(node, np.concatenate([chain[None], skip]))


def _normal(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def marginals(node: np.ndarray, left: np.ndarray, right: np.ndarray, kind: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Logarithms of the label shares of each node by loopy message passing: ``node`` (nodes, labels) and, for each edge, its
    ends and the factor table ``pair[kind]`` over (left's label, right's label). Exact where the edges form a forest."""
    edges = len(left)
    if not edges:
        return _normal(node)
    to, source = np.concatenate([right, left]), np.concatenate([left, right])
    tables = np.concatenate([pair[kind], pair[kind].transpose(0, 2, 1)])  # over (source's label, target's label)
    back = np.concatenate([np.arange(edges) + edges, np.arange(edges)])
    order = np.argsort(to, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], to[order][1:] != to[order][:-1]]))
    sent = np.zeros((2 * edges, node.shape[1]))

    def belief() -> np.ndarray:
        out = node.copy()
        out[to[order][heads]] += np.add.reduceat(sent[order], heads, axis=0)
        return out

    for _ in range(ROUNDS):
        open_ = belief()[source] - sent[back]
        terms = open_[:, :, None] + tables
        top = terms.max(axis=1)
        new = _normal(top + np.log(np.exp(terms - top[:, None, :]).sum(axis=1)))
        change = np.abs(new - sent).max()
        sent = (1 - DAMPING) * new + DAMPING * sent
        if change < ENOUGH:
            break
    return _normal(belief())


def added_spans(model: Model, tokens: Tokens) -> list[tuple[int, int, int, int]]:
    """(document, start, kind's number, end) of what the field finds beside the base spans."""
    n = len(tokens.text)
    if all(k >= 0 for k in tokens.kind):
        return []
    seen, joined = np.array(tokens.kind), np.array(tokens.joined)
    by_kind = model.node[[shape(text) for text in tokens.text]]
    node = by_kind[:, KIND_OF]
    node[:, 1::2] += np.log(0.5)
    node[:, 2::2] += np.log(0.5)
    node[np.ix_(~joined, np.arange(2, LABELS, 2))] = NEVER
    known = np.flatnonzero(seen >= 0)
    node[known] = NEVER
    node[known, 1 + 2 * seen[known] + ~np.array(tokens.first)[known]] = 0
    pairs, types = tokens.skips()
    chain = np.flatnonzero(joined)
    left = np.concatenate([chain - 1, np.array([i for i, _ in pairs], np.int64)]).astype(np.int64)
    right = np.concatenate([chain, np.array([j for _, j in pairs], np.int64)]).astype(np.int64)
    table = np.concatenate([np.zeros(len(chain), np.int64), 1 + np.array(types, np.int64)]).astype(np.int64)
    works = (seen[left] < 0) | (seen[right] < 0)
    shares = np.exp(marginals(node, left[works], right[works], table[works], model.pair))
    of_kind = np.stack([shares[:, KIND_OF == k].sum(axis=1) for k in range(1 + len(KINDS))], axis=1)
    kind = np.where((of_kind.max(axis=1) > 0.5) & (seen < 0), of_kind.argmax(axis=1) - 1, -1)
    out, i = [], 0
    while i < n:
        j, k = i + 1, int(kind[i])
        if k >= 0:
            while j < n and joined[j] and kind[j] == k and shares[j, 2 + 2 * k] > shares[j, 1 + 2 * k]:
                j += 1
            if _fits(k, " ".join(tokens.text[i:j])):
                out.append((tokens.doc[i], tokens.start[i], k, tokens.end[j - 1]))
        i = j
    return out


def _fits(kind: int, text: str) -> bool:
    """Whether a span can be of a kind at all."""
    digits = _digits(text)
    return ("@" in text, text.count(".") == 3, _is_card(text), 7 <= len(digits) <= 15 and not any(c.isalpha() for c in text))[kind]


def _found(model):
    def run(batches):
        for part in (p for batch in batches for p in slices(batch)):
            spans = [[] for _ in range(part.num_rows)]
            texts, base = _marked(part)
            tokens = Tokens.of(texts, base)
            for (row, _), known in zip(texts, base):
                spans[row] = [(a, k, z, False) for a, k, z in known]
            for row, a, k, z in added_spans(model.value, tokens):
                spans[row].append((a, k, z, True))
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))
            rows = [[{"kind": KINDS[k], "start": a, "end": z, "added": new} for a, k, z, new in sorted(s)] for s in spans]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kinds)], ["doc_id", "spans"])
    return run


def learn(docs: DataFrame) -> Model:
    """The field's factors, from counts over all texts of ``docs``."""
    counts = docs.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").mapInArrow(
        _counted, "factor long, place long, outcome long, n long")
    return Model.from_counts(tuple(r) for r in counts.groupBy("factor", "place", "outcome").agg(F.sum("n")).collect())


def personal_spans(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id and spans (kind, start, end, added) of each row of ``docs``: the personal data in its text, places in code points,
    the end exclusive, by start and then in the order of KINDS. ``added`` marks what the field found and the rules did not.

    ``docs`` has doc_id and text; other columns are not read. Null and empty texts have no spans; null and repeated doc_ids
    are kept as they are, every row is a text of its own; an empty table gives an empty result. Texts are taken whole. Without
    a ``model`` the field is learnt from ``docs`` itself.
    """
    model = docs.sparkSession.sparkContext.broadcast(model or learn(docs))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_found(model), f"doc_id long, spans array<{SPAN}>")


def span_text(spans: str | Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

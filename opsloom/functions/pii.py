"""PII redaction without a UDF: numbered tokens, token map, restore."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as an e-mail, phone, social-security and card number, in redaction order.
PATTERNS = {
    "EMAIL": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
    "PHONE": r"\(?\b[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CC": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
}


def _number_matches(text: Column, kind: str) -> Column:
    """Each match of the kind becomes ``[KIND_n]``, numbered from 1 in text order."""
    parts = F.split(text, PATTERNS[kind], -1)
    numbered = F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(
        F.concat(F.lit(f"[{kind}_"), i.cast("string"), F.lit("]"), part)))
    return F.array_join(numbered, "")


def _stages(text: Column) -> list[tuple[str, Column]]:
    """Per kind, the text its pattern is applied to: earlier kinds are already tokens."""
    stages = []
    for kind in PATTERNS:
        stages.append((kind, text))
        text = _number_matches(text, kind)
    return stages


def redact(text: Column) -> Column:
    for kind in PATTERNS:
        text = _number_matches(text, kind)
    return text


def pii_matches(text: Column, kind: str) -> Column:
    """What a kind's pattern finds in the text as given, on its own."""
    return F.regexp_extract_all(text, F.lit(PATTERNS[kind]), 0)


def token_map(text: Column) -> Column:
    """Token to original text, for :func:`restore`."""
    def entries(kind: str, staged: Column) -> Column:
        return F.transform(pii_matches(staged, kind), lambda match, i: F.struct(
            F.concat(F.lit(f"[{kind}_"), (i + 1).cast("string"), F.lit("]")).alias("token"), match.alias("original")))

    return F.map_from_entries(F.concat(*[entries(kind, staged) for kind, staged in _stages(text)]))


def restore(text: Column, mapping: Column) -> Column:
    return F.aggregate(F.map_entries(mapping), text, lambda done, e: F.replace(done, e["key"], e["value"]))

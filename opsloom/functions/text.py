"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that separates words, beyond ASCII too.
SPACE_CLASS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# A run of them for Java's matcher, which tells by one comparison that most other characters, those of ASCII, are none.
_SPACE_RUN = rf"[\x00-\x20\x{{7F}}-\x{{10FFFF}}&&{SPACE_CLASS}]+"

# The same characters one by one.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# A term is two or more letters, digits or underscores.
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"

# English stop words (Spark ML's default list for English, as plain words).
ENGLISH_STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until while of at by for with
about against between into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now could cannot ought would
""".split())


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """Non-empty words in order."""
    # only a text of nothing but spaces has an empty word after the ends are stripped
    return F.array_remove(F.split(strip(text), _SPACE_RUN), "")


def kept_terms(text: Column, stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS) -> Column:
    """Lower-case terms in order, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({TERM_PATTERN})"), 1)
    return F.filter(found, lambda w: ~w.isin(*stop_words)) if stop_words else found


def with_pairs(kept: Column) -> Column:
    """The terms and the pairs of neighbours among them. ``kept`` should be a plain column."""
    n = F.greatest(F.size(kept) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(kept, F.lit(1), n), F.slice(kept, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(kept, pairs)

"""Steps whose work must not grow faster than their input."""

from __future__ import annotations

import random

from pyspark.sql import functions as F


def test_range_totals_make_no_pairs(spark):
    """Totals over 40,000 copies of one range and 40,000 points in it, 1.6 billion pairs, beside mixed ranges by brute force."""
    from opsloom.operators.joins import range_join

    rng = random.Random(5)
    points = [(i, rng.choice((0.0, -1.0, 2.5, 7.0, rng.uniform(-9, 9)))) for i in range(300)] + [(900, None), (901, float("nan"))]
    ranges = [(i, float(a), float(a + rng.choice((0, 1, 2.5, 40)))) for i in range(40) for a in (rng.choice((0, -1, 2.5, rng.uniform(-9, 9))),)]
    ranges += [ranges[0], ranges[0], (50, None, 3.0), (51, 2.0, float("nan")), (52, 500.0, 600.0), (53, float("-inf"), float("inf"))]
    got = range_join(spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(ranges, "r int, a double, b double"), "x", "a", "b",
                     totals={"n": F.lit(1), "digest": F.col("p")})
    want = []
    for r, a, b in ranges:
        inside = [p for p, x in points if None not in (a, b, x) and a < b and a <= x < b]
        want += [(r, a, b, len(inside), sum(inside))] if inside else []
    assert sorted(map(tuple, got.collect())) == sorted(want)
    many = spark.range(40_000).select("id", F.lit(5.0).alias("x"))
    wide = spark.range(40_000).select(F.col("id").alias("r"), F.lit(4.0).alias("a"), F.lit(6.0).alias("b"))
    summed = range_join(many, wide, "x", "a", "b", totals={"n": F.lit(1).cast("long")}).agg(F.count(F.lit(1)), F.sum("n")).first()
    assert tuple(summed) == (40_000, 1_600_000_000)


def test_overlaps_with_more_columns_than_bits(spark):
    """70 key columns, so two words of bits; nulls are no keys."""
    from opsloom.operators.relationships import Edge, _overlaps

    wide = spark.createDataFrame([tuple(range(i, i + 70)) for i in range(10)] + [(None,) * 70], ", ".join(f"c{i} int" for i in range(70)))
    other = spark.createDataFrame([("5",), ("70",), ("99",), (None,)], "k string")
    edges = [Edge("wide", f"c{i}", "other", "k") for i in range(70)] + [Edge("other", "k", "wide", "c69")]
    got = {r["_edge"]: (r.source_distinct, r.overlap) for r in _overlaps(spark, {"wide": wide, "other": other}, edges).collect()}
    want = {i: (10, sum(i <= k < i + 10 for k in (5, 70, 99))) for i in range(70)} | {70: (3, 1)}
    assert got == want


def test_overlaps_shuffle_a_key_once(spark):
    """One row per key and one shuffle of keys, however many columns hold it."""
    from opsloom.operators.relationships import Edge, _overlaps

    tables = {t: spark.range(1000).select(F.col("id").alias("k")) for t in "abcd"}
    found = _overlaps(spark, tables, [Edge(s, "k", t, "k") for s in "abcd" for t in "abcd" if s != t])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_key" in plan and "Aggregate [_edge#" in plan and plan.count("Aggregate [") == 3
    assert {(r.source_distinct, r.overlap) for r in found.collect()} == {(1000, 1000)}


def test_strip_and_words_scan_the_ends_only(spark):
    """Every space character and its neighbours; no regular expression runs over a text to strip it."""
    from opsloom.functions.text import SPACE_CLASS, strip, words

    texts = [chr(c) + "a" + chr(c) + chr(c) + "b" + chr(c) + "\n" for c in [*range(1, 0x300), 0x1680, 0x180E, *range(0x1FFF, 0x2062), 0x3000, 0x3001, 0xFEFF]]
    texts += ["", " ", " \n\t", "a", None, "a  ", "\r\n a\r\nb \r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old_strip = F.regexp_replace("t", rf"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")
    old_words = F.filter(F.split("t", rf"{SPACE_CLASS}+"), lambda w: w != "")
    assert df.filter(~strip(F.col("t")).eqNullSafe(old_strip) | ~words(F.col("t")).eqNullSafe(old_words)).count() == 0
    assert "regexp" not in df.select(strip(F.col("t")))._jdf.queryExecution().optimizedPlan().toString().lower()

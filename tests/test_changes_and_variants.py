"""Change capture, exception buckets, late rows, relationships by values, changes by dimension and spelling variants."""

from __future__ import annotations

import itertools
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from opsloom.operators.analytics import rolling_average, subtotals
from opsloom.operators.drivers import attribute_change
from opsloom.operators.relationships import discover_by_values, value_sketches
from opsloom.operators.rules import Condition, Rule, evaluate_table_rules
from opsloom.operators.variants import category_variants, near_values
from opsloom.sources.changes import change_summary, read_keyed, refresh_keyed, row_changes
from opsloom.streaming import flows


def test_row_changes_of_odd_rows(spark):
    schema = "a int, b string, x string, y int"
    old = spark.createDataFrame([(1, "p", "s", 1), (2, "p", "s", None), (3, "p", None, 3), (4, "p", "s", 4), (5, "d", "s", 1), (5, "d", "t", 1),
                                 (None, "n", "s", 1), (None, None, "s", 1), (7, "r", "s", 1), (8, "c", "u", 5), (8, "c", "v", 5)], schema)
    new = spark.createDataFrame([(1, "p", "s", 1), (2, "p", "s", 0), (3, "p", "s", 4), (6, "p", "s", 4), (5, "d", "t", 1), (5, "d", "s", 1),
                                 (None, "n", "s", 2), (None, None, "s", 1), (7, "r", "s", 1), (7, "r", "s", 1), (8, "c", "u", 5), (8, "c", "w", 5)], schema)
    found = row_changes(old, new, ["a", "b"])
    assert {(r.a, r.b): (r.change, r.changed_columns) for r in found.collect()} == {
        (2, "p"): ("changed", ["y"]), (3, "p"): ("changed", ["x", "y"]), (4, "p"): ("deleted", []), (6, "p"): ("inserted", []),
        (None, "n"): ("changed", ["y"]), (7, "r"): ("changed", ["(rows)", "x", "y"]), (8, "c"): ("changed", ["x"])}
    assert tuple(change_summary(found).first()) == (1, 1, 5)
    assert row_changes(old, old.drop("y"), ["a", "b"]).filter("change = 'changed'").select(F.explode("changed_columns")).distinct().first()[0] == "y"
    assert row_changes(old, old.repartition(5), ["a", "b"]).count() == 0
    assert row_changes(old.limit(0), old.limit(0), ["a", "b"]).count() == 0


def test_refresh_writes_changed_buckets_only(spark, tmp_path):
    folder = str(tmp_path / "table")
    first = spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert refresh_keyed(spark, folder, first, ["k"], buckets=8).count() == 200
    before = {p: p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}
    second = first.withColumn("v", F.when(F.col("k") == 17, -1).otherwise(F.col("v")))
    assert [tuple(r) for r in refresh_keyed(spark, folder, second, ["k"], buckets=8).collect()] == [(17, "changed", ["v"])]
    after = {p: p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}
    assert len(set(before.items()) & set(after.items())) == 7
    assert {tuple(r) for r in read_keyed(spark, folder).select("k", "v").collect()} == {tuple(r) for r in second.collect()}
    bucket = F.pmod(F.xxhash64("k"), F.lit(8))
    emptied = second.filter(bucket != 3)
    refresh_keyed(spark, folder, emptied, ["k"], buckets=8)
    assert sorted(r.k for r in read_keyed(spark, folder).collect()) == sorted(r.k for r in emptied.collect())


def test_exception_batches_read_what_they_touch(spark, tmp_path):
    rule = Rule("big", "order", "orders", "HIGH", (Condition("amount", "gt", 100),))
    found = lambda rows: evaluate_table_rules(spark.createDataFrame(rows, "order_id string, amount double"), [rule], "2024-01-01")
    store = flows.ExceptionStore(spark, str(tmp_path / "store"), buckets=4)
    store.merge(found([(f"o{i}", 200.0 + i) for i in range(40)]), 0)
    sizes = []
    for batch in range(1, 6):
        touched = {r[0] for r in found([("o7", 500.0 + batch)]).select(store._bucket()).collect()}
        folders = store.folders(2 * batch, sorted(touched))
        assert len(folders) == 1  # one version of one bucket, whatever came before
        sizes.append(spark.read.parquet(*folders).count())
        store.merge(found([("o7", 500.0 + batch)]), batch)
        store.merge(found([("o7", 500.0 + batch)]), batch)  # a retry
    assert len(set(sizes)) == 1 and sizes[0] < 40
    versions = [len(list(p.glob("version=*"))) for p in Path(tmp_path / "store").glob("bucket=*")]
    assert max(versions) == 2
    state = store.read(6)
    assert state.count() == 40
    closing = state.filter("entity_id = 'o7'").select("rule_name", "entity_id", "exception_id", F.lit("RESOLVED").alias("status"), F.current_timestamp().alias("ts"))
    store.apply_status(closing, 5)
    store.merge(found([("o7", 900.0)]), 6)
    rows = store.read(7).filter("entity_id = 'o7'").collect()
    assert sorted(r.status for r in rows) == ["OPEN", "RESOLVED"] and len({r.exception_id for r in rows}) == 2
    store.merge(found([]), 7)
    assert store.read(8).count() == 41


def test_late_rows_correct_their_windows(spark, tmp_path):
    folder, landing = str(tmp_path / "flow"), str(tmp_path / "in")
    for rows in ([("2024-01-01 10:00:00", 1), ("2024-01-03 10:00:00", 2), (None, 9)], [("2024-01-01 11:00:00", 4), ("2024-01-03 09:30:00", 8)], []):
        df = spark.createDataFrame(rows, "t string, v int").select(F.col("t").cast("timestamp").alias("ts"), "v")
        df.write.mode("append").parquet(landing)
        flows.windows_with_corrections(flows.read_folder_stream(spark, landing, df.schema), "ts", {"s": F.sum("v")}, folder).awaitTermination()
    got = {str(r.window_start)[:10]: (r.s, r.late_rows) for r in spark.read.parquet(f"{folder}/windows").collect()}
    assert got == {"2024-01-01": (5, 1), "2024-01-03": (10, 0)}


@pytest.mark.parametrize("size", [16, 1024])
def test_relationships_by_values(spark, size):
    rng = random.Random(3)
    sets = {"a.key": list(range(300)), "b.ref": [rng.randrange(300) for _ in range(900)], "b.other": [rng.randrange(5000, 9000) for _ in range(900)],
            "c.code": [f"x{i}" for i in range(120)], "d.tag": [f"x{rng.randrange(125)}" for _ in range(400)], "d.few": [1, 2, 3, None] * 100,
            "e.none": [None] * 10, "e.one": [7] * 10, "c.again": list(range(1000, 1120))}
    tables = {}
    for name, group in itertools.groupby(sorted(sets), key=lambda n: n[0]):
        columns = [n[2:] for n in group]
        rows = list(itertools.zip_longest(*[sets[f"{name}.{c}"] for c in columns]))
        kinds = ["string" if any(isinstance(x, str) for x in sets[f"{name}.{c}"]) else "bigint" for c in columns]
        tables[name] = spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in zip(columns, kinds)))
    found = {(r.source_table, r.source_column, r.target_table, r.target_column): (r.source_distinct, r.overlap) for r in discover_by_values(spark, tables, 0.9, size=size).collect()}
    want = {}
    for s, t in itertools.permutations(sets, 2):
        ours, theirs = {x for x in sets[s] if x is not None}, [x for x in sets[t] if x is not None]
        if s[0] != t[0] and len(ours) >= 2 and theirs and len(theirs) == len(set(theirs)) and len(ours & set(theirs)) >= 0.9 * len(ours):
            want[(s[0], s[2:], t[0], t[2:])] = (len(ours), len(ours & set(theirs)))
    assert found == want and ("b", "ref", "a", "key") in found and ("d", "tag", "c", "code") in found
    counts = Counter((r.table_name, r.column_name) for r in value_sketches(tables, size).collect())
    assert max(counts.values()) <= size


def test_change_by_dimensions(spark):
    rows = [("before", "x", "p", 10.0), ("after", "x", "p", 30.0), ("before", "y", "p", 5.0), ("after", "y", None, 1.0), ("other", "x", "p", 1e6)]
    df = spark.createDataFrame(rows, "when string, a string, b string, m double")
    got = {(r.a, r.b): (r.change, r.share_percentage) for r in attribute_change(df, F.col("when"), ["a", "b"], F.col("m")).collect()}
    # x says all that x and p say
    assert got == {(None, None): (16.0, 100.0), ("x", None): (20.0, 125.0), ("y", None): (-4.0, -25.0), (None, "p"): (15.0, 93.8),
                   (None, "(none)"): (1.0, 6.3), ("y", "p"): (-5.0, -31.3)}
    assert [r.change for r in attribute_change(df, F.col("when"), ["a", "b"], F.col("m"), k=2).collect()] == [20.0, 16.0]
    assert attribute_change(df.limit(0), F.col("when"), ["a"], F.col("m")).filter("change <> 0").count() == 0
    for bad in ([], ["a", "b", "when", "m"]):
        with pytest.raises(ValueError):
            attribute_change(df, F.col("when"), bad, F.col("m"))


def test_category_variants(spark):
    values = ["Delivered"] * 9 + ["delivered ", "Delivred", "Delivrd", "Deliverd"] + ["Pending"] * 3 + ["on", "in", "of"] * 4 + [None, "", "Zürich", "Zurich", "Zuerich", "Munchen", "Muenchenn"]
    df = spark.createDataFrame([(v, "x") for v in values], "status string, other string")
    got = {r.value: (r.canonical, r.group_values, r.group_rows) for r in category_variants(df, ["status", "other"]).collect()}
    # one edit at a time: Delivrd hangs on Delivred, and that on Delivered
    assert {v for v, g in got.items() if g == ("Delivered", 5, 13)} == {"Delivered", "delivered ", "Delivred", "Delivrd", "Deliverd"}
    assert got["Zürich"] == ("Zuerich", 3, 3) and "Munchen" not in got and "Pending" not in got and "on" not in got
    two = {r.value: r.group_values for r in category_variants(df, ["status"], edits=2).collect()}
    assert two["Zuerich"] == 3 and two["Munchen"] == 2
    assert category_variants(df.limit(0), ["status"]).count() == 0
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 6))) for _ in range(150)})
    listed = spark.createDataFrame([("c", w) for w in words], "column_name string, norm string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = _next(row, x, b, i)
        return row[-1]

    def _next(row, x, b, i):
        out = [i + 1]
        for j, y in enumerate(b):
            out.append(min(row[j] + (x != y), row[j + 1] + 1, out[j] + 1))
        return out
    for edits in (1, 2):
        want = {(a, b) for a, b in itertools.permutations(words, 2) if min(len(a), len(b)) >= 4 and distance(a, b) <= edits}
        assert {(r.norm, r.other) for r in near_values(listed, edits).collect()} == want


def test_subtotals_and_order(spark):
    df = spark.createDataFrame([("x", None, 1), ("x", "p", 2), (None, "p", 4)], "a string, b string, v int")
    got = {(r.a, r.b, r.level): r.s for r in subtotals(df, ["a", "b"], {"s": F.sum("v")}, "cube").collect()}
    assert got == {("x", None, 0): 1, ("x", "p", 0): 2, (None, "p", 0): 4, ("x", None, 1): 3, (None, None, 1): 4, (None, None, 2): 1, (None, "p", 2): 6,
                   (None, None, 3): 7}
    assert subtotals(df, ["a", "b"], {"s": F.sum("v")}).count() == 6
    assert {r.level for r in subtotals(df, ["a", "b"], {"s": F.sum("v")}, [["b"], []]).collect()} == {2, 3}
    for bad in ("both", [["c"]]):
        with pytest.raises(ValueError):
            subtotals(df, ["a", "b"], {"s": F.sum("v")}, bad)
    with pytest.raises(ValueError):
        rolling_average(df, "a", "v", 3, order_by=[])


def test_board_reads_states_only(spark, tmp_path):
    from opsloom.operators.kpi import Metric, kpi_board
    from opsloom.operators.kpi_states import State, StateTable, board_from_states

    facts = spark.range(90).select((F.lit("2024-01-01 06:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int") % 17)).alias("at"),
                                   (F.col("id") * 1.5).alias("x"))
    late = spark.createDataFrame([(None, 1e9)], "at timestamp_ntz, x double")
    table = StateTable(spark, str(tmp_path / "facts"), "at", [State("s", "SUM(x)"), State("n", "COUNT(*)"), State("top", "MAX(x)", "max")])
    for batch in (0, 1, 1, 2):
        table.add(facts.filter(F.col("x") % 4.5 == batch * 1.5).unionByName(late), batch)
    metrics = [Metric("S", "S", "facts", "SUM(s)", "day"), Metric("A", "A", "facts", "SUM(s) / SUM(n)", "day", "rate"), Metric("T", "T", "facts", "MAX(top)", "day", "rate")]
    full = [Metric("S", "S", "facts", "SUM(x)", "at", grain="day"), Metric("A", "A", "facts", "AVG(x)", "at", "rate", grain="day"),
            Metric("T", "T", "facts", "MAX(x)", "at", "rate", grain="day")]
    shown = lambda df: sorted((r.code, r.current_value, r.previous_value, [tuple(p) for p in r.sparkline]) for r in df.collect())
    want = shown(kpi_board({"facts": facts}, full))
    board = board_from_states({"facts": table}, metrics)
    assert shown(board) == want
    assert all("/facts/" in f for f in table.read().inputFiles())
    table.compact(1)
    assert len(list((tmp_path / "facts").glob("batch=*"))) == 2 and shown(board_from_states({"facts": table}, metrics)) == want
    with pytest.raises(ValueError):
        StateTable(spark, "x", "at", [State("a", "AVG(x)", "avg")])

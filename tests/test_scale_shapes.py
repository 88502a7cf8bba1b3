"""The distributed forms of order-dependent operators against brute force, on skewed input."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opsloom.operators import actions as ac
from opsloom.operators.forest import isolation_forest_anomalies, isolation_forest_scores
from opsloom.operators.joins import interval_join
from opsloom.operators.ordering import exact_quantiles, first_per_group, rolling_rows, row_numbers, with_position


@pytest.fixture(scope="module")
def skewed():
    """2,000 rows; one key and one value hold a third each."""
    rng = np.random.default_rng(7)
    key = np.where(rng.random(2000) < 1 / 3, 0, rng.integers(1, 30, 2000))
    value = np.where(rng.random(2000) < 1 / 3, 5.0, np.round(rng.normal(10, 4, 2000), 2))
    return pd.DataFrame({"k": key, "i": rng.permutation(2000), "v": value})


@pytest.mark.parametrize("block", [8, 50, 100000])
def test_rolling_rows_equals_pandas(spark, skewed, block):
    df = spark.createDataFrame(skewed)
    got = rolling_rows(df, ["k"], ["i"], 7, lambda w: {
        "s": F.sum("v").over(w.rowsBetween(-7, -1)), "n": F.count("v").over(w.rowsBetween(-7, -1))}, block).toPandas()
    assert len(got) == len(skewed)
    got = got.sort_values(["k", "i"]).reset_index(drop=True)
    ordered = skewed.sort_values(["k", "i"]).reset_index(drop=True)
    want = ordered.groupby("k")["v"].transform(lambda s: s.shift(1).rolling(7, min_periods=1).sum())
    np.testing.assert_allclose(got["s"].astype(float), want, rtol=1e-9)


def test_rolling_needs_blocks_longer_than_the_frame(spark, skewed):
    with pytest.raises(ValueError):
        rolling_rows(spark.createDataFrame(skewed), ["k"], ["i"], 7, lambda w: {}, 7)


def test_positions_and_row_numbers(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = with_position(df, ["i"]).toPandas()
    assert (got["_pos"] == got["i"]).all()
    numbered = row_numbers(df, ["k"], ["i"], "rn").toPandas().sort_values(["k", "i"])
    want = skewed.sort_values(["k", "i"]).groupby("k").cumcount() + 1
    assert (numbered["rn"].to_numpy() == want.to_numpy()).all()


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_exact_quantiles_equal_numpy(spark, skewed, keys):
    got = exact_quantiles(spark.createDataFrame(skewed), "v", {"a": 0.0, "q": 0.25, "m": 0.5, "p": 0.99, "z": 1.0}, keys).toPandas()
    groups = skewed.groupby("k")["v"] if keys else [(None, skewed["v"])]
    for key, values in groups:
        row = got[got["k"] == key].iloc[0] if keys else got.iloc[0]
        for name, q in (("a", 0.0), ("q", 0.25), ("m", 0.5), ("p", 0.99), ("z", 1.0)):
            assert row[name] == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_quantiles_ignore_null_and_nan(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (3.0,)], "v double")
    assert exact_quantiles(df, "v", {"m": 0.5}).first().m == 2.0


def test_first_per_group_limits_before_the_shuffle(spark, skewed):
    df = spark.createDataFrame(skewed)
    limited = first_per_group(df, ["k"], [F.col("i")], 3)
    plan = limited._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # partial before the exchange, final after
    assert limited.count() == sum(min(3, n) for n in skewed.groupby("k").size())


def test_rule_filters_reach_the_scan(spark):
    from opsloom.operators.rules import Condition, Rule, evaluate_table_rules

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    big = Rule("big", "order", "orders", "HIGH", (
        Condition("o_totalprice", "gt", 400000), Condition("o_orderdate", "after", "2000-01-01")))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = evaluate_table_rules(orders, [big], "2001-01-01")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThan(o_totalprice,400000.0)" in pushed


def test_interval_join_equals_brute_force(spark):
    points = [(i, f"2024-01-{1 + i % 28:02d} 0{i % 10}:00:00") for i in range(200)]
    spans = [(j, f"2023-12-{10 + j:02d} 00:00:00", f"2024-0{1 + j % 3}-15 12:00:00") for j in range(10)]
    p = spark.createDataFrame(points, "i int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    s = spark.createDataFrame(spans, "j int, a string, b string").select(
        "j", F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    got = {(r.i, r.j) for r in interval_join(p, s, "t", "a", "b").collect()}
    assert got == {(i, j) for i, t in points for j, a, b in spans if a <= t < b}


def test_forest_finds_planted_outliers_and_repeats(spark):
    rng = np.random.default_rng(3)
    normal = pd.DataFrame(rng.normal(0, 1, (2000, 3)), columns=["a", "b", "c"])
    planted = pd.DataFrame([[9.0, -9.0, 9.0], [-8.0, 9.0, 8.5]], columns=["a", "b", "c"])
    table = pd.concat([normal, planted], ignore_index=True)
    table.insert(0, "row_id", [f"r{i}" for i in range(len(table))])
    df = spark.createDataFrame(table)
    scores = isolation_forest_scores(df, ["a", "b", "c"]).orderBy("score").limit(2).toPandas()
    assert set(scores["record_id"]) == {"r2000", "r2001"}
    first = isolation_forest_anomalies(df, ["a", "b", "c"], "t").toPandas()
    again = isolation_forest_anomalies(df, ["a", "b", "c"], "t").toPandas()
    assert 0.04 <= len(first) / len(table) <= 0.06
    assert set(first["record_id"]) == set(again["record_id"])
    spread = isolation_forest_anomalies(df.repartition(7), ["a", "b", "c"], "t").toPandas()
    assert set(first["record_id"]) == set(spread["record_id"])


def test_forest_with_few_rows(spark):
    small = spark.createDataFrame([(f"r{i}", float(i), float(i % 3)) for i in range(10)], "row_id string, a double, b double")
    assert isolation_forest_anomalies(small, ["a", "b"], "t").count() == 0


def test_approval_gate_equals_a_state_machine(spark):
    rng = np.random.default_rng(11)
    kinds = np.array(["approve", "reject", "execute"])
    events = [(str(rng.integers(0, 6)), int(i), f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", str(rng.choice(kinds)))
              for i in range(300)]
    required = {str(a): a % 2 == 0 for a in range(6)}
    status, refused = {a: "PROPOSED" for a in required}, set()
    for action, event, _, kind in events:
        if kind == "approve":
            status[action] = "APPROVED"
        elif kind == "reject":
            status[action] = "REJECTED"
        elif required[action] and status[action] != "APPROVED":
            refused.add(event)
        else:
            status[action] = "COMPLETED"
    actions = spark.createDataFrame([(a, r, "PROPOSED") for a, r in required.items()],
                                    "action_id string, approval_required boolean, status string")
    log = spark.createDataFrame(events, "action_id string, event_id long, ts string, decision string").select(
        "*", F.lit(None).cast("string").alias("user_name"), F.lit(None).cast("string").alias("reason"))
    judged = ac.judge_events(actions, log)
    assert {r.event_id for r in ac.rejected_transitions(judged).collect()} == refused
    assert {r.action_id: r.status for r in ac.apply_decisions(actions, judged).collect()} == status


def test_join_groups_copies_hot_groups_only(spark, skewed):
    """Rows of the groups beyond ``part_rows`` are dealt in proportion to their number; all others meet one copy."""
    from opsloom.operators.ordering import deal_parts, join_groups

    df = spark.createDataFrame(skewed)
    hot = {r.k: r._parts for r in deal_parts(df, ["k"], 100).collect()}
    sizes = skewed["k"].value_counts()
    assert hot == {k: -(-n // 100) for k, n in sizes.items() if n > 100} and 0 in hot and len(hot) < 5
    means = df.groupBy("k").agg(F.avg("v").alias("m"))
    for how in ("inner", "left"):
        got = join_groups(df, means.filter("k <> 3"), ["k"], F.col("i"), how, part_rows=100).toPandas().sort_values("i")
        want = skewed if how == "left" else skewed[skewed["k"] != 3]
        assert got["i"].tolist() == sorted(want["i"])
        assert got["m"].isna().sum() == (0 if how == "inner" else (skewed["k"] == 3).sum())


def _pairs(points, ranges):
    return sorted((p, r) for p, x in points for r, a, b in ranges
                  if x is not None and a is not None and b is not None and x == x and a <= x < b)


@pytest.mark.parametrize("part_rows", [5, 1_000_000])
def test_range_join_without_width(spark, part_rows):
    """The pairs of a theta join with lengths over many decades, a hot point and a hot range, and odd ends."""
    from opsloom.operators.joins import range_join

    rng = np.random.default_rng(9)
    points = [(i, float(x)) for i, x in enumerate(np.concatenate([rng.normal(0, 1000, 150), np.full(60, 7.25), [0.0, -1e300, 1e300, 2.0**70]]))]
    points += [(900, None), (901, float("nan")), (902, float("inf"))]
    lows = np.concatenate([rng.normal(0, 1000, 80), np.full(40, 7.0)])
    ranges = [(i, float(a), float(a + 10 ** rng.uniform(-3, 4))) for i, a in enumerate(lows)]
    ranges += [(800, 5.0, 5.0), (801, 6.0, 5.0), (802, None, 5.0), (803, 1.0, None), (804, float("-inf"), 3.0), (805, 3.0, float("inf")),
               (806, -1e308, 1e308), (807, 7.25, 7.5), (808, 0.0, 5e-324)]
    got = range_join(spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(ranges, "r int, a double, b double"), "x", "a", "b", part_rows=part_rows)
    assert sorted((r.p, r.r) for r in got.collect()) == _pairs(points, ranges)
    assert set(got.columns) == {"p", "x", "r", "a", "b"}
    none = range_join(spark.createDataFrame([], "p int, x double"), spark.createDataFrame([], "r int, a double, b double"), "x", "a", "b")
    assert none.count() == 0


def test_range_join_splits_hot_buckets(spark):
    """All points and ranges in one place: no part of a bucket has more than about part_rows of either side."""
    from opsloom.operators.joins import range_join

    points = spark.range(400).select(F.col("id").alias("p"), (F.lit(10.0) + F.col("id") / 1e6).alias("x"))
    ranges = spark.range(300).select(F.col("id").alias("r"), (F.lit(9.0) - F.col("id") / 1e6).alias("a"), F.lit(11.0).alias("b"))
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in plain}
    for name, value in plain.items():
        spark.conf.set(name, value)
    try:
        tasks = range_join(points, ranges, "x", "a", "b", part_rows=50).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(r["count"] for r in tasks) == 400 * 300
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < 0.5 * 400 * 300


@pytest.mark.parametrize("partitions", [1, 7])
def test_as_of_join_equals_pandas(spark, partitions):
    from opsloom.operators.joins import as_of_join

    rng = np.random.default_rng(10)
    key = lambda n: np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 40, n))
    left = pd.DataFrame({"i": np.arange(1500), "k": key(1500), "t": np.sort(rng.integers(0, 3000, 1500))})
    right = pd.DataFrame({"k": key(900), "u": np.sort(rng.integers(0, 3000, 900)), "v": np.arange(900)})
    want = pd.merge_asof(left, right.sort_values(["u", "v"]), left_on="t", right_on="u", by="k")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = as_of_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "u", ["v"]).toPandas().sort_values("i")
        near = as_of_join(spark.createDataFrame(left).withColumn("t", F.timestamp_seconds("t")),
                          spark.createDataFrame(right).withColumn("u", F.timestamp_seconds("u")), ["k"], "t", "u", ["v"], within="40 seconds").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    pd.testing.assert_series_equal(got["v"].reset_index(drop=True).astype(float), want["v"].astype(float), check_names=False)
    close = want["v"].where(want["t"] - want["u"] <= 40)
    assert near.sort_values("i")["v"].isna().tolist() == close.isna().tolist()


def test_as_of_join_of_odd_rows(spark):
    from opsloom.operators.joins import as_of_join

    left = spark.createDataFrame([(1, "a", 5), (2, None, 5), (3, "a", None), (4, "b", 1), (5, "a", 5), (5, "a", 5)], "i int, k string, t int")
    right = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 6, 3), (None, 1, 4), ("b", None, 5), ("b", 2, 6)], "k string, t int, v int")
    got = as_of_join(left, right, ["k"], "t", "t", ["v"], prefix="r_")
    assert got.columns == ["i", "k", "t", "r_t", "r_v"]
    assert sorted((r.i, r.r_v) for r in got.collect() if r.r_v) == [(1, 2), (5, 2), (5, 2)] and got.count() == 6
    assert as_of_join(left.limit(0), right, ["k"], "t", "t", prefix="r_").count() == 0
    assert as_of_join(left, right.limit(0), ["k"], "t", "t", prefix="r_").filter("r_v IS NULL").count() == 6
    with pytest.raises(ValueError):
        as_of_join(left, right, ["k"], "t", "t")

"""Intermediate tables lie in the named folder and go with their scope."""

from __future__ import annotations

import os

import __spark_entry__ as entry
from opsloom.session import cut_lineage, ensure_checkpoint_dir, intermediate_tables, shared

SF_DIR = "/root/testdata/sf0.001"


def test_nothing_is_left_behind(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    queries = entry.queries()
    with intermediate_tables(spark):
        for name in ("anomaly_iqr", "quality_health_scores", "search_policy_questions", "stream_daily_kpi", "source_csv_round_trip"):
            assert queries[name](spark, SF_DIR).count() > 0
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before


def test_scopes_nest(spark):
    df = spark.range(10)
    with intermediate_tables(spark):
        outer = cut_lineage(df)
        with intermediate_tables(spark):
            assert cut_lineage(df).count() == 10
        assert outer.count() == 10


def test_shared_tables_go_with_their_scope(spark, tmp_path):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    source = str(tmp_path / "t")
    spark.range(3).write.parquet(source)
    made = []

    def build():
        made.append(1)
        return cut_lineage(spark.read.parquet(source))

    before = set(os.listdir(folder))
    with intermediate_tables(spark):
        assert shared(spark, "x", source, build) is shared(spark, "x", source, build) and len(made) == 1
    assert set(os.listdir(folder)) == before
    kept = shared(spark, "x", source, build)
    with intermediate_tables(spark):
        assert shared(spark, "x", source, build) is kept
    assert kept.count() == 3 and len(made) == 2
    spark.range(2).write.mode("append").parquet(source)
    assert shared(spark, "x", source, build).count() == 5 and len(made) == 3

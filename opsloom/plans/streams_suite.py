"""Streaming flows as registered queries: the testdata files as file streams, run to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import rules
from opsloom.plans.registry import query
from opsloom.plans.rules_suite import AS_OF, score_sql
from opsloom.streaming import flows


def _stream(v, table: str):
    # as a glob, the path may be one file or a folder of part files
    return flows.read_folder_stream(v.spark, f"{v.directory}/{table}.parque[t]", v.raw(table).schema)


def _finish(v, name: str, df, target=None):
    folder = flows.run_folder(v.spark, name)
    flows.incremental_refresh(df, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return v.spark.read.schema(df.schema).parquet(f"{folder}/table")


@query("stream_incremental_refresh", "SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1")
def _(v):
    # two arrivals: the second run reads only what came since the first
    folder = flows.run_folder(v.spark, "refresh")
    events = v.raw("events")
    for part in (0, 1):
        events.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{folder}/landing")
        source = flows.read_folder_stream(v.spark, f"{folder}/landing", events.schema)
        flows.incremental_refresh(source, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    stored = v.spark.read.schema(events.schema).parquet(f"{folder}/table")
    return stored.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


# A window appears once the watermark (latest event minus an hour) has passed its end.
_CLOSED = "ends <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@query("stream_daily_kpi", f"""
    SELECT strftime(starts, '%Y-%m-%d') AS day, event_type, n, total FROM (
      SELECT date_trunc('day', ts) AS starts, date_trunc('day', ts) + INTERVAL 1 DAY AS ends, event_type, count(*) AS n,
        CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL) WHERE {_CLOSED}""")
def _(v):
    formulas = {"n": F.count(F.lit(1)), "total": F.sum(F.col("value").cast("decimal(18,2)")).cast("double")}
    stored = _finish(v, "daily", flows.windowed_kpi(_stream(v, "events"), "ts", formulas, keys=["event_type"]))
    return stored.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query("stream_sliding_kpi", f"""
    SELECT strftime(starts, '%Y-%m-%d %H:%M') AS starts, n FROM (
      SELECT starts, starts + INTERVAL 6 HOUR AS ends, count(*) AS n FROM (
        SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * ((extract('hour' FROM ts) % 2) + 2 * k) AS starts
        FROM events, range(3) AS r(k)) GROUP BY 1) WHERE {_CLOSED}""")
def _(v):
    stored = _finish(v, "sliding", flows.windowed_kpi(
        _stream(v, "events"), "ts", {"n": F.count(F.lit(1))}, "6 hours", "2 hours"))
    return stored.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("starts"), "n")


@query("stream_dedupe_events", "SELECT count(DISTINCT event_id) AS n, count(DISTINCT event_id) AS ids FROM events")
def _(v):
    arrivals = lambda: _stream(v, "events").select("event_id", "ts")  # noqa: E731  every event arrives twice
    stored = _finish(v, "dedupe", flows.dedupe_events(arrivals().unionByName(arrivals()), ["event_id"], "ts"))
    return stored.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query("stream_continuous_rules", f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, {score_sql("30.0", "o_totalprice",
      f"greatest(0, date_sub('day', o_orderdate, TIMESTAMP '{AS_OF}'))", "0.0")} AS priority_score, 'OPEN' AS status
    FROM orders WHERE o_orderstatus = 'P'""")
def _(v):
    orders = _stream(v, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("order_date"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total_amount"))
    rule = rules.Rule("Pending orders", "order", "orders", "HIGH", (rules.Condition("status", "equals", "p"),))
    folder = flows.run_folder(v.spark, "rules")
    store = flows.ExceptionStore(v.spark, f"{folder}/exceptions")
    run = flows.continuous_rules(orders, [rule], AS_OF, store, f"{folder}/checkpoint")
    run.awaitTermination()
    return store.read(flows.last_batch(run) + 1).select("entity_id", "priority_score", "status")


_AGE = f"greatest(0, date_sub('day', o_orderdate, TIMESTAMP '{AS_OF}'))"


@query("stream_exception_state", f"""
    WITH p AS (SELECT o_orderkey AS k, {score_sql("30.0", "o_totalprice", _AGE, "0.0")} AS score,
        {score_sql("30.0", "2 * o_totalprice", _AGE, "0.0")} AS again FROM orders WHERE o_orderstatus = 'P')
    SELECT CAST(k AS VARCHAR) AS entity_id, CASE WHEN k % 2 = 0 AND k % 5 = 0 THEN 'RESOLVED' WHEN k % 7 = 0 THEN 'ACKNOWLEDGED' ELSE 'OPEN' END AS status,
      CASE WHEN k % 3 = 0 AND NOT (k % 2 = 0 AND k % 5 = 0) THEN again ELSE score END AS priority_score FROM p
    UNION ALL SELECT CAST(k AS VARCHAR), 'OPEN', again FROM p WHERE k % 2 = 0 AND k % 5 = 0 AND k % 3 = 0""")
def _(v):
    """Three arrivals and the decisions between them: exceptions are closed, acknowledged, updated and opened again."""
    key = F.col("o_orderkey")
    pending = v.raw("orders").filter("o_orderstatus = 'P'").select(
        key.alias("order_id"), F.col("o_orderdate").alias("order_date"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total_amount"))
    arrivals = (pending.filter("order_id % 2 = 0"), pending.filter("order_id % 2 = 1"),
                pending.filter("order_id % 3 = 0").withColumn("total_amount", F.col("total_amount") * 2))
    rule = rules.Rule("Pending orders", "order", "orders", "HIGH", (rules.Condition("status", "equals", "p"),))
    folder = flows.run_folder(v.spark, "state")
    store = flows.ExceptionStore(v.spark, f"{folder}/exceptions", buckets=8)
    for number, arrival in enumerate(arrivals):
        arrival.write.mode("append").parquet(f"{folder}/landing")
        run = flows.continuous_rules(flows.read_folder_stream(v.spark, f"{folder}/landing", pending.schema), [rule], AS_OF, store, f"{folder}/checkpoint")
        run.awaitTermination()
        if number < 2:
            entity = F.col("entity_id").cast("long")
            state = store.read(number + 1).select("rule_name", "entity_id", "exception_id", F.lit(AS_OF).cast("timestamp").alias("ts"))
            chosen, status = ((entity % 2 == 0) & (entity % 5 == 0), "RESOLVED") if number == 0 else (
                (entity % 7 == 0) & ~((entity % 2 == 0) & (entity % 5 == 0)), "ACKNOWLEDGED")
            store.apply_status(state.filter(chosen).withColumn("status", F.lit(status)), number)
    return store.read(3).select("entity_id", "status", "priority_score")


@query("stream_late_corrections", """
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM events GROUP BY ALL""")
def _(v):
    """Arrivals that are shuffled over the whole month: the corrected windows equal those of all events at once."""
    folder = flows.run_folder(v.spark, "late")
    formulas = {"n": F.count(F.lit(1)), "total": F.sum(F.col("value").cast("decimal(18,2)")).cast("double")}
    for part in (2, 0, 1):
        v.raw("events").filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).write.mode("append").parquet(f"{folder}/landing")
        source = flows.read_folder_stream(v.spark, f"{folder}/landing", v.raw("events").schema)
        flows.windows_with_corrections(source, "ts", formulas, folder, keys=["event_type"]).awaitTermination()
    return v.spark.read.parquet(f"{folder}/windows").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")

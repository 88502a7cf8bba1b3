"""Anomaly operators as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import anomaly as ad
from opsloom.operators.forest import isolation_forest_anomalies
from opsloom.plans.registry import VIEW_SQL, query, sround
from opsloom.sources.tables import spread_scan

FLAT = ["table_name", "column_name", "method", "observed_value", "expected_min", "expected_max", "deviation",
        "deviation_percentage", "record_id", "date"]


def _z_sql(table: str, view: str, column: str, key: str, date: str | None, threshold: float) -> str:
    return f"""
    SELECT '{table}' AS table_name, '{column}' AS column_name, 'z_score' AS method, {sround('x', 2)} AS observed_value,
      {sround(f'm - {threshold} * s', 2)} AS expected_min, {sround(f'm + {threshold} * s', 2)} AS expected_max, {sround('x - m', 2)} AS deviation,
      CASE WHEN m = 0 THEN 0 ELSE {sround(sround('x - m', 2) + ' / abs(m) * 100', 2)} END AS deviation_percentage,
      CAST({key} AS VARCHAR) AS record_id, {f"CAST({date} AS VARCHAR)" if date else "CAST(NULL AS VARCHAR)"} AS date
    FROM (SELECT *, CAST({column} AS DOUBLE) AS x FROM {view}),
         (SELECT avg({column}) AS m, stddev_samp({column}) AS s, count({column}) AS n FROM {view})
    WHERE n >= 5 AND s <> 0 AND abs((x - m) / s) >= {threshold}"""


@query("anomaly_zscore", _z_sql("orders", "v_orders", "total_amount", "order_id", "order_date", 1.6))
def _(v):
    return ad.zscore_anomalies(v.orders, "total_amount", "orders", 1.6).select(*FLAT)


_PLAIN_EVENTS = ["event_id", "event_type", "value", "ts"]


@query("anomaly_zscore_by_group", f"""
    SELECT event_type, CAST(event_id AS VARCHAR) AS record_id, {sround('value', 2)} AS observed_value, {sround('value - m', 2)} AS deviation
    FROM events JOIN (SELECT event_type AS g, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1) ON g = event_type
    WHERE abs(value - m) / s >= 3""")
def _(v):
    found = ad.zscore_anomalies(v.raw("events").select(*_PLAIN_EVENTS), "value", "events", 3.0, partition_by=["event_type"])
    return found.select("event_type", "record_id", "observed_value", "deviation")


def _iqr_sql(table: str, view: str, column: str, key: str, date: str, k: float) -> str:
    return f"""
    SELECT '{table}' AS table_name, '{column}' AS column_name, 'iqr' AS method, {sround('x', 2)} AS observed_value, lo AS expected_min,
      hi AS expected_max, {sround('CASE WHEN x > hi THEN x - q3 ELSE x - q1 END', 2)} AS deviation,
      {sround(sround('CASE WHEN x > hi THEN x - q3 ELSE x - q1 END', 2) + ' / abs(q3) * 100', 2)} AS deviation_percentage,
      CAST({key} AS VARCHAR) AS record_id, {date} AS date
    FROM (SELECT *, CAST({column} AS DOUBLE) AS x FROM {view}), (SELECT q1, q3, {sround(f'q1 - {k} * (q3 - q1)', 2)} AS lo, {sround(f'q3 + {k} * (q3 - q1)', 2)} AS hi
      FROM (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {view}))
    WHERE q1 <> q3 AND (x < lo OR x > hi)"""


@query("anomaly_iqr", _iqr_sql("events", "events", "value", "event_id", "CAST(NULL AS VARCHAR)", 1.5))
def _(v):
    return ad.iqr_anomalies(v.raw("events").select(*_PLAIN_EVENTS), "value", "events").select(*FLAT)


def _rolling_sql(table: str, view: str, column: str, key: str, date: str, group: str = "") -> str:
    over = f"(PARTITION BY {group} " if group else "("
    return f"""
    SELECT '{table}' AS table_name, '{column}' AS column_name, 'rolling_deviation' AS method, {sround('x', 2)} AS observed_value,
      {sround('m - 2 * s', 2)} AS expected_min, {sround('m + 2 * s', 2)} AS expected_max, {sround('x - m', 2)} AS deviation,
      {sround('(x - m) / abs(m) * 100', 2)} AS deviation_percentage, CAST({key} AS VARCHAR) AS record_id, strftime({date}, '%Y-%m-%d') AS date
    FROM (SELECT *, {column} AS x, avg({column}) OVER w AS m, stddev_samp({column}) OVER w AS s, count(*) OVER w AS n FROM {view}
      WINDOW w AS {over} ORDER BY {date}, CAST({key} AS VARCHAR) ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
    WHERE n >= 3 AND s > 0 AND abs(x - m) > 2.5 * s"""


@query("anomaly_rolling", _rolling_sql("orders", "v_orders", "total_amount", "order_id", "order_date"))
def _(v):
    return ad.rolling_anomalies(v.orders, "total_amount", "orders").select(*FLAT)


@query("anomaly_rolling_by_group", "SELECT event_type, record_id, observed_value, deviation FROM (" + _rolling_sql(
    "events", "events", "value", "event_id", "ts", "event_type").replace("SELECT 'events'", "SELECT event_type, 'events'", 1) + ")")
def _(v):
    found = ad.rolling_anomalies(v.raw("events").select(*_PLAIN_EVENTS), "value", "events", "ts", partition_by=["event_type"])
    return found.select("event_type", "record_id", "observed_value", "deviation")


@query("anomaly_isolation_forest")
def _(v):
    found = isolation_forest_anomalies(spread_scan(v.raw("lineitem")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_id"), "l_quantity", "l_extendedprice",
        "l_discount", "l_tax"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "lineitem")
    return found.select(*FLAT[:8], "record_id", F.col("details").getItem("anomaly_score").alias("anomaly_score"))


# Every 1,000th order is made unlike all others. The share that is flagged and the planted rows are known beforehand.
@query("anomaly_forest_facts", """
    SELECT count(*) AS rows_scored, true AS planted_flagged, true AS share_flagged, count(*) FILTER (o_orderkey % 1000 = 0) AS planted FROM orders""")
def _(v):
    odd = F.col("order_id") % 1000 == 0
    table = v.orders.select("order_id", *[
        F.when(odd, F.lit(value)).otherwise(column).cast("double").alias(name) for name, value, column in (
            ("total", 9e6, F.col("total_amount")), ("day", -4000.0, F.date_diff("order_date", F.lit("1992-01-01"))),
            ("customer", -1e6, F.col("customer_id")))])
    flagged = isolation_forest_anomalies(table, ["total", "day", "customer"], "orders").select("record_id", F.lit(1).alias("hit"))
    joined = table.withColumn("record_id", F.col("order_id").cast("string")).join(flagged, "record_id", "left")
    share = F.count("hit") / F.count(F.lit(1))
    return joined.agg(F.count(F.lit(1)).alias("rows_scored"), F.coalesce(F.bool_and(F.when(odd, F.col("hit").isNotNull())), F.lit(True)).alias("planted_flagged"),
                      share.between(0.03, 0.05).alias("share_flagged"), F.count(F.when(odd, 1)).alias("planted"))


# the invoices table has two amounts and a date, so every univariate detector runs on both
_SCAN = " UNION ALL ".join(
    part for column in ("amount", "unpaid_amount") for part in (
        _z_sql("invoices", "v_invoices", column, "invoice_id", "issue_date", 1.7),
        _iqr_sql("invoices", "v_invoices", column, "invoice_id", "CAST(issue_date AS VARCHAR)", 1.5),
        _rolling_sql("invoices", "v_invoices", column, "invoice_id", "issue_date")))


# a second column that every other row lacks; each column's rows without a value are left out
VIEW_SQL["v_halved_orders"] = "SELECT *, CASE WHEN order_id % 2 = 0 THEN total_amount / 2 END AS half FROM v_orders"
_ALL = " UNION ALL ".join(part for c in ("total_amount", "half") for part in (
    _z_sql("orders", "v_halved_orders", c, "order_id", "order_date", 1.7),
    _iqr_sql("orders", "v_halved_orders", c, "order_id", "CAST(order_date AS VARCHAR)", 1.5),
    _rolling_sql("orders", f"(SELECT * FROM v_halved_orders WHERE {c} IS NOT NULL)", c, "order_id", "order_date")))


@query("anomaly_scan_all_methods", f"SELECT method, column_name, record_id, observed_value, deviation FROM ({_ALL})")
def _(v):
    table = v.orders.withColumn("half", F.when(F.col("order_id") % 2 == 0, F.col("total_amount") / 2))
    found = ad.scan_anomalies(table, "orders", ["total_amount", "half"], method="all", threshold=1.7)
    return found.filter("method <> 'isolation_forest'").select("method", "column_name", "record_id", "observed_value", "deviation")


@query("anomaly_scan_table", f"SELECT table_name, column_name, method, record_id, observed_value, deviation FROM ({_SCAN})")
def _(v):
    from functools import reduce
    scans = [ad.scan_anomalies(v.invoices, "invoices", method=m, threshold=1.7) for m in ("z_score", "iqr", "rolling")]
    return reduce(lambda a, b: a.unionByName(b), scans).select(
        "table_name", "column_name", "method", "record_id", "observed_value", "deviation")


_SUMMARY_TABLES = {
    "orders": ("v_orders", ["total_amount"], "order_id", "order_date"),
    "inventory": ("v_inventory", ["quantity_on_hand", "reorder_level", "safety_stock", "unit_cost"], "product_id", None),
    "support_tickets": ("v_support_tickets", ["satisfaction_score"], "ticket_id", None),
}
_SUMMARY = " UNION ALL ".join(
    f"SELECT table_name, column_name, record_id, deviation FROM ({_z_sql(t, view, c, key, date, 1.7)})"
    for t, (view, columns, key, date) in _SUMMARY_TABLES.items() for c in columns)


@query("anomaly_summary_counts", "SELECT table_name, records_analyzed, coalesce(n, 0) AS anomalies_count FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS records_analyzed FROM {view}" for t, (view, *_) in _SUMMARY_TABLES.items())
    + f") LEFT JOIN (SELECT table_name AS t, count(*) AS n FROM ({_SUMMARY}) GROUP BY 1) ON t = table_name")
def _(v):
    return ad.summarize_anomalies(v.as_dict(*_SUMMARY_TABLES), 1.7)[0]


@query("anomaly_summary_top", f"""
    SELECT table_name, column_name, record_id, deviation FROM ({_SUMMARY})
    QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY abs(deviation) DESC, column_name, record_id) <= 3""")
def _(v):
    return ad.summarize_anomalies(v.as_dict(*_SUMMARY_TABLES), 1.7)[1].select(
        "table_name", "column_name", "record_id", "deviation")


@query("anomaly_compact_list", f"""SELECT column_name AS "column", observed_value AS outlier_value, method, deviation AS deviation_score
    FROM ({_z_sql("orders", "v_orders", "total_amount", "order_id", "order_date", 1.6)})""")
def _(v):
    return ad.compact_list(ad.zscore_anomalies(v.orders, "total_amount", "orders", 1.6))

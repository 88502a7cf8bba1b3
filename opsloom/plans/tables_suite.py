"""Sources, sinks, guarded statements, snapshots and audit logs as registered queries: written, read again and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from opsloom.operators import audit, kpi, review
from opsloom.operators.safe_sql import execute_safe_query, validate_only
from opsloom.plans import kpis_suite, operations_suite, rules_suite
from opsloom.plans.registry import query
from opsloom.session import cut_lineage
from opsloom.sources import changes, files, tables
from opsloom.streaming.flows import run_folder

_ORDERS = "SELECT order_id, customer_id, order_date, status, total_amount FROM v_orders"


def _orders(v):
    return v.orders.select("order_id", "customer_id", "order_date", "status", "total_amount")


@query("source_csv_round_trip", _ORDERS)
def _(v):
    folder = run_folder(v.spark, "csv")
    files.export_csv(_orders(v), folder)
    return files.read_csv_table(v.spark, folder, delimiter=",", schema=_orders(v).schema)


@query("source_csv_sniffed", "SELECT count(*) AS n, CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS total FROM v_orders")
def _(v):
    folder = run_folder(v.spark, "csv")
    _orders(v).write.option("header", True).option("sep", ";").csv(folder)
    found = files.read_csv_table(v.spark, folder)
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("total_amount").cast("decimal(18,2)")).cast("double").alias("total"))


@query("source_json_round_trip", _ORDERS)
def _(v):
    folder = run_folder(v.spark, "json")
    _orders(v).write.json(folder)
    return files.read_json_table(v.spark, folder, schema=_orders(v).schema)


@query("source_json_nested", """
    SELECT customer_id AS customer_id, order_id AS order_id, status AS order_state FROM v_orders""")
def _(v):
    folder = run_folder(v.spark, "json")
    v.orders.select("customer_id", "order_id", F.struct(F.col("status").alias("state")).alias("order")).write.json(folder)
    found = files.read_json_table(v.spark, folder)
    key = v.orders.schema
    return found.select(F.col("customer_id").cast(key["customer_id"].dataType), F.col("order_id").cast(key["order_id"].dataType), "order_state")


@query("source_text_documents", "SELECT 'txt' AS file_type, count(*) AS files, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM benchmark WHERE text IS NOT NULL")
def _(v):
    folder = run_folder(v.spark, "texts")
    v.raw("benchmark").filter("text IS NOT NULL").repartition(8, "item_id").write.partitionBy("item_id").text(folder)
    found = files.read_text_documents(v.spark, f"{folder}/*/*.txt")
    return found.groupBy("file_type").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("text")).alias("chars"))


@query("source_normalized_names", """
    SELECT order_id AS order_no, customer_id AS order_no_2, status AS order_state, total_amount AS order_no_3 FROM v_orders""")
def _(v):
    odd = v.orders.select("order_id", "customer_id", "status", "total_amount").toDF(" Order No", "order-no", "Order.State ", "ORDER NO")
    return tables.normalize_columns(odd)


def _stored(v, name: str, steps):
    """The result of ``steps`` on a table of its own, which is dropped afterwards."""
    table = f"{name} {uuid.uuid4().hex}.csv"
    try:
        return cut_lineage(steps(table, tables.clean_table_name(table)))
    finally:
        v.spark.sql(f"DROP TABLE IF EXISTS {tables.clean_table_name(table)}")


@query("source_load_append", """
    SELECT status, 3 * count(*) AS n, count(DISTINCT order_id) AS orders FROM v_orders GROUP BY status""")
def _(v):
    def steps(given, stored):
        tables.load_table(_orders(v).limit(0), given)
        tables.load_table(_orders(v).unionAll(_orders(v)), given)
        tables.load_table(_orders(v), given, mode="append")
        return v.spark.table(stored).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("order_id").alias("orders"))
    return _stored(v, "Order Facts", steps)


@query("source_refresh_table", """
    SELECT count(*) FILTER (status = 'Delivered') AS previous_rows, count(*) AS current_rows,
      count(*) - count(*) FILTER (status = 'Delivered') AS row_diff FROM v_orders""")
def _(v):
    def steps(given, stored):
        tables.load_table(_orders(v).filter("status = 'Delivered'"), given)
        return tables.refresh_source(v.spark, stored, _orders(v))
    return _stored(v, "Refreshed Orders", steps)


_LISTED = ("orders", "customer", "lineitem", "events")


@query("source_list_tables", " UNION ALL ".join(
    f"SELECT 'listed_{t}' AS table_name, true AS is_view, (SELECT count(*) FROM {t}) AS rows" for t in _LISTED))
def _(v):
    counts = None
    for name in _LISTED:
        v.raw(name).createOrReplaceTempView(f"listed_{name}")
        one = v.spark.table(f"listed_{name}").agg(F.lit(f"listed_{name}").alias("table_name"), F.count(F.lit(1)).alias("rows"))
        counts = one if counts is None else counts.unionAll(one)
    return tables.list_tables(v.spark).join(counts, "table_name").select("table_name", "is_view", "rows")


@query("source_preview", "SELECT order_id, status FROM v_orders ORDER BY order_id LIMIT 20")
def _(v):
    return tables.preview(v.orders.select("order_id", "status"), 20, ["order_id"])


@query("sink_nested_csv", """SELECT order_id, '["' || status || '","' || shipping_method || '"]' AS words FROM v_orders""")
def _(v):
    folder = run_folder(v.spark, "csv")
    files.export_csv(v.orders.select("order_id", F.array("status", "shipping_method").alias("words")), folder)
    kind = v.orders.schema["order_id"].dataType.simpleString()
    return v.spark.read.option("header", True).option("escape", "\\").schema(f"order_id {kind}, words string").csv(folder)


@query("sink_report", """
    SELECT 'exceptions' AS section, count(*) AS n, CAST(sum(CAST(financial_impact AS DECIMAL(18,2))) AS DOUBLE) AS impact FROM v_exceptions WHERE status = 'OPEN'
    UNION ALL SELECT 'actions', count(*), NULL FROM v_actions""")
def _(v):
    sections = review.report_sections(v.spark, "Current", rules_suite.AS_OF, exceptions=rules_suite.exceptions(v),
                                      actions=operations_suite._actions(v).withColumn("action_type", F.lit("review")))
    folder = run_folder(v.spark, "report")
    files.write_report(sections, folder)
    total = F.sum(F.col("financial_impact").cast("decimal(18,2)")).cast("double")
    one = v.spark.read.json(f"{folder}/json/exceptions").agg(F.lit("exceptions").alias("section"), F.count(F.lit(1)).alias("n"), total.alias("impact"))
    two = v.spark.read.option("header", True).csv(f"{folder}/csv/actions").agg(
        F.lit("actions").alias("section"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("impact"))
    return one.unionAll(two)


_MANY = ", ".join(f"{i} AS c{i}" for i in range(40))
# Statements about each region, and whether the guard lets them pass.
_STATEMENTS = {
    "filter": ("SELECT order_id FROM guarded_orders WHERE status <> '{}' ORDER BY order_id", True),
    "common_table": ("WITH c AS (SELECT status, count(*) AS n FROM guarded_orders GROUP BY status) SELECT * FROM c WHERE status > '{}'", True),
    "write": ("DELETE FROM guarded_orders WHERE status = '{}'", False),
    "two_statements": ("SELECT '{}' AS a; DROP TABLE guarded_orders", False),
    "other_table": ("SELECT '{}' AS a, count(*) AS n FROM guarded_secret", False),
    "hidden_in_subquery": ("SELECT * FROM guarded_orders WHERE status IN (SELECT r_name FROM guarded_secret WHERE r_name = '{}')", False),
    "late_name": ("SELECT '{}' AS a FROM IDENTIFIER('guarded_secret')", False),
    "late_name_put_together": ("SELECT '{}' AS a FROM IDENTIFIER('guarded_' || 'secret')", False),
    "late_name_in_common_table": ("WITH c AS (SELECT * FROM IDENTIFIER('guarded_secret')) SELECT '{}' AS a FROM c", False),
    "file": ("SELECT '{}' AS a FROM parquet.`/tmp/none.parquet`", False),
    "java": ("SELECT java_method('java.lang.String', 'valueOf', '{}')", False),
    "many_columns": (f"SELECT {_MANY}, '{{}}' AS z FROM guarded_orders", True),
    "java_late_name": ("SELECT IDENTIFIER('java_method')('java.lang.String', 'valueOf', '{}') AS z FROM guarded_orders", False),
}
_JAVA = "java_method('java.lang.String', 'valueOf', '{}')"
_STATEMENTS |= {kind: (text, False) for kind, text in {
    "behind_columns": f"SELECT {_MANY}, {_JAVA} AS z FROM guarded_orders",
    "behind_columns_late": f"SELECT {_MANY}, IDENTIFIER('reflect')('java.lang.String', 'valueOf', '{{}}') AS z FROM guarded_orders",
    "behind_columns_file": f"SELECT {_MANY}, '{{}}' AS z FROM parquet.`/tmp/none.parquet`",
    "behind_columns_table": f"SELECT {_MANY}, (SELECT max(r_name) FROM guarded_secret WHERE r_name = '{{}}') AS z FROM guarded_orders",
    "java_in_subquery": f"SELECT status FROM guarded_orders WHERE status IN (SELECT {_JAVA} FROM guarded_orders)",
    "java_in_scalar": f"SELECT {_MANY}, (SELECT max({_JAVA}) FROM guarded_orders) AS z FROM guarded_orders",
    "java_in_common_table": f"WITH c AS (SELECT {_MANY}, {_JAVA} AS z FROM guarded_orders) SELECT c0 FROM c",
    "java_in_order": f"SELECT {_MANY} FROM guarded_orders ORDER BY {', '.join(f'c{i}' for i in range(40))}, {_JAVA}",
    "java_in_window": f"SELECT {_MANY}, sum(1) OVER (PARTITION BY {_JAVA}) AS z FROM guarded_orders",
    "java_in_lateral": f"SELECT * FROM guarded_orders, LATERAL explode(array({_JAVA}))",
    "java_qualified": "SELECT system.builtin.reflect('java.lang.String', 'valueOf', '{}') AS z FROM guarded_orders",
    "unknown_function": "SELECT no_function_of_spark('{}') AS z FROM guarded_orders",
}.items()}


@query("sql_refusals", "SELECT r_name AS region, kind, accepted, CASE WHEN accepted THEN 'guarded_orders' END AS tables_read, accepted AS explained FROM region, (VALUES "
       + ", ".join(f"('{k}', {str(ok).lower()})" for k, (_, ok) in _STATEMENTS.items()) + ") AS s(kind, accepted)")
def _(v):
    v.orders.createOrReplaceTempView("guarded_orders")
    v.raw("region").createOrReplaceTempView("guarded_secret")
    rows = []
    for r in v.raw("region").select("r_name").collect():  # the five regions
        for kind, (text, _) in _STATEMENTS.items():
            found = validate_only(v.spark, text.format(r.r_name), ["guarded_orders"])
            said = found.get("explanation", "")
            rows.append((r.r_name, kind, found["valid"], ",".join(found["referenced_tables"]) if found["valid"] else None,
                         "guarded_orders" in said and "500" in said))
    return v.spark.createDataFrame(rows, "region string, kind string, accepted boolean, tables_read string, explained boolean")


@query("sql_accepted", """
    SELECT r_name AS region, 'filter' AS kind, count(status) AS n FROM region LEFT JOIN v_orders ON status <> r_name GROUP BY r_name
    UNION ALL SELECT r_name, 'common_table', count(DISTINCT status) FROM region LEFT JOIN v_orders ON status > r_name GROUP BY r_name
    UNION ALL SELECT r_name, 'many_columns', (SELECT count(*) FROM v_orders) FROM region""")
def _(v):
    """Rows of each accepted statement, over all orders."""
    v.orders.createOrReplaceTempView("guarded_orders")
    counts = None
    for r in v.raw("region").select("r_name").collect():  # the five regions
        for kind in (k for k, (_, ok) in _STATEMENTS.items() if ok):
            found = execute_safe_query(v.spark, _STATEMENTS[kind][0].format(r.r_name), ["guarded_orders"], max_rows=None)
            one = found.rows.agg(F.lit(r.r_name).alias("region"), F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
            counts = one if counts is None else counts.unionAll(one)
    return counts


@query("sql_truncated", "SELECT count(*) AS all_rows, least(count(*), 500) AS shown, count(*) > 500 AS truncated FROM v_orders")
def _(v):
    v.orders.createOrReplaceTempView("guarded_orders")
    found = execute_safe_query(v.spark, "SELECT order_id FROM guarded_orders", ["guarded_orders"])
    return v.orders.agg(F.count(F.lit(1)).alias("all_rows")).withColumns(
        {"shown": found.rows.agg(F.count(F.lit(1))).scalar(), "truncated": F.lit(found.is_truncated())})


@query("audit_query_event", "SELECT 'sql_query' AS event_type, 'analyst' AS user_name, CAST(count(DISTINCT status) AS VARCHAR) AS rows, 'true' AS success FROM v_orders")
def _(v):
    v.orders.createOrReplaceTempView("guarded_orders")
    found = execute_safe_query(v.spark, "SELECT status, count(*) AS n FROM guarded_orders GROUP BY status", ["guarded_orders"])
    event = audit.query_event(v.spark, found, found.rows.count(), "analyst", None)
    field = lambda name: F.get_json_object("details", f"$.{name}")
    return event.select("event_type", "user_name", field("rows").alias("rows"), field("success").alias("success"))


@query("audit_append", """
    SELECT event_type, count(*) AS n, count(DISTINCT CAST(created_at AS DATE)) AS days FROM v_audit GROUP BY event_type""")
def _(v):
    folder = run_folder(v.spark, "audit")
    events = operations_suite._audit(v)
    for half in (0, 1):
        audit.append_events(events.filter(F.col("entity_id").cast("long") % 2 == half), folder)
    return v.spark.read.parquet(folder).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_date").alias("days"))


@query("kpi_snapshot_history", "SELECT code, 2 AS snapshots, current_value, status FROM (" + " UNION ALL ".join(
    kpis_suite._metric_sql(m, False) for m in kpis_suite._METRICS) + ")")
def _(v):
    board = cut_lineage(kpi.kpi_board(v.as_dict("orders", "invoices", "inventory", "support_tickets", "shipments"), kpi.default_kpis(kpis_suite.AS_OF)))
    folder = run_folder(v.spark, "snapshots")
    for period in ("first", "second"):
        kpi.snapshot_metrics(board, folder, period, "2000-01-01 00:00:00")
    return v.spark.read.parquet(folder).groupBy("code", "current_value", "status").agg(
        F.count_distinct("period_label").cast("int").alias("snapshots"))


# The orders of a day later: some gone, some new, amounts and states changed.
_LATER = """(SELECT CASE WHEN order_id % 19 = 0 THEN order_id + 100000000 ELSE order_id END AS order_id, customer_id, order_date,
    CASE WHEN order_id % 17 = 0 THEN NULL ELSE status END AS status, total_amount + CASE WHEN order_id % 13 = 0 THEN 1 ELSE 0 END AS total_amount
    FROM v_orders WHERE order_id % 11 <> 0)"""


def _later(v):
    key = F.col("order_id")
    return _orders(v).filter(key % 11 != 0).select(
        F.when(key % 19 == 0, key + 100_000_000).otherwise(key).alias("order_id"), "customer_id", "order_date",
        F.when(key % 17 != 0, F.col("status")).alias("status"), (F.col("total_amount") + F.when(key % 13 == 0, 1).otherwise(0)).alias("total_amount"))


_CHANGES = f"""
    SELECT coalesce(o.order_id, n.order_id) AS order_id, CASE WHEN o.order_id IS NULL THEN 'inserted' WHEN n.order_id IS NULL THEN 'deleted' ELSE 'changed' END AS change,
      CASE WHEN o.order_id IS NULL OR n.order_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.status IS DISTINCT FROM n.status THEN 'status' END,
        CASE WHEN o.total_amount IS DISTINCT FROM n.total_amount THEN 'total_amount' END) END AS columns
    FROM ({_ORDERS}) o FULL JOIN {_LATER} n ON o.order_id = n.order_id
    WHERE o.order_id IS NULL OR n.order_id IS NULL OR o.status IS DISTINCT FROM n.status OR o.total_amount IS DISTINCT FROM n.total_amount"""


@query("source_row_changes", _CHANGES)
def _(v):
    found = changes.row_changes(_orders(v), _later(v), ["order_id"])
    return found.select("order_id", "change", F.array_join("changed_columns", ",").alias("columns"))


@query("source_change_summary", f"""SELECT count(*) FILTER (change = 'inserted') AS inserted, count(*) FILTER (change = 'deleted') AS deleted,
    count(*) FILTER (change = 'changed') AS changed FROM ({_CHANGES})""")
def _(v):
    return changes.change_summary(changes.row_changes(_orders(v), _later(v), ["order_id"]))


@query("source_refresh_keyed", f"SELECT * FROM {_LATER}")
def _(v):
    """A stored table that is brought to a later state, buckets without a change left as they are."""
    folder = run_folder(v.spark, "keyed")
    for state in (_orders(v), _later(v)):
        changes.refresh_keyed(v.spark, folder, state, ["order_id"], buckets=16)
    return changes.read_keyed(v.spark, folder)

"""KPI operators as registered queries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F

from opsloom.operators import kpi
from opsloom.operators import kpi_states as ks
from opsloom.plans.registry import query
from opsloom.session import cut_lineage
from opsloom.streaming.flows import run_folder

AS_OF = "2000-01-01 00:00:00"
BREACH = "CASE WHEN lower(status) <> 'resolved' AND sla_deadline < TIMESTAMP '2000-01-01' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
OVERDUE = "CASE WHEN due_date < TIMESTAMP '2000-01-01' AND lower(status) <> 'paid' THEN unpaid_amount ELSE 0.0::DOUBLE END"
LATE = "CASE WHEN actual_delivery > estimated_delivery THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"

# code, name, owner, target, table, formula, time column, sums the halves, status expression over cur
_METRICS = [
    ("REV", "Total Revenue", "Finance Operations", 150000, "v_orders", "sum(total_amount)", "order_date", True,
     "CASE WHEN cur < 20000 THEN 'CRITICAL' WHEN cur < 50000 THEN 'WARNING' ELSE 'GOOD' END"),
    ("ORD_VOL", "Total Orders", "Fulfillment Operations", 500, "v_orders", "count(*)", "order_date", False,
     "CASE WHEN cur < 100 THEN 'CRITICAL' WHEN cur < 200 THEN 'WARNING' ELSE 'GOOD' END"),
    ("LATE_RATE", "Late Delivery Rate", "Logistics Operations", 2, "v_shipments", f"avg({LATE}) * 100", "ship_date", False,
     "CASE WHEN cur > 12 THEN 'CRITICAL' WHEN cur > 6 THEN 'WARNING' ELSE 'GOOD' END"),
    ("OVERDUE_INV", "Overdue Invoices", "Accounts Receivable", 5000, "v_invoices", f"sum({OVERDUE})", "due_date", True,
     "CASE WHEN cur > 50000 THEN 'CRITICAL' WHEN cur > 25000 THEN 'WARNING' ELSE 'GOOD' END"),
    ("SLA_BREACH", "SLA Breach Rate", "Customer Support", 1, "v_support_tickets", f"avg({BREACH}) * 100", "created_at", False,
     "CASE WHEN cur > 10 THEN 'CRITICAL' WHEN cur > 5 THEN 'WARNING' ELSE 'GOOD' END"),
    ("LOW_STOCK", "Low Stock Inventory", "Supply Chain", 0, "v_inventory",
     "count(CASE WHEN quantity_on_hand <= reorder_level THEN 1 END)", None, False,
     "CASE WHEN cur > 10 THEN 'CRITICAL' WHEN cur > 4 THEN 'WARNING' ELSE 'GOOD' END"),
]


def _series_sql(table: str, formula: str, time: str) -> str:
    return (f"SELECT {time} AS t, CAST({formula} AS DOUBLE) AS val, row_number() OVER (ORDER BY {time}) - 1 AS pos, "
            f"count(*) OVER () AS n FROM {table} WHERE {time} IS NOT NULL GROUP BY {time}")


def _metric_sql(m, spark: bool) -> str:
    code, name, owner, target, table, formula, time, sums, status = m
    current = f"(SELECT round(coalesce(CAST({formula} AS DOUBLE), 0), 2) FROM {table})"
    if time:
        series = _series_sql(table, formula, time)
        previous = f"(SELECT round({'sum' if sums else 'avg'}(val), 2) FROM ({series}) WHERE pos < n // 2)"
        line = (f"(SELECT string_agg(printf('%s=%.2f', substr(CAST(t AS VARCHAR), 1, 10), round(val, 2)), ' ' ORDER BY pos) "
                f"FROM ({series}) WHERE pos % greatest(1, n // 8) = 0)")
    else:
        previous = current
        line = ("(SELECT string_agg(printf('P%d=%.2f', i + 1, round(" + current + " * (0.95 + 0.02 * i), 2)), ' ' ORDER BY i) "
                "FROM (SELECT unnest(range(5)) AS i))")
    return f"""SELECT '{code}' AS code, '{name}' AS name, '{owner}' AS owner, CAST({target} AS DOUBLE) AS target_value,
        cur AS current_value, prev AS previous_value, round(cur - prev, 2) AS abs_change,
        CASE WHEN prev <> 0 THEN round((cur - prev) / abs(prev) * 100, 2) ELSE 0 END AS pct_change,
        {status} AS status{', line AS sparkline' if spark else ''}
        FROM (SELECT {current} AS cur, {previous} AS prev{', ' + line + ' AS line' if spark else ''})"""


def _line_text(df):
    points = F.transform("sparkline", lambda p: F.format_string("%s=%.2f", p["label"], p["value"]))
    return df.withColumn("sparkline", F.array_join(points, " "))


def _tables(v):
    return v.as_dict("orders", "shipments", "invoices", "support_tickets", "inventory")


@query("kpi_board", " UNION ALL ".join(_metric_sql(m, True) for m in _METRICS))
def _(v):
    return _line_text(kpi.kpi_board(_tables(v), kpi.default_kpis(AS_OF)))


@query("kpi_metric_revenue", _metric_sql(_METRICS[0], True))
def _(v):
    return _line_text(kpi.evaluate_metric(v.orders, kpi.default_kpis(AS_OF)[0]))


@query("kpi_metric_value", "SELECT round(sum(total_amount), 2) AS value FROM v_orders")
def _(v):
    return kpi.metric_value(v.orders, kpi.default_kpis(AS_OF)[0])


@query("kpi_metric_series", "SELECT order_date AS period, CAST(count(*) AS DOUBLE) AS value FROM v_orders GROUP BY 1")
def _(v):
    return kpi.metric_series(v.orders, kpi.default_kpis(AS_OF)[1])


@query("kpi_monthly_previous", """
    WITH s AS (SELECT strftime(order_date, '%Y-%m') AS m, round(sum(total_amount), 2) AS val FROM v_orders GROUP BY 1),
    p AS (SELECT val, row_number() OVER (ORDER BY m) - 1 AS pos, count(*) OVER () AS n FROM s)
    SELECT 'REV_M' AS code, (SELECT round(sum(total_amount), 2) FROM v_orders) AS current_value,
      (SELECT round(sum(val), 2) FROM p WHERE pos < n // 2) AS previous_value, 'GOOD' AS status""")
def _(v):
    monthly = kpi.Metric("REV_M", "Revenue by month", "orders", "SUM(total_amount)", "order_date", "sum",
                         150000.0, 50000.0, 20000.0, grain="month")
    return kpi.evaluate_metric(v.orders, monthly).select("code", "current_value", "previous_value", "status")


@query("kpi_test_formula", "SELECT round(max(total_amount) - min(total_amount), 2) AS sample_result FROM v_orders")
def _(v):
    return kpi.test_formula(v.orders, "round(max(total_amount) - min(total_amount), 2)")


def _period_sql(code: str, table: str, formula: str, time: str, period: str, start: str, status: str) -> str:
    at = f"TIMESTAMP '{start}'"
    inside = lambda a, b: f"(SELECT round(coalesce(CAST({formula} AS DOUBLE), 0), 2) FROM {table} WHERE {time} >= {a} AND {time} < {b})"
    return f"""SELECT '{code}' AS code, '{period}' AS period, cur AS current_value, prev AS previous_value, round(cur - prev, 2) AS abs_change,
        round((cur - prev) / nullif(abs(prev), 0) * 100, 2) AS pct_change, {status} AS status
        FROM (SELECT {inside(at, f"{at} + INTERVAL 1 {period}")} AS cur, {inside(f"{at} - INTERVAL 1 {period}", at)} AS prev)"""


@query("kpi_calendar_compare", " UNION ALL ".join(
    _period_sql(m[0], m[4], m[5], m[6], period, start, m[8]) for m in _METRICS[:4]
    for period, start in (("month", "1997-05-01"), ("quarter", "1997-04-01"), ("year", "1997-01-01"))))
def _(v):
    tables, parts = _tables(v), []
    for metric in kpi.default_kpis(AS_OF)[:4]:
        parts += [kpi.calendar_compare(tables[metric.source_table], metric, "1997-05-17 10:00:00", p) for p in ("month", "quarter", "year")]
    return reduce(lambda a, b: a.unionAll(b), parts)


@query("kpi_board_from_states", " UNION ALL ".join(
    _metric_sql((*m[:6], f"date_trunc('day', {m[6]})", *m[7:]), True) for m in _METRICS if m[6]))
def _(v):
    """Facts arrive in three batches, one of them twice; the board reads their daily states only."""
    folder = run_folder(v.spark, "states")
    stored, metrics = {}, []
    for name, (time, states, over) in ks.default_states(AS_OF).items():
        table = ks.StateTable(v.spark, f"{folder}/{name}", time, states)
        facts = v.table(name)
        asked = [c for c in facts.columns if any(re.search(rf"\b{c}\b", text) for text in (time, *(s.formula for s in states)))]
        # the facts may be joins, so they are made once for the four times that a batch reads them
        rows = cut_lineage(facts.withColumn("_batch", F.pmod(F.xxhash64(*facts.columns), F.lit(3))).select("_batch", *asked))
        for batch in (0, 1, 1, 2):
            table.add(rows.filter(F.col("_batch") == batch).drop("_batch"), batch)
        if name == "orders":
            table.compact(1)
        stored[name] = table
        metrics += over
    return _line_text(ks.board_from_states(stored, metrics))

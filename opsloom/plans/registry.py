"""Registered queries and the SQL that states their expected result.

``@query(name, sql)`` registers a function ``(views) -> DataFrame``. The SQL may
use the ``v_*`` views below; the ones it needs are put in front as CTEs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opsloom.sources.views import OperationsViews

VIEW_SQL = {
    "v_customers": """SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS tier, c_acctbal AS credit_limit,
        concat('procurement', CAST(c_custkey AS VARCHAR), '@example.com') AS email, n_name AS city,
        CASE WHEN c_acctbal < 0 THEN 'Credit_Hold' ELSE 'Active' END AS status
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_products": """SELECT p_partkey AS product_id, p_name AS name, p_type AS category,
        round(p_retailprice * 0.6, 2) AS unit_cost, p_retailprice AS unit_price, p_size AS reorder_level FROM part""",
    "v_inventory": """SELECT concat('SKU-', CAST(p_partkey AS VARCHAR)) AS sku, p_partkey AS product_id,
        p_name AS product_name, p_brand AS warehouse_location, p_partkey % 97 AS quantity_on_hand,
        p_size AS reorder_level, CAST(floor(p_size * 0.5) AS INT) AS safety_stock,
        round(p_retailprice * 0.6, 2) AS unit_cost FROM part""",
    "v_orders": """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
        CASE o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'Processing' ELSE 'Delayed' END AS status,
        o_totalprice AS total_amount,
        CASE WHEN o_totalprice < 250000 THEN 'Ground Freight' ELSE 'Expedited Air' END AS shipping_method,
        'Net 30' AS payment_terms FROM orders""",
    "v_order_items": """SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id,
        l_quantity AS quantity, l_extendedprice AS line_total FROM lineitem""",
    "v_shipments": """SELECT l_orderkey AS order_id, l_linenumber AS line_no, s_name AS carrier, l_shipdate AS ship_date,
        o_orderdate + INTERVAL 30 DAY AS estimated_delivery,
        CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS actual_delivery,
        CASE WHEN l_linestatus = 'O' THEN 'In Transit' WHEN l_shipdate > o_orderdate + INTERVAL 30 DAY THEN 'Delayed'
             ELSE 'Delivered' END AS status,
        greatest(0, date_diff('day', o_orderdate + INTERVAL 30 DAY, l_shipdate)) AS delay_days
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""",
    "v_invoices": """SELECT concat('INV-', CAST(o_orderkey AS VARCHAR)) AS invoice_id, o_custkey AS customer_id,
        o_orderkey AS order_id, o_orderdate AS issue_date, o_orderdate + INTERVAL 30 DAY AS due_date,
        o_totalprice AS amount,
        CASE WHEN o_orderstatus = 'F' THEN CAST(0 AS DOUBLE) ELSE o_totalprice END AS unpaid_amount,
        CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Pending' ELSE 'Overdue' END AS status FROM orders""",
    "v_payments": """SELECT concat('PAY-', CAST(o_orderkey AS VARCHAR)) AS payment_id,
        concat('INV-', CAST(o_orderkey AS VARCHAR)) AS invoice_id, o_orderdate + INTERVAL 10 DAY AS payment_date,
        o_totalprice AS amount,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Wire' WHEN o_orderpriority = '3-MEDIUM'
             THEN 'Corporate Card' ELSE 'ACH Transfer' END AS payment_method
        FROM orders WHERE o_orderstatus = 'F'""",
    "v_support_tickets": """SELECT event_id AS ticket_id, user_id AS customer_id, event_type AS subject,
        CASE event_type WHEN 'error' THEN 'Critical' WHEN 'purchase' THEN 'High' WHEN 'click' THEN 'Medium'
             ELSE 'Low' END AS priority,
        CASE WHEN event_id % 7 = 0 THEN 'In Progress' WHEN event_id % 5 = 0 THEN 'Waiting Customer'
             ELSE 'Resolved' END AS status,
        CASE WHEN event_id % 7 = 0 AND event_type IN ('error', 'purchase') THEN 'Breached'
             WHEN event_id % 5 = 0 THEN 'At Risk' ELSE 'Within SLA' END AS sla_status,
        ts AS created_at, ts + INTERVAL 24 HOUR AS sla_deadline, 1 + event_id % 5 AS satisfaction_score FROM events""",
    "v_employees": """SELECT s_suppkey AS employee_id, s_name AS name, n_name AS department,
        s_suppkey % 13 AS active_tasks, 30 + s_suppkey % 151 AS resolved_tasks
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "v_dirty_orders": """SELECT CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 103 = 1 THEN o_orderkey - 1
             ELSE o_orderkey END AS order_id,
        CASE WHEN o_orderkey % 53 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS customer_id,
        CASE WHEN o_orderkey % 37 = 0 THEN -o_totalprice ELSE o_totalprice END AS unit_price,
        CASE WHEN o_orderkey % 47 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN 150.0 WHEN o_orderkey % 43 = 0 THEN -5.0
             ELSE CAST(o_orderkey % 30 AS DOUBLE) END::DOUBLE AS discount_pct,
        CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 5 = 0 THEN upper(base) WHEN o_orderkey % 5 = 1 THEN lower(base) || ' ' ELSE base END AS status,
        CASE WHEN o_orderkey % 29 = 0 THEN 'not_a_date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date
        FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'Processing' ELSE 'Delayed' END AS base
              FROM orders)""",
}

_BUILDERS: dict[str, Callable[[OperationsViews], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _needed_views(sql: str) -> list[str]:
    """Views in dependency order."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEW_SQL and name not in found:
                visit(VIEW_SQL[name])
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def with_views(sql: str) -> str:
    body = sql.strip()
    views = ",\n".join(f"{name} AS ({VIEW_SQL[name]})" for name in _needed_views(body))
    if not views:
        return body
    own_ctes = re.match(r"(?i)with\s+(recursive\s)?", body)
    if not own_ctes:
        return f"WITH {views}\n{body}"
    return f"WITH {own_ctes[1] or ''}{views},\n{body[own_ctes.end():]}"


def sround(x: str, digits: int) -> str:
    """SQL for ``stable_round``."""
    return f"CAST(round(CAST({x} AS DECIMAL(20,6)), {digits}) AS DOUBLE)"


def query(name: str, sql: str | None = None):
    def register(build: Callable[[OperationsViews], DataFrame]):
        if name in _BUILDERS:
            raise ValueError(f"query {name!r} registered twice")
        _BUILDERS[name] = build
        if sql is not None:
            _ORACLES[name] = with_views(sql)
        return build
    return register


def registered_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(build):
        return lambda spark, sf_dir: build(OperationsViews(spark, sf_dir))
    return {name: runner(build) for name, build in _BUILDERS.items()}


def registered_sql() -> dict[str, str]:
    return dict(_ORACLES)

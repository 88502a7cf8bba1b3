"""Rule operators as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.functions.scoring import priority_score
from opsloom.operators import actions, rules
from opsloom.operators.rules import Condition, Rule
from opsloom.plans.registry import VIEW_SQL, query

AS_OF = "2001-09-01 00:00:00"
COLUMNS = ["rule_name", "entity_type", "entity_id", "severity", "title", "description", "observed_value",
           "financial_impact", "age_days", "priority_score", "status"]


def score_sql(points: str, impact: str, age: str, sla: str) -> str:
    return (f"least(100.0, greatest(0.0, CAST(round(CAST({points} + least(25.0::DOUBLE, {impact} / 10000.0 * 25.0) + "
            f"least(20.0::DOUBLE, CAST({age} AS DOUBLE) / 60.0 * 20.0) + {sla} AS DECIMAL(20,6)), 1) AS DOUBLE)))")


def _rule_sql(rule, entity, table, severity, points, key, impact, date, sla, observed, where) -> str:
    age = f"greatest(0, date_sub('day', {date}, TIMESTAMP '{AS_OF}'))" if date else "CAST(0 AS BIGINT)"
    title = f"'{rule}, {entity} ' || {key}"
    if impact != "0.0::DOUBLE":
        title += f" || CASE WHEN {impact} > 0 THEN ', worth ' || format('{{:,.2f}}', {impact}) ELSE '' END"
    return f"""SELECT '{rule}' AS rule_name, '{entity}' AS entity_type, CAST({key} AS VARCHAR) AS entity_id, '{severity}' AS severity,
        {title} AS title, 'all conditions of {rule} hold in {table[2:]}' AS description, CAST({observed} AS VARCHAR) AS observed_value,
        {impact} AS financial_impact, {age} AS age_days, {score_sql(points, impact, age, sla)} AS priority_score, 'OPEN' AS status
        FROM {table} WHERE {where}"""


_PARTS = [
    _rule_sql("Overdue Invoices > $5,000", "invoice", "v_invoices", "CRITICAL", "40.0", "invoice_id", "amount", "issue_date",
              "0.0", "unpaid_amount", "unpaid_amount > 5000 AND lower(status) <> 'paid'"),
    _rule_sql("Inventory Below Safety Stock", "inventory", "v_inventory", "HIGH", "30.0", "sku", "unit_cost", None,
              "0.0", "quantity_on_hand", "quantity_on_hand <= 20"),
    _rule_sql("Delayed Order Fulfillment", "order", "v_orders", "HIGH", "30.0", "order_id", "total_amount", "order_date",
              "0.0", "status", "lower(status) = 'delayed'"),
    _rule_sql("SLA At-Risk Support Tickets", "ticket", "v_support_tickets", "CRITICAL", "40.0", "ticket_id", "0.0::DOUBLE", "created_at",
              "15.0", "priority", "lower(priority) = 'urgent' AND lower(status) <> 'resolved'"),
]
VIEW_SQL["v_exceptions"] = " UNION ALL ".join(_PARTS)


def exceptions(v):
    return rules.evaluate_rules(v.as_dict("invoices", "inventory", "orders", "support_tickets"), rules.DEFAULT_RULES, AS_OF)


@query("rules_evaluate_all", "SELECT * FROM v_exceptions")
def _(v):
    return exceptions(v).select(*COLUMNS)


@query("rules_evaluate_one", _rule_sql(
    "Breached tickets", "ticket", "v_support_tickets", "WARNING", "25.0", "ticket_id", "0.0::DOUBLE", "created_at", "15.0",
    "sla_status", "lower(sla_status) = 'breached'").replace(AS_OF, "2024-02-15 12:00:00"))
def _(v):
    rule = Rule("Breached tickets", "ticket", "support_tickets", "WARNING", (Condition("sla_status", "eq", "BREACHED"),))
    return rules.evaluate_rule(v.support_tickets, rule, "2024-02-15 12:00:00").select(*COLUMNS)


@query("rules_same_table_two_rules", """
    SELECT 'big' AS rule_name, CAST(order_id AS VARCHAR) AS entity_id FROM v_orders WHERE total_amount >= 400000
    UNION ALL SELECT 'air', CAST(order_id AS VARCHAR) FROM v_orders
      WHERE lower(shipping_method) LIKE '%air%' AND order_date > TIMESTAMP '2000-01-01'""")
def _(v):
    two = [Rule("big", "order", "orders", "HIGH", (Condition("total_amount", ">=", "400000"),)),
           Rule("air", "order", "orders", "LOW", (Condition("shipping_method", "contains", "AIR"),
                                                 Condition("order_date", "after", "2000-01-01")))]
    return rules.evaluate_rules({"orders": v.orders}, two, AS_OF).select("rule_name", "entity_id")


_CONDITIONS = [
    ("eq_number", Condition("discount_pct", "equals", "150"), "discount_pct = 150"),
    ("eq_text", Condition("status", "==", "DELAYED"), "lower(status) = 'delayed'"),
    ("neq_null", Condition("order_id", "neq", 7), "order_id IS DISTINCT FROM 7"),
    ("gt_text", Condition("order_date", "gt", 5), "TRY_CAST(order_date AS DOUBLE) > 5"),
    ("lt", Condition("unit_price", "lt", 0), "unit_price < 0"),
    ("gte", Condition("discount_pct", "gte", 29), "discount_pct >= 29"),
    ("lte", Condition("discount_pct", "lte", -5), "discount_pct <= -5"),
    ("contains", Condition("status", "contains", "liv"), "lower(status) LIKE '%liv%'"),
    ("before", Condition("order_date", "before", "1996-01-01"), "TRY_CAST(order_date AS TIMESTAMP) < TIMESTAMP '1996-01-01'"),
    ("after", Condition("order_date", "after", "2000-01-01"), "TRY_CAST(order_date AS TIMESTAMP) > TIMESTAMP '2000-01-01'"),
    ("is_empty", Condition("order_id", "is_empty"), "order_id IS NULL"),
    ("is_not_empty", Condition("status", "is_not_empty"), "status IS NOT NULL AND trim(status) <> ''"),
    ("unknown_field", Condition("nowhere", "eq", 1), "false"),
    ("unknown_operator", Condition("status", "resembles", 1), "false"),
]


@query("rules_condition_operators", "SELECT " + ", ".join(
    f"count(*) FILTER (coalesce({sql}, false)) AS {name}" for name, _, sql in _CONDITIONS) + " FROM v_dirty_orders")
def _(v):
    df = v.dirty_orders
    return df.agg(*[F.count(F.when(rules.compile_condition(df.schema, c), 1)).alias(name) for name, c, _ in _CONDITIONS])


@query("rules_priority_score", f"""
    SELECT order_id, {score_sql("CASE status WHEN 'Delayed' THEN 30.0 WHEN 'Processing' THEN 10.0 ELSE 20.0 END", "total_amount",
    f"greatest(0, date_sub('day', order_date, TIMESTAMP '{AS_OF}'))", "CASE WHEN shipping_method = 'Expedited Air' THEN 15.0 ELSE 0.0 END")}
    AS priority_score FROM v_orders""")
def _(v):
    severity = F.when(F.col("status") == "Delayed", "HIGH").when(F.col("status") == "Processing", "low").otherwise("other")
    age = F.greatest(F.lit(0), F.timestamp_diff("DAY", F.col("order_date"), F.lit(AS_OF).cast("timestamp_ntz")))
    return v.orders.select("order_id", priority_score(
        severity, F.col("total_amount"), age, F.col("shipping_method") == "Expedited Air").alias("priority_score"))


@query("rules_list_filtered", """
    SELECT rule_name, entity_id, priority_score FROM v_exceptions WHERE severity = 'HIGH' AND entity_type = 'order' AND status = 'OPEN'""")
def _(v):
    return rules.list_exceptions(exceptions(v), "OPEN", "HIGH", "order").select("rule_name", "entity_id", "priority_score")


# Stored exceptions for the merge: the order exceptions found a year earlier, every
# seventh resolved and every fifth acknowledged.
_EARLIER = "2000-09-01 00:00:00"


def _stored(v):
    found = rules.evaluate_rules({"orders": v.orders}, [rules.DEFAULT_RULES[2]], _EARLIER)
    key = F.col("entity_id").cast("long")
    return found.withColumn("status", F.when(key % 7 == 0, "RESOLVED").when(key % 5 == 0, "ACKNOWLEDGED").otherwise("OPEN"))


_DELAYED = _PARTS[2]
VIEW_SQL["v_stored"] = f"""SELECT * REPLACE (CASE WHEN CAST(entity_id AS BIGINT) % 7 = 0 THEN 'RESOLVED'
    WHEN CAST(entity_id AS BIGINT) % 5 = 0 THEN 'ACKNOWLEDGED' ELSE 'OPEN' END AS status) FROM ({_DELAYED.replace(AS_OF, _EARLIER)})"""


@query("rules_merge_open", f"""
    WITH found AS ({_DELAYED}), opened AS (SELECT * FROM v_stored WHERE status IN ('OPEN', 'ACKNOWLEDGED'))
    SELECT coalesce(o.entity_id, f.entity_id) AS entity_id, coalesce(o.status, f.status) AS status,
      coalesce(o.age_days, f.age_days) AS age_days, coalesce(f.priority_score, o.priority_score) AS priority_score
    FROM opened o FULL JOIN found f ON o.entity_id = f.entity_id AND o.rule_name = f.rule_name
    UNION ALL SELECT entity_id, status, age_days, priority_score FROM v_stored WHERE status = 'RESOLVED'""")
def _(v):
    found = rules.evaluate_rules({"orders": v.orders}, [rules.DEFAULT_RULES[2]], AS_OF)
    return rules.merge_exceptions(_stored(v), found).select("entity_id", "status", "age_days", "priority_score")


# Recurrences of closed exceptions have ids of their own, so old decisions do not touch them.
@query("rules_recurrence_ids", f"""
    WITH found AS ({_DELAYED}) SELECT count(*) AS exceptions, count(*) AS ids, count(*) FILTER (again) AS recurring FROM (
      SELECT entity_id, false AS again FROM v_stored UNION ALL SELECT f.entity_id, s.status = 'RESOLVED' AS again FROM found f
      LEFT JOIN v_stored s ON s.entity_id = f.entity_id WHERE s.entity_id IS NULL OR s.status = 'RESOLVED')""")
def _(v):
    found = rules.evaluate_rules({"orders": v.orders}, [rules.DEFAULT_RULES[2]], AS_OF)
    merged = rules.merge_exceptions(_stored(v), found)
    first = rules.exception_id(F.col("rule_name"), F.col("entity_id"))
    return merged.agg(F.count(F.lit(1)).alias("exceptions"), F.count_distinct("exception_id").alias("ids"),
                      F.count(F.when(F.col("exception_id") != first, 1)).alias("recurring"))


@query("rules_recurrence_proposals", f"""
    WITH found AS ({_DELAYED}), again AS (SELECT f.* FROM found f JOIN v_stored s ON s.entity_id = f.entity_id WHERE s.status = 'RESOLVED')
    SELECT entity_id, 'OPEN' AS status, 'To do: ' || title AS title FROM again ORDER BY priority_score DESC, rule_name, entity_id LIMIT 25""")
def _(v):
    """Merge, replay the old closing events, then propose: every first occurrence has an action already."""
    stored = _stored(v)
    found = rules.evaluate_rules({"orders": v.orders}, [rules.DEFAULT_RULES[2]], AS_OF)
    merged = rules.merge_exceptions(stored, found)
    closing = stored.filter("status = 'RESOLVED'").select("exception_id", "status", F.lit(AS_OF).cast("timestamp").alias("ts"))
    now = rules.apply_status_events(merged, closing)
    first = rules.exception_id(F.col("rule_name"), F.col("entity_id"))
    proposed = actions.propose_actions(now, now.filter(F.col("exception_id") == first).select("exception_id"), k=25)
    return proposed.join(now.select("exception_id", "entity_id", F.col("status").alias("state")), "exception_id").select(
        "entity_id", F.col("state").alias("status"), "title")


# Status events derived from the events stream: the user id stands for the entity.
@query("rules_status_transitions", """
    WITH e AS (SELECT CAST(user_id AS VARCHAR) AS entity_id, arg_max(CASE event_id % 4 WHEN 0 THEN 'ACKNOWLEDGED' WHEN 1 THEN 'RESOLVED'
      WHEN 2 THEN 'IGNORED' ELSE 'OPEN' END, ts) AS status FROM events GROUP BY 1)
    SELECT s.entity_id, coalesce(e.status, s.status) AS status FROM v_stored s LEFT JOIN e ON e.entity_id = s.entity_id""")
def _(v):
    key = F.col("event_id") % 4
    status = F.when(key == 0, "ACKNOWLEDGED").when(key == 1, "RESOLVED").when(key == 2, "IGNORED").otherwise("OPEN")
    rule = F.lit(rules.DEFAULT_RULES[2].name)
    events = v.raw("events").select(
        rules.exception_id(rule, F.col("user_id").cast("string")).alias("exception_id"), status.alias("status"), "ts")
    return rules.apply_status_events(_stored(v), events).select("entity_id", "status")


@query("rules_action_template", """
    SELECT rule_name, CASE WHEN entity_type = 'order' THEN 'draft_email' ELSE 'create_task' END AS action_type, count(*) AS n
    FROM v_exceptions GROUP BY 1, 2""")
def _(v):
    return exceptions(v).groupBy("rule_name", F.col("action_template.action_type").alias("action_type")).agg(
        F.count(F.lit(1)).alias("n"))

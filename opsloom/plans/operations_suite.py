"""Questions, drivers, actions, audit, review and report as registered queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from opsloom.operators import actions as ac
from opsloom.operators import anomaly as ad
from opsloom.operators import audit as au
from opsloom.operators import drivers as dr
from opsloom.operators import entities as en
from opsloom.operators import kpi
from opsloom.operators import questions as cq
from opsloom.operators import review as rv
from opsloom.operators import rules
from opsloom.plans import anomalies_suite, kpis_suite, quality_suite, rules_suite
from opsloom.plans.documents_suite import _top_hit, corpus_index, questions
from opsloom.plans.registry import VIEW_SQL, query, sround
from opsloom.operators import search as se
from opsloom.session import cut_lineage

AS_OF = "2000-06-01 00:00:00"
TICKETS_AS_OF = "2024-01-15 00:00:00"

# Orders with a promised and an actual delivery, from the shipments.
VIEW_SQL["v_dated_orders"] = """
    SELECT o.order_id, customer_id, total_amount AS amount, promised_date, delivery_date, status
    FROM v_orders o LEFT JOIN (SELECT order_id, min(estimated_delivery) AS promised_date, max(actual_delivery) AS delivery_date
      FROM v_shipments GROUP BY 1) s ON s.order_id = o.order_id"""
_LATE = "(coalesce(delivery_date > promised_date, false) OR lower(status) = 'delayed')"


def dated_orders(v):
    dates = v.shipments.groupBy("order_id").agg(
        F.min("estimated_delivery").alias("promised_date"), F.max("actual_delivery").alias("delivery_date"))
    return v.orders.select("order_id", "customer_id", F.col("total_amount").alias("amount"), "status").join(
        dates, "order_id", "left")


@query("question_delayed_orders", f"""
    SELECT order_id, customer_id, amount, status FROM v_dated_orders WHERE {_LATE}""")
def _(v):
    return cq.delayed_orders(dated_orders(v)).select("order_id", "customer_id", "amount", "status")


@query("question_overdue_invoices", f"""
    SELECT invoice_id, customer_id, unpaid_amount, due_date, status FROM v_invoices
    WHERE (due_date < TIMESTAMP '{AS_OF}' OR lower(status) = 'overdue') AND lower(status) <> 'paid'""")
def _(v):
    return cq.overdue_invoices(v.invoices, AS_OF)


@query("question_restock_list", """
    SELECT sku, product_name, quantity_on_hand, reorder_level FROM v_inventory WHERE quantity_on_hand <= reorder_level""")
def _(v):
    return cq.restock_list(v.inventory)


@query("question_tickets_at_risk", f"""
    SELECT ticket_id, priority, status FROM v_support_tickets
    WHERE lower(status) <> 'resolved' AND (sla_deadline < TIMESTAMP '{TICKETS_AS_OF}' OR priority = 'Urgent')""")
def _(v):
    return cq.tickets_at_risk(v.support_tickets, TICKETS_AS_OF).select("ticket_id", "priority", "status")


@query("question_customers_by_delayed_value", f"""
    SELECT c.customer_id, c.name, c.tier, count(*) AS delayed_orders, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_delayed_value
    FROM v_customers c JOIN v_dated_orders o ON o.customer_id = c.customer_id WHERE {_LATE.replace('status', 'o.status')}
    GROUP BY ALL""")
def _(v):
    return cq.customers_by_delayed_value(v.customers, dated_orders(v))


@query("question_revenue_by_customer", """
    SELECT customer_id, count(*) AS orders_count, CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue
    FROM v_orders GROUP BY 1""")
def _(v):
    return cq.revenue_by_customer(v.orders.withColumnRenamed("total_amount", "amount"))


_CASES = "unpaid_amount > 2500 OR lower(status) IN ('refund_pending', 'overdue')"


@query("question_approval_cases", f"SELECT invoice_id, unpaid_amount, status FROM v_invoices WHERE {_CASES}")
def _(v):
    return cq.approval_cases(v.invoices).select("invoice_id", "unpaid_amount", "status")


@query("question_result_summary", f"""
    SELECT count(*) AS matching_records, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_exposure
    FROM v_invoices WHERE {_CASES}""")
def _(v):
    return cq.result_summary(cq.approval_cases(v.invoices))


# The conversations hold few keywords, so each turn is also asked with an opening that depends on its number.
_OPENINGS = ["Why ", "Which orders follow the approval policy? ", "What does the escalation guideline say? ",
             "What requires attention? ", "Show "]
_OPENED = "(CASE turn % 5 " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(_OPENINGS)) + " END || text)"


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


VIEW_SQL["v_intents"] = f"""
    SELECT conv_id, turn, CASE WHEN {_has(cq.POLICY_WORDS)} AND {_has(cq.CASE_WORDS)} THEN 'hybrid'
      WHEN {_has(cq.GUIDELINE_WORDS)} THEN 'policy_rag' WHEN starts_with(t, 'why') OR {_has(cq.CAUSE_WORDS)} THEN 'investigate'
      WHEN {_has(cq.PLAN_WORDS)} THEN 'action_plan' ELSE 'data_query' END AS intent
    FROM (SELECT conv_id, turn, lower({_OPENED}) AS t FROM conversations)"""


def _intents(v):
    opening = F.lit("Show ")
    for i, text in enumerate(_OPENINGS[:-1]):
        opening = F.when(F.col("turn") % 5 == i, text).otherwise(opening)
    return v.raw("conversations").select(
        "conv_id", "turn", cq.classify_intent(F.concat(opening, "text")).alias("intent"))


@query("question_intents", "SELECT * FROM v_intents")
def _(v):
    return _intents(v)


@query("question_tool_plans", """
    SELECT conv_id, turn, CASE intent WHEN 'hybrid' THEN 'search_documents,run_readonly_sql' WHEN 'policy_rag' THEN 'search_documents'
      WHEN 'investigate' THEN 'investigate_problem' WHEN 'action_plan' THEN 'calculate_kpi,detect_anomalies' ELSE 'run_readonly_sql' END AS tools
    FROM v_intents""")
def _(v):
    return _intents(v).select("conv_id", "turn", F.array_join(cq.plan_tools(F.col("intent")), ",").alias("tools"))


def _dimension_sql(columns: list[str], view: str) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS dimension, {i} AS ordinal, CAST({c} AS VARCHAR) AS segment, count(*) AS volume,
        (SELECT count(*) FROM {view}) AS total FROM {view} WHERE {c} IS NOT NULL GROUP BY {c}
        HAVING (SELECT count(DISTINCT {c}) FROM {view}) BETWEEN 2 AND 20""" for i, c in columns)


# the metric column order_id is left out, so ordinals start at the next column
VIEW_SQL["v_dimensions"] = _dimension_sql(list(enumerate(
    ["customer_id", "order_date", "status", "total_amount", "shipping_method", "payment_terms"])), "v_orders")


@query("drivers_candidate_dimensions", "SELECT dimension, ordinal, count(*) AS segments FROM v_dimensions GROUP BY 1, 2")
def _(v):
    return dr.candidate_dimensions(v.orders, "order_id")


_DRIVERS = """SELECT dimension, CAST(row_number() OVER (PARTITION BY dimension ORDER BY volume DESC, segment) AS INTEGER) AS rank, segment, volume,
    round(volume::DOUBLE / total * 100, 1) AS share_percentage, ordinal = (SELECT min(ordinal) FROM v_dimensions) AS is_primary
    FROM v_dimensions QUALIFY rank <= 3"""


@query("drivers_attribution", f"""SELECT *, segment || ' has ' || volume || ' of the orders, ' || share_percentage || '%' AS explanation FROM ({_DRIVERS})""")
def _(v):
    return dr.attribute_drivers(v.orders, "orders", "order_id")


@query("drivers_explained_share", f"""SELECT dimension, is_primary, round(sum(share_percentage), 1) AS explained_share_percentage
    FROM ({_DRIVERS}) GROUP BY 1, 2""")
def _(v):
    return dr.explained_share(dr.attribute_drivers(v.orders, "orders", "order_id"))


_PROBLEM = "Why did refund approvals above the threshold increase?"
VIEW_SQL["v_invoice_dimensions"] = _dimension_sql(list(enumerate(
    ["invoice_id", "customer_id", "order_id", "issue_date", "due_date", "amount", "status"])), "v_invoices")


@query("drivers_with_policy", f"""
    WITH hit AS MATERIALIZED (SELECT policy, content FROM {_top_hit(_PROBLEM)}),
    found AS MATERIALIZED ({_DRIVERS.replace("v_dimensions", "v_invoice_dimensions")})
    SELECT dimension, rank, segment, volume, share_percentage, is_primary, policy, content AS policy_snippet,
      segment || ' has ' || volume || ' of the invoices, ' || share_percentage || '%' AS explanation FROM found, hit""")
def _(v):
    problem = _PROBLEM
    table, metric = dr.investigation_target(problem, ["orders", "invoices"])
    chunks, index = corpus_index(v)
    hit = se.search(index, questions(v, {"q": problem}), k=1).join(chunks, "chunk_id").select(
        F.struct("doc_id", dr.policy_snippet(F.col("content")).alias("snippet")).alias("h")).scalar()
    return dr.attribute_drivers(v.table(table), table, metric).withColumns({
        "policy": hit.getField("doc_id"), "policy_snippet": hit.getField("snippet")})


def _exceptions(v):
    return rules_suite.exceptions(v)


def _handled(exceptions):
    """Actions that exist already: for the tickets and every order whose id is even."""
    even = (F.col("entity_type") == "order") & (F.col("entity_id").try_cast("long") % 2 == 0)
    return exceptions.filter((F.col("entity_type") == "ticket") | even).select("exception_id")


_UNHANDLED = "NOT (entity_type = 'ticket' OR (entity_type = 'order' AND TRY_CAST(entity_id AS BIGINT) % 2 = 0))"
_TOP5 = f"SELECT * FROM v_exceptions WHERE status = 'OPEN' AND {_UNHANDLED} {{}} ORDER BY priority_score DESC, rule_name, entity_id LIMIT 5"


@query("review_propose_actions", f"""
    SELECT 'To do: ' || title AS title, description, 'scored ' || printf('%.1f', priority_score) || ', at stake: '
      || format('{{:,.2f}}', financial_impact) AS reason, severity AS priority, 'Operations Manager' AS owner, 'create_task' AS action_type,
      'PROPOSED' AS status, true AS approval_required FROM ({_TOP5.format('')})""")
def _(v):
    found = _exceptions(v)
    return ac.propose_actions(found, _handled(found)).select(
        "title", "description", "reason", "priority", "owner", "action_type", "status", "approval_required")


@query("review_urgent_actions", f"""
    SELECT 'To do: ' || title AS title, 'urgent ' || entity_type AS reason, severity AS priority,
      CASE WHEN entity_type LIKE '%order%' THEN 'draft_email' ELSE 'create_task' END AS action_type
    FROM ({_TOP5.format("AND severity IN ('CRITICAL', 'HIGH')")})""")
def _(v):
    found = _exceptions(v)
    return ac.propose_urgent_actions(found, _handled(found)).select("title", "reason", "priority", "action_type")


# Actions and decisions from the events: a user stands for an action, event types for decisions.
VIEW_SQL["v_actions"] = """SELECT CAST(user_id AS VARCHAR) AS action_id, 'Order review ' || user_id AS title, 'PROPOSED' AS status,
    user_id % 4 <> 0 AS approval_required, CASE user_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'CRITICAL' ELSE 'LOW' END AS priority,
    CASE WHEN user_id % 2 = 0 THEN 'Operations Manager' ELSE 'Finance Lead' END AS owner, min(ts) AS created_at FROM events GROUP BY user_id"""
VIEW_SQL["v_decisions"] = """SELECT CAST(user_id AS VARCHAR) AS action_id, event_id, ts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'user' || event_id % 10 END AS user_name,
    CASE WHEN event_id % 2 = 0 THEN 'reason ' || event_id END AS reason,
    CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'execute' ELSE 'comment' END AS decision FROM events"""
VIEW_SQL["v_judged"] = """SELECT d.*, decision <> 'execute' OR NOT approval_required OR coalesce(prev = 'approve', false) AS legal
    FROM (SELECT *, lag(decision) OVER (PARTITION BY action_id ORDER BY ts, event_id) AS prev FROM v_decisions
      WHERE decision IN ('approve', 'reject', 'execute')) d JOIN v_actions a ON a.action_id = d.action_id"""


def _actions(v):
    user = F.col("user_id")
    return v.raw("events").groupBy("user_id").agg(F.min("ts").alias("created_at")).select(
        user.cast("string").alias("action_id"), F.concat(F.lit("Order review "), user.cast("string")).alias("title"),
        F.lit("PROPOSED").alias("status"), (user % 4 != 0).alias("approval_required"),
        F.when(user % 3 == 0, "HIGH").when(user % 3 == 1, "CRITICAL").otherwise("LOW").alias("priority"),
        F.when(user % 2 == 0, "Operations Manager").otherwise("Finance Lead").alias("owner"), "created_at",
        rules.exception_id(F.lit(rules.DEFAULT_RULES[2].name), user.cast("string")).alias("exception_id"))


def _decisions(v):
    kind, key = F.col("event_type"), F.col("event_id")
    return v.raw("events").select(
        F.col("user_id").cast("string").alias("action_id"), "event_id", "ts",
        F.when(key % 3 != 0, F.concat(F.lit("user"), (key % 10).cast("string"))).alias("user_name"),
        F.when(key % 2 == 0, F.concat(F.lit("reason "), key.cast("string"))).alias("reason"),
        F.when(kind == "purchase", "approve").when(kind == "error", "reject").when(kind == "click", "execute")
        .otherwise("comment").alias("decision"))


def _judged(v):
    return ac.judge_events(_actions(v), _decisions(v))


@query("action_list", """SELECT action_id, title, priority, owner FROM v_actions
    WHERE status = 'PROPOSED' AND priority = 'HIGH' AND owner ILIKE '%manager%'""")
def _(v):
    return ac.list_actions(_actions(v), "proposed", "high", "manager").select("action_id", "title", "priority", "owner")


@query("action_apply_decisions", """
    WITH l AS (SELECT *, row_number() OVER (PARTITION BY action_id ORDER BY ts DESC, event_id DESC) AS rn FROM v_judged WHERE legal),
    r AS (SELECT *, row_number() OVER (PARTITION BY action_id ORDER BY ts DESC, event_id DESC) AS rn FROM v_judged WHERE decision <> 'execute')
    SELECT a.action_id, CASE l.decision WHEN 'approve' THEN 'APPROVED' WHEN 'reject' THEN 'REJECTED' WHEN 'execute' THEN 'COMPLETED' ELSE a.status END AS status,
      CASE WHEN r.action_id IS NOT NULL THEN coalesce(r.user_name, 'Operations Manager') END AS approved_by,
      CASE WHEN r.decision = 'reject' THEN coalesce(r.reason, 'no reason given') END AS rejection_reason,
      (SELECT max(ts) FROM v_judged j WHERE legal AND decision = 'execute' AND j.action_id = a.action_id) AS executed_at
    FROM v_actions a LEFT JOIN l ON l.action_id = a.action_id AND l.rn = 1 LEFT JOIN r ON r.action_id = a.action_id AND r.rn = 1""")
def _(v):
    return ac.apply_decisions(_actions(v), _judged(v)).select(
        "action_id", "status", "approved_by", "rejection_reason", "executed_at")


@query("action_rejected_transitions", "SELECT action_id, event_id, user_name FROM v_judged WHERE NOT legal")
def _(v):
    return ac.rejected_transitions(_judged(v)).select("action_id", "event_id", "user_name")


@query("action_resolved_exceptions", """
    SELECT entity_id, CASE WHEN entity_id IN (SELECT action_id FROM v_judged WHERE legal AND decision = 'execute') THEN 'RESOLVED' ELSE 'OPEN' END AS status
    FROM v_exceptions WHERE entity_type = 'order'""")
def _(v):
    found = rules.evaluate_rules({"orders": v.orders}, [rules.DEFAULT_RULES[2]], rules_suite.AS_OF)
    applied = ac.apply_decisions(_actions(v), _judged(v))
    return ac.resolve_exceptions(found, applied).select("entity_id", "status")


@query("action_call_list", """
    SELECT invoice_id AS action_id, c.name, 'N/A' AS phone, CAST(c.customer_id AS VARCHAR) AS account, amount AS balance,
      'This is about: Collect ' || invoice_id || '. What do you need from us to settle it?' AS script
    FROM v_invoices i JOIN v_customers c ON c.customer_id = i.customer_id WHERE lower(i.status) = 'overdue'""")
def _(v):
    records = v.invoices.filter(F.lower("status") == "overdue").join(
        v.customers.select("customer_id", "name"), "customer_id").select(
        F.col("invoice_id").alias("action_id"), F.concat(F.lit("Collect "), "invoice_id").alias("title"), "name", "customer_id", "amount")
    return ac.call_list(records)


@query("action_draft_emails", """
    SELECT invoice_id AS action_id, CASE WHEN c.customer_id % 3 = 0 THEN 'customer-ops@example.com' ELSE email END AS recipient,
      'Please act: Collect ' || invoice_id AS subject,
      'Hello,' || chr(10) || chr(10) || 'this is about Collect ' || invoice_id || ' (' || i.status || ').'
        || chr(10) || chr(10) || 'Next steps:' || chr(10) || '  * Open the record' || chr(10) || '  * Correct it'
        || chr(10) || chr(10) || 'Written 2000-06-01 00:00:00 UTC' AS body
    FROM v_invoices i JOIN v_customers c ON c.customer_id = i.customer_id WHERE lower(i.status) = 'overdue'""")
def _(v):
    known = F.when(F.col("customer_id") % 3 != 0, F.col("email")).otherwise("")
    drafts = v.invoices.filter(F.lower("status") == "overdue").join(
        v.customers.select("customer_id", known.alias("email")), "customer_id").select(
        F.col("invoice_id").alias("action_id"), F.concat(F.lit("Collect "), "invoice_id").alias("title"), "email",
        F.lit("").alias("reason"), F.col("status").alias("description"), F.array().cast("array<string>").alias("suggested_steps"))
    return ac.draft_emails(drafts, AS_OF).select("action_id", "recipient", "subject", "body")


@query("action_task_checklist", """
    SELECT 'TASK-' || upper(substr(ticket, 1, 8)) AS task_id, priority AS assigned_to, s AS step_number, step
    FROM (SELECT 'ticket-' || ticket_id AS ticket, priority, unnest([0, 1, 2]) AS s,
      unnest(['Open the case', 'Make the change', 'Check the result']) AS step FROM v_support_tickets)""")
def _(v):
    tasks = v.support_tickets.select(
        F.concat(F.lit("ticket-"), F.col("ticket_id").cast("string")).alias("action_id"), F.col("priority").alias("owner"),
        F.array().cast("array<string>").alias("suggested_steps"))
    return ac.task_checklist(tasks).select("task_id", "assigned_to", "step_number", "step")


# Audit events from the events stream.
_KINDS = {"purchase": "action_approved", "error": "action_rejected", "click": "workflow_run", "view": "morning_review_run"}
VIEW_SQL["v_audit"] = "SELECT CASE event_type " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in _KINDS.items()) + """
    ELSE 'report_generated' END AS event_type, 'User ' || user_id AS user_name, 'action' AS entity_type, CAST(event_id AS VARCHAR) AS entity_id,
    ts AS created_at FROM events"""


def _audit(v):
    kind = F.lit("report_generated")
    for source, target in _KINDS.items():
        kind = F.when(F.col("event_type") == source, target).otherwise(kind)
    return v.raw("events").select(
        kind.alias("event_type"), F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("user_name"),
        F.lit("action").alias("entity_type"), F.col("event_id").cast("string").alias("entity_id"), F.col("ts").alias("created_at"))


@query("audit_list", """SELECT event_type, user_name, entity_id, created_at FROM v_audit
    WHERE event_type = 'workflow_run' AND entity_type = 'action' AND user_name ILIKE '%user 1%'""")
def _(v):
    return au.list_events(_audit(v), "workflow_run", "action", "user 1").select(
        "event_type", "user_name", "entity_id", "created_at")


@query("audit_breakdown", "SELECT event_type, count(*) AS events FROM v_audit GROUP BY 1")
def _(v):
    return au.event_breakdown(_audit(v))


@query("audit_stats", "SELECT count(*) AS total_audit_events, " + ", ".join(
    f"count(*) FILTER (event_type IN ({', '.join(repr(t) for t in types)})) AS {name}" for name, types in au.COUNTERS.items()) + " FROM v_audit")
def _(v):
    return au.audit_stats(_audit(v))


# Numeric columns of all tables; which of them are keys follows from their names.
_REVIEWED = {
    "customers": ["credit_limit"], "products": ["unit_cost", "unit_price", "reorder_level"],
    "inventory": ["quantity_on_hand", "reorder_level", "safety_stock", "unit_cost"], "orders": ["total_amount"],
    "order_items": ["line_no", "quantity", "line_total"], "shipments": ["line_no", "delay_days"], "invoices": ["amount", "unpaid_amount"],
    "payments": ["amount"], "support_tickets": ["satisfaction_score"], "employees": ["active_tasks", "resolved_tasks"]}
_REVIEW_Z = " UNION ALL ".join(anomalies_suite._z_sql(t, f"v_{t}", c, "1", None, 1.7) for t, columns in _REVIEWED.items() for c in columns)
_KPI_STATUS = " UNION ALL ".join(kpis_suite._metric_sql(m, False) for m in kpis_suite._METRICS)


def _review_parts(v):
    tables = v.as_dict("orders", "invoices", "inventory", "support_tickets", "shipments")
    _, scores = quality_suite.audit_parts(v)
    board = kpi.kpi_board(tables, kpi.default_kpis(kpis_suite.AS_OF))
    sla = en.sla_summary(v.orders, v.support_tickets, v.invoices)
    return scores, board, _exceptions(v), sla


@query("review_morning", f"""
    SELECT * FROM (SELECT CAST(round(CAST(avg(overall_score) AS DECIMAL(20,6)), 1) AS DOUBLE) AS data_health_score FROM v_health),
    (SELECT count(*) AS total_kpis, count(*) FILTER (status = 'GOOD') AS kpi_good, count(*) FILTER (status = 'WARNING') AS kpi_warning,
       count(*) FILTER (status = 'CRITICAL') AS kpi_critical FROM ({_KPI_STATUS})),
    (SELECT count(*) AS total_open, count(*) FILTER (severity = 'CRITICAL') AS open_critical, count(*) FILTER (severity = 'HIGH') AS open_high,
       count(*) FILTER (severity = 'MEDIUM') AS open_medium, count(*) FILTER (severity = 'LOW') AS open_low,
       CAST(sum(CAST(financial_impact AS DECIMAL(18,2))) AS DOUBLE) AS total_financial_impact FROM v_exceptions), v_sla_summary,
    (SELECT count(*) AS anomalies_detected FROM ({_REVIEW_Z}))""")
def _(v):
    anomalies = reduce(lambda a, b: a.unionByName(b), [
        ad.scan_anomalies(v.table(t), t, method="z_score", threshold=1.7) for t in _REVIEWED])
    return rv.morning_review(*_review_parts(v), anomalies)


@query("report_executive_summary", """
    SELECT 1 AS position, 'Overall Data Health Score' AS label, CAST(round(CAST(avg(overall_score) AS DECIMAL(20,6)), 1) AS DOUBLE) || '%' AS value FROM v_health
    UNION ALL SELECT 2, 'Active Open Exceptions', CAST(count(*) AS VARCHAR) FROM v_exceptions
    UNION ALL SELECT 3, 'Open Action Items', CAST(count(*) AS VARCHAR) FROM v_actions
    UNION ALL SELECT 4, 'SLA Breached Entities', CAST(breached_count AS VARCHAR) FROM v_sla_summary
    UNION ALL SELECT 5, 'SLA At-Risk Entities', CAST(at_risk_count AS VARCHAR) FROM v_sla_summary
    UNION ALL SELECT 6, 'Total SLA Exposure', '$' || format('{:,.2f}', financial_exposure) FROM v_sla_summary""")
def _(v):
    _, scores = quality_suite.audit_parts(v)
    # one row that three summary lines read
    sla = cut_lineage(en.sla_summary(v.orders, v.support_tickets, v.invoices))
    return rv.executive_summary(scores, _exceptions(v), _actions(v), sla)


@query("report_exceptions_section", """
    SELECT title, severity, entity_type, financial_impact, priority_score, status FROM v_exceptions""")
def _(v):
    sections = rv.report_sections(v.spark, "Current", AS_OF, exceptions=_exceptions(v))
    return sections["exceptions"].drop("exception_id")


# The last and the first year of complete orders, and what each combination of dimensions adds to the change between them.
_CHANGE = """
    WITH rows AS (
      SELECT coalesce(o.status, '(none)') AS status, coalesce(shipping_method, '(none)') AS shipping_method, coalesce(tier, '(none)') AS tier,
        CASE extract('year' FROM order_date) WHEN 1996 THEN 'before' WHEN 1997 THEN 'after' END AS period, CAST(total_amount AS DECIMAL(18,2)) AS metric
      FROM v_orders o LEFT JOIN v_customers c ON c.customer_id = o.customer_id),
    cube AS (
      SELECT status, shipping_method, tier, CAST(grouping(status, shipping_method, tier) AS INTEGER) AS level,
        coalesce(sum(metric) FILTER (period = 'before'), 0) AS before, coalesce(sum(metric) FILTER (period = 'after'), 0) AS after
      FROM rows WHERE period IS NOT NULL GROUP BY CUBE (status, shipping_method, tier)),
    kept AS (
      SELECT * FROM cube c WHERE NOT EXISTS (SELECT 1 FROM cube p WHERE p.before = c.before AND p.after = c.after AND (
        (c.status IS NOT NULL AND p.status IS NULL AND p.shipping_method IS NOT DISTINCT FROM c.shipping_method AND p.tier IS NOT DISTINCT FROM c.tier)
        OR (c.shipping_method IS NOT NULL AND p.shipping_method IS NULL AND p.status IS NOT DISTINCT FROM c.status AND p.tier IS NOT DISTINCT FROM c.tier)
        OR (c.tier IS NOT NULL AND p.tier IS NULL AND p.status IS NOT DISTINCT FROM c.status AND p.shipping_method IS NOT DISTINCT FROM c.shipping_method))))
    SELECT status, shipping_method, tier, level, CAST(before AS DOUBLE) AS before, CAST(after AS DOUBLE) AS after, CAST(after - before AS DOUBLE) AS change,
      """ + sround("CAST(after - before AS DOUBLE) / (SELECT CAST(after - before AS DOUBLE) FROM cube WHERE level = 7) * 100", 1) + """ AS share_percentage FROM kept"""


@query("drivers_change", _CHANGE)
def _(v):
    rows = v.orders.join(v.customers.select("customer_id", "tier"), "customer_id", "left")
    year = F.year("order_date")
    period = F.when(year == 1996, "before").when(year == 1997, "after")
    return dr.attribute_change(rows, period, ["status", "shipping_method", "tier"], F.col("total_amount"))

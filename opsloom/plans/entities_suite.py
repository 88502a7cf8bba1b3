"""Entity views and the SLA monitor as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import entities as en
from opsloom.plans.registry import VIEW_SQL, query


_ORDERS = "(SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC, order_id) AS rn FROM v_orders)"

VIEW_SQL["v_c360"] = f"""
    SELECT *, greatest(0.0, least(100.0, 100.0 - (overdue_invoices * 20 + late_orders * 15 + open_tickets * 10 + breached_tickets * 25
      + CASE WHEN open_invoices_balance > 1000 THEN 15 ELSE 0 END)))::DOUBLE AS health_score FROM (
    SELECT c.customer_id, c.name, coalesce(total_orders, 0) AS total_orders, coalesce(total_spent, 0) AS total_spent,
      coalesce(late_orders, 0) AS late_orders, coalesce(balance, 0) AS open_invoices_balance,
      coalesce(overdue_invoices, 0) AS overdue_invoices, coalesce(open_tickets, 0) AS open_tickets,
      coalesce(breached_tickets, 0) AS breached_tickets, coalesce(recent, '') AS recent
    FROM v_customers c
    LEFT JOIN (SELECT customer_id, count(*) AS total_orders, CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_spent,
        count(*) FILTER (lower(status) LIKE '%delay%' OR lower(status) LIKE '%late%') AS late_orders,
        string_agg(CAST(order_id AS VARCHAR), ',' ORDER BY rn) FILTER (rn <= 10) AS recent
      FROM {_ORDERS} GROUP BY 1) o ON o.customer_id = c.customer_id
    LEFT JOIN (SELECT customer_id, CAST(sum(CAST(amount AS DECIMAL(18,2))) FILTER (lower(status) NOT IN ('paid', 'settled', 'void')) AS DOUBLE) AS balance,
        count(*) FILTER (lower(status) LIKE '%overdue%') AS overdue_invoices FROM v_invoices GROUP BY 1) i ON i.customer_id = c.customer_id
    LEFT JOIN (SELECT customer_id, count(*) FILTER (lower(status) NOT IN ('closed', 'resolved')) AS open_tickets,
        count(*) FILTER (lower(sla_status) LIKE '%breach%') AS breached_tickets FROM v_support_tickets GROUP BY 1) t ON t.customer_id = c.customer_id)"""


def _c360(v):
    return en.customer_360(v.customers, v.orders, v.invoices, v.support_tickets)


@query("entity_customer_lookup", """
    SELECT customer_id, name FROM v_customers WHERE CAST(customer_id AS VARCHAR) = '77' OR name ILIKE '%77%' OR name ILIKE '%#00000007%'""")
def _(v):
    return en.find_customer(v.customers, "77").unionByName(en.find_customer(v.customers, "#00000007")).distinct().select(
        "customer_id", "name")


@query("entity_order_metrics", f"""
    SELECT CAST(customer_id AS VARCHAR) AS customer_id, count(*) AS total_orders,
      CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_spent,
      count(*) FILTER (lower(status) LIKE '%delay%' OR lower(status) LIKE '%late%') AS late_orders FROM v_orders GROUP BY 1""")
def _(v):
    return en.order_metrics(v.orders).select(
        F.col("_key").alias("customer_id"), "total_orders", "total_spent", "late_orders")


@query("entity_invoice_metrics", f"""
    SELECT CAST(customer_id AS VARCHAR) AS customer_id,
      coalesce(CAST(sum(CAST(amount AS DECIMAL(18,2))) FILTER (lower(status) NOT IN ('paid', 'settled', 'void')) AS DOUBLE), 0) AS open_invoices_balance,
      count(*) FILTER (lower(status) LIKE '%overdue%') AS overdue_invoices FROM v_invoices GROUP BY 1""")
def _(v):
    return en.invoice_metrics(v.invoices).select(
        F.col("_key").alias("customer_id"), "open_invoices_balance", "overdue_invoices")


@query("entity_ticket_metrics", f"""
    SELECT CAST(customer_id AS VARCHAR) AS customer_id, count(*) FILTER (lower(status) NOT IN ('closed', 'resolved')) AS open_tickets,
      count(*) FILTER (lower(sla_status) LIKE '%breach%') AS breached_tickets FROM v_support_tickets GROUP BY 1""")
def _(v):
    return en.ticket_metrics(v.support_tickets).select(
        F.col("_key").alias("customer_id"), "open_tickets", "breached_tickets")


@query("entity_customer_health", """
    SELECT customer_id, health_score, CASE WHEN health_score >= 80 THEN 'LOW_RISK' WHEN health_score >= 50 THEN 'MEDIUM_RISK'
      ELSE 'HIGH_RISK' END AS risk_tier FROM v_c360""")
def _(v):
    return _c360(v).select("customer_id", "health_score", "risk_tier")


@query("entity_customer_360", """
    SELECT customer_id, name, total_orders, round(total_spent, 2) AS total_spent, late_orders,
      round(open_invoices_balance, 2) AS open_invoices_balance, overdue_invoices, open_tickets, breached_tickets, health_score,
      recent AS recent_orders,
      CASE WHEN open_invoices_balance > 0 THEN 'Ask for the unpaid ' || format('{:,.2f}', open_invoices_balance)
        ELSE 'Nothing unpaid' END || '; ' ||
      CASE WHEN open_tickets > 0 THEN 'Tickets to close: ' || open_tickets ELSE 'No ticket to close' END AS advice FROM v_c360""")
def _(v):
    ids = F.transform("orders", lambda o: o["order_id"].cast("string"))
    return _c360(v).select(
        "customer_id", "name", "total_orders", "total_spent", "late_orders", "open_invoices_balance", "overdue_invoices",
        "open_tickets", "breached_tickets", "health_score",
        F.coalesce(F.array_join(ids, ","), F.lit("")).alias("recent_orders"),
        F.array_join("recommended_actions", "; ").alias("advice"))


@query("entity_order_360", """
    WITH i AS (SELECT order_id, count(*) AS item_count, CAST(sum(CAST(line_total AS DECIMAL(18,2))) AS DOUBLE) AS items_total
      FROM v_order_items GROUP BY 1),
    s AS (SELECT *, count(*) OVER (PARTITION BY order_id) AS n, row_number() OVER (PARTITION BY order_id
      ORDER BY line_no, ship_date, carrier, status, delay_days) AS rn FROM v_shipments),
    b AS (SELECT order_id, count(*) AS invoice_count, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS invoiced_total
      FROM v_invoices GROUP BY 1)
    SELECT o.order_id, o.status, coalesce(item_count, 0) AS item_count, coalesce(items_total, 0) AS items_total,
      coalesce(s.n, 0) AS shipment_count, coalesce(invoice_count, 0) AS invoice_count, coalesce(invoiced_total, 0) AS invoiced_total,
      CASE WHEN o.status = 'Delayed' OR s.status = 'Delayed' THEN 'DELAYED' ELSE 'ON_TIME' END AS sla_status,
      CAST(CASE WHEN o.status = 'Delayed' THEN 3 WHEN s.status = 'Delayed' THEN coalesce(s.delay_days, 2) ELSE 0 END AS INTEGER) AS delay_days,
      coalesce(s.carrier, 'N/A') AS carrier
    FROM v_orders o LEFT JOIN i ON i.order_id = o.order_id LEFT JOIN s ON s.order_id = o.order_id AND s.rn = 1
    LEFT JOIN b ON b.order_id = o.order_id""")
def _(v):
    return en.order_360(v.orders, v.order_items, v.shipments, v.invoices).select(
        "order_id", "status", "item_count", "items_total", "shipment_count", "invoice_count", "invoiced_total",
        "sla_status", "delay_days", "carrier")


@query("entity_order_360_details", """
    SELECT order_id, 'items' AS section, line_no, product_id AS item, CAST(line_total AS VARCHAR) AS value FROM v_order_items
    UNION ALL SELECT order_id, 'shipments', line_no, NULL, status || ' ' || carrier FROM v_shipments
    UNION ALL SELECT order_id, 'invoices', NULL, NULL, invoice_id || ' ' || status FROM v_invoices""")
def _(v):
    details = en.order_360_details(v.order_items, v.shipments, v.invoices)
    field = lambda name: F.get_json_object("record", f"$.{name}")
    is_of = lambda name: F.col("section") == name
    return details.select(
        "order_id", "section", field("line_no").cast(v.order_items.schema["line_no"].dataType).alias("line_no"),
        field("product_id").cast(v.order_items.schema["product_id"].dataType).alias("item"),
        F.when(is_of("items"), field("line_total")).when(is_of("shipments"), F.concat_ws(" ", field("status"), field("carrier")))
        .otherwise(F.concat_ws(" ", field("invoice_id"), field("status"))).alias("value"))


VIEW_SQL["v_sla_items"] = """
    SELECT 'order' AS entity_type, CAST(order_id AS VARCHAR) AS entity_id, CAST(customer_id AS VARCHAR) AS customer_id,
      CASE WHEN status = 'Delayed' THEN 'Late order ' ELSE 'Waiting order ' END || order_id AS title,
      CASE WHEN status = 'Delayed' THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
      CASE WHEN status = 'Delayed' THEN 'BREACHED' ELSE 'AT_RISK' END AS status, total_amount AS financial_impact,
      CASE WHEN status = 'Delayed' THEN 'delivery' ELSE 'fulfilment' END AS sla_type,
      'ordered ' || strftime(order_date, '%Y-%m-%d') || CASE WHEN status = 'Delayed' THEN ', now Delayed' ELSE ', not yet sent' END AS details
    FROM v_orders WHERE status IN ('Delayed', 'Processing')
    UNION ALL
    SELECT 'ticket', CAST(ticket_id AS VARCHAR), CAST(customer_id AS VARCHAR),
      CASE WHEN b THEN 'Broken promise on ticket ' ELSE 'Urgent ticket ' END || ticket_id || ': ' || subject,
      CASE WHEN b THEN 'CRITICAL' ELSE 'WARNING' END, CASE WHEN b THEN 'BREACHED' ELSE 'AT_RISK' END,
      CAST(CASE WHEN b AND priority = 'Critical' THEN 500 ELSE 200 END AS DOUBLE), 'response',
      'priority ' || upper(priority) || CASE WHEN b THEN ', time is up' ELSE ', time runs out' END
    FROM (SELECT *, sla_status = 'Breached' AS b FROM v_support_tickets)
    WHERE b OR sla_status = 'At Risk' OR (status <> 'Resolved' AND priority IN ('High', 'Critical'))
    UNION ALL
    SELECT 'invoice', invoice_id, CAST(customer_id AS VARCHAR), 'Overdue invoice ' || invoice_id, 'HIGH', 'BREACHED', amount,
      'payment', format('{:,.2f}', amount) || ' was due ' || strftime(due_date, '%Y-%m-%d')
    FROM v_invoices WHERE lower(status) LIKE '%overdue%'"""
VIEW_SQL["v_sla_summary"] = """
    SELECT total_monitored, breached_count, at_risk_count, financial_exposure, greatest(0, total_monitored - breached_count - at_risk_count) AS safe_count
    FROM (SELECT (SELECT count(*) FROM v_orders) + (SELECT count(*) FROM v_support_tickets) + (SELECT count(*) FROM v_invoices) AS total_monitored,
      count(*) FILTER (status = 'BREACHED') AS breached_count, count(*) FILTER (status = 'AT_RISK') AS at_risk_count,
      CAST(sum(CAST(financial_impact AS DECIMAL(18,2))) FILTER (status = 'BREACHED') AS DOUBLE) AS financial_exposure FROM v_sla_items)"""


@query("sla_orders", "SELECT * FROM v_sla_items WHERE entity_type = 'order'")
def _(v):
    return en.order_sla(v.orders)


@query("sla_tickets", "SELECT * FROM v_sla_items WHERE entity_type = 'ticket'")
def _(v):
    return en.ticket_sla(v.support_tickets)


@query("sla_invoices", "SELECT * FROM v_sla_items WHERE entity_type = 'invoice'")
def _(v):
    return en.invoice_sla(v.invoices)


@query("sla_summary", "SELECT * FROM v_sla_summary")
def _(v):
    return en.sla_summary(v.orders, v.support_tickets, v.invoices)


@query("sla_breached_list", """
    SELECT entity_type, entity_id, title, financial_impact FROM v_sla_items WHERE status = 'BREACHED'""")
def _(v):
    items = en.sla_items(v.orders, v.support_tickets, v.invoices)
    return en.sla_list(items, "BREACHED").select("entity_type", "entity_id", "title", "financial_impact")

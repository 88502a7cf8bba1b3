"""Business questions as registered queries, with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.plans import business_questions as bq
from opsloom.plans.registry import query, sround

AS_OF = "2001-09-01 00:00:00"
TICKETS_AS_OF = "2024-01-31 00:00:00"


def dec(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,2))"


def dsum(x: str) -> str:
    return f"CAST(sum({dec(x)}) AS DOUBLE)"


def davg(x: str) -> str:
    return f"({dsum(x)} / count({x}))"


@query("bq01_delayed_orders", "SELECT count(*) AS delayed_count FROM v_orders WHERE lower(status) = 'delayed'")
def _(v):
    return bq.count_delayed_orders(v.orders)


@query("bq01b_late_pending_orders", f"""
    SELECT o.order_id, customer_id, o.status, CAST(p.estimated_delivery AS DATE) AS estimated_delivery
    FROM v_orders o JOIN (SELECT order_id, min(estimated_delivery) AS estimated_delivery FROM v_shipments GROUP BY 1) p
      ON o.order_id = p.order_id
    WHERE lower(o.status) <> 'delivered' AND p.estimated_delivery < TIMESTAMP '{AS_OF}'""")
def _(v):
    return bq.late_pending_orders(v.orders, v.shipments, AS_OF)


@query("bq02_revenue_by_category", f"""
    SELECT p.category, round({dsum('oi.line_total')}, 2) AS cat_revenue
    FROM v_order_items oi JOIN v_products p ON oi.product_id = p.product_id GROUP BY p.category""")
def _(v):
    return bq.revenue_by_category(v.order_items, v.products)


@query("bq02b_delivered_revenue_by_category", f"""
    SELECT p.category, round({dsum('oi.line_total')}, 2) AS cat_revenue
    FROM v_order_items oi JOIN v_products p ON oi.product_id = p.product_id
    JOIN v_orders o ON o.order_id = oi.order_id WHERE o.status = 'Delivered' GROUP BY p.category""")
def _(v):
    return bq.revenue_by_category(v.order_items, v.products, v.orders)


@query("bq03_overdue_total", f"SELECT round({dsum('amount')}, 2) AS total_overdue FROM v_invoices WHERE lower(status) = 'overdue'")
def _(v):
    return bq.overdue_total(v.invoices)


@query("bq03b_overdue_aging", f"""
    SELECT invoice_id, customer_id, unpaid_amount, date_sub('day', due_date, TIMESTAMP '{AS_OF}') AS aging_days
    FROM v_invoices WHERE lower(status) = 'overdue' AND due_date < TIMESTAMP '{AS_OF}'""")
def _(v):
    return bq.overdue_aging(v.invoices, AS_OF)


@query("bq04_low_stock", """
    SELECT sku, product_name, quantity_on_hand, reorder_level FROM v_inventory
    WHERE quantity_on_hand <= reorder_level""")
def _(v):
    return bq.low_stock(v.inventory)


_TOP = f"""SELECT c.customer_id, c.name, round({dsum('o.total_amount')}, 2) AS total_spent
    FROM v_orders o JOIN v_customers c ON o.customer_id = c.customer_id WHERE %s
    GROUP BY c.customer_id, c.name ORDER BY total_spent DESC, c.customer_id LIMIT %d"""


@query("bq05_top_customers", _TOP % ("true", 5))
def _(v):
    return bq.top_customers(v.orders, v.customers, 5)


@query("bq05b_top_customers_completed", _TOP % ("o.status = 'Delivered'", 10))
def _(v):
    return bq.top_customers(v.orders, v.customers, 10, completed_only=True)


@query("bq06_delays_by_carrier", f"""
    SELECT carrier, count(*) AS delay_count, {sround('avg(delay_days)', 1)} AS avg_delay
    FROM v_shipments WHERE delay_days > 0 GROUP BY carrier""")
def _(v):
    return bq.delays_by_carrier(v.shipments)


@query("bq06b_late_rate_by_carrier", """
    SELECT carrier, count(*) AS shipments, count(*) FILTER (status = 'Delayed') AS late,
           round(CAST(count(*) FILTER (status = 'Delayed') AS DOUBLE) / count(*) * 100, 2) AS late_pct
    FROM v_shipments GROUP BY carrier""")
def _(v):
    return bq.late_rate_by_carrier(v.shipments)


@query("bq07_ticket_breach_rate", """
    SELECT count(*) AS total_tickets, count(*) FILTER (lower(sla_status) = 'breached') AS breached_count,
           round(CAST(count(*) FILTER (lower(sla_status) = 'breached') AS DOUBLE) / count(*) * 100, 2) AS breach_rate
    FROM v_support_tickets""")
def _(v):
    return bq.ticket_breach_rate(v.support_tickets)


@query("bq07b_tickets_past_deadline", f"""
    SELECT ticket_id, customer_id, priority, status FROM v_support_tickets
    WHERE status <> 'Resolved' AND priority IN ('High', 'Critical') AND sla_deadline < TIMESTAMP '{TICKETS_AS_OF}'""")
def _(v):
    return bq.tickets_past_deadline(v.support_tickets, TICKETS_AS_OF)


@query("bq08_satisfaction_by_priority", f"""
    SELECT priority, {sround('avg(satisfaction_score)', 2)} AS avg_csat FROM v_support_tickets
    WHERE satisfaction_score IS NOT NULL GROUP BY priority""")
def _(v):
    return bq.satisfaction_by_priority(v.support_tickets)


@query("bq09_shipping_methods", f"""
    SELECT shipping_method, count(*) AS order_count, round({dsum('total_amount')}, 2) AS total_val
    FROM v_orders GROUP BY shipping_method""")
def _(v):
    return bq.orders_by_shipping_method(v.orders)


@query("bq09b_delivery_by_shipping_method", f"""
    WITH per_order AS (SELECT o.order_id, shipping_method, total_amount, count(actual_delivery) AS n,
             sum(date_diff('day', order_date, actual_delivery)) AS days
        FROM v_orders o LEFT JOIN (SELECT order_id, actual_delivery FROM v_shipments WHERE actual_delivery IS NOT NULL) s
          ON o.order_id = s.order_id GROUP BY ALL)
    SELECT shipping_method, {sround(davg('total_amount'), 2)} AS avg_order_value,
           CAST(sum(n) AS BIGINT) AS closed_shipments, {sround('CAST(sum(days) AS DOUBLE) / sum(n)', 2)} AS avg_days
    FROM per_order GROUP BY shipping_method""")
def _(v):
    return bq.delivery_by_shipping_method(v.orders, v.shipments)


@query("bq10_busiest_employees", """
    SELECT department, name, active_tasks FROM v_employees ORDER BY active_tasks DESC, name LIMIT 5""")
def _(v):
    return bq.busiest_employees(v.employees)


@query("bq10b_employee_workload", """
    SELECT employee_id, department, active_tasks, resolved_tasks, coalesce(n, 0) AS orders_handled
    FROM v_employees LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)
      ON l_suppkey = employee_id""")
def _(v):
    lines = v.raw("lineitem").select(F.col("l_suppkey").alias("employee_id"), F.col("l_orderkey").alias("order_id"))
    return bq.employee_workload(v.employees, lines)


@query("bq11_valuation_by_warehouse", f"""
    SELECT warehouse_location, round({dsum('quantity_on_hand * unit_cost')}, 2) AS total_valuation
    FROM v_inventory GROUP BY warehouse_location""")
def _(v):
    return bq.valuation_by_warehouse(v.inventory)


@query("bq11b_valuation_with_total", f"""
    SELECT warehouse_location, round({dsum('quantity_on_hand * unit_cost')}, 2) AS total_valuation,
           CAST(grouping(warehouse_location) AS INTEGER) AS is_total
    FROM v_inventory GROUP BY ROLLUP (warehouse_location)""")
def _(v):
    return bq.valuation_with_total(v.inventory)


@query("bq12_customers_on_hold", """
    SELECT customer_id, name, credit_limit, status FROM v_customers WHERE lower(status) = 'credit_hold'""")
def _(v):
    return bq.customers_on_hold(v.customers)


@query("bq12b_customers_over_limit", f"""
    SELECT c.customer_id, name, credit_limit, open_balance
    FROM v_customers c JOIN (SELECT customer_id, {dsum('unpaid_amount')} AS open_balance FROM v_invoices
        WHERE lower(status) NOT IN ('paid', 'settled', 'void') GROUP BY 1) b ON b.customer_id = c.customer_id
    WHERE open_balance > credit_limit""")
def _(v):
    return bq.customers_over_limit(v.customers, v.invoices)


@query("bq13_average_order_value", f"""
    SELECT {sround(davg('total_amount'), 2)} AS aov, count(*) AS total_orders FROM v_orders""")
def _(v):
    return bq.average_order_value(v.orders)


@query("bq13b_monthly_order_value", f"""
    SELECT strftime(order_date, '%Y-%m') AS month, {sround(davg('total_amount'), 2)} AS aov, count(*) AS total_orders
    FROM v_orders WHERE status = 'Delivered' GROUP BY 1""")
def _(v):
    return bq.monthly_order_value(v.orders)


@query("bq14_payment_methods", f"""
    SELECT payment_method, count(*) AS pmt_count, round({dsum('amount')}, 2) AS total_collected
    FROM v_payments GROUP BY payment_method""")
def _(v):
    return bq.payments_by_method(v.payments)


@query("bq15_multi_line_orders", """
    SELECT order_id, count(*) AS item_count FROM v_order_items GROUP BY order_id HAVING count(*) > 2""")
def _(v):
    return bq.multi_line_orders(v.order_items, 2)


@query("bq15b_orders_with_three_lines", """
    SELECT order_id, count(*) AS item_count FROM v_order_items GROUP BY order_id HAVING count(*) >= 3""")
def _(v):
    return bq.multi_line_orders(v.order_items, 2)


@query("bq16_customers_by_tier", f"""
    SELECT tier, count(*) AS cust_count, {sround(davg('credit_limit'), 2)} AS avg_limit FROM v_customers GROUP BY tier""")
def _(v):
    return bq.customers_by_tier(v.customers)


@query("bq16b_margin_by_tier", """
    WITH sums AS (SELECT tier, sum(CAST(line_total AS DECIMAL(18,2))) AS r,
            sum(CAST(quantity AS DECIMAL(14,2)) * CAST(unit_cost AS DECIMAL(14,2))) AS c
        FROM v_order_items i JOIN v_products p ON p.product_id = i.product_id
        JOIN v_orders o ON o.order_id = i.order_id JOIN v_customers cu ON cu.customer_id = o.customer_id GROUP BY tier)
    SELECT tier, round(CAST(r AS DOUBLE), 2) AS revenue, round(CAST(c AS DOUBLE), 2) AS cost,
           round((round(CAST(r AS DOUBLE), 2) - round(CAST(c AS DOUBLE), 2)) / round(CAST(r AS DOUBLE), 2) * 100, 2) AS margin_pct
    FROM sums""")
def _(v):
    return bq.margin_by_tier(v.customers, v.orders, v.order_items, v.products)


@query("bq17_distinct_products", "SELECT count(DISTINCT product_id) AS unique_prods FROM v_order_items")
def _(v):
    return bq.distinct_products(v.order_items)


@query("bq17b_rolling_distinct_products", """
    WITH active AS (SELECT DISTINCT CAST(order_date AS DATE) AS day, product_id
        FROM v_order_items i JOIN v_orders o ON o.order_id = i.order_id),
    covered AS (SELECT product_id, unnest(range(0, 30)) AS k, day FROM active)
    SELECT CAST(day + CAST(k AS INTEGER) AS DATE) AS day, count(DISTINCT product_id) AS unique_products
    FROM covered WHERE day + CAST(k AS INTEGER) IN (SELECT day FROM active) GROUP BY 1""")
def _(v):
    return bq.rolling_distinct_products(v.order_items, v.orders)


@query("bq18_unresolved_critical", """
    SELECT ticket_id, subject, priority, status, sla_status FROM v_support_tickets
    WHERE priority = 'Critical' AND status <> 'Resolved'""")
def _(v):
    return bq.unresolved_critical(v.support_tickets)


@query("bq19_highest_priced", """
    SELECT product_id, name, unit_price FROM v_products ORDER BY unit_price DESC, product_id LIMIT 3""")
def _(v):
    return bq.highest_priced(v.products)


@query("bq19b_widest_margin", """
    SELECT product_id, name, round(unit_price - unit_cost, 2) AS margin_spread FROM v_products
    ORDER BY margin_spread DESC, product_id LIMIT 10""")
def _(v):
    return bq.widest_margin(v.products)


@query("bq20_shipments_by_status", """SELECT status, count(*) AS "count" FROM v_shipments GROUP BY status""")
def _(v):
    return bq.shipments_by_status(v.shipments)


@query("bq20b_on_time_rate", """
    WITH t AS (SELECT count(*) FILTER (status IN ('Delivered', 'Delayed')) AS closed,
                      count(*) FILTER (status = 'Delivered') AS on_time FROM v_shipments)
    SELECT closed, on_time, round(CAST(on_time AS DOUBLE) / closed * 100, 2) AS on_time_pct,
           CAST(95 AS DOUBLE) AS target_pct, round(CAST(on_time AS DOUBLE) / closed * 100, 2) >= 95 AS meets_target FROM t""")
def _(v):
    return bq.on_time_rate(v.shipments)


@query("bq21_orders_and_overdue", """
    WITH o AS (SELECT customer_id, count(DISTINCT order_id) AS total_orders FROM v_orders GROUP BY 1),
    i AS (SELECT customer_id, count(DISTINCT invoice_id) AS overdue_invoices FROM v_invoices
          WHERE lower(status) = 'overdue' GROUP BY 1)
    SELECT c.customer_id, c.name, total_orders, overdue_invoices
    FROM v_customers c JOIN o ON o.customer_id = c.customer_id JOIN i ON i.customer_id = c.customer_id
    ORDER BY overdue_invoices DESC, c.customer_id LIMIT 5""")
def _(v):
    return bq.orders_and_overdue_by_customer(v.customers, v.orders, v.invoices)


# The testdata invoices equal their orders, so the billed side is shifted by a
# fixed rule on both engines: every 11th order is billed 5.00 too much.
@query("bq21b_invoice_discrepancies", """
    WITH billed AS (SELECT order_id, CASE WHEN order_id % 11 = 0 THEN amount + 5.0 ELSE amount END AS amount FROM v_invoices)
    SELECT o.order_id, total_amount, round(CAST(CAST(amount AS DECIMAL(18,2)) AS DOUBLE), 2) AS invoiced,
           round(abs(total_amount - CAST(CAST(amount AS DECIMAL(18,2)) AS DOUBLE)), 2) AS difference
    FROM v_orders o FULL JOIN billed b ON o.order_id = b.order_id
    WHERE abs(total_amount - CAST(CAST(amount AS DECIMAL(18,2)) AS DOUBLE)) > 0.01""")
def _(v):
    shifted = v.invoices.withColumn(
        "amount", F.when(F.col("order_id") % 11 == 0, F.col("amount") + 5.0).otherwise(F.col("amount")))
    return bq.invoice_discrepancies(v.orders, shifted)

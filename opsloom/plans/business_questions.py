"""The named business questions over the operations tables.

Fact tables are aggregated on the join key before they are joined, so a hot key
is combined map-side and every join is one row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.functions.columns import as_of_literal, complete_days, lowered, money, money_avg, money_sum, percent, stable_round


def status_is(value: str):
    return lowered("status") == value


def count_delayed_orders(orders: DataFrame) -> DataFrame:
    return orders.filter(status_is("delayed")).agg(F.count(F.lit(1)).alias("delayed_count"))


def late_pending_orders(orders: DataFrame, shipments: DataFrame, as_of: str) -> DataFrame:
    """Orders not delivered yet whose earliest promised delivery is before ``as_of``."""
    promised = shipments.groupBy("order_id").agg(F.min("estimated_delivery").alias("estimated_delivery"))
    return (
        orders.filter(~status_is("delivered"))
        .join(promised.filter(F.col("estimated_delivery") < as_of_literal(as_of)), "order_id")
        .select("order_id", "customer_id", "status", F.to_date("estimated_delivery").alias("estimated_delivery"))
    )


def revenue_by_category(items: DataFrame, products: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """Revenue per product category; only delivered orders when ``orders`` is given."""
    if orders is not None:
        delivered = orders.filter(status_is("delivered")).select("order_id")
        items = items.join(delivered, "order_id", "left_semi")
    per_product = items.groupBy("product_id").agg(F.sum(money("line_total")).alias("_revenue"))
    return (
        per_product.join(products.select("product_id", "category"), "product_id")
        .groupBy("category").agg(F.round(F.sum("_revenue").cast("double"), 2).alias("cat_revenue"))
        .orderBy(F.desc("cat_revenue"), "category")
    )


def overdue_total(invoices: DataFrame) -> DataFrame:
    return invoices.filter(status_is("overdue")).agg(F.round(money_sum("amount"), 2).alias("total_overdue"))


def overdue_aging(invoices: DataFrame, as_of: str) -> DataFrame:
    """Overdue invoices with the whole days since they were due."""
    now = as_of_literal(as_of)
    return invoices.filter(status_is("overdue") & (F.col("due_date") < now)).select(
        "invoice_id", "customer_id", "unpaid_amount", complete_days(F.col("due_date"), now).alias("aging_days"))


def low_stock(inventory: DataFrame) -> DataFrame:
    return (
        inventory.filter(F.col("quantity_on_hand") <= F.col("reorder_level"))
        .select("sku", "product_name", "quantity_on_hand", "reorder_level")
        .orderBy("quantity_on_hand", "sku")
    )


def top_customers(orders: DataFrame, customers: DataFrame, k: int, completed_only: bool = False) -> DataFrame:
    if completed_only:
        orders = orders.filter(status_is("delivered"))
    spent = orders.groupBy("customer_id").agg(F.round(money_sum("total_amount"), 2).alias("total_spent"))
    return (
        spent.join(customers.select("customer_id", "name"), "customer_id")
        .select("customer_id", "name", "total_spent")
        .orderBy(F.desc("total_spent"), "customer_id").limit(k)
    )


def delays_by_carrier(shipments: DataFrame) -> DataFrame:
    return (
        shipments.filter(F.col("delay_days") > 0).groupBy("carrier")
        .agg(F.count(F.lit(1)).alias("delay_count"), stable_round(F.avg("delay_days"), 1).alias("avg_delay"))
        .orderBy(F.desc("delay_count"), "carrier")
    )


def late_rate_by_carrier(shipments: DataFrame) -> DataFrame:
    late = F.count(F.when(status_is("delayed"), 1))
    return shipments.groupBy("carrier").agg(
        F.count(F.lit(1)).alias("shipments"), late.alias("late"),
        percent(late, F.count(F.lit(1))).alias("late_pct"))


def ticket_breach_rate(tickets: DataFrame) -> DataFrame:
    breached = F.count(F.when(lowered("sla_status") == "breached", 1))
    return tickets.agg(
        F.count(F.lit(1)).alias("total_tickets"), breached.alias("breached_count"),
        percent(breached, F.count(F.lit(1))).alias("breach_rate"))


def tickets_past_deadline(tickets: DataFrame, as_of: str) -> DataFrame:
    """Unresolved high and critical tickets past their deadline."""
    return tickets.filter(
        ~status_is("resolved") & F.col("priority").isin("High", "Critical")
        & (F.col("sla_deadline") < as_of_literal(as_of))
    ).select("ticket_id", "customer_id", "priority", "status")


def satisfaction_by_priority(tickets: DataFrame) -> DataFrame:
    return (
        tickets.filter(F.col("satisfaction_score").isNotNull()).groupBy("priority")
        .agg(stable_round(F.avg("satisfaction_score"), 2).alias("avg_csat")).orderBy("avg_csat", "priority")
    )


def orders_by_shipping_method(orders: DataFrame) -> DataFrame:
    return (
        orders.groupBy("shipping_method")
        .agg(F.count(F.lit(1)).alias("order_count"), F.round(money_sum("total_amount"), 2).alias("total_val"))
        .orderBy(F.desc("order_count"), "shipping_method")
    )


def delivery_by_shipping_method(orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """Order value and average days from order to ship date of closed shipments."""
    per_order = (
        shipments.filter(F.col("actual_delivery").isNotNull()).groupBy("order_id")
        .agg(F.count(F.lit(1)).alias("_n"),
             F.sum(F.datediff("actual_delivery", F.lit("1970-01-01").cast("date"))).alias("_days"))
    )
    joined = orders.join(per_order, "order_id", "left")
    since_epoch = F.datediff("order_date", F.lit("1970-01-01").cast("date"))
    return joined.groupBy("shipping_method").agg(
        stable_round(money_avg("total_amount"), 2).alias("avg_order_value"),
        F.sum("_n").alias("closed_shipments"),
        stable_round(F.sum(F.col("_days") - F.col("_n") * since_epoch) / F.sum("_n"), 2).alias("avg_days"),
    )


def busiest_employees(employees: DataFrame, k: int = 5) -> DataFrame:
    return (
        employees.select("department", "name", "active_tasks")
        .orderBy(F.desc("active_tasks"), "name").limit(k)
    )


def employee_workload(employees: DataFrame, order_lines: DataFrame, k: int | None = None) -> DataFrame:
    """Tasks and distinct orders handled per employee (lines carry ``employee_id``)."""
    handled = order_lines.groupBy("employee_id").agg(F.count_distinct("order_id").alias("orders_handled"))
    joined = employees.join(handled, "employee_id", "left").select(
        "employee_id", "department", "active_tasks", "resolved_tasks",
        F.coalesce("orders_handled", F.lit(0)).alias("orders_handled"))
    return joined.orderBy(F.desc("orders_handled"), "employee_id").limit(k) if k else joined


def valuation_by_warehouse(inventory: DataFrame) -> DataFrame:
    value = (F.col("quantity_on_hand") * F.col("unit_cost")).cast("decimal(18,2)")
    return (
        inventory.groupBy("warehouse_location").agg(F.round(F.sum(value).cast("double"), 2).alias("total_valuation"))
        .orderBy(F.desc("total_valuation"), "warehouse_location")
    )


def valuation_with_total(inventory: DataFrame) -> DataFrame:
    value = (F.col("quantity_on_hand") * F.col("unit_cost")).cast("decimal(18,2)")
    return inventory.rollup("warehouse_location").agg(
        F.round(F.sum(value).cast("double"), 2).alias("total_valuation"),
        F.grouping("warehouse_location").cast("int").alias("is_total"),
    )


def customers_on_hold(customers: DataFrame) -> DataFrame:
    return customers.filter(status_is("credit_hold")).select("customer_id", "name", "credit_limit", "status")


def customers_over_limit(customers: DataFrame, invoices: DataFrame) -> DataFrame:
    """Customers whose open balance exceeds their credit limit."""
    open_balance = (
        invoices.filter(~lowered("status").isin("paid", "settled", "void"))
        .groupBy("customer_id").agg(money_sum("unpaid_amount").alias("open_balance"))
    )
    return (
        customers.join(open_balance, "customer_id")
        .filter(F.col("open_balance") > F.col("credit_limit"))
        .select("customer_id", "name", "credit_limit", "open_balance")
    )


def average_order_value(orders: DataFrame) -> DataFrame:
    return orders.agg(stable_round(money_avg("total_amount"), 2).alias("aov"), F.count(F.lit(1)).alias("total_orders"))


def monthly_order_value(orders: DataFrame) -> DataFrame:
    return (
        orders.filter(status_is("delivered")).groupBy(F.date_format("order_date", "yyyy-MM").alias("month"))
        .agg(stable_round(money_avg("total_amount"), 2).alias("aov"), F.count(F.lit(1)).alias("total_orders"))
        .orderBy("month")
    )


def payments_by_method(payments: DataFrame) -> DataFrame:
    return (
        payments.groupBy("payment_method")
        .agg(F.count(F.lit(1)).alias("pmt_count"), F.round(money_sum("amount"), 2).alias("total_collected"))
        .orderBy(F.desc("total_collected"), "payment_method")
    )


def multi_line_orders(items: DataFrame, more_than: int = 2, k: int | None = None) -> DataFrame:
    counts = (
        items.groupBy("order_id").agg(F.count(F.lit(1)).alias("item_count"))
        .filter(F.col("item_count") > more_than)
    )
    return counts.orderBy("order_id").limit(k) if k else counts


def customers_by_tier(customers: DataFrame) -> DataFrame:
    return (
        customers.groupBy("tier")
        .agg(F.count(F.lit(1)).alias("cust_count"), stable_round(money_avg("credit_limit"), 2).alias("avg_limit"))
        .orderBy(F.desc("cust_count"), "tier")
    )


def margin_by_tier(customers: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue, cost and margin per customer tier.

    Lines get their product's unit cost and are summed per order; the rest of the joins run on per-order sums.
    """
    cost = F.col("quantity").cast("decimal(14,2)") * F.col("unit_cost").cast("decimal(14,2)")
    with_cost = items.select("order_id", "product_id", "line_total", "quantity").join(products.select("product_id", "unit_cost"), "product_id").groupBy(
        "order_id").agg(F.sum(money("line_total")).alias("_revenue"), F.sum(cost.cast("decimal(28,4)")).alias("_cost"))
    per_customer = with_cost.join(orders.select("order_id", "customer_id"), "order_id").groupBy("customer_id").agg(
        F.sum("_revenue").alias("_revenue"), F.sum("_cost").alias("_cost"))
    return per_customer.join(customers.select("customer_id", "tier"), "customer_id").groupBy("tier").agg(
        F.round(F.sum("_revenue").cast("double"), 2).alias("revenue"),
        F.round(F.sum("_cost").cast("double"), 2).alias("cost"),
    ).withColumn("margin_pct", percent(F.col("revenue") - F.col("cost"), F.col("revenue")))


def distinct_products(items: DataFrame) -> DataFrame:
    return items.agg(F.count_distinct("product_id").alias("unique_prods"))


def rolling_distinct_products(items: DataFrame, orders: DataFrame, days: int = 30) -> DataFrame:
    """Distinct products ordered in the ``days`` days up to each order day.

    A product counts on day d when its latest order up to d is at most days-1 old.
    Per product, each (product, order day) opens the interval [day, end], cut short
    by the product's next order day, so every covered day is counted exactly once.
    The intervals become +1/-1 steps whose running sum is the answer: the work is one
    row per (product, order day), not one per product and covered day.
    """
    from pyspark.sql import Window

    day = F.to_date("order_date").alias("day")
    active = (
        items.select("order_id", "product_id").join(orders.select("order_id", day), "order_id")
        .select("product_id", "day").distinct()
    )
    # at most one row per calendar day and product
    following = F.lead("day").over(Window.partitionBy("product_id").orderBy("day"))
    spans = active.select(
        "day", F.least(F.date_add("day", days), F.coalesce(following, F.date_add("day", days))).alias("end"))
    steps = spans.select(F.inline(F.array(
        F.struct(F.col("day").alias("day"), F.lit(1).alias("step")),
        F.struct(F.col("end").alias("day"), F.lit(-1).alias("step")))))
    daily = steps.groupBy("day").agg(F.sum("step").alias("step"))
    # one row per calendar day: bounded by the calendar, not by the data
    running = daily.withColumn("unique_products", F.sum("step").over(
        Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    order_days = orders.join(items.select("order_id"), "order_id", "left_semi").select(day).distinct()
    return running.join(order_days, "day", "left_semi").select("day", "unique_products")


def unresolved_critical(tickets: DataFrame) -> DataFrame:
    return tickets.filter((F.col("priority") == "Critical") & (F.col("status") != "Resolved")).select(
        "ticket_id", "subject", "priority", "status", "sla_status")


def highest_priced(products: DataFrame, k: int = 3) -> DataFrame:
    return products.select("product_id", "name", "unit_price").orderBy(F.desc("unit_price"), "product_id").limit(k)


def widest_margin(products: DataFrame, k: int = 10) -> DataFrame:
    spread = F.round(F.col("unit_price") - F.col("unit_cost"), 2)
    return (
        products.select("product_id", "name", spread.alias("margin_spread"))
        .orderBy(F.desc("margin_spread"), "product_id").limit(k)
    )


def shipments_by_status(shipments: DataFrame) -> DataFrame:
    return shipments.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def on_time_rate(shipments: DataFrame, target_pct: float = 95.0) -> DataFrame:
    closed = F.count(F.when(F.col("status").isin("Delivered", "Delayed"), 1))
    on_time = F.count(F.when(F.col("status") == "Delivered", 1))
    rated = shipments.agg(closed.alias("closed"), on_time.alias("on_time"), percent(on_time, closed).alias("on_time_pct"))
    return rated.withColumns({
        "target_pct": F.lit(target_pct), "meets_target": F.col("on_time_pct") >= target_pct})


def orders_and_overdue_by_customer(customers: DataFrame, orders: DataFrame, invoices: DataFrame, k: int = 5) -> DataFrame:
    """Per customer: orders and overdue invoices; only customers that have both."""
    order_counts = orders.groupBy("customer_id").agg(F.count_distinct("order_id").alias("total_orders"))
    overdue = (
        invoices.filter(status_is("overdue")).groupBy("customer_id")
        .agg(F.count_distinct("invoice_id").alias("overdue_invoices"))
    )
    return (
        customers.select("customer_id", "name").join(order_counts, "customer_id").join(overdue, "customer_id")
        .orderBy(F.desc("overdue_invoices"), "customer_id").limit(k)
    )


def invoice_discrepancies(orders: DataFrame, invoices: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Orders whose invoiced amount differs from the order total, or that miss one side."""
    billed = invoices.groupBy("order_id").agg(money_sum("amount").alias("invoiced"))
    ordered = orders.select("order_id", "total_amount")
    both = ordered.join(billed, "order_id", "full_outer")
    difference = F.abs(F.coalesce("total_amount", F.lit(0.0)) - F.coalesce("invoiced", F.lit(0.0)))
    return both.filter(difference > tolerance).select(
        "order_id", "total_amount", "invoiced", F.round(difference, 2).alias("difference"))

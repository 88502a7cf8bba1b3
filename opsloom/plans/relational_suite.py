"""The relational surface reachable through guarded SQL, one query per feature."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.functions.columns import as_of_literal, money_sum
from opsloom.operators.joins import anti_join_keys, as_of_join, case_insensitive_join, interval_join, range_join
from opsloom.operators.ordering import rolling_rows, row_numbers
from opsloom.operators.safe_sql import execute_safe_query
from opsloom.plans.registry import query
from opsloom.sources import tables
from opsloom.sources.files import mask_connection_uri

AS_OF = "1998-07-01 00:00:00"


def _guarded(v, sql, *names, max_rows=None):
    for name in names:
        v.table(name).createOrReplaceTempView(f"wh_{name}")
    return execute_safe_query(v.spark, sql, [f"wh_{n}" for n in names], max_rows).rows


@query("sql_row_cap", "SELECT order_id, total_amount FROM v_orders ORDER BY total_amount DESC, order_id LIMIT 500")
def _(v):
    return _guarded(v, "SELECT order_id, total_amount FROM wh_orders ORDER BY total_amount DESC, order_id LIMIT 9000", "orders", max_rows=500)


@query("sql_guarded_join", """
    SELECT p.category, round(sum(oi.quantity), 2) AS quantity, count(*) AS order_lines
    FROM v_order_items oi JOIN v_products p ON oi.product_id = p.product_id GROUP BY p.category""")
def _(v):
    return _guarded(v, """SELECT p.category, ROUND(SUM(oi.quantity), 2) AS quantity, COUNT(*) AS order_lines
        FROM wh_order_items oi JOIN wh_products p ON oi.product_id = p.product_id
        GROUP BY p.category ORDER BY quantity DESC""", "order_items", "products")


@query("sql_cte_scalar_subquery", """
    SELECT customer_id, round(total, 2) AS total FROM (SELECT customer_id, CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE)
      AS total FROM v_orders GROUP BY 1) WHERE total > (SELECT max(total_amount) FROM v_orders) * 7""")
def _(v):
    return _guarded(v, """WITH spent AS (SELECT customer_id, CAST(SUM(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM wh_orders GROUP BY customer_id)
        SELECT customer_id, ROUND(total, 2) AS total FROM spent
        WHERE total > (SELECT MAX(total_amount) FROM wh_orders) * 7 ORDER BY total DESC, customer_id""", "orders")


@query("sql_nan_to_null", """
    SELECT doc_id, CASE WHEN n_chars % 10 < 2 THEN NULL ELSE CAST(n_chars AS DOUBLE) END AS size FROM documents""")
def _(v):
    n = F.col("n_chars")
    raw = v.raw("documents").select("doc_id", F.when(n % 10 == 0, F.lit(float("nan"))).when(
        n % 10 == 1, F.lit(float("inf"))).otherwise(n.cast("double")).alias("size"))
    return tables.nan_to_null(raw)


@query("source_bound_parameters", """
    SELECT order_id, status, total_amount FROM v_orders WHERE lower(status) = 'delayed' AND total_amount > 400000""")
def _(v):
    v.orders.createOrReplaceTempView("wh_orders")
    return tables.query_table(v.spark, "SELECT order_id, status, total_amount FROM wh_orders "
                              "WHERE lower(status) = lower(:status) AND total_amount > :floor",
                              {"status": "DELAYED", "floor": 400000})


@query("source_mask_credentials", """
    SELECT page_id, regexp_replace(replace(url, '://', '://user' || page_id || ':p@ss@'),
        '^([^:]+://[^:@]+)(:.*)?@', '\\1:********@') AS uri FROM pages""")
def _(v):
    secret = F.concat(F.lit("://user"), F.col("page_id").cast("string"), F.lit(":p@ss@"))
    uri = F.replace(F.col("url"), F.lit("://"), secret)
    return v.raw("pages").select("page_id", mask_connection_uri(uri).alias("uri"))


@query("source_refresh_diff", """
    SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS previous_rows, (SELECT count(*) FROM orders) AS current_rows,
           (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS row_diff""")
def _(v):
    return tables.refresh_summary(v.raw("orders").filter(F.col("o_orderstatus") == "F"), v.raw("orders"))


@query("source_list_filter", "SELECT doc_id, lang, source FROM documents WHERE source = 'src1'")
def _(v):
    listed = v.raw("documents").select("doc_id", "lang", F.col("source").alias("workspace_id"))
    return tables.list_sources(listed, "src1").withColumnRenamed("workspace_id", "source")


@query("rel_projection_arithmetic", """
    SELECT sku, quantity_on_hand * unit_cost AS stock_value, quantity_on_hand - safety_stock AS spare FROM v_inventory""")
def _(v):
    return v.inventory.select("sku", (F.col("quantity_on_hand") * F.col("unit_cost")).alias("stock_value"),
                              (F.col("quantity_on_hand") - F.col("safety_stock")).alias("spare"))


@query("rel_filter", """
    SELECT order_id, line_no, status FROM v_shipments WHERE actual_delivery IS NOT NULL AND actual_delivery > estimated_delivery
      AND (lower(status) = 'delayed' OR delay_days > 365)""")
def _(v):
    return v.shipments.filter(
        F.col("actual_delivery").isNotNull() & (F.col("actual_delivery") > F.col("estimated_delivery"))
        & ((F.lower("status") == "delayed") | (F.col("delay_days") > 365))).select("order_id", "line_no", "status")


@query("rel_like_ignore_case", "SELECT product_id, name FROM v_products WHERE name ILIKE '%RING%'")
def _(v):
    return v.products.filter(F.col("name").ilike("%RING%")).select("product_id", "name")


@query("rel_case_when", """
    SELECT customer_id, CASE WHEN credit_limit < 0 THEN 'hold' WHEN credit_limit < 5000 THEN 'standard' ELSE 'high' END AS band
    FROM v_customers""")
def _(v):
    return v.customers.select("customer_id", F.when(F.col("credit_limit") < 0, "hold").when(
        F.col("credit_limit") < 5000, "standard").otherwise("high").alias("band"))


@query("rel_coalesce", """
    SELECT order_id, line_no, coalesce(strftime(actual_delivery, '%Y-%m-%d'), 'open') AS delivered FROM v_shipments""")
def _(v):
    return v.shipments.select("order_id", "line_no", F.coalesce(
        F.date_format("actual_delivery", "yyyy-MM-dd"), F.lit("open")).alias("delivered"))


@query("rel_inner_join", """
    SELECT o.order_id, c.name, c.city FROM v_orders o JOIN v_customers c ON o.customer_id = c.customer_id""")
def _(v):
    return v.orders.join(v.customers, "customer_id").select("order_id", "name", "city")


@query("rel_three_way_join", """
    SELECT c.customer_id, count(DISTINCT o.order_id) AS orders, count(DISTINCT i.invoice_id) AS overdue
    FROM v_customers c JOIN v_orders o ON c.customer_id = o.customer_id
    JOIN v_invoices i ON c.customer_id = i.customer_id AND lower(i.status) = 'overdue' GROUP BY 1""")
def _(v):
    # both sides are counted per customer first: the fan-out of the plain 3-way join never exists
    orders = v.orders.groupBy("customer_id").agg(F.count_distinct("order_id").alias("orders"))
    overdue = v.invoices.filter(F.lower("status") == "overdue").groupBy("customer_id").agg(
        F.count_distinct("invoice_id").alias("overdue"))
    return v.customers.select("customer_id").join(orders, "customer_id").join(overdue, "customer_id")


@query("rel_left_join", """
    SELECT p.product_id, coalesce(n, 0) AS times_ordered
    FROM v_products p LEFT JOIN (SELECT product_id, count(*) AS n FROM v_order_items GROUP BY 1) i ON i.product_id = p.product_id""")
def _(v):
    ordered = v.order_items.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    return v.products.join(ordered, "product_id", "left").select(
        "product_id", F.coalesce("n", F.lit(0)).alias("times_ordered"))


@query("rel_not_in", """
    SELECT customer_id, name FROM v_customers WHERE customer_id NOT IN (SELECT customer_id FROM v_orders
      WHERE status = 'Delayed' AND customer_id IS NOT NULL)""")
def _(v):
    delayed = v.orders.filter(F.col("status") == "Delayed")
    return anti_join_keys(v.customers, "customer_id", delayed, "customer_id").select("customer_id", "name")


@query("rel_case_insensitive_join", """
    SELECT o.order_id, c.city FROM v_orders o JOIN v_customers c ON lower('cust-' || o.customer_id) = lower('CUST-' || c.customer_id)""")
def _(v):
    def code(prefix):
        return F.concat(F.lit(prefix), F.col("customer_id").cast("string"))
    left = v.orders.withColumn("customer_code", code("cust-"))
    right = v.customers.withColumn("customer_code", code("CUST-")).select("customer_code", "city")
    return case_insensitive_join(left, right, "customer_code").select("order_id", "city")


@query("rel_semi_join", """
    SELECT customer_id, name FROM v_customers c WHERE EXISTS (SELECT 1 FROM v_orders o WHERE o.customer_id = c.customer_id
      AND o.status IN ('Delayed', 'Processing') AND o.total_amount > 450000)""")
def _(v):
    big = v.orders.filter(F.col("status").isin("Delayed", "Processing") & (F.col("total_amount") > 450000))
    return v.customers.join(big, "customer_id", "left_semi").select("customer_id", "name")


@query("rel_range_join", """
    WITH quarters AS (SELECT DISTINCT date_trunc('quarter', order_date) AS starts FROM v_orders)
    SELECT strftime(starts, '%Y-%m-%d') AS quarter, count(*) AS orders
    FROM v_orders JOIN quarters ON order_date >= starts AND order_date < starts + INTERVAL 3 MONTH GROUP BY 1""")
def _(v):
    quarters = v.orders.select(F.date_trunc("quarter", "order_date").cast("timestamp_ntz").alias("starts")).distinct() \
        .withColumn("ends", F.col("starts") + F.expr("interval 3 months"))
    joined = interval_join(v.orders.select("order_date"), quarters, "order_date", "starts", "ends")
    return joined.groupBy(F.date_format("starts", "yyyy-MM-dd").alias("quarter")).agg(F.count(F.lit(1)).alias("orders"))


@query("rel_range_join_numbers", """
    SELECT n_name AS band, count(*) AS orders, min(total_amount) AS least, max(total_amount) AS most FROM v_orders
    JOIN nation ON total_amount >= n_nationkey * 20000 AND total_amount < n_nationkey * 20000 + 30000 GROUP BY 1""")
def _(v):
    low = F.col("n_nationkey").cast("double") * 20000
    bands = v.raw("nation").select(F.col("n_name").alias("band"), low.alias("low"), (low + 30000).alias("high"))
    joined = range_join(v.orders.select("order_id", "total_amount"), bands, "total_amount", "low", "high", 25000.0)
    return joined.groupBy("band").agg(F.count(F.lit(1)).alias("orders"), F.min("total_amount").alias("least"), F.max("total_amount").alias("most"))


# Ranges around orders' amounts, with lengths over four decades.
_SPANS = "SELECT o_orderkey AS span_id, o_totalprice AS low, o_totalprice + power(10, o_orderkey % 5) * (1 + o_orderkey % 7) / 10 AS high FROM orders WHERE o_orderstatus = 'F'"


@query("rel_range_join_mixed_lengths", f"""
    SELECT CAST(span_id % 5 AS INTEGER) AS decade, count(*) AS pairs, count(DISTINCT span_id) AS spans, CAST(sum(o_orderkey % 1000) AS BIGINT) AS digest
    FROM ({_SPANS}) JOIN orders ON o_totalprice >= low AND o_totalprice < high GROUP BY 1""")
def _(v):
    key = F.col("o_orderkey")
    length = F.pow(F.lit(10.0), key % 5) * (1 + key % 7) / 10
    spans = v.raw("orders").filter("o_orderstatus = 'F'").select(key.alias("span_id"), F.col("o_totalprice").alias("low"), (F.col("o_totalprice") + length).alias("high"))
    # the pairs grow as the square of the orders, their sums by span do not
    matched = range_join(v.raw("orders").select("o_orderkey", "o_totalprice"), spans, "o_totalprice", "low", "high",
                         totals={"pairs": F.lit(1).cast("long"), "digest": key % 1000})
    return matched.groupBy((F.col("span_id") % 5).cast("int").alias("decade")).agg(
        F.sum("pairs").alias("pairs"), F.count_distinct("span_id").alias("spans"), F.sum("digest").alias("digest"))


# Orders moved to the month of the events, so that both lie in one time.
_MOVED = "TIMESTAMP '2024-01-01' + to_days(CAST(date_diff('day', DATE '1995-01-01', o_orderdate) % 30 AS INTEGER))"


def _moved():
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) % 30
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days)


@query("rel_as_of_join", f"""
    SELECT o.o_orderkey AS order_id, e.event_id, e.event_type FROM (SELECT *, {_MOVED} AS at FROM orders) o
    ASOF LEFT JOIN events e ON o.o_custkey = e.user_id AND o.at >= e.ts""")
def _(v):
    """The last event of each order's customer before the order."""
    orders = v.raw("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
                                    _moved().alias("at"))
    events = v.raw("events").select("user_id", "ts", "event_id", "event_type")
    return as_of_join(orders, events, ["user_id"], "at", "ts", ["event_id"]).select("order_id", "event_id", "event_type")


@query("rel_as_of_join_within", f"""
    SELECT o.o_orderkey AS order_id, CASE WHEN e.ts >= o.at - INTERVAL 2 DAY THEN e.event_id END AS event_id FROM (SELECT *, {_MOVED} AS at FROM orders) o
    ASOF LEFT JOIN events e ON o.o_custkey % 10 = e.user_id % 10 AND o.at >= e.ts""")
def _(v):
    """The same by ten hot keys, at most two days back."""
    orders = v.raw("orders").select(F.col("o_orderkey").alias("order_id"), (F.col("o_custkey") % 10).alias("group"),
                                    _moved().alias("at"))
    events = v.raw("events").select((F.col("user_id") % 10).alias("group"), "ts", "event_id")
    return as_of_join(orders, events, ["group"], "at", "ts", ["event_id"], within="2 days").select("order_id", "event_id")


@query("rel_group_by", """
    SELECT status, shipping_method, count(*) AS n, count(DISTINCT customer_id) AS customers,
      CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS total, min(total_amount) AS low, max(total_amount) AS high
    FROM v_orders GROUP BY 1, 2""")
def _(v):
    return v.orders.groupBy("status", "shipping_method").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("customer_id").alias("customers"),
        money_sum("total_amount").alias("total"), F.min("total_amount").alias("low"), F.max("total_amount").alias("high"))


@query("rel_having", """
    SELECT customer_id, count(*) AS n FROM v_orders GROUP BY customer_id HAVING count(*) >= 12""")
def _(v):
    return v.orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 12)


@query("rel_global_aggregate", """
    SELECT count(*) AS n, CAST(sum(CAST(line_total AS DECIMAL(18,2))) AS DOUBLE) AS total, max(quantity) AS most FROM v_order_items""")
def _(v):
    return v.order_items.agg(F.count(F.lit(1)).alias("n"), money_sum("line_total").alias("total"),
                             F.max("quantity").alias("most"))


@query("rel_top_k", "SELECT order_id, total_amount FROM v_orders ORDER BY total_amount DESC, order_id LIMIT 25")
def _(v):
    return v.orders.select("order_id", "total_amount").orderBy(F.desc("total_amount"), "order_id").limit(25)


@query("rel_distinct", "SELECT DISTINCT status, shipping_method FROM v_orders")
def _(v):
    return v.orders.select("status", "shipping_method").distinct()


@query("rel_union", """
    SELECT customer_id FROM v_orders WHERE status = 'Delayed' UNION SELECT customer_id FROM v_support_tickets WHERE priority = 'Critical'""")
def _(v):
    return v.orders.filter(F.col("status") == "Delayed").select("customer_id").unionByName(
        v.support_tickets.filter(F.col("priority") == "Critical").select("customer_id")).distinct()


@query("rel_union_all", """
    SELECT 'order' AS kind, status, count(*) AS n FROM v_orders GROUP BY 2
    UNION ALL SELECT 'invoice', status, count(*) FROM v_invoices GROUP BY 2""")
def _(v):
    def counted(df, kind):
        return df.groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "status", "n")
    return counted(v.orders, "order").unionByName(counted(v.invoices, "invoice"))


@query("rel_intersect", """
    SELECT customer_id FROM v_orders WHERE status = 'Delayed' INTERSECT SELECT customer_id FROM v_orders WHERE status = 'Delivered'""")
def _(v):
    return v.orders.filter(F.col("status") == "Delayed").select("customer_id").intersect(
        v.orders.filter(F.col("status") == "Delivered").select("customer_id"))


@query("rel_except", """
    SELECT product_id FROM v_products EXCEPT SELECT product_id FROM v_order_items WHERE quantity >= 49""")
def _(v):
    return v.products.select("product_id").subtract(
        v.order_items.filter(F.col("quantity") >= 49).select("product_id"))


@query("rel_window_rank_lag", """
    SELECT customer_id, order_id, rank() OVER w AS spend_rank, lag(total_amount) OVER w AS next_higher
    FROM v_orders WINDOW w AS (PARTITION BY customer_id ORDER BY total_amount DESC, order_id)""")
def _(v):
    # no window over a whole customer: positions and short frames come from a range-partitioned sort
    spend = v.orders.select("customer_id", "order_id", "total_amount", (-F.col("total_amount")).alias("_desc"))
    ranked = row_numbers(spend, ["customer_id"], ["_desc", "order_id"], "spend_rank")
    return rolling_rows(ranked, ["customer_id"], ["_desc", "order_id"], 1,
                        lambda w: {"next_higher": F.lag("total_amount").over(w)}).select(
        "customer_id", "order_id", "spend_rank", "next_higher")


@query("rel_as_of_date", f"""
    SELECT invoice_id, unpaid_amount FROM v_invoices WHERE due_date < TIMESTAMP '{AS_OF}' AND lower(status) <> 'paid'""")
def _(v):
    return v.invoices.filter((F.col("due_date") < as_of_literal(AS_OF)) & (F.lower("status") != "paid")).select(
        "invoice_id", "unpaid_amount")

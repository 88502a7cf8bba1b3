"""Analytics operators as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import analytics as an
from opsloom.plans.registry import query


@query("analytics_group_by", """
    SELECT status, shipping_method, CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_amount_sum,
      min(total_amount) AS total_amount_min, max(total_amount) AS total_amount_max, count(total_amount) AS total_amount_count,
      round(avg(total_amount), 2) AS total_amount_mean, round(stddev_samp(total_amount), 2) AS total_amount_std,
      round(quantile_cont(total_amount, 0.5), 3) AS total_amount_median, count(DISTINCT customer_id) AS customer_id_nunique,
      arg_min(customer_id, order_id) AS customer_id_first, arg_max(customer_id, order_id) AS customer_id_last
    FROM v_orders WHERE status IS NOT NULL AND shipping_method IS NOT NULL GROUP BY 1, 2""")
def _(v):
    grouped = an.group_by_analysis(v.orders, ["status", "shipping_method"], {
        "total_amount": ["sum", "min", "max", "count", "mean", "std", "median"],
        "customer_id": ["nunique", "first", "last"]}, order_by=["order_id"])
    digits = {"total_amount_sum": 2, "total_amount_mean": 2, "total_amount_std": 2, "total_amount_median": 3}
    return grouped.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("analytics_group_median", """
    SELECT customer_id, round(quantile_cont(total_amount, 0.5), 4) AS total_amount_median FROM v_orders GROUP BY 1""")
def _(v):
    medians = an.group_by_analysis(v.orders, ["customer_id"], {"total_amount": ["median"]})
    return medians.withColumn("total_amount_median", F.round("total_amount_median", 4))


@query("analytics_pivot", """
    SELECT status, coalesce(round(sum(total_amount) FILTER (shipping_method = 'Ground Freight'), 2), 0) AS "Ground Freight",
      coalesce(round(sum(total_amount) FILTER (shipping_method = 'Expedited Air'), 2), 0) AS "Expedited Air"
    FROM v_orders GROUP BY 1""")
def _(v):
    pivoted = an.pivot_analysis(v.orders, "status", "shipping_method", "total_amount")
    return pivoted.select("status", *[F.round(f"`{c}`", 2).alias(c) for c in pivoted.columns[1:]])


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("analytics_correlation", " UNION ALL ".join(
    f"SELECT '{a}' AS metric, " + ", ".join(f"round(corr({a}, {b}), 3) AS {b}" for b in _CORR) + " FROM lineitem" for a in _CORR))
def _(v):
    return an.correlation_matrix(v.raw("lineitem"), _CORR)


@query("analytics_rolling_average", """
    SELECT order_id, strftime(order_date, '%Y-%m-%d') AS order_date, total_amount,
      round(avg(total_amount) OVER (ORDER BY order_date, order_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 2) AS total_amount_rolling_avg_7
    FROM v_orders""")
def _(v):
    return an.rolling_average(v.orders, "order_date", "total_amount", 7, order_by=["order_id"])


@query("analytics_rolling_by_group", """
    SELECT user_id, event_id, strftime(ts, '%Y-%m-%d') AS ts, cents,
      round(avg(cents) OVER (PARTITION BY user_id ORDER BY e.ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 2)
        AS cents_rolling_avg_7
    FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events) e""")
def _(v):
    events = v.raw("events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return an.rolling_average(events, "ts", "cents", 7, order_by=["event_id"], partition_cols=["user_id"])


def _resample_sql(label: str, calendar: str, agg: str, empty: str) -> str:
    return f"""
    WITH p AS (SELECT CAST({label} AS DATE) AS p, {agg} AS val FROM v_orders GROUP BY 1),
    cal AS (SELECT CAST({calendar} AS DATE) AS p FROM (SELECT min(p) AS a, max(p) AS b FROM p)),
    f AS (SELECT cal.p, round(coalesce(val, {empty}), 2) AS val FROM cal LEFT JOIN p ON p.p = cal.p),
    c AS (SELECT p, val, last_value(val IGNORE NULLS) OVER (ORDER BY p) AS carried FROM f),
    l AS (SELECT p, val, carried, lag(carried) OVER (ORDER BY p) AS prev FROM c)
    SELECT strftime(p, '%Y-%m-%d') AS order_date, coalesce(val, 0) AS total_amount,
      CASE WHEN prev IS NULL THEN 0 WHEN prev = 0 THEN NULL
           ELSE round(round((carried - prev) / prev, 4) * 100, 4) END AS pct_change FROM l"""


_SUM = "CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE)"
_SUNDAY = "date_trunc('week', order_date) + INTERVAL 6 DAY"


@query("analytics_resample_daily", _resample_sql("order_date", "unnest(generate_series(a, b, INTERVAL 1 DAY))", _SUM, "0"))
def _(v):
    return an.resample(v.orders.withColumn("total_amount", F.col("total_amount").cast("decimal(18,2)")),
                       "order_date", "total_amount", "D", "sum")


@query("analytics_resample_weekly", _resample_sql(_SUNDAY, "unnest(generate_series(a, b, INTERVAL 7 DAY))", "max(total_amount)", "NULL"))
def _(v):
    return an.resample(v.orders, "order_date", "total_amount", "W", "max")


@query("analytics_resample_monthly", _resample_sql(
    "last_day(order_date)", "last_day(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)))",
    "CAST(count(total_amount) AS DOUBLE)", "0"))
def _(v):
    return an.resample(v.orders, "order_date", "total_amount", "M", "count")


@query("analytics_series_stats", """
    WITH m AS (SELECT last_day(order_date) AS p, count(*) AS n FROM v_orders GROUP BY 1)
    SELECT date_diff('month', min(p), max(p)) + 1 AS total_periods, CAST(arg_max(n, p) AS DOUBLE) AS latest_value,
      'M' AS frequency, 'count' AS agg_func FROM m""")
def _(v):
    monthly = an.resample(v.orders, "order_date", "total_amount", "M", "count")
    return an.time_series_stats(monthly, "order_date", "total_amount", "M", "count")


@query("analytics_group_stats", """
    SELECT count(DISTINCT customer_id) AS groups_count, 'customer_id' AS grouped_by FROM v_orders""")
def _(v):
    return an.group_stats(an.group_by_analysis(v.orders, ["customer_id"], {"total_amount": ["count"]}), ["customer_id"])


_SOLD = """(SELECT c.tier, p.category, date_trunc('year', o.order_date) AS year, CAST(i.line_total AS DECIMAL(18,2)) AS total, o.customer_id
    FROM v_order_items i JOIN v_orders o ON o.order_id = i.order_id JOIN v_customers c ON c.customer_id = o.customer_id
    JOIN v_products p ON p.product_id = i.product_id)"""


def _sold(v):
    items = v.order_items.select("order_id", "product_id", "line_total").join(v.orders.select("order_id", "customer_id", "order_date"), "order_id")
    found = items.join(v.customers.select("customer_id", "tier"), "customer_id").join(v.products.select("product_id", "category"), "product_id")
    return found.select("tier", "category", F.year("order_date").alias("year"), F.col("line_total").cast("decimal(18,2)").alias("total"), "customer_id")


_TOTALS = "CAST(sum(total) AS DOUBLE) AS revenue, count(*) AS lines, count(DISTINCT customer_id) AS customers"


@query("analytics_cube_totals", f"""
    SELECT tier, category, CAST(extract('year' FROM year) AS INTEGER) AS year, CAST(grouping(tier, category, year) AS INTEGER) AS level, {_TOTALS}
    FROM {_SOLD} GROUP BY CUBE (tier, category, year)""")
def _(v):
    """Revenue by tier, category and year with all subtotals."""
    return an.subtotals(_sold(v), ["tier", "category", "year"], {
        "revenue": F.sum("total").cast("double"), "lines": F.count(F.lit(1)), "customers": F.count_distinct("customer_id")}, "cube")


@query("analytics_rollup_totals", f"""
    SELECT tier, category, CAST(grouping(tier, category) AS INTEGER) AS level, {_TOTALS} FROM {_SOLD} GROUP BY ROLLUP (tier, category)""")
def _(v):
    return an.subtotals(_sold(v), ["tier", "category"], {
        "revenue": F.sum("total").cast("double"), "lines": F.count(F.lit(1)), "customers": F.count_distinct("customer_id")})


@query("analytics_grouping_sets", f"""
    SELECT tier, category, CAST(grouping(tier, category) AS INTEGER) AS level, {_TOTALS} FROM {_SOLD} GROUP BY GROUPING SETS ((tier), (category), ())""")
def _(v):
    return an.subtotals(_sold(v), ["tier", "category"], {
        "revenue": F.sum("total").cast("double"), "lines": F.count(F.lit(1)), "customers": F.count_distinct("customer_id")},
        [["tier"], ["category"], []])

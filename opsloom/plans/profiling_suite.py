"""Profiling and relationship discovery as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import profile as pr
from opsloom.operators import relationships as rel
from opsloom.plans.registry import query

# columns of the views that the oracle text enumerates
_ORDERS = ["order_id", "customer_id", "order_date", "status", "total_amount", "shipping_method", "payment_terms"]
_DIRTY = ["order_id", "customer_id", "unit_price", "discount_pct", "status", "order_date"]
_CUSTOMERS = ["customer_id", "name", "tier", "credit_limit", "email", "city", "status"]


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


@query("profile_nulls_and_distinct", _union(
    f"""SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count,
        round(CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100, 2) AS null_percentage, count(DISTINCT {c}) AS unique_count
        FROM v_dirty_orders""" for c in _DIRTY))
def _(v):
    return pr.profile_columns(v.dirty_orders, "dirty_orders").select(
        "column_name", "row_count", "null_count", "null_percentage", "unique_count")


@query("profile_sample_values", _union(
    f"""SELECT '{c}' AS column_name, string_agg(x, ' | ' ORDER BY x) AS samples
        FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS x FROM v_orders ORDER BY x LIMIT 5)""" for c in _ORDERS))
def _(v):
    return pr.sample_values(pr.value_counts(v.orders)).select(
        "column_name", F.array_join("sample_values", " | ").alias("samples"))


_ROLES = {"customer_id": "identifier", "name": "text", "tier": "category", "credit_limit": "metric", "email": "sensitive",
          "city": "text", "status": "status"}


@query("profile_keys_and_roles", _union(
    f"""SELECT '{c}' AS column_name, count(*) > 0 AND {str(c == 'email').lower()} AS is_sensitive,
        {f"count(DISTINCT {c}) = count(*)" if c.endswith("_id") else "false"} AS is_primary_key,
        {f"count(DISTINCT {c}) < count(*)" if c.endswith("_id") else "false"} AS is_foreign_key,
        {f"CASE WHEN count(DISTINCT {c}) <= 15 THEN 'category' ELSE 'text' END" if c in ("name", "tier", "city") else f"'{r}'"} AS inferred_role
        FROM v_customers""" for c, r in _ROLES.items()))
def _(v):
    return pr.profile_columns(v.customers, "customers").select(
        "column_name", "is_sensitive", "is_primary_key", "is_foreign_key", "inferred_role")


@query("profile_foreign_keys", _union(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) = count(*) AS is_primary_key, count(DISTINCT {c}) < count(*) AS is_foreign_key "
    f"FROM v_orders" for c in ("order_id", "customer_id")))
def _(v):
    return pr.profile_columns(v.orders, "orders").filter(F.col("column_name").endswith("_id")).select(
        "column_name", "is_primary_key", "is_foreign_key")


@query("profile_numeric_stats", _union(
    f"""SELECT '{c}' AS column_name, min({c}) AS min, max({c}) AS max, round(avg({c}), 2) AS mean,
        round(quantile_cont({c}, 0.5), 2) AS median, round(stddev_samp({c}), 2) AS std FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def _(v):
    lines = v.raw("lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return pr.profile_columns(lines, "lineitem").select("column_name", "min", "max", "mean", "median", "std")


@query("profile_date_range", _union(
    f"SELECT '{c}' AS column_name, CAST(min({c}) AS VARCHAR) AS min_date, CAST(max({c}) AS VARCHAR) AS max_date FROM v_invoices"
    for c in ("issue_date", "due_date")))
def _(v):
    dates = v.invoices.select("issue_date", "due_date")
    return pr.profile_columns(dates, "invoices").select("column_name", "min_date", "max_date")


@query("profile_top_categories", _union(
    f"""SELECT '{c}' AS column_name, value, n, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS rank
        FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM v_dirty_orders WHERE {c} IS NOT NULL GROUP BY 1)
        QUALIFY rank <= 5""" for c in ("status", "order_date")))
def _(v):
    return pr.top_categories(pr.value_counts(v.dirty_orders, ["status", "order_date"])).withColumnRenamed("_rank", "rank")


def _described(c: str) -> str:
    if c == "email":
        return "'personal data: email'"
    if c == "customer_id":
        return "'the key of customers'"
    if c == "credit_limit":
        return ("'a number from ' || (SELECT CAST(min(credit_limit) AS VARCHAR) || ' to ' || "
                "CAST(max(credit_limit) AS VARCHAR) FROM v_customers)")
    if c in ("tier", "status"):
        return (f"'one of: ' || (SELECT string_agg(x, ', ' ORDER BY n DESC, x) FROM (SELECT {c} AS x, count(*) AS n "
                f"FROM v_customers GROUP BY 1 ORDER BY n DESC, x LIMIT 4))")
    return f"'free text: {c}'"


@query("profile_descriptions", _union(
    f"SELECT '{c}' AS column_name, {_described(c)} AS inferred_description" for c in _CUSTOMERS))
def _(v):
    return pr.profile_columns(v.customers, "customers").select("column_name", "inferred_description")


_ALL_DIRTY = ", ".join(_DIRTY)


@query("profile_table_totals", f"""
    SELECT 'dirty_orders' AS table_name, count(*) AS row_count, 6 AS column_count,
      CAST(sum({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in _DIRTY)}) AS BIGINT) AS missing_cells_total,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT {_ALL_DIRTY} FROM v_dirty_orders)) AS duplicate_rows FROM v_dirty_orders""")
def _(v):
    return pr.profile_table(v.dirty_orders, "dirty_orders")


@query("profile_duplicate_lines", """
    SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT order_id, line_no FROM v_order_items)) AS duplicate_rows FROM v_order_items""")
def _(v):
    return pr.duplicate_rows(v.order_items.select("order_id", "line_no"))


# expected entities follow from the naming rules; the row counts from the data
@query("profile_entity_detection", _union(
    f"SELECT '{t}' AS table_name, '{e}' AS detected_entity, CAST({c} AS DOUBLE) AS entity_confidence, '{r}' AS entity_reason, "
    f"count(*) AS row_count FROM {view}" for t, e, c, r, view in [
        ("customers", "Customers", 0.95, "the name customers says Customers", "v_customers"),
        ("ledger", "Invoices", 0.84, "columns of Invoices: invoice_id, due_date, unpaid_amount", "v_invoices"),
        ("stock_levels", "Products", 0.9, "columns of Products: product_id, product_name, sku", "v_inventory"),
        ("helpdesk", "Tickets", 0.84, "columns of Tickets: ticket_id, sla_deadline, priority", "v_support_tickets"),
        ("misc", "Orders", 0.7, "columns of Orders: order_id", "v_order_items"),
        ("texts", "Operations Data", 0.5, "nothing points to an entity", "documents")]))
def _(v):
    from functools import reduce
    tables = {"customers": v.customers, "ledger": v.invoices, "stock_levels": v.inventory, "helpdesk": v.support_tickets,
              "misc": v.order_items, "texts": v.raw("documents")}
    counts = reduce(lambda a, b: a.unionByName(b), [
        df.agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("row_count")) for t, df in tables.items()])
    return pr.detect_entities(pr.catalog_of(v.spark, tables)).join(counts, "table_name")


_TABLE_COLUMNS = {
    "customers": ("v_customers", ["customer_id"]), "orders": ("v_orders", ["order_id", "customer_id"]),
    "order_items": ("v_order_items", ["order_id", "product_id"]), "dirty_orders": ("v_dirty_orders", ["order_id", "customer_id"]),
    "products": ("v_products", ["product_id"]),
}
_EDGES = [(s, c, t) for s, (_, cs) in _TABLE_COLUMNS.items() for c in cs for t, (_, ct) in _TABLE_COLUMNS.items() if s != t and c in ct]
_REL_SQL = " UNION ALL ".join(f"""
    SELECT '{s}' AS source_table, '{c}' AS source_column, '{t}' AS target_table, '{c}' AS target_column,
      CASE WHEN r >= 0.95 THEN 0.98 WHEN r >= 0.5 THEN round(0.9 * r, 2) ELSE round(0.9 * 0.5, 2) END::DOUBLE AS confidence
    FROM (SELECT CAST(count(*) FILTER (k IN (SELECT {c} FROM {_TABLE_COLUMNS[t][0]} WHERE {c} IS NOT NULL)) AS DOUBLE) / count(*) AS r
      FROM (SELECT DISTINCT {c} AS k FROM {_TABLE_COLUMNS[s][0]} WHERE {c} IS NOT NULL))""" for s, c, t in _EDGES)


def _tables(v):
    return v.as_dict(*_TABLE_COLUMNS)


@query("profile_relationships", f"SELECT *, confidence >= 0.8 AS is_verified FROM ({_REL_SQL})")
def _(v):
    return rel.discover_relationships(v.spark, _tables(v))


# edges known before: those found, with the confidence halved and one edge that is not found any more
@query("profile_relationship_upsert", f"""
    SELECT * FROM (SELECT *, confidence >= 0.8 AND source_table <> 'orders' AS is_verified FROM ({_REL_SQL}))
    UNION ALL SELECT 'old', 'k', 'gone', 'k', 0.5, true""")
def _(v):
    found = rel.discover_relationships(v.spark, _tables(v))
    known = found.filter(F.col("source_table") == "orders").withColumns({
        "confidence": F.col("confidence") / 2, "is_verified": F.lit(False)})
    gone = v.spark.createDataFrame([("old", "k", "gone", "k", 0.5, True)], known.schema)
    return rel.upsert_relationships(known.unionByName(gone), found)


@query("profile_overrides", """
    SELECT 'customers' AS table_name, column_name, CASE column_name WHEN 'city' THEN 'category' ELSE role END AS effective_role,
      column_name IN ('email', 'name') AS effective_sensitive
    FROM (""" + _union(f"SELECT '{c}' AS column_name, " + (
        f"(SELECT CASE WHEN count(DISTINCT {c}) <= 15 THEN 'category' ELSE 'text' END FROM v_customers)"
        if c in ("name", "tier", "city") else f"'{r}'") + " AS role" for c, r in _ROLES.items()) + ")")
def _(v):
    overrides = v.spark.createDataFrame(
        [("customers", "city", "category", None, None), ("customers", "name", None, "Account name", True)],
        "table_name string, column_name string, user_role string, user_description string, user_sensitive boolean")
    return pr.apply_overrides(pr.profile_columns(v.customers, "customers"), overrides).select(
        "table_name", "column_name", "effective_role", "effective_sensitive")


_APPROXIMATED = ("order_id", "customer_id", "status", "order_date", "unit_price")


@query("profile_approximate_counts", _union(
    f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, true AS near FROM v_dirty_orders" for c in _APPROXIMATED))
def _(v):
    """The sketch is random in its errors, so what is compared is that it comes within a tenth of the exact count."""
    df = v.dirty_orders.select(*_APPROXIMATED)
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in _APPROXIMATED])
    exact = exact.select(F.explode(F.create_map(*[x for c in _APPROXIMATED for x in (F.lit(c), F.col(c))])).alias("column_name", "exact"))
    found = pr.approximate_profile(df, "dirty_orders").join(exact, "column_name")
    return found.select("column_name", "row_count", "null_count",
                        (F.abs(F.col("unique_count") - F.col("exact")) <= 0.1 * F.col("exact")).alias("near"))


# Key-like columns of the raw tables: whole numbers, texts and times.
_KEYS = {
    "region": [("r_regionkey", "number"), ("r_name", "text")],
    "nation": [("n_nationkey", "number"), ("n_name", "text"), ("n_regionkey", "number")],
    "supplier": [("s_suppkey", "number"), ("s_name", "text"), ("s_nationkey", "number")],
    "customer": [("c_custkey", "number"), ("c_name", "text"), ("c_nationkey", "number"), ("c_mktsegment", "text")],
    "part": [("p_partkey", "number"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"), ("p_size", "number")],
    "orders": [("o_orderkey", "number"), ("o_custkey", "number"), ("o_orderstatus", "text"), ("o_orderdate", "time"), ("o_orderpriority", "text")],
    "lineitem": [("l_orderkey", "number"), ("l_partkey", "number"), ("l_suppkey", "number"), ("l_linenumber", "number"),
                 ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "time")]}


@query("profile_relationships_by_values", "WITH cells AS (" + _union(
    f"SELECT '{t}' AS tab, '{c}' AS col, '{kind}' AS kind, CAST({c} AS VARCHAR) AS v FROM {t}" for t, columns in _KEYS.items() for c, kind in columns) + """),
    vals AS (SELECT tab, col, kind, v, count(*) AS n FROM cells WHERE v IS NOT NULL GROUP BY ALL),
    sizes AS (SELECT tab, col, count(*) AS d, sum(n) AS r FROM vals GROUP BY ALL),
    hits AS (SELECT s.tab AS st, s.col AS sc, t.tab AS tt, t.col AS tc, count(*) AS overlap FROM vals s
      JOIN vals t ON s.v = t.v AND s.kind = t.kind AND s.tab <> t.tab JOIN sizes u ON u.tab = t.tab AND u.col = t.col AND u.d = u.r GROUP BY ALL)
    SELECT st AS source_table, sc AS source_column, tt AS target_table, tc AS target_column, d AS source_distinct, overlap,
      round(CAST(overlap AS DOUBLE) / d, 4) AS confidence FROM hits JOIN sizes ON tab = st AND col = sc WHERE d >= 2 AND CAST(overlap AS DOUBLE) / d >= 0.95""")
def _(v):
    return rel.discover_by_values(v.spark, {t: v.raw(t) for t in _KEYS})

"""Quality operators as registered queries over orders with planted defects."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import quality as dq
from opsloom.operators import variants as va
from opsloom.plans.registry import VIEW_SQL, query
from opsloom.session import cut_lineage

EDGES = [("dirty_orders", "customer_id", "customers", "customer_id"), ("order_items", "order_id", "dirty_orders", "order_id")]
_COLUMNS = ["order_id", "customer_id", "unit_price", "discount_pct", "status", "order_date"]


def _pct(n: str, total: str = "count(*)") -> str:
    return f"round(CAST({n} AS DOUBLE) / {total} * 100, 2)"


def _samples(value: str, where: str, order: str | None = None) -> str:
    return (f"(SELECT string_agg(x, ' | ' ORDER BY o) FROM (SELECT DISTINCT CAST({value} AS VARCHAR) AS x, {order or value} AS o "
            f"FROM v_dirty_orders WHERE {where} ORDER BY o LIMIT 5))")


def _select(kind, column, severity, count, description, samples="''", table="v_dirty_orders", pct=None) -> str:
    named = f"'{column}'" if column else "CAST(NULL AS VARCHAR)"
    return f"""SELECT 'dirty_orders' AS table_name, {named} AS column_name, '{kind}' AS finding_type, {severity} AS severity,
        {description} AS description, n AS affected_count, pct AS affected_percentage, samples
        FROM (SELECT {count} AS n, {pct or _pct(count)} AS pct, {samples} AS samples FROM {table}) WHERE n > 0"""


_MISSING = [_select("missing_value", c, "CASE WHEN pct > 20 THEN 'WARNING' ELSE 'INFO' END", f"count(*) - count({c})",
                    f"n || ' rows lack {c}, ' || pct || '% of all'") for c in _COLUMNS if c != "order_id"]
_NULL_PK = _select("unexpected_null_pk", "order_id", "'CRITICAL'", "count(*) - count(order_id)",
                   "'the key order_id is null in some rows'")
_DUP_PK = _select(
    "duplicate_pk", "order_id", "'CRITICAL'",
    "(SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM v_dirty_orders GROUP BY order_id))",
    "n || ' rows repeat a value of the key order_id, ' || pct || '% of all'",
    "(SELECT string_agg(x, ' | ' ORDER BY o) FROM (SELECT CAST(order_id AS VARCHAR) AS x, order_id AS o FROM v_dirty_orders "
    "WHERE order_id IS NOT NULL GROUP BY order_id HAVING count(*) > 1 ORDER BY order_id LIMIT 5))")
_NEGATIVE = _select("negative_value", "unit_price", "'CRITICAL'", "count(*) FILTER (unit_price < 0)",
                    "'unit_price is below zero in ' || n || ' rows'", _samples("unit_price", "unit_price < 0"))
_PERCENT = _select("impossible_pct", "discount_pct", "'WARNING'", "count(*) FILTER (discount_pct < 0 OR discount_pct > 100)",
                   "'discount_pct is no share between 0 and 100 in ' || n || ' rows'",
                   _samples("discount_pct", "discount_pct < 0 OR discount_pct > 100"))
_DATES = _select("invalid_date", "order_date", "'WARNING'", "count(*) FILTER (order_date IS NOT NULL AND TRY_CAST(order_date AS TIMESTAMP) IS NULL)",
                 "'order_date cannot be read as a date in ' || n || ' rows'",
                 _samples("order_date", "order_date IS NOT NULL AND TRY_CAST(order_date AS TIMESTAMP) IS NULL"))
_GROUPS = """(SELECT norm, string_agg('''' || val || '''', ', ' ORDER BY val) AS vals
    FROM (SELECT DISTINCT status AS val, lower(trim(status)) AS norm FROM v_dirty_orders WHERE status IS NOT NULL) GROUP BY norm HAVING count(*) > 1)"""
_CATEGORY = f"""SELECT 'dirty_orders' AS table_name, 'status' AS column_name, 'inconsistent_category' AS finding_type, 'WARNING' AS severity,
    'status spells a category in several ways: ' || (SELECT string_agg('[' || vals || '] -> ''' || norm || '''', ', ' ORDER BY norm)
       FROM {_GROUPS}) AS description,
    (SELECT count(*) FROM {_GROUPS}) AS affected_count,
    round(CAST((SELECT count(*) FROM {_GROUPS}) AS DOUBLE) / count(DISTINCT status) * 100, 2) AS affected_percentage,
    (SELECT string_agg('[' || vals || '] -> ''' || norm || '''', ' | ' ORDER BY norm) FROM {_GROUPS}) AS samples FROM v_dirty_orders"""
_DUP_ROWS = """SELECT 'order_lines' AS table_name, CAST(NULL AS VARCHAR) AS column_name, 'duplicate_row' AS finding_type, 'WARNING' AS severity,
    n || ' rows repeat another row, ' || round(CAST(n AS DOUBLE) / t * 100, 2) || '% of all' AS description, n AS affected_count,
    round(CAST(n AS DOUBLE) / t * 100, 2) AS affected_percentage, '' AS samples
    FROM (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT order_id, line_no FROM v_order_items)) AS n, count(*) AS t FROM v_order_items)"""


def _orphans(source, column, target, target_column, source_view, target_view) -> str:
    lost = f"{column} IS NOT NULL AND {column} NOT IN (SELECT {target_column} FROM {target_view} WHERE {target_column} IS NOT NULL)"
    return f"""SELECT '{source}' AS table_name, '{column}' AS column_name, 'orphaned_fk' AS finding_type, 'CRITICAL' AS severity,
        n || ' rows of {source} have a {column} that {target}.{target_column} lacks, ' || pct || '% of all' AS description,
        n AS affected_count, pct AS affected_percentage, samples FROM (SELECT count(*) FILTER ({lost}) AS n,
          round(CAST(count(*) FILTER ({lost}) AS DOUBLE) / count({column}) * 100, 2) AS pct,
          (SELECT string_agg(CAST({column} AS VARCHAR), ' | ' ORDER BY {column}) FROM (SELECT DISTINCT {column} FROM {source_view} WHERE {lost}
             ORDER BY 1 LIMIT 5)) AS samples FROM {source_view}) WHERE n > 0"""


_ORPHANS = [_orphans("dirty_orders", "customer_id", "customers", "customer_id", "v_dirty_orders", "v_customers"),
            _orphans("order_items", "order_id", "dirty_orders", "order_id", "v_order_items", "v_dirty_orders")]
_ITEM_DUPS = _DUP_ROWS.replace("'order_lines'", "'order_items'").replace("DISTINCT order_id, line_no", "DISTINCT *") + " WHERE n > 0"
VIEW_SQL["v_dirty_findings"] = " UNION ALL ".join([*_MISSING, _NULL_PK, _DUP_PK, _NEGATIVE, _PERCENT, _DATES, _CATEGORY])


def _flat(df):
    return df.select(*dq.FINDING_COLUMNS[:-1], F.array_join("evidence_samples", " | ").alias("samples"))


def _findings(v):
    return dq.table_findings(v.dirty_orders, "dirty_orders", ["order_id"])


@query("quality_table_findings", "SELECT * FROM v_dirty_findings")
def _(v):
    return _flat(_findings(v))


@query("quality_missing_values", """SELECT column_name, finding_type, severity, affected_count FROM v_dirty_findings
    WHERE finding_type IN ('missing_value', 'unexpected_null_pk')""")
def _(v):
    return dq.column_findings(v.dirty_orders, "dirty_orders", ["order_id"]).filter(
        F.col("finding_type").isin("missing_value", "unexpected_null_pk")).select(
        "column_name", "finding_type", "severity", "affected_count")


@query("quality_duplicate_keys", "SELECT column_name, affected_count, affected_percentage, samples FROM v_dirty_findings WHERE finding_type = 'duplicate_pk'")
def _(v):
    return _flat(dq.duplicate_key_findings(v.dirty_orders, "dirty_orders", ["order_id"])).select(
        "column_name", "affected_count", "affected_percentage", "samples")


@query("quality_duplicate_rows", _DUP_ROWS)
def _(v):
    return _flat(dq.duplicate_row_findings(v.order_items.select("order_id", "line_no"), "order_lines"))


@query("quality_value_checks", """SELECT column_name, finding_type, severity, description, affected_count FROM v_dirty_findings
    WHERE finding_type IN ('negative_value', 'impossible_pct', 'invalid_date')""")
def _(v):
    return dq.column_findings(v.dirty_orders, "dirty_orders", ["order_id"]).filter(
        F.col("finding_type").isin("negative_value", "impossible_pct", "invalid_date")).select(
        "column_name", "finding_type", "severity", "description", "affected_count")


@query("quality_inconsistent_categories", "SELECT * FROM v_dirty_findings WHERE finding_type = 'inconsistent_category'")
def _(v):
    return _flat(dq.category_findings(v.dirty_orders, "dirty_orders"))


@query("quality_orphaned_keys", " UNION ALL ".join(_ORPHANS))
def _(v):
    return _flat(dq.orphaned_keys(v.as_dict("dirty_orders", "customers", "order_items"), EDGES))


@query("quality_evidence_samples", """SELECT column_name, finding_type, samples FROM v_dirty_findings
    WHERE finding_type IN ('negative_value', 'impossible_pct', 'invalid_date')""")
def _(v):
    return dq.evidence_samples(v.dirty_orders).select(
        "column_name", "finding_type", F.array_join("evidence_samples", " | ").alias("samples"))


def _score_sql(table: str, findings: str, view: str, columns: int) -> str:
    def hit(kinds, value="affected_count"):
        return f"coalesce((SELECT sum({value}) FROM ({findings}) WHERE table_name = '{table}' AND finding_type IN ({kinds})), 0)"

    def score(hits, base):
        return f"greatest(0.0, least(100.0, CAST(round(CAST(100 - CAST({hits} AS DOUBLE) / {base} * 100 AS DECIMAL(20,6)), 1) AS DOUBLE)))"
    return f"""SELECT '{table}' AS table_name, row_count, findings_count, completeness, uniqueness, validity, consistency, referential_integrity,
        CAST(round(CAST(completeness * 0.25::DOUBLE + uniqueness * 0.2::DOUBLE + validity * 0.2::DOUBLE + consistency * 0.15::DOUBLE
          + referential_integrity * 0.2::DOUBLE AS DECIMAL(20,6)), 1) AS DOUBLE) AS overall_score
        FROM (SELECT count(*) AS row_count, (SELECT count(*) FROM ({findings}) WHERE table_name = '{table}') AS findings_count,
          {score(hit("'missing_value', 'unexpected_null_pk'"), f"(count(*) * {columns})")} AS completeness,
          {score(hit("'duplicate_pk', 'duplicate_row'"), "count(*)")} AS uniqueness,
          {score(hit("'negative_value', 'invalid_date', 'impossible_pct'"), "count(*)")} AS validity,
          greatest(0.0, 100 - 5 * {hit("'inconsistent_category'", "1")})::DOUBLE AS consistency,
          {score(hit("'orphaned_fk'"), "count(*)")} AS referential_integrity FROM {view})"""


VIEW_SQL["v_audit_findings"] = "SELECT * FROM v_dirty_findings UNION ALL " + " UNION ALL ".join([*_ORPHANS, _ITEM_DUPS])
VIEW_SQL["v_health"] = " UNION ALL ".join(
    _score_sql(t, "SELECT * FROM v_audit_findings", f"v_{t}", n) for t, n in (("dirty_orders", 6), ("customers", 7), ("order_items", 5)))


def _tables(v):
    return v.as_dict("dirty_orders", "customers", "order_items")


def audit_parts(v):
    tables = _tables(v)
    # a handful of rows that two later aggregates read
    findings = cut_lineage(dq.quality_findings(
        tables, {"dirty_orders": ["order_id"], "customers": ["customer_id"]}, EDGES, samples=False))
    return findings, dq.health_scores(findings, dq.table_sizes(tables))


@query("quality_health_scores", "SELECT * FROM v_health")
def _(v):
    return audit_parts(v)[1]


@query("quality_audit", """
    SELECT (SELECT count(*) FROM v_audit_findings) AS total_findings,
      (SELECT count(*) FROM v_audit_findings WHERE severity = 'CRITICAL') AS critical_findings,
      (SELECT count(*) FROM v_audit_findings WHERE severity = 'WARNING') AS warning_findings,
      CAST(round(CAST(avg(overall_score) AS DECIMAL(20,6)), 1) AS DOUBLE) AS overall_data_health_score FROM v_health""")
def _(v):
    return dq.quality_audit(*audit_parts(v))


# Statuses with planted slips: a letter lost, doubled or replaced, other case, blanks; and free texts that differ.
VIEW_SQL["v_misspelt"] = """SELECT order_id, CASE WHEN order_id % 50 = 1 THEN replace(status, 'e', '') WHEN order_id % 50 = 2 THEN status || right(status, 1)
      WHEN order_id % 50 = 3 THEN 'X' || substr(status, 2) WHEN order_id % 50 = 4 THEN upper(status) || ' ' WHEN order_id % 997 = 5 THEN NULL ELSE status END AS status,
    CASE WHEN order_id % 40 = 7 THEN substr(shipping_method, 1, 6) || substr(shipping_method, 8) ELSE shipping_method END AS shipping_method FROM v_orders"""


def _misspelt(v):
    key, status, method = F.col("order_id") % 50, F.col("status"), F.col("shipping_method")
    return v.orders.select(
        "order_id",
        F.when(key == 1, F.replace(status, F.lit("e"), F.lit(""))).when(key == 2, F.concat(status, F.right(status, F.lit(1))))
        .when(key == 3, F.concat(F.lit("X"), F.expr("substring(status, 2)"))).when(key == 4, F.concat(F.upper(status), F.lit(" ")))
        .when(F.col("order_id") % 997 == 5, F.lit(None)).otherwise(status).alias("status"),
        F.when(F.col("order_id") % 40 == 7, F.concat(F.substring(method, 1, 6), F.expr("substring(shipping_method, 8)"))).otherwise(method).alias("shipping_method"))


def _variants_sql(edits: int) -> str:
    return f"""
    WITH RECURSIVE c AS (
      SELECT column_name, value, count(*) AS n, lower(trim(value)) AS norm FROM (
        SELECT 'status' AS column_name, status AS value FROM v_misspelt UNION ALL SELECT 'shipping_method', shipping_method FROM v_misspelt) WHERE value IS NOT NULL GROUP BY ALL),
    links AS (SELECT DISTINCT a.column_name, a.norm AS x, b.norm AS y FROM c a JOIN c b ON a.column_name = b.column_name AND a.norm <> b.norm
      WHERE length(a.norm) >= 4 AND length(b.norm) >= 4 AND levenshtein(a.norm, b.norm) <= {edits}),
    reach(column_name, x, y) AS (SELECT DISTINCT column_name, norm, norm FROM c UNION SELECT r.column_name, r.x, l.y FROM reach r JOIN links l ON l.column_name = r.column_name AND l.x = r.y),
    grouped AS (SELECT r.column_name, r.x AS norm, min(r.y) AS g FROM reach r GROUP BY ALL),
    full_rows AS (SELECT c.*, g FROM c JOIN grouped USING (column_name, norm))
    SELECT column_name, value, n, first_value(value) OVER (PARTITION BY column_name, g ORDER BY n DESC, value) AS canonical,
      count(*) OVER (PARTITION BY column_name, g) AS group_values, CAST(sum(n) OVER (PARTITION BY column_name, g) AS BIGINT) AS group_rows
    FROM full_rows QUALIFY count(*) OVER (PARTITION BY column_name, g) > 1"""


@query("quality_fuzzy_categories", _variants_sql(1))
def _(v):
    return va.category_variants(_misspelt(v), ["status", "shipping_method"])


@query("quality_fuzzy_categories_two_edits", _variants_sql(2))
def _(v):
    return va.category_variants(_misspelt(v), ["status", "shipping_method"], edits=2)

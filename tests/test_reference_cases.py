"""Small literal cases with known results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from opsloom.functions import pii
from opsloom.functions.scoring import priority_score
from opsloom.operators import analytics as an
from opsloom.operators import anomaly as ad
from opsloom.operators import documents as doc
from opsloom.operators import kpi
from opsloom.operators import profile as pr
from opsloom.operators import quality as dq
from opsloom.operators import questions as cq
from opsloom.operators import relationships as rel
from opsloom.operators import rules as ru
from opsloom.operators import search as se
from opsloom.plans.policies import POLICIES, QUESTIONS


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([
        (1, "Acme", "completed", 100.0, 60.0, "2026-01-01"), (2, "Acme", "completed", 200.0, 120.0, "2026-01-02"),
        (3, "Globex", "pending", 150.0, 90.0, "2026-01-03"), (4, "Globex", "completed", 250.0, 150.0, "2026-01-04"),
        (5, "Initech", "completed", 300.0, 180.0, "2026-01-05"), (6, "Acme", "pending", 300.0, 200.0, "2026-01-06"),
    ], "order_id long, customer string, status string, amount double, cost double, order_date string")


def test_group_by_sums_and_medians(sales):
    got = {r.customer: r for r in an.group_by_analysis(
        sales, ["customer"], {"amount": ["sum", "median", "first"]}, order_by=["order_id"]).collect()}
    assert len(got) == 3
    assert got["Acme"].amount_sum == 600.0
    assert got["Acme"].amount_median == 200.0
    assert got["Acme"].amount_first == 100.0


def test_group_by_drops_null_keys_and_names_unknown_columns(spark, sales):
    with_null = sales.unionByName(spark.createDataFrame(
        [(7, None, "x", 1.0, 1.0, "2026-01-07")], sales.schema))
    assert an.group_by_analysis(with_null, ["customer"], {"amount": ["sum"]}).count() == 3
    with pytest.raises(ValueError, match="nowhere"):
        an.group_by_analysis(sales, ["nowhere"], {"amount": ["sum"]})
    with pytest.raises(ValueError, match="order_by"):
        an.group_by_analysis(sales, ["customer"], {"amount": ["first"]})


def test_pivot_fills_missing_cells(sales):
    got = {r.customer: r for r in an.pivot_analysis(sales, "customer", "status", "amount").collect()}
    assert got["Initech"].pending == 0.0
    assert got["Acme"].completed == 300.0


def test_correlation(sales):
    got = an.correlation_matrix(sales, ["amount", "cost"]).collect()
    assert len(got) == 2
    assert got[0].cost > 0.9 and got[0].amount == 1.0


def test_resample_keeps_empty_periods(spark, sales):
    daily = an.resample(sales.filter("order_id <> 3"), "order_date", "amount").collect()
    assert len(daily) == 6
    assert daily[2].amount == 0.0
    assert daily[0].pct_change == 0.0 and daily[1].pct_change == 100.0
    assert daily[3].pct_change is None  # the previous period is 0


@pytest.fixture(scope="module")
def transactions(spark):
    rows = [(f"TX-{i + 1}", 100.0 + (i % 5) * 2, 70.0 + (i % 5) * 1.5, f"2026-01-{i + 1:02d}") for i in range(20)]
    return spark.createDataFrame(rows + [("TX-21", 1000.0, 850.0, "2026-01-21")],
                                 "transaction_id string, amount double, cost double, order_date string")


def test_zscore_finds_exactly_the_spike(transactions):
    got = ad.zscore_anomalies(transactions, "amount", "transactions").collect()
    assert [r.observed_value for r in got] == [1000.0]
    assert got[0].record_id == "TX-21" and got[0].is_verified_impact is False and len(got[0].potential_drivers) == 2


def test_iqr_contains_the_spike(transactions):
    assert 1000.0 in [r.observed_value for r in ad.iqr_anomalies(transactions, "amount", "transactions").collect()]


def test_rolling_finds_the_last_value(transactions):
    got = ad.rolling_anomalies(transactions, "amount", "transactions").orderBy("date").collect()
    assert got[-1].observed_value == 1000.0


def test_scan_covers_all_detectors_once(transactions):
    got = ad.scan_anomalies(transactions, "transactions").collect()
    assert {r.method for r in got} == {"z_score", "iqr", "rolling_deviation", "isolation_forest"}
    keys = [(r.column_name, r.record_id, r.method) for r in got]
    assert len(keys) == len(set(keys))


def test_too_few_or_constant_values_give_nothing(spark):
    few = spark.createDataFrame([(f"a{i}", float(i)) for i in range(4)], "x_id string, v double")
    same = spark.createDataFrame([(f"a{i}", 5.0) for i in range(30)], "x_id string, v double")
    for df in (few, same):
        assert ad.zscore_anomalies(df, "v", "t").count() == 0
        assert ad.iqr_anomalies(df, "v", "t").count() == 0


def test_dirty_table_findings(spark):
    dirty = spark.createDataFrame([
        (1.0, 10, 25.0, 10.0, "Pending", "2026-01-01"), (2.0, 20, -10.0, 15.0, "pending", "not_a_date"),
        (2.0, 30, 50.0, 150.0, "PENDING", "2026-01-03"), (4.0, 40, 30.0, 5.0, "Shipped", "2026-01-04"),
        (None, 50, 15.0, -5.0, "Delivered", "2026-01-05"),
    ], "order_id double, customer_id long, unit_price double, discount_pct double, status string, order_date string")
    findings = dq.table_findings(dirty, "dirty_orders", ["order_id"])
    got = {r.finding_type: r for r in findings.collect()}
    assert set(got) == {"unexpected_null_pk", "duplicate_pk", "negative_value", "impossible_pct", "inconsistent_category", "invalid_date"}
    assert got["impossible_pct"].affected_count == 2
    assert got["duplicate_pk"].evidence_samples == ["2.0"]
    assert got["invalid_date"].evidence_samples == ["not_a_date"]
    scores = dq.health_scores(findings, dq.table_sizes({"dirty_orders": dirty})).first()
    assert scores.overall_score < 100.0 and scores.consistency == 95.0


def test_empty_table_scores_full(spark):
    empty = spark.createDataFrame([], "order_id long, unit_price double")
    scores = dq.health_scores(dq.table_findings(empty, "e", ["order_id"]), dq.table_sizes({"e": empty})).first()
    assert scores.overall_score == 100.0 and scores.row_count == 0


def test_kpi_late_rate_and_sum(spark):
    orders = spark.createDataFrame([
        (1, 1000.0, "2026-01-01", "2026-01-05", "2026-01-04"), (2, 2000.0, "2026-01-02", "2026-01-05", "2026-01-08"),
        (3, 1500.0, "2026-01-03", "2026-01-06", "2026-01-06"), (4, 2500.0, "2026-01-04", "2026-01-07", "2026-01-10"),
    ], "order_id long, amount double, order_date string, promised_date string, delivery_date string")
    late = kpi.Metric("LATE", "Late", "orders", "AVG(CASE WHEN delivery_date > promised_date THEN 1.0D ELSE 0.0D END) * 100",
                      "order_date", "rate", 2.0, 6.0, 12.0, "lower_is_better")
    got = kpi.evaluate_metric(orders, late).first()
    assert got.current_value == 50.0 and got.status == "CRITICAL" and len(got.sparkline) == 4
    total = kpi.Metric("REV", "Revenue", "orders", "SUM(amount)", "order_date", "sum")
    revenue = kpi.evaluate_metric(orders, total).first()
    assert revenue.current_value == 7000.0 and revenue.previous_value == 3000.0 and revenue.status == "GOOD"
    flat = kpi.evaluate_metric(orders, kpi.Metric("N", "N", "orders", "COUNT(*)")).first()
    assert [p.label for p in flat.sparkline] == ["P1", "P2", "P3", "P4", "P5"] and flat.abs_change == 0.0
    assert kpi.test_formula(orders, "SUM(amount)").first().sample_result == 7000.0


def test_formula_may_not_read_tables(spark, sales):
    from opsloom.operators.safe_sql import UnsafeSqlError
    sales.createOrReplaceTempView("secret_sales")
    for bad in ("(SELECT max(amount) FROM secret_sales)", "reflect('java.lang.System', 'exit', 0)"):
        with pytest.raises(UnsafeSqlError):
            kpi.metric_value(sales, kpi.Metric("X", "X", "orders", bad))


def test_condition_masks(spark):
    df = spark.createDataFrame([(100, "Alpha", None), (500, "Beta", "urgent"), (1000, "Gamma", "")],
                               "amount long, category string, tag string")

    def mask(*condition):
        column = ru.compile_condition(df.schema, ru.Condition(*condition))
        return [r[0] for r in df.orderBy("amount").select(column).collect()]

    assert mask("amount", "greater_than", 400) == [False, True, True]
    assert mask("category", "contains", "bet") == [False, True, False]
    assert mask("tag", "is_empty") == [True, False, True]
    assert mask("tag", "not_equals", "urgent") == [True, False, True]
    assert mask("nowhere", "equals", 1) == [False] * 3
    assert mask("amount", "resembles", 1) == [False] * 3


def test_priority_scores(spark):
    one = spark.range(1)
    assert one.select(priority_score(F.lit("CRITICAL"), F.lit(10000.0), F.lit(60), F.lit(True))).first()[0] == 100.0
    assert one.select(priority_score(F.lit("LOW"), F.lit(0.0), F.lit(0), F.lit(False))).first()[0] == 10.0


@pytest.fixture(scope="module")
def rule_invoices(spark):
    return spark.createDataFrame([
        ("INV-1001", "Acme", 12000.0, "2025-11-01", "overdue"), ("INV-1002", "Globex", 450.0, "2026-03-01", "pending"),
        ("INV-1003", "Initech", 8500.0, "2025-12-15", "overdue"), ("INV-1004", "Umbrella", 0.0, "2026-01-01", "paid"),
    ], "invoice_id string, customer string, unpaid_amount double, due_date string, status string")


LARGE_OVERDUE = ru.Rule("Large Overdue Balance", "invoice", "invoices", "CRITICAL", (
    ru.Condition("unpaid_amount", "greater_than", 5000.0), ru.Condition("status", "equals", "overdue")))


def test_rule_finds_two_invoices_and_merge_is_idempotent(rule_invoices):
    found = ru.evaluate_rule(rule_invoices, LARGE_OVERDUE, "2026-02-01")
    got = found.collect()
    assert {r.entity_id for r in got} == {"INV-1001", "INV-1003"}
    assert all(r.priority_score >= 60.0 for r in got)
    assert '"unpaid_amount":12000.0' in next(r for r in got if r.entity_id == "INV-1001").evidence
    acknowledged = found.withColumn("status", F.lit("ACKNOWLEDGED"))
    merged = ru.merge_exceptions(acknowledged, found)
    assert merged.count() == 2 and {r.status for r in merged.collect()} == {"ACKNOWLEDGED"}
    again = ru.merge_exceptions(acknowledged.withColumn("status", F.lit("RESOLVED")), found)
    assert again.count() == 4


def test_rule_without_conditions_matches_nothing(rule_invoices):
    assert rule_invoices.filter(ru.compile_rule(rule_invoices.schema, ru.Rule("r", "e", "t", "LOW", ()))).count() == 0


def test_profile_keys_and_edges(spark):
    customers = spark.createDataFrame([(1, "A", "a@x.com"), (2, "B", "b@x.com"), (3, "C", "c@x.com")],
                                      "customer_id long, name string, email string")
    orders = spark.createDataFrame([(101, 1, 250.0, "paid"), (102, 2, 500.0, "pending"), (103, 1, 150.0, "paid")],
                                   "order_id long, customer_id long, amount double, status string")
    profile = {r.column_name: r for r in pr.profile_columns(customers, "customers").collect()}
    assert profile["customer_id"].is_primary_key and profile["customer_id"].inferred_role == "identifier"
    assert profile["email"].inferred_role == "sensitive"
    entity = pr.detect_entities(pr.catalog_of(spark, {"customers": customers})).first()
    assert entity.detected_entity == "Customers" and entity.entity_confidence >= 0.8
    edges = {(r.source_table, r.source_column, r.target_table): r.confidence
             for r in rel.discover_relationships(spark, {"customers": customers, "orders": orders}).collect()}
    assert edges[("orders", "customer_id", "customers")] == 0.98


def test_redact_and_restore(spark):
    text = "Please follow up with customer john.doe@example.com at (555) 123-4567 regarding order 101."
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(pii.redact(F.col("t")).alias("r"), pii.token_map(F.col("t")).alias("m"),
                    pii.restore(pii.redact(F.col("t")), pii.token_map(F.col("t"))).alias("back")).first()
    assert "[EMAIL_1]" in row.r and "[PHONE_1]" in row.r and "john.doe" not in row.r
    assert row.back == text and row.m["[EMAIL_1]"] == "john.doe@example.com"


def test_equal_values_get_new_numbers(spark):
    df = spark.createDataFrame([("a@b.co a@b.co",)], "t string")
    assert df.select(pii.redact(F.col("t"))).first()[0] == "[EMAIL_1] [EMAIL_2]"


def test_questions(spark):
    orders = spark.createDataFrame([
        (101, "C1", 1200.0, "2026-01-05", "2026-01-09", "delayed"), (102, "C2", 4500.0, "2026-01-05", "2026-01-12", "delayed"),
        (103, "C1", 300.0, "2026-01-05", "2026-01-04", "delivered"), (104, "C3", 2800.0, "2026-01-05", "2026-01-10", "delayed"),
    ], "order_id long, customer_id string, amount double, promised_date string, delivery_date string, status string")
    assert [r.order_id for r in cq.delayed_orders(orders, k=10).collect()] == [102, 104, 101]
    assert {r.order_id for r in cq.delayed_orders(orders).collect()} == {101, 102, 104}
    invoices = spark.createDataFrame([
        ("INV-1", "C1", 4200.0, "2025-11-01", "refund_pending"), ("INV-2", "C2", 1500.0, "2026-03-01", "pending"),
        ("INV-3", "C3", 8900.0, "2025-12-01", "overdue")],
        "invoice_id string, customer_id string, unpaid_amount double, due_date string, status string")
    assert cq.approval_cases(invoices).count() == 2
    assert cq.result_summary(cq.approval_cases(invoices)).first().total_exposure == 13100.0
    asked = spark.createDataFrame([
        ("Which orders are delayed?", "data_query"), ("Why did delivery delays increase?", "investigate"),
        ("Which refund cases require manager approval according to our policy?", "hybrid"),
        ("What does the SOP say?", "policy_rag"), ("What requires attention today?", "action_plan")], "q string, want string")
    assert all(r.got == r.want for r in asked.select("want", cq.classify_intent(F.col("q")).alias("got")).collect())


def test_policies_answer_their_questions(spark):
    docs = spark.createDataFrame(list(POLICIES.items()), "doc_id string, text string")
    chunks = doc.chunk_documents(docs)
    assert chunks.count() >= 8
    index = se.build_index(chunks)
    asked = spark.createDataFrame(list(QUESTIONS.items()), "query_id string, query string")
    hits = se.search_results(se.search(index, asked, k=3), chunks,
                             docs.select("doc_id", F.col("doc_id").alias("filename")))
    top = {r.query_id: r for r in hits.filter("rank = 1").collect()}
    expected = {
        "refund_threshold": ("Refund_and_Credit_Policy", "$5,000"), "credit_hold_timeline": ("Accounts_Receivable", "30 days overdue"),
        "critical_ticket_sla": ("Customer_Support_SLA_Policy", "4 hours"), "safety_stock_formula": ("Inventory_Reorder", "lead time"),
        "credit_hold_override": ("Accounts_Receivable", "Chief Financial Officer")}
    for question, (document, fact) in expected.items():
        assert document in top[question].doc_id and fact in top[question].content
        assert "Page: " in top[question].citation and "Section: " in top[question].citation


def test_long_pages_are_cut_with_overlap(spark):
    text = " ".join(f"w{i}" for i in range(400 + 600))
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    got = doc.chunk_documents(df).orderBy("chunk_index").collect()
    # pages of 400, 400 and 200 words
    assert [(r.page_number, r.token_count) for r in got] == [(1, 250), (1, 190), (2, 250), (2, 190), (3, 200)]
    assert got[1].content.split()[0] == "w210"

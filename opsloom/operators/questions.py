"""The canned operational questions, and the intent behind a question text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.columns import as_of_literal, contains_any, lowered, money_sum, stable_round
from opsloom.operators.ordering import top_rows

# Intent keywords.
POLICY_WORDS = ["policy", "sop", "rule", "approval"]
CASE_WORDS = ["case", "order", "invoice", "refund", "which", "who", "show"]
GUIDELINE_WORDS = ["policy", "sop", "guideline", "escalation rule", "terms", "allowed"]
CAUSE_WORDS = ["caused", "increase", "investigate"]
PLAN_WORDS = ["action plan", "priority action", "morning review", "what should we do", "what requires attention"]
AMOUNT_WORDS = ("amount", "revenue", "price", "value")
TOOLS = {
    "hybrid": ["search_documents", "run_readonly_sql"],
    "policy_rag": ["search_documents"],
    "investigate": ["investigate_problem"],
    "action_plan": ["calculate_kpi", "detect_anomalies"],
    "data_query": ["run_readonly_sql"],
}
APPROVAL_LIMIT = 2500


def _is_late() -> Column:
    late = F.coalesce(F.col("delivery_date") > F.col("promised_date"), F.lit(False))
    return late | F.coalesce(lowered("status") == "delayed", F.lit(False))


def delayed_orders(orders: DataFrame, k: int | None = None) -> DataFrame:
    """Delivered after the promise or marked delayed; as in all questions, ``k`` asks for the first rows only."""
    found = orders.filter(_is_late()).select("order_id", "customer_id", "amount", "promised_date", "delivery_date", "status")
    return top_rows(found, k, F.desc("amount"), "order_id")


def overdue_invoices(invoices: DataFrame, as_of: str, k: int | None = None) -> DataFrame:
    past = F.col("due_date") < as_of_literal(as_of)
    found = invoices.filter((past | (lowered("status") == "overdue")) & (lowered("status") != "paid")).select(
        "invoice_id", "customer_id", "unpaid_amount", "due_date", "status")
    return top_rows(found, k, F.desc("unpaid_amount"), "invoice_id")


def restock_list(inventory: DataFrame, k: int | None = None) -> DataFrame:
    found = inventory.filter(F.col("quantity_on_hand") <= F.col("reorder_level")).select(
        "sku", "product_name", "quantity_on_hand", "reorder_level")
    return top_rows(found, k, "quantity_on_hand", "sku")


def tickets_at_risk(tickets: DataFrame, as_of: str, k: int | None = None) -> DataFrame:
    past = F.col("sla_deadline") < as_of_literal(as_of)
    found = tickets.filter((lowered("status") != "resolved") & (past | (F.col("priority") == "Urgent"))).select(
        "ticket_id", "customer_id", "subject", "priority", "status", "sla_deadline")
    return top_rows(found, k, F.desc("priority"), "ticket_id")


def customers_by_delayed_value(customers: DataFrame, orders: DataFrame, k: int | None = None) -> DataFrame:
    delayed = orders.filter(_is_late()).groupBy("customer_id").agg(
        F.count("order_id").alias("delayed_orders"), money_sum("amount").alias("total_delayed_value"))
    return top_rows(customers.select("customer_id", "name", "tier").join(delayed, "customer_id"), k,
                    F.desc("total_delayed_value"), "customer_id")


def revenue_by_customer(orders: DataFrame, k: int | None = None) -> DataFrame:
    found = orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("orders_count"), money_sum("amount").alias("total_revenue"))
    return top_rows(found, k, F.desc("total_revenue"), "customer_id")


def approval_cases(invoices: DataFrame, limit: float = APPROVAL_LIMIT) -> DataFrame:
    """Invoices that need a manager's approval."""
    return invoices.filter((F.col("unpaid_amount") > limit) | lowered("status").isin("refund_pending", "overdue"))


def result_summary(result: DataFrame) -> DataFrame:
    """Matching rows and the sum of the first amount-like column, one row."""
    amount = next((c for c in result.columns if any(w in c.lower() for w in AMOUNT_WORDS)), None)
    total = money_sum(amount) if amount else F.lit(0.0)
    return result.agg(F.count(F.lit(1)).alias("matching_records"),
                      stable_round(F.coalesce(total, F.lit(0.0)), 2).alias("total_exposure"))


def classify_intent(question: Column) -> Column:
    """hybrid, policy_rag, investigate, action_plan or data_query; the first rule that applies."""
    text = F.lower(question)
    return (
        F.when(contains_any(text, POLICY_WORDS) & contains_any(text, CASE_WORDS), "hybrid")
        .when(contains_any(text, GUIDELINE_WORDS), "policy_rag")
        .when(text.startswith("why") | contains_any(text, CAUSE_WORDS), "investigate")
        .when(contains_any(text, PLAN_WORDS), "action_plan")
        .otherwise("data_query")
    )


def plan_tools(intent: Column) -> Column:
    chain = F.array(*[F.lit(t) for t in TOOLS["data_query"]])
    for name, tools in TOOLS.items():
        chain = F.when(intent == name, F.array(*[F.lit(t) for t in tools])).otherwise(chain)
    return chain

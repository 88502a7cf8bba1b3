"""The operations model (customers, orders, invoices, ...) over the testdata tables.

Each property is a lazy DataFrame; only the tables a query touches are read.
Derived columns are pure functions of the row, so any engine gets the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "interval 1 day"


def _days(n: int):
    return F.expr(f"interval {n} days")


class OperationsViews:
    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    @cached_property
    def customers(self) -> DataFrame:
        # nation is a fixed 25-row code table
        nation = self.raw("nation")
        return self.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("tier"),
            F.col("c_acctbal").alias("credit_limit"),
            F.concat(F.lit("procurement"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
            F.col("n_name").alias("city"),
            F.when(F.col("c_acctbal") < 0, "Credit_Hold").otherwise("Active").alias("status"),
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.round(F.col("p_retailprice") * 0.6, 2).alias("unit_cost"),
            F.col("p_retailprice").alias("unit_price"),
            F.col("p_size").alias("reorder_level"),
        )

    @cached_property
    def inventory(self) -> DataFrame:
        return self.raw("part").select(
            F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"),
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_brand").alias("warehouse_location"),
            (F.col("p_partkey") % 97).alias("quantity_on_hand"),
            F.col("p_size").alias("reorder_level"),
            F.floor(F.col("p_size") * 0.5).cast("int").alias("safety_stock"),
            F.round(F.col("p_retailprice") * 0.6, 2).alias("unit_cost"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("order_date"),
            F.when(status == "F", "Delivered").when(status == "O", "Processing").otherwise("Delayed").alias("status"),
            F.col("o_totalprice").alias("total_amount"),
            F.when(F.col("o_totalprice") < 250000, "Ground Freight").otherwise("Expedited Air").alias("shipping_method"),
            F.lit("Net 30").alias("payment_terms"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("line_total"),
        )

    @cached_property
    def shipments(self) -> DataFrame:
        estimated = F.col("o_orderdate") + _days(30)
        closed = F.col("l_linestatus") == "F"
        lines = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_linestatus")
        orders = self.raw("orders").select("o_orderkey", "o_orderdate")
        suppliers = self.raw("supplier").select("s_suppkey", "s_name")
        return (
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                F.col("l_orderkey").alias("order_id"),
                F.col("l_linenumber").alias("line_no"),
                F.col("s_name").alias("carrier"),
                F.col("l_shipdate").alias("ship_date"),
                estimated.alias("estimated_delivery"),
                F.when(closed, F.col("l_shipdate")).alias("actual_delivery"),
                F.when(~closed, "In Transit").when(F.col("l_shipdate") > estimated, "Delayed")
                .otherwise("Delivered").alias("status"),
                F.greatest(F.lit(0), F.datediff("l_shipdate", estimated)).alias("delay_days"),
            )
        )

    @cached_property
    def invoices(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.raw("orders").select(
            F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("invoice_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderkey").alias("order_id"),
            F.col("o_orderdate").alias("issue_date"),
            (F.col("o_orderdate") + _days(30)).alias("due_date"),
            F.col("o_totalprice").alias("amount"),
            F.when(status == "F", F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("unpaid_amount"),
            F.when(status == "F", "Paid").when(status == "O", "Pending").otherwise("Overdue").alias("status"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        key = F.col("o_orderkey").cast("string")
        priority = F.col("o_orderpriority")
        return self.raw("orders").filter(F.col("o_orderstatus") == "F").select(
            F.concat(F.lit("PAY-"), key).alias("payment_id"),
            F.concat(F.lit("INV-"), key).alias("invoice_id"),
            (F.col("o_orderdate") + _days(10)).alias("payment_date"),
            F.col("o_totalprice").alias("amount"),
            F.when(priority.isin("1-URGENT", "2-HIGH"), "Wire").when(priority == "3-MEDIUM", "Corporate Card")
            .otherwise("ACH Transfer").alias("payment_method"),
        )

    @cached_property
    def support_tickets(self) -> DataFrame:
        kind, key = F.col("event_type"), F.col("event_id")
        return self.raw("events").select(
            key.alias("ticket_id"),
            F.col("user_id").alias("customer_id"),
            kind.alias("subject"),
            F.when(kind == "error", "Critical").when(kind == "purchase", "High").when(kind == "click", "Medium")
            .otherwise("Low").alias("priority"),
            F.when(key % 7 == 0, "In Progress").when(key % 5 == 0, "Waiting Customer")
            .otherwise("Resolved").alias("status"),
            F.when((key % 7 == 0) & kind.isin("error", "purchase"), "Breached").when(key % 5 == 0, "At Risk")
            .otherwise("Within SLA").alias("sla_status"),
            F.col("ts").alias("created_at"),
            (F.col("ts") + F.expr("interval 24 hours")).alias("sla_deadline"),
            (1 + key % 5).alias("satisfaction_score"),
        )

    @cached_property
    def employees(self) -> DataFrame:
        nation = self.raw("nation")
        return self.raw("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("employee_id"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("department"),
            (F.col("s_suppkey") % 13).alias("active_tasks"),
            (30 + F.col("s_suppkey") % 151).alias("resolved_tasks"),
        )

    @cached_property
    def dirty_orders(self) -> DataFrame:
        """All orders with planted defects, for the quality operators."""
        key = F.col("o_orderkey")
        base = F.when(F.col("o_orderstatus") == "F", "Delivered").when(F.col("o_orderstatus") == "O", "Processing") \
            .otherwise("Delayed")
        return self.raw("orders").select(
            F.when(key % 101 == 0, F.lit(None)).when(key % 103 == 1, key - 1).otherwise(key).alias("order_id"),
            F.when(key % 53 == 0, F.col("o_custkey") + 10000000).otherwise(F.col("o_custkey")).alias("customer_id"),
            F.when(key % 37 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("unit_price"),
            F.when(key % 47 == 0, F.lit(None)).when(key % 41 == 0, F.lit(150.0)).when(key % 43 == 0, F.lit(-5.0))
            .otherwise((key % 30).cast("double")).alias("discount_pct"),
            F.when(key % 4 == 3, F.lit(None)).when(key % 5 == 0, F.upper(base)).when(key % 5 == 1, F.concat(F.lower(base), F.lit(" ")))
            .otherwise(base).alias("status"),
            F.when(key % 29 == 0, "not_a_date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"),
        )

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def as_dict(self, *names: str) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in names}

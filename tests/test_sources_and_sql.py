"""Files, tables, guarded SQL, sinks and streaming state."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from opsloom.operators import audit
from opsloom.operators import kpi
from opsloom.operators.rules import Condition, Rule, evaluate_table_rules
from opsloom.operators.safe_sql import UnsafeSqlError, execute_safe_query, validate_formula, validate_only, validate_sql
from opsloom.sources import files, tables
from opsloom.streaming import flows


@pytest.mark.parametrize("delimiter", [",", ";", "\t", "|"])
def test_csv_delimiter_and_names(spark, tmp_path, delimiter):
    path = tmp_path / "orders.csv"
    path.write_text("\n".join(delimiter.join(r) for r in [
        ["Order ID", "Customer-Name", "amount", "Amount"], ["1", "Acme", "10.5", "1"], ["2", "Globex", "20.0", "2"]]))
    df = files.read_csv_table(spark, str(path))
    assert df.columns == ["order_id", "customer_name", "amount", "amount_2"]
    assert df.count() == 2 and df.agg(F.sum("amount")).first()[0] == 30.5


def test_json_shapes(spark, tmp_path):
    items = [{"sku": "A", "dims": {"w": 1, "size": {"h": 2}}}, {"sku": "B", "dims": {"w": 3, "size": {"h": 4}}}]
    shapes = {"list": items, "wrapped": {"data": items, "total": 2}, "single": items[0]}
    for name, value in shapes.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(value))
        df = files.read_json_table(spark, str(path), multi_line=True)
        assert set(df.columns) == {"sku", "dims_w", "dims_size_h"}
        assert df.count() == (1 if name == "single" else 2)
    bad = tmp_path / "bad.json"
    bad.write_text("42")
    with pytest.raises(ValueError):
        files.read_json_table(spark, str(bad), multi_line=True)


def test_text_documents_drop_bad_bytes(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# Title\nbody \xff\xfe end")
    row = files.read_text_documents(spark, str(tmp_path)).first()
    assert row.filename == "a.md" and row.file_type == "md" and row.text == "# Title\nbody  end"


def test_credentials_are_masked(spark):
    uris = ["postgresql://user:secret@host:5432/db", "postgresql://user:p@ss:w0rd@host/db", "postgresql://host/db"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in uris], "u string").select(
        files.mask_connection_uri(F.col("u"))).collect()]
    assert got == ["postgresql://user:********@host:5432/db", "postgresql://user:********@host/db", "postgresql://host/db"]


def test_table_names():
    assert tables.clean_table_name("My Orders-2024.v1.csv") == "my_orders_2024_v1"
    assert tables.normalized_names([" A b", "a-b", "a.b", "a_b_2"]) == ["a_b", "a_b_2", "a_b_3", "a_b_2_2"]


def test_load_append_refresh_and_listing(spark):
    first = spark.createDataFrame([(1, "x")], "Id int, `Some Name` string")
    stored = tables.load_table(first, "Load Test")
    assert stored.columns == ["id", "some_name"]
    tables.load_table(first, "Load Test", mode="append")
    assert spark.table("load_test").count() == 2
    report = tables.refresh_source(spark, "load_test", spark.createDataFrame([(i, "y") for i in range(5)], "id int, some_name string"))
    assert tuple(report.first()) == (2, 5, 3)
    assert "load_test" in [r.table_name for r in tables.list_tables(spark).collect()]
    assert tables.preview(spark.range(100).toDF("n")).count() == 20
    spark.sql("DROP TABLE load_test")


def test_load_tables_registers_views(spark):
    loaded = tables.load_tables(spark, "/root/testdata/sf0.001")
    assert "orders" in loaded and spark.table("orders").count() > 0
    for name in loaded:
        spark.catalog.dropTempView(name)


def test_jdbc_options_reach_the_reader(spark):
    with pytest.raises(Exception, match="(?i)driver|jdbc"):
        files.read_jdbc_tables(spark, "jdbc:nosuch://h/db", ["t"], {"user": "u"}, {"t": ("id", 0, 10, 2)})


@pytest.fixture()
def orders_view(spark):
    spark.createDataFrame([(1, 10, 500.0, "shipped"), (2, 11, 1500.0, "delayed"), (3, 10, 250.0, "shipped")],
                          "order_id long, customer_id long, amount double, status string").createOrReplaceTempView("orders")
    yield
    spark.catalog.dropTempView("orders")


def test_guarded_query_envelope(spark, orders_view):
    result = execute_safe_query(spark, "SELECT status, COUNT(*) AS n FROM orders WHERE amount > 100 GROUP BY status ORDER BY n")
    assert result.success and result.columns == ["status", "n"] and result.referenced_tables == ["orders"]
    assert "filters rows by" in result.explanation and "aggregates records by status" in result.explanation
    assert "caps output to 500 records" in result.explanation


def test_cap_applies_to_the_outer_result(spark, orders_view):
    sql = "SELECT * FROM (SELECT * FROM orders LIMIT 2) a UNION ALL SELECT * FROM orders LIMIT 100000"
    assert execute_safe_query(spark, sql, max_rows=4).rows.count() == 4


def test_cte_names_are_not_tables(spark, orders_view):
    checked = validate_sql(spark, "WITH big AS (SELECT * FROM orders WHERE amount > 400) SELECT * FROM big")
    assert checked.referenced_tables == ["orders"]


@pytest.mark.parametrize("sql", [
    "", "   ", "DROP TABLE orders", "DELETE FROM orders", "INSERT INTO orders VALUES (1, 1, 1, 'x')", "UPDATE orders SET amount = 0",
    "ALTER TABLE orders ADD COLUMN x INT", "CREATE TABLE t AS SELECT 1", "TRUNCATE TABLE orders", "SELECT 1; DROP TABLE orders",
    "SELECT 1; SELECT 2", "/*c*/ DROP VIEW orders", "SHOW TABLES", "SET a=b", "CACHE TABLE orders", "SELECT * FROM nowhere",
    "WITH w AS (SELECT 1) INSERT INTO orders SELECT * FROM w", "INSERT OVERWRITE DIRECTORY '/tmp/x' USING csv SELECT 1",
    "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT java_method('java.lang.System', 'exit', 0)", "SELEC 1",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`", "EXPLAIN DROP TABLE orders", "DESCRIBE orders"])
def test_unsafe_statements_are_refused(spark, orders_view, sql):
    with pytest.raises(UnsafeSqlError):
        validate_sql(spark, sql)
    assert spark.table("orders").count() == 3
    assert validate_only(spark, sql)["valid"] is False


def test_allow_list_cannot_be_hidden_behind_a_cte(spark, orders_view):
    spark.range(1).createOrReplaceTempView("hidden")
    with pytest.raises(UnsafeSqlError, match="hidden"):
        validate_sql(spark, "WITH hidden AS (SELECT * FROM hidden) SELECT * FROM hidden", ["orders"])
    spark.catalog.dropTempView("hidden")


def test_subquery_tables_are_seen_and_literals_are_not(spark, orders_view):
    with pytest.raises(UnsafeSqlError, match="nowhere"):
        validate_sql(spark, "SELECT * FROM orders WHERE order_id IN (SELECT id FROM nowhere)")
    assert validate_only(spark, "SELECT 'DROP TABLE x' AS t FROM orders")["valid"]


def test_sinks_and_audit(spark, tmp_path, orders_view):
    df = spark.table("orders")
    files.export_csv(df.withColumn("tags", F.array(F.lit("a"))), str(tmp_path / "csv"))
    assert files.read_csv_table(spark, str(tmp_path / "csv")).count() == 3
    assert files.write_report({"kpis": df, "sla": df}, str(tmp_path / "report")) == ["kpis", "sla"]
    assert spark.read.json(str(tmp_path / "report/json/kpis")).count() == 3
    result = execute_safe_query(spark, "SELECT * FROM orders")
    from datetime import datetime
    for day in (1, 2):
        audit.append_events(audit.query_event(spark, result, 3, "Ann", datetime(2024, 1, day)), str(tmp_path / "audit"))
    assert audit.audit_stats(spark.read.parquet(str(tmp_path / "audit"))).first().total_audit_events == 2
    board = kpi.evaluate_metric(df, kpi.Metric("N", "N", "orders", "COUNT(*)"))
    for day in (1, 2):
        kpi.snapshot_metrics(board, str(tmp_path / "snapshots"), "Current", f"2024-01-0{day} 00:00:00")
    assert spark.read.parquet(str(tmp_path / "snapshots")).count() == 2


def test_refresh_stream_takes_new_files_only(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "table")

    def add(values):
        spark.createDataFrame([(v,) for v in values], "n int").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = flows.read_folder_stream(spark, source, spark.read.parquet(source).schema)
        flows.incremental_refresh(stream, target, str(tmp_path / "checkpoint")).awaitTermination()
        return sorted(r.n for r in spark.read.parquet(target).collect())

    add([1, 2])
    assert run() == [1, 2]
    add([3])
    assert run() == [1, 2, 3]
    assert run() == [1, 2, 3]


def test_exception_store_survives_a_repeated_batch(spark, tmp_path):
    rule = Rule("big", "order", "orders", "HIGH", (Condition("amount", "gt", 100),))

    def found(rows):
        return evaluate_table_rules(spark.createDataFrame(rows, "order_id string, amount double"), [rule], "2024-01-01")

    store = flows.ExceptionStore(spark, str(tmp_path / "store"))
    store.merge(found([("a", 200.0), ("b", 300.0)]), 0)
    for _ in range(2):  # the second run is the retry of a lost batch
        store.merge(found([("b", 5000.0), ("c", 400.0)]), 1)
    state = {r.entity_id: r.priority_score for r in store.read(2).collect()}
    assert set(state) == {"a", "b", "c"} and state["b"] == 42.5


@pytest.mark.parametrize("sql", [
    "SELECT count(*) FROM IDENTIFIER('orders')", "SELECT * FROM IDENTIFIER('or' || 'ders')", "SELECT (SELECT max(amount) FROM IDENTIFIER('orders')) AS m",
    "WITH c AS (SELECT * FROM IDENTIFIER('orders')) SELECT * FROM c", "SELECT * FROM IDENTIFIER('parquet.`/tmp/none`')",
    "SELECT * FROM parquet.`/tmp/none`", "SELECT IDENTIFIER('abs')(1) AS a", "SELECT * FROM sql_keywords()"])
def test_names_known_late_are_refused(spark, sql):
    spark.range(1).createOrReplaceTempView("late_ok")
    with pytest.raises(UnsafeSqlError):
        validate_sql(spark, sql, ["late_ok"])
    with pytest.raises(UnsafeSqlError):
        validate_formula(spark, "(SELECT max(id) FROM IDENTIFIER('late_ok'))")


MANY = ", ".join(f"{i} AS c{i}" for i in range(40))
CALL = "java_method('java.lang.System', 'getProperty', 'user.name')"


@pytest.mark.parametrize("sql", [
    f"SELECT {MANY}, {CALL} AS z FROM orders",
    f"SELECT {MANY}, IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.name') AS z FROM orders",
    f"SELECT {MANY}, try_reflect('java.lang.System', 'getProperty', 'user.name') AS z FROM orders",
    f"SELECT * FROM orders WHERE amount IN (SELECT {CALL} FROM orders)",
    f"WITH c AS (SELECT {MANY}, {CALL} AS z FROM orders) SELECT c0 FROM c",
    f"SELECT {MANY} FROM orders ORDER BY {CALL}",
    f"SELECT {MANY}, transform(array(1), x -> {CALL}) AS z FROM orders",
    f"SELECT {MANY}, CASE WHEN amount > 0 THEN {CALL} END AS z FROM orders GROUP BY ALL HAVING max(amount) > 0",
    f"SELECT {MANY}, own_code(1) AS z FROM orders",
])
def test_refusals_behind_many_columns(spark, sql):
    spark.createDataFrame([(1, 500.0)], "order_id int, amount double").createOrReplaceTempView("orders")
    spark.udf.register("own_code", lambda x: x, "int")
    with pytest.raises(UnsafeSqlError):
        validate_sql(spark, sql, ["orders"])
    assert validate_sql(spark, f"SELECT {MANY}, upper('a') AS z FROM orders", ["orders"]).referenced_tables == ["orders"]


def test_view_of_foreign_code_may_be_read(spark):
    """What the owner of a view computes in it is theirs to choose; the statement itself may not call it."""
    spark.udf.register("own_code", lambda x: x, "int")
    spark.range(3).selectExpr("own_code(CAST(id AS INT)) AS v").createOrReplaceTempView("with_code")
    assert validate_only(spark, "SELECT sum(v) AS s FROM with_code", ["with_code"])["valid"]
    assert not validate_only(spark, "SELECT own_code(v) AS s FROM with_code", ["with_code"])["valid"]


def test_formula_refusals_behind_many_terms(spark):
    long = " + ".join(f"amount * {i}" for i in range(60))
    assert validate_formula(spark, f"sum({long})")
    for bad in (f"sum({long}) + length({CALL})", f"sum({long}) + (SELECT 1)", "IDENTIFIER('java_method')('a', 'b')"):
        with pytest.raises(UnsafeSqlError):
            validate_formula(spark, bad)

"""Guarded read-only SQL on top of ``spark.sql``.

Spark's own parser and analyser do the reading; nothing is run. What is judged are the trees that they return, with every
expression, subquery and common table in them, not the plans' printed text, which leaves out what is long.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from opsloom.sources.tables import nan_to_null

MAX_ROWS = 500

# Statement starts that a read-only query may not have.
WRITE_WORDS = ("DROP", "DELETE", "INSERT", "UPDATE", "ALTER", "TRUNCATE",
               "CREATE", "REPLACE", "ATTACH", "DETACH", "PRAGMA", "VACUUM")

# Nodes of a parsed plan that a read-only query may have, wherever they stand; all others are refused. Identifiers that are
# only known after evaluation (IDENTIFIER) parse to nodes of their own, which are not among these.
QUERY_NODES = frozenset(
    "Project Aggregate Distinct Sort GlobalLimit LocalLimit Union Intersect Except Filter UnresolvedHaving SubqueryAlias CTE "
    "UnresolvedWith LocalRelation OneRowRelation UnresolvedInlineTable WithWindowDefinition Offset OrderBy Join LateralJoin "
    "AsOfJoin Generate Pivot Unpivot Expand Window Sample UnresolvedHint UnresolvedRelation UnresolvedSubqueryColumnAliases "
    "UnresolvedTableValuedFunction Deduplicate Tail".split())
# Expressions of a parsed plan that the analyser has still to look up.
OPEN_EXPRESSIONS = frozenset(
    "UnresolvedFunction UnresolvedAttribute UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedStarWithColumns UnresolvedAlias "
    "UnresolvedOrdinal UnresolvedExtractValue UnresolvedGenerator UnresolvedRegex MultiAlias UnresolvedFieldName "
    "UnresolvedInlineTable".split())
# Table functions that make rows from their arguments alone.
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())
# Leaves of an analysed plan that read nothing but given tables.
HARMLESS_LEAVES = frozenset("OneRowRelation LocalRelation Range CTERelationRef UnionLoopRef".split())
# Built-in functions that run any JVM code, and the expressions that run code which is not Spark's own.
UNSAFE_FUNCTIONS = frozenset("reflect try_reflect java_method".split())
FOREIGN_CODE = frozenset(
    "CallMethodViaReflection TryReflect ScalaUDF PythonUDF PythonUDAF PythonUDTF ScalaUDAF ScalaAggregator TypedAggregateExpression "
    "HiveSimpleUDF HiveGenericUDF HiveGenericUDTF HiveUDAFFunction V2ScalarFunction ApplyFunctionExpression V2Aggregator".split())
EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
LINE = re.compile(r"^[\s:+\-]*'?([A-Za-z]\w*)")


class UnsafeSqlError(ValueError):
    """The statement is not a permitted read-only query."""


@dataclass(frozen=True)
class ValidatedQuery:
    sql: str
    referenced_tables: list[str]
    explanation: str
    max_rows: int | None


@dataclass
class QueryResult:
    """Lazy rows plus what is known about the query; ``error`` is set when it failed to analyse."""

    sql: str
    explanation: str
    referenced_tables: list[str]
    columns: list[str] = field(default_factory=list)
    rows: DataFrame | None = None
    duration_ms: float = 0.0
    success: bool = True
    error: str | None = None
    max_rows: int | None = None
    uncapped: DataFrame | None = None

    def is_truncated(self) -> bool:
        """Whether the cap left rows out; reads at most one row beyond it."""
        if self.max_rows is None or self.uncapped is None:
            return False
        return self.uncapped.limit(self.max_rows + 1).count() > self.max_rows


Node = dict  # of a plan: its class, the number of its children, and its fields


def _name(node: Node) -> str:
    return node["class"].rsplit(".", 1)[-1].rstrip("$")


def _words(text: str) -> list[str]:
    """The parts of a name as the tree shows them."""
    return [part.strip().lower() for part in text.strip("[]").split(",")]


def plan_nodes(tree, hides: Callable[[Node], bool] = lambda node: False) -> Iterator[Node]:
    """All nodes and expressions of a plan, those in its fields, subqueries and common tables too. What stands below a node that
    ``hides`` is left out."""
    waiting = [tree]
    while waiting:
        part = waiting.pop()
        if isinstance(part, dict):
            waiting.extend(part.values())
        elif isinstance(part, list) and part and isinstance(part[0], dict) and "class" in part[0]:
            at = 0
            while at < len(part):  # parents come before their children
                node = part[at]
                yield node
                waiting.extend(value for value in node.values() if isinstance(value, (dict, list)))
                at += 1
                if hides(node):
                    left = node["num-children"]
                    while left:
                        left += part[at]["num-children"] - 1
                        at += 1
        elif isinstance(part, list):
            waiting.extend(part)


def _parsed_plan(spark: SparkSession, sql: str) -> tuple[list, str]:
    """The tree that Spark's parser makes of a statement, and its text."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        return json.loads(plan.toJSON()), plan.toString()
    except PySparkException as error:
        raise UnsafeSqlError(f"SQL syntax error: {error}") from error
    except RecursionError as error:
        raise UnsafeSqlError("the statement is nested too deeply") from error


@lru_cache
def _own_functions(application: str) -> frozenset[str]:
    spark = SparkSession.getActiveSession()
    return frozenset(r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()) - UNSAFE_FUNCTIONS


def _refuse_unknown(spark: SparkSession, nodes: list[Node]) -> None:
    functions = _own_functions(spark.sparkContext.applicationId)
    for node in nodes:
        name = _name(node)
        if not node["class"].startswith(EXPRESSIONS) and name not in QUERY_NODES and name not in OPEN_EXPRESSIONS:
            if "UnresolvedIdentifier" in name:
                raise UnsafeSqlError("names must be written out; IDENTIFIER(...) is not permitted")
            raise UnsafeSqlError(f"{name} is not permitted in read-only mode")
        if name == "UnresolvedFunction" and (called := _words(node["nameParts"])[-1]) not in functions:
            raise UnsafeSqlError(f"function {called!r} is not permitted: it is not one of Spark's own, or it calls JVM code")
        if name == "UnresolvedTableValuedFunction" and (called := _words(node["name"])[-1]) not in TABLE_FUNCTIONS:
            raise UnsafeSqlError(f"table function {called!r} is not permitted")
        if name in FOREIGN_CODE:
            raise UnsafeSqlError("functions that call JVM code are not permitted")


def _table_of(node: Node) -> str | None:
    """The catalog's name for a view, or for a table that is read."""
    entry = node.get("desc") or node.get("catalogTable") or node.get("tableMeta")
    return entry["identifier"]["table"].lower() if isinstance(entry, dict) and "identifier" in entry else None


def _check_analysed(df: DataFrame, available: set[str]) -> None:
    """Everything that the analysed plan reads must stand below a permitted view, and everything that it calls outside of
    them must be Spark's own. Functions are known here however they were named."""
    tree = json.loads(df._jdf.queryExecution().analyzed().toJSON())
    for node in plan_nodes(tree, lambda node: _name(node) == "View" and _table_of(node) in available):
        name, table = _name(node), _table_of(node)
        if name in FOREIGN_CODE:
            raise UnsafeSqlError("functions that call JVM code are not permitted")
        if name == "View" and table not in available:
            raise UnsafeSqlError(f"referenced table {table!r} does not exist in the active data sources")
        if not node["num-children"] and not node["class"].startswith(EXPRESSIONS) and name not in HARMLESS_LEAVES and table not in available:
            raise UnsafeSqlError(f"{name} is read, which is none of the active data sources")


def _line_node(line: str) -> str:
    match = LINE.match(line)
    return match.group(1) if match else ""


def _explain(lines: list[str], tables: list[str], max_rows: int | None) -> str:
    shown = ", ".join(f"'{t}'" for t in tables) or "operational tables"
    parts = [f"Queries data from {shown}"]
    limit = max_rows
    phrases = {"Filter": "filters rows by {}", "Aggregate": "aggregates records by {}", "Sort": "orders results by {}"}
    seen: set[str] = set()
    for line in lines:
        node = _line_node(line)
        rest = re.sub(r"^[\s:+\-]*'?\w+\s*", "", line).replace("'", "")
        if node == "GlobalLimit":
            wanted = re.match(r"\d+", rest)
            if wanted and "limit" not in seen:
                limit = int(wanted.group()) if max_rows is None else min(int(wanted.group()), max_rows)
            seen.add("limit")
        elif node in phrases and node not in seen:
            seen.add(node)
            if node == "Aggregate":
                rest = rest.split("], [")[0].lstrip("[")
                if not rest:
                    continue
            elif node == "Sort":
                rest = rest.rsplit("], ", 1)[0].lstrip("[")
            parts.append(phrases[node].format(rest.strip()))
    if limit is not None:
        parts.append(f"caps output to {limit} records")
    return "The query " + ", and ".join(parts) + "."


def validate_sql(spark: SparkSession, sql: str, allowed_tables: list[str] | None = None,
                 max_rows: int | None = MAX_ROWS) -> ValidatedQuery:
    """Check that ``sql`` is one read-only query over known tables; nothing is run. ``max_rows`` None means no cap."""
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise UnsafeSqlError("empty query")
    for word in WRITE_WORDS:
        if re.search(rf"(^|;)\s*{word}\s", text, re.IGNORECASE):
            raise UnsafeSqlError(f"prohibited operation {word!r} in read-only mode")
    text = re.sub(r"(?i)^explain(\s+(extended|formatted|codegen|cost))?\s+", "", text)
    tree, shown = _parsed_plan(spark, text)
    if _name(tree[0]) not in QUERY_NODES:
        raise UnsafeSqlError(f"only SELECT queries can be run in read-only mode, not {_name(tree[0])}")
    nodes = list(plan_nodes(tree))
    _refuse_unknown(spark, nodes)
    known = [t.name.lower() for t in spark.catalog.listTables()]
    available = {t.lower() for t in allowed_tables} if allowed_tables is not None else set(known)
    ctes = {part["_1"].lower() for node in nodes for part in node.get("cteRelations") or []}
    # a CTE that hides a table outside the allow-list could still read it in its own body
    ctes -= {t for t in known if t not in available}
    tables = sorted({".".join(_words(node["multipartIdentifier"])) for node in nodes if _name(node) == "UnresolvedRelation"} - ctes)
    for table in tables:
        if table not in available:
            raise UnsafeSqlError(f"referenced table {table!r} does not exist in the active data sources")
    try:
        _check_analysed(spark.sql(text), available)  # a query is only analysed here
    except PySparkException:
        pass  # it reads nothing then; execution reports the error
    lines = [line for line in shown.splitlines() if line.strip()]
    return ValidatedQuery(text, tables, _explain(lines, tables, max_rows), max_rows)


def execute_safe_query(spark: SparkSession, sql: str, allowed_tables: list[str] | None = None,
                       max_rows: int | None = MAX_ROWS) -> QueryResult:
    """Validated query as a lazy DataFrame of at most ``max_rows`` rows; None means all."""
    checked = validate_sql(spark, sql, allowed_tables, max_rows)
    start = time.monotonic()
    result = QueryResult(sql, checked.explanation, checked.referenced_tables, max_rows=max_rows)
    try:
        result.uncapped = spark.sql(checked.sql)
        result.rows = nan_to_null(result.uncapped if max_rows is None else result.uncapped.limit(max_rows))
        result.columns = result.rows.columns
    except PySparkException as error:
        result.success, result.error = False, str(error)
    result.duration_ms = round((time.monotonic() - start) * 1000, 2)
    return result


def validate_only(spark: SparkSession, sql: str, allowed_tables: list[str] | None = None) -> dict:
    try:
        checked = validate_sql(spark, sql, allowed_tables)
    except UnsafeSqlError as error:
        return {"valid": False, "error": str(error)}
    return {"valid": True, "sanitized_sql": checked.sql if checked.max_rows is None else f"{checked.sql} LIMIT {checked.max_rows}",
            "referenced_tables": checked.referenced_tables, "explanation": checked.explanation}


def validate_formula(spark: SparkSession, formula: str) -> str:
    """A metric formula must be a plain expression: no subquery, no statement."""
    tree, _ = _parsed_plan(spark, f"SELECT {formula} AS v")
    if _name(tree[0]) not in ("Project", "Aggregate"):
        raise UnsafeSqlError("a formula must be a single expression")
    nodes = list(plan_nodes(tree))
    _refuse_unknown(spark, nodes)
    if any(_name(node) in QUERY_NODES and _name(node) not in ("Project", "Aggregate", "OneRowRelation") for node in nodes):
        raise UnsafeSqlError("a formula may not read tables")
    if sum(_name(node) in QUERY_NODES for node in nodes) != len(tree):
        raise UnsafeSqlError("a formula may not hold a query")
    return formula

"""Run registered queries against DuckDB: ``python tests/oracle_check.py [--plain] [--sf DIR] [name-part ...]``.

``--plain`` uses a session with Spark's default settings.
"""

from __future__ import annotations

import importlib
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from pyspark.sql import SparkSession  # noqa: E402

from opsloom.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


CLOCK: list[float] = []  # when Spark's rows had arrived


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) + 0.0
    if isinstance(value, Decimal):
        return ("decimal", str(value))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = tuple(columns[i] for i in order)
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return names, sorted(cells, key=repr)


def compare(spark_df, con, sql):
    """None when equal, else a short account of the difference."""
    got_names, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    CLOCK.append(time.time())
    cursor = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}", len(got)
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 50000 else []
        return f"rows {len(got)} != {len(want)} e.g. {extra}", len(got)
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return f"first difference over {got_names}\n   spark  {g}\n   oracle {w}", len(got)
    return None, len(got)


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    plain = bool(argv) and argv[0] == "--plain"
    argv = argv[1:] if plain else argv
    if argv and argv[0] == "--sf":
        sf_dir, argv = argv[1], argv[2:]
    entry = importlib.import_module("__spark_entry__")
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(part in n for part in argv)]
    if plain:
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    else:
        spark = build_session("oracle-check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    failed = []
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem, rows = compare(df, con, oracles[name])
            else:
                problem, rows = None, len(df.collect())
        except Exception as error:  # report and go on with the next query
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", -1
        took = (CLOCK.pop() if CLOCK else time.time()) - start
        mark = "FAIL" if problem else ("ok  " if name in oracles else "rows")
        if rows == 0:
            mark += " EMPTY"
        print(f"{mark} {name} rows={rows} {took:.2f}s" + (f"\n   {problem}" if problem else ""), flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} passed; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

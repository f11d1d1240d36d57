"""Run registered queries against their DuckDB SQL: ``python tests/oracle_check.py [names]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        name = file.split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return f"{value:.10g}"
    return str(value)


def _family(kind: str) -> str:
    kind = kind.lower()
    for names, family in (
        (("hugeint",), "hugeint"), (("bigint", "long"), "long"), (("int", "integer"), "int"),
        (("double",), "double"), (("varchar", "string"), "string"),
        (("timestamp_ntz", "timestamp"), "timestamp"), (("bool", "boolean"), "boolean"),
        (("date",), "date"),
    ):
        if kind in names:
            return family
    return kind


def _table(columns, types, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    schema = [(columns[i], _family(types[i])) for i in order]
    return schema, sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(spark, name: str, sf_dir: str = SF_DIR) -> str | None:
    """None if the query agrees with its SQL, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    mine = _table(df.columns, [t for _, t in df.dtypes], df.collect())
    relation = connect(sf_dir).sql(entry.oracle_sql()[name])
    theirs = _table(relation.columns, [str(t) for t in relation.types], relation.fetchall())
    if mine[0] != theirs[0]:
        return f"schema {set(mine[0]) ^ set(theirs[0])}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows, expected {len(theirs[1])}"
    wrong = [(a, b) for a, b in zip(mine[1], theirs[1]) if a != b]
    return f"{len(wrong)} of {len(mine[1])} rows differ, first {wrong[0]}" if wrong else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    for query in sys.argv[1:] or entry.queries():
        start = time.time()
        try:
            result = difference(session, query) or "ok"
        except Exception as error:  # report and go on with the next query
            result = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{query:28s} {time.time() - start:6.1f}s  {result}", flush=True)

"""Queries of cases: each row of a table gets one of a list of written cases, the operator runs on
all rows, and the SQL form says what has to come out for each case.

What comes out is written down by hand from the rules, not computed by the operator, so a
case is an example as a unit test has it, over a whole table. The tables hold no CVs, job
descriptions or reports, so their own rows can't reach most branches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import spread
from .registry import ORACLES, QUERIES, Query, table

#: The queries of cases with what has to come out, for tests also where a query of a table has taken the name.
CASES: dict[str, tuple[Query, str]] = {}
KINDS = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}


def _literal(v: object, kind: str) -> str:
    if v is None:
        return f"CAST(NULL AS {KINDS[kind]})"
    text = "'" + str(v).replace("'", "''") + "'" if kind == "string" else str(v).lower() if kind == "boolean" else str(v)
    return f"CAST({text} AS {KINDS[kind]})"


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str, fields: str, inputs: list[tuple]) -> DataFrame:
    """id and the fields of a case, for every row of a table; cases go round by the row's key."""
    cases = spark.createDataFrame([(i, *row) for i, row in enumerate(inputs)], f"case int, {fields}")
    rows = spread(table(spark, sf_dir, name).select(F.col(key).cast("bigint").alias("id")))
    # the cases are a written list of a few rows
    return rows.join(F.broadcast(cases), F.pmod("id", F.lit(len(inputs))).cast("int") == F.col("case")).drop("case")


def case_query(name: str, fields: str, out: str, cases: list[tuple[tuple, list[tuple]]], run: Callable[[DataFrame], DataFrame], source: str = "customer", key: str = "c_custkey") -> None:
    """Register a query: ``run`` maps (id, fields) to (id, out); a case is (its fields, the rows that have to come out)."""
    columns = [c.split(" ") for c in out.split(", ")]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(dealt(spark, sf_dir, source, key, fields, [c for c, _ in cases])).select("id", *[c for c, _ in columns])

    query.__name__ = query.__qualname__ = name
    query.__doc__ = run.__doc__
    rows = [f"({i}, {', '.join(_literal(v, k) for v, (_, k) in zip(row, columns, strict=True))})" for i, (_, wanted) in enumerate(cases) for row in wanted]
    names = ", ".join(c for c, _ in columns)
    CASES[name] = query, f"SELECT CAST({key} AS BIGINT) AS id, {names} FROM {source} JOIN (VALUES {', '.join(rows)}) AS c(dealt, {names}) ON {key} % {len(cases)} = c.dealt"
    QUERIES[name], ORACLES[name] = CASES[name]

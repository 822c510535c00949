"""Small literal tables, for Spark and for SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _value(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return str(x)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression with the rows of a literal table."""
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows) + ")"


def case(value: str, table: list[tuple[str, str]], test: str) -> str:
    """CASE over an ordered table; test has {v} for the value and {k} for a key."""
    return "CASE " + " ".join(f"WHEN {test.format(v=value, k=k)} THEN {_value(v)}" for k, v in table) + " END"

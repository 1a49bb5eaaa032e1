"""A registered query: a DataFrame function, its output columns and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def _spec(columns: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in columns.split(",")]


def present(df: DataFrame, columns: str) -> DataFrame:
    """Project to agreed types: s text, i integer, d date text, b boolean text, fN rounded."""
    out = []
    for name, code in _spec(columns):
        value = F.col(name)
        if code == "i":
            value = value.cast("bigint")
        elif code == "d":
            value = F.date_format(value, "yyyy-MM-dd")
        elif code == "b":
            value = value.cast("boolean").cast("string")
        elif code.startswith("f"):
            value = F.round(value.cast("double"), int(code[1:])) + F.lit(0.0)
        else:
            value = value.cast("string")
        out.append(value.alias(name))
    return df.select(*out)


def present_sql(sql: str, columns: str) -> str:
    out = []
    for name, code in _spec(columns):
        if code == "i":
            value = f"CAST({name} AS BIGINT)"
        elif code == "d":
            value = f"strftime(CAST({name} AS DATE), '%Y-%m-%d')"
        elif code == "b":
            value = f"CASE WHEN {name} THEN 'true' WHEN NOT {name} THEN 'false' END"
        elif code.startswith("f"):
            value = f"round(CAST({name} AS DOUBLE), {code[1:]}) + 0.0::DOUBLE"
        else:
            value = f"CAST({name} AS VARCHAR)"
        out.append(f"{value} AS {name}")
    return f"SELECT {', '.join(out)} FROM ({sql}) AS result"


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}

    def add(self, name: str, columns: str, sql: str | None = None):
        """Register the decorated function under ``name`` with one column spec for both sides."""
        def decorate(function):
            def run(spark: SparkSession, sf: str) -> DataFrame:
                return present(function(spark, sf), columns)

            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = Query(run, present_sql(sql, columns) if sql else None)
            return function
        return decorate

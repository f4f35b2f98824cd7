"""Small made-up tables with the columns that companies, contacts, stories and runs have, for tests of the rules on them.

A query on a fixture gets its tables as DataFrames, and its SQL gets the same rows as common table
expressions, so that both sides read one definition.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Name -> (rows of a SparkSession, SQL).
CASES: dict[str, tuple[Callable[[SparkSession], DataFrame], str]] = {}

_SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]", "array<long>": "BIGINT[]"}


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


@dataclass(frozen=True)
class Fixture:
    name: str
    columns: tuple[tuple[str, str], ...]
    rows: tuple[tuple, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        stamps = [c for c, kind in self.columns if kind == "timestamp_ntz"]
        schema = ", ".join(f"{c} {'string' if c in stamps else kind}" for c, kind in self.columns)
        df = spark.createDataFrame([list(r) for r in self.rows], schema)
        return df.withColumns({c: df[c].cast("timestamp_ntz") for c in stamps})

    @property
    def sql(self) -> str:
        names = ", ".join(c for c, _ in self.columns)
        casts = ", ".join(f"CAST({c} AS {_SQL_TYPES[kind]}) AS {c}" for c, kind in self.columns)
        values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        return f"{self.name} AS (SELECT {casts} FROM (VALUES {values}) AS t({names}))"


def fixture(name: str, columns: str, rows: list[tuple]) -> Fixture:
    """``columns`` as ``name kind, name kind``."""
    parts = tuple(tuple(c.strip().split(" ", 1)) for c in columns.split(","))
    return Fixture(name, parts, tuple(map(tuple, rows)))


def on(*fixtures: Fixture, sql: str):
    """Register a function of DataFrames as a case on these fixtures; ``sql`` follows their common table expressions."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        more = sql.strip()
        opening = next((w for w in ("WITH RECURSIVE ", "WITH ") if more.startswith(w)), "")
        tables = ", ".join(x.sql for x in fixtures)
        CASES[f.__name__] = lambda spark: f(*(x.frame(spark) for x in fixtures)), (opening or "WITH ") + tables + (", " + more[len(opening) :] if opening else "\n" + more)
        return f

    return add

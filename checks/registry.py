"""Named queries with their oracle SQL.

Both sides go through the same presentation: doubles are compared at single
precision (sums of doubles depend on their order in the last bits), dates and
timestamps as text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.prelude import with_tables

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def _present(df: DataFrame) -> DataFrame:
    def show(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            column = column.cast("float").cast("double")
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            column = column.cast("string")
        return column.alias(field.name)

    return df.select(*[show(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None, doubles: str = "", texts: str = "") -> Callable[[Query], Query]:
    """Register a query; ``doubles`` and ``texts`` list the oracle columns to present as above."""
    def register(fn: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        oracle = None
        if sql is not None:
            replaced = [f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in doubles.split()]
            replaced += [f"CAST({c} AS VARCHAR) AS {c}" for c in texts.split()]
            shown = f"* REPLACE ({', '.join(replaced)})" if replaced else "*"
            oracle = with_tables(f"SELECT {shown} FROM (\n{sql.strip()}\n) AS answer")
        ENTRIES[name] = Entry(lambda spark, sf: _present(fn(spark, sf)), oracle)
        return fn

    return register

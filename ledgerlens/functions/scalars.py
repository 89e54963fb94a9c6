"""Column expressions used by several operators (all JVM-side)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DAY_MICROS = 86_400_000_000


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _micros(ts: Column | str) -> Column:
    return F.unix_micros(as_column(ts).cast("timestamp"))


def whole_days(later: Column | str, earlier: Column | str) -> Column:
    """Number of whole 24-hour periods between two instants, rounded down."""
    return F.floor((_micros(later) - _micros(earlier)) / F.lit(_DAY_MICROS)).cast("bigint")


def minus_days(ts: Column | str, days: int) -> Column:
    return as_column(ts) - F.expr(f"INTERVAL '{int(days)}' DAY")


def decade(year: Column | str) -> Column:
    return (F.floor(as_column(year) / 10) * 10).cast("int")


def birth_date(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """Date from three integers; impossible or missing parts give NULL."""
    parts = [as_column(p) for p in (year, month, day)]
    # concat (unlike concat_ws) is NULL as soon as one part is NULL
    text = F.concat(
        F.lpad(parts[0].cast("string"), 4, "0"), F.lit("-"),
        F.lpad(parts[1].cast("string"), 2, "0"), F.lit("-"),
        F.lpad(parts[2].cast("string"), 2, "0"),
    )
    return text.try_cast("date")


def completed_years(start: Column | str, end: Column | str) -> Column:
    """Completed calendar years from ``start`` to ``end``."""
    s, e = as_column(start), as_column(end)
    before_anniversary = (F.month(e) * 100 + F.dayofmonth(e)) < (F.month(s) * 100 + F.dayofmonth(s))
    return (F.year(e) - F.year(s) - before_anniversary.cast("int")).cast("bigint")


def yes_no(c: Column | str) -> Column:
    """1 for yes, 0 for no in any letter case; anything else is NULL."""
    text = F.lower(F.trim(as_column(c).cast("string")))
    return F.when(text == "yes", 1).when(text == "no", 0)


def key_text(c: Column | str) -> Column:
    """Numeric (possibly floating) identifier to its integer text."""
    return as_column(c).cast("bigint").cast("string")


def key_hash(key: Column | str) -> Column:
    """Multiplicative integer hash in [0, 2^32) that other engines can repeat.

    Keys are first reduced modulo 2^31 so the product stays within a bigint.
    """
    reduced = F.pmod(as_column(key).cast("bigint"), F.lit(2_147_483_648))
    return F.pmod(reduced * F.lit(2_654_435_761), F.lit(4_294_967_296))


def lookup(c: Column | str, table: Mapping[str, object]) -> Column:
    """Literal dictionary lookup; absent keys give NULL."""
    source = as_column(c)
    chain = None
    for key, value in table.items():
        chain = F.when(source == key, F.lit(value)) if chain is None else chain.when(source == key, F.lit(value))
    return chain if chain is not None else F.lit(None)


def round_doubles(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round every floating column, leaving the others untouched."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(*[
        F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, floating) else F.col(f.name)
        for f in df.schema.fields
    ])

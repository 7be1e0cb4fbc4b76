"""Registration and rounding shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def registrar() -> tuple[dict, Callable]:
    """A table of queries and the decorator that fills it with (function, SQL twin or None)."""
    found: dict[str, tuple[Callable, str | None]] = {}

    def query(name: str, sql: str | None = None) -> Callable:
        def keep(run: Callable) -> Callable:
            found[name] = (run, sql)
            return run

        return keep

    return found, query


def quick_round(value: Column, digits: int) -> Column:
    """As ``F.round`` of a double, to the bit; it makes a decimal number, which costs more than a pair does, only near a tie and beyond 1e11 units."""
    units = value * 10.0**digits
    clear = (F.abs(units) < 1e11) & (F.abs(units - F.floor(units) - 0.5) > 1e-4)
    return F.when(clear, F.rint(units) / 10.0**digits).otherwise(F.round(value, digits))


def rounded(df: DataFrame, *, digits: int = 6, quick: bool = False, **as_long: object) -> DataFrame:
    """Doubles to ``digits`` (with +0.0 for a negative zero) and 64-bit counts, for comparison between engines.

    ``quick``: by ``quick_round``, for results of very many rows.
    """
    out = []
    for c, t in df.dtypes:
        if t in ("double", "float"):
            value = F.col(c).cast("double")
            out.append(((quick_round(value, digits) if quick else F.round(value, digits)) + F.lit(0.0)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)

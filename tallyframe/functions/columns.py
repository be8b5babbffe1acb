"""Column expressions for weights, guarded division and null-safe keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def names(columns: str | Sequence[str] | None) -> list[str]:
    """Accept one column name, several, or none."""
    if columns is None:
        return []
    return [columns] if isinstance(columns, str) else list(columns)


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.FractionalType) and not isinstance(
        df.schema[name].dataType, T.DecimalType
    )


def number(df: DataFrame, name: str) -> Column:
    """A measure whose products and sums do not overflow: whole numbers become decimals."""
    if isinstance(df.schema[name].dataType, T.IntegralType):
        return df[name].cast("decimal(19,0)")
    return df[name]


def weight(df: DataFrame, w: str) -> Column:
    """The weight where it counts, NULL where it is null or zero; see :func:`number`.

    A negative or infinite weight, or NaN, is an error when the row is read.
    """
    col = number(df, w)
    bad = col < 0
    if is_floating(df, w):
        bad = bad | F.isnan(col) | (col == float("inf"))
    message = F.concat(F.lit(f"weight column {w} holds "), col.cast("string"))
    return F.when(bad, F.raise_error(message)).when(col > 0, col)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as a double, NULL on a zero or missing denominator."""
    bottom = denominator.cast("double")
    return numerator.cast("double") / F.nullif(bottom, F.lit(0.0))


def same_keys(keys: Sequence[str], left: str, right: str) -> Column:
    """Join condition between two aliased sides that treats NULL keys as equal."""
    return reduce(
        lambda a, b: a & b,
        [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys],
    )


def label(keys: dict[str, Column]) -> Column:
    """Key values as readable text, for error messages."""
    parts = [
        F.concat(F.lit(f"{name}="), F.coalesce(col.cast("string"), F.lit("NULL")))
        for name, col in keys.items()
    ]
    return F.concat_ws(", ", *parts)

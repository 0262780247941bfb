"""Comparison of result sets as multisets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(df: DataFrame, digits: int | None) -> DataFrame:
    """Fractions rounded, so that equal up to a tolerance is equal."""
    if digits is None:
        return df
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f"`{f.name}`") for f in df.schema.fields])


def difference(left: DataFrame, right: DataFrame, digits: int | None = None) -> DataFrame:
    """Rows that ``left`` has more often than ``right``, as often as it has more."""
    return rounded(left, digits).exceptAll(rounded(right, digits))


def same_rows(left: DataFrame, right: DataFrame, digits: int | None = 6) -> bool:
    """Whether two results are equal as multisets, by columns of the same names in any order."""
    if sorted(left.columns) != sorted(right.columns):
        return False
    names: Sequence[str] = sorted(left.columns)
    a, b = left.select(*names), right.select(*names)
    return difference(a, b, digits).isEmpty() and difference(b, a, digits).isEmpty()

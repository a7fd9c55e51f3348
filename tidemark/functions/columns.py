"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .fixed import BLANK_WORDS, ZERO

_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)\s*$"
_DATE_FORMATS = (
    "M/d/yyyy", "yyyy/M/d", "d.M.yyyy", "yyyyMMdd", "yyyy-MM", "MMM yyyy", "MMMM yyyy", "d-MMM-yyyy", "d MMM yyyy", "d MMMM yyyy"
)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def to_number(col: Column, dtype: T.DataType | None = None) -> Column:
    """Text or number to double; what is not a number becomes null (NaN included).

    With a numeric ``dtype`` the value is only cast, and stays inside generated code.
    """
    if isinstance(dtype, T.NumericType):
        value = col.cast("double")
        return F.when(~F.isnan(value), value) if isinstance(dtype, (T.DoubleType, T.FloatType)) else value
    text = col.cast("string")
    value = F.when(F.lower(text).rlike(_NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def number(df: DataFrame, name: str) -> Column:
    return to_number(F.col(name), df.schema[name].dataType)


def number_or(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """A number from a column that may be absent."""
    if name not in df.columns:
        return F.lit(float(default))
    return F.coalesce(number(df, name), F.lit(float(default)))


def to_day(col: Column, dtype: T.DataType | None = None) -> Column:
    """Date, timestamp, text or a whole number such as 20250131 to DATE; what is unreadable becomes null."""
    if dtype is not None and not is_text(dtype) and not isinstance(dtype, T.NumericType):
        return col.cast("date")
    text = F.trim(col.cast("string"))
    tries = [F.try_to_timestamp(text)]
    tries += [F.try_to_timestamp(text, F.lit(fmt)) for fmt in _DATE_FORMATS]
    return F.coalesce(*tries).cast("date")


def clean_text(col: Column) -> Column:
    text = F.trim(col.cast("string"))
    return F.when((text != "") & ~F.lower(text).isin(BLANK_WORDS), text)


def contains_any(col: Column, tokens) -> Column:
    found = F.lit(False)
    for token in tokens:
        found = found | col.contains(token)
    return found


def is_zero(col: Column) -> Column:
    return col <= F.lit(ZERO)


def is_finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != F.lit(float("inf")))


def at_least(col: Column, floor: float) -> Column:
    return F.greatest(col, F.lit(float(floor)))

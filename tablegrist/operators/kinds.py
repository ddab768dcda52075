"""Column kinds and argument checks shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TEXT, NUMBER, DATETIME, OTHER = "text", "number", "datetime", "other"


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    if isinstance(dtype, T.NumericType):
        return NUMBER
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    return OTHER


def column_kinds(df: DataFrame) -> dict[str, str]:
    """Column name to text / number / datetime / other, in schema order."""
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def columns_of(df: DataFrame, kind: str, skip: Iterable[str] = ()) -> list[str]:
    out = set(skip)
    return [n for n, k in column_kinds(df).items() if k == kind and n not in out]


def require_column(df: DataFrame, name: str | None, role: str) -> str:
    if name is None or name not in df.columns:
        raise ValueError(f"{role} '{name}' not found. Available: {df.columns}")
    return name

"""Scalar and grouped metrics, trends and top-n rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegrist.operators.kinds import NUMBER, kind_of, require_column

METRICS = ("mean", "sum", "count", "min", "max")
OPS = (*METRICS, "top_n", "trend")
DEFAULT_TOP = 10


def _metric(op: str, c: Column) -> Column:
    return {
        "mean": F.avg(c),
        "sum": F.coalesce(F.sum(c), F.lit(0)),
        "count": F.count(c),
        "min": F.min(c),
        "max": F.max(c),
    }[op]


def compute(
    df: DataFrame,
    op: str,
    column: str,
    group_by: str | None = None,
    n: int | None = None,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """One metric of one column.

    * mean/sum/count/min/max: ``(metric, value)``, or ``(group, column)`` per
      non-NULL group, in group order
    * trend: mean per value of ``group_by``, in its order
    * top_n: the whole rows with the n largest values (default 10)
    """
    require_column(df, column, "Column")
    if op not in OPS:
        raise ValueError(f"Unknown metric '{op}'. Available: {list(OPS)}")
    c = F.col(f"`{column}`")
    numeric = kind_of(df.schema[column].dataType) == NUMBER
    if op in ("mean", "sum", "trend", "top_n") and not numeric:
        raise ValueError(f"'{op}' needs a numeric column, '{column}' is not")
    if op == "top_n":
        order = [c.desc_nulls_last(), *[F.col(f"`{t}`").asc_nulls_last() for t in tie_break]]
        return df.orderBy(*order).limit(n or DEFAULT_TOP)
    if op == "trend":
        if group_by is None:
            raise ValueError("'trend' needs group_by, usually a date or period column")
        op = "mean"
    if group_by is None:
        value = _metric(op, c)
        if numeric or op == "count":
            value = value.cast("double")
        return df.agg(value.alias("value")).select(F.lit(op).alias("metric"), "value")
    require_column(df, group_by, "group_by column")
    key = F.col(f"`{group_by}`")
    return (
        df.filter(key.isNotNull())
        .groupBy(key)
        .agg(_metric(op, c).alias(column))
        .orderBy(key)
    )

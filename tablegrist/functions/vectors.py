"""Arithmetic on ``array<float>`` / ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _fold(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(_fold(F.transform(_col(v), lambda x: x.cast("double") * x.cast("double"))))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(
        _fold(
            F.zip_with(
                _col(a),
                _col(b),
                lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")),
            )
        )
    )


def l2_normalise(v: Column | str, norm: Column | str) -> Column:
    """``v`` scaled to unit length, given its norm as a column (so the norm is
    computed once per row); a zero vector stays as it is."""
    n = _col(norm)
    return F.transform(_col(v), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))

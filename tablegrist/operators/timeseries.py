"""Trailing-window statistics and growth per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegrist.functions.text import canonical_name
from tablegrist.operators.kinds import DATETIME, columns_of
from tablegrist.session import small_table

# Window labels and their days; growth only on the longest.
WINDOWS = {"30d": 30, "90d": 90, "365d": 365}
GROWTH_WINDOW = "365d"
DAYS_PER_YEAR = 365.25
WINDOW_SCHEMA = (
    "canonical_id string, window string, column string, position int, mean double, std double, min double, max double, "
    "count bigint, cagr double"
)


def detect_timeseries(df: DataFrame, name_col: str) -> str | None:
    """First datetime column in which some entity has more than one moment.
    Two moments differ exactly when minimum and maximum do, so no distinct
    count is needed."""
    dates = columns_of(df, DATETIME)
    if name_col not in df.columns or not dates:
        return None
    entity = F.col(f"`{name_col}`")
    spread = [
        (F.max(F.col(f"`{d}`")) > F.min(F.col(f"`{d}`"))).alias(f"s{i}") for i, d in enumerate(dates)
    ]
    got = (
        df.filter(entity.isNotNull())
        .groupBy(canonical_name(entity).alias("canonical_id"))
        .agg(*spread)
        .agg(*[F.bool_or(f"s{i}").alias(f"s{i}") for i in range(len(dates))])
        .first()
    )
    return next((d for i, d in enumerate(dates) if got[f"s{i}"]), None)


def _entity_rows(df: DataFrame, name_col: str, columns: Sequence[str]) -> DataFrame:
    entity = F.col(f"`{name_col}`")
    return (
        df.filter(entity.isNotNull())
        .select(canonical_name(entity).alias("canonical_id"), *[f"`{c}`" for c in columns])
        .filter(F.col("canonical_id") != "")
    )


def _growth(n: Column, first: Column, last: Column, days: Column) -> Column:
    ok = (n >= 2) & (first > 0) & (days > 0) & (last >= 0)
    return F.when(ok, F.pow(last / first, F.lit(DAYS_PER_YEAR) / days) - 1)


def trailing_windows(
    df: DataFrame,
    name_col: str,
    date_col: str,
    value_cols: Sequence[str],
    order_by: str,
) -> DataFrame:
    """``(canonical_id, window, column, mean, std, min, max, count, cagr)``.

    Windows end at the latest moment of the whole table (cutoff included) and
    need two rows. Rows within the longest cutoff, which is a scan filter, become
    a row per value column; all windows of an entity and column are one hash
    aggregate, so any number of columns has the same plan. An integral ordinal is
    put behind the moment in one number, which orders first and last value; an
    ordinal of another type is compared as it is."""
    if not value_cols:
        return small_table(df.sparkSession, [], WINDOW_SCHEMA)
    columns = list(dict.fromkeys([date_col, order_by, *value_cols]))
    d = F.col(f"`{date_col}`")
    # One value, put into the plan as a literal so that the cutoff prunes files.
    latest = (
        _entity_rows(df, name_col, [date_col])
        .agg(F.unix_micros(F.max(d).cast("timestamp")).alias("at"))
        .first()["at"]
    )
    anchor = F.timestamp_micros(F.lit(latest).cast("bigint"))

    def within(days: int) -> Column:
        return d >= anchor - F.make_interval(days=F.lit(days))

    # The cutoff comes before the names are normalised.
    recent = _entity_rows(df.filter(within(max(WINDOWS.values()))), name_col, columns).select(
        "*", *[within(days).alias(f"in_{w}") for w, days in WINDOWS.items()]
    )
    values = F.array(*[
        F.struct(F.lit(i).alias("position"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(value_cols)
    ])
    moment = F.unix_micros(d.cast("timestamp"))
    o = F.col(f"`{order_by}`")
    if isinstance(df.schema[order_by].dataType, T.IntegralType):
        at = moment.cast("decimal(20,0)") * F.lit(str(2**64)).cast("decimal(20,0)") + o.cast("decimal(20,0)")
    else:
        at = F.struct(moment, o)
    long = recent.select(
        "canonical_id", moment.alias("moment"), at.alias("at"), *[f"in_{w}" for w in WINDOWS], F.inline(values)
    )
    seen = F.col("v").isNotNull() & F.col("moment").isNotNull()
    when_seen = lambda c: F.when(seen, F.col(c))
    aggs = [
        F.min_by("v", when_seen("at")).alias("first"),
        F.max_by("v", when_seen("at")).alias("last"),
        F.floor((F.max(when_seen("moment")) - F.min(when_seen("moment"))) / F.lit(86_400_000_000)).alias("days"),
    ]
    for w in WINDOWS:
        x = F.when(F.col(f"in_{w}"), F.col("v"))
        aggs += [
            F.count_if(F.col(f"in_{w}")).alias(f"rows_{w}"),
            F.count(x).alias(f"n_{w}"),
            F.avg(x).alias(f"mean_{w}"),
            F.stddev_pop(x).alias(f"std_{w}"),
            F.min(x).alias(f"min_{w}"),
            F.max(x).alias(f"max_{w}"),
        ]
    per = long.groupBy("canonical_id", "position").agg(*aggs)
    parts = []
    for w in WINDOWS:
        n = F.col(f"n_{w}")
        growth = _growth(n, F.col("first"), F.col("last"), F.col("days")) if w == GROWTH_WINDOW else F.lit(None)
        entry = F.struct(
            F.lit(w).alias("window"),
            F.get(F.array(*[F.lit(c) for c in value_cols]), F.col("position")).alias("column"),
            "position",
            F.col(f"mean_{w}").alias("mean"),
            F.col(f"std_{w}").alias("std"),
            F.col(f"min_{w}").alias("min"),
            F.col(f"max_{w}").alias("max"),
            n.alias("count"),
            growth.cast("double").alias("cagr"),
        )
        parts.append(F.when((F.col(f"rows_{w}") >= 2) & (n > 0), entry))
    return per.select("canonical_id", F.inline(F.array_compact(F.array(*parts))))


def window_stats(windows: DataFrame, file: str) -> DataFrame:
    """One row per (entity, window): stats map and its sentence."""
    sentence = F.concat(
        F.format_string(
            "%s mean=%.4f std=%.4f min=%.4f max=%.4f", "column", "mean", "std", "min", "max"
        ),
        F.when(F.col("cagr").isNotNull(), F.format_string(" cagr=%.4f", "cagr")).otherwise(F.lit("")),
    )
    entry = F.struct(
        "position", "column", F.struct("mean", "std", "min", "max", "count", "cagr").alias("stats"),
        sentence.alias("sentence"),
    )
    packed = windows.groupBy("canonical_id", "window").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return packed.select(
        "canonical_id",
        "window",
        F.map_from_entries(
            F.transform("e", lambda x: F.struct(x["column"], x["stats"]))
        ).alias("stats"),
        F.concat(
            F.lit("Time window "), F.col("window"), F.lit(" for "), F.col("canonical_id"),
            F.lit(f" in {file}: "),
            F.array_join(F.transform("e", lambda x: x["sentence"]), "; "), F.lit("."),
        ).alias("text"),
    )

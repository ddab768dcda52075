"""Table profiles: shape, value counts, enumerations, descriptions, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegrist.operators.kinds import DATETIME, NUMBER, TEXT, column_kinds, columns_of
from tablegrist.operators.ranks import exact_quantiles, value_at
from tablegrist.session import cut_lineage, small_table

ENUM_MIN, PART_VALUES = 2, 500
NAME_SHARE = 0.8
QUARTILES = (0.25, 0.5, 0.75)
FREQUENCY_SCHEMA = "column string, value string, n bigint"


def shape(df: DataFrame, table: str) -> DataFrame:
    """One row per column: position, kind, rows of the table, non-NULL cells."""
    kinds = column_kinds(df)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(c).alias("column"),
                    F.lit(k).alias("kind"),
                    F.count(F.col(f"`{c}`")).alias("filled"),
                )
                for i, (c, k) in enumerate(kinds.items())
            ]
        ).alias("cols"),
    )
    return counts.select(F.lit(table).alias("table"), "rows", F.inline("cols"))


def value_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` over the non-NULL cells, one shuffle for all
    columns, counts combined before it."""
    if not columns:
        return small_table(df.sparkSession, [], FREQUENCY_SCHEMA)
    cells = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
                    for c in columns
                ]
            )
        ).alias("cell")
    ).select("cell.column", "cell.value")
    return (
        cells.filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_values(frequencies: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent values per column, ties by value."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (
        frequencies.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def enumerations(
    df: DataFrame,
    table: str,
    columns: Sequence[str] | None = None,
    low: int = ENUM_MIN,
    part_values: int = PART_VALUES,
    high: int | None = None,
) -> DataFrame:
    """Sorted distinct values of every text column with ``low`` of them or more,
    a longer list in numbered parts of ``part_values``. With ``high``, columns
    with more values are left out.

    Values are placed by range: they are sorted in slices of the order, and a
    value's number is its place in the slice plus the sizes of the slices before,
    so no column is sorted in one task."""
    columns = list(columns) if columns is not None else columns_of(df, TEXT)
    values = value_frequencies(df, columns).select("column", "value")
    sliced = cut_lineage(
        values.repartitionByRange("column", "value").withColumn("_slice", F.spark_partition_id())
    )
    sizes = sliced.groupBy("column", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("column").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("column")
    sizes = sizes.select(
        "column", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("n_values"),
    ).filter(F.col("n_values") >= low)
    if high is not None:
        sizes = sizes.filter(F.col("n_values") <= high)
    within = Window.partitionBy("column", "_slice").orderBy("value")
    placed = sliced.join(sizes, ["column", "_slice"]).withColumn(
        "_place", F.col("_before") + F.row_number().over(within) - 1
    )
    parts = placed.groupBy(
        "column", "n_values", (F.floor(F.col("_place") / part_values) + 1).cast("int").alias("part")
    ).agg(F.sort_array(F.collect_list("value")).alias("values"))
    n_parts = F.ceil(F.col("n_values") / part_values)
    which = F.when(
        n_parts > 1,
        F.concat(F.lit(", part "), F.col("part").cast("string"), F.lit(" of "), n_parts.cast("string")),
    ).otherwise("")
    return parts.select(
        "column",
        "n_values",
        "part",
        "values",
        F.concat(
            F.lit("All distinct values in column '"),
            F.col("column"),
            F.lit(f"' from {table} ("),
            F.col("n_values").cast("string"),
            F.lit(" total"),
            which,
            F.lit("): "),
            F.array_join("values", ", "),
            F.lit("."),
        ).alias("text"),
    )


def pick_name_column(df: DataFrame, share: float = NAME_SHARE) -> str | None:
    """First text column with at least two values of which ``share`` are
    distinct. One sketch pass (standard error under 1 %) settles the clear
    columns; only a column within a tenth of the limit is counted exactly."""
    columns = columns_of(df, TEXT)
    if not columns:
        return None
    aggs = []
    for i, c in enumerate(columns):
        q = f"`{c}`"
        aggs += [
            F.count(q).alias(f"n{i}"),
            F.hll_sketch_estimate(F.hll_sketch_agg(F.col(q), F.lit(14))).alias(f"d{i}"),
            (F.min(q) != F.max(q)).alias(f"two{i}"),
        ]
    got = df.agg(*aggs).first()
    for i, c in enumerate(columns):
        n = got[f"n{i}"]
        if not n or not got[f"two{i}"]:
            continue
        guess = got[f"d{i}"] / n
        if guess < share - 0.1:
            continue
        if guess >= share + 0.1 or _exact_share(df, c, n) >= share:
            return c
    return None


def _exact_share(df: DataFrame, column: str, n: int) -> float:
    return df.agg(F.count_distinct(F.col(f"`{column}`"))).first()[0] / n


def describe_numbers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles, maximum."""
    columns = list(columns) if columns is not None else columns_of(df, NUMBER)
    spark = df.sparkSession
    schema = (
        "column string, count bigint, mean double, std double, min double, "
        "p25 double, p50 double, p75 double, max double"
    )
    if not columns:
        return small_table(spark, [], schema)
    basics = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(F.col(f"`{c}`")).alias("count"),
            F.avg(F.col(f"`{c}`")).alias("mean"),
            F.stddev_samp(F.col(f"`{c}`")).alias("std"),
            F.min(F.col(f"`{c}`")).cast("double").alias("min"),
            F.max(F.col(f"`{c}`")).cast("double").alias("max"),
        )
        for c in columns
    ]
    # Column statistics are one row per column, so they may be held here.
    stats = df.agg(F.array(*basics).alias("s")).first()["s"]
    counts = {r["column"]: r["count"] for r in stats}
    quartiles = exact_quantiles(df, counts, QUARTILES)
    return small_table(spark, [
            (r["column"], r["count"], r["mean"], r["std"], r["min"], *quartiles[r["column"]], r["max"])
            for r in stats
        ],
        schema,
    )


def date_ranges(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """First and last moment of every datetime column."""
    columns = list(columns) if columns is not None else columns_of(df, DATETIME)
    if not columns:
        return small_table(df.sparkSession, [], "column string, lo timestamp, hi timestamp")
    ends = [
        F.struct(
            F.lit(c).alias("column"),
            F.min(F.col(f"`{c}`")).cast("timestamp").alias("lo"),
            F.max(F.col(f"`{c}`")).cast("timestamp").alias("hi"),
        )
        for c in columns
    ]
    return df.agg(F.array(*ends).alias("e")).select(F.inline("e")).filter(F.col("lo").isNotNull())


def head_middle_tail(df: DataFrame, order_by: str) -> DataFrame:
    """Sample of a table by its ordinal column: every row up to 10 rows, else
    the first and last five, and five from the middle above 30. Three bounded
    top-k reads; the middle starts at an order statistic, not at a row number
    over the sorted table."""
    o = F.col(f"`{order_by}`")
    n = df.count()
    part = F.lit
    if n <= 10:
        return df.withColumn("sample", part("all"))
    head = df.orderBy(o.asc()).limit(5).withColumn("sample", part("head"))
    tail = df.orderBy(o.desc()).limit(5).withColumn("sample", part("tail"))
    out = head.unionByName(tail)
    if n > 30:
        start = n // 2 - 2
        at = value_at(df, order_by, start)
        # Rows that share the value but come before the middle are passed over.
        skip = start - df.filter(o < at).count()
        middle = df.filter(o >= at).orderBy(o.asc()).offset(skip).limit(5)
        out = out.unionByName(middle.withColumn("sample", part("middle")))
    return out

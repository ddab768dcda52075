"""One question against many tables at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegrist.functions import questions as Q
from tablegrist.functions.text import name_tokens
from tablegrist.operators.kinds import NUMBER, columns_of
from tablegrist.operators.query import filter_rows, query_table
from tablegrist.session import cut_lineage, small_table

SOURCE = "Source File"


def column_catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, column, position)`` of every numeric column, from the schemas."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (t, c, i) for t, df in tables.items() for i, c in enumerate(columns_of(df, NUMBER))
    ]
    return small_table(spark, rows, "table string, column string, position int")


def resolve_columns(questions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``(query_id, table, column, score)``: the numeric column of each table a
    question means. Score is the share of column-name tokens the question holds
    plus a thousandth of their number; ties go to the earlier column, no shared
    token gives no row. One equi-join on the token."""
    asked = questions.select("query_id", F.explode(name_tokens("question")).alias("token"))
    named = catalogue.withColumn("tokens", name_tokens("column")).select(
        "table", "column", "position", F.size("tokens").alias("n"), F.explode("tokens").alias("token")
    )
    shared = (
        asked.join(named, "token")
        .groupBy("query_id", "table", "column", "position", "n")
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    score = F.col("hits") / F.col("n") + F.lit(0.001) * F.col("hits")
    best = Window.partitionBy("query_id", "table").orderBy(F.desc("score"), F.asc("position"))
    return (
        shared.withColumn("score", score)
        .withColumn("_rank", F.row_number().over(best))
        .filter(F.col("_rank") == 1)
        .select("query_id", "table", "column", "score")
    )


@dataclass
class ThresholdAnswer:
    """Rows of a threshold question over every table with a fitting column."""

    op: str
    value: float
    columns: dict[str, str]  # table -> column
    rows: DataFrame
    counts: DataFrame  # (table, column, rows); tables without a hit included


def threshold_search(
    question: str, tables: dict[str, DataFrame], order_by: dict[str, str], limit: int | None = None
) -> ThresholdAnswer | None:
    """Filter all tables by the threshold a question states, or None when the
    question states none or no table has a fitting column. With ``limit``, at
    most so many rows per table in its row order; the counts are of all rows
    either way. With two or more contributing tables every row carries its
    source, and the columns are those of the contributing tables."""
    if not tables:
        return None
    spark = next(iter(tables.values())).sparkSession
    # Reading one question and the schemas: a handful of values.
    asked = small_table(spark, [(0, question)], "query_id int, question string")
    plan = asked.select(*[c.alias(n) for n, c in Q.plan_columns("question").items()]).first()
    if plan["intent"] != "numeric_threshold":
        return None
    op, value = plan["threshold_op"], plan["threshold_value"]
    fits = {r["table"]: r["column"] for r in resolve_columns(asked, column_catalogue(tables)).collect()}
    columns = {t: fits[t] for t in tables if t in fits}
    if not columns:
        return None
    filters = {t: [{"column": c, "op": op, "value": value}] for t, c in columns.items()}
    counting = [
        filter_rows(tables[t], filters[t]).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(t).alias("table"), F.lit(c).alias("column"), "rows"
        )
        for t, c in columns.items()
    ]
    # One number per table.
    counted = {r["table"]: r["rows"] for r in reduce(DataFrame.unionByName, counting).collect()}
    counts = small_table(
        spark, [(t, c, counted[t]) for t, c in columns.items()], "table string, column string, rows bigint"
    )
    hits = {
        t: filter_rows(tables[t], filters[t]) if limit is None
        else query_table(tables[t], filters[t], sort_by=order_by[t], sort_desc=False, limit=limit)
        for t in columns
    }
    contributing = [t for t in columns if counted[t]] or list(columns)
    if len(contributing) == 1:
        return ThresholdAnswer(op, value, columns, hits[contributing[0]], counts)
    pieces = [hits[t].withColumn(SOURCE, F.lit(t)) for t in contributing]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pieces)
    rows = rows.select(F.col(SOURCE), *[F.col(f"`{c}`") for c in rows.columns if c != SOURCE])
    return ThresholdAnswer(op, value, columns, rows, counts)


def threshold_hits(questions: DataFrame, tables: dict[str, DataFrame], order_by: dict[str, str]) -> DataFrame:
    """``(query_id, table, column, row, value)`` for every row that a question of
    ``questions(query_id, question)`` with a threshold asks for, in each table
    with a fitting column; ``row`` is the table's ``order_by`` value as text.

    The numeric cells of all tables are dealt into slices by column and value, with
    the row to part equal values, so neither a long column nor a frequent value
    fills a task. A question is compared with the ends of its column's slices and
    then with the cells of those slices only that its threshold leaves open."""
    plans = questions.select("query_id", *[c.alias(n) for n, c in Q.plan_columns("question").items()])
    plans = plans.filter("intent = 'numeric_threshold'").select("query_id", "threshold_op", "threshold_value")
    asked = resolve_columns(questions, column_catalogue(tables)).join(plans, "query_id").drop("score")
    cells = sliced_cells(tables, order_by)
    low, high = F.col("low"), F.col("high")
    ends = cells.groupBy("slice", "table", "column").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    # A slice has a hit only if its better end is one.
    best = F.when(F.col("threshold_op").isin(">", ">="), high).when(F.col("threshold_op").isin("<", "<="), low)
    limit = F.col("threshold_value")
    reached = F.when(F.col("threshold_op") == "==", limit.between(low, high)).otherwise(_holds(best))
    open_slices = asked.join(ends, ["table", "column"]).filter(reached).drop("low", "high")
    return cells.join(open_slices, ["slice", "table", "column"]).filter(_holds(F.col("value"))).select(
        "query_id", "table", "column", "row", "value"
    )


def _holds(v: Column) -> Column:
    """Whether a value meets the threshold beside it."""
    limit, op = F.col("threshold_value"), F.col("threshold_op")
    return (
        ((op == ">") & (v > limit)) | ((op == ">=") & (v >= limit)) | ((op == "<") & (v < limit))
        | ((op == "<=") & (v <= limit)) | ((op == "==") & (v == limit))
    )


def sliced_cells(tables: dict[str, DataFrame], order_by: dict[str, str]) -> DataFrame:
    """``slice``, ``table``, ``column``, ``row`` and ``value`` of the filled cells of
    all numeric columns, written in slices of consecutive values."""
    spark = next(iter(tables.values())).sparkSession
    cells = small_table(spark, [], "table string, row string, column string, value double")
    for t, df in tables.items():
        numbers = columns_of(df, NUMBER)
        if numbers:
            parts = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in numbers]
            cells = cells.unionByName(df.select(
                F.lit(t).alias("table"), F.col(f"`{order_by[t]}`").cast("string").alias("row"), F.inline(F.array(*parts))
            ))
    dealt = cells.filter("value is not null").repartitionByRange("table", "column", "value", "row")
    return cut_lineage(dealt.withColumn("slice", F.spark_partition_id()))

"""Cell grids of extracted tables.

A grid set is one frame ``(table_id, row, cells array<string>)`` with 0-based
rows. A row always fits one record, a table need not: per-table facts are
small aggregates joined back, and rows are renumbered block by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegrist.functions.text import NOT_BLANK, WHITESPACE_RUN, strip

MAX_EMPTY_SHARE = 0.7
MAX_TITLE_ROWS = 3
ROWS_PER_BLOCK = 4096
ROWS_PER_TEXT = 10_000


def clean_cell(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WHITESPACE_RUN, " "))


def _has_text(c: Column) -> Column:
    """Whether anything is left of a raw cell once it is cleaned."""
    return F.coalesce(c.rlike(NOT_BLANK), F.lit(False))


def clean_grids(grids: DataFrame) -> DataFrame:
    """Folded cells, without empty rows and columns, padded to one width, rows
    renumbered 0, 1, 2… within their table.

    What each table keeps is found from the raw cells, block of rows by block:
    how many rows stay and which columns hold text. Rows are then ranked inside
    their block and shifted by the blocks before, so no task holds a table, and
    cells are cleaned once."""
    block = F.floor(F.col("row") / ROWS_PER_BLOCK).alias("_block")
    rows = grids.filter(F.exists("cells", _has_text)).select("table_id", "row", "cells", block)
    marked = F.array_compact(F.transform("cells", lambda c, i: F.when(_has_text(c), i)))
    blocks = (
        rows.select("table_id", "_block", marked.alias("_filled"))
        .groupBy("table_id", "_block")
        .agg(F.count(F.lit(1)).alias("_n"), F.flatten(F.collect_set("_filled")).alias("_filled"))
    )
    before = Window.partitionBy("table_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "table_id", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    columns = (
        blocks.select("table_id", F.explode(F.array_distinct("_filled")).alias("_pos"))
        .groupBy("table_id")
        .agg(F.sort_array(F.collect_set("_pos")).alias("_keep"))
    )
    rank = F.row_number().over(Window.partitionBy("table_id", "_block").orderBy("row"))
    return (
        rows.withColumn("_rank", rank)
        .join(offsets.join(columns, "table_id"), ["table_id", "_block"])
        .select(
            "table_id",
            (F.col("_offset") + F.col("_rank") - 1).cast("bigint").alias("row"),
            F.transform("_keep", lambda i: clean_cell(F.get("cells", i))).alias("cells"),
        )
    )


def grid_facts(grids: DataFrame) -> DataFrame:
    """Rows, columns and share of empty cells per table."""
    return grids.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.size("cells")).alias("columns"),
        (
            F.sum(F.size(F.filter("cells", lambda c: c == ""))) / F.nullif(F.sum(F.size("cells")), F.lit(0))
        ).alias("empty_share"),
    )


def valid_grids(grids: DataFrame) -> DataFrame:
    """Only tables of at least 2 x 2 with at most 70 % empty cells."""
    good = grid_facts(grids).filter(
        (F.col("rows") >= 2) & (F.col("columns") >= 2) & (F.col("empty_share") <= MAX_EMPTY_SHARE)
    )
    return grids.join(good.select("table_id"), "table_id", "left_semi")


def _filled(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: strip(c) != ""))


def strip_titles(grids: DataFrame) -> DataFrame:
    """Drop up to three sparse title rows from the top of each table: while
    more than two rows remain, row 0 is under half filled and row 1 has more.
    Tables under 2 x 2 or wholly empty go away."""
    filled = _filled(F.col("cells"))
    facts = grids.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.max(F.size("cells")).alias("_width"),
        F.max(filled).alias("_most"),
        *[F.max(F.when(F.col("row") == i, filled)).alias(f"_f{i}") for i in range(MAX_TITLE_ROWS + 1)],
    ).filter((F.col("_rows") >= 2) & (F.col("_width") >= 2) & (F.col("_most") > 0))

    def goes(i: int) -> Column:
        top, below = F.col(f"_f{i}"), F.col(f"_f{i + 1}")
        return (F.col("_rows") - i > 2) & (top * 2 < F.col("_width")) & (below > top)

    drop = F.when(~goes(0), 0).when(~goes(1), 1).when(~goes(2), 2).otherwise(3)
    return (
        grids.join(facts.select("table_id", "_width", drop.alias("_drop")), "table_id")
        .filter(F.col("row") >= F.col("_drop"))
        .select(
            "table_id",
            (F.col("row") - F.col("_drop")).alias("row"),
            F.concat(
                "cells", F.array_repeat(F.lit(""), F.col("_width") - F.size("cells"))
            ).alias("cells"),
        )
    )


def header_names(cells: Column) -> Column:
    """Header cells made usable: blanks become ``col_<i>`` when at least half
    are filled, and a repeated name gets ``_2``, ``_3``…"""
    dense = _filled(cells) * 2 >= F.size(cells)
    named = F.transform(
        cells,
        lambda c, i: F.when((strip(c) == "") & dense, F.concat(F.lit("col_"), (i + 1).cast("string"))).otherwise(
            strip(c)
        ),
    )

    def numbered(c: Column, i: Column) -> Column:
        nth = F.size(F.filter(F.slice(named, F.lit(1), i + 1), lambda o: o == c))
        return F.when((c != "") & (nth > 1), F.concat(c, F.lit("_"), nth.cast("string"))).otherwise(c)

    return F.transform(named, numbered)


def fix_headers(grids: DataFrame) -> DataFrame:
    return grids.withColumn(
        "cells", F.when(F.col("row") == 0, header_names(F.col("cells"))).otherwise(F.col("cells"))
    )


def pipe_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: strip(F.coalesce(c, F.lit("")))), " | "), F.lit(" |\n"))


def pipe_tables(grids: DataFrame) -> DataFrame:
    """``(table_id, part, text)``: each table as pipe-separated text. A table is
    one text; only beyond ``ROWS_PER_TEXT`` rows does it go on in further parts,
    which together are the whole table."""
    rule = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: F.lit("---")), " | "), F.lit(" |\n"))
    line = F.when(F.col("row") == 0, F.concat(pipe_row(F.col("cells")), rule)).otherwise(
        pipe_row(F.col("cells"))
    )
    part = F.floor(F.col("row") / ROWS_PER_TEXT)
    return (
        grids.select("table_id", part.alias("part"), F.struct("row", line.alias("line")).alias("l"))
        .groupBy("table_id", "part")
        .agg(
            F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["line"]), "").alias("text")
        )
    )


def csv_line(cells: Column) -> Column:
    """Comma-separated line; a cell is quoted only where it must be."""
    quoted = F.transform(
        cells,
        lambda c: F.when(
            c.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        ).otherwise(c),
    )
    return F.array_join(quoted, ",")

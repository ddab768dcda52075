"""Extracted tables as CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegrist.operators.grids import csv_line, fix_headers, strip_titles


def _csv_lines(grids: DataFrame) -> DataFrame:
    ready = fix_headers(strip_titles(grids))
    return ready.select("table_id", "row", csv_line(F.col("cells")).alias("value"))


def pack_grids(grids: DataFrame, path: str) -> None:
    """``(table_id, row, value)``: the CSV lines of many tables in few files, as
    many as there are tasks. A table is its rows in order of ``row``, sought by
    the ranges of ``table_id`` in the files; a folder for each would cost more
    than the work."""
    _csv_lines(grids).sortWithinPartitions("table_id", "row").write.parquet(path)


def write_grids(grids: DataFrame, path: str) -> None:
    """One folder ``table_id=…`` per table. Rows are ranged by (table, row), so
    a small table is one file and a huge one a run of files in row order; no
    task has to hold a table. For tables that are few; ``pack_grids`` takes any
    number."""
    (
        _csv_lines(grids).repartitionByRange("table_id", "row")
        .sortWithinPartitions("table_id", "row")
        .select("table_id", "value")
        .write.partitionBy("table_id")
        .text(path)
    )

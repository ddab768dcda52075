"""Delimited files as logical tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegrist.sources.folder import ORDINAL, SOURCE, scan_tables


@dataclass
class LogicalTable:
    """One non-empty table with its name, ready for the chunk builders."""

    logical_name: str
    sheet: str | None
    df: DataFrame
    order_by: str
    report: dict


def read_tables(
    spark: SparkSession, path: str, names: dict[str, tuple[str, str | None]] | None = None
) -> list[LogicalTable]:
    """Every CSV under ``path`` (file, folder or glob) as a logical table of its
    own, typed by the cleaning vote; empty tables are left out.

    A view of ``scan_tables`` for few files: the frames of files with the same
    header and types are parts of one. ``names`` maps a base file name to
    ``(logical name, sheet)``. Rows keep their file order in ``_ordinal``."""
    scan = scan_tables(spark, path)
    if scan is None:
        return []
    out = []
    for row in sorted(scan.files.collect(), key=lambda r: r["file"]):
        group = scan.groups[row["group"]]
        base = row["file"].rsplit("/", 1)[-1]
        logical, sheet = (names or {}).get(base, (base, None))
        report = {
            "rows_dropped": row["rows_dropped"], "cols_dropped": row["cols_dropped"],
            "numeric_coerced": group.typing.numeric_coerced, "date_coerced": group.typing.dates,
        }
        df = group.df.filter(F.col(SOURCE) == row["file"]).drop(SOURCE)
        out.append(LogicalTable(logical, sheet, df, ORDINAL, report))
    return out


def sheet_name(workbook: str, sheet: str, sheets: int) -> str:
    """Logical name of a sheet: the workbook alone when it has only one."""
    return f"{workbook} :: {sheet}" if sheets > 1 else workbook

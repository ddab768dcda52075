"""Narrow intermediate tables that several steps read."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tablegrist.session import cut_lineage

ROWS_PER_FILE = 100_000


def compacted(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder in as many files as its rows need, not
    one for each shuffle partition, and read back. The rows are made in parallel
    and counted first; only the finished ones are gathered into fewer files."""
    kept = df.persist(StorageLevel.DISK_ONLY)
    files = kept.count() // ROWS_PER_FILE + 1
    out = cut_lineage(kept.coalesce(files))
    kept.unpersist()
    return out

"""Which row of which file a row is: a key that holds when ids repeat or are null."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegrist.session import cut_lineage

FILE, ROW = "__file", "__row"
#: Up to so many names of files, some 200 bytes each, are sent to every task.
BROADCAST_FILES = 100_000


def located(df: DataFrame) -> DataFrame:
    """``df`` with the file and the row number it was read from. A frame that is
    not a plain read of files is first written to the shared folder, as rows made
    by a shuffle can have another order when they are made again."""
    try:
        return _with_place(df)
    except AnalysisException:
        return _with_place(cut_lineage(df))


def _with_place(df: DataFrame) -> DataFrame:
    place = df.metadataColumn("_metadata")
    return df.withColumns({FILE: place["file_path"], ROW: place["row_index"]})


def in_written_order(docs: DataFrame, name: str = "position") -> DataFrame:
    """``docs`` with ``name``, the place of each row, from 0 on, in the order its
    files were written in: parts by their number, rows as they stand in them. For
    range-sorted rows that were written and read again it is their rank. Only
    one row per file passes through one task."""
    docs = located(docs)
    part = F.regexp_extract(FILE, r"part-(\d+)[^/]*$", 1).try_cast("bigint")
    files = docs.groupBy(FILE).agg(F.count("*").alias("__rows")).withColumn("__part", part)
    before = Window.orderBy(F.col("__part").asc_nulls_first(), FILE).rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(FILE, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    few = len(docs.inputFiles()) <= BROADCAST_FILES
    return docs.join(F.broadcast(starts) if few else starts, FILE).withColumn(name, F.col("__start") + F.col(ROW)).drop(FILE, ROW, "__start")


def at_places(located_docs: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of ``located_docs`` that stand in ``places``, without the place."""
    return located_docs.join(places.select(FILE, ROW), [FILE, ROW], "left_semi").drop(FILE, ROW)

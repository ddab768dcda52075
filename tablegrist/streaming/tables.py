"""Delimited files as a stream: every new file joins the stored table of its header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tablegrist.sources.folder import text_lines
from tablegrist.sources.table_store import TableStore


def ingest_tables(
    spark: SparkSession, path: str, store: TableStore, checkpoint: str, files_per_batch: int = 100, once: bool = True
) -> StreamingQuery:
    """Start the stream over the text files of a folder; with ``once`` it takes what
    is there and ends. The checkpoint numbers the batches, and the store takes one
    that is run again as the same, so rows and types are those of one run."""
    lines = text_lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))

    def add(batch: DataFrame, number: int) -> None:
        store.add(batch, number)

    writer = lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()

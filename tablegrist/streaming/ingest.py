"""File-at-a-time ingest as a stream.

A file source hands each new file to ``foreachBatch``, which runs the batch plan
and upserts into the store. Chunk ids are stable, so a replayed batch writes the
same rows again instead of doubling them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablegrist.plans.ingest import Family
from tablegrist.sources.store import ChunkStore


def ingest_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    store: ChunkStore,
    family: Callable[[DataFrame], Family],
    checkpoint: str,
    file_format: str = "parquet",
    files_per_batch: int = 1,
    once: bool = True,
    **options: str,
) -> StreamingQuery:
    """Start the stream; with ``once`` it takes what is there and ends."""
    files = (
        spark.readStream.format(file_format)
        .schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .options(**options)
        .load(path)
    )

    def add(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        kept = batch.persist()
        try:
            store.add(family(kept))
        finally:
            kept.unpersist()

    writer = files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()

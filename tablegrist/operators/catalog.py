"""Questions about the chunk tables themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("chunks"))


def count_by_type(chunks: DataFrame, *more: str) -> DataFrame:
    return chunks.groupBy(*more, "chunk_type").agg(F.count(F.lit(1)).alias("chunks"))


def list_files(chunks: DataFrame) -> DataFrame:
    return chunks.select("file").distinct().orderBy("file")


def list_file_ids(chunks: DataFrame) -> DataFrame:
    return chunks.select("file_id").filter(F.col("file_id").isNotNull()).distinct().orderBy("file_id")


def documents(chunks: DataFrame) -> DataFrame:
    """Name, suffix and number of chunks of every file."""
    suffix = F.lower(F.regexp_extract(F.regexp_replace("file", " :: .*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    return (
        chunks.groupBy("file")
        .agg(F.count(F.lit(1)).alias("chunks"))
        .select("file", suffix.alias("type"), "chunks")
    )


def get_many(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks of ``wanted(position, chunk_id)`` in request order; unknown ids
    drop out, a repeated id comes back each time."""
    return wanted.join(chunks, "chunk_id").orderBy("position")


def by_canonical(chunks: DataFrame, canonical_id: str) -> DataFrame:
    return chunks.filter(F.col("canonical_id") == canonical_id).orderBy("chunk_id")


def by_file(chunks: DataFrame, file: str) -> DataFrame:
    return chunks.filter(F.col("file") == file).orderBy("chunk_id")


def by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.filter(F.col("chunk_id") == chunk_id)


def total_rows(file_stats: DataFrame, *more: Column) -> DataFrame:
    """Rows of all stored tables, 0 without any; ``more`` aggregates beside it."""
    return file_stats.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"), *more)


def snapshot(
    chunks: DataFrame, postings: DataFrame, text_vectors: DataFrame, numeric_vectors: DataFrame, scalers: DataFrame,
    file_stats: DataFrame,
) -> DataFrame:
    """Size of every table as ``(metric, name, value)`` rows."""

    def metric(name: str, df: DataFrame, value, key=None) -> DataFrame:
        keyed = df.groupBy(key.alias("name")) if key is not None else df.groupBy(F.lit("").alias("name"))
        # A plain aggregate keeps the zero row of an empty table.
        out = keyed.agg(value.alias("value")) if key is not None else df.agg(value.alias("value"))
        return out.select(
            F.lit(name).alias("metric"),
            (F.col("name") if key is not None else F.lit("")).alias("name"),
            F.col("value").cast("bigint").alias("value"),
        )

    n = F.count(F.lit(1))
    return (
        metric("chunks", chunks, n)
        .unionByName(metric("chunks_by_type", chunks, n, F.col("chunk_type")))
        .unionByName(metric("chunks_by_file", chunks, n, F.col("file")))
        .unionByName(metric("postings", postings, n))
        .unionByName(metric("text_vectors", text_vectors, n))
        .unionByName(metric("numeric_vectors", numeric_vectors, n))
        .unionByName(metric("scalers", scalers, F.count_distinct("file_id")))
        .unionByName(metric("table_rows", file_stats, F.coalesce(F.sum("row_count"), F.lit(0))))
    )

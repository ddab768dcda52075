"""Exact-match postings: ``(kind, key, value, chunk_id)``.

* ``id``: key is a canonical entity id
* ``cell``: key is a lower-cased column, value a normalised cell
* ``enum``: key is a lower-cased column of an enumeration chunk
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegrist.functions.text import canonical_name, cell_text
from tablegrist.operators.kinds import TEXT, kind_of
from tablegrist.session import cut_lineage

COLUMNS = ("kind", "key", "value", "chunk_id")


def cell_postings(rows: DataFrame, columns: Sequence[str], chunk_id: str = "chunk_id") -> DataFrame:
    """One posting per non-NULL cell whose normalised value is not empty. Names
    are normalised as columns of one projection, then exploded: no shuffle."""
    entries = []
    fields = {f.name: f for f in rows.schema.fields}
    for c in columns:
        text = cell_text(c, fields[c].dataType)
        ascii_only = kind_of(fields[c].dataType) != TEXT
        value = _plain_key(text) if ascii_only else canonical_name(text)
        entries.append(F.struct(F.lit(c.lower()).alias("key"), value.alias("value")))
    return (
        rows.select(chunk_id, F.explode(F.array(*entries)).alias("e"))
        .select(F.lit("cell").alias("kind"), "e.key", "e.value", F.col(chunk_id).alias("chunk_id"))
        .filter(F.col("value") != "")
    )


def _plain_key(text):
    """``canonical_name`` of text that cannot hold letters to fold or drop."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(""))


def id_postings(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("canonical_id") != "").select(
        F.lit("id").alias("kind"), F.col("canonical_id").alias("key"), F.lit("").alias("value"), "chunk_id"
    )


def enum_postings(chunks: DataFrame) -> DataFrame:
    return (
        chunks.filter(F.col("chunk_type") == "enumeration")
        .select("chunk_id", F.explode("column_names").alias("column"))
        .select(F.lit("enum").alias("kind"), F.lower("column").alias("key"), F.lit("").alias("value"), "chunk_id")
    )


def lookup_keys(requests: DataFrame, *carry: str) -> DataFrame:
    """``(query_id, kind, column, value)`` requests as distinct posting keys:
    names and cell values normalised, columns lower-cased. ``carry`` names
    further request columns to keep."""
    is_id, is_cell = F.col("kind") == "id", F.col("kind") == "cell"
    return requests.select(
        "query_id",
        "kind",
        F.when(is_id, F.col("value")).otherwise(F.lower("column")).alias("key"),
        F.when(is_cell, canonical_name("value")).otherwise(F.lit("")).alias("value"),
        *carry,
    ).distinct()


def matches(postings: DataFrame, keys: DataFrame) -> DataFrame:
    """Every posting of every key, with the columns of the key.

    The keys are written first, so that their true size decides: usually they are
    sent to the tasks and the many postings of a hot key stay where they are."""
    return postings.join(cut_lineage(keys), ["kind", "key", "value"]).drop("key", "value")


def lookup(postings: DataFrame, keys: DataFrame) -> DataFrame:
    """``(query_id, kind, chunk_id)``, each once."""
    return matches(postings, keys).select("query_id", "kind", "chunk_id").distinct()


def total_postings(postings: DataFrame) -> DataFrame:
    return postings.agg(F.count(F.lit(1)).alias("postings"))


def remove_chunks(postings: DataFrame, deleted: DataFrame) -> DataFrame:
    return postings.join(deleted.select("chunk_id"), "chunk_id", "left_anti").select(*COLUMNS)

"""Entities of a table, their aliases, and resolution of phrases to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegrist.functions.text import canonical_name
from tablegrist.operators.kinds import DATETIME, columns_of


def latest_rows(
    df: DataFrame, name_col: str, order_by: str, date_col: str | None = None
) -> DataFrame:
    """One representative row per entity: the latest by the first datetime
    column (dated rows win over undated ones), then by the ordinal. Taken as a
    ``max_by`` so that each task sends one row per entity at most."""
    if date_col is None:
        dates = columns_of(df, DATETIME)
        date_col = dates[0] if dates else None
    entity = F.col(f"`{name_col}`")
    keys = ([F.col(f"`{date_col}`")] if date_col else []) + [F.col(f"`{order_by}`")]
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return (
        df.filter(entity.isNotNull())
        .select(canonical_name(entity).alias("canonical_id"), whole.alias("row"), F.struct(*keys).alias("at"))
        .filter(F.col("canonical_id") != "")
        .groupBy("canonical_id")
        .agg(F.max_by("row", "at").alias("row"))
        .select("canonical_id", "row.*")
    )


def alias_table(df: DataFrame, name_col: str) -> DataFrame:
    """Distinct ``(canonical_id, alias)`` of the raw names of a table."""
    entity = F.col(f"`{name_col}`").cast("string")
    return (
        df.select(entity.alias("alias"))
        .filter(F.col("alias").isNotNull())
        .distinct()
        .select(canonical_name("alias").alias("canonical_id"), "alias")
        .filter(F.col("canonical_id") != "")
    )


def register_aliases(known: DataFrame, new: DataFrame) -> DataFrame:
    """Known aliases plus the new ones, each pair once."""
    return known.select("canonical_id", "alias").unionByName(new.select("canonical_id", "alias")).distinct()


def alias_lists(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy("canonical_id").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))


def with_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities with their alias list, empty when none is registered."""
    return entities.join(alias_lists(aliases), "canonical_id", "left").withColumn(
        "aliases", F.coalesce("aliases", F.array().cast("array<string>"))
    )


def alias_keys(aliases: DataFrame) -> DataFrame:
    """``(key, canonical_id)``: every normalised alias and every id itself."""
    spelled = aliases.select(canonical_name("alias").alias("key"), "canonical_id")
    own = aliases.select(F.col("canonical_id").alias("key"), "canonical_id")
    return (
        spelled.unionByName(own)
        .filter(F.col("key") != "")
        .groupBy("key")
        .agg(F.min("canonical_id").alias("canonical_id"))
    )


def resolve_aliases(phrases: DataFrame, aliases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """Phrases with the entity their normalised form stands for, or NULL."""
    keyed = phrases.withColumn("key", canonical_name(phrase))
    return keyed.join(alias_keys(aliases), "key", "left").drop("key")


def resolve_entities(questions: DataFrame, aliases: DataFrame, ids: DataFrame) -> DataFrame:
    """``questions(query_id, entity_phrases)`` with the entity they name.

    Longest phrase first; a whole phrase is tried as alias, then as id, and is
    then shortened from the right one token at a time (id, then alias). All
    trials of all questions are one join on the trial text."""
    lookup = (
        alias_keys(aliases)
        .select("key", F.col("canonical_id").alias("via_alias"), F.lit(False).alias("is_id"))
        .unionByName(
            ids.select(F.col("canonical_id").alias("key"))
            .select("key", F.lit(None).cast("string").alias("via_alias"), F.lit(True).alias("is_id"))
        )
        .groupBy("key")
        .agg(F.max("via_alias").alias("via_alias"), F.bool_or("is_id").alias("is_id"))
    )
    phrase = questions.select("query_id", F.posexplode("entity_phrases").alias("pos", "phrase"))
    tokens = phrase.select(
        "query_id", "pos", F.length("phrase").alias("len"),
        F.split(canonical_name("phrase"), " ").alias("tokens"),
    )
    trials = tokens.select(
        "query_id", "pos", "len", "tokens",
        F.explode(F.sequence(F.lit(0), F.size("tokens") - 1)).alias("cut"),
    ).select(
        "query_id", "pos", "len", "cut",
        F.array_join(F.slice("tokens", F.lit(1), F.size("tokens") - F.col("cut")), " ").alias("key"),
    )
    own = F.when(F.col("is_id"), F.col("key"))
    hit = F.when(F.col("cut") == 0, F.coalesce("via_alias", own)).otherwise(F.coalesce(own, F.col("via_alias")))
    best = (
        trials.join(lookup, "key")
        .groupBy("query_id")
        .agg(F.min_by(hit, F.struct(-F.col("len"), F.col("pos"), F.col("cut"))).alias("canonical_id"))
    )
    return questions.join(best, "query_id", "left")


def first_rows(df: DataFrame, order_by: str, cap: int | None) -> DataFrame:
    """The first ``cap`` rows by the ordinal (``None``: all of them)."""
    return df if cap is None else df.orderBy(F.col(f"`{order_by}`").asc()).limit(cap)


def first_rows_per_table(df: DataFrame, table_col: str, order_by: str, cap: int) -> DataFrame:
    """The first ``cap`` rows of every table of a many-table frame. The rank
    limit is applied within each task before the shuffle."""
    order = Window.partitionBy(table_col).orderBy(order_by)
    return (
        df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= cap).drop("_rank")
    )

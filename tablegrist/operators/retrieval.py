"""Candidates for a table of questions: signals, scores, ranks, contexts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegrist.functions import questions as Q
from tablegrist.functions.text import words
from tablegrist.operators import postings as P
from tablegrist.operators.vectors import top_k

OVERFETCH = 4
MIN_FETCH = 20
SECOND_STAGE_ROWS = 20
# Weights of the linear score.
WEIGHT_ID, WEIGHT_CELL, WEIGHT_TEXT, WEIGHT_DISTANCE, WEIGHT_PRIOR = 1.0, 0.4, 0.5, 0.3, 0.2
MAX_DISTANCE = 9.9
# How well a chunk type fits an intent; 0.1 where not listed.
DEFAULT_PRIOR = 0.1
TYPE_PRIORS = {
    "point_lookup": {"row": 1.0, "entity": 0.9, "table": 0.4, "text": 0.2, "tabular_summary": 0.3},
    "list_distinct": {"enumeration": 1.0, "synopsis": 0.4},
    "aggregate": {"tabular_summary": 0.6, "entity": 0.4, "row": 0.3, "synopsis": 0.3},
    "filter_rows": {"row": 1.0, "entity": 0.6, "tabular_summary": 0.3},
    "numeric_threshold": {"numeric_vector": 0.8, "row": 0.7, "entity": 0.5},
    "trend": {"time_window": 1.0, "tabular_summary": 0.3},
    "qualitative": {"text": 1.0, "table": 0.6, "synopsis": 0.4, "entity": 0.4},
}
# Displayed confidence.
EXACT_SCORE, FIELD_SCORE, GROUNDED = 1.0, 0.95, 0.85
CONFIDENCE_ROWS = 3
NO_CONTEXT = "(no relevant context found)"


def type_prior(intent: Column, chunk_type: Column) -> Column:
    """The fixed table as one literal map, looked up in place."""
    pairs = [
        x
        for kind, priors in TYPE_PRIORS.items()
        for name, weight in priors.items()
        for x in (F.lit(f"{kind}/{name}"), F.lit(weight))
    ]
    found = F.try_element_at(F.create_map(*pairs), F.concat_ws("/", intent, chunk_type))
    return F.coalesce(found, F.lit(DEFAULT_PRIOR))


def linear_score(
    exact_id: Column,
    exact_cell: Column,
    text_sim: Column,
    distance: Column,
    intent: Column,
    chunk_type: Column,
) -> Column:
    far = F.when(distance.isNotNull(), F.least(distance, F.lit(MAX_DISTANCE)) / 10.0).otherwise(F.lit(0.0))
    return (
        F.when(exact_id, WEIGHT_ID).otherwise(0.0)
        + F.when(exact_cell, WEIGHT_CELL).otherwise(0.0)
        + WEIGHT_TEXT * text_sim
        - WEIGHT_DISTANCE * far
        + WEIGHT_PRIOR * type_prior(intent, chunk_type)
    )


def exact_requests(questions: DataFrame) -> DataFrame:
    """Posting keys a question asks for: its entity and its cell predicates."""
    ids = questions.filter(F.col("canonical_id") != "").select(
        "query_id", "intent", F.lit("id").alias("kind"), F.lit("").alias("column"),
        F.col("canonical_id").alias("value"),
    )
    cells = questions.select(
        "query_id", "intent", F.explode(Q.cell_predicates(F.col("question"))).alias("p")
    ).select("query_id", "intent", F.lit("cell").alias("kind"), "p.column", "p.value")
    return ids.unionByName(cells)


def _signals(df: DataFrame, **given: Column) -> DataFrame:
    none = F.lit(None).cast("double")
    no = F.lit(False)
    values = {"exact_id": no, "exact_cell": no, "text_sim": none, "numeric_dist": none, **given}
    return df.select("query_id", "chunk_id", "intent", *[c.alias(n) for n, c in values.items()])


def merge_signals(exact: DataFrame, similar: DataFrame, distant: DataFrame | None = None) -> DataFrame:
    """One row per (query, chunk) with all its signals. The key holds the chunk,
    so the many hits of one hot posting spread over all tasks."""
    kind = F.col("kind")
    parts = _signals(exact, exact_id=kind == "id", exact_cell=kind == "cell").unionByName(
        _signals(similar, text_sim=F.col("score"))
    )
    if distant is not None:
        parts = parts.unionByName(_signals(distant, numeric_dist=F.col("score")))
    return parts.groupBy("query_id", "chunk_id").agg(
        F.first("intent").alias("intent"),
        F.bool_or("exact_id").alias("exact_id"),
        F.bool_or("exact_cell").alias("exact_cell"),
        F.coalesce(F.max("text_sim"), F.lit(0.0)).alias("text_sim"),
        F.min("numeric_dist").alias("numeric_dist"),
    )


def candidates(
    questions: DataFrame, postings: DataFrame, vectors: DataFrame, k: int, distant: DataFrame | None = None,
    fetch: int | None = None,
) -> DataFrame:
    """Entity hits, cell hits and the ``fetch`` (else ``max(4k, 20)``) most similar chunks of
    ``questions(query_id, question, canonical_id, intent, vec)``. The intent
    travels with each hit, so no later join gathers the hits of a question."""
    exact = P.matches(postings, P.lookup_keys(exact_requests(questions), "intent"))
    intents = questions.select("query_id", "intent")
    similar = top_k(questions.select("query_id", "vec"), vectors, fetch or max(k * OVERFETCH, MIN_FETCH))
    if distant is not None:
        distant = distant.join(intents, "query_id")
    return merge_signals(exact, similar.join(intents, "query_id"), distant)


def score_candidates(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates with chunk type and linear score; unknown chunks drop out.
    Only the type is read here, the text of a chunk follows once it is ranked."""
    return found.join(chunks.select("chunk_id", "chunk_type"), "chunk_id").withColumn(
        "score",
        linear_score(
            F.col("exact_id"), F.col("exact_cell"), F.col("text_sim"), F.col("numeric_dist"),
            F.col("intent"), F.col("chunk_type"),
        ),
    )


def hydrate(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked rows with the rest of their chunk."""
    return ranked.join(chunks.drop("chunk_type"), "chunk_id")


def _rank_by(*order: Column) -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(*order))


def linear_top_k(scored: DataFrame, k: int) -> DataFrame:
    return scored.withColumn("rank", _rank_by(F.desc("score"), F.asc("chunk_id"))).filter(F.col("rank") <= k)


def shared_words(question: Column, text: Column) -> Column:
    """Default second-stage score: distinct lower-case words in common."""
    return F.size(F.array_intersect(words(F.lower(question)), words(F.lower(text)))).cast("double")


def stand_in_text(text: Column, chunk_type: Column, canonical_id: Column, numeric_columns: Column, window: Column) -> Column:
    """Something to score for chunks that carry no text."""
    who = F.coalesce(F.nullif(canonical_id, F.lit("")), F.lit("?"))
    return F.coalesce(
        F.nullif(text, F.lit("")),
        F.when(
            chunk_type == "numeric_vector",
            F.concat(F.lit("Numeric snapshot for "), who, F.lit(" covering: "), _column_list(numeric_columns), F.lit(".")),
        )
        .when(chunk_type == "time_window", F.concat(F.lit("Time-window "), window, F.lit(" statistics for "), who, F.lit(".")))
        .otherwise(who),
    )


def _column_list(numeric_columns: Column) -> Column:
    listed = F.array_join(numeric_columns, ", ")
    return F.coalesce(F.nullif(listed, F.lit("")), F.lit("(no columns)"))


def second_stage(
    scored: DataFrame,
    questions: DataFrame,
    chunks: DataFrame,
    k: int,
    scorer: Callable[[Column, Column], Column] = shared_words,
    rows: int = SECOND_STAGE_ROWS,
) -> DataFrame:
    """Entity matches first in linear order, then the best ``rows`` of the rest in
    the order of the second score, then what is left in linear order. Cut to k,
    chunks included."""
    first = Window.partitionBy("query_id", "exact_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    # The constant bound lets each task cut before the shuffle.
    kept = (
        scored.withColumn("_place", F.row_number().over(first))
        .filter(F.col("_place") <= max(k, rows))
    )
    body = stand_in_text(*[F.col(c) for c in ("text", "chunk_type", "canonical_id", "numeric_columns", "window")])
    full = hydrate(kept, chunks).join(questions.select("query_id", "question"), "query_id")
    judged = ~F.col("exact_id") & (F.col("_place") <= rows)
    again = full.withColumn("ce_score", F.when(judged, scorer(F.col("question"), body)))
    order = _rank_by(F.desc("exact_id"), F.desc_nulls_last("ce_score"), F.asc("_place"))
    return again.withColumn("rank", order).filter(F.col("rank") <= k).drop("_place")


def with_source_score(ranked: DataFrame) -> DataFrame:
    """The 0-1 score shown for a source and the kind of match behind it."""
    shown = F.when(F.col("exact_id"), EXACT_SCORE).when(F.col("exact_cell"), FIELD_SCORE).otherwise(F.col("text_sim"))
    match = F.when(F.col("exact_id"), "exact").when(F.col("exact_cell"), "field").otherwise("semantic")
    return ranked.withColumn("source_score", F.round(shown, 3)).withColumn("match", match)


def confidence(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """Tier and value per question from its first three sources; a question
    without sources is semantic at 0."""
    top = with_source_score(ranked).filter(F.col("rank") <= CONFIDENCE_ROWS)
    per = top.groupBy("query_id").agg(
        F.bool_and("exact_id").alias("_exact"), F.avg("source_score").alias("_avg")
    )
    value = F.coalesce("_avg", F.lit(0.0))
    tier = (
        F.when(F.col("_exact"), "deterministic").when(value >= GROUNDED, "grounded").otherwise("semantic")
    )
    percent = F.concat(F.lit(" (avg "), F.round(value * 100).cast("int").cast("string"), F.lit("%)"))
    reason = (
        F.when(F.col("_avg").isNull(), "no relevant sources")
        .when(F.col("_exact"), "all top sources are exact entity matches")
        .when(value >= GROUNDED, F.concat(F.lit("strong source overlap"), percent))
        .otherwise(F.concat(F.lit("semantic-only retrieval"), percent))
    )
    return questions.select("query_id").join(per, "query_id", "left").select(
        "query_id", tier.alias("tier"),
        F.when(F.col("_exact"), 1.0).otherwise(F.round(value, 3)).alias("value"),
        reason.alias("reason"),
    )


def contexts(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """Numbered source blocks per question, k at most."""
    where = F.concat(F.coalesce("file", F.lit("?")), F.coalesce(F.concat(F.lit(" p."), F.col("page").cast("string")), F.lit("")))
    body = F.coalesce(
        F.nullif(F.col("text"), F.lit("")),
        F.when(
            F.col("chunk_type") == "numeric_vector",
            F.concat(
                F.lit("Numeric snapshot for entity '"), F.coalesce(F.nullif("canonical_id", F.lit("")), F.lit("?")),
                F.lit("' covering: "), _column_list(F.col("numeric_columns")), F.lit("."),
            ),
        ).when(
            F.col("chunk_type") == "time_window",
            F.concat(F.lit("Time window "), F.col("window"), F.lit(" stats for "), F.col("canonical_id"), F.lit(".")),
        ),
        F.lit(""),
    )
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), where, F.lit("\n"), body)
    joined = (
        ranked.select("query_id", F.struct("rank", block.alias("block")).alias("b"))
        .groupBy("query_id")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["block"]), "\n\n").alias("context"))
    )
    return questions.select("query_id").join(joined, "query_id", "left").select(
        "query_id", F.coalesce("context", F.lit(NO_CONTEXT)).alias("context")
    )

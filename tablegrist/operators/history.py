"""Bounded conversation history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegrist.functions.text import strip

HISTORY_TURNS = 4
CONTENT_CHARS = 400


def last_messages(
    messages: DataFrame, session: str, order_by: str, history_turns: int = HISTORY_TURNS
) -> DataFrame:
    """The latest ``2 * history_turns`` messages of each session. Each task
    keeps that many per session before the shuffle."""
    newest = Window.partitionBy(session).orderBy(F.desc(order_by))
    return (
        messages.withColumn("_age", F.row_number().over(newest))
        .filter(F.col("_age") <= 2 * history_turns)
        .drop("_age")
    )


def transcripts(
    messages: DataFrame,
    session: str,
    order_by: str,
    role: str = "role",
    content: str = "content",
    history_turns: int = HISTORY_TURNS,
    chars: int | None = CONTENT_CHARS,
) -> DataFrame:
    """One ``role: content`` line per recent message, blank ones left out;
    of each the first ``chars`` characters (``None``: all)."""
    recent = last_messages(messages, session, order_by, history_turns)
    body = strip(content)
    line = F.concat(
        F.coalesce(F.col(role), F.lit("?")), F.lit(": "), body if chars is None else F.substring(body, 1, chars)
    )
    said = recent.filter(F.length(body) > 0).select(session, F.struct(order_by, line.alias("line")).alias("m"))
    return said.groupBy(session).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda m: m["line"]), "\n").alias(
            "transcript"
        )
    )

"""Lines repeated across the pages of a document, and their removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegrist.functions.text import is_page_number, lines, strip, trimmed_lines
from tablegrist.session import cut_lineage

MIN_REPEAT = 3
MIN_LENGTH = 3
# A repeated-line table within these bounds is sent to every task.
BROADCAST_LINES_PER_DOC = 500
BROADCAST_CHARS = 32_000_000


def repeated_lines(
    pages: DataFrame, document: str, text: str, min_repeat: int = MIN_REPEAT
) -> DataFrame:
    """``(document, line, pages)`` for trimmed lines of at least three
    characters on ``min_repeat`` pages or more. ``pages`` has one row per page,
    so after removing repeats within the row a plain count is a page count and
    a line on every page is combined before the shuffle."""
    seen = F.array_distinct(trimmed_lines(text))
    return (
        pages.select(document, F.explode(seen).alias("line"))
        .filter(F.length("line") >= MIN_LENGTH)
        .groupBy(document, "line")
        .agg(F.count(F.lit(1)).alias("pages"))
        .filter(F.col("pages") >= min_repeat)
    )


def strip_repeated(
    pages: DataFrame, document: str, page: str, text: str, repeated: DataFrame
) -> DataFrame:
    """``pages`` with repeated lines and page-number lines taken out of ``text``.

    A small repeated-line table (measured, not assumed) is joined as one list
    per document and the text never leaves its task. A larger one is matched by
    an anti-join on (document, line) and the pages are put together again row
    by row. Both ways give the same; a null text stays null."""
    repeated = cut_lineage(repeated)
    size = (
        repeated.groupBy(document)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))
        .agg(F.max("n").alias("n"), F.sum("chars").alias("chars"))
        .first()
    )
    if (size["n"] or 0) <= BROADCAST_LINES_PER_DOC and (size["chars"] or 0) <= BROADCAST_CHARS:
        return _strip_in_place(pages, document, text, repeated)
    return _strip_by_join(pages, document, text, repeated)


def _strip_in_place(pages: DataFrame, document: str, text: str, repeated: DataFrame) -> DataFrame:
    lists = repeated.groupBy(document).agg(F.collect_set("line").alias("_repeated"))
    known = F.coalesce(F.col("_repeated"), F.array().cast("array<string>"))

    def stays(line: Column) -> Column:
        return ~(F.array_contains(F.col("_known"), strip(line)) | is_page_number(line))

    joined = pages.join(F.broadcast(lists), document, "left").withColumn("_known", known)
    kept = F.when(F.col(text).isNotNull(), F.array_join(F.filter(lines(text), stays), "\n"))
    return joined.withColumn(text, kept).drop("_repeated", "_known")


def _strip_by_join(pages: DataFrame, document: str, text: str, repeated: DataFrame) -> DataFrame:
    """Lines and pages are known by two 64-bit hashes each, so only these and the
    places of repeated lines are shuffled. Pages that share document and text lose
    the same lines and may share a key."""
    pages = pages.withColumns({"_k1": F.xxhash64(document, text), "_k2": F.xxhash64(text, document)})
    hashes = F.xxhash64(document, "line").alias("_h1"), F.xxhash64("line", document).alias("_h2")
    each = (
        pages.filter(F.col(document).isNotNull())
        .select("_k1", "_k2", document, F.posexplode(trimmed_lines(text)).alias("_pos", "line"))
        .filter(F.length("line") >= MIN_LENGTH)
        .select("_k1", "_k2", "_pos", *hashes)
    )
    known = repeated.filter(F.col(document).isNotNull()).select(*hashes)
    drops = each.join(known, ["_h1", "_h2"], "left_semi").groupBy("_k1", "_k2").agg(F.collect_set("_pos").alias("_drop"))
    joined = pages.join(drops, ["_k1", "_k2"], "left").withColumn("_drop", F.coalesce("_drop", F.array().cast("array<int>")))
    # Of each line in order whether it goes, from sets of places and not by a search for each.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines(text)) - 1), F.col("_drop"))
    order = F.concat(F.transform(stay, lambda i: i * 2), F.transform("_drop", lambda i: i * 2 + 1))
    left = F.zip_with(
        lines(text), F.array_sort(order), lambda line, i: F.when((i % 2 == 0) & ~is_page_number(line), line)
    )
    return joined.withColumn(text, F.when(F.col(text).isNotNull(), F.array_join(left, "\n"))).drop("_k1", "_k2", "_drop")

"""Rule-based reading of natural-language questions, one Column per facet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablegrist.functions.text import strip

# Keyword lists, matched as substrings of the lower-cased question.
LIST_DISTINCT_PHRASES = (
    "list all", "show all", "all distinct", "all the categories",
    "all benchmarks", "all schemes", "all categories", "what categories",
    "what are all", "list distinct", "distinct values",
)
TREND_PHRASES = ("trend", "over time", "by year", "by month", "by quarter")
AGGREGATE_WORDS = (
    "average", "avg", "mean", "median", "sum", "total", "top", "bottom",
    "trend", "plot", "chart", "graph", "calculate", "compute",
    "highest", "lowest", "max", "maximum", "min", "minimum",
    "compare", "rank", "count", "aggregate", "by year", "by month",
    "analyz", "analys", "breakdown", "distribution", "histogram",
)
FILTER_PHRASES = (
    "show me", "show the", "find all", "find the", "find me",
    "which fund", "which row", "rows with", "rows where",
    "funds with", "stocks with", "entries with", "items with",
    "give me all", "give me the", "list the funds", "list funds",
)
ROW_QUERY_PHRASES = (
    "list all", "show me", "show all", "find all", "find the", "find me",
    "which fund", "which row", "where ", "filter", "rows with", "rows where",
    "funds with", "stocks with", "entries with", "items with",
    "give me all", "give me the",
)
SENTENCE_STARTERS = (
    "what", "which", "who", "where", "when", "why", "how",
    "list", "show", "find", "give", "tell", "is", "are", "does", "do",
    "can", "could", "would", "should", "the", "a", "an",
)
# Patterns.
REFERRED_ENTITY = (
    r"\b(?:of|for|about|regarding)\s+([A-Z][A-Za-z0-9 &\-]{2,80}?)"
    r"(?=\s*(?:\?|$|,|\.|;|in\b|on\b|doesn|does|has\b|have\b|with\b))"
)
CAPITALISED_RUN = (
    r"\b([A-Z][A-Za-z0-9&\-]*(?:\s+(?:[A-Z][A-Za-z0-9&\-]*|[0-9][A-Za-z0-9&\-]*)){1,6})\b"
)
CELL_PREDICATE = (
    r"(?i)\b([A-Za-z][A-Za-z0-9_ \-]{1,40}?)\s*(?:=|==|\bis\b|:)\s*"
    r'"?([A-Za-z0-9 \-_/]{1,60})"?'
)
THRESHOLD_WORDS = {
    "greater than": ">", "more than": ">", "above": ">", "over": ">",
    "less than": "<", "fewer than": "<", "below": "<", "under": "<",
}
THRESHOLD_SYMBOLS = (">=", "<=", ">", "<")
# The symbol alternative has no leading word boundary, so "AUM > 5000" counts.
THRESHOLD = (
    r"(?i)(\b(?:" + "|".join(THRESHOLD_WORDS) + r")|" + "|".join(THRESHOLD_SYMBOLS) + r")"
    r"\s*(\d[\d,.]*)\b"
)

MODES = ("chat", "aggregate", "query", "auto")


def _any_of(text: Column, phrases: Sequence[str]) -> Column:
    return reduce(lambda acc, p: acc | text.contains(p), phrases[1:], text.contains(phrases[0]))


def threshold_op(q: Column) -> Column:
    found = F.lower(F.regexp_extract(q, THRESHOLD, 1))
    op = F.when(found.isin(*THRESHOLD_SYMBOLS), found)
    for word, symbol in THRESHOLD_WORDS.items():
        op = op.when(found == word, F.lit(symbol))
    return F.when(threshold_value(q).isNotNull(), op)


def threshold_value(q: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(q, THRESHOLD, 2), ",", "").try_cast("double")


def entity_phrases(q: Column) -> Column:
    """Candidate entity names in order of discovery, without repeats: phrases
    after of/for/about/regarding, then runs of capitalised words. A question
    word that opens the text is cut off its run."""
    text = strip(q)
    found = F.struct(
        text.alias("text"),
        F.transform(F.regexp_extract_all(text, F.lit(REFERRED_ENTITY), F.lit(1)), strip).alias("named"),
        F.transform(F.regexp_extract_all(text, F.lit(CAPITALISED_RUN), F.lit(1)), strip).alias("runs"),
    )

    def merged(m: Column) -> Column:
        def without_starter(p: Column, i: Column) -> Column:
            first = F.lower(F.regexp_extract(p, r"^\S+", 0))
            rest = F.regexp_replace(F.regexp_replace(p, r"^\S+\s*", ""), r"\s+", " ")
            # Only the first run can open the text.
            opens = (i == 0) & F.startswith(m["text"], p) & first.isin(*SENTENCE_STARTERS)
            known = F.array_contains(m["named"], p)
            return F.when(known, F.lit("")).when(opens, rest).otherwise(p)

        fresh = F.transform(m["runs"], without_starter)
        return F.array_distinct(F.filter(F.concat(m["named"], fresh), lambda p: p != ""))

    # Both pattern scans are bound to one value, so each runs once per text.
    return F.transform(F.array(found), merged)[0]


def merged_phrases(literal: Column, rewritten: Column) -> Column:
    """Phrases of the question as asked, then the new ones of its rewriting."""
    return F.array_distinct(F.concat(literal, rewritten))


def intent(q: Column, phrases: Column) -> Column:
    """First matching rule wins."""
    low = F.lower(strip(q))
    asks = (
        low.startswith("what")
        | low.startswith("how much")
        | low.startswith("tell me")
        | low.contains(" of ")
    )
    return (
        F.when(_any_of(low, LIST_DISTINCT_PHRASES), F.lit("list_distinct"))
        .when(_any_of(low, TREND_PHRASES), F.lit("trend"))
        .when(threshold_op(q).isNotNull(), F.lit("numeric_threshold"))
        .when((F.size(phrases) > 0) & asks, F.lit("point_lookup"))
        .when(_any_of(low, AGGREGATE_WORDS), F.lit("aggregate"))
        .when(_any_of(low, FILTER_PHRASES), F.lit("filter_rows"))
        .otherwise(F.lit("qualitative"))
    )


def trend_window(q: Column, intent_col: Column) -> Column:
    low = F.lower(q)
    return F.when(
        intent_col == "trend",
        F.when(low.contains("year"), F.lit("365d")).when(low.contains("month"), F.lit("90d")),
    )


def cell_predicates(q: Column) -> Column:
    """``array<struct<column, value>>`` read from "X = Y", "X is Y", "X: Y"."""
    pairs = F.arrays_zip(
        F.transform(F.regexp_extract_all(q, F.lit(CELL_PREDICATE), F.lit(1)), strip).alias("column"),
        F.transform(F.regexp_extract_all(q, F.lit(CELL_PREDICATE), F.lit(2)), strip).alias("value"),
    )
    named = F.transform(
        pairs, lambda p: F.struct(p["column"].alias("column"), p["value"].alias("value"))
    )
    return F.filter(named, lambda p: (p["column"] != "") & (p["value"] != ""))


def wants_aggregate(q: Column, mode: Column, has_tables: Column) -> Column:
    """Whether the aggregation capability is offered for this question."""
    return has_tables & _offered(q, mode, "aggregate")


def wants_rows(q: Column, mode: Column, has_tables: Column) -> Column:
    """Whether the row-query capability is offered for this question."""
    return has_tables & _offered(q, mode, "query")


def _offered(q: Column, mode: Column, capability: str) -> Column:
    low = F.lower(q)
    by_keyword = _any_of(low, AGGREGATE_WORDS) | _any_of(low, ROW_QUERY_PHRASES)
    return (
        F.when(mode == "chat", F.lit(False))
        .when(mode.isin("aggregate", "query"), mode == capability)
        .otherwise(by_keyword)
    )


def plan_columns(question: Column | str) -> dict[str, Column]:
    """The whole reading of a question, ready for ``withColumns``."""
    q = F.col(question) if isinstance(question, str) else question
    phrases = entity_phrases(q)
    kind = intent(q, phrases)
    return {
        "entity_phrases": phrases,
        "intent": kind,
        "threshold_op": threshold_op(q),
        "threshold_value": threshold_value(q),
        "trend_window": trend_window(q, kind),
    }

"""Registered queries over the sample tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tablegrist.session import spread

Run = Callable[[SparkSession, str], DataFrame]


@dataclass
class Report:
    run: Run
    sql: str | None


REPORTS: dict[str, Report] = {}


def report(sql: str | None = None) -> Callable[[Run], Run]:
    """Register the decorated function under its own name."""

    def add(run: Run) -> Run:
        REPORTS[run.__name__] = Report(run, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str, costly: bool = False) -> DataFrame:
    """A sample table; ``costly`` where much work per row follows."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if costly else df


def sql_canonical(text: str) -> str:
    """SQL for the canonical form of an ASCII name."""
    noise = r"\b(?:fund|scheme|plan|the|an|a)\b"
    out = f"regexp_replace(lower({text}), '[^a-z0-9 ]', ' ', 'g')"
    out = f"regexp_replace({out}, '{noise}', ' ', 'g')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


SQL_BLANK = r"[\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL_BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SQL_BLANK}+|{SQL_BLANK}+$', '', 'g')"


def sql_words(text: str) -> str:
    """SQL list of the whitespace-separated words of a text."""
    return f"list_filter(regexp_split_to_array({text}, '{SQL_BLANK}+'), lambda w: w <> '')"


def sql_lines(text: str) -> str:
    return f"regexp_split_to_array(regexp_replace({text}, '(?:{SQL_BREAK})$', ''), '{SQL_BREAK}')"


def load_all() -> dict[str, Report]:
    from tablegrist.plans.reports import analysis, answers, prose, storage  # noqa: F401

    return REPORTS

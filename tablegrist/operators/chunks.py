"""Builders of the nine chunk types, all in one schema.

A chunk id is a hash of file, type and place, so a rebuilt or retried task
writes the same id and re-ingest replaces instead of duplicating.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegrist.functions import text as X
from tablegrist.operators import entities as E
from tablegrist.operators import profile as P
from tablegrist.operators import timeseries as TS
from tablegrist.operators.kinds import DATETIME, NUMBER, TEXT, column_kinds, columns_of
from tablegrist.operators.vectors import Scaler, scaled_vector
from tablegrist.session import small_table

SCHEMA_VERSION = 2
STATS = "struct<mean:double,std:double,min:double,max:double,count:bigint,cagr:double>"
# Chunk columns in order, with their types.
FIELDS = {
    "chunk_id": "string",
    "file": "string",
    "file_id": "string",
    "sheet": "string",
    "row_number": "bigint",
    "chunk_type": "string",
    "canonical_id": "string",
    "ingestion_time": "timestamp",
    "version": "int",
    "text": "string",
    "page": "bigint",
    "aliases": "array<string>",
    "column_names": "array<string>",
    "numeric_columns": "array<string>",
    "window": "string",
    "stats": f"map<string,{STATS}>",
    "source_chunk_ids": "array<string>",
}
CHUNK_SCHEMA = ", ".join(f"`{n}` {t}" for n, t in FIELDS.items())
CHUNK_TYPES = (
    "text", "table", "synopsis", "enumeration", "tabular_summary",
    "row", "entity", "numeric_vector", "time_window",
)


def file_id(file: Column | str) -> Column:
    """Stable twelve-character id of a logical file name."""
    if isinstance(file, str):
        return F.lit(Source(file).file_id)
    return F.substring(F.sha2(file, 256), 1, 12)


def chunk_id(file: Column | str, chunk_type: str, place: Column) -> Column:
    """Hash of the whole file name's hash (the short ``file_id`` may be shared by two
    of very many files), type and place."""
    name = F.lit(hashlib.sha256(file.encode()).hexdigest()) if isinstance(file, str) else F.sha2(file, 256)
    return F.sha2(F.concat_ws("|", name, F.lit(chunk_type), place.cast("string")), 256)


@dataclass
class Source:
    """A logical table or document set and when it was read."""

    file: str
    sheet: str | None = None
    time: dt.datetime | None = None

    @property
    def file_id(self) -> str:
        return hashlib.sha256(self.file.encode()).hexdigest()[:12]

    @property
    def moment(self) -> Column:
        return F.current_timestamp() if self.time is None else F.lit(self.time)


def as_chunks(
    df: DataFrame,
    chunk_type: str,
    source: Source,
    place: Column,
    file: Column | None = None,
    **values: Column,
) -> DataFrame:
    """``df`` as chunk rows: the mandatory fields plus the given ones."""
    name = F.lit(source.file) if file is None else file
    given = {
        "chunk_id": chunk_id(source.file if file is None else file, chunk_type, place),
        "file": name,
        "file_id": file_id(source.file if file is None else file),
        "sheet": F.lit(source.sheet),
        "chunk_type": F.lit(chunk_type),
        "ingestion_time": source.moment,
        "version": F.lit(SCHEMA_VERSION),
        **values,
    }
    return df.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items()])


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- documents --------------------------------------------------------------


def text_chunks(
    docs: DataFrame,
    source: Source,
    file: Column,
    text: str,
    header: Column | None = None,
    page: Column | None = None,
    size: int = X.DEFAULT_WINDOW,
    overlap: int = X.DEFAULT_OVERLAP,
) -> DataFrame:
    """Overlapping word windows of prose, one row per window. Every document is
    cut inside its own row, so nothing is shuffled."""
    named = docs.select(
        file.alias("_file"),
        (page if page is not None else F.lit(None)).cast("bigint").alias("_page"),
        (header if header is not None else F.lit(None).cast("string")).alias("_header"),
        X.words(text).alias("_words"),
    )
    each = named.select(
        "_file", "_page", "_header", F.posexplode(X.window_bodies("_words", size, overlap)).alias("_i", "_body")
    )
    place = F.concat_ws(".", F.col("_page").cast("string"), F.col("_i").cast("string"))
    return as_chunks(
        each, "text", source, place, file=F.col("_file"),
        row_number=F.col("_i"), page=F.col("_page"), text=F.concat_ws("\n", "_header", "_body"),
    )


def table_chunks(tables: DataFrame, source: Source, file: Column, page: Column | None = None) -> DataFrame:
    """``tables(table_id, part, text)`` of pipe text as chunks."""
    place = F.concat_ws(".", F.col("table_id").cast("string"), F.col("part").cast("string"))
    return as_chunks(
        tables, "table", source, place, file=file,
        text=F.col("text"), page=page if page is not None else F.lit(None),
    )


# --- one cleaned table ------------------------------------------------------


@dataclass
class TableProfile:
    """Facts about a table: a few values per column, whatever its size."""

    rows: int
    kinds: dict[str, str]
    dtypes: dict[str, str]
    ranges: dict[str, tuple]
    top: dict[str, list[tuple[str, int]]]
    numbers: list[tuple] = field(default_factory=list)
    samples: dict[str, list[tuple]] = field(default_factory=dict)


def profile_table(df: DataFrame, order_by: str, hidden: Sequence[str] = ()) -> TableProfile:
    """``hidden`` columns (such as a technical ordinal) are left out."""
    view = df.drop(*hidden)
    rows = df.count()
    fields = {f.name: f.dataType for f in view.schema.fields}
    texts = columns_of(view, TEXT)
    top: dict[str, list] = {c: [] for c in texts}
    for r in P.top_values(P.value_frequencies(view, texts), 5).orderBy("column", "rank").collect():
        top[r["column"]].append((r["value"], r["n"]))
    dated = columns_of(view, DATETIME)
    ranges = {r["column"]: (r["lo"], r["hi"]) for r in P.date_ranges(view).collect()} if dated else {}
    samples: dict[str, list] = {}
    shown = P.head_middle_tail(df, order_by)
    cells = F.array(*[F.coalesce(X.cell_text(n, t), F.lit("")) for n, t in fields.items()])
    for r in shown.select("sample", F.col(f"`{order_by}`").alias("_o"), cells.alias("cells")).orderBy("sample", "_o").collect():
        samples.setdefault(r["sample"], []).append(tuple(r["cells"]))
    return TableProfile(
        rows, column_kinds(view), {n: t.simpleString() for n, t in fields.items()}, ranges, top,
        [tuple(r) for r in P.describe_numbers(view).collect()], samples,
    )


def synopsis_text(p: TableProfile, file: str) -> str:
    def named(kind: str) -> list[str]:
        return [c for c, k in p.kinds.items() if k == kind]

    out = [f"{file} is a tabular dataset with {p.rows} rows and {len(p.kinds)} columns."]
    if named(TEXT):
        out.append(f"Text columns: {', '.join(named(TEXT))}.")
    if named(NUMBER):
        out.append(f"Numeric columns: {', '.join(named(NUMBER))}.")
    for c in named(DATETIME):
        if c in p.ranges:
            lo, hi = p.ranges[c]
            out.append(f"{c} ranges from {lo:%Y-%m-%d} to {hi:%Y-%m-%d}.")
    if named(TEXT):
        first = named(TEXT)[0]
        common = [v for v, _ in p.top[first][:3]]
        if common:
            out.append(f"Common values in {first}: {', '.join(common)}.")
    return " ".join(out)


def summary_text(p: TableProfile, file: str, report: dict | None = None) -> str:
    report = report or {}
    out = [f"File: {file}", f"Rows: {p.rows}, Columns: {len(p.kinds)}"]
    if report.get("rows_dropped") or report.get("cols_dropped"):
        out.append(
            f"Cleaning: dropped {report['rows_dropped']} empty rows, {report['cols_dropped']} empty columns."
        )
    if report.get("numeric_coerced"):
        out.append(f"Coerced to numeric: {', '.join(report['numeric_coerced'])}")
    if report.get("date_coerced"):
        out.append(f"Coerced to date: {', '.join(report['date_coerced'])}")
    out += ["", "Columns and dtypes:"] + [f"  - {c}: {t}" for c, t in p.dtypes.items()]

    def pipes(header: Sequence, rows: Sequence) -> list[str]:
        lines = [header, ["---"] * len(header), *rows]
        return ["| " + " | ".join(str(x) for x in line) + " |" for line in lines]

    titles = {"all": "All rows:", "head": "First 5 rows:", "tail": "Last 5 rows:", "middle": "Middle 5 rows:"}
    for part, title in titles.items():
        if part in p.samples:
            out += ["", title, *pipes(list(p.kinds), p.samples[part])]
    if p.numbers:
        stats = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")
        body = [[s, *[n[i + 1] for n in p.numbers]] for i, s in enumerate(stats)]
        out += ["", "Numeric summary:", *pipes(["", *[n[0] for n in p.numbers]], body)]
    if any(p.top.values()):
        out += ["", "Top values in text columns:"]
        out += [f"  - {c}: " + ", ".join(f"{v}={n}" for v, n in vs) for c, vs in p.top.items() if vs]
    if p.ranges:
        out += ["", "Date ranges:"] + [f"  - {c}: {lo} to {hi}" for c, (lo, hi) in p.ranges.items()]
    return "\n".join(out)


def _one_text(spark: SparkSession, chunk_type: str, source: Source, text: str) -> DataFrame:
    one = small_table(spark, [(text,)], "_text string")
    return as_chunks(one, chunk_type, source, F.lit("0"), text=F.col("_text"))


def synopsis_chunk(spark: SparkSession, p: TableProfile, source: Source) -> DataFrame:
    return _one_text(spark, "synopsis", source, synopsis_text(p, source.file))


def summary_chunk(spark: SparkSession, p: TableProfile, source: Source, report: dict | None = None) -> DataFrame:
    return _one_text(spark, "tabular_summary", source, summary_text(p, source.file, report))


def enumeration_chunks(df: DataFrame, source: Source, hidden: Sequence[str] = ()) -> DataFrame:
    listed = P.enumerations(df.drop(*hidden), source.file)
    # The first part of a list keeps the place of the column alone.
    place = F.when(F.col("part") == 1, F.col("column")).otherwise(
        F.concat("column", F.lit("#"), F.col("part").cast("string"))
    )
    return as_chunks(listed, "enumeration", source, place, text=F.col("text"), column_names=F.array("column"))


def _shown(df: DataFrame, hidden: Sequence[str]) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name not in hidden]


def row_frame(
    df: DataFrame, source: Source, order_by: str, name_col: str | None, cap: int | None = None
) -> DataFrame:
    """The rows that become row chunks, with their chunk id and entity."""
    rows = E.first_rows(df, order_by, cap)
    entity = X.canonical_name(f"`{name_col}`") if name_col else F.lit(None).cast("string")
    if name_col:
        entity = F.when(F.col(f"`{name_col}`").isNotNull(), entity)
    return rows.select(
        "*",
        chunk_id(source.file, "row", F.col(f"`{order_by}`")).alias("chunk_id"),
        entity.alias("canonical_id"),
    )


def row_chunks(rows: DataFrame, source: Source, order_by: str, hidden: Sequence[str] = ()) -> DataFrame:
    """``row_frame`` rows as chunks."""
    fields = [f for f in _shown(rows, hidden) if f.name not in ("chunk_id", "canonical_id")]
    return as_chunks(
        rows, "row", source, F.col(f"`{order_by}`"),
        row_number=F.col(f"`{order_by}`"), canonical_id=F.col("canonical_id"),
        text=X.row_body(source.file, fields),
        column_names=F.array(*[F.lit(f.name) for f in fields]),
    )


def entity_chunks(
    df: DataFrame, source: Source, name_col: str, order_by: str, aliases: DataFrame, hidden: Sequence[str] = ()
) -> DataFrame:
    """One chunk per entity: its latest row and its aliases."""
    fields = _shown(df, hidden)
    latest = E.with_aliases(E.latest_rows(df, name_col, order_by), aliases)
    listed = F.coalesce(F.nullif(F.array_join("aliases", ", "), F.lit("")), F.lit("(none registered)"))
    body = F.concat(
        F.lit("Entity "), F.col("canonical_id"), F.lit(f" from {source.file}. Aliases: "), listed,
        F.lit(". Attributes: "), X.attribute_list(fields), F.lit("."),
    )
    return as_chunks(
        latest, "entity", source, F.col("canonical_id"),
        canonical_id=F.col("canonical_id"), text=body, aliases=F.col("aliases"),
    )


def numeric_vectors(
    df: DataFrame, source: Source, order_by: str, name_col: str | None, scaler: Scaler
) -> DataFrame:
    """Every row as a scaled vector: chunk columns plus ``vec``."""
    entity = F.lit(None).cast("string")
    if name_col:
        entity = F.when(F.col(f"`{name_col}`").isNotNull(), X.canonical_name(f"`{name_col}`"))
    o = F.col(f"`{order_by}`")
    framed = df.select(o.alias("_o"), entity.alias("_entity"), scaled_vector(df, scaler).alias("_vec"))
    fid = file_id(source.file)
    return framed.select(
        chunk_id(source.file, "numeric_vector", F.col("_o")).alias("chunk_id"),
        fid.alias("file_id"), F.col("_o").alias("row_number"), F.col("_entity").alias("canonical_id"),
        F.col("_vec").alias("vec"),
    )


def numeric_vector_chunks(vectors: DataFrame, source: Source, scaler: Scaler) -> DataFrame:
    return as_chunks(
        vectors, "numeric_vector", source, F.col("row_number"),
        row_number=F.col("row_number"), canonical_id=F.col("canonical_id"),
        numeric_columns=F.array(*[F.lit(c) for c in scaler.columns]),
    )


def time_window_chunks(
    df: DataFrame, source: Source, name_col: str, date_col: str, value_cols: Sequence[str], order_by: str
) -> DataFrame:
    """One chunk per entity and window with statistics for each value column."""
    stats = TS.window_stats(TS.trailing_windows(df, name_col, date_col, value_cols, order_by), source.file)
    return as_chunks(
        stats, "time_window", source, F.concat_ws("|", "canonical_id", "window"),
        canonical_id=F.col("canonical_id"), text=F.col("text"), window=F.col("window"), stats=F.col("stats"),
    )

"""A cleaned table or a document set to its full family of chunk tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegrist.functions import text as X
from tablegrist.operators import chunks as C
from tablegrist.operators import entities as E
from tablegrist.operators import postings as P
from tablegrist.operators import profile
from tablegrist.operators import timeseries as TS
from tablegrist.operators.boilerplate import repeated_lines, strip_repeated
from tablegrist.operators.kinds import NUMBER, columns_of
from tablegrist.operators.vectors import fit_scaler
from tablegrist.session import small_table

ALIAS_SCHEMA = "canonical_id string, alias string"
SCALER_SCHEMA = "file_id string, column string, position int, mean double, std double"
STAT_SCHEMA = "file_id string, filename string, row_count bigint, ingestion_time timestamp"
VECTOR_SCHEMA = "chunk_id string, file_id string, vec array<float>"
POSTING_SCHEMA = "kind string, key string, value string, chunk_id string"
TABLES = {
    "chunks": C.CHUNK_SCHEMA,
    "postings": POSTING_SCHEMA,
    "text_vectors": VECTOR_SCHEMA,
    "numeric_vectors": VECTOR_SCHEMA,
    "scalers": SCALER_SCHEMA,
    "aliases": ALIAS_SCHEMA,
    "file_stats": STAT_SCHEMA,
}


#: Rows (``chunk_id``, ``vec``), or what makes them of chunks.
Vectors = DataFrame | Callable[[DataFrame], DataFrame] | None


@dataclass
class Family:
    """Everything one source contributes, one lazy frame per table. ``of_chunks``
    makes the tables that hang on the chunks from the chunks once they are stored, so
    that these need not be made again."""

    chunks: DataFrame
    postings: DataFrame
    text_vectors: DataFrame
    numeric_vectors: DataFrame
    scalers: DataFrame
    aliases: DataFrame
    file_stats: DataFrame
    name_col: str | None = None
    date_col: str | None = None
    of_chunks: Callable[[DataFrame], dict[str, DataFrame]] | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {t: getattr(self, t) for t in TABLES}


def table_family(
    df: DataFrame,
    source: C.Source,
    order_by: str,
    hidden: Sequence[str] = (),
    aliases: DataFrame | None = None,
    report: dict | None = None,
    row_cap: int | None = None,
    text_vectors: DataFrame | None = None,
) -> Family:
    """All table chunk types of one cleaned table. The builders read ``df``
    several times, so pass a stored or persisted frame. ``text_vectors(chunk_id,
    vec)`` of chunks with a text come from an embedder outside, keyed by the
    stable chunk id."""
    spark = df.sparkSession
    seen = df.drop(*hidden)
    name_col = profile.pick_name_column(seen)
    facts = C.profile_table(df, order_by, hidden)
    rows = C.row_frame(df, source, order_by, name_col, row_cap)
    parts = [
        C.synopsis_chunk(spark, facts, source),
        C.summary_chunk(spark, facts, source, report),
        C.enumeration_chunks(df, source, hidden),
        C.row_chunks(rows, source, order_by, hidden),
    ]
    own = E.alias_table(df, name_col) if name_col else small_table(spark, [], ALIAS_SCHEMA)
    known = own if aliases is None else E.register_aliases(aliases, own)
    if name_col:
        parts.append(C.entity_chunks(df, source, name_col, order_by, known, hidden))
    numbers = columns_of(seen, NUMBER)
    scalers = small_table(spark, [], SCALER_SCHEMA)
    vectors = small_table(spark, [], VECTOR_SCHEMA)
    fid = source.file_id
    if numbers:
        scaler = fit_scaler(df, fid, numbers)
        scalers = scaler.table(df)
        framed = C.numeric_vectors(df, source, order_by, name_col, scaler)
        parts.append(C.numeric_vector_chunks(framed, source, scaler))
        vectors = framed.select("chunk_id", "file_id", "vec")
    date_col = TS.detect_timeseries(seen, name_col) if name_col else None
    if date_col:
        parts.append(C.time_window_chunks(df, source, name_col, date_col, numbers, order_by))
    chunks = C.union_all(parts)
    cells = P.cell_postings(rows, [c for c in seen.columns])

    def of_chunks(made: DataFrame) -> dict[str, DataFrame]:
        named = P.id_postings(made).unionByName(P.enum_postings(made))
        return {"postings": named.unionByName(cells), "text_vectors": _of_chunks(made, text_vectors)}

    stats = small_table(spark, [(fid, source.file, facts.rows)], "file_id string, filename string, row_count bigint")
    return Family(
        chunks=chunks, **of_chunks(chunks), numeric_vectors=vectors, scalers=scalers, aliases=known,
        file_stats=stats.withColumn("ingestion_time", source.moment), name_col=name_col, date_col=date_col, of_chunks=of_chunks,
    )


def _of_chunks(chunks: DataFrame, vectors: Vectors) -> DataFrame:
    """Text vectors of the chunks they belong to."""
    if vectors is None:
        return small_table(chunks.sparkSession, [], VECTOR_SCHEMA)
    if callable(vectors):
        vectors = vectors(chunks)
    return chunks.select("chunk_id", "file_id").join(vectors, "chunk_id")


def document_family(
    pages: DataFrame,
    source: C.Source,
    document: str,
    page: str,
    text: str,
    paged: bool = True,
    vectors: Vectors = None,
    size: int = X.DEFAULT_WINDOW,
    overlap: int = X.DEFAULT_OVERLAP,
) -> Family:
    """Prose pages: repeated lines out, text normalised, cut into windows with
    a header naming document and page. ``vectors(chunk_id, vec)`` come from an
    embedder outside, keyed by the stable chunk id, or are made of the chunks by it."""
    spark = pages.sparkSession
    if paged:
        pages = strip_repeated(pages, document, page, text, repeated_lines(pages, document, text))
    tidy = pages.withColumn(text, X.normalise_text(text))
    name: Column = F.col(document).cast("string")
    header = F.concat(F.lit("["), name, F.lit("]"))
    if paged:
        header = F.concat(header, F.lit(" page "), F.col(page).cast("string"))
    chunks = C.text_chunks(
        tidy, source, name, text, header=header,
        page=F.col(page).try_cast("bigint") if paged else None, size=size, overlap=overlap,
    )
    return Family(
        chunks, small_table(spark, [], POSTING_SCHEMA), _of_chunks(chunks, vectors), small_table(spark, [], VECTOR_SCHEMA),
        small_table(spark, [], SCALER_SCHEMA), small_table(spark, [], ALIAS_SCHEMA),
        small_table(spark, [], STAT_SCHEMA), of_chunks=lambda made: {"text_vectors": _of_chunks(made, vectors)},
    )

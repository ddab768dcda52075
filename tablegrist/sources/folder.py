"""A folder of delimited files as typed tables, in a fixed number of passes.

Files are read as lines of splittable blocks. A quoted cell may go over line
breaks, and a block may begin inside one: each block is summed up as what it makes
of both states (outside or inside of quotes), the summaries are composed in block
order, and then every block knows the state it begins in. Records that go over a
block's end are put together from their pieces.

Files with the same header are parsed together, one vote per file is counted in
one aggregate per header, and files with the same header and types share a frame.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablegrist.operators import clean
from tablegrist.session import cut_lineage, new_dir

HEADER_ROWS = 5
MAX_BLANK_SHARE = 0.3
SOURCE, ORDINAL = "_source", "_ordinal"
#: Blocks that begin inside of quotes or belong to a file whose last quote stays
#: open are sent to the tasks up to this number, 200 bytes each; more are joined.
BROADCAST_BLOCKS = 100_000

RECORDS = "file string, ordinal bigint, value string"
_OPEN = re.compile(r'(?:(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+|),)*+(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+|)', re.S)
_INSIDE = re.compile(r'(?:[^"]|"")*+', re.S)


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside or outside of quotes ends inside. A quote
    opens a cell only at the cell's beginning; after the closing one the rest of
    the cell is plain."""
    if '"' not in line:
        return inside
    if inside:
        at = _INSIDE.match(line).end()
        if at == len(line):
            return True
        comma = line.find(",", at + 1)
        if comma < 0:
            return False
        line = line[comma + 1 :]
    return _OPEN.fullmatch(line) is None


def cells_of(record: str) -> list[str]:
    return next(csv.reader(io.StringIO(record)), [])


def blank_share(cells: list[str]) -> float:
    return sum(not c.strip() for c in cells) / len(cells) if cells else 1.0


def choose_header(lines: list[str]) -> int:
    """Index of the header among a file's first records: row 0 unless more than
    30 % of its cells are blank, then the first better one of rows 1-4 that has
    data below, else row 0. The first row's width sets the number of cells."""
    if not lines:
        return 0
    width = max(len(cells_of(line)) for line in lines)

    def blank(i: int) -> float:
        cells = cells_of(lines[i])
        return blank_share(cells + [""] * (width - len(cells)))

    if len(lines) < 2 or blank(0) <= MAX_BLANK_SHARE:
        return 0
    good = (i for i in range(1, len(lines)) if i < HEADER_ROWS and i + 1 <= len(lines) - 1)
    return next((i for i in good if blank(i) <= MAX_BLANK_SHARE), 0)


def header_names(cells: list[str], width: int) -> list[str]:
    """Column names: blanks get a placeholder, repeats a counter."""
    out: list[str] = []
    taken: set[str] = set()
    for i in range(max(width, len(cells))):
        name = cells[i].strip() if i < len(cells) else ""
        name = name or f"Unnamed: {i}"
        base, n = name, 0
        while name in taken:
            n += 1
            name = f"{base}.{n}"
        out.append(name)
        taken.add(name)
    return out


# --- records ----------------------------------------------------------------


def text_lines(reader) -> DataFrame:
    """``value``, ``file`` and ``block`` of the lines that a reader, of a batch or
    of a stream, gives for text files."""
    return reader.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[str], bool, bool]]:
    """The lines of each block in a batch, with what is known of the block."""
    files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
    values = batch.column("value").to_pylist()
    known = batch.schema.get_field_index("inside") >= 0
    inside = batch.column("inside").to_pylist() if known else [None] * len(files)
    literal = batch.column("literal").to_pylist() if known else [None] * len(files)
    since = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or files[i] != files[since] or blocks[i] != blocks[since]:
            yield files[since], blocks[since], values[since:i], bool(inside[since]), bool(literal[since])
            since = i


def _summaries(lines: DataFrame) -> DataFrame:
    """What each block makes of both states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, states, done = None, (False, True), []
        for batch in batches:
            for file, block, values, _, _ in _runs(batch):
                if (file, block) != at:
                    if at:
                        done.append((*at, *states))
                    at, states = (file, block), (False, True)
                for v in values:
                    if '"' in v:
                        states = tuple(ends_inside(v, s) for s in states)
        if at:
            done.append((*at, *states))
        columns = list(zip(*done)) or [[], [], [], []]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "block", "outside", "inside"])

    return lines.mapInArrow(run, "file string, block bigint, outside boolean, inside boolean")


def _entries(summaries: DataFrame) -> DataFrame:
    """``file``, ``block``, ``inside`` (the state it begins in) and ``literal`` of
    the blocks for which one of them is true.

    A block either ends in one state whatever it begins in, or keeps the state, or
    turns it over. So the state behind a block is that of the last block of the
    first kind, turned over as often as blocks after it do."""
    order = Window.partitionBy("file").orderBy("block")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    fixed = F.col("outside") == F.col("inside")
    turns = F.sum((~fixed & F.col("outside")).cast("int")).over(upto)
    summed = summaries.withColumn("turns", turns)
    last = F.last(F.when(fixed, F.struct("outside", "turns")), ignorenulls=True).over(upto)
    summed = summed.withColumn("last", last)
    after = F.coalesce(F.col("last.outside"), F.lit(False)) != (
        (F.col("turns") - F.coalesce(F.col("last.turns"), F.lit(0))) % 2 == 1
    )
    states = summed.select("file", "block", after.alias("after")).select(
        "file", "block", F.coalesce(F.lag("after").over(order), F.lit(False)).alias("inside"),
        F.last("after").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("literal"),
    )
    return states.filter("inside or literal")


#: Kinds of pieces: a whole record, one that goes on in the next block, and what
#: an earlier block's record goes on with.
_WHOLE, _HEAD, _REST = 0, 1, 2


def _pieces(lines: DataFrame) -> DataFrame:
    """Records and pieces of records, numbered within their block by the records
    that begin there. Blank lines outside of quotes are no records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, literal, open_, place, rest = None, False, False, [], 0, False
        for batch in batches:
            out: list[tuple] = []
            for file, block, values, entered, plain in _runs(batch):
                if (file, block) != at:
                    if open_:
                        out.append((*at, place, "\n".join(open_), _REST if rest else _HEAD))
                    at, inside, literal, open_, place, rest = (file, block), entered and not plain, plain, [], 0, entered and not plain
                for v in values:
                    was, inside = inside, not literal and ends_inside(v, inside)
                    if not was and not inside:
                        if v:
                            out.append((file, block, place, v, _WHOLE))
                            place += 1
                        continue
                    open_.append(v)
                    if not inside:
                        out.append((file, block, place, "\n".join(open_), _REST if rest else _WHOLE))
                        place += not rest
                        open_, rest = [], False
            yield _batch(out)
        if open_:
            yield _batch([(*at, place, "\n".join(open_), _REST if rest else _HEAD)])

    return lines.mapInArrow(run, "file string, block bigint, place bigint, value string, kind int")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "block", "place", "value", "kind"]
    )


def csv_records(lines: DataFrame) -> DataFrame:
    """``file``, ``ordinal`` (from 0 on, in file order) and ``value`` of every record
    of ``lines``, written to the shared folder.

    Line breaks inside of quotes belong to the record, as \\n. Where a file's last
    quote is never closed, its quotes do not join lines. Two passes over the
    files; what meets in one task is a row per block of a file, and the pieces of
    one record."""
    entries = cut_lineage(_entries(_summaries(lines)))
    n = entries.count()
    if n == 0:
        known = lines
    elif n <= BROADCAST_BLOCKS:
        known = lines.join(F.broadcast(entries), ["file", "block"], "left")
    else:
        # The order of lines is that of a read, which a shuffle would lose.
        number = lines.withColumn("at", F.monotonically_increasing_id())
        known = number.join(entries, ["file", "block"], "left").repartition("file", "block")
        known = known.sortWithinPartitions("file", "block", "at").drop("at")
    pieces = cut_lineage(_pieces(known))
    begun = pieces.filter(F.col("kind") != _REST)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = begun.groupBy("file", "block").agg(F.count("*").alias("n")).select(
        "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    in_order = Window.partitionBy("file").orderBy("block", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("kind") == _HEAD, F.struct("block", "place")), ignorenulls=True).over(in_order)
    parts = F.sort_array(F.collect_list(F.struct("block", "value")))["value"]
    joined = pieces.filter(F.col("kind") != _WHOLE).withColumn("owner", owner).select(
        "file", F.col("owner.block").alias("first"), F.col("owner.place").alias("place"), "block", "value"
    ).groupBy("file", "first", "place").agg(F.array_join(parts, "\n").alias("value")).withColumnRenamed("first", "block")
    whole = pieces.filter(F.col("kind") == _WHOLE).select("file", "block", "place", "value")
    return whole.unionByName(joined).join(starts, ["file", "block"]).select(
        "file", (F.col("start") + F.col("place")).alias("ordinal"), "value"
    )


# --- tables -----------------------------------------------------------------


def headers(records: DataFrame) -> DataFrame:
    """``file``, ``at`` (ordinal of the header), ``columns`` and their ``signature``.
    The first six records of a file meet in one group."""
    first = records.filter(F.col("ordinal") <= HEADER_ROWS).groupBy("file").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "value"))), lambda x: x["value"]).alias("lines")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, columns = [], []
            for lines in batch.column("lines").to_pylist():
                at.append(choose_header(lines))
                width = max(len(cells_of(line)) for line in lines[at[-1] :])
                columns.append(header_names(cells_of(lines[at[-1]]), width))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), pa.array(at, pa.int64()), pa.array(columns, pa.list_(pa.string()))], ["file", "at", "columns"]
            )

    found = first.mapInArrow(run, "file string, at bigint, columns array<string>")
    return found.withColumn("signature", F.sha2(F.to_json("columns"), 256))


def csv_columns(columns: list[str], value: str = "value") -> Column:
    """A record as a struct of text columns."""
    ddl = ", ".join(f"`{c.replace('`', '``')}` STRING" for c in columns)
    return F.from_csv(value, ddl, {"escape": '"', "maxCharsPerColumn": "-1"})


@dataclass
class Placed:
    """The data records of a folder, in a directory for each signature."""

    path: str
    columns: dict[str, list[str]]  # by signature
    spark: SparkSession

    def rows(self, signature: str) -> DataFrame:
        """``_source``, ``_ordinal`` and the text columns of all files of a signature."""
        found = self.spark.read.schema(RECORDS).parquet(f"{self.path}/signature={signature}")
        return found.select(
            F.col("file").alias(SOURCE), F.col("ordinal").alias(ORDINAL), csv_columns(self.columns[signature]).alias("r")
        ).select(SOURCE, ORDINAL, "r.*")


def placed_records(lines: DataFrame) -> Placed:
    """The records below the headers, dealt by signature."""
    spark = lines.sparkSession
    records = cut_lineage(csv_records(lines))
    files = cut_lineage(headers(records))
    data = records.join(files.select("file", "at", "signature"), "file").filter("ordinal > at")
    path = new_dir(spark, "records")
    data.select("file", (F.col("ordinal") - F.col("at") - 1).alias("ordinal"), "value", "signature").write.partitionBy(
        "signature"
    ).parquet(path)
    # One row for each header that differs from the others.
    known = files.groupBy("signature").agg(F.first("columns").alias("columns"))
    with_rows = data.select("signature").distinct()
    return Placed(path, {r["signature"]: list(r["columns"]) for r in known.join(with_rows, "signature").collect()}, spark)


def file_votes(placed: Placed) -> DataFrame:
    """``file``, ``signature``, ``rows``, ``filled`` and ``votes`` of every file with
    data; one aggregate per signature."""
    out = None
    for signature in sorted(placed.columns):
        one = clean.votes_by(placed.rows(signature).drop(ORDINAL), SOURCE).select(
            F.col(SOURCE).alias("file"), F.lit(signature).alias("signature"), "rows", "filled", "votes"
        )
        out = one if out is None else out.unionByName(one)
    return out


@dataclass
class TableGroup:
    """Files with one header and one typing: a frame with ``_source``, the typed
    columns and ``_ordinal``."""

    signature: str
    typing: clean.Typing
    df: DataFrame


@dataclass
class FolderScan:
    """``files``: a row per table that is not empty, with its group and report."""

    files: DataFrame
    groups: list[TableGroup]


def scan_tables(spark: SparkSession, path: str | list[str]) -> FolderScan | None:
    """All delimited files under ``path``, typed by a vote of each file; None if
    there are no data. The passes over the data do not depend on the number of
    files; the driver holds a plan for each header and typing that differ."""
    placed = placed_records(text_lines(spark.read.text(path)))
    if not placed.columns:
        return None
    chosen = F.transform("votes", lambda v: clean.decided(v))
    votes = cut_lineage(file_votes(placed).filter("filled > 0").withColumn("kinds", chosen))
    kinds = votes.select("signature", "kinds").distinct().orderBy("signature", F.to_json("kinds")).collect()
    groups, names = [], []
    for g, row in enumerate(kinds):
        columns = placed.columns[row["signature"]]
        typing = clean.typing_of(columns, row["kinds"])
        files = votes.filter((F.col("signature") == row["signature"]) & (F.col("kinds") == F.array(*map(F.lit, row["kinds"]))))
        rows = placed.rows(row["signature"]).join(files.select(F.col("file").alias(SOURCE)), SOURCE, "left_semi")
        groups.append(TableGroup(row["signature"], typing, typed(rows, typing, columns)))
        names.append(files.select(
            "file", F.lit(g).alias("group"), "rows", (F.col("rows") - F.col("filled")).alias("rows_dropped"),
            F.lit(typing.cols_dropped).cast("bigint").alias("cols_dropped"), F.lit(", ".join(typing.numeric_coerced)).alias("numeric_coerced"),
            F.lit(", ".join(typing.dates)).alias("date_coerced"),
        ))
    files = names[0]
    for more in names[1:]:
        files = files.unionByName(more)
    return FolderScan(files, groups)


def typed(rows: DataFrame, typing: clean.Typing, columns: list[str]) -> DataFrame:
    """Text rows by a plan; rows without a cell that the plan keeps are left out."""
    held = clean.Typing(
        {**typing.names, SOURCE: SOURCE, ORDINAL: ORDINAL}, [SOURCE, *typing.keep, ORDINAL],
        typing.integers, typing.decimals, typing.dates,
    )
    some = F.coalesce(*[F.col(f"`{c}`") for c in columns])
    return clean.apply_typing(rows.filter(some.isNotNull()), held).dropna("all", subset=[f"`{c}`" for c in typing.keep])

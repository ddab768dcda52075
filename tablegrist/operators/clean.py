"""Re-typing of messy tables by a parse-rate vote.

The order is part of the contract: names, null tokens, empty rows, empty
columns, numbers, dates. ``infer_typing`` reads the table once (one aggregate
for all columns) and returns a small plan; ``apply_typing`` is a lazy
projection, so a streaming job can freeze the plan of its first batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegrist.functions.text import WHITESPACE, WHITESPACE_RUN, strip_cell
from tablegrist.operators.kinds import TEXT, column_kinds, kind_of
from tablegrist.session import small_table

# Cells that mean "missing".
NULL_TOKENS = ("", "-", "--", "n/a", "na", "none", "null", "nan", "#n/a")
# Signs dropped before a number is parsed.
NUMBER_SIGNS = "$£€₹,"
# Name parts that let a text column be tried as dates.
DATE_HINTS = ("date", "month", "year", "period", "as of", "asof")
PARSE_SHARE = 0.8

# The inside of a character class of all blanks.
BLANK = WHITESPACE_RUN[1:-2]
# Cells worth parsing; text is turned away by its first characters. Letters
# other than the exponent cannot pass, so the cast that follows is strict.
PLAIN_NUMBER = r"^[+-]?[0-9]+(?:\.[0-9]+)?$"
NUMBER_SHAPE = rf"^[{BLANK}$£€₹,+-]*\.?\d[{BLANK}$£€₹,.\deE+-]*%*$"
INTEGER_SHAPE = rf"^[{BLANK}$£€₹,+-]*\d[{BLANK}$£€₹,\d]*$"
FRACTION_MARKS = "[.eE%]"
# Beyond so many digits a whole number may not fit a bigint.
MAX_INTEGER_DIGITS = 18
ISO_DATE = (
    r"^\d{4}-\d{1,2}(?:-\d{1,2}(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)?)?$"
)
# A time behind a date: hours and minutes, seconds, half of the day, zone.
TIME_PART = (
    r"(?:[ ,]+|(?<=\d)t)(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?)\d*)?(?: *([ap])\.?m\.?)?(?: *(z|utc|gmt|[+-]\d{2}:?\d{2}))?$"
)
# The months as they are written, in full or short.
MONTH = (
    "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|"
    "oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
NTH = "(?:st|nd|rd|th)?"
# What is left of a date when its separators are blanks, and which of its groups
# are year, month and day (0: the first of the month).
DATE_FORMS = (
    (r"^(\d{1,2}) (\d{1,2}) (\d{4}|\d{2})$", None),
    (r"^(\d{4}) (\d{1,2}) (\d{1,2})$", (1, 2, 3)),
    (r"^(\d{4})(\d{2})(\d{2})$", (1, 2, 3)),
    (rf"^(\d{{1,2}}){NTH} {MONTH} (\d{{4}}|\d{{2}})$", (3, 2, 1)),
    (rf"^{MONTH} (\d{{1,2}}){NTH} (\d{{4}})$", (3, 1, 2)),
    (rf"^(\d{{4}}) {MONTH} (\d{{1,2}})$", (1, 2, 3)),
    (rf"^{MONTH} (\d{{4}})$", (2, 1, 0)),
)


@dataclass
class Typing:
    """What one pass over a table decided."""

    names: dict[str, str]  # source name -> trimmed name
    keep: list[str]  # trimmed names, in order
    integers: list[str] = field(default_factory=list)
    decimals: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    rows: int = 0
    rows_dropped: int = 0
    cols_dropped: int = 0

    @property
    def numeric_coerced(self) -> list[str]:
        both = set(self.integers) | set(self.decimals)
        return [c for c in self.keep if c in both]

    def report(self) -> dict:
        return {
            "rows_dropped": self.rows_dropped,
            "cols_dropped": self.cols_dropped,
            "numeric_coerced": self.numeric_coerced,
            "date_coerced": self.dates,
        }


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def null_tokens(c: Column) -> Column:
    """Trimmed text with the tokens that mean "missing" as NULL."""
    return F.when(~F.lower(c).isin(*NULL_TOKENS), c)


def tidy_cells(df: DataFrame) -> DataFrame:
    """Null tokens in text columns and NaN in floating columns become NULL."""
    trimmed, out = [], []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if kind_of(f.dataType) == TEXT:
            trimmed.append(strip_cell(c).alias(f.name))
            c = null_tokens(c)
        else:
            trimmed.append(c)
            if f.dataType.typeName() in ("double", "float"):
                c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    # Two projections: a trimmed cell is used twice and computed once.
    return df.select(*trimmed).select(*out)


def _bare(c: Column) -> Column:
    """The cell without currency signs, blanks, plus and minus."""
    return F.translate(c, NUMBER_SIGNS + WHITESPACE + "+-", "")


def _digits(c: Column) -> Column:
    return F.rtrim(F.translate(c, NUMBER_SIGNS + WHITESPACE, ""), F.lit("%"))


def parse_number(c: Column) -> Column:
    """Number in a text cell; a percentage becomes a fraction, junk NULL."""
    unit = F.when(c.endswith("%"), 100.0).otherwise(1.0)
    return F.when(c.rlike(PLAIN_NUMBER), c.try_cast("double")).when(
        c.rlike(NUMBER_SHAPE), _digits(c).try_cast("double") / unit
    )


def parse_integer(c: Column) -> Column:
    return F.when(c.rlike(INTEGER_SHAPE), _digits(c).try_cast("bigint"))


def parse_date(c: Column) -> Column:
    """Moment in a text cell, or NULL. A cell is an ISO date, or a date with a time
    behind it: numbers and a month's name in any case, parted by blanks, commas,
    dots, slashes or dashes. Of two numbers before a year the month comes first
    unless it exceeds 12; two digits of a year are of this century."""
    cell = F.lower(c)
    # Cells that hold no digit or begin with a sign are no dates.
    return F.when(c.rlike(ISO_DATE), c.try_cast("timestamp")).when(
        cell.rlike(r"^[a-z0-9][^:]*\d"), _once(cell, _written_date)
    )


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used, and
    as an expression of its own: generated in full it is too large to compile."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _written_date(cell: Column) -> Column:
    timed = cell.contains(":")
    bare = F.when(timed, F.regexp_replace(cell, TIME_PART, "")).otherwise(cell)
    return _once(F.trim(F.regexp_replace(bare, r"[ ,./-]+", " ")), lambda date: _date_form(cell, date))


def _date_form(cell: Column, date: Column) -> Column:
    part = lambda shape, g: F.regexp_extract(date, shape, g)
    out = F.when(F.lit(False), F.lit(None).cast("timestamp"))
    for shape, places in DATE_FORMS:
        if places is None:
            one, two, year = (part(shape, g).cast("int") for g in (1, 2, 3))
            found = _moment(cell, year, F.when(one > 12, two).otherwise(one), F.when(one > 12, one).otherwise(two))
        else:
            year, month, day = (part(shape, g) if g else F.lit("1") for g in places)
            if MONTH in shape:
                month = (F.instr(F.lit(MONTHS), F.left(month, F.lit(3))) + 2) / 3
            found = _moment(cell, year.cast("int"), month.cast("int"), day.cast("int"))
        out = out.when(date.rlike(shape), found)
    return out


def _moment(cell: Column, year: Column, month: Column, day: Column) -> Column:
    """A date with the time that stands behind it in the cell."""
    part = lambda g: F.regexp_extract(cell, TIME_PART, g)
    number = lambda g, kind="int": F.coalesce(part(g).try_cast(kind), F.lit(0)).cast(kind)
    hour, half = number(1), part(4)
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    year = F.when(year < 100, year + 2000).otherwise(year)
    at = F.try_make_timestamp(year, month, day, hour, number(2), number(3, "decimal(8,6)"))
    zone = F.regexp_replace(part(5), "[^0-9+-]", "")
    minutes = F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int")
    off = F.when(zone.rlike(r"^[+-]\d{4}$"), minutes * F.when(zone.startswith("-"), -1).otherwise(1)).otherwise(0)
    # A time holds a colon; most dates have none.
    plain = F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))
    return F.when(cell.contains(":"), at - F.make_dt_interval(mins=off)).otherwise(plain)


def _dated(name: str) -> bool:
    return any(h in name.lower() for h in DATE_HINTS)


def _prepared(df: DataFrame, keys: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with trimmed names and tidy cells, its text cells parsed as numbers
    next to it (once for both votes), and the kinds of its columns but ``keys``."""
    held = [F.col(f"`{k}`") for k in keys]
    cells = tidy_cells(trim_names(df))
    kinds = {n: k for n, k in column_kinds(cells).items() if n not in keys}
    numbers = [
        parse_number(F.col(f"`{n}`")).alias(f"_num{i}") for i, (n, k) in enumerate(kinds.items()) if k == TEXT
    ]
    return cells.select(*held, *[F.col(f"`{n}`") for n in kinds], *numbers), kinds


def _votes(kinds: dict[str, str]) -> list[Column]:
    """The aggregates that decide a table's types: its rows, those with a cell, and
    for each column its cells and how many of them read as number, whole number
    and date. All of them are counts, so votes of parts of a table add up."""
    some_cell = F.coalesce(*[F.col(f"`{c}`").cast("string") for c in kinds])
    each = []
    for i, (name, kind) in enumerate(kinds.items()):
        c, none = F.col(f"`{name}`"), F.lit(0).cast("bigint")
        number = whole = date = none
        if kind == TEXT:
            parsed = F.col(f"_num{i}")
            fits = ~c.rlike(FRACTION_MARKS) & (F.length(_bare(c)) <= MAX_INTEGER_DIGITS)
            number, whole = F.count(parsed), F.count_if(parsed.isNotNull() & fits)
            date = F.count(parse_date(c)) if _dated(name) else none
        each.append(F.struct(F.count(c).alias("n"), number.alias("number"), whole.alias("whole"), date.alias("date")))
    return [F.count(F.lit(1)).alias("rows"), F.count(some_cell).alias("filled"), F.array(*each).alias("votes")]


#: What a vote makes of a column of text; wider kinds come later.
EMPTY, INTEGER, DECIMAL, DATE, PLAIN = "empty", "integer", "decimal", "date", "text"


def decided(vote: Column, share: float = PARSE_SHARE) -> Column:
    """The kind a column of text gets by its votes."""
    n, number = vote["n"], vote["number"]
    return (
        F.when(n == 0, EMPTY)
        .when(number / n >= share, F.when(vote["whole"] == number, INTEGER).otherwise(DECIMAL))
        .when(vote["date"] / n >= share, DATE)
        .otherwise(PLAIN)
    )


def typing_of(columns: list[str], kinds: list[str], rows: int = 0, filled: int = 0) -> Typing:
    """The plan for columns of text with kinds as ``decided`` names them."""
    out = Typing(names={c: c.strip() for c in columns}, keep=[], rows=filled)
    out.rows_dropped = rows - filled
    lists = {INTEGER: out.integers, DECIMAL: out.decimals, DATE: out.dates, PLAIN: []}
    for c, kind in zip(columns, kinds):
        if kind == EMPTY:
            out.cols_dropped += 1
        else:
            out.keep.append(c.strip())
            lists[kind].append(c.strip())
    return out


def votes_by(df: DataFrame, *keys: str) -> DataFrame:
    """``keys``, ``rows``, ``filled`` and ``votes`` of each group of rows; all other
    columns are text. One aggregate for any number of groups."""
    tidy, kinds = _prepared(df, keys)
    return tidy.groupBy(*keys).agg(*_votes(kinds))


def infer_typing(df: DataFrame, share: float = PARSE_SHARE) -> Typing:
    tidy, kinds = _prepared(df)
    chosen = F.transform("votes", lambda v: decided(v, share))
    got = tidy.agg(*_votes(kinds)).select("rows", "filled", "votes", chosen.alias("chosen")).first()
    # Typed columns keep their type; an empty one goes as a text column does.
    kept = [PLAIN if k != TEXT and v["n"] else c for c, k, v in zip(got["chosen"], kinds.values(), got["votes"])]
    return typing_of(df.columns, kept, got["rows"], got["filled"])


def apply_typing(df: DataFrame, typing: Typing) -> DataFrame:
    tidy = tidy_cells(df.toDF(*[typing.names.get(c, c.strip()) for c in df.columns]))
    out = []
    for name in typing.keep:
        c = F.col(f"`{name}`")
        if name in typing.integers:
            c = parse_integer(c)
        elif name in typing.decimals:
            c = parse_number(c)
        elif name in typing.dates:
            c = parse_date(c)
        out.append(c.alias(name))
    return tidy.dropna("all").select(*out)


def clean(df: DataFrame, share: float = PARSE_SHARE) -> tuple[DataFrame, dict]:
    """Cleaned table and its report."""
    typing = infer_typing(df, share)
    return apply_typing(df, typing), typing.report()


def report_rows(df: DataFrame, table: str, share: float = PARSE_SHARE) -> DataFrame:
    """The cleaning report as one row."""
    r = infer_typing(df, share).report()
    return small_table(df.sparkSession, [
            (
                table,
                r["rows_dropped"],
                r["cols_dropped"],
                ", ".join(r["numeric_coerced"]),
                ", ".join(r["date_coerced"]),
            )
        ],
        "table string, rows_dropped bigint, cols_dropped bigint, "
        "numeric_coerced string, date_coerced string",
    )

"""Text and name normalisation as Column expressions.

All rules run inside whole-stage code except Unicode NFKC, which Spark has no
built-in for; that one goes through an Arrow UDF and only for the values that
hold an ``UNSETTLED`` character (everything else is sent across as NULL).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip()/split() treat as blank.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RUN = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
# The same for text without a character beyond U+00FF. Listed one by one they are
# looked up in a table; each range is a step of its own for every character.
LATIN_RUN = r"[\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x{85}\x{A0}]+"
RARE_BLANK = r"[^\x00-\xFF](?<=[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}])"
NOT_BLANK = "[^" + WHITESPACE_RUN[1:-1]
RARE_BREAK = r"[\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
BLANKS = WHITESPACE_RUN[:-1] + "*"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"

# Tokens that do not distinguish one entity name from another.
NAME_NOISE = ("fund", "scheme", "plan", "the", "an", "a")

# Look-alike characters and what replaces them.
LOOKALIKES = {
    "\u00a0": " ",  # no-break space
    "\u2009": " ",  # thin space
    "\u2018": "'",  # left single quote
    "\u2019": "'",  # right single quote
    "\u201c": '"',  # left double quote
    "\u201d": '"',  # right double quote
    "\u2013": "-",  # en dash
    "\u2014": "-",  # em dash
    "\u200b": "",  # zero-width space
    "\ufeff": "",  # byte-order mark
}
ELLIPSIS = "\u2026"

# Fixed value: a line that is only a page number ("~" stands for blanks).
PAGE_NUMBER_LINE = r"(?i)^~(?:page~)?\d+(?:~(?:of|/)~\d+)?~$".replace("~", BLANKS)

DEFAULT_WINDOW = 180
DEFAULT_OVERLAP = 40
# Characters beyond ASCII that NFKC leaves alone and never joins to the one before,
# and the few frequent ones it always replaces in the same way.
SETTLED = (
    "\xa1-\xa7\xa9\xab-\xae\xb0\xb1\xb6\xb7\xbb\xbf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e"
    "\u200b\u2010\u2012-\u2015\u2018-\u201e\u2022\u20ac\ufeff"
)
REPLACED = {"\xa0": " ", "\u2009": " ", "\u2026": "..."}
# The plain class is tried first, as most characters are ASCII.
UNSETTLED = f"[^\\x00-\\x7F](?<![{SETTLED}{''.join(REPLACED)}])"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Rows held as Python strings at a time; the others stay in their Arrow batch.
NFKC_ROWS = 64


def _nfkc_batch(values: pa.Array) -> pa.Array:
    # Not Arrow's own utf8_normalize: it leaves letters and accents apart.
    done = [
        pa.array([v and unicodedata.normalize("NFKC", v) for v in part.to_pylist()], pa.string())
        for part in (values.slice(i, NFKC_ROWS) for i in range(0, len(values), NFKC_ROWS))
    ]
    return pa.concat_arrays(done) if done else values


# Declared non-deterministic so that a filter on a normalised name is not
# copied below its projection, which would run the normalisation twice.
_nfkc_udf = F.arrow_udf(_nfkc_batch, T.StringType()).asNondeterministic()


def nfkc(c: Column | str) -> Column:
    c = _col(c)
    plain = c
    for k, v in REPLACED.items():
        plain = F.replace(plain, F.lit(k), F.lit(v))
    return F.coalesce(_nfkc_udf(F.when(c.rlike(UNSETTLED), c)), plain)


def strip(c: Column | str) -> Column:
    """Trim every Unicode blank, not only U+0020 as ``trim`` does."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def strip_cell(c: Column | str) -> Column:
    """``strip`` for short text. A cell that starts and ends with a visible
    ASCII character, the usual case, is left alone at once."""
    c = _col(c)
    visible = F.ascii(c).between(33, 126) & F.ascii(F.right(c, F.lit(1))).between(33, 126)
    return F.when(visible, c).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def words(c: Column | str) -> Column:
    """Whitespace-separated words; blank text gives an empty array."""
    trimmed = strip(c)
    cut = F.when(trimmed.rlike(RARE_BLANK), F.split(trimmed, WHITESPACE_RUN)).otherwise(F.split(trimmed, LATIN_RUN))
    return F.when(F.length(trimmed) > 0, cut).when(trimmed.isNotNull(), F.array().cast("array<string>"))


def lines(c: Column | str) -> Column:
    """Lines without their breaks; a final break opens no further line. Text
    whose only breaks are newlines is cut by the plain one-character split."""
    c = _col(c)
    rare = c.rlike(RARE_BREAK)
    plain = F.when(c.endswith("\n"), _chop(c)).otherwise(c)
    odd = F.regexp_replace(c, f"(?:{LINE_BREAK})\\z", "")
    return F.when(rare, F.split(odd, LINE_BREAK)).otherwise(F.split(plain, "\n"))


def _chop(c: Column) -> Column:
    return F.substring(c, F.lit(1), F.length(c) - 1)


def trimmed_lines(c: Column | str) -> Column:
    return F.transform(lines(c), strip_cell)


def normalise_text(c: Column | str) -> Column:
    """Canonical form of prose: NFKC, ASCII punctuation, re-joined hyphenated
    line wraps, no blanks before a break, at most one empty line in a row."""
    keep = [k for k, v in LOOKALIKES.items() if v]
    drop = [k for k, v in LOOKALIKES.items() if not v]
    out = F.translate(nfkc(c), "".join(keep + drop), "".join(LOOKALIKES[k] for k in keep))
    out = F.replace(out, F.lit(ELLIPSIS), F.lit("..."))
    out = F.regexp_replace(out, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    out = F.regexp_replace(out, r"[ \t]+\n", "\n")
    return F.regexp_replace(out, r"\n{3,}", "\n\n")


def canonical_name(c: Column | str, noise: Sequence[str] = NAME_NOISE) -> Column:
    """Entity key of a name: lower case, only ``[a-z0-9 ]``, noise words out,
    single blanks. NULL gives the empty string; applying it twice changes
    nothing."""
    out = F.regexp_replace(F.lower(nfkc(_col(c).cast("string"))), r"[^a-z0-9 ]", " ")
    if noise:
        out = F.regexp_replace(out, r"\b(?:" + "|".join(noise) + r")\b", " ")
    out = F.trim(F.regexp_replace(out, " +", " "))
    return F.coalesce(out, F.lit(""))


def window_bodies(word_col: str, size: int = DEFAULT_WINDOW, overlap: int = DEFAULT_OVERLAP) -> Column:
    """Overlapping word windows of an existing ``array<string>`` column. Takes a
    column name, not an expression, so the split is done once per row."""
    step = max(1, size - overlap)
    w = F.col(word_col)
    starts = F.when(
        F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(step))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, F.lit(size)), " "))


def framed(header: Column | None, body: Column) -> Column:
    return body if header is None else F.concat_ws("\n", header, body)


def excerpt(c: Column | str, limit: int = 120) -> Column:
    w = words(c)
    tail = F.when(F.size(w) > limit, F.lit("...")).otherwise(F.lit(""))
    return F.concat(F.array_join(F.slice(w, 1, limit), " "), tail)


def is_page_number(line: Column) -> Column:
    return line.rlike(PAGE_NUMBER_LINE)


def name_tokens(c: Column | str) -> Column:
    """Distinct lower-case ``[a-z0-9]+`` tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9]+"), F.lit(0)))


def plain_number(c: Column) -> Column:
    """A double as people write it: no exponent between 1e-4 and 1e16."""
    text = c.cast("string")
    size = F.abs(c)

    def positional(scale: int) -> Column:
        fixed = text.try_cast(f"decimal(38,{scale})").cast("string")
        short = F.regexp_replace(fixed, "0+$", "")
        return F.when(short.endswith("."), F.concat(short, F.lit("0"))).otherwise(short)

    return (
        F.when((size >= 1e7) & (size < 1e16), positional(10))
        .when((size >= 1e-4) & (size < 1e-3), positional(24))
        .otherwise(text)
    )


def cell_text(name: str, dtype: T.DataType) -> Column:
    """A cell as text, the form used in row bodies and cell postings."""
    c = F.col(f"`{name}`")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return plain_number(c.cast("double"))
    return c.cast("string")


def attribute_list(fields: Sequence[T.StructField]) -> Column:
    """``a=1; b=2`` over the given fields, NULL cells left out."""
    parts = []
    for f in fields:
        cell = cell_text(f.name, f.dataType)
        parts.append(F.when(cell.isNotNull(), F.concat(F.lit(f"{f.name}="), cell)))
    return F.concat_ws("; ", *parts)


def row_body(file: str, fields: Sequence[T.StructField]) -> Column:
    return F.concat(F.lit(f"Row from {file}: "), attribute_list(fields), F.lit("."))

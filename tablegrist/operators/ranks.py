"""Exact order statistics without a global sort.

Values are taken as 64-bit numbers in the same order: doubles by their bits, whole
numbers, days and moments as they are. A pass counts the rows by their first 22
bits; the count says in which of these groups a rank lies, and the next pass looks
at the next 21 bits inside such groups only. So any number of ranks of any number
of columns takes three passes at most, and fewer where a group holds one value.
Counts add up, so they are combined before the shuffle and skew does not matter.

Other types have no such number. Their values are counted, dealt by range, and a
rank is sought in the one range that holds it.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegrist.session import cut_lineage

#: Bits behind the digit of each pass.
SHIFTS = (42, 21, 0)
#: Groups of digits that are read before the digits themselves.
COARSE = 11

_MANTISSA = 1 << 52
_NAN = 0x7FF8 << 48
_WHOLE = ("byte", "short", "integer", "long", "date", "timestamp")


def ordered_bits(c: Column, kind: str) -> Column | None:
    """A column as bigint in the order of its values, or None for other types. NaN
    comes last, -0.0 is 0.0, NULL stays NULL."""
    if kind in ("byte", "short", "integer", "long"):
        return c.cast("bigint")
    if kind == "date":
        return F.unix_date(c).cast("bigint")
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind not in ("double", "float"):
        return None
    x = F.abs(c.cast("double"))
    guess = _guess(x)
    return _signed_bits(c, _magnitude(x, _exponent(x, guess, F.pow(F.lit(2.0), guess))))


def _guess(x: Column) -> Column:
    """The exponent by logarithm, which may be off by one next to a power of two."""
    return F.least(F.greatest(F.floor(F.log2(x)), F.lit(-1022).cast("bigint")), F.lit(1023).cast("bigint"))


def _exponent(x: Column, guess: Column, low: Column) -> Column:
    exponent = guess + F.when(low > x, -1).when(x >= low * 2, 1).otherwise(0)
    return F.least(F.greatest(exponent, F.lit(-1022)), F.lit(1023))


def _magnitude(x: Column, exponent: Column) -> Column:
    part = ((x / F.pow(F.lit(2.0), exponent) - 1) * float(_MANTISSA)).cast("bigint")
    tiny = (x * 2.0**537 * 2.0**537).cast("bigint")
    return (
        F.when(F.isnan(x), _NAN).when(x == float("inf"), 0x7FF << 52).when(x == 0, 0)
        .when(x < 2.0**-1022, tiny).otherwise((exponent + 1023) * _MANTISSA + part)
    ).cast("bigint")


def _signed_bits(c: Column, bits: Column) -> Column:
    return F.when(c.isNotNull(), F.when((c < 0) & ~F.isnan(c), -bits).otherwise(bits))


def from_bits(bits: int) -> float:
    """The double of its ordered bits."""
    return math.copysign(struct.unpack("<d", struct.pack("<Q", abs(bits)))[0], bits)


def select_ranks(cells: DataFrame, wanted: dict[int, list[int]]) -> dict[tuple[int, int], int]:
    """The keys at 0-based ``ranks`` of each column of ``cells`` (``c`` int, ``key``
    bigint without NULLs). The driver sees at most 2 * 2,048 counts for each group
    that still holds a rank."""
    found: dict[tuple[int, int], int] = {}
    # (column, digits before) -> the ranks sought, counted from the group's start.
    open_ = {(c, 0): [(r, r) for r in sorted(set(ranks))] for c, ranks in wanted.items() if ranks}
    for level, shift in enumerate(SHIFTS):
        if not open_:
            break
        rows = cells
        if level:
            before = SHIFTS[level - 1]
            groups = [(F.col("c") == c) & (F.shiftright("key", before) == p) for c, p in open_]
            any_group = groups[0]
            for g in groups[1:]:
                any_group = any_group | g
            # Not a filter: it would be moved below the steps that make the keys and
            # write them all out once for each group. The others count as one group.
            rows = rows.withColumn("prefix", F.when(any_group, F.shiftright("key", before)))
        else:
            rows = rows.withColumn("prefix", F.lit(0).cast("bigint"))
        counts = cut_lineage(
            rows.groupBy("c", "prefix", F.when(F.col("prefix").isNotNull(), F.shiftright("key", shift)).alias("digit"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        ).filter("prefix is not null")
        coarse = F.shiftright("digit", COARSE).alias("digit")
        upper = counts.groupBy("c", "prefix", coarse).agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
        )
        open_ = _descend(upper, open_, found)
        if open_:
            parts = [(F.col("c") == c) & (F.shiftright("digit", COARSE) == p) for c, p in open_]
            some = parts[0]
            for part in parts[1:]:
                some = some | part
            lower = counts.filter(some).select("c", F.shiftright("digit", COARSE).alias("prefix"), "digit", "n", "low", "high")
            open_ = _descend(lower, open_, found)
    return found


def _descend(counts: DataFrame, open_: dict, found: dict) -> dict:
    """The groups one level down that hold the ranks; ranks in a group of one key
    are found."""
    listed: dict[tuple[int, int], list] = {}
    for r in counts.collect():
        listed.setdefault((r["c"], r["prefix"]), []).append((r["digit"], r["n"], r["low"], r["high"]))
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for (c, prefix), ranks in open_.items():
        bins = iter(sorted(listed[c, prefix]))
        digit, n, low, high = next(bins)
        before = 0
        for within, rank in ranks:
            while within >= before + n:
                before += n
                digit, n, low, high = next(bins)
            if low == high:
                found[c, rank] = low
            else:
                out.setdefault((c, digit), []).append((within - before, rank))
    return out


def rank_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``c`` (place in ``columns``) and ``key`` of the non-NULL cells. Doubles are
    taken apart after they are rows: written out for each column, their bits make
    one method that the JVM neither generates nor compiles."""
    none = {"x": F.lit(None).cast("double"), "key": F.lit(None).cast("bigint")}
    cells = []
    for i, name in enumerate(columns):
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType.typeName()
        # Decimals are ranked as the doubles they are given as.
        own = {"key": ordered_bits(c, kind)} if kind in _WHOLE else {"x": c.cast("double")}
        cells.append(F.struct(F.lit(i).alias("c"), *[v.alias(n) for n, v in (none | own).items()]))
    rows = df.select(F.inline(F.array(*cells)))
    if all(df.schema[name].dataType.typeName() in _WHOLE for name in columns):
        return rows.select("c", "key").filter("key is not null")
    # Steps of their own, as each is read more than once by the next.
    rows = rows.filter("x is not null or key is not null").withColumn("_abs", F.abs("x"))
    rows = rows.withColumn("_guess", _guess(F.col("_abs"))).withColumn("_low", F.pow(F.lit(2.0), "_guess"))
    rows = rows.withColumn("_exponent", _exponent(F.col("_abs"), F.col("_guess"), F.col("_low")))
    rows = rows.withColumn("_bits", _magnitude(F.col("_abs"), F.col("_exponent")))
    return rows.select("c", F.coalesce("key", _signed_bits(F.col("x"), F.col("_bits"))).alias("key"))


def order_statistics(df: DataFrame, ranks: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """The values at 0-based ``ranks`` of each (numeric) column's non-NULL values
    as doubles, -inf first, inf and then NaN last."""
    names = [c for c in ranks if ranks[c]]
    if not names:
        return {}
    got = select_ranks(rank_cells(df, names), {i: ranks[c] for i, c in enumerate(names)})
    whole = {c for c in names if df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long")}
    return {(names[i], r): float(k) if names[i] in whole else from_bits(k) for (i, r), k in got.items()}


def exact_quantiles(
    df: DataFrame,
    counts: dict[str, int],
    probs: Sequence[float],
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles, given each column's non-NULL count."""
    def ends(n: int, p: float) -> tuple[int, int, float]:
        pos = p * (n - 1)
        low = math.floor(pos)
        return low, min(low + 1, n - 1), pos - low

    ranks = {
        c: [r for p in probs for r in ends(n, p)[:2]] for c, n in counts.items() if n > 0
    }
    values = order_statistics(df, ranks)
    out: dict[str, list[float | None]] = {}
    for c, n in counts.items():
        row: list[float | None] = []
        for p in probs:
            if n == 0:
                row.append(None)
                continue
            low, high, part = ends(n, p)
            a, b = values[c, low], values[c, high]
            # Equal ends need no step, which for infinite ones would be NaN.
            row.append(a if part == 0 or a == b else a + (b - a) * part)
        out[c] = row
    return out


def value_at(df: DataFrame, column: str, rank: int) -> Column:
    """The value at a 0-based rank of a column without NULLs, in its own type, as a
    literal column."""
    c, kind = F.col(f"`{column}`"), df.schema[column].dataType
    bits = ordered_bits(c, kind.typeName())
    if bits is None:
        return F.lit(_value_by_range(df.select(c.alias("x")), rank))
    found = select_ranks(rank_cells(df, [column]), {0: [rank]})[0, rank]
    if kind.typeName() in ("double", "float"):
        return F.lit(from_bits(found)).cast(kind)
    key = F.lit(found).cast("bigint")
    if kind.typeName() == "date":
        return F.date_from_unix_date(key.cast("int"))
    return F.timestamp_micros(key) if kind.typeName() == "timestamp" else key.cast(kind)


def _value_by_range(df: DataFrame, rank: int):
    """The value at a rank of ``x``: equal values are one row with their count, the
    rows are dealt by range, and one range is sorted."""
    counts = cut_lineage(
        df.groupBy("x").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("x").withColumn("part", F.spark_partition_id())
    )
    for part in sorted(counts.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["part"]):
        if rank < part["n"]:
            break
        rank -= part["n"]
    upto = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    here = counts.filter(F.col("part") == part["part"]).withColumn("upto", F.sum("n").over(upto))
    return here.filter(F.col("upto") > rank).agg(F.min("x")).first()[0]

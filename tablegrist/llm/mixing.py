"""Mixing sources to target weights over the course of a training run.

Every source has a weight schedule over training time 0 to 1. Its integral is the
source's share; targets are capped at a number of passes over the source, and the
excess goes to the others by weight. The documents of a source, in a fixed random
order and pass after pass, fill its target one after the other; where a document
begins on that scale of words is turned, by the inverse of the integrated
schedule, into its position in training. Documents are range-sorted by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablegrist.llm.rows import FILE, ROW, located
from tablegrist.llm.reuse import compacted
from tablegrist.session import cut_lineage

#: Blanks between words: `[\x20\x09-\x0D]`.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Mean number of documents in a slice whose sizes are summed up in one task.
SLICE_ROWS = 1000
#: Documents over 1/50 of what is left of a source's target after whole passes,
#: or of a twentieth of the source if that is more, are chosen before the small
#: ones, so that the target ends with a small document.
LARGE, LARGE_SHARE = 50, 0.05


def n_words(text: Column) -> Column:
    """Number of runs of characters other than blanks; 0 for null."""
    marked = F.regexp_replace(
        text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "."
    )
    blank = F.btrim(text, F.lit(BLANKS)) == ""
    return F.when(text.isNull() | blank, 0).otherwise(F.length(marked)).cast("long")


def capped_targets(sources: DataFrame, most: float) -> DataFrame:
    """``sources`` (``source``, ``source_size``, ``weight``) with ``target``.

    The targets share out the sum of all sizes by weight, none over ``most``
    times its source: with the sources in order of size per weight, the first
    ones are at their cap and the rest share what is left by weight. One row per
    source goes through one window.
    """
    order = W.orderBy(F.col("cap") / F.col("weight"), "source")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(every)
    weighted = sources.withColumns({"cap": most * F.col("source_size"), "total": total}).filter("weight > 0")
    capped = weighted.withColumn(
        "level",
        (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after),
    )
    # The first source under its cap shares with all later ones at its level;
    # taking later ones for the first would give a lower level.
    level = F.max(F.when(F.col("weight") * F.col("level") <= F.col("cap"), F.col("level"))).over(every)
    return capped.select(
        "source", "weight", "source_size",
        F.least(F.col("cap"), F.coalesce(F.col("weight") * level, F.col("cap"))).alias("target"),
    )


def integrated(schedule: DataFrame) -> DataFrame:
    """``schedule`` (``source``, ``since``, ``weight``: the weight holds until the
    next ``since`` or 1) as one row per source: ``weight``, the integral, and
    ``steps``, where each step begins in time and on the integral."""
    by_time = W.partitionBy("source").orderBy("since")
    steps = schedule.select(
        "source", F.col("since").cast("double"), F.col("weight").cast("double").alias("slope")
    ).filter("since < 1 and slope >= 0")
    steps = steps.withColumn("area", F.col("slope") * (F.coalesce(F.lead("since").over(by_time), F.lit(1.0)) - F.col("since")))
    steps = steps.withColumn("begun", F.sum("area").over(by_time) - F.col("area"))
    return steps.groupBy("source").agg(
        F.sum("area").alias("weight"),
        F.sort_array(F.collect_list(F.struct("begun", "since", "slope"))).alias("steps"),
    )


def mix(
    docs: DataFrame,
    schedule: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    most: float = 3,
) -> DataFrame:
    """What the mix takes of each row of ``docs`` (located): ``id``, ``source``,
    ``size`` (words), ``source_size``, ``target``, ``repeats``, ``taken`` (words,
    repeats counted), ``positions`` (one for each repeat), ``position`` (the
    first) and the row's place; range-sorted by ``position``, rows not taken last.

    Null text has no words. Null is a source of its own. A source without a
    schedule, or with weight 0, has target 0. Empty documents are never taken.
    Rows that repeat are rows of their own. The order within a source comes from
    a hash of id and text, so reruns agree. An empty table gives no rows.
    """
    rows = cut_lineage(
        docs.select(
            F.col(key).alias("id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
            F.xxhash64(F.col(key), F.col(text)).alias("rank"), FILE, ROW,
        )
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sizes = compacted(sizes)
    shares = integrated(schedule)
    weighted = sizes.join(shares, sizes["source"].eqNullSafe(shares["source"]), "left").select(
        sizes["source"], "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"), "steps"
    )
    targets = capped_targets(weighted.drop("steps"), most)
    plan = weighted.drop("weight", "source_size").alias("w").join(
        targets.alias("t"), F.col("w.source").eqNullSafe(F.col("t.source")), "left"
    ).select("w.source", "steps", "weight", F.coalesce("target", F.lit(0.0)).alias("target"))
    plan = compacted(
        sizes.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).select(
            "s.source", "source_size", "steps", "weight", "target",
            F.greatest(F.lit(1), F.ceil(F.col("n") / SLICE_ROWS)).alias("slices"),
        )
    )
    return _placed(rows, plan)


def _placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with what is taken of them: whole passes over the source, and of the
    rest of the target one more pass over some of the documents."""
    plan = plan.withColumn("passes", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
    plan = plan.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    rows = rows.alias("r").join(
        plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))
    ).drop(F.col("p.source"))
    large = F.col("size") * LARGE > F.greatest(F.col("rest"), F.col("source_size") * LARGE_SHARE)
    rows = rows.withColumns({
        "slice": F.pmod(F.col("rank"), F.col("slices")),
        "small": F.when(large, 0).otherwise(F.col("size")),
    })
    first = _large_first(rows.filter(large))
    rows = rows.join(first.select(FILE, ROW, F.lit(True).alias("first")), [FILE, ROW], "left")
    left = first.groupBy("source").agg(F.min("left").alias("left"))
    sums = rows.groupBy("source", "slice").agg(
        F.sum("size").alias("slice_size"), F.sum("small").alias("slice_small")
    )
    ahead = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(
        "source", "slice",
        F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)).alias("ahead"),
        F.coalesce(F.sum("slice_small").over(ahead), F.lit(0)).alias("small_ahead"),
    )
    sums = sums.alias("s").join(
        left.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source")), "left"
    ).drop(F.col("l.source"))
    within = W.partitionBy("source", "slice").orderBy("rank", "id", FILE, ROW).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({
        "earlier": F.coalesce(F.sum("size").over(within), F.lit(0)),
        "small_earlier": F.coalesce(F.sum("small").over(within), F.lit(0)),
    })
    rows = rows.alias("r").join(
        sums.alias("s"),
        F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.slice") == F.col("s.slice")),
    ).select(
        "r.*", (F.col("ahead") + F.col("earlier")).alias("begin"),
        (F.col("small_ahead") + F.col("small_earlier")).alias("small_begin"),
        F.coalesce("left", "rest").alias("left"),
    )
    # A small document is in if its middle lies within what is left.
    fits = (F.col("small") > 0) & (F.col("small_begin") + F.col("small") / 2 <= F.col("left"))
    more = F.coalesce("first", F.lit(False)) | fits
    repeats = F.when(F.col("size") > 0, F.col("passes") + more.cast("int")).otherwise(0).cast("int")

    def demand(p: Column) -> Column:
        """The words of the target that come before the document in pass ``p``.
        In the last pass the small documents that are in fill the rest in their
        order, the large ones stand among them by theirs."""
        last = F.when(F.col("small") > 0, F.col("small_begin") * F.try_divide("rest", "left")).otherwise(
            F.col("begin") * F.try_divide("rest", "source_size")
        )
        return p * F.col("source_size") + F.when(p < F.col("passes"), F.col("begin")).otherwise(last)

    rows = rows.withColumn("repeats", repeats)
    positions = F.when(
        F.col("repeats") > 0,
        F.transform(
            F.sequence(F.lit(0), F.col("repeats") - 1),
            lambda p: _position(demand(p) / F.col("target") * F.col("weight")),
        ),
    ).otherwise(F.array().cast("array<double>"))
    return (
        rows.withColumn("positions", positions)
        .select(
            "id", "source", "size", "source_size", "target", "repeats",
            (F.col("size") * F.col("repeats")).alias("taken"), "positions",
            F.get("positions", F.lit(0)).alias("position"), FILE, ROW,
        )
        .repartitionByRange(F.col("position").asc_nulls_last(), F.xxhash64(FILE, ROW))
        .sortWithinPartitions(F.col("position").asc_nulls_last(), "id")
    )


def _large_first(rows: DataFrame) -> DataFrame:
    """Of the large documents those that are in the last pass, the largest first
    as long as they fit, with what is ``left`` of the source's target after them.
    A source has at most LARGE / LARGE_SHARE of them."""
    one = F.struct((-F.col("size")).alias("minus"), "rank", "id", FILE, ROW)
    lists = rows.groupBy("source").agg(
        F.sort_array(F.collect_list(one)).alias("docs"), F.first("rest").alias("rest")
    )
    place = f"struct<{FILE}:string,{ROW}:bigint>"
    start = F.struct(F.col("rest").alias("left"), F.array().cast(f"array<{place}>").alias("taken"))

    def next_one(so_far: Column, d: Column) -> Column:
        taken = F.concat(so_far["taken"], F.array(F.struct(d[FILE].alias(FILE), d[ROW].alias(ROW)).cast(place)))
        with_it = F.struct((so_far["left"] + d["minus"]).alias("left"), taken.alias("taken"))
        return F.when(-d["minus"] <= so_far["left"], with_it).otherwise(so_far)

    chosen = lists.select("source", F.aggregate("docs", start, next_one).alias("end"))
    return chosen.select("source", "end.left", F.inline_outer("end.taken"))


def _position(area: Column) -> Column:
    """The time at which the integral of a source's schedule reaches ``area``."""
    step = F.element_at(F.filter("steps", lambda s: s["begun"] <= area), -1)
    return step["since"] + F.when(step["slope"] > 0, (area - step["begun"]) / step["slope"]).otherwise(0.0)


def constant(sources: DataFrame, weight: Column) -> DataFrame:
    """A schedule in which each source has one weight all the time."""
    return sources.select("source", F.lit(0.0).alias("since"), weight.alias("weight"))


def by_rank(docs: DataFrame, source: str = "source", cycle: int = 3) -> DataFrame:
    """Weights 1 to ``cycle``, again and again, over the sources in order of code
    points, null last. One row per source goes through one window."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    names = docs.select(F.col(source).alias("source")).distinct()
    return constant(names, (F.row_number().over(order) - 1) % cycle + 1)


def training_order(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs`` (located) as the mix feeds them: one row for each
    repeat, range-sorted by position, with the columns of ``docs``."""
    names = [c for c in docs.columns if c not in (FILE, ROW)]
    fed = docs.join(
        mixed.filter("repeats > 0").select(FILE, ROW, F.explode("positions").alias("__position")), [FILE, ROW]
    )
    return (
        fed.repartitionByRange("__position", F.xxhash64(FILE, ROW))
        .sortWithinPartitions("__position")
        .select(*[fed[n] for n in names])
    )


def mixed_documents(docs: DataFrame, schedule: DataFrame, **options) -> DataFrame:
    """``docs`` mixed by ``schedule``, in training order."""
    docs = located(docs)
    return training_order(docs, mix(docs, schedule, **options))

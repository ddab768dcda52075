"""Exact Jaccard self-join of word shingle sets by segments of the universe.

All shingles are dealt over m segments by their hash. Two sets that are similar
enough differ in at most h shingles, so if lookups of a set are chosen such that
each allows its segment to differ in less than v shingles and the v sum up to
h + 1, one of them finds the other set: v is 0 for a segment that is left out, 1
for one looked up as it is, 2 for one looked up with its one-deletion
neighbourhood. m and h belong to a band of set sizes; a set has its segments in
its own band and, if sets of the band below can be similar, in that one too.

There are more lookups than h + 1 asks for, and each set leaves out those that
would meet the most other sets, such as segments without a shingle. What meets is
compared by odd sketches first, whose distance is never above the true one, and
then by the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegrist.llm.components import components
from tablegrist.llm.grams import mixed
from tablegrist.llm.reuse import compacted
from tablegrist.llm.rows import FILE, ROW, located
from tablegrist.llm.shingles import alike, shingle_sets, slices
from tablegrist.llm.tidy import tidy
from tablegrist.session import cut_lineage

#: Segments at the front whose one-deletion neighbourhoods are indexed, too.
NEIGHBOURED = 2
#: Members of a bucket that are compared with each other in one task, and pairs
#: (or words of their sketches) that are compared at once.
BLOCK, PAIRS = 1024, 1 << 19
#: Odd sketches of a set. One tells sets apart that have little in common, the second
#: most of those just below the bound; they go with every row that meets others.
SKETCHES = 2
#: Of the buckets a set is in, and of those in which it looks others up, the smallest
#: so many go with it.
MET = 16
#: Of the members of other components that a set may be similar to in a bucket, so many
#: are compared with it at first; thirty-two times as many in each further round.
NEAREST = 2
#: Pairs of two components that are compared in full at first; eight times as many
#: each time these did not settle it.
AT_FIRST = 8
#: Up to so many ids are sent to the tasks that read texts, 8 bytes each.
BROADCAST_IDS = 1_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Bands:
    """Sizes from ``first[k]`` on are band k; the bands get wider by
    (100 / percent) squared, so that similar sets are in the same band or in
    neighbouring ones. ``needed[k]`` is h + 1, ``segments[k]`` is m."""

    def __init__(self, percent: int, largest: int):
        first, needed = [1], []
        while first[-1] <= largest:
            first.append(max(first[-1] + 1, first[-1] * 10_000 // percent**2))
            low = first[-1] - 1
            high = 100 * low // percent
            needed.append((low + high) * (100 - percent) // (100 + percent) + 1)
        self.percent = percent
        self.first = np.array(first, np.int64)
        self.needed = np.array(needed, np.int64)
        spare = np.where(self.needed > 1, 2 + self.needed // 12, 0)
        self.segments = self.needed + spare
        self.neighboured = np.minimum(NEIGHBOURED, np.where(self.needed > 1, self.segments, 0))
        #: By how much the lookups of a set exceed what it needs.
        self.spare = self.segments + self.neighboured - self.needed

    def bits(self, band: int) -> int:
        """The width of a band's sketches, at least twice the size of its sets."""
        return 1 << max(9, int(self.first[band + 1] - 1).bit_length() + 1)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, sizes, "right") - 1

    def also_below(self, sizes: np.ndarray) -> np.ndarray:
        """Whether the largest sets of the band below can be similar."""
        band = self.of(sizes)
        return (band > 0) & (100 * (self.first[band] - 1) >= self.percent * sizes)


@lru_cache(8)
def bands(percent: int) -> Bands:
    return Bands(percent, LARGEST)


def segment_keys(sets: list[np.ndarray], band: np.ndarray, of: Bands) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each set the keys of its segments in a band, the keys of its segments at
    the front without one of their shingles, and how many of these are of the
    first segment. A key stands for band, segment and shingles."""
    sizes = np.array([len(s) for s in sets], np.int64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    m = of.segments[band]
    since = np.cumsum(m) - m
    value = mixed(element + _GOLD)
    segment = ((value >> np.uint64(32)) * m[doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    value = mixed(value ^ _GOLD)
    content = np.zeros(int(m.sum()), np.uint64)
    np.add.at(content, since[doc] + segment, value)
    place = np.arange(len(content)) - np.repeat(since, m)
    seed = mixed((np.repeat(band, m) << 32 | place).astype(np.uint64) * _GOLD)
    exact = mixed(content + seed).astype(np.int64)
    front = np.flatnonzero(segment < of.neighboured[band][doc])
    front = front[np.lexsort((segment[front], doc[front]))]
    at = since[doc[front]] + segment[front]
    without = mixed(content[at] - value[front] + seed[at]).astype(np.int64)
    ends = np.searchsorted(doc[front], np.arange(1, len(sets) + 1))
    firsts = np.bincount(doc[front][segment[front] == 0], minlength=len(sets))
    return list(zip(np.split(exact, since[1:]), np.split(without, ends[:-1]), firsts.tolist()))


def odd_sketch(s: np.ndarray, bits: int) -> np.ndarray:
    """SKETCHES fields of ``bits`` (a power of two, 64 or more), a row each; a shingle
    turns one bit of each over. Two fields differ in no more bits than the sets in
    shingles, and seldom all of them in fewer."""
    value, out = mixed(s * _GOLD), []
    for k in range(SKETCHES):
        at = (value >> np.uint64(16 * k) if bits <= 1 << 16 else mixed(value + np.uint64(k))) & np.uint64(bits - 1)
        out.append(np.packbits(np.bincount(at.astype(np.int64), minlength=bits) & 1 == 1, bitorder="little"))
    return np.concatenate(out).view(np.uint64).reshape(SKETCHES, -1)


#: Bands of sets of any size there can be.
LARGEST = 1 << 40

SIGNED = (
    "node bigint, id bigint, n bigint, class binary, own boolean, band int, exact array<bigint>, "
    "without array<bigint>, firsts int, sketch binary"
)


def _signed(rows: DataFrame, width: int, of: Bands) -> DataFrame:
    """A row per row and band: size and digest of its set, its segment keys in that
    band and an odd sketch as wide as the band's sets are large. ``own`` is its own
    band; a row without shingles has no band and no digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text").to_pylist(), width)
                sizes = np.array([len(s) for s in sets], np.int64)
                band = of.of(np.maximum(sizes, 1))
                own = np.flatnonzero(sizes)
                below = own[of.also_below(sizes[own])]
                chosen, bands_of = np.concatenate([own, below]), np.concatenate([band[own], band[below] - 1])
                keys = segment_keys([sets[i] for i in chosen], bands_of, of)
                sketches = [odd_sketch(sets[i], of.bits(b)).tobytes() for i, b in zip(chosen.tolist(), bands_of.tolist())]
                none = np.flatnonzero(sizes == 0)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                at = np.concatenate([chosen, none])
                nothing = [None] * len(none)
                yield pa.RecordBatch.from_arrays([
                    part.column("node").take(pa.array(at)), part.column("id").take(pa.array(at)), pa.array(sizes[at]),
                    pa.array([digests[i] for i in at.tolist()], pa.binary()),
                    pa.array(np.isin(np.arange(len(at)), np.arange(len(own), len(chosen)), invert=True)),
                    pa.array([*bands_of.tolist(), *nothing], pa.int32()),
                    pa.array([*(k[0] for k in keys), *nothing], pa.list_(pa.int64())),
                    pa.array([*(k[1] for k in keys), *nothing], pa.list_(pa.int64())),
                    pa.array([*(k[2] for k in keys), *nothing], pa.int32()),
                    pa.array([*sketches, *nothing], pa.binary()),
                ], ["node", "id", "n", "class", "own", "band", "exact", "without", "firsts", "sketch"])

    return rows.mapInArrow(tidy(run), SIGNED)


def _members(keyed: DataFrame) -> DataFrame:
    """``bucket``, ``id``, ``band``, ``unit`` (segment looked up, or -1 - segment of
    its one-deletion neighbourhood) and ``hub`` (the smallest id with exactly that
    segment), of all buckets in which two can meet. A bucket's members come to one
    task in order, which keeps no more of it than its hub."""
    exact = keyed.select("id", "band", F.posexplode("exact").alias("unit", "bucket"))
    without = keyed.select("id", "band", "firsts", F.posexplode("without").alias("at", "bucket")).select(
        "id", "band", F.when(F.col("at") < F.col("firsts"), -1).otherwise(-2).alias("unit"), "bucket"
    )
    # Band and unit as one number, with segments before neighbourhoods.
    spot = F.when(F.col("unit") >= 0, F.col("unit")).otherwise(_NEIGHBOUR - 1 - F.col("unit"))
    placed = exact.unionByName(without).select(
        "bucket", "id", (F.shiftleft(spot.cast("bigint"), 16) + F.col("band")).alias("spot")
    )
    placed = placed.repartition("bucket").sortWithinPartitions("bucket", F.col("spot") >= _NEIGHBOUR << 16, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the row whose successor is not known yet
        before, hub = None, -1  # bucket of the row before it, and the bucket's hub
        for batch in _with_end(batches):
            rows = batch if last is None else pa.concat_batches([last, batch]) if batch is not None else last
            if rows is None or not rows.num_rows:
                continue
            keep = rows.num_rows if batch is None else rows.num_rows - 1
            bucket, ids, spots = (rows.column(c).to_numpy() for c in ("bucket", "id", "spot"))
            new = np.ones(rows.num_rows, bool)
            new[1:] = bucket[1:] != bucket[:-1]
            new[0] = before is None or bucket[0] != before
            last_of = np.append(new[1:], batch is None)
            start = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            hubs = np.where(start < 0, hub, np.where(spots[start] < _NEIGHBOUR << 16, ids[start], -1))
            fine = ((~new | ~last_of) & (hubs != -1))[:keep]
            at = np.flatnonzero(fine)
            unit = spots[at] >> 16
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket[at]), pa.array(ids[at]), pa.array((spots[at] & 0xFFFF).astype(np.int32)),
                pa.array(np.where(unit < _NEIGHBOUR, unit, _NEIGHBOUR - 1 - unit).astype(np.int32)), pa.array(hubs[at]),
            ], ["bucket", "id", "band", "unit", "hub"])
            if keep:
                before, hub = bucket[keep - 1], hubs[keep - 1]
            last = rows.slice(keep) if batch is not None else None

    return placed.mapInArrow(tidy(run), "bucket bigint, id bigint, band int, unit int, hub bigint")


#: Units from here on are neighbourhoods; no set has so many segments.
_NEIGHBOUR = 1 << 45


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _chosen(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (``node`` and others, all bigint) with ``node`` as ``id``, and ``text``."""
    few = wanted.count() * len(wanted.columns) <= BROADCAST_IDS
    rows = texts.join(F.broadcast(wanted) if few else wanted, "node")
    return rows.select(F.col("node").alias("id"), *[c for c in wanted.columns if c != "node"], "text")


def _sets_of(wanted: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``id``, the other columns of ``wanted`` and ``shingles``, the packed set."""
    rows = _chosen(texts, wanted)
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [s.tobytes() for s in shingle_sets(part.column("text").to_pylist(), width)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sets, pa.binary())], [*names, "shingles"])

    kinds = ", ".join(f"{c} bigint" for c in names)
    return rows.mapInArrow(tidy(run), f"{kinds}, shingles binary")


def _linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the distinct ``pairs`` (``a``, ``b``) whose full sets are similar.
    The set of an ``a`` goes to its ``b``, each once."""
    pairs = compacted(pairs)
    left = _sets_of(pairs.select(F.col("a").alias("node"), "b"), texts, width)
    right = _sets_of(pairs.select(F.col("b").alias("node")).distinct(), texts, width)
    both = left.withColumnsRenamed({"id": "a", "shingles": "of_a"}).join(
        right.withColumnsRenamed({"id": "b", "shingles": "of_b"}), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = batch.column("of_a"), batch.column("of_b")
            fine = [
                alike(np.frombuffer(one[i].as_buffer(), np.uint64), np.frombuffer(other[i].as_buffer(), np.uint64), percent)
                for i in range(batch.num_rows)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return compacted(both.select("a", "b", "of_a", "of_b").mapInArrow(tidy(run), "a bigint, b bigint"))


def _apart(members: DataFrame, labels: DataFrame, of: Bands) -> DataFrame:
    """The members of buckets that hold more than one component, with ``label``,
    ``size`` of the bucket and ``asks``: whether the set's own choice of lookups
    meets the others in this bucket.

    A set leaves out its dearest lookups, as many as it can spare. A segment is
    given up only after its one-deletion neighbourhood, so that one's cost holds
    the segment's own."""
    labelled = members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "label", F.coalesce("label", "id")
    )
    labelled = _enough_met(compacted(labelled), of)
    several = labelled.groupBy("bucket").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"),
        F.count_if(F.col("unit") >= 0).alias("exacts"),
        F.sum(F.xxhash64("id", "unit").cast("decimal(38,0)")).alias("list"),
    ).filter("low < high")
    # Buckets with the same members are one.
    several = several.groupBy("list", "size", "exacts", "low").agg(F.min("bucket").alias("bucket")).select(
        "bucket", "size", "exacts", F.col("low").alias("main")
    )
    apart = labelled.join(several, "bucket")
    segment = F.when(F.col("unit") >= 0, F.col("unit")).otherwise(-1 - F.col("unit"))
    is_exact = F.col("unit") >= 0
    apart = apart.withColumn("segment", segment)
    of_segment = Window.partitionBy("id", "band", "segment")
    of_unit = Window.partitionBy("id", "band", "unit").orderBy("bucket")
    bound = F.lit(of.spare.tolist())[F.col("band")]
    neighboured = F.col("segment") < F.lit(of.neighboured.tolist())[F.col("band")]
    apart = apart.withColumns({
        "all": F.sum("exacts").over(of_segment),
        "neighbours": F.sum((~is_exact).cast("int")).over(of_segment),
        "nth": F.row_number().over(of_unit),
    })
    # Without neighbours here, giving up a segment gives up its neighbourhood, too.
    weight = F.when(is_exact & neighboured & (F.col("neighbours") == 0), 2).otherwise(1)
    cost = F.when(is_exact, F.col("exacts")).otherwise(F.col("all"))
    dearest = Window.partitionBy("id", "band").orderBy(F.desc("cost"), is_exact, "unit", "nth")
    return apart.withColumns({"cost": cost, "weight": F.when(F.col("nth") == 1, weight).otherwise(0)}).withColumn(
        "given_up", F.sum("weight").over(dearest.rowsBetween(Window.unboundedPreceding, 0))
    ).select("bucket", "id", "band", "label", "size", "main", "unit", (F.col("given_up") > bound).alias("asks"))


def _enough_met(labelled: DataFrame, of: Bands) -> DataFrame:
    """Without the sets that cannot be similar to any set of another component. Lookups
    in which two similar sets meet weigh more than a set can spare, so all of a set's
    buckets with another component have to."""
    several = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    neighboured = F.col("unit") < F.lit(of.neighboured.tolist())[F.col("band")]
    weight = F.sum(F.when(F.col("unit") < 0, 0).when(neighboured, 2).otherwise(1))
    for k in range(NEIGHBOURED):
        weight += F.max((F.col("unit") == -1 - k).cast("int"))
    kept = labelled.join(several.select("bucket"), "bucket", "left_semi").groupBy("id", "band").agg(weight.alias("weight"))
    kept = kept.filter(F.col("weight") > F.lit(of.spare.tolist())[F.col("band")]).select("id", "band")
    return compacted(labelled.join(kept, ["id", "band"], "left_semi"))


def _survivors(apart: DataFrame, sketches: DataFrame, percent: int, most: int) -> DataFrame:
    """``a``, ``b`` and ``far`` (the sketches' distance) of the pairs of different
    components that meet in a bucket, one of them asking, and whose sketches do
    not rule out that they are similar; of one set in one bucket the ``most``
    nearest, with ``more`` if there are others. So their number is bounded by the
    rows, not by the square of a bucket's. A pair counts in the first bucket only
    of those it is known to meet in. The askers, or those outside the smallest
    component if they are fewer, are one side, all members the other; blocks of
    both meet as groups of their own."""
    apart = cut_lineage(apart)
    sides = apart.groupBy("bucket").agg(
        F.sum(F.col("asks").cast("long")).alias("asking"), F.sum((F.col("label") != F.col("main")).cast("long")).alias("rest")
    ).filter("asking > 0")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    least = lambda c: F.slice(F.sort_array(F.collect_list(F.when(c & (F.col("unit") >= 0), F.col("bucket")))), 1, MET)
    details = apart.groupBy("id", "band").agg(least(F.lit(True)).alias("in"), least(F.col("asks")).alias("met")).join(
        sketches, ["id", "band"]
    )
    apart = apart.join(sides, "bucket").withColumns({
        "left": F.when(F.col("asking") <= F.col("rest"), F.col("asks")).otherwise(F.col("label") != F.col("main")),
        "lefts": blocks(F.least("asking", "rest")), "alls": blocks(F.col("size")),
    })
    at = lambda n: F.pmod(F.xxhash64("id", "bucket"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["bucket", "id", "band", "label", "unit", "asks"]
    # Of a bucket that is one block, a row is on both sides.
    single = F.greatest("lefts", "alls") == 1
    whole = apart.filter(single).select(*kept, "left", F.lit(-1).alias("i"), F.lit(0).alias("j"))
    left = apart.filter(~single & F.col("left")).select(*kept, "left", at("lefts").alias("i"), upto("alls").alias("j"))
    every = apart.filter(~single).select(*kept, F.lit(False).alias("left"), upto("lefts").alias("i"), at("alls").alias("j"))
    jobs = whole.unionByName(left).unionByName(every).join(details, ["id", "band"])
    jobs = jobs.select("bucket", "i", "j", "left", "id", "label", "unit", "asks", "n", "sketch", "in", "met")
    jobs = jobs.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _with_end(batches):
            rows = [t for t in (held, None if batch is None else pa.Table.from_batches([batch])) if t is not None]
            if not rows:
                continue
            rows = pa.concat_tables(rows)
            if not rows.num_rows:
                continue
            group = np.stack([rows.column(c).to_numpy() for c in ("bucket", "i", "j")])
            # The last group may go on in the next batch.
            open_ = (group == group[:, -1:]).all(axis=0)
            whole = rows.num_rows if batch is None else int(open_.argmax())
            held = rows.slice(whole) if batch is not None else None
            if whole:
                found = near_pairs(rows.slice(0, whole), percent, most)
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in found[:3]), pa.array(found[3] == 1)], ["a", "b", "far", "more"])

    found = jobs.mapInArrow(tidy(run), "a bigint, b bigint, far bigint, more boolean")
    return compacted(found.groupBy("a", "b").agg(F.min("far").alias("far"), F.bool_or("more").alias("more")))


def _padded(lists: pa.ListArray) -> np.ndarray:
    """Lists of up to MET values as rows, filled up with the largest one there is."""
    sizes = lists.value_lengths().to_numpy()
    out = np.full((len(sizes), MET), np.iinfo(np.int64).max)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def _met_before(met: np.ndarray, into: np.ndarray, bucket: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the first row of a pair asks in a bucket before theirs that the second is in."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(x), 1 << 16):
        u, v = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
        for k in range(met.shape[1]):
            one = met[u, k]
            out[at : at + (1 << 16)] |= (one < bucket[u]) & (into[v] == one[:, None]).any(axis=1)
    return out


def near_pairs(rows: pa.Table, percent: int, most: int) -> np.ndarray:
    """``a`` (the larger id), ``b``, distance and 1 if there are more, of the pairs of
    a left and another row of a group that can be similar, the ``most`` nearest of
    each left row. Groups are consecutive rows with equal
    bucket, i and j, those that are not left first; the sketches of a group are of
    one width. Of a group with an i below 0 all rows are on the other side. ``in``
    are buckets a row is in with its segment as it is, ``met`` those in which it asks;
    a pair that meets in one before its own is left to that one."""
    group = np.stack([rows.column(c).to_numpy() for c in ("bucket", "i", "j")])
    ids, n, labels, unit = (rows.column(c).to_numpy() for c in ("id", "n", "label", "unit"))
    asks, left = (np.asarray(rows.column(c).to_pylist(), bool) for c in ("asks", "left"))
    exact = unit >= 0
    begins = np.append(True, (group[:, 1:] != group[:, :-1]).any(axis=0))
    since = np.maximum.accumulate(np.where(begins, np.arange(len(ids)), 0))
    others = np.bincount(np.cumsum(begins) - 1, ~left | (group[1] < 0)).astype(np.int64)[np.cumsum(begins) - 1]
    placed = "met" in rows.column_names
    into, met = (_padded(rows.column(c).combine_chunks()) if placed else np.zeros((len(ids), 0), np.int64) for c in ("in", "met"))
    sketches = [s.as_buffer() for s in rows.column("sketch").combine_chunks()]
    words = np.array([len(s) // 8 for s in sketches])
    out = [np.zeros((4, 0), np.int64)]
    for w in np.unique(words):
        rank = np.cumsum(words == w) - 1
        fields = np.stack([np.frombuffer(s, np.uint64) for s, own in zip(sketches, words == w) if own])
        lefts = np.flatnonzero(left & (words == w))
        ends = np.cumsum(others[lefts])
        for chunk in np.split(lefts, np.flatnonzero(np.diff(ends // PAIRS)) + 1):
            times = others[chunk]
            x = np.repeat(chunk, times)
            y = np.arange(len(x)) - np.repeat(np.cumsum(times) - times, times) + since[x]
            fine = (labels[x] != labels[y]) & (asks[x] | asks[y]) & (exact[x] | exact[y])
            fine &= 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            x, y = x[fine], y[fine]
            far, near, step = np.zeros(len(x), np.int64), np.zeros(len(x), bool), max(1, PAIRS // int(w))
            for at in range(0, len(x), step):
                u, v = x[at : at + step], y[at : at + step]
                bits = np.bitwise_count(fields[rank[u]] ^ fields[rank[v]]).reshape(len(u), SKETCHES, -1)
                far[at : at + step] = bits.sum(axis=2, dtype=np.int64).max(axis=1)
                near[at : at + step] = far[at : at + step] * (100 + percent) <= (n[u] + n[v]) * (100 - percent)
            x, y, far = x[near], y[near], far[near]
            here = ~(_met_before(met, into, group[0], x, y) | _met_before(met, into, group[0], y, x))
            x, y, far = x[here], y[here], far[here]
            order = np.lexsort((ids[y], far, x))
            x, y, far = x[order], y[order], far[order]
            begin = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
            sizes = np.diff(np.append(begin, len(x)))
            place = np.arange(len(x)) - np.repeat(begin, sizes)
            kept = place < most
            a, b = ids[x[kept]], ids[y[kept]]
            out.append(np.stack([np.maximum(a, b), np.minimum(a, b), far[kept], np.repeat(sizes > most, sizes)[kept]]))
    return np.unique(np.concatenate(out, axis=1), axis=1)


def _apart_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of the pairs that are in different components, with ``label_a`` and
    ``label_b``."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumns({
        "label_a": F.coalesce("label_a", "a"), "label_b": F.coalesce("label_b", "b"),
    }).filter("label_a <> label_b")


def _settled(links: DataFrame, survivors: DataFrame, labels: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``links`` and what is needed of the survivors' links: of two components the
    nearest pairs first, until one holds or all are compared."""
    most = AT_FIRST
    while not survivors.isEmpty():
        low, high = F.least("label_a", "label_b"), F.greatest("label_a", "label_b")
        open_pairs = _apart_pairs(survivors, labels).withColumns({"low": low, "high": high})
        order = Window.partitionBy("low", "high").orderBy("far", "a", "b")
        ranked = compacted(open_pairs.select("a", "b", "far", F.row_number().over(order).alias("place")))
        links = compacted(links.unionByName(_linked(ranked.filter(F.col("place") <= most).select("a", "b"), texts, width, percent)))
        labels = components(links)
        survivors = ranked.filter(F.col("place") > most).select("a", "b", "far")
        most *= 8
    return links


def _all_links(texts: DataFrame, keyed: DataFrame, of: Bands, width: int, percent: int) -> DataFrame:
    """Links (``a``, ``b``) that join the same nodes as all links do."""
    members = compacted(_members(keyed))
    # Every set is compared with the hub it meets most often. Those that meet but once
    # are seldom similar; their sketches are compared first, with all others.
    often = members.filter("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("times")).filter("times > 1")
    best = often.groupBy("id").agg(F.max(F.struct("times", (-F.col("hub")).alias("hub"))).alias("best"))
    first = best.select(F.col("id").alias("a"), (-F.col("best.hub")).alias("b"))
    links = _linked(first, texts, width, percent)
    sketches = keyed.select("id", "band", "n", "sketch")
    most, labels = NEAREST, components(links)
    while True:
        survivors = _survivors(_apart(members, labels, of), sketches, percent, most)
        links = _settled(links, survivors.drop("more"), labels, texts, width, percent)
        # A set with more candidates than were compared meets all its buckets again, but
        # for those in the component it is in by now.
        more = survivors.filter("more")
        if more.isEmpty():
            return links
        again = more.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        labels = components(links)
        buckets = members.join(again, "id", "left_semi").select("bucket").distinct()
        members = compacted(members.join(buckets, "bucket", "left_semi"))
        most *= 32


def jaccard_components(
    docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """A row per row of ``docs``: ``id``, ``n_shingles`` and ``component_id``, the
    smallest id reachable by links, its own included.

    Two texts are linked if 100 * |common shingles| >= percent * |all shingles|, for
    any percent from 50 to 100; no link between different sets is missed. Null and
    blank texts have no shingles and no links, texts of any length have one set. A
    row without an id is linked with nothing and has no component. Rows that repeat
    an id have the component of their own text each. Other columns are not read; an
    empty table gives no rows.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent goes from 50 to 100")
    # A row is known by a hash of its place, as ids may repeat.
    rows = located(docs).select(
        F.xxhash64(FILE, ROW).alias("node"), F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")
    )
    of = bands(percent)
    signed = cut_lineage(_signed(rows, width, of))
    sized = signed.filter("own").select("node", "id", "n", "class")
    known = sized.filter("class is not null and id is not null")
    classes = compacted(known.groupBy("class").agg(F.min("id").alias("rep"), F.min("node").alias("node")))
    texts = rows.select("node", "text").filter("text is not null")
    # Sets are signed once a row; one row of each class goes on.
    few = classes.count() <= BROADCAST_IDS
    nodes = classes.select("node")
    keyed = signed.filter("band is not null").join(F.broadcast(nodes) if few else nodes, "node", "left_semi")
    labels = components(_all_links(texts, keyed.withColumn("id", F.col("node")), of, width, percent))
    named = classes.join(labels, "node", "left").select("class", "rep", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component"))
    named = named.join(least, "label").select("class", "component")
    return sized.join(named, "class", "left").select(
        "id", F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
    )

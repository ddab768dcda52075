"""Near-duplicates by SuperMinHash signatures, banding and exact checks.

A text is the set of its word shingles. SuperMinHash gives each shingle a random
permutation of the signature's places and lets it offer its j-th place a value
between j and j + 1; a place keeps the least offer. The offers of one shingle are
correlated, so estimates vary less than with independent hashes, and once every
place of a text has a value below j no shingle needs its j-th offer.

Texts with equal sets are one class. Classes that agree in a band of the
signature meet in its bucket. All members of a bucket are compared with its
smallest one on their full sets; what is then still apart in a bucket is compared
block by block, also on the full sets. Links are joined to components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegrist.llm.components import UnionFind, components
from tablegrist.llm.grams import mixed
from tablegrist.llm.reuse import compacted
from tablegrist.llm.shingles import alike, shingle_sets, slices
from tablegrist.llm.tidy import tidy
from tablegrist.session import cut_lineage, short_batches

#: Bands and their rows. A pair of similarity 0.8 shares no band with a
#: probability of (1 - 0.8^6)^40 = 5e-6, one of 0.5 shares one with 0.47.
BANDS, ROWS = 40, 6
PLACES = BANDS * ROWS
#: Pairs whose signatures agree in a smaller share are not compared in blocks;
#: at similarity 0.8 that is over five standard deviations below.
LEAST_ALIKE = 0.65
#: Members of a bucket that are compared with each other in one task.
BLOCK = 512
#: Up to so many documents are found again by a broadcast of their ids.
BROADCAST_IDS = 200_000
#: Rows with texts or sets that go to Python at once.
BATCH = 256

_BASE = 0x9E3779B97F4A7C15
_GOLD = np.uint64(_BASE)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash of each set (not empty), a row of PLACES values: the level of
    the least offer in the upper and its random part in the lower 32 bits."""
    n = len(sets)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    element = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    least = np.full(n * PLACES, np.iinfo(np.uint64).max, np.uint64)
    order: np.ndarray | None = None
    for level in range(PLACES):
        random = mixed(element + np.uint64((level + 1) * _BASE % 2**64))
        value = (np.uint64(level) << np.uint64(32)) | (random >> np.uint64(32))
        swap = level + ((random & np.uint64(0xFFFFFFFF)) * np.uint64(PLACES - level) >> np.uint64(32)).astype(np.int64)
        if level == 0:
            place = swap
        else:
            rows = np.arange(len(element))
            place = order[rows, swap].astype(np.int64)
            order[rows, swap] = order[rows, level]
        np.minimum.at(least, doc * PLACES + place, value)
        worst = least.reshape(n, PLACES).max(axis=1)
        open_docs = worst >= (np.uint64(level + 1) << np.uint64(32))
        if not open_docs.any():
            break
        keep = open_docs[doc]
        if level == 0:
            doc, element, swap = doc[keep], element[keep], swap[keep]
            order = np.tile(np.arange(PLACES, dtype=np.uint8), (len(element), 1))
            order[np.arange(len(element)), swap] = 0
        elif not keep.all():
            doc, element, order = doc[keep], element[keep], order[keep]
    return least.reshape(n, PLACES)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One hash for each band of each row; equal bands of different number differ."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD, parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mixed(key * _GOLD + parts[:, :, r])
    return key.astype(np.int64)


SIGNED = "id bigint, n bigint, class binary, bands array<bigint>, brief binary"


def _signed(rows: DataFrame, width: int) -> DataFrame:
    """``id`` with the size of its set, the set's digest, band keys and a byte of
    each place of the signature; nulls for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text").to_pylist(), width)
                full = [i for i, s in enumerate(sets) if len(s)]
                sign = signatures([sets[i] for i in full])
                keys, brief = band_keys(sign), mixed(sign).astype(np.uint8)
                place = {i: k for k, i in enumerate(full)}
                yield pa.RecordBatch.from_arrays([
                    part.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([keys[place[i]] if i in place else None for i in range(len(sets))], pa.list_(pa.int64())),
                    pa.array([brief[place[i]].tobytes() if i in place else None for i in range(len(sets))], pa.binary()),
                ], ["id", "n", "class", "bands", "brief"])

    return rows.mapInArrow(tidy(run), SIGNED)


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """A row per row of ``docs``: ``id``, ``n_shingles``, ``component_id`` (the
    smallest id reachable by links, its own included) and ``kept``.

    Two texts are linked if 100 * |common shingles| >= percent * |all shingles|.
    Null and blank texts have no shingles and no links. A row without an id is
    linked with nothing, has no component and is kept. Rows that repeat an id have
    the component of their own text each; two texts with the same smallest id
    count as linked. An empty table gives no rows.
    """
    with short_batches(docs.sparkSession, BATCH):
        return _near_duplicates(docs, width, percent, key, text)


def _near_duplicates(docs: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    signed = cut_lineage(_signed(rows, width))
    classes = compacted(
        signed.filter("class is not null and id is not null").groupBy("class").agg(F.min("id").alias("rep"))
    )
    firsts = signed.join(
        classes.select(F.col("class"), F.col("rep").alias("id")), ["class", "id"], "left_semi"
    )
    members = compacted(_members(firsts))
    texts = rows.filter("text is not null and id is not null")
    first_links = compacted(_hub_links(members, texts, width, percent))
    labels = components(first_links)
    more = compacted(_block_links(members, labels, firsts, texts, width, percent))
    if not more.isEmpty():
        labels = components(first_links.unionByName(more))
    named = classes.join(labels, F.col("rep") == F.col("node"), "left").select(
        "class", F.coalesce("label", "rep").alias("label")
    )
    out = signed.select("id", "n", "class").join(named, "class", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("label", "id"))
    return out.select(
        "id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _members(firsts: DataFrame) -> DataFrame:
    """``bucket``, ``id`` and the bucket's smallest id (``hub``), of all buckets
    with at least two ids."""
    placed = firsts.select("id", F.explode("bands").alias("bucket"))
    buckets = placed.groupBy("bucket").agg(
        F.min("id").alias("hub"), F.max("id").alias("last")
    ).filter("hub < last").select("bucket", "hub")
    return placed.join(buckets, "bucket")


def _sets_of(ids: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``id`` and ``shingles`` (packed) of the documents named in ``ids``."""
    ids = compacted(ids.distinct())
    small = ids.count() <= BROADCAST_IDS
    chosen = texts.join(F.broadcast(ids) if small else ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [s.tobytes() for s in shingle_sets(part.column("text").to_pylist(), width)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"]
                )

    return cut_lineage(chosen.mapInArrow(tidy(run), "id bigint, shingles binary"))


def _hub_links(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between the members of buckets and their hubs, checked on full sets."""
    pairs = compacted(members.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct())
    sets = _sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), texts, width)
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = batch.column("of_a"), batch.column("of_b")
            fine = [
                alike(np.frombuffer(one[i].as_buffer(), np.uint64), np.frombuffer(other[i].as_buffer(), np.uint64), percent)
                for i in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return both.select("a", "b", "of_a", "of_b").mapInArrow(tidy(run), "a bigint, b bigint").distinct()


def _block_links(
    members: DataFrame, labels: DataFrame, firsts: DataFrame, texts: DataFrame, width: int, percent: int
) -> DataFrame:
    """Links between members of a bucket that are neither its hub nor in one
    component yet. The members in the component of the smallest of them are one
    side, the rest the other; both are cut into blocks, and the rest's blocks are
    compared with all others, each pair of blocks as a group of its own."""
    others = members.filter("id <> hub").join(
        labels.select(F.col("node").alias("id"), "label"), "id", "left"
    ).select("bucket", "id", F.coalesce("label", "id").alias("label"))
    others = compacted(others)
    apart = others.groupBy("bucket").agg(
        F.min("label").alias("main"), F.max("label").alias("top")
    ).filter("main < top")
    # Many buckets hold the same documents; equal lists of them are compared once.
    apart = apart.select("bucket", "main")
    placed = compacted(others.join(apart, "bucket"))
    if placed.isEmpty():
        return placed.select(F.col("id").alias("a"), F.col("id").alias("b"))
    in_main = F.col("label") == F.col("main")
    totals = placed.groupBy("bucket").agg(
        F.sum(in_main.cast("long")).alias("mains"), F.sum((~in_main).cast("long")).alias("rests"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("list"),
    )
    one_of = totals.groupBy("list", "mains", "rests").agg(F.min("bucket").alias("bucket")).select(
        "bucket",
        F.ceil(F.col("mains") / BLOCK).cast("int").alias("main_blocks"),
        F.ceil(F.col("rests") / BLOCK).cast("int").alias("rest_blocks"),
    )
    placed = placed.join(one_of, "bucket")
    at = lambda n: F.pmod(F.xxhash64("id", "bucket"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    main = placed.filter(in_main).select(
        "bucket", "id", "label", at("main_blocks").alias("i"), upto("rest_blocks").alias("j"), F.lit(0).alias("side")
    )
    rest = placed.filter(~in_main).withColumn("own", at("rest_blocks"))
    against_main = rest.select(
        "bucket", "id", "label", upto("main_blocks").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side")
    )
    # A pair of the rest's blocks has the smaller number, less one, negated as i.
    pairs = rest.select("bucket", "id", "label", "own", upto("rest_blocks").alias("with")).select(
        "bucket", "id", "label",
        (-1 - F.least("own", "with")).alias("i"), F.greatest("own", "with").alias("j"), F.lit(2).alias("side"),
    )
    jobs = main.unionByName(against_main).unionByName(pairs)
    sets = _sets_of(placed.select("id"), texts, width).join(firsts.select("id", "brief"), "id")
    jobs = jobs.join(sets, "id")

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_apart_links(block, percent), columns=["a", "b"], dtype="int64")

    return jobs.groupBy("bucket", "i", "j").applyInPandas(compare, "a bigint, b bigint").distinct()


def _apart_links(block: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links that join members with different labels, as few as are needed."""
    ids, side = block["id"].to_numpy(), block["side"].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in block["shingles"]]
    brief = np.stack([np.frombuffer(s, np.uint8) for s in block["brief"]])
    groups, links = UnionFind(), []
    for i, label in zip(ids, block["label"]):
        groups.join(int(label), int(i))
    for x in range(len(ids)):
        equal = (brief[x + 1 :] == brief[x]).mean(axis=1)
        near = x + 1 + np.flatnonzero((equal >= LEAST_ALIKE) & ~((side[x] == 0) & (side[x + 1 :] == 0)))
        for y in near:
            a, b = int(ids[x]), int(ids[y])
            if groups.find(a) != groups.find(b) and alike(sets[x], sets[y], percent):
                groups.join(a, b)
                links.append((max(a, b), min(a, b)))
    return links


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    dropped = near_duplicates(docs, key=key, text=text, **options).filter("not kept").select(
        F.col("id").alias("__dropped")
    ).distinct()
    return docs.join(dropped, F.col(key).cast("bigint") == F.col("__dropped"), "left_anti")

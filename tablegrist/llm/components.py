"""Connected components of a link table by large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegrist.llm.reuse import compacted
from tablegrist.llm.tidy import tidy


class UnionFind:
    """Groups of values; the smallest one is the name of its group."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a, b) -> bool:
        """Whether ``a`` and ``b`` were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each batch as stars around the smallest member."""
    for batch in batches:
        groups = UnionFind()
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            groups.join(a, b)
        pairs = [(x, groups.find(x)) for x in groups.parent]
        pairs = [(x, r) for x, r in pairs if x != r]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())],
            ["a", "b"],
        )


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node reachable, for each value in
    ``links`` (``a``, ``b``, bigint) that is not itself the smallest one.

    Each round every node passes its smallest neighbour on to the larger ones
    and then to the smaller ones, until nothing changes, which takes about the
    logarithm of the longest chain. Rounds are written to the shared folder.
    Links with a null or to itself do not count.
    """
    links = links.filter("a is not null and b is not null and a <> b").mapInArrow(tidy(_stars), "a bigint, b bigint")
    links = compacted(links.distinct())
    before = None
    while True:
        links = compacted(_small_star(_large_star(links)))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = now


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(
        "a <> b"
    ).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` go from the larger ``a`` to the smaller ``b``."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

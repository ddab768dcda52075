"""Exact nearest vectors of many queries, with blocks pruned by their radius.

The queries are written to the shared folder, in blocks of one group each. A task
clusters its own part of the corpus once, keeps a center and a radius for each
cluster, and reads one query block after the other. No vector of a cluster scores
better for a query than its center's distance and its radius allow, so clusters
that cannot reach a query's k-th best are passed over, nearest clusters first. The
corpus is read once and neither side is copied for the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablegrist.session import new_dir

#: Rows of a cluster on average, rounds of moving the centers, and bytes of vectors
#: (as doubles) that are clustered together.
CLUSTER_ROWS, ROUNDS, CLUSTERED_BYTES = 256, 2, 64 << 20
#: Relative to the largest possible score: what sums in another order may differ by.
SLACK = 1e-9


def matrix(lists: pa.Array) -> np.ndarray:
    """A list column without NULLs as rows of doubles."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = pc.unique(pc.list_value_length(lists))
    if len(sizes) > 1:
        raise ValueError("vectors of different lengths in one search")
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)


class Clusters:
    """Vectors in clusters with center and radius; ``ranks`` say which of equal
    scores comes first."""

    def __init__(self, vectors: np.ndarray, ranks: np.ndarray):
        n = len(vectors)
        m = max(1, n // CLUSTER_ROWS)
        centers = vectors[np.random.default_rng(n).choice(n, m, replace=False)]
        for _ in range(ROUNDS):
            own = nearest(vectors, centers)
            sums = np.zeros_like(centers)
            np.add.at(sums, own, vectors)
            sizes = np.bincount(own, minlength=m)
            centers = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centers)
        own = nearest(vectors, centers)
        order = np.argsort(own, kind="stable")
        self.vectors, self.ranks, self.centers = vectors[order], ranks[order], centers
        self.ends = np.cumsum(np.bincount(own, minlength=m))
        away = np.sqrt(((self.vectors - centers[own[order]]) ** 2).sum(axis=1))
        self.radius = np.zeros(m)
        np.maximum.at(self.radius, own[order], away)
        self.squares = (self.vectors**2).sum(axis=1)

    def search(self, queries: np.ndarray, k: int, cosine: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scores (larger is better: product, or minus the squared distance) and
        ranks of the k best per query; -inf where there are fewer."""
        best = np.full((len(queries), k), -np.inf)
        ranks = np.full((len(queries), k), np.iinfo(np.int64).max)
        if not len(queries):
            return best, ranks
        norms = np.sqrt((queries**2).sum(axis=1))
        slack = SLACK * (1 + norms.max() + np.sqrt(self.squares.max())) ** 2
        product = queries @ self.centers.T
        if cosine:
            bound = product + norms[:, None] * self.radius + slack
        else:
            away = np.sqrt(np.maximum((norms**2)[:, None] + (self.centers**2).sum(axis=1) - 2 * product, 0))
            bound = -np.maximum(away - self.radius, 0) ** 2 + slack
        # Queries that are best served by the same cluster look at clusters together.
        home = bound.argmax(axis=1)
        for h in np.unique(home):
            rows = np.flatnonzero(home == h)
            for j in np.argsort(-bound[rows].max(axis=0), kind="stable"):
                active = rows[bound[rows, j] >= best[rows, -1]]
                if len(active):
                    self._meet(j, active, queries, k, cosine, slack, best, ranks)
        return best, ranks

    def _meet(self, j, active, queries, k, cosine, slack, best, ranks) -> None:
        """Take the vectors of cluster ``j`` into the best of the active queries."""
        at, to = int(self.ends[j - 1]) if j else 0, int(self.ends[j])
        if at == to:
            return
        own = queries[active]
        about = own @ self.vectors[at:to].T
        if not cosine:
            about = 2 * about - (own**2).sum(axis=1)[:, None] - self.squares[at:to]
        floor = best[active, -1]
        if to - at > k:
            floor = np.maximum(floor, np.partition(about, to - at - k, axis=1)[:, to - at - k])
        q, x = np.nonzero(about >= floor[:, None] - slack)
        if not len(q):
            return
        # Each pair's score is summed in one fixed order, so equal vectors tie.
        a, b = own[q], self.vectors[at + x]
        score = (a * b).sum(axis=1) if cosine else -((a - b) ** 2).sum(axis=1)
        touched = np.unique(q)
        old = active[touched]
        all_q = np.concatenate([q, np.repeat(touched, k)])
        all_score = np.concatenate([score, best[old].ravel()])
        all_rank = np.concatenate([self.ranks[at + x], ranks[old].ravel()])
        order = np.lexsort((all_rank, -all_score, all_q))
        all_q = all_q[order]
        first = np.searchsorted(all_q, touched)
        keep = (first[:, None] + np.arange(k)).ravel()
        best[old] = all_score[order][keep].reshape(-1, k)
        ranks[old] = all_rank[order][keep].reshape(-1, k)


def nearest(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest center of each vector, some rows at a time."""
    squares, out = (centers**2).sum(axis=1), np.empty(len(vectors), np.int64)
    for at in range(0, len(vectors), 4096):
        part = vectors[at : at + 4096]
        out[at : at + 4096] = (squares - 2 * part @ centers.T).argmin(axis=1)
    return out


def _written(queries: DataFrame, blocks: int) -> list[tuple[str, str, str]]:
    """The queries in about so many files, and each file with its first and last
    group; the driver holds a line per file."""
    spark = queries.sparkSession
    path = new_dir(spark, "queries")
    dealt = queries.repartitionByRange(blocks, "grp", F.xxhash64("query_id")).sortWithinPartitions("grp")
    dealt.write.parquet(path)
    read = spark.read.schema(queries.schema).parquet(path)
    file = F.col("_metadata.file_path")
    ends = read.groupBy(file.alias("file")).agg(F.min("grp").alias("low"), F.max("grp").alias("high"))
    return [tuple(r) for r in ends.orderBy("file").collect()]


def _blocks(file: str, most: int) -> Iterator[pa.Table]:
    """The queries of a file, at most so many of one group at a time."""
    fs, name = pyarrow.fs.FileSystem.from_uri(file)
    with fs.open_input_file(name) as source:
        for batch in pyarrow.parquet.ParquetFile(source).iter_batches(batch_size=most):
            groups = batch.column("grp").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield pa.Table.from_batches([batch.slice(a, b - a)])


def search_blocks(queries: DataFrame, corpus: DataFrame, k: int, cosine: bool, schema: str, per_block: int, grouped: bool) -> DataFrame:
    """``query_id``, ``chunk_id`` and ``score`` of the k best of every task's part of
    the corpus (``chunk_id``, ``vec``, ``grp``) for each query (``query_id``, ``vec``,
    ``grp``) of its group. With groups the corpus is dealt by range of group and
    chunk, so that a large group fills many tasks and a task reads few groups."""
    files = _written(queries, max(1, -(-queries.count() // per_block)))
    shipped = queries.sparkSession.sparkContext.broadcast(files)
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    if grouped:
        corpus = corpus.repartitionByRange("grp", F.xxhash64("chunk_id"))

    def found(part: pa.Table) -> Iterator[pa.RecordBatch]:
        groups = np.asarray(part.column("grp").to_pylist(), object)
        clusters, ids = {}, {}
        for g in sorted(set(groups)):
            own = part.take(np.flatnonzero(groups == g))
            ids[g] = own.column("chunk_id").combine_chunks().take(pc.sort_indices(own.column("chunk_id")))
            ranks = np.empty(len(own), np.int64)
            ranks[np.asarray(pc.sort_indices(own.column("chunk_id")))] = np.arange(len(own))
            clusters[g] = Clusters(matrix(own.column("vec")), ranks)
        names = sorted(clusters)
        for file, low, high in shipped.value:
            if not any(low <= g <= high for g in names):
                continue
            for block in _blocks(file, per_block):
                g = block.column("grp")[0].as_py()
                if g not in clusters:
                    continue
                best, ranks = clusters[g].search(matrix(block.column("vec")), k, cosine)
                q, x = np.nonzero(best > -np.inf)
                score = best[q, x] if cosine else np.sqrt(-best[q, x])
                yield pa.RecordBatch.from_arrays([
                    block.column("query_id").combine_chunks().take(pa.array(q)), ids[g].take(pa.array(ranks[q, x])), pa.array(score),
                ], ["query_id", "chunk_id", "score"]).cast(arrow)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("vec").flatten()) * 8
            if size >= CLUSTERED_BYTES:
                yield from found(pa.Table.from_batches(held))
                held, size = [], 0
        if sum(b.num_rows for b in held):
            yield from found(pa.Table.from_batches(held))

    return corpus.mapInArrow(scan, schema)

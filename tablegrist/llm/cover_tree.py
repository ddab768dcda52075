"""Exact top-k inner products by dual-tree search over cover trees.

Queries and data are both indexed. A cover tree node is a data point with a
covering radius; its children lie within it and cover it at half the scale.
Points that have no children of their own are gathered in buckets around their
parent. For a group of queries around c with radius r and a node around d with
radius s, no inner product is over <c,d> + s|c| + r|d| + rs, so the pair is left
out when that is below the worst k-th score of the group.

Components are whole numbers. Where a sum of products may not be exact in a
double, trees only prune, with room for rounding, and what is left is scored in
exact whole numbers.

On Spark the queries go in blocks: each block is indexed on the driver and sent
to all tasks, which cut their rows into blocks, index these and search them. The
best of all tasks are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablegrist.session import cut_lineage

#: Queries searched for in one pass over the data, by their bytes as 64-bit
#: numbers, and rows indexed together by a task.
QUERY_BYTES = 8 << 20
DATA_ROWS = 4096
BUCKET = 64
SCALE = 0.5


class CoverTree:
    """A cover tree over the rows of ``points`` in arrays. ``center`` is a row,
    ``radius`` the largest distance to a point below, ``children`` are node
    numbers; a node without children has its points in ``members``."""

    def __init__(self, points: np.ndarray):
        #: Whole numbers too large for a double come as Python integers.
        self.whole = points
        self.points = _doubles(points)
        self.largest = float(np.abs(self.points).max(initial=0))
        self.length = points.shape[1] if points.ndim == 2 else 0
        self.exact = self.length * self.largest**2 < 2**53 if self.largest < 2**500 else False
        self.square = np.einsum("ij,ij->i", self.points, self.points)
        self.norm = np.sqrt(self.square)
        self.center: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray] = []
        self.members: list[np.ndarray] = []
        self.root = -1
        if len(points):
            every = np.arange(len(points))
            self.root = self._grow(0, every, self._distance(0, every))
        self.centers = np.array(self.center, dtype=np.int64)
        self.radii = np.array(self.radius)

    def _distance(self, p: int, others: np.ndarray) -> np.ndarray:
        if not self.exact:
            # Differences of squares would cancel; never less than the distance.
            with np.errstate(all="ignore"):
                d = self.points[others] - self.points[p]
                return np.sqrt(np.einsum("ij,ij->i", d, d)) * (1 + _rounding(self.length))
        d = self.square[others] + self.square[p] - 2 * (self.points[others] @ self.points[p])
        return np.sqrt(np.maximum(d, 0))

    def _node(self, p: int, radius: float, children: list[int], members: np.ndarray) -> int:
        self.center.append(p)
        self.radius.append(radius)
        self.children.append(np.array(children, dtype=np.int64))
        self.members.append(members)
        return len(self.center) - 1

    def _grow(self, p: int, inside: np.ndarray, far: np.ndarray) -> int:
        """The node around ``p`` over the points ``inside`` at distances ``far``.
        Levels without a split are passed over, so depth is bounded by the
        spread of distances, not by the number of points."""
        radius = float(far.max())
        if not np.isfinite(radius):
            return self._node(p, np.inf, [], inside)
        if len(inside) <= BUCKET or radius == 0:
            return self._node(p, radius, [], inside)
        reach = radius * SCALE
        nodes, single = [], []
        near = far <= reach
        own, own_far = inside[near], far[near]
        rest = inside[~near]
        if len(own) > 1:
            nodes.append(self._grow(p, own, own_far))
        else:
            single.append(own)
        while len(rest):
            q = int(rest[0])
            d = self._distance(q, rest)
            d[0] = 0.0
            near = d <= reach
            if near.sum() > 1:
                nodes.append(self._grow(q, rest[near], d[near]))
            else:
                single.append(rest[:1])
            rest = rest[~near]
        loose = np.concatenate(single) if single else np.empty(0, np.int64)
        # Neighbours among the loose points share a bucket as far as a cheap
        # order along the direction of largest spread can tell.
        if len(loose) > BUCKET:
            spread = self.points[loose]
            axis = spread.var(axis=0).argmax()
            loose = loose[np.argsort(spread[:, axis], kind="stable")]
        for at in range(0, len(loose), BUCKET):
            part = loose[at : at + BUCKET]
            nodes.append(self._node(p, float(self._distance(p, part).max()), [], part))
        return self._node(p, radius, nodes, np.empty(0, np.int64))


class Search:
    """The k best of each query over all data trees seen so far: highest score
    first, then smallest id. An id counts once, with its best score."""

    def __init__(self, queries: CoverTree, query_ids: np.ndarray, k: int):
        self.queries, self.query_ids, self.k = queries, query_ids, k
        self.score = np.full((len(query_ids), k), -np.inf)
        self.id = np.full((len(query_ids), k), np.iinfo(np.int64).max)
        #: The rows below each node; a node's number is above its children's.
        self.below: list[np.ndarray] = []
        #: From the first block that is not exact in doubles on, the k best of each
        #: query in Python integers; ``score`` is then no more than they are.
        self.best: list[list[tuple[int, int]]] | None = None
        for children, members in zip(queries.children, queries.members):
            rows = [self.below[c] for c in children]
            self.below.append(np.concatenate(rows) if rows else members)

    def add(self, data: CoverTree, data_ids: np.ndarray) -> None:
        if data.root >= 0 and self.queries.root >= 0:
            q = self.queries
            if self.best is None and not data.length * q.largest * data.largest < 2**53:
                self.best = [
                    [(int(s), int(i)) for s, i in zip(*both) if s > -np.inf] for both in zip(self.score, self.id)
                ]
            with np.errstate(all="ignore"):
                self._visit(q.root, np.array([data.root]), data, data_ids)

    def _visit(self, group: int, nodes: np.ndarray, data: CoverTree, ids: np.ndarray) -> None:
        """A query group against a frontier of data nodes: drop what cannot reach
        the group's worst k-th score, split the data as long as its nodes are
        wider than the group, then split the group."""
        q = self.queries
        c, r = q.points[q.center[group]], q.radius[group]
        c_norm = q.norm[q.center[group]]
        while True:
            worst = self.score[self.below[group], self.k - 1].min()
            centers, radii = data.centers[nodes], data.radii[nodes]
            bound = data.points[centers] @ c + radii * c_norm + r * data.norm[centers] + r * radii
            # Equal scores count, as a smaller id wins; the margin is for rounding.
            # What is too large for a bound stays.
            keep = ~(bound < worst - self._room(bound, c_norm + r, data.norm[centers] + radii))
            nodes, bound = nodes[keep], bound[keep]
            if not len(nodes):
                return
            nodes = nodes[np.argsort(-bound, kind="stable")]
            inner = np.array([len(data.children[n]) > 0 for n in nodes])
            wide = inner & (data.radii[nodes] >= r) if len(q.children[group]) else inner
            if not wide.any():
                break
            nodes = np.concatenate([nodes[~wide], *[data.children[n] for n in nodes[wide]]])
        if len(q.children[group]):
            for child in q.children[group]:
                self._visit(int(child), nodes, data, ids)
            return
        # Buckets in order of their bounds, the best ones first.
        for at in range(0, len(nodes), 8):
            some = nodes[at : at + 8]
            if at:
                worst = self.score[self.below[group], self.k - 1].min()
                centers, radii = data.centers[some], data.radii[some]
                bound = data.points[centers] @ c + radii * c_norm + r * data.norm[centers] + r * radii
                some = some[~(bound < worst - self._room(bound, c_norm + r, data.norm[centers] + radii))]
            if len(some):
                self._score(self.below[group], np.concatenate([data.members[n] for n in some]), data, ids)

    def _room(self, bound: np.ndarray, one: float, other: np.ndarray) -> np.ndarray:
        return 1e-6 * (1 + abs(bound)) + _rounding(self.queries.length) * one * other

    def _score(self, rows: np.ndarray, members: np.ndarray, data: CoverTree, ids: np.ndarray) -> None:
        scores = self.queries.points[rows] @ data.points[members].T
        candidates = ids[members]
        if self.best is not None:
            self._score_whole(rows, members, scores, candidates, data)
            return
        scores[candidates[None, :] == self.query_ids[rows][:, None]] = -np.inf
        better = scores >= self.score[rows, self.k - 1][:, None]
        better &= scores > -np.inf
        for i in np.nonzero(better.any(axis=1))[0]:
            found = np.nonzero(better[i])[0]
            if len(found) > 4 * self.k:
                # Only the best ones and their equals can stay; ids may repeat
                # in a block, which the caller has ruled out.
                least = np.partition(scores[i, found], -self.k)[-self.k]
                found = found[scores[i, found] >= least]
            self._merge(int(rows[i]), scores[i, found], candidates[found])

    def _score_whole(self, rows, members, scores, candidates, data: CoverTree) -> None:
        """Exact scores of what can reach a query's worst k-th one by ``scores``."""
        small = data.length * self.queries.largest * data.largest < 2**62
        distinct = len(np.unique(candidates)) == len(candidates)
        for i, row in enumerate(rows.tolist()):
            room = _rounding(data.length) * self.queries.norm[row] * data.norm[members]
            least = self.score[row, self.k - 1]
            other = candidates != self.query_ids[row]
            sure = (scores[i] - room)[other]
            if distinct and len(sure) > self.k and np.isfinite(sure).all():
                least = max(least, np.partition(sure, -self.k)[-self.k])
            found = np.nonzero(other & ~(scores[i] + room < least))[0]
            if not len(found):
                continue
            a, b = self.queries.whole[row], data.whole[members[found]]
            if small:
                exact = (b.astype(np.int64) @ a.astype(np.int64)).tolist()
            else:
                a = [int(x) for x in a]
                exact = [sum(int(x) * y for x, y in zip(v, a)) for v in b]
            most = dict((d, s) for s, d in self.best[row])
            for s, d in zip(exact, candidates[found].tolist()):
                most[d] = max(s, most.get(d, s))
            best = sorted(((s, d) for d, s in most.items()), key=lambda x: (-x[0], x[1]))[: self.k]
            self.best[row] = best
            if len(best) == self.k:
                self.score[row, self.k - 1] = _not_over(best[-1][0])

    def _merge(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, d = np.concatenate([self.score[row], scores]), np.concatenate([self.id[row], ids])
        order = np.lexsort((d, -s))
        s, d = s[order], d[order]
        first = np.sort(np.unique(d, return_index=True)[1])
        first = first[s[first] > -np.inf][: self.k]
        self.score[row], self.id[row] = -np.inf, np.iinfo(np.int64).max
        self.score[row, : len(first)], self.id[row, : len(first)] = s[first], d[first]

    def results(self) -> tuple[list, list, list, list]:
        """Query, id, score and what orders scores that are no bigint."""
        if self.best is None:
            row, place = np.nonzero(self.score > -np.inf)
            found = self.query_ids[row], self.id[row, place], self.score[row, place].astype(np.int64)
            return (*(x.tolist() for x in found), [FITS] * len(row))
        all_ = [(int(q), d, s) for q, best in zip(self.query_ids, self.best) for s, d in best]
        return (
            [x[0] for x in all_], [x[1] for x in all_],
            [min(max(s, -(2**63)), 2**63 - 1) for *_, s in all_], [_over(s) for *_, s in all_],
        )


FOUND = "query_id bigint, vec_id bigint, score bigint, over binary"
FITS = b"\x01"


def _over(score: int) -> bytes:
    """Orders scores beyond the same end of bigint as bytes; FITS for all others."""
    if -(2**63) <= score < 2**63:
        return FITS
    size = (abs(score).bit_length() + 7) // 8
    key = size.to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return b"\x02" + key if score > 0 else b"\x00" + bytes(255 - x for x in key)


def _rounding(length: int) -> float:
    """More than the relative error of a sum of so many products of doubles."""
    return (length + 16) * 2.0**-50


def _not_over(number: int) -> float:
    """A double that is not over ``number``."""
    try:
        return float(np.nextafter(float(number), -np.inf))
    except OverflowError:
        return float(np.finfo(np.float64).max) if number > 0 else -np.inf


def _doubles(points: np.ndarray) -> np.ndarray:
    if points.dtype != object:
        return points.astype(np.float64)
    return np.array([[float(x) if abs(x) < 2**1023 else np.copysign(np.inf, x >= 0 or -1) for x in v] for v in points])


def quantised(vector: Column) -> Column:
    """floor(256 x) / 256 of each component, which a double holds exactly; null
    where the vector is null, empty or holds a null, NaN or infinite component."""
    number = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(number, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = vector.isNotNull() & (F.size(vector) > 0) & ~bad
    # From 2^44 on 256 x is whole anyway.
    whole = lambda x: F.when(F.abs(x) < 2.0**44, F.floor(x * 256).cast("double") / 256).otherwise(x)
    return F.when(fine, F.transform(number, whole))


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The ``k`` best partners of each row whose key is divisible by ``every``:
    ``query_id``, ``rank``, ``vec_id``, ``score``.

    Rows without a key or with an unfit vector take no part; vectors are only
    compared with those of their own length. Rows that repeat a key are one
    candidate with its best score, and none of them is a partner of that key; as
    a query, such a key has the smallest of its vectors. Ties go to the smaller
    id. No query or no candidate gives no rows. A score beyond bigint counts in
    full for the rank and is shown as null.
    """
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), quantised(F.col(vector)).alias("v")).filter(
        "id is not null and v is not null"
    )
    queries = cut_lineage(
        rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    )
    found = None
    for length, n in sorted(queries.groupBy(F.size("v").alias("n")).count().collect()):
        blocks = -(-n * length * 8 // QUERY_BYTES)
        for b in range(blocks):
            block = queries.filter((F.size("v") == length) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b))
            part = _found(rows.filter(F.size("v") == length), block, k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        none = F.lit(None).cast("bigint")
        return rows.limit(0).select(
            none.alias("query_id"), none.cast("int").alias("rank"), none.alias("vec_id"), none.alias("score")
        )
    best = found.groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "over")).alias("s")).select(
        "query_id", "vec_id", "s.score", "s.over"
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("over"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    score = F.when(F.col("over") == F.lit(FITS), F.col("score"))
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))


def _found(rows: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """The k best of each query of ``block`` in each task's rows."""
    table = block.toArrow().combine_chunks()
    shipped = rows.sparkSession.sparkContext.broadcast(
        (table.column("id").to_numpy(), _whole(_matrix(table.column("v").combine_chunks())))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, points = shipped.value
        search = Search(CoverTree(points), query_ids, k)
        for ids, data in _blocks(batches):
            search.add(CoverTree(_whole(data)), ids)
        query, vec, score, over = search.results()
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(x, pa.int64()) for x in (query, vec, score)), pa.array(over, pa.binary())],
            ["query_id", "vec_id", "score", "over"],
        )

    return rows.mapInArrow(run, FOUND)


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _whole(v: np.ndarray) -> np.ndarray:
    """256 times ``v`` as whole numbers of the smallest fitting kind."""
    most = np.abs(v).max(initial=0)
    if most < 2**22:
        return (v * 256).astype(np.int32)
    if most < 2.0**54:
        return (v * 256).astype(np.int64)
    return np.array([[int(x) * 256 if abs(x) >= 2**44 else int(x * 256) for x in row] for row in v.tolist()], dtype=object)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows in blocks of DATA_ROWS, of equal rows only one."""
    ids, data, n = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, DATA_ROWS):
            part = batch.slice(at, DATA_ROWS)
            ids.append(part.column("id").to_numpy())
            data.append(_matrix(part.column("v")))
            n += part.num_rows
            if n >= DATA_ROWS:
                yield _distinct(ids, data)
                ids, data, n = [], [], 0
    if n:
        yield _distinct(ids, data)


def _distinct(ids: list[np.ndarray], data: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    i, d = np.concatenate(ids), np.concatenate(data)
    if len(np.unique(i)) < len(i):
        both = np.unique(np.column_stack([i, np.ascontiguousarray(d).view(np.int64)]), axis=0)
        i, d = both[:, 0], np.ascontiguousarray(both[:, 1:]).view(np.float64)
    return i, d

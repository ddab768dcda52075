"""Exact vector search, scaling and vector tables.

Search keeps a running top-k per query inside each task (NumPy on Arrow
batches) and merges the k best per task by rank, so neither the corpus nor the
full score matrix is ever shuffled. Queries are shipped to the tasks only while
their number is within a checked bound; beyond it the tasks read them block by
block (``vector_blocks``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablegrist.functions.vectors import l2_norm, l2_normalise
from tablegrist.operators.kinds import NUMBER, columns_of
from tablegrist.operators.vector_blocks import search_blocks
from tablegrist.session import small_table

MAX_SHIPPED_QUERIES = 2048
MIN_STD = 1e-9
COSINE, EUCLIDEAN = "cosine", "euclidean"


# --- search -----------------------------------------------------------------


def _scores(queries: np.ndarray, corpus: np.ndarray, metric: str) -> np.ndarray:
    """Larger is better for both metrics (distance is negated)."""
    if metric == COSINE:
        return queries @ corpus.T
    out = np.empty((len(queries), len(corpus)))
    for i, q in enumerate(queries):
        out[i] = -np.sqrt(((corpus - q) ** 2).sum(axis=1))
    return out


class _Best:
    """Running top-k of one query; ties go to the smaller id."""

    __slots__ = ("k", "score", "ids")

    def __init__(self, k: int):
        self.k = k
        self.score = np.empty(0)
        self.ids = np.empty(0, dtype=object)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score) > self.k:
            floor = np.partition(score, len(score) - self.k)[len(score) - self.k]
            keep = score >= floor
            score, ids = score[keep], ids[keep]
        if len(self.score) == self.k:
            keep = score >= self.score[-1]
            if not keep.any():
                return
            score, ids = score[keep], ids[keep]
        score = np.concatenate([self.score, score])
        ids = np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[order], ids[order]


def _scan(
    batches: Iterator[tuple[np.ndarray, np.ndarray, list]],
    queries: dict[str | None, tuple[list, np.ndarray]],
    k: int,
    metric: str,
) -> dict:
    """Top-k of every query over ``(group, ids, vectors)`` batches; a query only
    meets vectors of its own group."""
    best: dict = {}
    for groups, ids, vecs in batches:
        for g in pd.unique(groups):
            if g not in queries:
                continue
            names, matrix = queries[g]
            at = np.flatnonzero(groups == g)
            block = np.array([vecs[i] for i in at], dtype=np.float64)
            score = _scores(matrix, block, metric)
            chosen = ids[at]
            for row, name in enumerate(names):
                best.setdefault(name, _Best(k)).add(score[row], chosen)
    return best


def _by_group(pdf: pd.DataFrame) -> dict:
    out = {}
    for g, part in pdf.groupby("grp", sort=False):
        out[g] = (
            part["query_id"].tolist(),
            np.array([np.asarray(v, dtype=np.float64) for v in part["vec"]]),
        )
    return out


def _table(best: dict, metric: str) -> pd.DataFrame:
    sign = 1.0 if metric == COSINE else -1.0
    rows = [(q, i, float(sign * s)) for q, b in best.items() for i, s in zip(b.ids, b.score)]
    return pd.DataFrame(rows, columns=["query_id", "chunk_id", "score"])


def top_k(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    metric: str = COSINE,
    group: str | None = None,
    max_shipped: int = MAX_SHIPPED_QUERIES,
) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: for each query vector its k nearest
    corpus vectors, exactly. ``queries(query_id, vec)``, ``corpus(chunk_id,
    vec)``; with ``group`` both also carry that column and only equal groups
    meet. Cosine expects unit vectors; Euclidean scores are distances. Fewer than
    k vectors give fewer rows, k <= 0 or an empty side gives none."""
    q_type, c_type = queries.schema["query_id"].dataType, corpus.schema["chunk_id"].dataType
    schema = (
        f"query_id {q_type.simpleString()}, chunk_id {c_type.simpleString()}, score double"
    )
    if k <= 0:
        return small_table(queries.sparkSession, [], schema + ", rank int")
    grp = F.col(group).cast("string") if group else F.lit("")
    q = queries.select("query_id", "vec", grp.alias("grp")).filter(F.col("vec").isNotNull())
    c = corpus.select("chunk_id", "vec", grp.alias("grp")).filter(F.col("vec").isNotNull())
    shipped = q.limit(max_shipped + 1).toPandas()
    if len(shipped) <= max_shipped:
        partial = _search_shipped(shipped, c, k, metric, schema)
    else:
        partial = search_blocks(q, c, k, metric == COSINE, schema, max_shipped, group is not None)
    better = F.desc("score") if metric == COSINE else F.asc("score")
    order = Window.partitionBy("query_id").orderBy(better, "chunk_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_shipped(
    shipped: pd.DataFrame, corpus: DataFrame, k: int, metric: str, schema: str
) -> DataFrame:
    """Every task scans its part of the corpus against all query vectors."""
    queries = corpus.sparkSession.sparkContext.broadcast(_by_group(shipped))
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpack():
            for b in batches:
                lists = b.column(1)
                flat = np.asarray(lists.flatten(), dtype=np.float64)
                cut = np.asarray(lists.offsets)[1:-1] - lists.offsets[0].as_py()
                yield (
                    b.column(2).to_numpy(zero_copy_only=False),
                    b.column(0).to_numpy(zero_copy_only=False),
                    np.split(flat, cut),
                )

        out = _table(_scan(unpack(), queries.value, k, metric), metric)
        if len(out):
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    return corpus.mapInArrow(scan, schema)


# --- scaling ----------------------------------------------------------------


@dataclass
class Scaler:
    """Mean and population deviation of the numeric columns of one table."""

    file_id: str
    columns: list[str]
    mean: dict[str, float]
    std: dict[str, float]

    def table(self, df: DataFrame) -> DataFrame:
        """``(file_id, column, position, mean, std)``, the form that is stored."""
        return small_table(df.sparkSession, [(self.file_id, c, i, self.mean[c], self.std[c]) for i, c in enumerate(self.columns)],
            "file_id string, column string, position int, mean double, std double",
        )

    @staticmethod
    def load(scalers: DataFrame, file_id: str) -> Scaler:
        """One row per column of one table, so it may be held here."""
        rows = scalers.filter(F.col("file_id") == file_id).orderBy("position").collect()
        return Scaler(
            file_id,
            [r["column"] for r in rows],
            {r["column"]: r["mean"] for r in rows},
            {r["column"]: r["std"] for r in rows},
        )


def fit_scaler(df: DataFrame, file_id: str, columns: Sequence[str] | None = None) -> Scaler:
    """One aggregate over all columns. A constant column gets deviation 1, an
    empty one mean 0 and deviation 1."""
    columns = list(columns) if columns is not None else columns_of(df, NUMBER)
    if not columns:
        return Scaler(file_id, [], {}, {})
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`").cast("double") if c in df.columns else F.lit(None).cast("double")
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
    got = df.agg(*aggs).first()
    mean = {c: got[f"m{i}"] if got[f"m{i}"] is not None else 0.0 for i, c in enumerate(columns)}
    std = {c: got[f"s{i}"] if (got[f"s{i}"] or 0.0) > MIN_STD else 1.0 for i, c in enumerate(columns)}
    return Scaler(file_id, columns, mean, std)


def scaled_vector(df: DataFrame, scaler: Scaler) -> Column:
    """z-scores in scaler order as ``array<float>``; missing or unparsable is 0."""
    cells = []
    for c in scaler.columns:
        v = F.col(f"`{c}`").try_cast("double") if c in df.columns else F.lit(None).cast("double")
        z = (v - F.lit(scaler.mean[c])) / F.lit(scaler.std[c])
        cells.append(F.coalesce(F.when(~F.isnan(z), z), F.lit(0.0)).cast("float"))
    return F.array(*cells)


# --- vector tables ----------------------------------------------------------


def unit_vectors(df: DataFrame, vec: str) -> DataFrame:
    """Vectors scaled to length one, the norm taken once per row."""
    return (
        df.withColumn("_norm", l2_norm(vec))
        .withColumn(vec, F.transform(l2_normalise(vec, "_norm"), lambda x: x.cast("float")))
        .drop("_norm")
    )


def mean_vectors(df: DataFrame, by: str, vec: str) -> DataFrame:
    """Component-wise mean per group, combined before the shuffle."""
    each = df.select(by, F.posexplode(vec).alias("pos", "x"))
    means = each.groupBy(by, "pos").agg(F.avg("x").alias("x"))
    return means.groupBy(by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias(vec)
    )


def append_vectors(known: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """Known plus new vectors; a vector of another length fails the job."""
    checked = new.withColumn(
        "vec",
        F.when(F.size("vec") == dim, F.col("vec")).otherwise(
            F.raise_error(F.concat(F.lit(f"expected {dim} components, got "), F.size("vec").cast("string")))
        ),
    )
    return known.unionByName(checked.select(*known.columns))


def keep_vectors(vectors: DataFrame, deleted: DataFrame) -> DataFrame:
    """Vectors of all chunks but the deleted ones."""
    return vectors.join(deleted.select("chunk_id"), "chunk_id", "left_anti")

"""The stored chunk tables: plain Parquet folders that only grow.

Every write adds rows under a new ingest number; the ``files`` table says which
ingest of a file is in force. Replacing or deleting a file is one row in ``files``
and touches nothing else, so the cost of a write is that of its own rows. Readers
see an ingest only after its ``files`` rows, which are written last. Rows out of
force stay until ``compact`` writes the rows in force to another folder.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegrist.plans.ingest import TABLES, Family
from tablegrist.session import cut_lineage, small_table

# ``vec_size``: the length of the text vectors written with the file.
FILES_SCHEMA = "file string, seq bigint, ingest string, vec_size int"
# How each table is laid out: directories to prune by, columns to sort by so
# that Parquet min/max statistics narrow point look-ups.
PARTITIONS = {"chunks": ["chunk_type"], "postings": ["kind"]}
SORTED = {
    "chunks": ["canonical_id", "chunk_id"],
    "postings": ["key", "value"],
    "text_vectors": ["file_id", "chunk_id"],
    "numeric_vectors": ["file_id", "chunk_id"],
}
# Tables dealt by key range before they are written, so that a look-up opens few
# files; the chunk at the end of the key lets one hot posting fill many of them.
RANGED = {"postings": ["kind", "key", "value", "chunk_id"]}
FILE, INGEST = "_file", "_ingest"
OfChunks = Callable[[DataFrame], dict[str, DataFrame]]


class ChunkStore:
    """A folder of tables. ``aliases`` belong to no file and are only added to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- reading --

    def _stored(self, table: str, schema: str) -> DataFrame:
        empty = small_table(self.spark, [], schema)
        try:
            return self.spark.read.schema(empty.schema).parquet(f"{self.root}/{table}").select(*empty.columns)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty

    def _in_force(self) -> DataFrame:
        """``_file``, ``_ingest`` and ``vec_size`` of every file that is not deleted."""
        last = self._stored("files", FILES_SCHEMA).groupBy(F.col("file").alias(FILE)).agg(
            F.max(F.struct("seq", "ingest", "vec_size")).alias("last")
        )
        return last.select(FILE, F.col("last.ingest").alias(INGEST), "last.vec_size").filter(F.col(INGEST).isNotNull())

    def read(self, table: str) -> DataFrame:
        """The rows of a table that are in force."""
        columns = small_table(self.spark, [], TABLES[table]).columns
        if table == "aliases":
            return self._stored(table, TABLES[table]).distinct()
        rows = self._stored(table, f"{TABLES[table]}, {FILE} string, {INGEST} string")
        return rows.join(self._in_force(), [FILE, INGEST], "left_semi").select(*columns)

    # -- writing --

    def _append(self, table: str, df: DataFrame) -> None:
        if table in RANGED:
            # The ranges are found in a pass of its own over the rows.
            df = cut_lineage(df).repartitionByRange(*RANGED[table])
        if table in SORTED:
            df = df.sortWithinPartitions(*PARTITIONS.get(table, []), *SORTED[table])
        writer = df.write.mode("append")
        if table in PARTITIONS:
            writer = writer.partitionBy(*PARTITIONS[table])
        writer.parquet(f"{self.root}/{table}")

    def _write(self, tables: dict[str, DataFrame], of_chunks: OfChunks | None = None) -> DataFrame:
        """Append all tables under one new ingest; the ``files`` rows that put it
        in force, still to be written. ``of_chunks`` makes some of the tables from
        the stored chunks."""
        ingest, seq = uuid.uuid4().hex, time.time_ns()
        written = []
        chunks = size = None
        for table in sorted(tables, key=lambda t: t != "chunks"):
            df = tables[table].select(*small_table(self.spark, [], TABLES[table]).columns)
            if table == "aliases":
                self._append(table, df)
                continue
            df = _with_file(table, df, chunks).withColumn(INGEST, F.lit(ingest))
            self._append(table, df)
            stored = self._stored(table, f"{TABLES[table]}, {FILE} string, {INGEST} string")
            stored = stored.filter(F.col(INGEST) == ingest)
            if table == "chunks":
                chunks = stored
                tables = tables | (of_chunks(chunks.drop(FILE, INGEST)) if of_chunks else {})
            if table == "text_vectors":
                size = self._checked_size(stored)
            if chunks is None or table in ("chunks", "file_stats"):
                written.append(stored.select(FILE))
        files = small_table(self.spark, [], f"{FILE} string")
        for w in written:
            files = files.unionByName(w)
        return files.distinct().select(
            F.col(FILE).alias("file"), F.lit(seq).alias("seq"), F.lit(ingest).alias("ingest"),
            F.lit(size).cast("int").alias("vec_size"),
        )

    def _checked_size(self, new: DataFrame) -> int | None:
        """The length of the vectors just written. All text vectors of a store have one
        length, or none can be searched; those in force are known by their files, so
        no other vectors are read."""
        ends = lambda df, n: df.agg(F.min(n).alias("low"), F.max(n).alias("high")).first()
        found = {n for r in (ends(new, F.size("vec")), ends(self._in_force(), F.col("vec_size"))) for n in r}
        found.discard(None)
        if len(found) > 1:
            raise ValueError("text vectors of different lengths")
        return found.pop() if found else None

    def put(self, **tables: DataFrame) -> None:
        """Add rows to the given tables. They replace all rows of the files they
        belong to, in every table."""
        self._append("files", self._write(tables))

    def add(self, family: Family) -> None:
        self._append("files", self._write(family.tables(), family.of_chunks))

    def delete_file(self, file: str) -> int:
        """Take a file out of every table; returns the number of its chunks."""
        removed = self.read("chunks").filter(F.col("file") == file).count()
        gone = small_table(self.spark, [(file, time.time_ns(), None, None)], FILES_SCHEMA)
        self._append("files", gone)
        return removed

    def rebuild(self, sources: dict[str, Callable[[], Family]]) -> DataFrame:
        """Replace everything by the given sources and report chunks per file
        and type. A source that fails is reported with its error and leaves the
        others alone; what was in force stays so until all are written."""
        failed, fresh = [], small_table(self.spark, [], FILES_SCHEMA)
        for name, build in sources.items():
            try:
                family = build()
                fresh = fresh.unionByName(self._write(family.tables(), family.of_chunks))
            except Exception as e:
                failed.append((name, None, None, f"{type(e).__name__}: {e}"))
        old = self._in_force().select(F.col(FILE).alias("file")).join(fresh.select("file"), "file", "left_anti")
        gone = old.select("file", F.lit(time.time_ns()).alias("seq"), F.lit(None).cast("string").alias("ingest"), F.lit(None).cast("int").alias("vec_size"))
        self._append("files", fresh.unionByName(gone))
        counts = self.read("chunks").groupBy("file", "chunk_type").agg(F.count(F.lit(1)).alias("chunks"))
        errors = small_table(self.spark, failed, "file string, chunk_type string, chunks bigint, error string")
        return counts.withColumn("error", F.lit(None).cast("string")).unionByName(errors)

    def compact(self, root: str) -> ChunkStore:
        """A store under another folder with the rows in force only."""
        other = ChunkStore(self.spark, root)
        other.put(**{t: self.read(t) for t in TABLES})
        return other


def _with_file(table: str, df: DataFrame, chunks: DataFrame | None) -> DataFrame:
    """``df`` with the file each row belongs to: its own name, that of its chunk,
    or that of its file id, which stands for itself where no chunk has it."""
    own: dict[str, Column] = {"chunks": F.col("file"), "file_stats": F.col("filename")}
    if table in own:
        return df.withColumn(FILE, own[table])
    if chunks is None:
        if "file_id" not in df.columns:
            raise ValueError(f"{table} are stored together with the chunks they belong to")
        return df.withColumn(FILE, F.col("file_id"))
    key = "chunk_id" if "chunk_id" in df.columns else "file_id"
    known = chunks.select(key, F.col("file").alias(FILE)).distinct()
    joined = df.join(known, key, "left")
    return joined.withColumn(FILE, F.coalesce(FILE, "file_id")) if key == "file_id" else joined


def save_aliases(aliases: DataFrame, path: str) -> None:
    """Alias pairs as JSON lines people can edit."""
    aliases.select("canonical_id", "alias").write.mode("overwrite").json(path)


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("canonical_id string, alias string").json(path)

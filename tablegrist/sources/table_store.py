"""Stored tables that grow file by file, with types frozen per header.

Rows are stored as the text of their cells, in a directory for each header
signature. The types of a signature are kept beside them: the votes of all
batches so far and the kind of each column. Votes are counts, so a batch adds its
own and reads nothing again. A kind is frozen by the first batch that has cells of
the column and only ever gets wider: whole numbers to numbers, anything to text.
As cells are text until they are read, a column that got wider shows its early
cells as they stood in their files.

Everything is appended; a file belongs to the ingest that its last row in
``files`` names, and a batch's types rest on those of earlier batches. So a batch
that is run again changes nothing.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablegrist.operators import clean
from tablegrist.session import cut_lineage, small_table
from tablegrist.sources.folder import ORDINAL, SOURCE, file_votes, placed_records, typed

SCHEMAS = {
    "rows": "file string, ordinal bigint, cells array<string>, ingest string, signature string",
    "files": "file string, signature string, rows bigint, filled bigint, batch bigint, ingest string, seq bigint",
    "types": "signature string, position int, column string, kind string, n bigint, number bigint, whole bigint, "
    "date bigint, batch bigint, seq bigint",
}
VOTES = ("n", "number", "whole", "date")


def wider(frozen: Column, voted: Column) -> Column:
    """The kind of a column that had one kind and whose votes now say another."""
    numbers = (clean.INTEGER, clean.DECIMAL)
    return (
        F.when(frozen.isNull() | (frozen == clean.EMPTY), voted)
        .when((voted == clean.EMPTY) | (voted == frozen), frozen)
        .when(frozen.isin(*numbers) & voted.isin(*numbers), clean.DECIMAL)
        .otherwise(clean.PLAIN)
    )


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _stored(self, table: str) -> DataFrame:
        empty = small_table(self.spark, [], SCHEMAS[table])
        try:
            return self.spark.read.schema(empty.schema).parquet(f"{self.root}/{table}").select(*empty.columns)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty

    def _append(self, table: str, df: DataFrame, **options) -> None:
        df.select(*small_table(self.spark, [], SCHEMAS[table]).columns).write.mode("append").parquet(
            f"{self.root}/{table}", **options
        )

    # -- writing --

    def add(self, lines: DataFrame, batch: int) -> None:
        """Take in the files whose ``lines`` (``folder.text_lines``) make a batch.
        Batches are numbered in the order they come; one that is run again has its
        old number. Files without data leave nothing."""
        placed = placed_records(lines)
        if not placed.columns:
            return
        ingest, seq = uuid.uuid4().hex, time.time_ns()
        votes = cut_lineage(file_votes(placed).filter("filled > 0"))
        for signature, columns in placed.columns.items():
            cells = placed.rows(signature).select(
                F.col(SOURCE).alias("file"), F.col(ORDINAL).alias("ordinal"),
                F.array(*[F.col(f"`{c}`") for c in columns]).alias("cells"),
                F.lit(ingest).alias("ingest"), F.lit(signature).alias("signature"),
            )
            self._append("rows", cells, partitionBy="signature")
        names = small_table(
            self.spark, [(s, i, c) for s, columns in placed.columns.items() for i, c in enumerate(columns)],
            "signature string, position int, column string",
        )
        self._append("types", self._voted(votes, names, batch).withColumn("seq", F.lit(seq)))
        # Rows of a batch can be seen once their files are there.
        self._append("files", votes.withColumns({
            "batch": F.lit(batch).cast("bigint"), "ingest": F.lit(ingest), "seq": F.lit(seq),
        }))

    def _voted(self, votes: DataFrame, names: DataFrame, batch: int) -> DataFrame:
        """The types after a batch: votes added to those before it, kinds no
        narrower than before."""
        new = votes.select("signature", F.posexplode("votes").alias("position", "vote")).groupBy("signature", "position").agg(
            *[F.sum(f"vote.{v}").alias(v) for v in VOTES]
        )
        old = self.types(before=batch).select("signature", "position", F.col("kind").alias("frozen"), *[F.col(v).alias(f"old_{v}") for v in VOTES])
        summed = new.join(old, ["signature", "position"], "left").select(
            "signature", "position", "frozen", *[(F.col(v) + F.coalesce(f"old_{v}", F.lit(0))).alias(v) for v in VOTES]
        )
        voted = clean.decided(F.struct(*VOTES))
        return summed.join(names, ["signature", "position"]).withColumns({
            "kind": wider(F.col("frozen"), voted), "batch": F.lit(batch).cast("bigint"),
        })

    # -- reading --

    def types(self, before: int | None = None) -> DataFrame:
        """The types in force, a row per signature and column; with ``before`` those
        that held when that batch began."""
        kept = self._stored("types")
        if before is not None:
            kept = kept.filter(F.col("batch") < before)
        last = Window.partitionBy("signature", "position").orderBy(F.desc("batch"), F.desc("seq"))
        return kept.withColumn("_place", F.row_number().over(last)).filter("_place = 1").drop("_place", "seq")

    def files(self) -> DataFrame:
        """Each file with the ingest its rows are of."""
        last = Window.partitionBy("file").orderBy(F.desc("seq"))
        return self._stored("files").withColumn("_place", F.row_number().over(last)).filter("_place = 1").drop("_place")

    def signatures(self) -> dict[str, list[str]]:
        """The columns of each signature; the driver holds one entry per header."""
        rows = self.types().groupBy("signature").agg(F.sort_array(F.collect_list(F.struct("position", "column"))).alias("c")).collect()
        return {r["signature"]: [x["column"] for x in r["c"]] for r in rows}

    def read(self, signature: str) -> DataFrame:
        """``_source``, the typed columns and ``_ordinal`` of all files with a header."""
        kinds = self.types().filter(F.col("signature") == signature).orderBy("position").collect()
        columns = [r["column"] for r in kinds]
        typing = clean.typing_of(columns, [r["kind"] for r in kinds])
        files = self.files().select("file", "ingest")
        rows = self._stored("rows").filter(F.col("signature") == signature).join(files, ["file", "ingest"], "left_semi")
        text = rows.select(
            F.col("file").alias(SOURCE), F.col("ordinal").alias(ORDINAL), *[F.col("cells")[i].alias(c) for i, c in enumerate(columns)]
        )
        return typed(text, typing, columns)

"""Session settings and the shared scratch folder."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str = "tablegrist", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # Beyond 8000 bytes a generated method is no longer compiled to machine
        # code; such a stage is faster as separate, smaller methods.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster in
    ``spark.checkpoint.dir``. Only a local session without the setting gets a
    folder of its own."""
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder all executors share")
    path = os.path.join(tempfile.gettempdir(), f"tablegrist-{spark.sparkContext.applicationId}")
    spark.conf.set(CHECKPOINT_KEY, path)
    return path


def new_dir(spark: SparkSession, label: str) -> str:
    """A path under the shared folder nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder and read it back, so several
    consumers share one computation that survives executor loss."""
    spark = df.sparkSession
    path = new_dir(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def short_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs within sends no more than ``rows`` rows at once to Python. A batch is
    held by the JVM, outside its heap and while it grows twice, and by the worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small file over all cores. A file below the split size,
    or of one row group, is one task however costly its rows are; an input that
    already comes in as many splits as there are cores is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few known rows as a frame made of literals: no Python worker and no
    parallelised collection behind it, and an empty one folds away in plans."""
    if not rows:
        fields = T._parse_datatype_string(schema).fields
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    known = json.dumps([dict(zip(names, r)) for r in rows], default=str)
    parsed = F.from_json(F.lit(known), f"array<struct<{_struct_ddl(schema)}>>")
    return spark.range(0, 1, 1, 1).select(F.inline(parsed))


def _struct_ddl(schema: str) -> str:
    return ", ".join(
        f"`{f.name}`: {f.dataType.simpleString()}" for f in T._parse_datatype_string(schema).fields
    )

"""Exact duplicates by a stateful stream.

A narrow log holds one line per row: digest of the normalised text, id, length
and the place of the content (file and row). A streaming aggregate reads the log
and keeps, in disk-backed state (RocksDB) without a watermark, so without expiry,
one entry per digest: how many rows had it and which row stays. The state
outlives the run, so a later log is checked against all earlier ones. Where a
digest was met more than once, the full normalised bytes of these rows are
compared with those of the row that stays.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegrist.llm.rows import FILE, ROW, at_places, located
from tablegrist.session import new_dir

#: The six blanks `[\x20\x09-\x0D]` that do not count in a comparison.
BLANKS = r"[\x20\x09-\x0D]+"
#: Up to so many rows with a repeated digest are found again by a broadcast of
#: their places (about 150 bytes each); more are joined by shuffling.
BROADCAST_HITS = 100_000
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Else every partition's store sets aside megabytes for its logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # The stores of an executor share so much memory outside the heap, and those
    # that no query needs any more are closed soon.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def append_log(
    docs: DataFrame, log_dir: str, key: str, text: str, digest: Callable[[Column], Column]
) -> None:
    """Add a line for each row of ``docs``, which must be located."""
    docs.select(
        F.col(key).alias("id"),
        digest(normalised(F.col(text))).alias("digest"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("points"),
        F.col(FILE),
        F.col(ROW),
    ).write.mode("append").parquet(log_dir)


def update_state(spark: SparkSession, log_dir: str, state_dir: str) -> DataFrame:
    """Take all log lines that the state has not seen yet into the state, and
    return the state: ``digest``, ``group_size``, the ``id`` and the place of
    the row that stays (most code points, then smallest id, then last place)."""
    lines = spark.readStream.schema(spark.read.parquet(log_dir).schema).parquet(log_dir)
    best = F.struct("points", F.bitwise_not("id").alias("not_id"), FILE, ROW)
    kept = lines.groupBy("digest").agg(
        F.count("*").alias("group_size"), F.max(best).alias("best")
    )
    with _settings(spark, STATE_SETTINGS):
        stream = (
            kept.writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", state_dir)
            .trigger(availableNow=True)
            .start()
        )
        stream.awaitTermination()
        state = spark.read.format("statestore").load(state_dir)
        names = [f.name for f in state.schema["value"].dataType.fields]
        size, best = (F.col(f"value.`{n}`") for n in names)
        return state.select(
            F.col("key.digest").alias("digest"),
            size.alias("group_size"),
            F.bitwise_not(best["not_id"]).alias("keep_id"),
            best[FILE].alias("keep_file"),
            best[ROW].alias("keep_row"),
        )


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]):
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def grouped(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """Each row's group of equal texts: ``id``, ``keep_id``, ``group_size``,
    ``kept``, ``digest`` and its place. ``docs`` must be located.

    Null text counts as empty, so all null and blank texts are one group. Of
    rows with equal length and id one stays; a null id loses against any other.
    An empty table gives an empty result. ``digest`` may be any function of the
    normalised text: texts that share a digest without being equal are told
    apart by their bytes.
    """
    spark = docs.sparkSession
    log_dir, state_dir = new_dir(spark, "dedup-log"), new_dir(spark, "dedup-state")
    append_log(docs, log_dir, key, text, digest)
    log = spark.read.parquet(log_dir)
    if log.isEmpty():
        return _result(log.withColumns(_columns_of(log)))
    state = update_state(spark, log_dir, state_dir)
    found = log.join(state, "digest")
    collided = _collided(docs, found, state, text)
    if collided.isEmpty():
        return _result(found)
    return _result(found.join(collided, "digest", "left_anti")).unionByName(
        _result(_by_bytes(docs, found.join(collided, "digest", "left_semi"), text))
    )


def _columns_of(log: DataFrame) -> dict[str, Column]:
    kinds = {"group_size": "bigint", "keep_file": "string", "keep_row": "bigint"}
    kinds["keep_id"] = log.schema["id"].dataType.simpleString()
    return {name: F.lit(None).cast(kind) for name, kind in kinds.items()}


def _result(found: DataFrame) -> DataFrame:
    here = (F.col(FILE) == F.col("keep_file")) & (F.col(ROW) == F.col("keep_row"))
    return found.select("id", "keep_id", "group_size", here.alias("kept"), "digest", FILE, ROW)


def _collided(docs: DataFrame, found: DataFrame, state: DataFrame, text: str) -> DataFrame:
    """Digests under which different bytes were met; the bytes of all rows with a
    repeated digest are compared with the bytes of the row that stays."""
    repeated = state.filter("group_size > 1")
    hits = found.filter("group_size > 1").select(
        FILE, ROW, "digest",
        ((F.col(FILE) == F.col("keep_file")) & (F.col(ROW) == F.col("keep_row"))).alias("keeps"),
    )
    n_hits = repeated.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    texts = docs.select(FILE, ROW, F.col(text).alias("text")).join(
        F.broadcast(hits) if n_hits <= BROADCAST_HITS else hits, [FILE, ROW]
    ).select("digest", "keeps", normalised(F.col("text")).alias("bytes"))
    first = texts.filter("keeps").select("digest", F.col("bytes").alias("kept_bytes"))
    others = texts.filter("not keeps").join(first, "digest")
    return others.filter("bytes <> kept_bytes").select("digest").distinct()


def _by_bytes(docs: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """Groups by the bytes themselves for the few rows of collided digests."""
    lines = found.select("id", "digest", "points", FILE, ROW)
    lines = docs.select(FILE, ROW, normalised(F.col(text)).alias("bytes")).join(lines, [FILE, ROW])
    best = F.max(F.struct("points", F.bitwise_not("id").alias("not_id"), FILE, ROW)).alias("best")
    groups = lines.groupBy("bytes").agg(F.count("*").alias("group_size"), best)
    return lines.join(groups, "bytes").withColumns({
        "keep_id": F.bitwise_not(F.col("best.not_id")),
        "keep_file": F.col(f"best.{FILE}"),
        "keep_row": F.col(f"best.{ROW}"),
    }).drop("bytes", "best")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = located(docs)
    return at_places(docs, grouped(docs, key, text).filter("kept"))

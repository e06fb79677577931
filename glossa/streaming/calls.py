"""Streaming over the call log: totals per window, idempotent ingest, running totals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructType

from ..functions.keys import null_safe_join
from ..session import shared_dir

# Window of the monitor and how late a record may come.
WINDOW, LATENESS = "10 minutes", "1 hour"
CALL_KEY = ("prompt_hash", "model", "temperature", "response_index")


def read_calls(spark: SparkSession, path: str, schema: StructType, kind: str = "json", **options: str) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).format(kind).load(path)


def call_totals(calls: DataFrame, tokens: Column, ts: str = "ts", model: str = "model") -> DataFrame:
    """Calls and tokens per model and tumbling window; works on streams and tables alike.

    On a stream, a window is emitted once the watermark has passed its end, and
    records later than that are dropped.
    """
    timed = calls.withWatermark(ts, LATENESS) if calls.isStreaming else calls
    totals = timed.groupBy(F.window(ts, WINDOW).alias("window"), F.col(model).alias("model")).agg(
        F.count(F.lit(1)).alias("n_calls"), F.coalesce(F.sum(tokens), F.lit(0)).alias("n_tokens")
    )
    return totals.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "model", "n_calls", "n_tokens"
    )


def drop_redelivered(calls: DataFrame, keys: Sequence[str] = CALL_KEY, ts: str = "ts") -> DataFrame:
    """Keep one copy of each call; on a stream, copies are recognised within the watermark delay."""
    if calls.isStreaming:
        return calls.withWatermark(ts, LATENESS).dropDuplicatesWithinWatermark(list(keys))
    return calls.dropDuplicates(list(keys))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is available now to a Parquet table, each row exactly once."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _stored_already(calls: DataFrame, path: str, delivery: str, keys: Sequence[str]) -> DataFrame:
    """Keys of the calls that other deliveries hold."""
    wanted = calls.select(*keys)
    schema = StructType([*wanted.schema.fields]).add("delivery", StringType())
    stored = calls.sparkSession.read.schema(schema).parquet(path).filter(F.col("delivery") != delivery).select(*keys)
    return null_safe_join(stored, wanted, keys, "left_semi")


def new_calls_writer(path: str, run: str, keys: Sequence[str] = CALL_KEY) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that stores the calls whose key no other delivery holds, however late a copy comes.

    The stored calls are the index: only their key columns are read. The batch is written aside first, so Spark knows its size
    and sends the keys of a small batch to the store, which is then not shuffled. A null in a key equals a null; of copies in one batch any one is kept. Each batch
    has a folder named by ``run`` and its number, and is compared with all other folders, so a replayed batch writes the same calls
    to the same folder. ``run`` names the checkpoint: another checkpoint counts its batches anew and needs another name. One
    writer at a time. ``delivery`` is the name of the folder column, so calls may not have a column of that name.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, delivery, aside = batch.sparkSession, f"{run}-{batch_id}", shared_dir(batch.sparkSession, "delivery")
        batch.dropDuplicates(list(keys)).write.parquet(aside)
        calls = spark.read.schema(batch.schema).parquet(aside)
        if _exists(spark, path):
            calls = null_safe_join(calls, _stored_already(calls, path, delivery, keys), keys, "left_anti")
        calls.write.mode("overwrite").parquet(f"{path}/delivery={delivery}")
        _remove(spark, aside)

    return write


def append_new(stream: DataFrame, path: str, checkpoint: str, run: str, keys: Sequence[str] = CALL_KEY) -> StreamingQuery:
    """Append the calls not stored yet; copies are recognised after any time and after restarts."""
    return (
        stream.writeStream.foreachBatch(new_calls_writer(path, run, keys))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stored_calls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("delivery")


# Folders of one tier that are merged into one of the next.
FAN = 8
MANIFEST = "version long, folder string, first long, last long, tier int"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def manifests(spark: SparkSession, path: str) -> dict[int, list[tuple[str, int, int, int]]]:
    """(folder, first batch, last batch, tier) by version, in order of batches. A version is there as a whole or not at all."""
    if not _exists(spark, f"{path}/manifest"):
        return {}
    out: dict[int, list] = {}
    for r in spark.read.schema(MANIFEST).json(f"{path}/manifest/*.done").collect():
        out.setdefault(r.version, []).append((r.folder, r.first, r.last, r.tier))
    return {v: sorted(entries, key=lambda e: e[1]) for v, entries in out.items()}


def batch_writer(path: str, keys: Sequence[str], value: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that stores a batch's sums and counts, and keeps the number of folders small.

    A batch is written to a folder of its own; ``FAN`` folders of one tier are added up into one of the next, so after n batches
    there are FAN folders a tier at most and log n tiers. What counts is named in a manifest. It is written aside and renamed, which is
    one step: before it the old folders count, after it the new one. A replayed batch that stands alone is written again to the
    same folder; one that is part of a merged folder has been counted and is left. Folders go one version after they were last named.
    """

    def total(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = manifests(spark, path)
        now = max(versions, default=-1)
        entries = versions.get(now, [])
        if any(first <= batch_id <= last and tier for _, first, last, tier in entries):
            return
        partial = batch.groupBy(*keys).agg(F.sum(F.col(value).cast("double")).alias("total"), F.count(value).alias("n"))
        partial.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if any(first == batch_id for _, first, _, _ in entries):
            return
        entries = sorted([*entries, (f"batch_id={batch_id}", batch_id, batch_id, 0)], key=lambda e: e[1])
        while True:
            tier = entries[-1][3]
            same = [e for e in entries if e[3] == tier]
            if len(same) < FAN:
                break
            first, last = same[0][1], same[-1][2]
            folder = f"merged-{first}-{last}"
            total(spark.read.parquet(*[f"{path}/{e[0]}" for e in same])).write.mode("overwrite").parquet(f"{path}/{folder}")
            entries = [*(e for e in entries if e[3] != tier), (folder, first, last, tier + 1)]
        _publish(spark, path, now + 1, entries)
        named = {e[0] for v in (versions.get(now, []), entries) for e in v}
        for old, gone in versions.items():
            if old < now:
                for folder in {e[0] for e in gone} - named:
                    _remove(spark, f"{path}/{folder}")
                _remove(spark, f"{path}/manifest/{old}.done")

    return write


def _publish(spark: SparkSession, path: str, version: int, entries: Sequence[tuple[str, int, int, int]]) -> None:
    aside, done = f"{path}/manifest/{version}.part", f"{path}/manifest/{version}.done"
    rows = spark.createDataFrame([(version, *e) for e in entries], MANIFEST)
    rows.coalesce(1).write.mode("overwrite").json(aside)
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (aside, done))
    if not source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, target):
        raise OSError(f"manifest {version} could not be put in place")


def accumulate(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], value: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(batch_writer(path, keys, value))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def accumulated_means(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Mean and count per cell over all batches stored so far: the folders that the newest manifest names, few as they are."""
    versions = manifests(spark, path)
    folders = [f"{path}/{e[0]}" for e in versions[max(versions)]]
    stored = spark.read.parquet(*folders)
    return stored.groupBy(*keys).agg((F.sum("total") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))

"""Continuous maintenance of the master, and streaming first-seen filters."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from noticeflow import schemas
from noticeflow.columns import unused
from noticeflow.sources import snapshots


def in_order(stream: DataFrame) -> DataFrame:
    """File rows with snapshot_ts, which orders files by the time they came and then by path, and file_part, which orders the parts of one."""
    meta = lambda name: F.col(f"_metadata.{name}").alias(name)
    return stream.select("*", F.struct(meta("file_modification_time"), meta("file_path")).alias("snapshot_ts"), F.col("_metadata.file_block_start").alias("file_part"))


def batch_name(checkpoint: str, number: int) -> str:
    """What a stream's batch is called in the master: the same whenever it runs again."""
    return f"{hashlib.md5(checkpoint.encode()).hexdigest()[:12]}-{number:012d}"


def merge_batch(batch: DataFrame, name: str, master: str, quarter: str, target: T.StructType = schemas.NOTICE, keep_keyless: bool = False) -> None:
    """Append one batch of ``in_order`` rows to the master."""
    # a file part is read by one task from its start on, so the id orders the rows of a part
    rows = snapshots.na_to_null(batch).withColumn("row_no", F.struct("file_part", F.monotonically_increasing_id().alias("place"))).drop("file_part")
    lists = {f.name: snapshots.text_to_list(F.col(f.name)) for f in target.fields if isinstance(f.dataType, T.ArrayType) and f.name in rows.columns}
    rows = rows.withColumns(lists) if lists else rows
    snapshots.append_to_master(batch.sparkSession, master, rows, quarter, schema=target, keep_keyless=keep_keyless, batch=name)


def maintain_master(
    spark: SparkSession, drops: str, master: str, checkpoint: str, quarter: str, schema: T.StructType = schemas.SNAPSHOT_CSV,
    target: T.StructType = schemas.NOTICE, keep_keyless: bool = False, max_files: int | None = None,
) -> StreamingQuery:
    """Merge every new CSV drop once; the first row of a url wins, by the time its file came, the file's path, and the place in it.

    ``max_files`` bounds what one batch takes; files are taken in order of time, so the master is the same for any bound. A file that
    comes later than a batch with younger ones replaces nothing. foreachBatch may run a batch twice; the batch's number is written with
    its rows, and the second run replaces those of the first, also where that had written a part only.
    """
    reader = spark.readStream.schema(schema).options(**snapshots.CSV)
    stream = in_order((reader.option("maxFilesPerTrigger", max_files) if max_files else reader).csv(drops))
    writer = stream.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, batch_name(checkpoint, number), master, quarter, target, keep_keyless))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: str = "url", event_time: str | None = None, within: str = "7 days") -> DataFrame:
    """Rows whose key was not seen before.

    Without an event time the state holds every key for ever. With one it holds those of the last
    ``within``, and a key may come again after that.
    """
    if event_time is None:
        return stream.dropDuplicates([key])
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, within).dropDuplicatesWithinWatermark([key])


def first_of_sessions(stream: DataFrame, keys: Sequence[str], event_time: str, gap: str, late: str = "0 seconds") -> DataFrame:
    """(keys, first_seen, last_seen, n): a row for each run of a key's events that are at most ``gap`` apart.

    Unlike ``first_seen`` the result does not depend on how a stream is cut into batches: a run ends where more than ``gap`` passes without an event, in
    event time. It comes out, and its state goes, once the stream is ``late`` beyond the run's end; rows older than that are left out. So the
    state holds the keys of the last ``gap + late`` only. Rows without an event time are in no run; a null key is one. Works on a table as well, where nothing is late.
    """
    time, run = unused([*stream.columns, "first_seen", "last_seen", "n"], "time", "run")
    timed = stream.where(F.col(event_time).isNotNull()).withColumn(time, F.col(event_time).cast("timestamp"))
    timed = timed.withWatermark(time, late) if stream.isStreaming else timed
    runs = timed.groupBy(F.session_window(time, gap).alias(run), *keys).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("n"))
    return runs.select(*keys, "first_seen", "last_seen", "n")

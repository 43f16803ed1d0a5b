"""What became of each key over all snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def presence_intervals(snapshots: DataFrame, key: str = "url", label: str = "snapshot_ts") -> DataFrame:
    """(key, spell, valid_from, valid_to, n_snapshots): a row for each run of successive snapshots that hold a key.

    ``valid_from`` is the label of the run's first snapshot, ``valid_to`` that of the first snapshot after it, null while the key is there in the last
    one; ``spell`` counts a key's runs, so 2 and more mean that it came back. One pass over the snapshots: each is reduced to its
    different keys before the shuffle, so what a key has in one task is a number for each snapshot. Rows without a key are one key; rows without a label are in no snapshot.
    """
    seen = snapshots.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("key"), F.col(label).alias("label")).agg(F.lit(1).alias("one"))
    # as many rows as there are snapshots
    labels = snapshots.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct().withColumn("no", F.row_number().over(Window.orderBy("label")))
    runs = (
        seen.join(F.broadcast(labels), "label")
        .withColumn("run", F.col("no") - F.row_number().over(Window.partitionBy("key").orderBy("no")))
        .groupBy("key", "run").agg(F.min(F.struct("no", "label")).alias("first"), F.max("no").alias("last"), F.count("*").alias("n_snapshots"))
        .withColumn("spell", F.row_number().over(Window.partitionBy("key").orderBy("run")))
    )
    after = labels.select((F.col("no") - 1).alias("last"), F.col("label").alias("valid_to"))
    return runs.join(F.broadcast(after), "last", "left").select(F.col("key").alias(key), "spell", F.col("first.label").alias("valid_from"), "valid_to", "n_snapshots")


def at_snapshot(intervals: DataFrame, label: str, key: str = "url") -> DataFrame:
    """Keys that were there in the snapshot of that label."""
    return intervals.where((F.col("valid_from") <= label) & (F.col("valid_to").isNull() | (F.col("valid_to") > label))).select(key)

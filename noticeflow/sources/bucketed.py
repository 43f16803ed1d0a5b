"""A master bucketed by the hash of its key, which is merged into without moving it.

The files lie in buckets by the hash of the url, so that a join by url reads each bucket where it is: only the new keys are shuffled, into as many parts. Before
the join the new keys' Bloom filter leaves out what of the master none of them can meet. Each batch is a partition of its own, which a repeated
batch replaces. A master is its folder and number of buckets; the table that the session's catalog knows it by is made anew each time.

Defined results: as ``snapshots.append_to_master``: the first row of a key wins, a blank key is none, and of all rows without a key the first is kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow import schemas
from noticeflow.columns import unused
from noticeflow.functions.bloom import bloom_filter, may_be_among
from noticeflow.operators import merge


class BucketedMaster:
    """The master below ``root``, in ``buckets`` buckets by ``key``; their number is the folder's for good."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, schema: T.StructType = schemas.NOTICE, key: str = "url"):
        self.spark, self.root, self.buckets, self.schema, self.key = spark, root, buckets, schema, key
        self.name = f"master_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(
            f"CREATE TABLE {self.name} ({columns}, quarter string, batch string) USING parquet OPTIONS ('partitionOverwriteMode' = 'dynamic') PARTITIONED BY (quarter, batch) "
            f"CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{root}'"
        )
        try:
            spark.read.schema(schema).parquet(root)
        except AnalysisException as e:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            spark.catalog.recoverPartitions(self.name)

    def detach(self) -> None:
        """Forget the table; its files stay."""
        self.spark.sql(f"DROP TABLE {self.name}")

    def read(self, quarter: str | None = None) -> DataFrame:
        df = self.spark.table(self.name)
        return df.where(F.col("quarter") == quarter) if quarter else df

    def novel(self, new: DataFrame, quarter: str, order: Sequence[str] = ("snapshot_ts", "row_no"), batch: str | None = None) -> DataFrame:
        """One row for each key of ``new`` that the quarter lacks, dealt as the master is."""
        other, one = unused([*new.columns, *self.schema.names], "other_key", "one")
        master = self.read(quarter)
        master = master.where(F.col("batch") != batch) if batch is not None else master
        firsts = merge.first_by_key(merge.blank_to_null(new, self.key), self.key, order)
        met = may_be_among(master.select(self.key), self.key, bloom_filter(merge.blank_to_null(new, self.key), self.key)).withColumnRenamed(self.key, other)
        joined = firsts.where(F.col(self.key).isNotNull()).repartition(self.buckets, self.key).join(met, F.col(self.key) == F.col(other), "left_anti")
        some = F.broadcast(master.where(F.col(self.key).isNull()).select(F.lit(1).alias(other)).limit(1))
        keyless = firsts.where(F.col(self.key).isNull()).withColumn(one, F.lit(1)).join(some, F.col(one) == F.col(other), "left_anti").drop(one)
        return joined.unionByName(keyless)

    def append(self, new: DataFrame, quarter: str, order: Sequence[str] = ("snapshot_ts", "row_no"), batch: str | None = None) -> None:
        """Append the rows of keys that the quarter lacks, as partition ``batch``, which a second run of that name replaces."""
        rows = self.novel(new, quarter, order, batch)
        have = set(rows.columns)
        rows = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        named = rows.withColumns({"quarter": F.lit(quarter), "batch": F.lit(batch or uuid.uuid4().hex)})
        named.write.insertInto(self.name, overwrite=True)  # of this partition alone: see the table's options

"""Rejected rows are kept with a reason, and do not stop a run: one pass writes good and rejected rows to two sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.columns import unused

GOOD, REJECTED = "good", "rejected"


def reasons(rules: Mapping[str, Column]) -> Column:
    """All rules that a row breaks, in their order; a rule is broken where its condition is true, or null."""
    broken = F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]) if rules else F.array().cast("array<string>")
    return F.filter(broken, lambda r: r.isNotNull())


def write_split(df: DataFrame, root: str, rules: Mapping[str, Column]) -> dict[str, int]:
    """Write ``df`` below ``root``: ``sink=good/reason=none``, and ``sink=rejected/reason=<first rule broken>`` with the column ``reasons``.

    One pass: the rules are computed once a row and the sinks are partitions of one write, which replaces those that it has rows for. Gives the numbers of good and rejected rows, counted
    while they were written. ``df`` has no columns of the names ``sink``, ``reason`` and ``reasons``, in any case.
    """
    if unused(df.columns, "sink", "reason", "reasons") != ["sink", "reason", "reasons"]:
        raise ValueError("the rows have columns of the names that the sinks use")
    marked = df.withColumn("reasons", reasons(rules))
    first = F.coalesce(F.get("reasons", 0), F.lit("none"))
    marked = marked.withColumns({"sink": F.when(F.size("reasons") == 0, GOOD).otherwise(REJECTED), "reason": first})
    seen = Observation()
    counted = marked.observe(seen, F.count_if(F.size("reasons") == 0).alias(GOOD), F.count_if(F.size("reasons") > 0).alias(REJECTED))
    counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sink", "reason").parquet(root)
    return seen.get


def read_split(spark: SparkSession, root: str, schema: T.StructType, sink: str) -> DataFrame:
    """The good rows as they were, or the rejected ones with reasons and reason; other partitions are not read."""
    more = [T.StructField("reasons", T.ArrayType(T.StringType())), T.StructField("sink", T.StringType()), T.StructField("reason", T.StringType())]
    rows = spark.read.schema(T.StructType([*schema.fields, *more])).parquet(root).where(F.col("sink") == sink)
    return rows.drop("sink", "reasons", "reason") if sink == GOOD else rows.drop("sink")

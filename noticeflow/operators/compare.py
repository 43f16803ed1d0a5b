"""Comparing snapshots. Keys are compared null-safely: two rows without a url match each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.columns import unused


def keyed(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Left semi or anti join by a key, null-safe; no job runs before the result is asked for.

    Rows without a key are set aside, so they don't meet in one task: whether ``right`` has one too is a row at most, which is
    sent to them.
    """
    other, one = unused([*left.columns, *right.columns], "other_key", "one")
    keys = right.where(F.col(key).isNotNull()).select(F.col(key).alias(other)).distinct()
    joined = left.where(F.col(key).isNotNull()).join(keys, F.col(key) == F.col(other), how)
    some = F.broadcast(right.where(F.col(key).isNull()).select(F.lit(1).alias(other)).limit(1))
    keyless = left.where(F.col(key).isNull()).withColumn(one, F.lit(1)).join(some, F.col(one) == F.col(other), how).drop(one)
    return joined.unionByName(keyless)


def added(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks; repeated rows stay."""
    return keyed(new, old, key, "left_anti")


def removed(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """Rows of ``old`` whose key ``new`` lacks."""
    return keyed(old, new, key, "left_anti")


def members(rows: DataFrame, keys: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key is among ``keys``."""
    return keyed(rows, keys, key, "left_semi")


def key_difference(left: DataFrame, right: DataFrame, key: str = "url") -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks."""
    return left.select(key).subtract(right.select(key))


def change_report(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """Added and removed rows with change_type."""
    return added(old, new, key).withColumn("change_type", F.lit("added")).unionByName(
        removed(old, new, key).withColumn("change_type", F.lit("removed")), allowMissingColumns=True
    )


def key_presence(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """(key, in_old, in_new) for each key, from one aggregation."""
    flag = lambda df, a, b: df.select(key, F.lit(a).alias("in_old"), F.lit(b).alias("in_new"))
    return flag(old, True, False).unionByName(flag(new, False, True)).groupBy(key).agg(F.max("in_old").alias("in_old"), F.max("in_new").alias("in_new"))


def differing_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows, with columns in one order, that one of the two bags has more often than the other, each as often as it has more.

    One aggregation over both, combined before the shuffle.
    """
    columns = old.columns
    surplus, side = unused(columns, "surplus", "side")
    both = old.withColumn(surplus, F.lit(-1)).unionByName(new.select(*columns).withColumn(surplus, F.lit(1)))
    more = both.groupBy(*columns).agg(F.sum(surplus).alias(surplus)).where(F.col(surplus) != 0)
    more = more.withColumn(side, F.when(F.col(surplus) > 0, "new").otherwise("old"))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.abs(surplus)))
    return more.withColumn(surplus, times).drop(surplus)


def unchanged(old: DataFrame, new: DataFrame) -> bool:
    """Whether both hold the same rows, as often, in any order; stops at the first difference."""
    if set(old.columns) != set(new.columns):
        return False
    return differing_rows(old, new).isEmpty()

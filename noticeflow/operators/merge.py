"""Union with schema drift, first row by key, and the incremental merge into a master."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.columns import unused
from noticeflow.operators.compare import keyed


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows; columns are those of the first frame, then further ones; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def blank_to_null(df: DataFrame, key: str = "url") -> DataFrame:
    """A blank key is no key."""
    return df.withColumn(key, F.when(F.col(key) != "", F.col(key)))


def first_by_key(df: DataFrame, key: str = "url", order: Sequence[str] = ("snapshot_ts", "row_no"), keep_keyless: bool = False) -> DataFrame:
    """The first row of each key in the given order; rows without a key are one key.

    An aggregation, so a key that a third of the rows share is combined before the shuffle.
    ``keep_keyless`` keeps all rows without a key.
    """
    (row,) = unused(df.columns, "row")
    rows = df.where(F.col(key).isNotNull()) if keep_keyless else df
    out = rows.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias(row)).select(f"{row}.*")
    return out.unionByName(df.where(F.col(key).isNull())) if keep_keyless else out


def first_by_rank(df: DataFrame, key: str = "url", order: Sequence[str] = ("snapshot_ts", "row_no")) -> DataFrame:
    """The same by ranking, for checks; a hot key is one task's work here."""
    (rank,) = unused(df.columns, "rank")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(rank) == 1).drop(rank)


def novel(master: DataFrame, new: DataFrame, key: str = "url", order: Sequence[str] = ("snapshot_ts", "row_no"), keep_keyless: bool = False) -> DataFrame:
    """One row for each key of ``new`` that the master lacks."""
    firsts = first_by_key(blank_to_null(new, key), key, order, keep_keyless)
    return keyed(firsts, master.where(F.col(key).isNotNull()) if keep_keyless else master, key, "left_anti")


def merge(
    master: DataFrame, new: DataFrame, key: str = "url", order: Sequence[str] = ("snapshot_ts", "row_no"),
    conflict: str = "keep_existing", keep_keyless: bool = False,
) -> DataFrame:
    """The master with the new keys' rows. ``keep_existing`` leaves old rows as they are, ``latest`` takes the new ones."""
    if conflict == "keep_existing":
        return union_all([master, novel(master, new, key, order, keep_keyless)])
    if conflict == "latest":
        fresh = first_by_key(blank_to_null(new, key), key, order, keep_keyless)
        return union_all([fresh, keyed(master, fresh, key, "left_anti")])
    raise ValueError(conflict)

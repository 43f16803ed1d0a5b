"""Snapshots and the quarterly master.

Snapshots are directories ``snapshot_ts=<label>`` of Parquet, whose labels sort in time, or CSV files whose names do. The
master is Parquet partitioned by quarter and by the batch that brought a row, and only grows: each batch writes novel rows to a partition of its own,
which a repeated batch replaces as a whole. Labels and quarters are parameters; nothing here looks at the clock.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow import schemas
from noticeflow.columns import unused
from noticeflow.operators import merge, reporting

# Cell texts that a CSV reader of notices takes for a missing value.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def na_to_null(df: DataFrame, tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Text cells that are one of the tokens become null."""
    return df.select(*[
        F.when(~F.col(f.name).isin(list(tokens)), F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields
    ])


#: How notice CSV is written and read: a quote inside a cell is doubled, and a quoted cell may hold line breaks. As a break may be inside a cell, a file
#: is read by one task whatever its size; large tables belong in Parquet.
CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


def csv_reader(spark: SparkSession, schema: T.StructType | None = None):
    reader = spark.read.options(**CSV)
    return reader.schema(schema) if schema is not None else reader


def list_to_text(c: Column) -> Column:
    return F.to_json(c)


def text_to_list(c: Column) -> Column:
    """A list column from JSON, or from the older quoted form ``['a', 'b']``."""
    return F.coalesce(F.from_json(c, "array<string>"), F.from_json(F.replace(c, F.lit("'"), F.lit('"')), "array<string>"))


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType = schemas.SNAPSHOT_CSV, lists: Sequence[str] = ("flagged_keywords",)) -> DataFrame:
    """A CSV snapshot with missing values as nulls and its list columns as arrays. Columns are found by position: see read_csv_drift."""
    df = na_to_null(csv_reader(spark, schema).option("enforceSchema", False).csv(path))
    return df.withColumns({c: text_to_list(F.col(c)) for c in lists if c in df.columns})


def read_csv_drift(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Snapshots of different generations as one table of the current columns; columns that one lacks are null.

    One job reads the header lines, files with the same one are read together, and no types are inferred. The number of
    different headers, not of files, decides how many parts the plan has.
    """
    first = (
        spark.read.option("wholetext", False).text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
        .where("block = 0").groupBy("file").agg(F.first("value").alias("header"))
    )
    by_header = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()  # names only
    frames = []
    for row in sorted(by_header, key=lambda r: r["files"]):
        names = csv_reader(spark).csv(row["files"][0]).columns
        own = T.StructType([schemas.SNAPSHOT_CSV[n] if n in schemas.SNAPSHOT_CSV.names else T.StructField(n, T.StringType()) for n in names])
        frames.append(read_csv(spark, row["files"], own, [c for c in ("flagged_keywords",) if c in names]))
    return merge.union_all([spark.createDataFrame([], schemas.NOTICE), *frames])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header; lists, which CSV has not, as JSON."""
    lists = {f.name: list_to_text(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    (df.withColumns(lists) if lists else df).write.mode(mode).options(header=True, quote='"', escape='"').csv(path)


def latest_csv(spark: SparkSession, folder: str, prefix: str = "snapshot_", schema: T.StructType = schemas.SNAPSHOT_CSV) -> DataFrame:
    """The file with the greatest name among those that begin with the prefix; empty if there is none. No other file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*").load(folder).select("path")
    latest = files.agg(F.max("path")).first()[0]  # names have one folder in common
    return na_to_null(csv_reader(spark, schema).csv(latest)) if latest else spark.createDataFrame([], schema)


def write_snapshot(df: DataFrame, root: str, label: str) -> None:
    """Write one snapshot; a second one with the same label (same minute, or same day) replaces it, and no other."""
    (
        df.withColumn("snapshot_ts", F.lit(label)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_ts").parquet(root)
    )


def write_observed(df: DataFrame, root: str, label: str, widths: Sequence[str] = ()) -> dict[str, int]:
    """As write_snapshot; the run's counts, and the widths of some columns, are gathered while the rows are written, without a second pass.

    The same figures as ``run_summary`` and ``column_widths`` (as ``width_<column>``).
    """
    figures = [*reporting.summary_columns(df), *[w.alias(f"width_{c}") for c, w in zip(widths, reporting.width_columns(df, widths) if widths else [], strict=True)]]
    seen = Observation()
    write_snapshot(df.observe(seen, *figures), root, label)
    return seen.get


def write_sorted(df: DataFrame, root: str, label: str, column: str = "date", files: int = 16) -> None:
    """One snapshot, newest first over all its files: each file holds a range of the column, undated rows the last files.

    Bounds are quantiles that Spark finds; equal dates, and rows without one, are dealt over files by a hash, so two files have a date in common at most,
    and no date is one task. Readers that filter by the column skip files and row groups by their statistics.
    """
    (salt,) = unused(df.columns, "salt")
    order = [F.col(column).desc_nulls_last(), F.col(salt)]
    dealt = df.withColumn(salt, F.xxhash64(*[c for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)])).repartitionByRange(files, *order)
    write_snapshot(dealt.sortWithinPartitions(*order).drop(salt), root, label)


def read_snapshots(spark: SparkSession, root: str, schema: T.StructType = schemas.NOTICE) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("snapshot_ts", T.StringType())])).parquet(root)


def latest_snapshot(spark: SparkSession, root: str, schema: T.StructType = schemas.NOTICE) -> DataFrame:
    """The snapshot with the greatest label; other partitions are not read."""
    all_of = read_snapshots(spark, root, schema)
    label = all_of.select("snapshot_ts").distinct().agg(F.max("snapshot_ts")).first()[0]  # a partition column: answered from folder names
    return all_of.where(F.col("snapshot_ts") == F.lit(label))


def read_master(spark: SparkSession, root: str, quarter: str | None = None, schema: T.StructType = schemas.NOTICE, batch: bool = False) -> DataFrame:
    """The master, or one quarter of it; empty, with the same columns, where there is none yet. ``batch`` adds what brought each row."""
    whole = T.StructType([*schema.fields, T.StructField("quarter", T.StringType()), T.StructField("batch", T.StringType())])
    try:
        df = spark.read.schema(whole).parquet(root)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df = spark.createDataFrame([], whole)
    df = df.where(F.col("quarter") == quarter) if quarter else df
    return df if batch else df.drop("batch")


def append_to_master(
    spark: SparkSession, root: str, new: DataFrame, quarter: str, order: Sequence[str] = ("snapshot_ts", "row_no"),
    schema: T.StructType = schemas.NOTICE, keep_keyless: bool = False, batch: str | None = None,
) -> None:
    """Append to a quarter the rows of keys it lacks. Running it again with the same rows appends nothing.

    ``batch`` names what is appended. A batch of that name that was written before, wholly or in part, counts as not there, and what is
    written replaces it: so a batch that runs again leaves the master as one run does, rows without a key among them.
    """
    master = read_master(spark, root, quarter, schema, batch=True)
    if batch is not None:
        master = master.where(F.col("batch") != batch)
    rows = merge.novel(master.drop("batch"), new, "url", order, keep_keyless)
    have = set(rows.columns)
    rows = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    named = rows.withColumns({"quarter": F.lit(quarter), "batch": F.lit(batch or uuid.uuid4().hex)})
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("quarter", "batch").parquet(root)

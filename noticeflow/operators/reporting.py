"""Aggregates, orders and profiles for reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.functions.dates import numeric_date_text


def codes_per_date(notices: DataFrame) -> DataFrame:
    """(publication_date, total_eccns), by the date as written, in order of that text; notices without one are left out."""
    return (
        notices.where(F.col("publication_date").isNotNull()).groupBy("publication_date")
        .agg(F.sum("eccn_count").alias("total_eccns")).orderBy("publication_date")
    )


def flagged_only(notices: DataFrame) -> DataFrame:
    return notices.where(F.col("flagged"))


def pdf_summary(notices: DataFrame) -> DataFrame:
    return notices.select("title", "date", "url")


def newest_first(notices: DataFrame, *tie_breaks: str) -> DataFrame:
    """By date, newest first, undated last; then by url."""
    return notices.orderBy(F.col("date").desc_nulls_last(), *(tie_breaks or ("url",)))


def head(notices: DataFrame, n: int = 5, *tie_breaks: str) -> DataFrame:
    return newest_first(notices, *tie_breaks).limit(n)


def summary_columns(notices: DataFrame) -> list[Column]:
    """The counts of a run; a flag that a table lacks is false everywhere."""
    flag = lambda c: F.count_if(F.col(c)) if c in notices.columns else F.count_if(F.lit(False))
    return [
        F.count(F.lit(1)).alias("rows"), F.count("url").alias("with_url"), flag("pdf_downloaded").alias("downloaded"),
        flag("flagged").alias("flagged"), flag("is_ear_related").alias("ear"), flag("is_itar_related").alias("itar"),
    ]


def run_summary(notices: DataFrame) -> DataFrame:
    """One row of counts."""
    return notices.agg(*summary_columns(notices))


def width_columns(df: DataFrame, columns: Sequence[str] | None = None, null_width: int = 3, margin: int = 2) -> list[Column]:
    """For each column the longest value or the header, plus a margin."""
    def width(c: str) -> Column:
        longest = F.max(F.coalesce(F.length(F.col(c).cast("string")), F.lit(null_width)))
        return (F.greatest(F.coalesce(longest, F.lit(0)), F.lit(len(c))) + margin).alias(c)

    return [width(c) for c in columns or df.columns]


def source_counts(notices: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, n) for each source of a dimension, with 0 for those without rows."""
    counts = notices.groupBy("source").agg(F.count("*").alias("n"))
    return sources.select("source").join(counts, "source", "left").select("source", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def column_widths(df: DataFrame, columns: Sequence[str] | None = None, null_width: int = 3, margin: int = 2) -> DataFrame:
    """One row of the columns' widths; one pass."""
    return df.agg(*width_columns(df, columns, null_width, margin))


def date_coverage(df: DataFrame, column: str = "date") -> DataFrame:
    """(rows, dated, any_dated, all_dated)."""
    return df.agg(
        F.count("*").alias("rows"), F.count(column).alias("dated"), (F.count(column) > 0).alias("any_dated"),
        (F.count(column) == F.count("*")).alias("all_dated"),
    )


def carry_forward_dates(links: DataFrame, group: Sequence[str], order: str, title: str = "link_text", paragraph: str | None = "p_text") -> DataFrame:
    """``links`` with date_text: the paragraph's own date, else the first one found so far in its link titles."""
    window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.first(numeric_date_text(F.col(title)), ignorenulls=True).over(window)
    return links.withColumn("date_text", F.coalesce(numeric_date_text(F.col(paragraph)), found) if paragraph else found)


def long_enough(links: DataFrame, href: str = "href", title: str = "link_text", least: int = 5) -> DataFrame:
    """Links whose address and text both have ``least`` characters."""
    return links.where((F.length(href) >= least) & (F.length(title) >= least))

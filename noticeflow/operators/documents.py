"""Documents of notices: admission by fetch metadata, and joining what their texts hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.urls import is_pdf_url

# Fixed value: the largest document taken, in bytes.
MAX_BYTES = 5 * 1024 * 1024
_KIND = "application/pdf"


def admission_reason(rules: str = "current", max_bytes: int = MAX_BYTES) -> Column:
    """Why a row of a fetch log is taken or not; the first that applies. A missing length counts as none.

    ``current``: URL, size, type, status. ``early``: URL, size, then status and type (in this case of letters) together.
    ``suffix``: the URL's suffix and the status alone.
    """
    length, kind = F.coalesce("content_length", F.lit(0)), F.coalesce("content_type", F.lit(""))
    failed = F.coalesce(F.col("status") != 200, F.lit(True))
    if rules == "current":
        return (
            F.when(~is_pdf_url(F.col("url")), "invalid_url").when(length > max_bytes, "too_large")
            .when(~F.contains(F.lower(kind), F.lit(_KIND)), "not_pdf").when(failed, "http_error").otherwise("accepted")
        )
    if rules == "early":
        return (
            F.when(~is_pdf_url(F.col("url")), "invalid_url").when(length > max_bytes, "too_large")
            .when(failed | ~F.contains(kind, F.lit(_KIND)), "http_error").otherwise("accepted")
        )
    if rules == "suffix":
        return F.when(~is_pdf_url(F.col("url"), suffix_only=True), "invalid_url").when(failed, "http_error").otherwise("accepted")
    raise ValueError(rules)


def admitted(fetch_log: DataFrame, rules: str = "current") -> DataFrame:
    return fetch_log.withColumn("reason", admission_reason(rules)).withColumn("accepted", F.col("reason") == "accepted")


def with_defaults(notices: DataFrame, source: str | None = None) -> DataFrame:
    """Constant and default columns of a notice that has no document yet."""
    out = notices.withColumns({
        "pdf_downloaded": F.lit(False), "pdf_path": F.lit(None).cast("string"), "contains_eccn": F.lit(False),
        "eccn_count": F.lit(0), "eccns_found": F.lit(""),
    })
    return out.withColumn("source", F.lit(source)) if source is not None else out


def enrich(notices: DataFrame, facts: DataFrame, key: str = "url") -> DataFrame:
    """Each notice with its document's contains_eccn, eccn_count and eccns_found, or their defaults.

    Notices without a url are set aside before the join, so they do not meet in one task.
    """
    defaults = {"contains_eccn": False, "eccn_count": 0, "eccns_found": ""}
    facts = facts.select(key, *defaults).dropDuplicates([key])
    base = notices.drop(*defaults)
    joined = base.where(F.col(key).isNotNull()).join(facts, key, "left").fillna(defaults)
    without = base.where(F.col(key).isNull()).withColumns({
        "contains_eccn": F.lit(False), "eccn_count": F.lit(0), "eccns_found": F.lit("")
    })
    return joined.unionByName(without)

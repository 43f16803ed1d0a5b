"""Reports: named tables from one master, written as one dataset each."""

from __future__ import annotations

from pyspark.sql import DataFrame

from noticeflow.operators import reporting
from noticeflow.sources.snapshots import write_csv


def report(master: DataFrame, new: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables by name, in their order. The code summary covers the new rows only, the others the whole master."""
    out = {"all_entries": master, "flagged_only": reporting.flagged_only(master), "pdf_summary": reporting.pdf_summary(master)}
    if new is not None:
        out["code_summary"] = reporting.codes_per_date(new)
    return out


def write_report(master: DataFrame, root: str, new: DataFrame | None = None, csv: bool = False) -> None:
    """Write each table below ``root``. The master feeds several of them, so it is kept while they are written."""
    master.persist()
    try:
        for name, table in report(master, new).items():
            if csv:
                write_csv(table, f"{root}/{name}")
            else:
                table.write.mode("overwrite").parquet(f"{root}/{name}")
    finally:
        master.unpersist()

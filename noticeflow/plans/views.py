"""Notice-shaped views of the star-schema tables: the same definitions for Spark and for SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns of the notice view but the written date, whose formatting is each engine's own.
_NOTICE = {
    "notice_id": "o_orderkey",
    "source": "concat('src-', o_orderstatus)",
    "url": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE concat('https://www.example.org/pkg/', cast(o_custkey AS {text}), "
           "CASE WHEN o_orderkey % 5 = 0 THEN '.html' ELSE '.pdf' END) END",
    "title": "concat('Notice ', o_orderpriority, ' on item ', cast(o_orderkey % 10 AS {text}), 'A', "
             "lpad(cast(o_custkey % 1000 AS {text}), 3, '0'), '.a and 5b', lpad(cast(o_orderkey % 1000 AS {text}), 3, '0'))",
    "true_date": "cast(o_orderdate AS date)",
    "o_totalprice": "o_totalprice",
}
_FORMS = [("MM/dd/yyyy", "%m/%d/%Y"), ("MMMM dd, yyyy", "%B %d, %Y"), ("yyyy-MM-dd", "%Y-%m-%d"),
          ("dd MMMM yyyy", "%d %B %Y"), ("MMMM dd yyyy", "%B %d %Y"), ("MM-dd-yyyy", "%m-%d-%Y")]


def _columns(text: str, date: str, engine: int) -> list[str]:
    cases = " ".join(f"WHEN {k} THEN " + date.format(f[engine]) for k, f in enumerate(_FORMS))
    return [*[f"{v.format(text=text)} AS {k}" for k, v in _NOTICE.items()], f"CASE o_orderkey % 6 {cases} END AS publication_date"]


_FETCH = [
    "url", "CASE WHEN notice_id % 11 = 0 THEN 404 ELSE 200 END AS status",
    "CASE WHEN notice_id % 7 = 0 THEN 'text/html' ELSE 'Application/PDF' END AS content_type",
    "CASE WHEN notice_id % 13 = 0 THEN NULL ELSE cast(floor(o_totalprice * 20) AS bigint) END AS content_length",
]
SNAP_OLD, SNAP_NEW = "true_date < date '1999-01-01'", "true_date >= date '1998-01-01'"


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_columns("string", "date_format(o_orderdate, '{}')", 0))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = notices(spark, sf_dir)
    return n.where(SNAP_OLD), n.where(SNAP_NEW)


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).selectExpr(*_FETCH)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("p_no"), F.col("o_orderkey").alias("a_no"),
        F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), F.date_format("o_orderdate", "MM/dd/yyyy"))).otherwise("")).alias("link_text"),
    )


#: Common table expressions that SQL checks begin with.
DUCK = f"""WITH notices_v AS (SELECT {', '.join(_columns('varchar', "strftime(o_orderdate, '{}')", 1))} FROM orders),
snap_old_v AS (SELECT * FROM notices_v WHERE {SNAP_OLD}), snap_new_v AS (SELECT * FROM notices_v WHERE {SNAP_NEW}),
fetch_log_v AS (SELECT {', '.join(_FETCH)} FROM notices_v),
links_v AS (SELECT o_custkey AS p_no, o_orderkey AS a_no, o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN ' ' || strftime(o_orderdate, '%m/%d/%Y') ELSE '' END AS link_text FROM orders)
"""

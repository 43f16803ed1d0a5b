"""URL rules: a blocked Bloom filter passes possible hits to an exact hash join.

A rule is (host, path, verdict). It fits its host and every subdomain, if the
url's path starts with the rule's path; the longest fitting rule wins (host
plus path; of two as long, the one with the longer host). Urls that no rule
fits get the default verdict.

Of each url only the prefixes are looked up that some rule's shape (labels in
the host, length of the path) can match, so the number of look-ups a url is at most the
number of distinct shapes, not of rules.

Defined results: a null url, or one without ``://``, has empty host and path and
gets the default verdict; rows that repeat are judged alike, each is returned;
of equal rules with different verdicts the greater verdict as text wins; a rule whose host is null, or whose host and path
are both empty, fits nothing; an empty table gives an empty result, and no rules give the default everywhere;
further columns pass through unchanged, even ones that share a helper's name.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import ascii_lower, bloom_blocks, bloom_build, bloom_test, fresh, written

#: Distinct shapes (labels, path length) of rules that are sent to every task; more are joined, with urls dealt over PARTS.
MAX_SENT, PARTS = 4096, 64
#: Join keys over which urls without host and path are dealt.
SPREAD = 1024


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(
    urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow",
    out: Sequence[str] = ("host", "path", "rule", "verdict"), bits_per_key: int = 16,
) -> DataFrame:
    """``urls`` with host, path, the winning rule (``host + path``, else null) and the verdict.

    ``rules`` has host, path (empty, or starting with ``/``) and verdict. The filter that
    tasks get is bounded by common.MAX_BLOCKS; the rules themselves are joined exactly,
    broadcast only if Spark's own size limit allows it.
    """
    rules = rules.select(
        ascii_lower(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict"
    ).where("rule_host <> '' or rule_path <> ''")
    host, path, rule, verdict = out
    clash = [c for c in urls.columns if c.lower() in {o.lower() for o in out}]
    base = urls.drop(*clash) if clash else urls
    base = base.withColumns({host: host_of(urls[url_col]), path: path_of(urls[url_col])})
    n_rules = rules.count()
    if not n_rules:
        return base.withColumns({rule: F.lit(None).cast("string"), verdict: F.lit(default)})

    n_blocks = bloom_blocks(n_rules, bits_per_key)
    keys = rules.select(F.xxhash64(F.concat("rule_host", "rule_path")).alias("h"))
    words = base.sparkSession.sparkContext.broadcast(bloom_build(keys, "h", n_blocks))

    @F.pandas_udf("boolean")
    def listed(h: pd.Series) -> pd.Series:
        return pd.Series(bloom_test(words.value, h.to_numpy()))

    # what is looked up depends on host and path alone, so a url that a third of the rows share is looked up once
    distinct = base.select(F.col(host).alias("host"), F.col(path).alias("path")).where("host <> '' or path <> ''").distinct()
    labels = distinct.withColumn("labels", F.explode(F.sequence(F.lit(1), F.size(F.split("host", r"\.")))))
    shapes = written(
        rules.groupBy(F.size(F.split("rule_host", r"\.")).alias("labels")).agg(F.collect_set(F.length("rule_path")).alias("lengths")), "shapes"
    )
    if shapes.agg(F.sum(F.size("lengths"))).first()[0] <= MAX_SENT:
        shaped = labels.join(F.broadcast(shapes), "labels")
    else:  # hosts have few different numbers of labels
        parts = shapes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        shaped = labels.withColumn("part", F.pmod(F.xxhash64("host", "path"), F.lit(PARTS)).cast("int")).join(parts, ["labels", "part"])
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    probes = shaped.select("host", "path", "labels", F.explode(fitting).alias("length")).select(
        "host", "path", F.expr("concat(substring_index(host, '.', -labels), substring(path, 1, length))").alias("key")
    )
    k_host, k_path, best, own = fresh([*base.columns, rule, verdict], "k_host", "k_path", "best", "own_path")
    hits = (
        probes.withColumn("hash", F.xxhash64("key")).where(listed("hash")).drop("hash")
        .join(rules.withColumn("key", F.concat("rule_host", "rule_path")), "key")
        .where((F.col("host") == F.col("rule_host")) | F.endswith("host", F.concat(F.lit("."), "rule_host")))
        .groupBy(F.col("host").alias(k_host), F.col("path").alias(k_path))
        .agg(F.max_by(F.struct(F.col("key").alias("r"), F.col("verdict").alias("v")),
                      F.struct(F.length("key"), F.length("rule_host"), F.col("verdict"))).alias(best))
    )
    # no path holds a question mark: urls that can't hit get keys that nothing has, so that they don't meet in one task
    nowhere = F.concat(F.lit("?"), (F.monotonically_increasing_id() % SPREAD).cast("string"))
    keyed = base.withColumn(own, F.when((F.col(host) == "") & (F.col(path) == ""), nowhere).otherwise(F.col(path)))
    joined = keyed.join(hits, (F.col(host) == F.col(k_host)) & (F.col(own) == F.col(k_path)), "left")
    return joined.select(
        *[keyed[c] for c in base.columns], F.col(f"{best}.r").alias(rule),
        F.coalesce(F.col(f"{best}.v"), F.lit(default)).alias(verdict),
    )

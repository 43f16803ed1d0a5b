"""Mixing sources to target weights by Poisson replication.

Each source has a mean rate: how often its documents should be repeated for the
mix to reach its target share of the budget. A document's count is the Poisson
quantile, at that mean, of a uniform number hashed from seed and document id, so
a rerun or a lost executor gives the same counts, and a document's count does
not depend on any other row. Copies are dealt by a hash of seed, id and copy
number over all shards and sorted by it within each: a global shuffle, in one
exchange.

Defined results: a null source is a source of its own; a null or empty text has
no characters and is repeated at its source's rate all the same (rate 1 for a
source without any characters); rows that repeat an id get the same count each;
sources without a target get none of the budget; a row without id is hashed by its text instead; an empty
table gives an empty result; texts of any length pass through whole, as do further columns, even ones
that share a helper's name. Rows are dealt by the copy's hash and the row's number together, so that rows that
repeat an id, or have none, don't meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import fresh, written


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) of 52 bits, from an MD5 of seed and keys."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """[P(0), P(<=1), ...] up to where the rest is below 1e-15; summed from logs, so large rates don't underflow."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(
        (-rate).alias("log_p"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("cdf")
    )

    def step(acc: Column, k: Column) -> Column:
        log_p = acc["log_p"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    many = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])
    return F.when(rate > 0, many).otherwise(F.array(F.lit(1.0)))


def _sizes(docs: DataFrame, source: str, text: str) -> DataFrame:
    """(source, chars), one row a source, counted before the shuffle."""
    return written(docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).alias("chars")), "sizes")


def tempered_rates(docs: DataFrame, source: str, text: str, exponent: float, epochs: float) -> DataFrame:
    """(source, rate): target share proportional to characters ** exponent, of a budget of epochs * all characters."""
    sizes, power = _sizes(docs, source, text), F.pow(F.col("chars").cast("double"), F.lit(exponent))
    total = sizes.agg(F.sum("chars").cast("double").alias("all"), F.sum(power).alias("norm")).first()
    if not total["all"]:
        return sizes.select("source", F.lit(1.0).alias("rate"))
    share = F.lit(epochs) * F.lit(total["all"]) * power / F.lit(total["norm"]) / F.col("chars")
    return sizes.select("source", F.when(F.col("chars") > 0, share).otherwise(F.lit(1.0)).alias("rate"))


def target_rates(docs: DataFrame, source: str, text: str, weights: dict[str, float], epochs: float) -> DataFrame:
    """(source, rate) from named target weights; weights need not add up to 1."""
    norm = sum(weights.values())
    shares = docs.sparkSession.createDataFrame([(k, v / norm) for k, v in weights.items()], "source string, share double")
    sizes = _sizes(docs, source, text)
    total = sizes.agg(F.sum("chars").cast("double")).first()[0] or 0.0
    share = F.coalesce("share", F.lit(0.0))
    rate = F.when(F.col("chars") > 0, share * F.lit(epochs) * F.lit(total) / F.col("chars")).when(share > 0, 1.0).otherwise(0.0)
    return sizes.join(shares, "source", "left").select("source", rate.alias("rate"))


#: Sources, and values of their distributions, that are sent to every task as one table; with more, they are joined, and each
#: source's rows are dealt over PARTS, as one may hold a third of all.
MAX_LOCAL_SOURCES, MAX_LOCAL_VALUES, PARTS = 10_000, 1_000_000, 64


def mix(
    docs: DataFrame, *, weights: dict[str, float] | None = None, exponent: float = 0.7, epochs: float = 1.0,
    seed: str = "mix-1", doc_id: str = "doc_id", source: str = "source", text: str = "text",
    copy: str | None = "copy_no", order: str | None = "shuffle_key",
) -> DataFrame:
    """Rows of ``docs``, each as often as its Poisson count says, in a global random order.

    ``copy`` numbers the copies from 0, ``order`` is the hash they are sorted by; None leaves the column out.
    """
    spark = docs.sparkSession
    rates = (
        target_rates(docs, source, text, weights, epochs) if weights else tempered_rates(docs, source, text, exponent, epochs)
    )
    got = rates.limit(MAX_LOCAL_SOURCES + 1).collect()
    values = sum(r["rate"] + 12 * r["rate"] ** 0.5 + 41 for r in got)
    few = len(got) <= MAX_LOCAL_SOURCES and values <= MAX_LOCAL_VALUES
    if few:
        rates = spark.createDataFrame(got, "source string, rate double")
    c_copy, c_order, c_source, c_cdf, c_row, c_part, c_of = fresh(
        docs.columns, copy or "copy_no", order or "shuffle_key", "mix_source", "mix_cdf", "mix_row", "mix_part", "mix_of"
    )
    cdfs = rates.select(F.col("source").alias(c_source), poisson_cdf(F.col("rate")).alias(c_cdf))
    # a row's number in the input, before any join: read again, a part of a file gives its rows the same
    docs = docs.withColumn(c_row, F.monotonically_increasing_id())
    if few:
        matched = docs.join(F.broadcast(cdfs), F.col(source).eqNullSafe(F.col(c_source)))
    else:
        parts = cdfs.withColumn(c_of, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        dealt = docs.withColumn(c_part, (F.col(c_row) % PARTS).cast("int"))
        matched = dealt.join(parts, F.col(source).eqNullSafe(F.col(c_source)) & (F.col(c_part) == F.col(c_of))).drop(c_part, c_of)
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))))
    u = uniform(seed, key)
    count = F.size(F.filter(c_cdf, lambda c: c <= u))
    copies = (
        matched.withColumn(c_copy, count).where(F.col(c_copy) > 0).drop(c_source, c_cdf)
        .withColumn(c_copy, F.explode(F.sequence(F.lit(0), F.col(c_copy) - 1)))
        .withColumn(c_order, F.md5(F.concat_ws("|", F.lit(f"{seed}/order"), key, F.col(c_copy).cast("string"))))
    )
    dealt = copies.repartition(F.xxhash64(c_order, c_row)).sortWithinPartitions(c_order)
    return dealt.drop(c_row, *[c for c, want in ((c_copy, copy), (c_order, order)) if not want])

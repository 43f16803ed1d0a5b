import hashlib
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from noticeflow.llm import chat, mixing, queries, url_filter
from noticeflow.llm.common import bloom_blocks, bloom_build, bloom_test, fresh


def test_fresh_names():
    assert fresh(["a", "B"], "a", "b", "c") == ["_a", "_b", "c"]


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    words = bloom_build(keys, "h", bloom_blocks(5000))
    import numpy as np

    inside = np.array([r["h"] for r in keys.collect()])
    outside = np.array([r["h"] for r in spark.range(10_000, 20_000).select(F.xxhash64("id").alias("h")).collect()])
    assert bloom_test(words, inside).all()
    assert bloom_test(words, outside).mean() < 0.02
    assert not bloom_test(bloom_build(keys.limit(0), "h", 1), inside).any()


URLS = [
    "http://Example.COM/en/x", "https://www.example.com/en/", "https://a.www.example.com/en/y?z", "https://example.com/de", "https://example.com", "https://notexample.com/en/",
    "http://x.net/es/a", "http://net/fr/", "http://x.net/en", "http://x.org/", "no scheme", "", None, "ftp://com?x#y", "a://b://c.com/en/", "http://user@x.COM:80/", "http://ÀB.net/fr/é", "http://example.com/en/" + "x" * 5000,
]


def slow(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, "allow")


def test_url_rules_on_all_shapes(spark):
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    rows = [(i, u, "x", "y") for i, u in enumerate([*URLS, *URLS])]
    df = spark.createDataFrame(rows, "page_id int, url string, possible string, key string")
    got = url_filter.judge(df, rules).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [slow(u) for u in [*URLS, *URLS]]
    assert all(r["possible"] == "x" and r["key"] == "y" for r in got)
    assert url_filter.judge(df.limit(0), rules).count() == 0
    none = url_filter.judge(df, rules.limit(0), default="block").collect()
    assert {(r["rule"], r["verdict"]) for r in none} == {(None, "block")} and len(none) == len(rows)


def test_rules_of_many_shapes_are_joined(spark, monkeypatch):
    """As it runs where a rule set has more shapes than are sent to every task; equal rules, empty rules, hosts without a name."""
    monkeypatch.setattr(url_filter, "MAX_SENT", 0)
    extra = [("org", "/a", "allow"), ("ORG", "/a", "block"), (None, "/", "block"), ("", "", "block"), ("", "/tmp/", "block"), ("x.org", None, "allow")]
    rules = spark.createDataFrame(queries.RULES + extra, "host string, path string, verdict string")
    urls = [*URLS, "http://org/ab", "http://x.org/ab", "file:///tmp/x", "file:///", "://", "://?"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "k_path int, url string, best string")
    out = url_filter.judge(df, rules)
    assert out.columns == ["k_path", "url", "best", "host", "path", "rule", "verdict"]
    got = {r["k_path"]: tuple(r)[3:] for r in out.collect()}
    known = [("org", "/ab", "org/a", "block"), ("x.org", "/ab", "x.org", "allow"), ("", "/tmp/x", "/tmp/", "block"), ("", "/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow")]
    want = [slow(u) if "x.org" not in (u or "") else ("x.org", "/", "x.org", "allow") for u in URLS] + known
    assert got == dict(enumerate(want))


def test_many_rules_against_brute_force(spark):
    rng = random.Random(2)
    part = lambda: rng.choice("ab") * rng.randint(1, 2)
    rules = list({(f"{part()}.{part()}", rng.choice(["", "/", f"/{part()}", f"/{part()}/"])): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    urls = [f"http://{'.'.join(part() for _ in range(rng.randint(1, 4)))}/{part()}/{part()}" for _ in range(300)]
    got = url_filter.judge(
        spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame([(h, p, v) for (h, p), v in rules], "host string, path string, verdict string"), default="none"
    )
    for r in got.collect():
        fit = [(len(h + p), len(h), h + p, v) for (h, p), v in rules if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        assert (r["rule"], r["verdict"]) == (max(fit)[2:] if fit else (None, "none"))


def test_chat_round_trip_and_mask(spark):
    rng = random.Random(4)
    texts = [queries.CONTROL_TEXT, "", None, "\\", "[+]", "[/user]</s><s>[assistant]", "a\nb\\n", "é<|[", "plain", "x" * 100_000, "\\[" * 3000]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a]b[", None]), rng.choice(texts)) for c in range(40) for t in range(rng.randint(1, 8))]
    rows += [(None, 0, "assistant", "lost"), (99, None, "user", "q"), (99, 1, "assistant", "a"), (99, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("ts", F.lit(1))
    out = chat.read_chats(chat.format_chats(df)).withColumn("loss", chat.loss_text(F.col("turns"))).collect()
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert {r["conv_id"] for r in out} == set(by)
    for r in out:
        want = [(a, b) for _, a, b in sorted(by[r["conv_id"]])]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        assert r["loss"] == "".join(b for a, b in want if a == "assistant")
    assert chat.format_chats(df.limit(0)).count() == 0


def test_adjacent_turns_are_merged(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id int, turn int, role string, text string")
    assert chat.format_chats(df).first()["formatted"] == "<s>[user]a[+]b[/user]</s><s>[assistant]c[/assistant]</s>"


def quantile(u, rate):
    k, p, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_poisson_counts(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, "x" * (i % 5), "c") for i in range(600)] + [(1, "s1", "x", "c")] * 2
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string, mix_cdf string")
    chars = {}
    for _, s, t, _ in rows:
        chars[s] = chars.get(s, 0) + len(t)
    norm = sum(c**0.5 for c in chars.values())
    out = mixing.mix(docs, exponent=0.5, epochs=2.0, seed="t")
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r["copy_no"])
        assert r["mix_cdf"] == "c"
    for i, s, _, _ in rows[:600]:
        u = int(hashlib.md5(f"t|{i}".encode()).hexdigest()[:13], 16) / 2**52
        n = quantile(u, 2.0 * sum(chars.values()) * chars[s] ** 0.5 / norm / chars[s])
        assert sorted(got.get(i, [])) == sorted(list(range(n)) * (3 if i == 1 else 1))
    assert out.columns == [*docs.columns, "copy_no", "shuffle_key"]
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs, copy=None, order=None).columns == docs.columns


def test_many_sources_are_joined_in_parts(spark, monkeypatch):
    """As it runs where there are more sources than are sent to every task: the same copies, nulls and repeated rows too."""
    rows = [(i, f"s{i % 40}" if i % 3 else None, "x" * (i % 7), i) for i in range(400)] + [(None, "s1", None, 7)] * 3
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string, mix_part int")
    few = mixing.mix(docs, epochs=2.0)
    want = sorted(map(str, few.collect()))
    monkeypatch.setattr(mixing, "MAX_LOCAL_SOURCES", 0)
    many = mixing.mix(docs, epochs=2.0)
    assert many.columns == few.columns and sorted(map(str, many.collect())) == want


def test_named_weights_reach_their_shares(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"), F.lit("xxxx").alias("text"))
    n = {r["source"]: r["count"] for r in mixing.mix(docs, weights={"a": 3, "b": 1}).groupBy("source").count().collect()}
    assert abs(n["a"] - 3000) < 200 and abs(n["b"] - 1000) < 120
    assert set(r["source"] for r in mixing.mix(docs, weights={"a": 1}).select("source").distinct().collect()) == {"a"}
    empty = spark.createDataFrame([(1, "z", ""), (2, "z", None)], "doc_id int, source string, text string")
    assert mixing.mix(empty).count() >= 0


@pytest.mark.parametrize("rate", [0.0, 0.3, 5.0, 900.0])
def test_cdf_is_whole(spark, rate):
    cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(rate)).alias("c")).first()["c"]
    assert abs(cdf[-1] - 1) < 1e-9 and cdf == sorted(cdf)
    if rate == 5.0:
        assert abs(cdf[3] - duckdb.sql("select exp(-5)*(1+5+12.5+125/6.0)").fetchall()[0][0]) < 1e-12

import base64
import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeflow.llm import jaccard, topk, warc


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 12)) * 0.3
    x[50:120] = x[50]  # ties
    x[200] = 0
    rows = [(i, [float(v) for v in r], "q") for i, r in enumerate(x)]
    rows += [(900, None, "q"), (950, [1.0, None] * 6, "q"), (1000, [float("nan")] * 12, "q"), (1050, [float("inf")] * 12, "q"), (1100, [], "q"), (None, [0.1] * 12, "q"), (1150, [0.5, 0.5], "q"), (1200, [0.25, 0.5], "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string")
    got = defaultdict(list)
    for r in topk.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    v = np.floor(256 * x).astype(int)
    for q in range(0, 400, 50):
        order = sorted((-int(v[i] @ v[q]), i) for i in range(400) if i != q)[:5]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(order)]
    assert set(got) == {*range(0, 400, 50), 1150, 1200}
    assert got[1150] == [(1, 1200, 128 * 64 + 128 * 128)]
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


def test_topk_of_large_components_and_repeats(spark):
    rows = [(k, [2.0**46 * (1 + k / 64), -(2.0**40), float(k)]) for k in range(100)] + [(100 + k, [1e300, 3e29 * k, 1.0]) for k in range(60)]
    rows += [(300, [2.0**46, 1.0, 1.0])] * 3 + [(301, [1.7e308] * 3), (302, [-1e300, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.search(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i != 301]  # 256 times that is beyond a double
    assert set(got) == {0, 50, 100, 150, 300}
    for q, v in {i: v for i, v in whole if i in got}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q)[:5]
        assert got[q] == [(i, max(-(2**63), min(2**63 - 1, -s))) for s, i in scored]
    assert [i for i, _ in got[0]].count(300) == 0 and max(s for _, s in got[100]) == 2**63 - 1


def test_many_repeats_of_a_candidate_are_ranked_each(spark):
    df = spark.createDataFrame([(7, [1.0, 1.0])] * 40 + [(8, [0.5, 0.5]), (50, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in topk.search(df, df.where("vec_id = 50")).collect()] == [7] * 5
    few = df.where("vec_id <> 7").unionByName(df.limit(3))
    assert [r["vec_id"] for r in topk.search(few, df.where("vec_id = 50")).orderBy("rank").collect()] == [7, 7, 7, 8]


def test_blocks_hold_the_same_rows_when_a_task_runs_again(spark):
    from noticeflow.llm import vectors

    rows = spark.createDataFrame([(k % 50, [float(k % 7)] * 3, 3, 1) for k in range(400)], "id long, v array<double>, dim int, tag long").distinct()
    packs = lambda n: sorted((r["block"], bytes(r["ids"]), bytes(r["data"])) for r in vectors.blocks(rows.repartition(n), 350, 40).collect())
    assert packs(1) == packs(5) == packs(13)


def test_lists_stop_early_and_are_exact():
    rng = np.random.default_rng(6)
    data = np.zeros((5000, 8), np.float32)
    data[np.arange(5000), rng.integers(0, 8, 5000)] = rng.integers(1, 4000, 5000)
    lists = topk.Lists(np.arange(5000) * 3, data)
    for _ in range(30):
        q = np.zeros(8, np.float32)
        q[rng.integers(0, 8, 2)] = rng.integers(-50, 50, 2)
        s = data @ q
        order = np.lexsort((np.arange(5000), -s))[:5]
        ids, scores = lists.best(q, -1, 5)
        assert list(ids) == list(order * 3) and list(scores) == list(s[order])
    big = np.array([[2**40, 1]]), np.array([[2**20, 3]])
    assert topk.exact_type(*big) is np.int64


def payload_digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def archived(spark, rows, min_bytes=0):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    path = warc.write_archives(pages.repartition(3), min_bytes=min_bytes)
    return path, warc.read_archives(spark, path, payloads=True)


def test_warc_round_trip(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    htmls = ["<p>a</p>", "", None, "WARC/1.1\r\n", fake, "x" + fake + fake + "y", fake * 3, "\r\n\r\n\r\n\r\n", "é" * 100_000, "<p>a</p>", "WARC/1.1\r\n" * 50, "\r\n\r\nWARC/1.1\r\nContent-Length: 99999999\r\n\r\n"]
    rows = [(i, f"http://h/{i} é\r\nX: y", h, "clash") for i, h in enumerate(htmls)] + [(100, None, "only", "c"), (101, "u", "only", "c")]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "1000b"):  # whole files, and splits that cut records and magics
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            _, records = archived(spark, rows)
            got = {r["page_id"]: r for r in warc.page_records(records).collect()}
            assert set(got) == {r[0] for r in rows}
            for i, _, h, _ in rows:
                best = max(j for j, _, g, _ in rows if (g or "") == (h or ""))
                want = (len((h or "").encode()), payload_digest(h), "response" if best == i else "revisit", None if best == i else best)
                assert tuple(got[i])[1:] == want, (size, i)
            texts = {r["payload"] for r in records.where("header like '%WARC-Type: response%'").collect()}
            assert texts == {h or "" for _, _, h, _ in rows}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_warc_min_bytes_repeats_and_empty(spark):
    _, records = archived(spark, [(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abcd", ""), (4, "u", "abcd", ""), (4, "u", "abcd", ""), (None, "u", "abcd", "")], min_bytes=3)
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.page_records(records).collect())
    assert got == [(0, "revisit", 4), (1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (4, "response", None)]
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.write_archives(pages)).count() == 0


def test_warc_broken_files(spark, tmp_path):
    record = lambda i, text: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(text)}\r\n\r\n{text}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((record(1, "one") + record(2, "two")[:-6]).encode())  # cut off
    (tmp_path / "b.warc").write_bytes(("junk" + record(3, "x")).encode())  # no record at the start
    (tmp_path / "c.warc").write_bytes((record(4, "x") + "WARC/1.1\r\nno header\r\n\r\n\r\n\r\n" + record(5, "x")).encode())
    got = warc.page_records(warc.read_archives(spark, str(tmp_path))).collect()
    assert sorted(r["page_id"] for r in got) == [1, 4]


def brute(texts, percent=75):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    passage = [word() for _ in range(60)]
    docs = [None, "", "  \n", "A b c", "a B  c", "a b c d", "a b c d e", "A b\x0bc d e", "a b c d e f", "é É x y z w", "É É x y z w"]
    docs += [" ".join(passage + [word() for _ in range(rng.randint(0, 40))]) for _ in range(25)]
    for n in (6, 7, 8, 9, 10, 12, 16, 20, 30, 60, 200):
        for _ in range(3):
            base = [word() for _ in range(n)]
            docs.append(" ".join(base))
            for _ in range(rng.randint(1, 7)):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, n // 12))):
                    copy[rng.randrange(len(copy))] = word()
                docs.append(" ".join(copy[: len(copy) - rng.randint(0, 2)]))
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_join_against_brute_force(spark):
    texts = corpus(1)
    want = brute(texts)
    df = spark.createDataFrame(texts, "doc_id int, text string").withColumn("signature", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df.repartition(3)).collect()}
    assert got == want
    kept = {r["doc_id"] for r in jaccard.deduplicate(df).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_join_with_every_boundary(spark, monkeypatch):
    texts = corpus(3)
    want = brute(texts)
    df = spark.createDataFrame(texts, "doc_id int, text string")
    for light, long, block in ((0, 32, 4096), (400, 1, 3), (10, 1, 4096)):
        monkeypatch.setattr(jaccard, "boundary", lambda *a, light=light, **k: light)
        monkeypatch.setattr(jaccard, "LONG", long)
        monkeypatch.setattr(jaccard, "BLOCK", block)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()}
        assert got == want, (light, long, block)


@pytest.mark.parametrize("percent", [1, 30, 50, 100])
def test_join_at_other_thresholds(spark, percent):
    rng = random.Random(percent)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 8))) for _ in range(60)]
    texts += ["a b c d e", "a b c d e f", "z a b c d e", "q r s", "q r s", "q r s t u v w x y", "u v w x y"]
    texts = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(texts, "doc_id int, text string"), percent=percent).collect()}
    assert got == brute(texts, percent)


def test_join_without_a_filter_of_the_nodes(spark, monkeypatch):
    """As it runs where there are more texts than a filter of bounded size can tell apart; parts of long lists are small too."""
    texts = corpus(4)
    monkeypatch.setattr(jaccard, "MAX_BLOCKS", 0)
    monkeypatch.setattr(jaccard, "PART", 4)
    df = spark.createDataFrame(texts, "doc_id int, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()} == brute(texts)
    clash = df.withColumns({"_gone": F.lit(1), "gone": F.lit(2)})
    kept = jaccard.deduplicate(clash)
    assert kept.columns == clash.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in brute(texts).items() if i == c}


def test_join_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "q r s t u v"), (0, "q r s t u v"), (2, "q r s t u v"), (3, "A b c d e f"), (None, "a b c d e f"), (None, None), (4, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["component_id"]) for r in jaccard.join(df).collect())
    assert got == sorted([(-1, None), (-1, None), (0, 0), (1, 0), (1, 0), (2, 0), (3, 0), (4, 4)])
    assert jaccard.join(df.limit(0)).count() == 0
    assert jaccard.join(df.where("text is null")).count() == 2
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in jaccard.deduplicate(df).collect()) == [-1, -1, 0, 4]


def test_sketches_never_say_more_than_differs():
    rng = np.random.default_rng(7)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 3000)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**63, rng.integers(1, 3000)).astype(np.uint64)]))
        assert jaccard.differing(jaccard.parity(a), jaccard.parity(b)) <= len(np.setxor1d(a, b))


def test_prefix_rule():
    t = Fraction(3, 4)
    assert [jaccard.prefix_length(n, t) for n in (1, 2, 3, 4, 5, 8, 100)] == [1, 1, 1, 2, 2, 3, 26]
    sizes = {10: 1000, 200: 1000}
    assert 0 <= jaccard.boundary(sizes, 0.0, t) <= jaccard.boundary(sizes, 500.0, t)


def test_components_of_long_paths(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000)], "a long, b long")
    got = {r["node"]: r["root"] for r in jaccard.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
    assert jaccard.components(edges.limit(0)).count() == 0

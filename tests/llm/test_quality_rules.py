import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeflow.llm import quality_rules


def counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_rule_counts_against_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", " \n\t ", "a", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 3000, "é|#\nx\n x\nx\n\n\n", "a\x0bb\x0cc\rd"]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "d# ", " ", "\t", "é "]) for _ in range(rng.randint(0, 200))) for _ in range(150)]
    texts += ["a b c d e f g " * 40_000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, words string")
    got = quality_rules.statistics(docs).orderBy("doc_id").collect()
    assert [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got] == [counts(t) for t in texts]
    assert got[0]["words"] == "clash"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)) + "."


def test_outliers_go_and_clean_texts_stay(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, int(np.exp(rng.gauss(5, 1))) + 25), "en" if i % 3 else None, "hot" if i % 2 else f"s{i % 40}") for i in range(900)]
    bad = [(1000 + i, " ".join(w + "%%%" for w in prose(rng, 200).split()), "en", "hot") for i in range(12)]
    bad += [(1100 + i, " | ".join(prose(rng, 200).split()), None, "s1") for i in range(12)]
    docs = spark.createDataFrame([*rows, *bad, (2000, None, "en", "hot"), (2001, "short", None, None)], "doc_id int, text string, lang string, source string")
    out = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, min_group=50).collect()}
    assert sum(out[r[0]]["kept"] for r in rows) >= 899
    assert not any(out[b[0]]["kept"] for b in bad) and not any(out[b[0]]["base_failed"] for b in bad)
    assert out[2000]["base_failed"] and out[2001]["base_failed"] and not out[2000]["kept"]
    assert quality_rules.apply_rules(docs.limit(0)).count() == 0


def numpy_mcd(x, starts, rng):
    """The least determinant over many starts, reweighted, with the operator's floors and factors."""
    q, floors = quality_rules, np.array(list(quality_rules.FLOORS.values()))

    def scatter(y, scale):
        m = y.mean(axis=0)
        s = np.cov(y.T, bias=True) * scale
        low = np.zeros((5, 5))
        for i in range(5):
            for j in range(i):
                low[i, j] = (s[i, j] - low[i, :j] @ low[j, :j]) / low[j, j]
            low[i, i] = np.sqrt(max(s[i, i] - low[i, :i] @ low[i, :i], floors[i] ** 2))
        return m, low @ low.T

    def distance(m, s):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)

    best = None
    for k in range(starts):
        m, s = scatter(x[rng.choice(len(x), 8, replace=False)], 1.0)
        if k == 0:
            m = np.median(x, axis=0)
            s = np.diag(np.maximum(1.4826 * np.median(np.abs(x - m), axis=0), floors) ** 2)
        last = np.inf
        while True:
            d = distance(m, s)
            new = scatter(x[d <= np.sort(d)[(len(x) + 1) // 2 - 1]], q.HALF)
            det = np.linalg.slogdet(new[1])[1]
            if det >= last - 1e-6:
                break
            (m, s), last = new, det
        if best is None or last < best[0]:
            best = (last, m, s)
    near = x[distance(*best[1:]) <= q.WITHIN]
    return best[0], *scatter(near, q.MOST * (len(near) + 1) / (len(near) - 7))


@pytest.mark.parametrize("share", [0.1, 0.4])
def test_mcd_against_numpy(spark, share):
    rng = np.random.default_rng(3)
    x = rng.multivariate_normal(np.zeros(5), np.diag([1, 0.3, 0.3, 0.3, 0.5]) + 0.1, 800)
    x[: int(800 * share)] += 8
    x = np.round(x * quality_rules.GRID)
    df = spark.createDataFrame([("g", *map(int, r)) for r in x], "g string, " + ", ".join(f"{d} int" for d in quality_rules.DIMS))
    results = []
    for parts in (4, 211):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(quality_rules.robust(df.repartition(parts)).first().asDict())
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    e = results[0]
    assert results[1] == e  # to the last bit, however the rows are dealt
    got = np.array([e[f"m_{d}"] for d in quality_rules.DIMS])
    low = np.array([[e[f"l_{a}_{b}"] if (a, b) in quality_rules.PAIRS else 0.0 for b in quality_rules.DIMS] for a in quality_rules.DIMS])
    _, m, s = numpy_mcd(x / quality_rules.GRID, 30, rng)
    assert np.abs(got - m).max() < 0.05 and np.abs(low @ low.T - s).max() < 0.1
    assert np.abs(got).max() < 0.25  # the shifted share has no say


def test_estimates_joined_in_parts_are_the_same(spark, monkeypatch):
    rng = random.Random(4)
    table = counted(spark, [(f"s{k % 3}", int(np.exp(rng.gauss(5.5, 0.5))) + 30, rng.randint(0, 3), 0, 0) for k in range(300)])
    want = kept(table)
    monkeypatch.setattr(quality_rules, "MAX_SENT", 0)
    assert kept(table) == want


def counted(spark, rows):
    """A table of counts from (source, n_words, n_symbols, n_dup_lines, n_repeat_words); words have five letters or so."""
    rng = random.Random(5)
    rows = [(i, "en", s, n, int(n * rng.gauss(5, 0.2)), sym, dup, rep) for i, (s, n, sym, dup, rep) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id int, lang string, source string, " + ", ".join(f"{c} long" for c in quality_rules.COUNTS))


def kept(table):
    return [r["kept"] for r in quality_rules.judge(table, quality_rules.estimates(table)).orderBy("doc_id").collect()]


def test_small_source_is_judged_by_its_own_normal(spark):
    rng = random.Random(1)
    length = lambda: int(np.exp(rng.gauss(5.5, 0.5))) + 30
    web = [("web", length(), 0, 0, 0) for _ in range(600)]
    lists = [("lists", n, n // 2, 0, 0) for n in (length() for _ in range(40))]  # half as many symbols as words
    got = kept(counted(spark, [*web, *lists, ("lists", 250, 0, 0, 0), ("web", 250, 125, 0, 0)]))
    assert all(got[:640]) and got[640:] == [False, False]


def test_junk_in_a_plane_has_no_small_determinant(spark):
    rng = random.Random(7)
    clean = [("web", int(np.exp(rng.gauss(5.5, 0.7))) + 30, 0, 0, 0) for _ in range(26)]
    table = counted(spark, [*clean, *[("web", n, 3 * n, 0, 0) for n in (150, 200, 300, 780, 270)]])  # long words, many symbols: the two go together
    table = table.withColumn("word_chars", F.when(F.col("n_symbols") > 0, 8 * F.col("n_words")).otherwise(F.col("word_chars")))
    got = kept(table)
    assert all(got[:26]) and not any(got[26:])


@pytest.mark.parametrize("copies", ["exact", "near"])
def test_a_third_of_junk_copies_has_no_say(spark, copies):
    rng = random.Random(2)
    clean = [("web", int(np.exp(rng.gauss(5.5, 0.5))) + 30, 0, 0, 0) for _ in range(200)]
    junk = [("web", n, n // 2, 0, 0) for n in (240 + (k if copies == "near" else 0) for k in range(100))]
    table = counted(spark, [*clean, *junk])
    if copies == "exact":
        table = table.withColumn("word_chars", F.when(F.col("n_symbols") > 0, 1200).otherwise(F.col("word_chars")).cast("long"))
    got = kept(table)
    assert all(got[:200]) and not any(got[200:])


def test_each_statistic_rejects_alone(spark):
    rng = random.Random(3)
    clean = [("web", int(400 * np.exp(rng.gauss(0, 0.3))), 0, 0, 0) for _ in range(300)]
    odd = [("web", 16000, 0, 0, 0), ("web", 400, 30, 0, 0), ("web", 400, 0, 14, 0), ("web", 400, 0, 0, 119)]
    got = kept(counted(spark, [*clean, *odd]))
    assert all(got[:300]) and got[300:] == [False] * 4


def test_no_two_pairs_of_names_share_a_key(spark):
    names = [None, "", "null", "a", "b", "c", "|", "||", "=", "a|", "|a", "a|=b", "b|=c", "=b|", "a||", "null|null"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "lang string, source string")
    own, by_lang = quality_rules._group_keys("lang", "source")
    keys = pairs.select(own.alias("own"), by_lang.alias("lang")).collect()
    assert len({r["own"] for r in keys}) == len(names) ** 2 and len({r["lang"] for r in keys}) == len(names)


def plain_distances(docs):
    """For each of (doc_id, text, lang, source) the squared distance from its group's estimate, infinite where the base rules fail; all in numpy."""
    rng, points, at = np.random.default_rng(9), {}, {}
    for i, text, lang, source in docs:
        n, chars, symbols, lines, repeats = counts(text)
        if n < 20 or 100 * repeats > 30 * n:
            continue
        at[i] = (np.array([np.log1p(n), np.log(chars / n), np.log1p(20 * symbols / n), np.log1p(50 * lines / n), np.log1p(10 * repeats / n)]), lang, source)
        points.setdefault((lang, source), set()).add(tuple(np.floor(at[i][0] * quality_rules.GRID + 0.5)))
    wider = {(lang,): set().union(*(v for k, v in points.items() if k[0] == lang)) for lang, _ in points}
    small = {lang for (lang, _), v in points.items() if len(v) < quality_rules.MIN_GROUP}
    in_all = set().union(*points.values())
    level = lambda lang, source: next(
        (k, v) for k, v in (((lang, source), points[lang, source]), ((lang,), wider[lang,]), ((), in_all)) if len(v) >= quality_rules.MIN_GROUP or k == ()
    )
    assert small  # wider groups are asked for
    fitted, out = {}, {i: np.inf for i, *_ in docs}
    for i, (x, lang, source) in at.items():
        key, found = level(lang, source)
        if key not in fitted:
            fitted[key] = numpy_mcd(np.array(sorted(found)) / quality_rules.GRID, 30, rng)[1:]
        m, s = fitted[key]
        out[i] = (x - m) @ np.linalg.inv(s) @ (x - m)
    return out

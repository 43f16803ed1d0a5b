import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from noticeflow.functions import text
from noticeflow.operators import compare, documents, merge, reporting


def keyed(spark, rows, extra=()):
    return spark.createDataFrame([(k, *v) if isinstance(v, tuple) else (k, v) for k, v in rows], "url string, v int")


def test_added_and_removed_are_null_safe(spark):
    old = keyed(spark, [("a", 1), (None, 2)])
    new = keyed(spark, [("a", 1), (None, 3), ("b", 4), ("b", 5)])
    assert sorted(r["v"] for r in compare.added(old, new).collect()) == [4, 5]
    assert compare.removed(old, new).count() == 0
    assert sorted(r["v"] for r in compare.members(new, old).collect()) == [1, 3]
    assert [r["url"] for r in compare.key_difference(new, old).collect()] == ["b"]
    kept = compare.members(new, old)
    assert not compare.differing_rows(compare.added(old, new).unionByName(kept), new).count()
    report = compare.change_report(old, keyed(spark, [("a", 9)])).collect()
    assert [(r["url"], r["change_type"]) for r in report] == [(None, "removed")]
    presence = {r["url"]: (r["in_old"], r["in_new"]) for r in compare.key_presence(old, new).collect()}
    assert presence == {"a": (True, True), None: (True, True), "b": (False, True)}


def test_unchanged_is_bag_equality(spark):
    a = spark.createDataFrame([("x", ["p"]), ("x", ["p"]), (None, None)], "url string, l array<string>")
    assert compare.unchanged(a, a.orderBy(F.desc("url")).select("l", "url"))
    assert not compare.unchanged(a, a.distinct())
    assert not compare.unchanged(a, a.drop("l"))


def test_columns_with_names_of_helpers_pass_through(spark):
    names = ("other_key", "rank", "row", "surplus", "side")
    old = keyed(spark, [("a", 1), (None, 2)]).withColumns({n: F.lit(n) for n in names})
    new = keyed(spark, [("a", 1), ("b", 3), (None, 4)]).withColumns({n: F.lit(n) for n in names})
    for out in (compare.added(old, new), compare.members(new, old), merge.first_by_key(new, order=["v"]), merge.first_by_rank(new, order=["v"])):
        assert out.columns == new.columns and all(r[n] == n for r in out.collect() for n in names)
    assert [r["url"] for r in compare.added(old, new).collect()] == ["b"]
    assert merge.merge(old, new, order=["v"]).count() == 3 == merge.merge(old, new, order=["v"], conflict="latest").count()
    assert compare.differing_rows(old.drop("side"), new.drop("side")).groupBy("side").count().count() == 2
    assert compare.added(old.where("url = 'a'"), new).count() == 2 and compare.members(new, old.where("url = 'a'")).count() == 1


def stacked(spark):
    return spark.createDataFrame(
        [("a", 1, "1", 0), ("a", 9, "2", 0), ("b", 6, "2", 1), ("b", 7, "2", 2), (None, 5, "2", 3), ("", 4, "2", 4)],
        "url string, v int, snapshot_ts string, row_no int",
    )


def test_first_by_key_and_by_rank_agree(spark):
    rows = stacked(spark)
    first = {r["url"]: r["v"] for r in merge.first_by_key(rows).collect()}
    assert first == {"a": 1, "b": 6, None: 5, "": 4} == {r["url"]: r["v"] for r in merge.first_by_rank(rows).collect()}
    assert Counter(r["url"] for r in merge.first_by_key(rows.union(rows), keep_keyless=True).collect())[None] == 2


def test_merge(spark):
    rows = stacked(spark)
    master = merge.first_by_key(rows.where("snapshot_ts = '1'"))
    new = rows.where("snapshot_ts = '2'")
    once = merge.merge(master, new)
    assert {r["url"]: r["v"] for r in once.collect()} == {"a": 1, "b": 6, None: 5}
    assert compare.unchanged(once, merge.merge(once, new))
    assert {r["url"]: r["v"] for r in merge.merge(master, new, conflict="latest").collect()} == {"a": 9, "b": 6, None: 5}
    assert merge.merge(master, new, keep_keyless=True).where("url is null").count() == 2
    with pytest.raises(ValueError):
        merge.merge(master, new, conflict="other")


def test_union_all_fills_columns(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, "q")], "x int, y string")
    assert [tuple(r) for r in merge.union_all([a, b]).orderBy("x").collect()] == [(1, None), (2, "q")]


def test_admission(spark):
    mb = 1024 * 1024
    log = spark.createDataFrame(
        [("x", 200, "application/pdf", 1), ("https://h/a.pdf", 200, "application/pdf", 6 * mb), ("https://h/b.pdf", 200, "text/html", None),
         ("https://h/c.pdf", 404, "Application/PDF", None), ("https://h/d.pdf", 200, "Application/PDF", 5 * mb), ("https://h/e.pdf", None, None, None)],
        "url string, status int, content_type string, content_length long",
    )
    reasons = lambda rules: [r["reason"] for r in documents.admitted(log, rules).collect()]
    assert reasons("current") == ["invalid_url", "too_large", "not_pdf", "http_error", "accepted", "not_pdf"]
    assert reasons("early") == ["invalid_url", "too_large", "http_error", "http_error", "http_error", "http_error"]
    assert reasons("suffix") == ["invalid_url", "accepted", "accepted", "http_error", "accepted", "http_error"]


def test_enrich_keeps_every_notice(spark):
    n = documents.with_defaults(spark.createDataFrame([("u", 1), ("w", 2), (None, 3)], "url string, id int"), "src")
    facts = spark.createDataFrame([("u", True, 2, "1A001, 1A002"), ("u", True, 2, "1A001, 1A002")], "url string, contains_eccn boolean, eccn_count int, eccns_found string")
    got = {r["id"]: (r["contains_eccn"], r["eccn_count"], r["eccns_found"], r["source"]) for r in documents.enrich(n, facts).collect()}
    assert got == {1: (True, 2, "1A001, 1A002", "src"), 2: (False, 0, "", "src"), 3: (False, 0, "", "src")}


def test_reports(spark):
    day = dt.date(2025, 3, 28)
    n = spark.createDataFrame(
        [("s", "b", "1/1", 2, True, day), ("s", None, "1/1", 3, None, None), ("t", "a", None, 1, False, day), ("t", "c", "", 4, True, dt.date(2024, 1, 1))],
        "source string, url string, publication_date string, eccn_count int, flagged boolean, date date",
    )
    assert [tuple(r) for r in reporting.codes_per_date(n).collect()] == [("", 4), ("1/1", 5)]
    assert reporting.flagged_only(n).count() == 2
    assert [r["url"] for r in reporting.head(n, 3).collect()] == ["a", "b", "c"]
    assert tuple(reporting.run_summary(n).first()) == (4, 3, 0, 2, 0, 0)
    sources = spark.createDataFrame([("s",), ("t",), ("empty",)], "source string")
    assert {tuple(r) for r in reporting.source_counts(n, sources).collect()} == {("s", 2), ("t", 2), ("empty", 0)}
    assert tuple(reporting.column_widths(n, ["url", "date"]).first()) == (5, 12)
    assert tuple(reporting.date_coverage(n).first()) == (4, 3, True, False)
    assert tuple(reporting.date_coverage(n.limit(0)).first()) == (0, 0, False, True)


def test_carry_forward(spark):
    links = spark.createDataFrame([(1, 0, "x", None), (1, 1, "1/2/2024", None), (1, 2, "y", None), (1, 3, "3/4/2024", None), (2, 0, "5/6/2024", "on 7/8/2024")],
                                  "p int, a int, link_text string, p_text string")
    got = [r["date_text"] for r in reporting.carry_forward_dates(links, ["p"], "a").orderBy("p", "a").collect()]
    assert got == [None, "1/2/2024", "1/2/2024", "1/2/2024", "7/8/2024"]
    long = reporting.long_enough(spark.createDataFrame([("/abcd", "title"), ("/a", "title"), ("/abcd", None)], "href string, link_text string"))
    assert long.count() == 1


def test_no_job_runs_while_a_plan_is_built(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "url string, n int")
    right = spark.createDataFrame([("b", 3), (None, 4)], "url string, n int")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans", "building plans")
    try:
        rows = left.withColumns({"snapshot_ts": F.lit("1"), "row_no": F.col("n"), "title": F.col("url")})
        more = right.withColumns({"snapshot_ts": F.lit("2"), "row_no": F.col("n"), "title": F.col("url")})
        plans = [
            compare.added(left, right), compare.removed(left, right), compare.members(left, right), compare.change_report(left, right), compare.key_presence(left, right),
            merge.merge(rows, more), merge.merge(rows, more, conflict="latest"), merge.merge(rows, more, keep_keyless=True),
            text.flag_keywords_from_table(rows, spark.createDataFrame([("a", 1)], "keyword string, rank int")),
        ]
        assert len(tracker.getJobIdsForGroup("plans")) == 0
        assert all(len(p.collect()) >= 0 for p in plans)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

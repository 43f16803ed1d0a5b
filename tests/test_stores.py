import datetime as dt
import random
import re
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow import schemas
from noticeflow.functions import text
from noticeflow.operators import history, reporting, widening
from noticeflow.sources import bucketed, quarantine, records, snapshots

SMALL = T.StructType([T.StructField("url", T.StringType()), T.StructField("title", T.StringType())])


def ranked(spark, rows, ts="1"):
    return spark.createDataFrame([(u, t, ts, t) for u, t in rows], "url string, title string, snapshot_ts string, row_no string")


def contents(df):
    return sorted((r["url"] or "", r["title"]) for r in df.collect())


def test_bucketed_master_grows_as_the_plain_one(spark, tmp_path):
    rng = random.Random(1)
    batches = [[(rng.choice([None, "", *[f"u{k}" for k in range(80)]]), f"t{b}-{k:03d}") for k in range(120)] for b in range(4)]
    for b, rows in enumerate(batches):
        snapshots.append_to_master(spark, f"{tmp_path}/plain", ranked(spark, rows, str(b)), "q", schema=SMALL)
        master = bucketed.BucketedMaster(spark, f"{tmp_path}/bucketed", 4, SMALL)  # each run finds the master by its folder
        master.append(ranked(spark, rows, str(b)), "q", batch=f"it's {b}")
        master.append(ranked(spark, rows, str(b)), "q", batch=f"it's {b}")
        state = contents(master.read("q"))
        master.detach()
        assert state == contents(snapshots.read_master(spark, f"{tmp_path}/plain", "q", SMALL))
    master = bucketed.BucketedMaster(spark, f"{tmp_path}/bucketed", 4, SMALL)
    master.append(ranked(spark, [("u1", "other quarter")]), "q2")
    assert contents(master.read("q2")) == [("u1", "other quarter")] and contents(master.read("q")) == state
    master.detach()


def test_bucketed_master_is_not_exchanged(spark, tmp_path):
    master = bucketed.BucketedMaster(spark, f"{tmp_path}/m", 4, SMALL)
    master.append(ranked(spark, [(f"u{k}", "t") for k in range(100)]), "q")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = master.novel(ranked(spark, [("u1", "x"), ("new", "y")]), "q")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    master.detach()
    depth = lambda line: len(re.match(r"[ :+\-|]*", line)[0])
    above, scans = [], 0
    for line in plan.splitlines():
        above = [a for a in above if a[0] < depth(line)] + [(depth(line), line)]
        if "FileScan" in line:
            scans += 1
            over = [x for _, x in above if "Exchange" in x]
            assert all("SinglePartition" in x or "Broadcast" in x for x in over), over  # a single row at most: whether a keyless one is there
    assert scans >= 2 and "Bucketed: true" in plan and "SortMergeJoin" in plan


def test_bloom_filter_lets_all_of_its_keys_through_and_few_others(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("url")).unionByName(spark.createDataFrame([(None,), ("",)], "url string"))
    rows = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("url"), F.col("id").alias("block"), F.lit(1).alias("words"))
    got = bucketed.may_be_among(rows, "url", bucketed.bloom_filter(keys, "url"))
    assert got.columns == rows.columns and got.where("block < 3000").count() == 3000 and got.count() < 3100
    assert bucketed.may_be_among(rows, "url", bucketed.bloom_filter(keys.limit(0), "url")).count() == 0


def test_history_over_snapshots(spark):
    held = {"1": "abcn", "2": "ab", "3": "bn", "4": "abb", "5": "ab"}
    rows = [(None if u == "n" else u, ts, u) for ts, urls in held.items() for u in urls] + [("x", None, "no snapshot")]
    got = history.presence_intervals(spark.createDataFrame(rows, "url string, snapshot_ts string, one string"))
    assert sorted((r["url"] or "", r["spell"], r["valid_from"], r["valid_to"], r["n_snapshots"]) for r in got.collect()) == [
        ("", 1, "1", "2", 1), ("", 2, "3", "4", 1), ("a", 1, "1", "3", 2), ("a", 2, "4", None, 2), ("b", 1, "1", None, 5), ("c", 1, "1", "2", 1)]
    for ts, urls in held.items():
        assert {r["url"] or "n" for r in history.at_snapshot(got, ts).collect()} == set(urls)
    assert history.presence_intervals(spark.createDataFrame([], "url string, snapshot_ts string")).count() == 0


def test_records_lose_nothing(spark):
    lines = [
        '{"a": 1, "b": "x", "d": "2024-01-02"}', '{"a": "7", "c": [1, 2], "b": null}', '{"a": "no"}', "[1]", "{torn", None, '{"a": 2.5, "q\\"r": {"z": 1}}', "{}", '{"a": 9223372036854775807}',
        '{"a": true, "B": 1}',
    ]
    df = spark.createDataFrame([(k, t, "own") for k, t in enumerate(lines)], "id int, value string, fields string")
    got = records.read_records(df, T.StructType.fromDDL("a long, b string, d date"))
    assert got.columns == ["id", "fields", "a", "b", "d", "rescued", "corrupt"]
    assert [tuple(r)[2:] for r in got.orderBy("id").collect()] == [
        (1, "x", dt.date(2024, 1, 2), None, None), (7, None, None, '{"c":[1,2]}', None), (None, None, None, '{"a":"no"}', None), (None, None, None, None, "[1]"),
        (None, None, None, None, "{torn"), (None, None, None, None, None), (None, None, None, '{"a":2.5,"q\\"r":{"z":1}}', None), (None, None, None, None, None),
        (9223372036854775807, None, None, None, None), (1, None, None, '{"B":1}', None)]
    found = {(r["field"], r["type"]): r["n"] for r in records.fields_of(df).collect()}
    assert found["a", "STRING"] == 2 and found["b", "VOID"] == 1 and found["c", "ARRAY<BIGINT>"] == 1
    assert records.discovered_schema(spark.createDataFrame([('{"n": 1, "x": 2.5, "f": true, "v": null}',), ('{"n": 3, "x": 1, "s": 1}',), ('{"s": "t"}',)], "value string")).simpleString() == (
        "struct<f:boolean,n:bigint,s:string,v:string,x:double>")


def test_rejected_rows_go_to_a_sink_of_their_own(spark, tmp_path):
    df = spark.createDataFrame([(1, "a.pdf", 5), (2, None, 5), (3, "b", 50), (4, "c.pdf", None)], "id int, url string, size int")
    rules = {"no_url": F.col("url").isNull(), "not_pdf": ~F.endswith("url", F.lit(".pdf")), "too_large": F.col("size") > 10}
    for _ in range(2):  # again: the same
        assert quarantine.write_split(df, f"{tmp_path}/q", rules) == {"good": 1, "rejected": 3}
    good = quarantine.read_split(spark, f"{tmp_path}/q", df.schema, quarantine.GOOD)
    assert good.columns == df.columns and [r["id"] for r in good.collect()] == [1]
    bad = quarantine.read_split(spark, f"{tmp_path}/q", df.schema, quarantine.REJECTED).orderBy("id").collect()
    assert [(r["id"], r["reason"], r["reasons"]) for r in bad] == [(2, "no_url", ["no_url", "not_pdf"]), (3, "not_pdf", ["not_pdf", "too_large"]), (4, "too_large", ["too_large"])]
    assert quarantine.write_split(df.limit(0), f"{tmp_path}/e", rules) == {"good": 0, "rejected": 0}
    with pytest.raises(ValueError, match="names"):
        quarantine.write_split(df.withColumn("Reason", F.lit(1)), f"{tmp_path}/x", rules)


def full(spark, n, seed=2):
    rng = random.Random(seed)
    rows = [(f"u{k}", f"title {k}" * rng.randrange(1, 9), None if k % 5 == 0 else dt.date(2020, 1, 1) if k % 3 == 0 else dt.date(2000, 1, 1) + dt.timedelta(rng.randrange(9000)), k % 2 == 0) for k in range(n)]
    some = spark.createDataFrame(rows, "url string, title string, date date, flagged boolean")
    return spark.createDataFrame([], schemas.NOTICE).unionByName(some, allowMissingColumns=True)


def test_figures_of_a_write_need_no_second_job(spark, tmp_path):
    df = full(spark, 500).repartition(4)
    spark.sparkContext.setJobGroup("observed", "a write with figures")
    try:
        found = snapshots.write_observed(df, f"{tmp_path}/s", "1", ("url", "title"))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("observed")) == 2  # the shuffle of this test's rows, and the write
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = reporting.run_summary(df).first().asDict() | {f"width_{c}": w for c, w in reporting.column_widths(df, ("url", "title")).first().asDict().items()}
    assert found == want and snapshots.read_snapshots(spark, f"{tmp_path}/s").count() == 500


def test_sorted_snapshot_files_hold_ranges(spark, tmp_path):
    df = full(spark, 3000)
    snapshots.write_sorted(df, f"{tmp_path}/s", "1", files=10)
    spans, undated = [], 0
    for path in sorted(Path(f"{tmp_path}/s/snapshot_ts=1").glob("part-*.parquet")):  # in order of task
        dates = [d for d in pq.read_table(path).column("date").to_pylist()]
        known = [d for d in dates if d]
        assert dates == sorted(known, reverse=True) + [None] * (len(dates) - len(known))
        undated += not known
        if known:
            spans.append((max(known), min(known), len(dates)))
    assert len(spans) + undated >= 8 and undated >= 1 and sum(n for *_, n in spans) < 3000
    assert all(a[1] >= b[0] for a, b in zip(spans, spans[1:], strict=False))  # a date in common at most
    assert max(n for *_, n in spans) < 900  # though a quarter of all rows has one date
    whole = snapshots.read_snapshots(spark, f"{tmp_path}/s").drop("snapshot_ts")
    assert Counter(map(repr, whole.collect())) == Counter(map(repr, df.collect()))
    plan = whole.where("date < date '2001-01-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThan(date" in plan


def test_long_texts_by_ranges_equal_those_at_once(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.choice([None, *range(-40, 400)]), rng.choice([None, "", "x", "yy", "zzzé"])) for _ in range(600)]
    rows = list({(k, n): (k, n, t) for k, n, t in rows}.values())  # a page number once a key
    pages = spark.createDataFrame([(*r, "s", 0) for r in rows], "url string, page_no int, text string, piece string, part int").repartition(5)
    want = {r["url"]: r["text"] for r in text.assemble(pages, "url", "page_no").collect()}
    for span in (1, 7, 1000):
        assert {r["url"]: r["text"] for r in text.assemble_ranges(pages, "url", "page_no", span=span).collect()} == want
        for most in (0, 1, 50, 10_000):
            limited = {r["url"]: (r["text"], r["truncated"]) for r in text.assemble(pages, "url", "page_no", max_chars=most).collect()}
            got = {r["url"]: (r["text"], r["truncated"]) for r in text.assemble_ranges(pages, "url", "page_no", span=span, max_chars=most).collect()}
            assert got == limited


KINDS = [T.NullType(), T.StringType(), T.ByteType(), T.IntegerType(), T.LongType(), T.DecimalType(10, 2), T.DecimalType(20, 5), T.FloatType(), T.DoubleType(), T.DateType(), T.TimestampType(), T.BooleanType()]


def test_types_meet_in_a_lattice():
    for a in KINDS:
        assert widening.common_type([a, a]) == (a if not isinstance(a, T.FloatType) else T.FloatType())
        for b in KINDS:
            if not {type(a), type(b)} & {T.StringType, T.NullType}:
                assert widening.wider(a, b) == widening.wider(b, a)
                assert widening.common_type([a, T.StringType(), b]) == widening.common_type([b, a])
                for c in KINDS[2:]:
                    if not isinstance(widening.wider(widening.wider(a, b), c), T.StringType) and not isinstance(widening.wider(b, c), T.StringType):
                        assert widening.wider(widening.wider(a, b), c) == widening.wider(a, widening.wider(b, c))
    meets = {(2, 3): T.IntegerType(), (3, 5): T.DecimalType(21, 2), (4, 8): T.DoubleType(), (9, 10): T.TimestampType(), (9, 3): T.StringType(), (11, 3): T.StringType()}
    assert all(widening.wider(KINDS[a], KINDS[b]) == t for (a, b), t in meets.items())


def test_generations_of_other_types_are_one_table(spark):
    old = spark.createDataFrame([("1", "March 5, 2024", "7", "true"), ("2", "soon", "7.5", "perhaps"), ("3", None, None, "")], "id string, date string, n string, flag string")
    mid = spark.createDataFrame([(4, dt.date(2024, 1, 2), True, ["x"])], "id int, date date, flag boolean, tags array<string>")
    new = spark.createDataFrame([(5, dt.date(2024, 1, 3), 2**40, "y")], "id long, date date, n long, tags string")
    got = widening.union_widened([old, mid, new])
    assert got.dtypes == [("id", "bigint"), ("date", "date"), ("n", "bigint"), ("flag", "boolean"), ("tags", "array<string>"), ("unread", "map<string,string>")]
    rows = {r["id"]: r for r in got.collect()}
    assert rows[1]["date"] == dt.date(2024, 3, 5) and rows[1]["n"] == 7 and rows[1]["flag"] is True and rows[1]["unread"] is None
    assert rows[2]["unread"] == {"date": "soon", "n": "7.5", "flag": "perhaps"} and rows[2]["date"] is None
    assert rows[3]["unread"] == {"flag": ""} and rows[5]["n"] == 2**40 and rows[4]["tags"] == ["x"] and rows[5]["unread"] == {"tags": "y"}
    with pytest.raises(ValueError, match="unread"):
        widening.union_widened([old.withColumn("Unread", F.lit(1))])

import datetime as dt

from pyspark.sql import functions as F

from noticeflow import schemas
from noticeflow.operators import compare
from noticeflow.sources import html, reports, snapshots
from noticeflow.streaming import master as streaming


def pages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")


TABLE = """<table><thead><tr><th>h</th></tr></thead><tbody>
<tr><td> 03/28/2025 <td>N/A<td>x<td>90 FR 1<td>Title <b>one</b><td><a name=q></a><a href="/a.pdf">pdf</a>
<tr><td>a</td><td>b</td></tr>
<tr><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td></tr></tbody></table>"""


def test_notices_from_tables(spark):
    got = html.notices_from_tables(pages(spark, TABLE, None, "<p>no table"), "src").orderBy("row_no").collect()
    assert [(r["publication_date"], r["effective_date"], r["citation"], r["title"], r["url"]) for r in got] == [
        ("03/28/2025", "N/A", "90 FR 1", "Title one", "/a.pdf"), ("1", "2", "4", "5", None)]


NEWS = """<div class="x catItemView"><h3 class=catItemTitle> Head <a href="/n1">one</a></h3><dd class=published> March 5, 2024 </dd></div>
<div class="catItemView"><p>no title</p></div>"""


def test_news_both_ways(spark):
    by_link = html.items(pages(spark, NEWS), html.NEWS_BY_LINK).collect()
    assert [(r["title"], r["href"], r["date_text"]) for r in by_link] == [("one", "/n1", "March 5, 2024"), (None, None, None)]
    by_heading = html.items(pages(spark, NEWS), html.NEWS_BY_HEADING).collect()
    assert [(r["title"], r["href"]) for r in by_heading] == [("Head one", "/n1")]


def test_sections_lists_and_paragraphs(spark):
    page = """<h2>Recent News</h2><p>x</p><div><div class=views-row><h3>Foo <b>bar</b><a href="/r"> z </a></h3><div class=views-field-created>1/2/2024</div></div>
    <div class=views-row>no h3</div></div><h2>The Industry Notices</h2><div><div class=views-row><h3>Q</h3></div></div><div class=views-row><h3>outside</h3></div>"""
    got = html.items(pages(spark, page), html.SECTIONED).orderBy("item_no").collect()
    assert [(r["section"], r["title"], r["href"], r["date_text"]) for r in got] == [
        ("Recent News", "Foobarz", "/r", "1/2/2024"), ("Industry Notices", "Q", None, None)]
    page = """<ul><li class=document-wrapper><h5><a href=/d>Doc</a></h5><time>3/4/2024</time><a href="/f.pdf">f</a><li class=document-wrapper>none</ul>"""
    row = html.items(pages(spark, page), html.LISTED).select("title", "href", "date_text", html.first_pdf_link(F.col("links")).alias("pdf")).collect()
    assert [tuple(r) for r in row] == [("Doc", "/d", "3/4/2024", "/f.pdf")]
    page = """<div class=blog><p>On 1/2/2024 <a href="/one">First link</a> <a>bare</a><p><a href=/two>Second</a></div><p><a href=/no>no</a>"""
    got = html.paragraph_links(pages(spark, page)).orderBy("p_no", "a_no").collect()
    assert [(r["p_no"], r["a_no"], r["href"], r["link_text"]) for r in got] == [(0, 0, "/one", "First link"), (0, 1, None, "bare"), (1, 0, "/two", "Second")]
    assert html.page_links(pages(spark, '<a href="x">y</a>', None)).count() == 1


def notice(spark, *rows):
    base = spark.createDataFrame(list(rows), "url string, title string, date date, flagged_keywords array<string>, flagged boolean")
    return base.withColumns({"snapshot_ts": F.lit("1"), "row_no": F.monotonically_increasing_id()})


def test_snapshots_and_csv(spark, tmp_path):
    rows = notice(spark, ("a", "N/A", dt.date(2024, 1, 2), ["Entity List"], True), (None, "t", None, [], False))
    full = spark.createDataFrame([], schemas.NOTICE).unionByName(rows.drop("snapshot_ts", "row_no"), allowMissingColumns=True)
    snapshots.write_csv(full, f"{tmp_path}/csv")
    back = snapshots.read_csv(spark, f"{tmp_path}/csv")
    assert [(r["url"], r["title"], r["flagged_keywords"]) for r in back.orderBy(F.desc_nulls_last("url")).collect()] == [("a", None, ["Entity List"]), (None, "t", [])]
    old = spark.createDataFrame([("['Entity List', 'PRC']",), ('["x"]',), (None,)], "c string").select(snapshots.text_to_list(F.col("c")).alias("c"))
    assert [r["c"] for r in old.collect()] == [["Entity List", "PRC"], ["x"], None]
    root = f"{tmp_path}/snaps"
    snapshots.write_snapshot(full, root, "2025-04-15_18-04")
    snapshots.write_snapshot(full.limit(1), root, "2025-04-15_18-45")
    snapshots.write_snapshot(full.limit(1), root, "2025-04-15_18-45")
    assert snapshots.read_snapshots(spark, root).count() == 3
    latest = snapshots.latest_snapshot(spark, root)
    assert {r["snapshot_ts"] for r in latest.collect()} == {"2025-04-15_18-45"}


def test_csv_cells_with_quotes_commas_and_line_breaks(spark, tmp_path):
    titles = ['Rule on "dual use", part 2', "two\nlines", 'ends with "', "back\\slash", "a,b;c", "  padded  "]
    rows = notice(spark, *[(f"u{i}", t, None, ['x "y"', "z,\n"], True) for i, t in enumerate(titles)]).drop("snapshot_ts", "row_no")
    full = spark.createDataFrame([], schemas.NOTICE).unionByName(rows, allowMissingColumns=True)
    snapshots.write_csv(full, f"{tmp_path}/csv")
    back = {r["url"]: (r["title"].strip(), r["flagged_keywords"]) for r in snapshots.read_csv(spark, f"{tmp_path}/csv").collect()}
    assert back == {f"u{i}": (t.strip(), ['x "y"', "z,\n"]) for i, t in enumerate(titles)}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/snapshot_1.csv").write_text('source,url,title\ns,u,"Rule on ""dual use"", part 2"\ns,v,"two\nlines"\n')
    for got in (snapshots.latest_csv(spark, f"{tmp_path}/in", schema=schemas.T.StructType([schemas.NOTICE[c] for c in ("source", "url", "title")])),
                snapshots.read_csv_drift(spark, [f"{tmp_path}/in/snapshot_1.csv"])):
        assert {(r["url"], r["title"]) for r in got.collect()} == {("u", 'Rule on "dual use", part 2'), ("v", "two\nlines")}


def test_deep_nesting(spark):
    deep = pages(spark, "<div>" * 5000 + '<p><a href="/x.pdf">t</a>')
    assert html.items(deep, html.Items(("p", None), ("a", None), title_is_link=True)).first()["href"] == "/x.pdf"


def test_latest_csv_and_drift(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/snapshot_2025-01.csv").write_text("source,url\ns,old\n")
    (tmp_path / "in/snapshot_2025-02.csv").write_text("source,url\ns,new\ns,\n")
    (tmp_path / "in/zzz.csv").write_text("source,url\ns,other\n")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("url", T.StringType())])
    assert {r["url"] for r in snapshots.latest_csv(spark, f"{tmp_path}/in", schema=schema).collect()} == {"new", None}
    (tmp_path / "gen3.csv").write_text("source,url,date,flagged_keywords\ns,u,2025-03-28,\"['PRC']\"\n")
    got = snapshots.read_csv_drift(spark, [f"{tmp_path}/in/snapshot_2025-01.csv", f"{tmp_path}/gen3.csv"])
    assert got.columns == schemas.NOTICE.names
    assert {(r["url"], r["date"], tuple(r["flagged_keywords"] or ())) for r in got.collect()} == {("old", None, ()), ("u", dt.date(2025, 3, 28), ("PRC",))}


def test_master_grows_once(spark, tmp_path):
    root = f"{tmp_path}/master"
    assert snapshots.read_master(spark, root, "2025_Q2").count() == 0
    rows = notice(spark, ("a", "1", None, None, True), ("a", "2", None, None, True), ("b", "3", None, None, False), ("", "4", None, None, False))
    for _ in range(2):
        snapshots.append_to_master(spark, root, rows, "2025_Q2")
    got = snapshots.read_master(spark, root, "2025_Q2")
    assert sorted((r["url"] or "", r["title"]) for r in got.collect()) == [("", "4"), ("a", "1"), ("b", "3")]
    snapshots.append_to_master(spark, root, rows.limit(1), "2025_Q3")
    assert snapshots.read_master(spark, root).count() == 4


def test_report_is_written(spark, tmp_path):
    rows = notice(spark, ("a", "1", None, ["PRC"], True)).withColumns({"publication_date": F.lit("1/1"), "eccn_count": F.lit(2)})
    reports.write_report(rows, f"{tmp_path}/r", rows)
    reports.write_report(rows, f"{tmp_path}/c", rows, csv=True)
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/r/code_summary").collect()] == [("1/1", 2)]
    assert spark.read.option("header", True).csv(f"{tmp_path}/c/all_entries").count() == 1


def test_stream_merges_each_drop_once(spark, tmp_path):
    drops, root = tmp_path / "drops", f"{tmp_path}/m"
    drops.mkdir()
    head = ",".join(schemas.SNAPSHOT_CSV.names)
    line = lambda url, title: "s,,,,{},{},,,,,,,\"['PRC']\",true".format(title, url)
    (drops / "d1.csv").write_text("\n".join([head, line("u1", "first"), line("u1", "again"), line("", "none")]) + "\n")
    run = lambda cp: streaming.maintain_master(spark, str(drops), root, f"{tmp_path}/{cp}", "2025_Q2").awaitTermination()
    run("cp")
    (drops / "d2.csv").write_text("\n".join([head, line("u1", "late"), line("u2", "second")]) + "\n")
    run("cp")
    want = [("", "none"), ("u1", "first"), ("u2", "second")]
    state = lambda: sorted((r["url"] or "", r["title"]) for r in snapshots.read_master(spark, root).collect())
    assert state() == want
    run("other")  # a full replay
    assert state() == want


def test_first_drop_wins_whatever_the_batches(spark, tmp_path):
    """Six drops with one url, whose names are in no order, in one batch and in many."""
    import os

    drops = tmp_path / "drops"
    drops.mkdir()
    head = ",".join(schemas.SNAPSHOT_CSV.names)
    for k, name in enumerate(("q", "c", "z", "a", "m", "b")):
        (drops / f"{name}.csv").write_text(f'{head}\ns,,,,title {k},u,,,,,,,"[]",true\ns,,,,own {k},u{k},,,,,,,"[]",true\ns,,,,again {k},u{k},,,,,,,"[]",true\n')
        os.utime(drops / f"{name}.csv", (1_700_000_000 + k, 1_700_000_000 + k))
    want = [("u", "title 0"), *[(f"u{k}", f"own {k}") for k in range(6)]]
    for files in (None, 1, 4):
        root = f"{tmp_path}/m{files}"
        streaming.maintain_master(spark, str(drops), root, f"{tmp_path}/cp{files}", "2025_Q2", max_files=files).awaitTermination()
        assert sorted((r["url"], r["title"]) for r in snapshots.read_master(spark, root).collect()) == want
    same = tmp_path / "same"  # of one time: by path
    same.mkdir()
    for name in ("b", "a"):
        (same / f"{name}.csv").write_text(f'{head}\ns,,,,{name},u,,,,,,,"[]",true\n')
        os.utime(same / f"{name}.csv", (1_700_000_000, 1_700_000_000))
    streaming.maintain_master(spark, str(same), f"{tmp_path}/s", f"{tmp_path}/cps", "2025_Q2").awaitTermination()
    assert [r["title"] for r in snapshots.read_master(spark, f"{tmp_path}/s").collect()] == ["a"]


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    from pathlib import Path

    root = f"{tmp_path}/m"
    rows = notice(spark, ("a", "1", None, None, True), ("b", "2", None, None, True), (None, "3", None, None, False), (None, "3", None, None, False)).repartition(4)
    append = lambda part, name: snapshots.append_to_master(spark, root, part, "2025_Q2", keep_keyless=True, batch=name)
    state = lambda: sorted((r["url"] or "", r["title"], r["batch"]) for r in snapshots.read_master(spark, root, batch=True).collect())
    append(rows, "s-1")
    once = state()
    assert once == [("", "3", "s-1"), ("", "3", "s-1"), ("a", "1", "s-1"), ("b", "2", "s-1")]
    append(rows, "s-1")
    assert state() == once
    next(Path(root).rglob("part-*.parquet")).unlink()  # a batch of which a part was written
    assert state() != once
    append(rows, "s-1")
    assert state() == once
    append(rows.where("url is not null"), "s-2")
    assert state() == once and snapshots.read_master(spark, root).columns[-1] == "quarter"
    assert streaming.batch_name("cp", 3) == streaming.batch_name("cp", 3) != streaming.batch_name("other", 3)


def test_runs_of_a_stream_by_event_time(spark, tmp_path):
    row = lambda key, minute: (key, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute) if minute is not None else None)
    parts = [
        [row("a", 0), row("a", 9), row("b", 3), row("a", None), row(None, 5)],
        [row("a", 18), row("a", 60), row("b", 70)],
        [row("c", 20), row("a", 61), row("b", 68)],  # c is older than the watermark, b's is within the allowance
        [row("z", 10_000)],
    ]
    schema = "url string, ts timestamp"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        runs = streaming.first_of_sessions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["url"], "ts", "10 minutes", "5 minutes")
        runs.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    minute = lambda t: int((t - dt.datetime(2024, 1, 1)).total_seconds() // 60)
    rows = lambda df: sorted(((r["url"] or "", minute(r["first_seen"]), minute(r["last_seen"]), r["n"]) for r in df.collect()))
    got = rows(spark.read.schema(runs.schema).parquet(f"{tmp_path}/out"))
    assert got == [("", 5, 5, 1), ("a", 0, 18, 3), ("a", 60, 61, 2), ("b", 3, 3, 1), ("b", 68, 70, 2)]
    whole = rows(streaming.first_of_sessions(spark.createDataFrame([r for p in parts for r in p], schema), ["url"], "ts", "10 minutes"))
    assert [r for r in whole if r[0] not in ("c", "z")] == got
    exact = spark.createDataFrame([row("a", 0), row("a", 10)], schema)  # a pause of just the gap
    assert rows(streaming.first_of_sessions(exact, ["url"], "ts", "10 minutes")) == [("a", 0, 10, 2)]


def test_first_seen(spark, tmp_path):
    src = tmp_path / "s"
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 02:00:00")], "url string, ts string")
    df.selectExpr("url", "cast(ts as timestamp_ntz) ts").coalesce(1).write.parquet(str(src))
    for k, event in enumerate((None, "ts")):
        stream = spark.readStream.schema("url string, ts timestamp_ntz").parquet(str(src))
        q = streaming.first_seen(stream, "url", event).writeStream.format("memory").queryName(f"seen{k}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(r["url"] for r in spark.table(f"seen{k}").collect()) == ["a", "b"]
    assert compare.unchanged(df, df)


def test_extractors_put_rows_out_in_small_parts():
    import pyarrow as pa

    page = "<table>" + "<tr><td>a<td>b" * 1000 + "</table>"
    batch = pa.RecordBatch.from_pydict({"page_id": pa.array(range(50), pa.int64()), "html": pa.array([page, None] * 25)})
    schema = pa.schema([("page_id", pa.int64()), ("row_no", pa.int32()), ("cells", pa.list_(pa.string())), ("links", pa.list_(pa.string()))])
    sizes = [b.num_rows for b in html._rows(iter([batch]), html._table_rows, schema)]
    assert sum(sizes) == 25_000 and max(sizes) <= html.ROWS
    long = pa.RecordBatch.from_pydict({"page_id": pa.array(range(8), pa.int64()), "html": pa.array(["<table><tr><td>" + "x" * (html.CHARS // 2)] * 8)})
    assert max(b.num_rows for b in html._rows(iter([long]), html._table_rows, schema)) <= 3

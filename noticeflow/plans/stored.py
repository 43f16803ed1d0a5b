"""Registered queries of sources, sinks, streams and whole runs: written to the shared folder from the given tables, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow import schemas
from noticeflow.functions import dates, text, urls
from noticeflow.operators import compare, documents, merge, reporting
from noticeflow.plans import views
from noticeflow.sources import bucketed, html, quarantine, records, reports, snapshots
from noticeflow.streaming import master as streaming

QUARTER = "1998_Q1"
FLAGS = ("urgent", "5b1")
#: Titles as CSV has to bear them: quotes, commas and a line break.
_TITLE = {0: "concat('On \"', title, '\", part 2')", 1: "concat('A', {nl}, title)", 2: "title", 3: "'N/A'"}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))  # one machine, as in tests
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/noticeflow/{name}-{uuid.uuid4().hex}"


def _titled(newline: str) -> str:
    return "CASE notice_id % 4 " + " ".join(f"WHEN {k} THEN {v.format(nl=newline)}" for k, v in _TITLE.items()) + " END"


def _notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notices in the schema of a snapshot."""
    n = views.notices(spark, sf_dir).withColumn("date", F.col("true_date"))
    n = text.flag_keywords(text.with_codes(n, "title"), "title", FLAGS).drop("eccns")
    return spark.createDataFrame([], schemas.NOTICE).unionByName(n.drop("notice_id", "true_date", "o_totalprice"), allowMissingColumns=True)


_CELLS = ("source", "url", "title", "date", "eccns_found", "flagged")


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices with quotes, commas, line breaks, missing values and lists, through CSV."""
    n = views.notices(spark, sf_dir).withColumn("title", F.expr(_titled("'\n'")))
    n = text.flag_keywords(n.withColumn("date", F.col("true_date")), "title", FLAGS)
    rows = spark.createDataFrame([], schemas.NOTICE).unionByName(n.drop("notice_id", "true_date", "o_totalprice"), allowMissingColumns=True)
    path = folder(spark, "csv")
    snapshots.write_csv(rows, path)
    return snapshots.read_csv(spark, path).select("source", "url", "title", "date", text.joined(F.col("flagged_keywords")).alias("keywords"), "flagged")


def csv_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV of two generations, the older without some columns, as one table."""
    rows, path = _notices(spark, sf_dir), folder(spark, "generations")
    snapshots.write_csv(rows.where(F.col("date") < "1998-01-01").select("source", "url", "title"), f"{path}/old")
    snapshots.write_csv(rows.where(F.col("date") >= "1998-01-01"), f"{path}/new")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(path).select("path")
    return snapshots.read_csv_drift(spark, [r["path"] for r in files.collect()]).select(*_CELLS)  # names of files


def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three snapshots are written, one of them twice; the latest is read."""
    rows, root = _notices(spark, sf_dir), folder(spark, "snapshots")
    snapshots.write_snapshot(rows.where(F.col("date") < "1995-01-01"), root, "2025-04-15_18-04")
    for _ in range(2):
        snapshots.write_snapshot(rows.where(F.col("date") >= "1995-01-01"), root, "2025-04-15_18-45")
    snapshots.write_snapshot(rows, root, "2025-04-14_23-59")
    return snapshots.latest_snapshot(spark, root).select(*_CELLS, "snapshot_ts")


#: What ranks a url's rows within a snapshot. The SQL's order ends with the date; the source makes it total, as the other cells follow from the title.
_ORDER = ("title", "date", "source")


def _ranked(rows: DataFrame, ts: str) -> DataFrame:
    return rows.withColumns({"snapshot_ts": F.lit(ts), "row_no": F.struct(*_ORDER)})


def master_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A master that starts empty and gets two overlapping snapshots, the second one twice."""
    rows, root = _notices(spark, sf_dir), folder(spark, "master")
    old, new = rows.where("date < date '1999-01-01'"), rows.where("date >= date '1998-01-01'")
    for ts, part in (("1", old), ("2", new), ("2", new)):
        snapshots.append_to_master(spark, root, _ranked(part, ts), QUARTER)
    return snapshots.read_master(spark, root, QUARTER).select(*_CELLS, "quarter")


def stream_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream over CSV drops of many files, the second of which comes later; then all of it again from the start, to which the master has every url."""
    rows, root = _notices(spark, sf_dir), folder(spark, "stream")
    for k, part in enumerate(("date < date '1999-01-01'", "date >= date '1998-01-01'")):
        snapshots.write_csv(rows.where(part).repartition("url").sortWithinPartitions("url", *_ORDER), f"{root}/drops/{k}")
        streaming.maintain_master(spark, f"{root}/drops/*", f"{root}/master", f"{root}/first", QUARTER).awaitTermination()
    streaming.maintain_master(spark, f"{root}/drops/*", f"{root}/master", f"{root}/again", QUARTER).awaitTermination()
    return snapshots.read_master(spark, f"{root}/master").select(*_CELLS, "quarter")


#: Hours that a user's events of a type may pause within a run.
GAP = 72


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each user's events of a type, from a stream that gets the events in four parts, and then one long after all, which lets every run end."""
    root = folder(spark, "sessions")
    events = views.table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    cuts = events.agg(F.percentile_approx("ts", [0.25, 0.5, 0.75]).alias("cuts"), F.max("ts").alias("last")).first()
    at = F.lit(0)
    for cut in cuts["cuts"] or []:
        at = at + (F.col("ts") > F.lit(cut)).cast("int")
    end = spark.range(1).select(F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("event_type"), (F.lit(cuts["last"]) + F.expr("INTERVAL 1000 DAYS")).alias("ts"))
    for part in (*[events.where(at == k) for k in range(4)], end):
        part.write.mode("append").parquet(f"{root}/events")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/events")
        runs = streaming.first_of_sessions(stream, ["user_id", "event_type"], "ts", f"{GAP} hours", "1 hour")
        query = runs.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp")
        query.trigger(availableNow=True).start().awaitTermination()
    # left out here, as a filter in the stream would keep the last event from the watermark
    found = spark.read.schema(runs.schema).parquet(f"{root}/out").where("user_id is not null")
    return found.select("user_id", "event_type", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "n")


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and type of events, once each, from a stream."""
    events, root = views.table(spark, sf_dir, "events").select("user_id", "event_type"), folder(spark, "seen")
    events.write.parquet(f"{root}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{root}/events")
    keyed = stream.withColumn("url", F.concat_ws("/", "user_id", "event_type"))
    query = streaming.first_seen(keyed).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, event_type string, url string").parquet(f"{root}/out")


def report_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of a written report's tables, as (name, a, b, n)."""
    rows, root = _notices(spark, sf_dir), folder(spark, "report")
    reports.write_report(rows, root, rows.where("date >= date '1998-01-01'"))
    shown = {
        "all_entries": ("url", "title", "eccn_count"), "flagged_only": ("url", "eccns_found", "eccn_count"), "pdf_summary": ("url", "title", None),
        "code_summary": ("publication_date", None, "total_eccns"),
    }
    cell = lambda c, kind: (F.col(c) if c else F.lit(None)).cast(kind)
    return merge.union_all([
        spark.read.parquet(f"{root}/{name}").select(F.lit(name).alias("name"), cell(a, "string").alias("a"), cell(b, "string").alias("b"), cell(n, "long").alias("n"))
        for name, (a, b, n) in shown.items()
    ])


#: Notices on a page that queries make of them.
PER_PAGE = 100


def _pages_of(spark: SparkSession, sf_dir: str, item, before: str, after: str, where: str = "true", join: str = "\n") -> DataFrame:
    """(page_id, html): pages of PER_PAGE notices in order of id, of those that ``where`` keeps."""
    rows = views.notices(spark, sf_dir).where(where).withColumns({"page_id": F.expr(f"notice_id div {PER_PAGE}"), "item": item})
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("notice_id", "item"))), lambda s: s["item"]), join)
    return rows.groupBy("page_id").agg(F.concat(F.lit(before), listed, F.lit(after)).alias("html"))


def _tables_of_html(spark: SparkSession, sf_dir: str, short: bool = False) -> DataFrame:
    """Pages with a table of notices; ``short`` leaves each tenth row without its last cells."""
    cell = lambda c: F.concat(F.lit("<td> "), F.coalesce(F.col(c), F.lit("")), F.lit(" "))
    link = F.when(F.col("url").isNotNull(), F.concat(F.lit('<td><a href="'), "url", F.lit('">pdf</a>'))).otherwise("<td>")
    row = F.concat(F.lit("<tr>"), cell("publication_date"), F.lit("<td>N/A</td><td>x</td>"), cell("source"), cell("title"), link)
    if short:
        row = F.when(F.col("notice_id") % 10 == 0, F.concat(F.lit("<tr>"), cell("publication_date"), F.lit("<td>N/A</td><td>x</td>"), cell("source"))).otherwise(row)
    return _pages_of(spark, sf_dir, row, "<table><tbody>", "</table>")


def table_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.notices_from_tables(_tables_of_html(spark, sf_dir), "src")
    return found.select("page_id", "row_no", "publication_date", "citation", "title", "url")


def table_short_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where rows of four cells have to go."""
    found = html.notices_from_tables(_tables_of_html(spark, sf_dir, short=True), "src")
    return found.select("page_id", "row_no", "publication_date", "citation", "title", "url")


BASE = "https://www.example.org"
_HREF = "coalesce(url, concat('/n/', cast(notice_id AS {text})))"


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of paragraphs as rule rows: short links left out, addresses made whole, dates from the paragraph or an earlier link."""
    date = F.when(F.col("notice_id") % 3 == 0, F.concat(F.lit("On "), F.date_format("true_date", "MM/dd/yyyy"), F.lit(": "))).otherwise("")
    name = F.when(F.col("notice_id") % 10 == 0, "abc").otherwise(F.col("title"))
    later = F.when(F.col("notice_id") % 4 == 0, F.concat(F.lit('<a href="/later/'), F.col("notice_id").cast("string"), F.lit('">as amended</a>'))).otherwise("")
    item = F.concat(F.lit("<p>"), date, F.lit('<a href="'), F.expr(_HREF.format(text="string")), F.lit('">'), name, F.lit("</a>"), later, F.lit("</p>"))
    links = html.paragraph_links(_pages_of(spark, sf_dir, item, "<div class='blog'>", "</div><p><a href='/outside'>outside of it</a>"))
    dated = reporting.carry_forward_dates(reporting.long_enough(links), ["page_id", "p_no"], "a_no")
    return dated.select("page_id", "p_no", "a_no", F.col("link_text").alias("title"), urls.absolute(F.col("href"), BASE, "not_http").alias("url"), "date_text")


def paragraph_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir).withColumn("urgent", text.topic_flag(F.col("title"), ("URGENT", "NOT SPECIFIED")))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of two sections of a page; each seventh block lacks its title and has to go."""
    title = F.when(F.col("notice_id") % 7 == 0, F.lit("<b>no title</b>")).otherwise(F.concat(F.lit("<h3>"), F.col("title"), F.lit('<a href="'), F.expr(_HREF.format(text="string")), F.lit('"></a></h3>')))
    item = F.concat(F.lit("<div class='views-row'>"), title, F.lit("<div class='views-field-created'> "), F.col("publication_date"), F.lit("</div></div>"))
    half = lambda k, name: _pages_of(spark, sf_dir, item, f"<h2>{name}</h2><p>x</p><div>", "</div>", f"notice_id % 2 = {k}")
    both = half(0, "All Recent News").unionByName(half(1, "Industry Notices")).groupBy("page_id").agg(F.array_join(F.sort_array(F.collect_list("html")), "").alias("html"))
    return html.items(both, html.SECTIONED).select("page_id", "section", "item_no", "title", "href", "date_text")


def section_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir)


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a list of documents with the link to each one's file."""
    item = F.concat(F.lit("<li class='document-wrapper'><h5>"), F.col("title"), F.lit("</h5><time>"), F.date_format("true_date", "MM/dd/yyyy"), F.lit('</time><a href="/x">y</a><a href="/f/'), F.col("notice_id").cast("string"), F.lit('.pdf">pdf</a></li>'))
    found = html.items(_pages_of(spark, sf_dir, item, "<ul>", "</ul>"), html.LISTED)
    return found.select("page_id", "item_no", "title", html.first_pdf_link(F.col("links")).alias("href"), "date_text")


def document_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir)


def multi_source_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over four sources: their extractors, one table, dates, flags, a sorted snapshot, and counts by source, one without rows among them."""
    root = folder(spark, "sources")
    url = lambda c, mode: urls.absolute(F.col(c), BASE, mode).alias("url")
    parts = {
        "register": html.notices_from_tables(_tables_of_html(spark, sf_dir, short=True), "register").select("title", url("url", "relative"), F.col("publication_date").alias("date_text"), "citation"),
        "rules": _rules(spark, sf_dir).select("title", "url", "date_text"),
        "updates": _sections(spark, sf_dir).select("title", url("href", "relative"), "date_text"),
        "library": _listed(spark, sf_dir).select("title", url("href", "always"), "date_text"),
    }
    rows = merge.union_all([df.withColumn("source", F.lit(name)) for name, df in parts.items()])
    rows = rows.withColumn("date", dates.parse_date(F.col("date_text")))
    rows = text.flag_keywords(rows, "title", FLAGS).withColumn("is_ear_related", text.topic_flag(F.col("title"), ("URGENT", "NOT SPECIFIED")))
    rows = rows.drop("date_text")
    rows.write.parquet(f"{root}/rows")  # pages are parsed once, though a sort by ranges reads its rows twice
    rows = spark.read.schema(rows.schema).parquet(f"{root}/rows")
    snapshots.write_sorted(rows, f"{root}/snapshots", "2025-04-15_18-04", files=8)
    last = spark.read.schema(rows.schema).parquet(f"{root}/snapshots/snapshot_ts=2025-04-15_18-04")
    known = spark.createDataFrame([(name,) for name in (*parts, "closed")], "source string")
    counts = last.groupBy("source").agg(F.count("date").alias("dated"), F.count("url").alias("with_url"), F.count("citation").alias("cited"), F.count_if("flagged").alias("flagged"), F.count_if("is_ear_related").alias("ear"))
    return reporting.source_counts(last, known).join(counts, "source", "left").na.fill(0)


def bucketed_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As master_append, in a master by buckets."""
    rows, root = _notices(spark, sf_dir), folder(spark, "bucketed")
    old, new = rows.where("date < date '1999-01-01'"), rows.where("date >= date '1998-01-01'")
    master = bucketed.BucketedMaster(spark, root, buckets=8)
    try:
        for ts, part in (("1", old), ("2", new), ("2", new)):
            master.append(_ranked(part, ts), QUARTER, batch=ts)
    finally:
        master.detach()
    return snapshots.read_master(spark, root, QUARTER).select(*_CELLS, "quarter")


_RECORD = {
    0: """concat('{{"notice_id": ', {id}, ', "url": "u', {id}, '", "total": ', {price}, '}}')""",
    1: """concat('{{"notice_id": "', {id}, '", "total": "n/a"}}')""",
    2: """concat('{{"notice_id": ', {id}, ', "tags": ["a", ', {id}, '], "url": null, "total": 7}}')""",
    3: """concat('{{"notice_id": ', {id}, ', "url"')""",
    4: """concat('{{"notice_id": ', {id}, '.5, "urgent": true}}')""",
}
_RECORDS = "CASE notice_id % 5 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _RECORD.items()) + " END"


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of different fields and types, some of them torn, from text files."""
    path = folder(spark, "records")
    one = F.expr(_RECORDS.format(id="cast(notice_id AS string)", price="cast(notice_id % 1000 AS string)"))
    views.notices(spark, sf_dir).select(one.alias("value")).write.text(path)
    schema = "notice_id long, url string, total double, urgent boolean"
    return records.read_records(spark.read.text(path), schemas.T.StructType.fromDDL(schema))


def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of those records, their types and how often each is there."""
    one = F.expr(_RECORDS.format(id="cast(notice_id AS string)", price="cast(notice_id % 1000 AS string)"))
    return records.fields_of(views.notices(spark, sf_dir).select(one.alias("value"))).groupBy("field").agg(F.sum("n").alias("n"))


def quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices in two sinks: good ones, and those that break a rule with all their reasons."""
    root = folder(spark, "quarantine")
    n = views.notices(spark, sf_dir).select("notice_id", "url", "title", "true_date")
    rules = {"no_url": F.col("url").isNull(), "not_pdf": ~urls.is_pdf_url(F.col("url")), "too_old": F.col("true_date") < "1993-01-01", "too_long": F.length("title") > 60}
    quarantine.write_split(n, root, rules)
    good = quarantine.read_split(spark, root, n.schema, quarantine.GOOD).select("notice_id", F.lit(None).cast("string").alias("reason"), F.lit("").alias("reasons"))
    rejected = quarantine.read_split(spark, root, n.schema, quarantine.REJECTED).select("notice_id", "reason", text.joined(F.col("reasons")).alias("reasons"))
    return good.unionByName(rejected)


def observed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a run and column widths, as the write of its snapshot found them."""
    n = _notices(spark, sf_dir).withColumn("pdf_downloaded", urls.is_pdf_url(F.col("url")))
    found = snapshots.write_observed(n, folder(spark, "observed"), "2025-04-15_18-04", ("url", "title"))
    return spark.createDataFrame([found], ", ".join(f"{k} long" for k in found))


def sorted_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two years of a snapshot that lies sorted by date; undated rows stay in it."""
    root = folder(spark, "sorted")
    rows = _notices(spark, sf_dir).withColumn("date", F.when(F.col("url").isNotNull(), F.col("date")))
    snapshots.write_sorted(rows, root, "1", files=12)
    whole = snapshots.read_snapshots(spark, root)
    return whole.where("date between date '1994-01-01' and date '1995-12-31' or date is null").select(*_CELLS)


def article_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's article by its heading: title with white space as it is, and its link, which these headings lack."""
    spec = html.Items(("article", None), ("h1", None))
    return html.items(views.table(spark, sf_dir, "pages").select("page_id", "html"), spec).select("page_id", "item_no", "title", "href")


def menu_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each page's menu with their texts and links."""
    spec = html.Items(("li", None), ("a", None), title_is_link=True, packed=True)
    return html.items(views.table(spark, sf_dir, "pages").select("page_id", "html"), spec).select("page_id", "item_no", "title", "href", F.size("links").alias("n_links"))


def current_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run: tables of pages to dated, flagged and coded notices, compared with the last snapshot, written, merged and reported."""
    root = folder(spark, "run")
    found = html.notices_from_tables(_tables_of_html(spark, sf_dir), "src").withColumn("url", urls.absolute(F.col("url"), "https://www.example.org", "relative"))
    found = found.withColumn("date", dates.parse_date(F.col("publication_date")))
    found.write.parquet(f"{root}/found")  # pages are parsed once, though the documents and the notices with and without a url all read the rows
    found = spark.read.schema(found.schema).parquet(f"{root}/found")
    facts = text.with_codes(text.assemble(found.where(urls.is_pdf_url(F.col("url"))).withColumn("page_no", F.struct("page_id", "row_no")), "url", "page_no", "title", "text"), "text")
    rows = text.flag_keywords(documents.enrich(documents.with_defaults(found, "src"), facts), "title", FLAGS)
    rows = spark.createDataFrame([], schemas.NOTICE).unionByName(rows.drop("page_id", "row_no"), allowMissingColumns=True)
    rows.write.parquet(f"{root}/rows")  # and documents are joined once, though the comparison, the snapshot, the master and the reports all read the rows
    rows = spark.read.schema(schemas.NOTICE).parquet(f"{root}/rows")
    before = rows.where("date < date '1998-01-01'")
    snapshots.write_snapshot(before, root + "/snapshots", "1")
    snapshots.append_to_master(spark, f"{root}/master", _ranked(before, "1"), QUARTER)
    last = snapshots.latest_snapshot(spark, f"{root}/snapshots").drop("snapshot_ts")
    if not compare.unchanged(last, rows):  # an unchanged run ends here
        snapshots.write_snapshot(rows, f"{root}/snapshots", "2")
        snapshots.append_to_master(spark, f"{root}/master", _ranked(rows, "2"), QUARTER)
    master = snapshots.read_master(spark, f"{root}/master", QUARTER)
    reports.write_report(master, f"{root}/report", rows)
    return spark.read.parquet(f"{root}/report/all_entries").select("url", "eccn_count", "eccns_found", "contains_eccn", "source")


QUERIES = {f.__name__: f for f in (
    csv_round_trip, csv_generations, snapshot_latest, master_append, stream_master, stream_sessions, stream_first_seen, report_contents, table_notices, table_short_rows, paragraph_rules, section_items, document_list, multi_source_run,
    bucketed_master, json_records, record_fields, quarantine_split, observed_summary, sorted_snapshot, article_items, menu_items, current_run,
)}

_CODES = f"list_sort(list_distinct(regexp_extract_all(title, '(?i){text.CODE}')))"
_HITS = "list_filter(['urgent', '5b1'], lambda k: contains(lower(coalesce(title, '')), k))"
_ROWS = f"(SELECT *, true_date AS date, array_to_string({_CODES}, ', ') AS eccns_found, len({_CODES})::BIGINT AS eccn_count, len({_HITS}) > 0 AS flagged FROM notices_v)"
_READ = "source, url, nullif(title, '') AS title, date, nullif(eccns_found, '') AS eccns_found, flagged"
_MASTER = f"""(SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts, title, date) AS r FROM
  (SELECT *, 1 AS ts FROM {_ROWS} WHERE date < DATE '1999-01-01' UNION ALL SELECT *, 2 FROM {_ROWS} WHERE date >= DATE '1998-01-01'))"""
_TABLES = f"(SELECT *, notice_id // {PER_PAGE} AS page_id, (row_number() OVER (PARTITION BY notice_id // {PER_PAGE} ORDER BY notice_id) - 1)::INTEGER AS row_no FROM notices_v)"
_IS_PDF = r"coalesce(regexp_matches(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') AND ends_with(lower(url), '.pdf'), false)"
_WHOLE = f"(SELECT *, {_HREF.format(text='varchar')} AS href FROM notices_v)"
_MADE_WHOLE = f"CASE WHEN starts_with(href, 'http') THEN href ELSE '{BASE}' || href END"
_RULE_DATE = "CASE WHEN notice_id % 3 = 0 THEN strftime(true_date, '%m/%d/%Y') END"
#: Rule rows: the link of each notice, and of each fourth a second one; page_id, place of its paragraph and of the link in it.
_RULES = f"""(SELECT *, notice_id // {PER_PAGE} AS page_id, (row_number() OVER (PARTITION BY notice_id // {PER_PAGE} ORDER BY notice_id) - 1)::INTEGER AS p_no FROM {_WHOLE})"""
_RULE_ROWS = f"""(SELECT page_id, p_no, 0::INTEGER AS a_no, title, {_MADE_WHOLE} AS url, {_RULE_DATE} AS date_text FROM {_RULES} WHERE notice_id % 10 <> 0
  UNION ALL SELECT page_id, p_no, 1, 'as amended', '{BASE}/later/' || notice_id, {_RULE_DATE} FROM {_RULES} WHERE notice_id % 4 = 0)"""
_URGENT = "(contains(title, 'URGENT') OR contains(title, 'NOT SPECIFIED'))"
_ITEMS = f"""(SELECT *, notice_id // {PER_PAGE} AS page_id, CASE WHEN notice_id % 2 = 0 THEN 'Recent News' ELSE 'Industry Notices' END AS section,
  (row_number() OVER (PARTITION BY notice_id // {PER_PAGE} ORDER BY notice_id % 2, notice_id) - 1)::INTEGER AS item_no FROM {_WHOLE} WHERE notice_id % 7 <> 0)"""
_ALL = f"(SELECT unnest(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', 1)) AS href, unnest(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', 2)) AS title, unnest(range(len(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', 1))))::INTEGER AS item_no, page_id FROM pages)"

_SQL = {
    "csv_round_trip": f"""SELECT source, url, nullif(title, 'N/A') AS title, true_date AS date, array_to_string({_HITS}, ', ') AS keywords, len({_HITS}) > 0 AS flagged
      FROM (SELECT notice_id, source, url, true_date, {_titled("chr(10)")} AS title FROM notices_v)""",
    "csv_generations": f"""SELECT source, url, title, CASE WHEN date >= DATE '1998-01-01' THEN date END AS date,
      CASE WHEN date >= DATE '1998-01-01' THEN nullif(eccns_found, '') END AS eccns_found, CASE WHEN date >= DATE '1998-01-01' THEN flagged END AS flagged FROM {_ROWS}""",
    "snapshot_latest": f"SELECT source, url, title, date, eccns_found, flagged, '2025-04-15_18-45' AS snapshot_ts FROM {_ROWS} WHERE date >= DATE '1995-01-01'",
    "master_append": f"SELECT source, url, title, date, eccns_found, flagged, '{QUARTER}' AS quarter FROM {_MASTER} WHERE r = 1",
    "stream_master": f"SELECT source, url, nullif(title, '') AS title, date, nullif(eccns_found, '') AS eccns_found, flagged, '{QUARTER}' AS quarter FROM {_MASTER} WHERE r = 1",
    "stream_sessions": f"""SELECT user_id, event_type, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM
      (SELECT *, sum(start::INTEGER) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM
        (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > INTERVAL {GAP} HOUR, true) AS start FROM events))
      GROUP BY user_id, event_type, run""",
    "stream_first_seen": "SELECT DISTINCT user_id, event_type, user_id::VARCHAR || '/' || event_type AS url FROM events",
    "report_contents": f"""SELECT 'all_entries' AS name, url AS a, title AS b, eccn_count AS n FROM {_ROWS} UNION ALL SELECT 'flagged_only', url, eccns_found, eccn_count FROM {_ROWS} WHERE flagged
      UNION ALL SELECT 'pdf_summary', url, title, NULL FROM {_ROWS}
      UNION ALL SELECT 'code_summary', publication_date, NULL, sum(eccn_count)::BIGINT FROM {_ROWS} WHERE date >= DATE '1998-01-01' GROUP BY publication_date""",
    "table_short_rows": f"SELECT page_id, row_no, publication_date, source AS citation, title, url FROM {_TABLES} WHERE notice_id % 10 <> 0",
    "paragraph_rules": f"SELECT *, {_URGENT} AS urgent FROM {_RULE_ROWS}",
    "section_items": f"SELECT page_id, section, item_no, title, href, publication_date AS date_text FROM {_ITEMS}",
    "document_list": f"SELECT page_id, row_no AS item_no, title, '/f/' || notice_id || '.pdf' AS href, strftime(true_date, '%m/%d/%Y') AS date_text FROM {_TABLES}",
    "multi_source_run": f"""SELECT s.source, count(r.source) AS n, count(dated) FILTER (dated) AS dated, count(r.url) AS with_url, count(cited) FILTER (cited) AS cited,
      count(*) FILTER (len({_HITS}) > 0) AS flagged, count(*) FILTER ({_URGENT}) AS ear FROM (SELECT unnest(['register', 'rules', 'updates', 'library', 'closed']) AS source) s LEFT JOIN
      (SELECT 'register' AS source, title, url, true AS dated, true AS cited FROM notices_v WHERE notice_id % 10 <> 0 UNION ALL
       SELECT 'rules', title, url, date_text IS NOT NULL, false FROM {_RULE_ROWS} UNION ALL SELECT 'updates', title, href, true, false FROM {_ITEMS} UNION ALL
       SELECT 'library', title, '/f', true, false FROM notices_v) r ON s.source = r.source GROUP BY s.source""",
    "bucketed_master": f"SELECT source, url, title, date, eccns_found, flagged, '{QUARTER}' AS quarter FROM {_MASTER} WHERE r = 1",
    "json_records": """SELECT CASE WHEN k < 3 THEN notice_id END AS notice_id, CASE WHEN k = 0 THEN 'u' || notice_id END AS url, CASE k WHEN 0 THEN notice_id % 1000 WHEN 2 THEN 7 END::DOUBLE AS total,
      CASE WHEN k = 4 THEN true END AS urgent, CASE k WHEN 1 THEN '{"total":"n/a"}' WHEN 2 THEN '{"tags":["a",' || notice_id || ']}' WHEN 4 THEN '{"notice_id":' || notice_id || '.5}' END AS rescued,
      CASE WHEN k = 3 THEN '{"notice_id": ' || notice_id || ', "url"' END AS corrupt FROM (SELECT notice_id, notice_id % 5 AS k FROM notices_v)""",
    "record_fields": """SELECT field, count(*) AS n FROM (SELECT unnest(CASE notice_id % 5 WHEN 0 THEN ['notice_id', 'url', 'total'] WHEN 1 THEN ['notice_id', 'total'] WHEN 2 THEN ['notice_id', 'tags', 'url', 'total']
      WHEN 4 THEN ['notice_id', 'urgent'] ELSE [] END) AS field FROM notices_v) GROUP BY field""",
    "quarantine_split": f"""SELECT notice_id, r[1] AS reason, array_to_string(r, ', ') AS reasons FROM (SELECT notice_id, list_filter([CASE WHEN url IS NULL THEN 'no_url' END,
      CASE WHEN NOT {_IS_PDF} THEN 'not_pdf' END, CASE WHEN true_date < DATE '1993-01-01' THEN 'too_old' END, CASE WHEN length(title) > 60 THEN 'too_long' END], lambda x: x IS NOT NULL) AS r FROM notices_v)""",
    "observed_summary": f"""SELECT count(*) AS rows, count(url) AS with_url, count(*) FILTER ({_IS_PDF}) AS downloaded, count(*) FILTER (len({_HITS}) > 0) AS flagged, 0::BIGINT AS ear, 0::BIGINT AS itar,
      (greatest(max(coalesce(length(url), 3)), 3) + 2)::BIGINT AS width_url, (greatest(max(coalesce(length(title), 3)), 5) + 2)::BIGINT AS width_title FROM notices_v""",
    "sorted_snapshot": f"""SELECT source, url, title, CASE WHEN url IS NOT NULL THEN date END AS date, eccns_found, flagged FROM {_ROWS}
      WHERE url IS NULL OR date BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'""",
    "table_notices": f"SELECT page_id, row_no, publication_date, source AS citation, title, url FROM {_TABLES}",
    "article_items": "SELECT page_id, 0::INTEGER AS item_no, trim(replace(replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title, NULL::VARCHAR AS href FROM pages",
    "menu_items": f"SELECT page_id, item_no, title, href, 1::INTEGER AS n_links FROM {_ALL}",
    "current_run": f"""SELECT url, coalesce(len(c), 0)::INTEGER AS eccn_count, coalesce(array_to_string(c, ', '), '') AS eccns_found, coalesce(len(c) > 0, false) AS contains_eccn, 'src' AS source
      FROM (SELECT DISTINCT url FROM notices_v) n LEFT JOIN (SELECT url AS u, {_CODES} AS c FROM
      (SELECT url, string_agg(title, '' ORDER BY page_id, row_no) AS title FROM {_TABLES} WHERE ends_with(url, '.pdf') GROUP BY url)) d ON n.url = d.u""",
}
SQL = {k: views.DUCK + v for k, v in _SQL.items()}

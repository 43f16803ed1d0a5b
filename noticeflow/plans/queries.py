"""The registered queries of the notice operators, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.functions import dates, text, urls
from noticeflow.operators import compare, documents, history, merge, reporting, widening
from noticeflow.plans import views
from noticeflow.sources import html, reports

FORMATS = "['%m/%d/%Y', '%B %d, %Y', '%Y-%m-%d', '%d %B %Y', '%B %d %Y', '%m-%d-%Y']"
_DATE = f"CAST(try_strptime(publication_date, {FORMATS}) AS DATE)"
_CODES = f"list_sort(list_distinct(regexp_extract_all(title, '(?i){text.CODE}')))"
#: Keywords that the synthetic documents do hold.
KEYWORDS = ("license", "copyright", "smic", "Entity List")
_MATCHES = f"list_filter({list(KEYWORDS)}, lambda k: contains(lower(coalesce(text, '')), lower(k)))"
_PDF = r"coalesce(regexp_matches(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') AND ends_with(lower(url), '.pdf'), false)"
_NAMES = "notice_id, source, url, title, true_date, publication_date"
COLUMNS = _NAMES.split(", ")


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.notices(spark, sf_dir).select("notice_id", dates.parse_date(F.col("publication_date")).alias("date"), "true_date")


def first_numeric_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.links(spark, sf_dir).select("a_no", dates.numeric_date_text(F.col("link_text")).alias("date_text"))


def extract_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.with_codes(views.notices(spark, sf_dir), "title").select("notice_id", "eccns_found", "eccn_count", "contains_eccn")


def codes_per_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.codes_per_date(text.with_codes(views.notices(spark, sf_dir), "title"))


def keyword_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.flag_keywords(docs, "text", KEYWORDS).select("doc_id", text.joined(F.col("flagged_keywords")).alias("flagged_keywords"), "flagged")


#: A keyword for each part: a code that titles may hold, two letters of its name, or a word that stands in every title.
_KEYWORD = "CASE WHEN p_partkey % 50 = 0 THEN substring(p_name, 1, 2) WHEN p_partkey % 333 = 0 THEN 'Notice' ELSE concat('5B', lpad(cast(p_partkey AS {text}), cast(greatest(3, length(cast(p_partkey AS {text}))) AS int), '0')) END"


def keyword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by a table with as many keywords as there are parts."""
    words = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rank"), F.expr(_KEYWORD.format(text="string")).alias("keyword"))
    titles = views.notices(spark, sf_dir).select("notice_id", "title")
    return text.flag_keywords_from_table(titles, words, form=text.joined).select("notice_id", "flagged_keywords", "flagged")


def flagged_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    return reporting.flagged_only(text.flag_keywords(docs, "text", KEYWORDS)).select("doc_id", F.size("flagged_keywords").alias("n_keywords"))


#: Topics whose names the written titles hold: a short one inside words, a long one.
TOPICS = {"is_medium": ("MEDIUM", "NOT SPECIFIED"), "is_urgent": ("URG", "1-URGENT")}


def topic_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.col("title")
    return views.notices(spark, sf_dir).select(
        "notice_id", *[text.topic_flag(title, t).alias(k) for k, t in TOPICS.items()],
        text.topic_flag(title, "ear").alias("is_ear_related"), text.topic_flag(title, "itar").alias("is_itar_related"),
    )


def diff_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = views.snapshots(spark, sf_dir)
    return compare.added(old, new).select(*COLUMNS)


def diff_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = views.snapshots(spark, sf_dir)
    return compare.removed(old, new).select(*COLUMNS)


def diff_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = views.snapshots(spark, sf_dir)
    return compare.members(new, old).select(*COLUMNS)


def change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = views.snapshots(spark, sf_dir)
    return compare.change_report(old, new).select(*COLUMNS, "change_type")


def key_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = views.snapshots(spark, sf_dir)
    return compare.key_presence(old, new)


def key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = views.snapshots(spark, sf_dir)
    return compare.key_difference(new, old)


def snapshot_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair, n_differing): a snapshot against itself in another order, and against another one."""
    old, new = views.snapshots(spark, sf_dir)
    old, new = old.select(*COLUMNS), new.select(*COLUMNS)
    count = lambda a, b, name: compare.differing_rows(a, b).agg(F.count("*").alias("n_differing")).withColumn("pair", F.lit(name))
    return count(old, old.orderBy(F.desc("notice_id")), "same").unionByName(count(old, new, "other"))


def url_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each url was there, over a snapshot for each year with the notices of that year."""
    years = views.notices(spark, sf_dir).select("url", F.date_format("true_date", "yyyy").alias("snapshot_ts"))
    return history.presence_intervals(years)


def widened_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three generations: dates and counts as texts, some of them unreadable; dates, and counts as long; neither, and counts as int."""
    n = views.notices(spark, sf_dir)
    part = lambda k: n.where(F.col("notice_id") % 3 == k)
    written = F.when(F.col("notice_id") % 2 == 0, "to be set").otherwise(F.col("publication_date"))
    count = F.when(F.col("notice_id") % 5 == 0, F.lit("2.5")).otherwise((F.col("notice_id") % 100).cast("string"))
    frames = [
        part(0).select("notice_id", "title", written.alias("date"), count.alias("count")),
        part(1).select("notice_id", F.col("true_date").alias("date"), F.col("notice_id").alias("count"), "url"),
        part(2).select("notice_id", "url", (F.col("notice_id") % 7).cast("int").alias("count")),
    ]
    rows = widening.union_widened(frames)
    return rows.select("notice_id", "title", "date", "count", "url", F.col("unread")["date"].alias("unread_date"), F.col("unread")["count"].alias("unread_count"))


def union_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = views.snapshots(spark, sf_dir)
    return merge.union_all([old.select("notice_id", "url"), new.select("notice_id", "title", "url")])


def multi_source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.notices(spark, sf_dir)
    parts = [
        n.where("source = 'src-F'").select("source", "notice_id", "url"), n.where("source = 'src-O'").select("source", "notice_id", "title"),
        n.where("source = 'src-P'").select("source", "notice_id", F.lit(True).alias("is_ear_related")),
    ]
    return merge.union_all(parts)


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source over a dimension that also has sources without rows: one for each order priority."""
    n = views.notices(spark, sf_dir)
    dimension = n.select("source").distinct().unionByName(views.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source")).distinct())
    return reporting.source_counts(n, dimension)


def _stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = views.snapshots(spark, sf_dir)
    stamp = lambda df, ts: df.select(*COLUMNS).withColumn("snapshot_ts", F.lit(ts)).withColumn("row_no", F.col("notice_id"))
    return merge.union_all([stamp(old, "1"), stamp(new, "2")])


def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.first_by_key(_stacked(spark, sf_dir)).select(*COLUMNS)


def first_per_key_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.first_by_rank(_stacked(spark, sf_dir)).select(*COLUMNS)


def master_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stacked(spark, sf_dir)
    master = merge.first_by_key(rows.where("snapshot_ts = '1'"))
    return merge.merge(master, rows.where("snapshot_ts = '2'")).select(*COLUMNS)


def master_merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stacked(spark, sf_dir)
    master = merge.first_by_key(rows.where("snapshot_ts = '1'"))
    return merge.merge(master, rows.where("snapshot_ts = '2'"), conflict="latest").select(*COLUMNS)


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.notices(spark, sf_dir).withColumn("date", dates.parse_date(F.col("publication_date")))


def newest_first_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.head(_dated(spark, sf_dir), 5, "url", "notice_id").select("notice_id", "url", "date")


def pdf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.pdf_summary(_dated(spark, sf_dir))


def report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, rows) of each table of a report whose new rows are the later snapshot's."""
    rows = text.flag_keywords(text.with_codes(_dated(spark, sf_dir), "title"), "title", ("urgent", "5b1"))
    tables = reports.report(rows, rows.where(views.SNAP_NEW))
    return merge.union_all([t.agg(F.count("*").alias("rows")).withColumn("name", F.lit(n)) for n, t in tables.items()])


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = text.flag_keywords(views.notices(spark, sf_dir), "title", ("urgent", "5b1"))
    return reporting.run_summary(n.withColumn("pdf_downloaded", urls.is_pdf_url(F.col("url"))))


def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.column_widths(views.notices(spark, sf_dir).select("notice_id", "source", "url", "title", "true_date", "publication_date"))


def date_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.date_coverage(_dated(spark, sf_dir))


def quarter_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("o_orderdate")
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.quarter_label(ts).alias("quarter"), dates.snapshot_label(ts).alias("label"), dates.snapshot_label(ts, daily=True).alias("day")
    )


def assemble_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return text.assemble(turns, "conv_id", "turn")


#: Longest text of a url in assemble_hot, and page numbers of a range.
MOST, SPAN = 5_000, 400


def assemble_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by url where one url has a third of all pages: whole, and within a limit."""
    o = F.col("o_orderkey")
    pages = views.table(spark, sf_dir, "orders").select(F.when(o % 3 == 0, "hot").otherwise((o % 1000).cast("string")).alias("url"), o.alias("page_no"), F.col("o_orderpriority").alias("text"))
    whole = text.assemble_ranges(pages, "url", "page_no", span=SPAN)
    return whole.join(text.assemble_ranges(pages, "url", "page_no", out="limited", span=SPAN, max_chars=MOST), "url")


def empty_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", text.is_blank(F.col("text")).alias("blank"))


def strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit(" \t"), F.col("title"), F.lit("\n "))
    return views.notices(spark, sf_dir).select("notice_id", text.strip(padded).alias("title"), F.lower(text.strip(padded)).alias("folded"))


def pdf_url_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return views.notices(spark, sf_dir).select(
        "notice_id", urls.is_pdf_url(url).alias("is_pdf"), urls.is_pdf_url(F.upper(url)).alias("upper_is_pdf"),
        urls.is_pdf_url(F.upper(url), strict_case=True).alias("upper_is_strict_pdf"),
    )


def url_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", urls.file_name(F.col("url")).alias("file_name"))


def absolute_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    href, base = F.col("href"), "https://www.example.org"
    return html.page_links(views.table(spark, sf_dir, "pages")).select(
        "page_id", "link_no", urls.absolute(href, base, "always").alias("always"), urls.absolute(href, base, "relative").alias("relative"),
        urls.absolute(href, base, "not_http").alias("not_http"),
    )


def admission_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = documents.admitted(views.fetch_log(spark, sf_dir))
    return log.groupBy("reason", "accepted").agg(F.count("*").alias("n"), F.sum(F.coalesce("content_length", F.lit(0))).alias("bytes"))


def notice_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices with defaults and the codes of their own document: here, the titles of all of the url's orders."""
    n = documents.with_defaults(views.notices(spark, sf_dir))
    pages = n.where(urls.is_pdf_url(F.col("url"))).select("url", F.col("notice_id").alias("page_no"), F.col("title").alias("text"))
    facts = text.with_codes(text.assemble(pages, "url", "page_no"), "text")
    return documents.enrich(n, facts).select("notice_id", "url", "source", "pdf_downloaded", "contains_eccn", "eccn_count", "eccns_found")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_links(views.table(spark, sf_dir, "pages"))


def short_link_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.long_enough(html.page_links(views.table(spark, sf_dir, "pages")))


def carry_forward_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.carry_forward_dates(views.links(spark, sf_dir), ["p_no"], "a_no", paragraph=None).select("p_no", "a_no", "date_text")


def element_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each page's menu, by the element extractor."""
    spec = html.Items(("li", None), ("a", None), title_is_link=True, packed=True)
    found = html.items(views.table(spark, sf_dir, "pages").select("page_id", "html"), spec)
    return found.groupBy("page_id").agg(F.count("*").alias("n_items"), F.max("item_no").alias("last_item"), F.count("href").alias("n_links"))


QUERIES = {f.__name__: f for f in (
    parse_dates, first_numeric_date, extract_codes, codes_per_date, keyword_flags, keyword_table, flagged_only, topic_flags, diff_added, diff_removed, diff_semi,
    change_report, key_presence, key_difference, url_history, widened_generations, snapshot_unchanged, union_drift, multi_source_union, source_counts, first_per_key,
    first_per_key_ranked, master_merge, master_merge_latest, newest_first_top5, pdf_summary, report_tables, run_summary, column_widths, date_coverage,
    quarter_label, assemble_text, assemble_hot, empty_text, strip_text, pdf_url_predicate, url_filename, absolute_urls, admission_reason, notice_enrich,
    page_links, short_link_filter, carry_forward_date, element_links,
)}

_FIRST = f"""SELECT {_NAMES} FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts, notice_id) AS r FROM
  (SELECT *, 1 AS ts FROM snap_old_v UNION ALL SELECT *, 2 FROM snap_new_v)) WHERE r = 1"""
_ADDED = f"SELECT {_NAMES} FROM snap_new_v n WHERE NOT EXISTS (SELECT 1 FROM snap_old_v o WHERE o.url IS NOT DISTINCT FROM n.url)"
_REMOVED = f"SELECT {_NAMES} FROM snap_old_v o WHERE NOT EXISTS (SELECT 1 FROM snap_new_v n WHERE o.url IS NOT DISTINCT FROM n.url)"
_CODED = f"(SELECT *, {_CODES} AS c FROM notices_v)"
_FLAGGED = "len(list_filter(['urgent', '5b1'], lambda k: contains(lower(title), k))) > 0"
_LINKS = """(SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
  unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS link_text,
  unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1))))::INTEGER AS link_no FROM pages)"""
_BASE = "'https://www.example.org'"
_WIDTH = lambda c: f"(greatest(max(coalesce(length({c}::VARCHAR), 3)), {len(c)}) + 2)::INTEGER AS {c}"
_PATH = r"regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '^([^?#]*)', 1)"
_NAME = f"regexp_extract({_PATH}, '([^/]*)$', 1)"

_SQL = {
    "parse_dates": f"SELECT notice_id, {_DATE} AS date, true_date FROM notices_v",
    "first_numeric_date": r"SELECT a_no, nullif(regexp_extract(link_text, '\b([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})\b', 0), '') AS date_text FROM links_v",
    "extract_codes": f"SELECT notice_id, array_to_string(c, ', ') AS eccns_found, len(c)::INTEGER AS eccn_count, len(c) > 0 AS contains_eccn FROM {_CODED}",
    "codes_per_date": f"SELECT publication_date, sum(len(c))::BIGINT AS total_eccns FROM {_CODED} WHERE publication_date IS NOT NULL GROUP BY 1",
    "keyword_flags": f"SELECT doc_id, array_to_string({_MATCHES}, ', ') AS flagged_keywords, len({_MATCHES}) > 0 AS flagged FROM documents",
    "keyword_table": f"""SELECT n.notice_id, coalesce(string_agg(k, ', ' ORDER BY rank, k), '') AS flagged_keywords, count(k) > 0 AS flagged FROM notices_v n
      LEFT JOIN (SELECT p_partkey AS rank, {_KEYWORD.format(text="varchar")} AS k FROM part) w ON k <> '' AND contains(lower(n.title), lower(k)) GROUP BY n.notice_id""",
    "flagged_only": f"SELECT doc_id, len({_MATCHES})::INTEGER AS n_keywords FROM documents WHERE len({_MATCHES}) > 0",
    "topic_flags": "SELECT notice_id, " + ", ".join(
        f"contains(title, '{a}') OR contains(title, '{b}') AS {k}" for k, (a, b) in (
            *TOPICS.items(), ("is_ear_related", text.TOPICS["ear"]), ("is_itar_related", text.TOPICS["itar"]))) + " FROM notices_v",
    "diff_added": _ADDED,
    "diff_removed": _REMOVED,
    "diff_semi": f"SELECT {_NAMES} FROM snap_new_v n WHERE EXISTS (SELECT 1 FROM snap_old_v o WHERE o.url IS NOT DISTINCT FROM n.url)",
    "change_report": f"SELECT *, 'added' AS change_type FROM ({_ADDED}) UNION ALL SELECT *, 'removed' FROM ({_REMOVED})",
    "key_presence": "SELECT url, bool_or(o) AS in_old, bool_or(n) AS in_new FROM (SELECT url, true AS o, false AS n FROM snap_old_v UNION ALL SELECT url, false, true FROM snap_new_v) GROUP BY url",
    "key_difference": "SELECT url FROM snap_new_v EXCEPT SELECT url FROM snap_old_v",
    "snapshot_unchanged": f"""SELECT 'same' AS pair, 0::BIGINT AS n_differing UNION ALL SELECT 'other', (SELECT count(*) FROM
      ((SELECT {_NAMES} FROM snap_new_v EXCEPT ALL SELECT {_NAMES} FROM snap_old_v) UNION ALL (SELECT {_NAMES} FROM snap_old_v EXCEPT ALL SELECT {_NAMES} FROM snap_new_v)))""",
    "url_history": """SELECT url, row_number() OVER (PARTITION BY url ORDER BY a)::INTEGER AS spell, l.label AS valid_from, e.label AS valid_to, n AS n_snapshots FROM
      (SELECT url, min(no) AS a, max(no) AS b, count(*) AS n FROM (SELECT *, no - row_number() OVER (PARTITION BY url ORDER BY no) AS run FROM
        (SELECT DISTINCT url, dense_rank() OVER (ORDER BY year(true_date)) AS no FROM notices_v)) GROUP BY url, run) r
      JOIN (SELECT DISTINCT year(true_date)::VARCHAR AS label, dense_rank() OVER (ORDER BY year(true_date)) AS no FROM notices_v) l ON l.no = r.a
      LEFT JOIN (SELECT DISTINCT year(true_date)::VARCHAR AS label, dense_rank() OVER (ORDER BY year(true_date)) AS no FROM notices_v) e ON e.no = r.b + 1""",
    "widened_generations": f"""SELECT notice_id, CASE WHEN g = 0 THEN title END AS title, CASE WHEN g = 0 AND notice_id % 2 = 1 THEN {_DATE} WHEN g = 1 THEN true_date END AS date,
      CASE WHEN g = 0 AND notice_id % 5 <> 0 THEN notice_id % 100 WHEN g = 1 THEN notice_id WHEN g = 2 THEN notice_id % 7 END::BIGINT AS count, CASE WHEN g > 0 THEN url END AS url,
      CASE WHEN g = 0 AND notice_id % 2 = 0 THEN 'to be set' END AS unread_date, CASE WHEN g = 0 AND notice_id % 5 = 0 THEN '2.5' END AS unread_count FROM (SELECT *, notice_id % 3 AS g FROM notices_v)""",
    "union_drift": "SELECT notice_id, url, NULL::VARCHAR AS title FROM snap_old_v UNION ALL SELECT notice_id, url, title FROM snap_new_v",
    "multi_source_union": """SELECT source, notice_id, CASE WHEN source = 'src-F' THEN url END AS url, CASE WHEN source = 'src-O' THEN title END AS title,
      CASE WHEN source = 'src-P' THEN true END AS is_ear_related FROM notices_v""",
    "source_counts": """SELECT d.source, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT source FROM notices_v UNION ALL SELECT DISTINCT o_orderpriority FROM orders) d
      LEFT JOIN (SELECT source, count(*) AS n FROM notices_v GROUP BY 1) c ON d.source = c.source""",
    "first_per_key": _FIRST,
    "first_per_key_ranked": _FIRST,
    "master_merge": _FIRST,
    "master_merge_latest": _FIRST.replace("ORDER BY ts,", "ORDER BY ts DESC,"),
    "newest_first_top5": f"SELECT notice_id, url, {_DATE} AS date FROM notices_v ORDER BY date DESC NULLS LAST, url NULLS FIRST, notice_id LIMIT 5",
    "pdf_summary": f"SELECT title, {_DATE} AS date, url FROM notices_v",
    "report_tables": f"""SELECT 'all_entries' AS name, count(*) AS rows FROM notices_v UNION ALL SELECT 'flagged_only', count(*) FROM notices_v WHERE {_FLAGGED}
      UNION ALL SELECT 'pdf_summary', count(*) FROM notices_v UNION ALL SELECT 'code_summary', count(DISTINCT publication_date) FROM snap_new_v""",
    "run_summary": f"""SELECT count(*) AS rows, count(url) AS with_url, count(*) FILTER ({_PDF}) AS downloaded, count(*) FILTER ({_FLAGGED}) AS flagged,
      0::BIGINT AS ear, 0::BIGINT AS itar FROM notices_v""",
    "column_widths": f"SELECT {', '.join(_WIDTH(c) for c in COLUMNS)} FROM notices_v",
    "date_coverage": f"SELECT count(*) AS rows, count({_DATE}) AS dated, count({_DATE}) > 0 AS any_dated, count({_DATE}) = count(*) AS all_dated FROM notices_v",
    "quarter_label": """SELECT o_orderkey, year(o_orderdate)::VARCHAR || '_Q' || quarter(o_orderdate)::VARCHAR AS quarter,
      strftime(o_orderdate, '%Y-%m-%d_%H-%M') AS label, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""",
    "assemble_text": "SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "assemble_hot": f"""SELECT url, string_agg(t, '' ORDER BY no) AS text, string_agg(CASE WHEN l <= {MOST} THEN t ELSE '' END, '' ORDER BY no) AS limited, max(l) > {MOST} AS truncated FROM
      (SELECT *, sum(length(t)) OVER (PARTITION BY url ORDER BY no) AS l FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'hot' ELSE (o_orderkey % 1000)::VARCHAR END AS url, o_orderkey AS no, o_orderpriority AS t FROM orders)) GROUP BY url""",
    "empty_text": r"SELECT doc_id, regexp_replace(coalesce(text, ''), '\s+', '', 'g') = '' AS blank FROM documents",
    "strip_text": "SELECT notice_id, title, lower(title) AS folded FROM notices_v",
    "pdf_url_predicate": f"SELECT notice_id, {_PDF} AS is_pdf, {_PDF} AS upper_is_pdf, false AS upper_is_strict_pdf FROM notices_v",
    "url_filename": f"SELECT page_id, CASE WHEN {_NAME} <> '' THEN {_NAME} ELSE 'pdf_' || substr(md5(url), 1, 16) || '.pdf' END AS file_name FROM pages",
    "absolute_urls": f"""SELECT page_id, link_no, {_BASE} || href AS always, CASE WHEN starts_with(href, '/') THEN {_BASE} || href ELSE href END AS relative,
      CASE WHEN NOT starts_with(href, 'http') THEN {_BASE} || href ELSE href END AS not_http FROM {_LINKS}""",
    "admission_reason": f"""SELECT reason, reason = 'accepted' AS accepted, count(*) AS n, sum(coalesce(content_length, 0))::BIGINT AS bytes FROM
      (SELECT *, CASE WHEN NOT {_PDF} THEN 'invalid_url' WHEN coalesce(content_length, 0) > 5242880 THEN 'too_large'
       WHEN NOT contains(lower(content_type), 'application/pdf') THEN 'not_pdf' WHEN status <> 200 THEN 'http_error' ELSE 'accepted' END AS reason FROM fetch_log_v) GROUP BY reason""",
    "notice_enrich": f"""SELECT n.notice_id, n.url, n.source, false AS pdf_downloaded, coalesce(len(c) > 0, false) AS contains_eccn,
      coalesce(len(c), 0)::INTEGER AS eccn_count, coalesce(array_to_string(c, ', '), '') AS eccns_found FROM notices_v n LEFT JOIN
      (SELECT url, {_CODES} AS c FROM (SELECT url, string_agg(title, '' ORDER BY notice_id) AS title FROM notices_v WHERE {_PDF} GROUP BY url)) d ON n.url = d.url""",
    "page_links": f"SELECT page_id, link_no, href, link_text FROM {_LINKS}",
    "short_link_filter": f"SELECT page_id, link_no, href, link_text FROM {_LINKS} WHERE length(href) >= 5 AND length(link_text) >= 5",
    "carry_forward_date": r"""SELECT p_no, a_no, first_value(d IGNORE NULLS) OVER (PARTITION BY p_no ORDER BY a_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS date_text
      FROM (SELECT *, nullif(regexp_extract(link_text, '\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\b', 0), '') AS d FROM links_v)""",
    "element_links": f"SELECT page_id, count(*) AS n_items, (count(*) - 1)::INTEGER AS last_item, count(href) AS n_links FROM {_LINKS} GROUP BY page_id",
}
SQL = {k: views.DUCK + v for k, v in _SQL.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, codes and flags of all notices, summed by date of publication."""
    n = text.flag_keywords(text.with_codes(_dated(spark, sf_dir), "title"), "title", ("urgent", "5b1"))
    return n.groupBy("date").agg(F.count("*").alias("notices"), F.sum("eccn_count").alias("total_eccns"), F.count_if("flagged").alias("flagged")).orderBy("date")

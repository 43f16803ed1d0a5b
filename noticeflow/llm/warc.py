"""WARC archives: distributed writing, and reading by boundary-chain verification.

Writing: Spark's text writer puts out one record a row, with the two line breaks that
end a record as its line separator, so every task's file is an archive. Of records with
equal payloads the one with the largest page id is a response, the others revisit it.

Reading: archives are split anywhere. The text reader, with the magic ``WARC/1.1`` as
line separator, hands each task the chunks between magics. A chunk is a candidate record:
its place in the file is the sum of the chunks before it, its header gives the place of
its successor. Payloads may hold the magic, so candidates are verified as a chain: runs of
candidates that follow each other directly are contracted to one node, and pointer jumping
from the start of the file keeps the nodes that it reaches. What no chain reaches is
payload. Runs end where a block of a file does, so no task orders a whole archive. Records of
several chunks (with a magic inside) are put together again from the texts of their chunks alone, which a second
scan of the files that have some looks up by hash and size.

Defined results: a null payload is empty, as is a null url; control characters in a url are
percent-encoded; rows that repeat a page id and a payload are all responses if theirs is the
largest id; a null page id is smaller than any other and reads back as null; a candidate whose
header is broken or whose length goes beyond the file ends its chain; an empty table gives
archives without records, which read back as an empty table; further columns are not written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeflow.llm.common import scratch_dir, written

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"


def base32(hexed: Column) -> Column:
    """Upper-case base32 of 40 hex digits: five hex digits are four base32 digits."""
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def deduplicated(pages: DataFrame, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, bytes, refers_to, revisit) of each page.

    Only digests that occur twice are joined back, and those are known by an aggregation with map-side combine.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
        payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"),
    ).withColumn("digest", base32(F.col("digest")))
    twice = written(
        rows.where(F.col("bytes") >= min_bytes).groupBy("digest")
        .agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n"), "twice",
    )
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return (
        rows.join(twice, "digest", "left").withColumn("revisit", revisit)
        .withColumn("refers_to", F.when(F.col("revisit"), F.col("response"))).drop("response")
    )


def record_text(date: str) -> Column:
    """One record, without the two line breaks that end it."""
    head = F.lit(HTTP + GAP)
    block = F.when(F.col("revisit"), head).otherwise(F.concat(head, F.col("payload")))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), r"[\x00-\x20]", "%20")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    lines = F.concat_ws(
        "\r\n",
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), name("refers_to"))),
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(F.lit(MAGIC), lines, F.lit(GAP), block)


def write_archives(
    pages: DataFrame, path: str | None = None, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z",
    page_id: str = "page_id", url: str = "url", html: str = "html",
) -> str:
    """Write one archive a task; returns the folder, by default a new one that driver and executors share."""
    path = path or f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = deduplicated(pages, min_bytes, page_id, url, html)
    rows.select(record_text(date).alias("record")).write.option("lineSep", GAP).text(path)
    return path


def _header(name: str) -> Column:
    return F.regexp_extract("header", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)


def _chunks(spark: SparkSession, path: str, keep: bool) -> DataFrame:
    """Candidates with their places: file, block, off (of the magic), end (of the chunk), next (the successor's place; null if none).

    For a candidate that is a whole record (next = end) the payload's size and digest are taken in this scan, each from
    bytes and once a record; ``mark`` and ``len`` stand for the chunk's text, which is carried along with ``keep`` only.
    """
    m, gap = len(MAGIC), len(GAP)
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("no"), "value",
    )
    parsed = raw.withColumns({"len": F.octet_length("value").cast("long"), "header": F.substring_index("value", GAP, 1)})
    parsed = parsed.withColumns({"head": F.octet_length("header"), "content": _header("Content-Length").try_cast("long")})
    parsed = parsed.withColumn(
        "record_len",
        F.when((F.col("head") < F.col("len")) & F.contains("header", F.lit(":")) & (F.col("content") >= 0), m + F.col("head") + gap + F.col("content") + gap),
    )
    parsed = parsed.withColumn("from", F.when(F.col("record_len") == F.col("len") + m, payload_start("value", "head", "content")))
    size = F.col("head") + gap + F.col("content") - F.col("from")
    payload = F.substring(F.col("value").cast("binary"), (F.col("from") + 1).cast("int"), size.cast("int"))
    parsed = parsed.select(
        "file", "block", "size", "no", "len", "record_len",
        F.when(F.col("record_len").isNotNull(), F.col("header")).alias("header"),
        size.alias("bytes"), F.sha1(payload).alias("sha1"), F.xxhash64("value").alias("mark"), *([F.col("value")] if keep else []),
    )
    parsed = written(parsed, "chunks")  # the scan's row order is fixed from here on
    in_block = Window.partitionBy("file", "block").orderBy("no")
    blocks = parsed.groupBy("file", "block").agg(F.sum(F.col("len") + m).alias("sum"))
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    bases = blocks.select(F.col("file"), F.col("block"), F.coalesce(F.sum("sum").over(in_file), F.lit(0)).alias("base"))
    before = F.coalesce(F.sum(F.col("len") + m).over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parsed.withColumn("before", before).join(bases, ["file", "block"])
    placed = placed.withColumn("off", F.col("base") + F.col("before") - m).where("off >= 0")  # what comes before a file's first magic is no record
    return placed.select(
        "file", "block", "off", "len", "mark", (F.col("off") + m + F.col("len")).alias("end"),
        F.when(F.col("off") + F.col("record_len") <= F.col("size"), F.col("off") + F.col("record_len")).alias("next"),
        "header", "bytes", base32(F.col("sha1")).alias("digest"), *([F.col("value")] if keep else []),
    )


def payload_start(value: str, head: str, content: str) -> Column:
    """Where the payload begins in a chunk, in bytes: behind the HTTP header, or where the block does if that has none."""
    block = F.col(head) + len(GAP)
    behind = F.octet_length(F.substring_index(value, GAP, 2)) + len(GAP)
    return F.when(behind <= block + F.col(content), behind).otherwise(block)


def _payload(value: str, header: str = "header") -> Column:
    """The payload of a whole record's text."""
    head, gap = F.octet_length(header), len(GAP)
    behind = F.octet_length(F.substring_index(value, GAP, 2)) + gap
    end = F.octet_length(value) - gap
    start = F.when(behind <= end, behind).otherwise(head + gap)
    return F.substring(F.col(value).cast("binary"), start + 1, end - start)


def _verified(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All candidates, and those on the chain from the start of their file.

    Runs end where a block of the file does, so however large a file is, no task orders more than a block's candidates,
    and the nodes that pointers jump over are about as many as blocks.
    """
    order = Window.partitionBy("file", "block").orderBy("off")
    c = candidates.withColumns({"prev": F.lag("next").over(order), "after": F.lead("off").over(order)})
    # a run also ends where a jump over other candidates lands, so that a run is always entered at its head
    landings = (
        c.where(F.col("next").isNotNull() & ~F.col("next").eqNullSafe(F.col("after")))
        .select("file", F.col("next").alias("off"), F.lit(True).alias("landing")).distinct()
    )
    c = c.join(written(landings, "landings"), ["file", "off"], "left")
    head = ~F.col("prev").eqNullSafe(F.col("off")) | F.col("landing").isNotNull()
    c = c.withColumn("run", F.max(F.when(head, F.col("off"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    c = written(c.drop("prev", "after", "landing"), "runs")
    jump = written(c.groupBy("file", F.col("run").alias("off")).agg(F.max_by("next", F.col("off")).alias("to")), "jump")
    reached = written(jump.where("off = 0").select("file", "off"), "reached")
    count = reached.count()
    while count:
        step = reached.join(jump, ["file", "off"]).select("file", F.col("to").alias("off")).where("off is not null")
        nodes = jump.select("file", "off")
        reached = written(reached.unionByName(step.join(nodes, ["file", "off"], "left_semi")).distinct(), "reached")
        grown = reached.count()
        if grown == count:
            break
        count = grown
        far = jump.select("file", F.col("off").alias("to"), F.col("to").alias("far"))
        jump = written(jump.join(far, ["file", "to"], "left").select("file", "off", F.col("far").alias("to")), "jump")
    runs = reached.withColumnRenamed("off", "run")
    return c, c.join(runs, ["file", "run"], "left_semi").where("next is not null")


def _pieces(candidates: DataFrame, torn: DataFrame) -> DataFrame:
    """(file, own, at, mark, len) of each chunk of the torn records (file, block, own, next).

    A block's chunks are told apart by a window within the block; at most one record reaches into a block from before it.
    """
    span = candidates.groupBy("file", "block").agg(F.min("off").alias("first"), F.max("end").alias("stop"))
    reach = lambda: F.struct("own", "next").alias("reach")
    over = torn.join(span, ["file", "block"]).where("next > stop").select("file", reach())
    into = span.join(over, "file").where("first > reach.own and first < reach.next").select("file", "block", F.col("reach").alias("into"))
    order = Window.partitionBy("file", "block").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    c = (
        candidates.select("file", "block", "off", "mark", "len").join(torn.select("file", F.col("own").alias("off"), reach()), ["file", "off"], "left")
        .join(into, ["file", "block"], "left")
        .withColumn("of", F.coalesce(F.last("reach", ignorenulls=True).over(order), F.col("into")))
    )
    return c.where("off < of.next").select("file", F.col("of.own").alias("own"), F.col("off").alias("at"), "mark", "len")


#: Names of archives that are read a second time by name; with more, the whole folder is.
MAX_NAMES = 1000


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """(file, offset, header, payload_bytes, payload_digest[, payload]) of each verified record.

    Size and digest are those of the bytes read. ``payload`` is text, as every payload here is UTF-8.
    """
    candidates, good = _verified(_chunks(spark, path, payloads))
    good = written(good, "verified")
    whole = good.where("next = end").select(
        "file", F.col("off").alias("offset"), "header", F.col("bytes").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        *([_payload("value").cast("string").alias("payload")] if payloads else []),
    )
    torn = good.where("next <> end").select("file", "block", F.col("off").alias("own"), "next")
    if torn.isEmpty():
        return whole
    pieces = written(_pieces(candidates, torn), "pieces")
    files = [r["file"] for r in pieces.select("file").distinct().limit(MAX_NAMES + 1).collect()]
    again = spark.read.option("lineSep", MAGIC).text(files if len(files) <= MAX_NAMES else path)
    # a chunk is known by its hash and size; only the texts of torn records' chunks leave the scan
    texts = (
        again.withColumns({"mark": F.xxhash64("value"), "len": F.octet_length("value").cast("long")})
        .join(pieces.select("mark", "len").distinct(), ["mark", "len"], "left_semi").groupBy("mark", "len").agg(F.first("value").alias("value"))
    )
    joined = pieces.join(texts, ["mark", "len"]).groupBy("file", "own").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]), MAGIC).alias("value")
    ).withColumn("header", F.substring_index("value", GAP, 1)).withColumn("body", _payload("value"))
    return whole.unionByName(joined.select(
        "file", F.col("own").alias("offset"), "header", F.octet_length("body").cast("long").alias("payload_bytes"),
        base32(F.sha1("body")).alias("payload_digest"), *([F.col("body").cast("string").alias("payload")] if payloads else []),
    ))


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): the full payload's figures, for revisits from their header."""
    revisit = _header("WARC-Type") == "revisit"
    page = lambda name: F.regexp_extract(_header(name), "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return records.select(
        page("WARC-Record-ID").alias("page_id"),
        F.when(revisit, _header("X-Payload-Length").try_cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(_header("WARC-Payload-Digest"), "^sha1:", "")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        _header("WARC-Type").alias("record_type"),
        F.when(revisit, page("WARC-Refers-To")).alias("refers_to"),
    )

"""Text: strip, keyword and topic flags, classification codes, lists as text, ordered assembly."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.columns import once, unused
from noticeflow.functions.bloom import bloom_filter, may_be_among

# The default keyword list, in the order in which matches are reported.
KEYWORDS = ("Entity List", "Final Rule", "Huawei", "SMIC", "military end use", "PRC")
# Short and long name of each topic.
TOPICS = {"ear": ("EAR", "Export Administration Regulations"), "itar": ("ITAR", "International Traffic in Arms Regulations")}
#: Characters of the pieces by which texts and keywords of a table meet; a keyword's are of the greatest of the sizes that it has room for.
GRAM = 3
SIZES = (GRAM, 6, 12)
#: Texts with one such piece that meet its keywords in one part.
PART = 100_000
# Fixed value: a digit, a letter, three digits, and perhaps a dotted suffix; letter case is ignored.
CODE = r"\b[0-9][A-Z][0-9]{3}(?:\.[a-z0-9]+)?\b"


def strip(c: Column) -> Column:
    """Without white space, in Unicode's sense, at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def is_blank(c: Column) -> Column:
    """Whether a text holds nothing but white space; null counts as blank."""
    return F.coalesce(F.regexp_replace(c, r"(?U)\s+", "") == "", F.lit(True))


def keyword_matches(text: Column, keywords: Sequence[str] = KEYWORDS, whole_word: bool = False) -> Column:
    """The keywords that the text contains, in keyword order, whatever the case; null has none.

    By default a keyword matches inside a word; with ``whole_word`` it has to stand by itself.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    if not keywords:
        return F.array().cast("array<string>")
    words = F.array(*[F.lit(k) for k in keywords])
    if whole_word:
        padded = F.concat(F.lit(" "), F.regexp_replace(low, r"(?U)[^\w]+", " "), F.lit(" "))
        plain = lambda k: F.concat(F.lit(" "), F.regexp_replace(F.lower(k), r"(?U)[^\w]+", " "), F.lit(" "))
        return once(padded, lambda t: F.filter(words, lambda k: F.contains(t, plain(k))))
    return once(low, lambda t: F.filter(words, lambda k: F.contains(t, F.lower(k))))


def flag_keywords(df: DataFrame, column: str = "title", keywords: Sequence[str] = KEYWORDS, whole_word: bool = False) -> DataFrame:
    """``df`` with flagged_keywords and flagged."""
    return df.withColumn("flagged_keywords", keyword_matches(F.col(column), keywords, whole_word)).withColumn(
        "flagged", F.size("flagged_keywords") > 0
    )


def pieces_of(c: Column, size: int) -> Column:
    """The different pieces of ``size`` characters that a text holds."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def grams(low: Column) -> Column:
    """The different pieces of up to GRAM characters that a text holds. Linear in the text, and no Python."""
    return F.concat(*[pieces_of(low, n) for n in range(1, GRAM + 1)])


def cut_keywords(keywords: DataFrame, sizes: Sequence[int] = (GRAM,)) -> DataFrame:
    """``keywords`` (word, labels) with a row for each piece of a word, as gram: those of the greatest of ``sizes`` that it has room for, or itself."""
    whole = lambda size: F.filter(pieces_of(F.col("word"), size), lambda g: F.length(g) == size)
    own = F.array("word")
    for size in sorted(sizes):
        own = F.when(F.length("word") >= size, whole(size)).otherwise(own)
    return keywords.withColumn("gram", F.explode(own))


def filed_keywords(pieces: DataFrame, keywords: DataFrame, part_size: int = PART, sizes: Sequence[int] = (GRAM,)) -> DataFrame:
    """``keywords`` (word, labels), a row for each word, each under the piece of it that the fewest texts hold, as gram; a word with a piece that no text holds is in none and goes.

    A piece that many texts hold is dealt over parts: ``parts`` says over how many. ``pieces`` has a gram of a text in each row, of ``sizes`` and of all sizes below the least.
    """
    cut = cut_keywords(keywords, sizes)
    counts = pieces.groupBy("gram").agg(F.count(pieces.columns[0]).alias("texts"))  # of a column, as one that is pruned would make another plan of the pieces
    met = cut.join(counts, "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    rarest = met.groupBy("word").agg(F.min_by(F.struct("gram", "texts"), F.struct("texts", "gram")).alias("least"), F.first("labels").alias("labels"))
    return rarest.where(F.col("least.texts") > 0).select("word", "labels", "least.gram", F.ceil(F.col("least.texts") / part_size).cast("int").alias("parts"))


def flag_keywords_from_table(
    df: DataFrame, keywords: DataFrame, column: str = "title", keyword: str = "keyword", rank: str = "rank", part_size: int = PART, form: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """As flag_keywords, for a keyword table of any length; matches are listed by rank.

    A text that holds a keyword holds every piece of it, the rarest among them. How many texts hold each piece is counted
    once, each keyword is filed under its rarest piece, and texts meet keywords there; a piece that very many texts hold is dealt over parts. The keywords
    that a text has met are then looked for in it as a whole. Only pieces and the texts' digests take part in the meeting, and equal texts meet once.
    Texts that hold the same keywords share one list of matches, which is put in order once. Rows need no key: what a row gets depends on its own text alone.
    With ``form``, flagged_keywords is what it makes of the list, made once for each list: a list is as long as the table has ranks for its words, so it is not for each row to go through.

    Null and empty texts have no keyword, null and empty keywords match nothing, keywords of one rank are in order of their letters, and a repeated keyword
    is listed once. Letter case is ignored.
    """
    digest, low, of, held, found = unused([*df.columns, "flagged_keywords", "flagged"], "digest", "low", "digest_of", "held", "found")
    rows = df.drop("flagged_keywords", "flagged").withColumn(low, F.lower(F.coalesce(column, F.lit("")))).withColumn(digest, F.unhex(F.md5(low)))
    known = keywords.select(F.col(rank).alias("rank"), F.col(keyword).alias("k"), F.lower(keyword).alias("word")).where(F.length("word") > 0)
    known = known.groupBy("word").agg(F.collect_set(F.struct("rank", "k")).alias("labels"))  # a word that the table has under many ranks meets texts once
    texts = rows.select(F.col(digest).alias("digest"), F.col(low).alias("low")).distinct()
    of_words = cut_keywords(known, SIZES).select("gram")
    sizes = F.broadcast(of_words.agg(F.collect_set(F.length("gram")).alias("sizes")))  # one row: texts are cut into no pieces that no keyword is cut into
    cut = [F.when(F.array_contains("sizes", n), pieces_of(F.col("low"), n)).otherwise(F.array().cast("array<string>")) for n in (*range(1, GRAM), *SIZES)]
    pieces = texts.crossJoin(sizes).select("digest", F.explode(F.concat(*cut)).alias("gram"))
    # the pieces of texts are by far the most rows: those that no keyword has go before anything is exchanged. The others are dealt by text,
    # so that those of one gram don't meet, and made once for both uses: what each use would otherwise infer, that nothing is null, is said here, so that the plans are equal
    pieces = may_be_among(pieces, "gram", bloom_filter(of_words, "gram")).where("digest IS NOT NULL AND gram IS NOT NULL").repartition("digest")
    filed = filed_keywords(pieces, known, part_size, SIZES)
    parts = filed.groupBy("gram").agg(F.max("parts").alias("parts"))
    of_texts = pieces.join(parts, "gram").withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    of_keywords = filed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    candidates = of_texts.select("digest", "gram", "part").join(of_keywords.select("word", "gram", "part"), ["gram", "part"])
    met = candidates.groupBy("digest").agg(F.collect_set("word").alias("met"))
    words = F.array_sort(once(F.col("low"), lambda t: F.filter("met", lambda w: F.contains(t, w))))
    holders = texts.join(met, "digest").select("digest", words.alias("words")).where(F.size("words") > 0).withColumn("held", F.unhex(F.md5(F.to_json("words"))))
    labels = holders.select("held", "words").distinct().select("held", F.explode("words").alias("word")).join(known.hint("merge"), "word")
    shown = form or (lambda c: c)
    lists = labels.groupBy(F.col("held").alias(f"{held}_of")).agg(shown(F.transform(F.array_sort(F.flatten(F.collect_list("labels"))), lambda s: s["k"])).alias(found))
    out = rows.join(holders.select(F.col("digest").alias(of), F.col("held").alias(held)), F.col(digest) == F.col(of), "left")
    out = out.withColumn(held, F.coalesce(held, digest)).join(lists, F.col(held) == F.col(f"{held}_of"), "left")  # a digest is in no list; rows without a match don't meet in one task
    out = out.withColumns({"flagged_keywords": F.coalesce(found, shown(F.array().cast("array<string>"))), "flagged": F.col(f"{held}_of").isNotNull()})
    return out.drop(low, digest, of, held, f"{held}_of", found)


def topic_flag(title: Column, topic: str | tuple[str, str]) -> Column:
    """Whether a title holds the topic's short or long name, in this case of letters, anywhere."""
    short, long = TOPICS[topic] if isinstance(topic, str) else topic
    return F.coalesce(F.contains(title, F.lit(short)) | F.contains(title, F.lit(long)), F.lit(False))


def codes(text: Column) -> Column:
    """All classification codes, in text order, with repetitions."""
    return F.regexp_extract_all(text, F.lit(f"(?iU){CODE}"), F.lit(0))


def distinct_codes(text: Column) -> Column:
    """Distinct codes in code point order; none for null."""
    return F.coalesce(F.array_sort(F.array_distinct(codes(text))), F.array().cast("array<string>"))


def joined(items: Column) -> Column:
    return F.array_join(items, ", ")


def with_codes(df: DataFrame, text: str) -> DataFrame:
    """``df`` with eccns (array), eccns_found, eccn_count and contains_eccn."""
    return df.withColumn("eccns", distinct_codes(F.col(text))).withColumns({
        "eccns_found": joined(F.col("eccns")), "eccn_count": F.size("eccns"), "contains_eccn": F.size("eccns") > 0,
    })


def assemble(pages: DataFrame, key: str, order: str, text: str = "text", out: str = "text", max_chars: int | None = None) -> DataFrame:
    """(key, out): texts of each key in page order, nothing between.

    ``max_chars`` keeps one key's text within a row where input is hostile: pages beyond it are left out whole, and the
    column ``truncated`` says so. None sets no limit.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    if max_chars is None:
        return pages.groupBy(key).agg(F.expr(f"listagg(coalesce(`{text}`, ''), '') WITHIN GROUP (ORDER BY `{order}`)").alias(out))
    fits, piece = unused([*pages.columns, out, "truncated"], "fits", "piece")
    so_far = F.sum(F.length(t)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    marked = pages.withColumn(fits, so_far <= max_chars).withColumn(piece, F.when(F.col(fits), t).otherwise(""))
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(piece).alias("t"))))
    return marked.groupBy(key).agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), "").alias(out), (~F.bool_and(fits)).alias("truncated")
    )


def assemble_ranges(pages: DataFrame, key: str, order: str, text: str = "text", out: str = "text", span: int = 1000, max_chars: int | None = None) -> DataFrame:
    """As ``assemble``, for keys that may have very many pages, with whole page numbers as ``order``.

    Each range of ``span`` page numbers of a key is put together apart, then the ranges are, so no task sorts more than a range's pages. With
    ``max_chars`` the lengths of the ranges are summed up first: ranges that end before the limit are taken whole, and only the pages of the one that crosses it are looked at
    one by one. Without a limit a key's whole text has to fit a row. Pages without a number come first, as a range of their own.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    no, part, piece, before, so_far, fits, mine, at = unused([*pages.columns, out, "truncated"], "no", "part", "piece", "before", "so_far", "fits", "key_of", "part_of")
    rows = pages.select(F.col(key).alias(key), F.col(order).alias(no), F.expr(f"`{order}` div {span}").alias(part), t.alias(piece))
    in_range = lambda c: F.expr(f"listagg(`{c}`, '') WITHIN GROUP (ORDER BY `{no}`, `{c}`)")
    by_range = lambda c: F.expr(f"listagg(`{c}`, '') WITHIN GROUP (ORDER BY `{part}`)")
    if max_chars is None:
        return rows.groupBy(key, part).agg(in_range(piece).alias(piece)).groupBy(key).agg(by_range(piece).alias(out))
    lengths = rows.groupBy(key, part).agg(F.sum(F.length(piece)).alias(so_far))
    ahead = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    lengths = lengths.withColumn(before, F.coalesce(F.sum(so_far).over(ahead), F.lit(0))).select(F.col(key).alias(mine), F.col(part).alias(at), before, so_far)
    placed = rows.join(lengths, F.col(key).eqNullSafe(F.col(mine)) & F.col(part).eqNullSafe(F.col(at))).drop(mine, at)
    within = Window.partitionBy(key, part).orderBy(no, piece).rowsBetween(Window.unboundedPreceding, 0)
    # a range that lies before or behind the limit as a whole needs no running sum
    whole = placed.where((F.col(before) + F.col(so_far) <= max_chars) | (F.col(before) > max_chars)).withColumn(fits, F.col(before) + F.col(so_far) <= max_chars)
    crossing = placed.where((F.col(before) <= max_chars) & (F.col(before) + F.col(so_far) > max_chars))
    crossing = crossing.withColumn(fits, F.col(before) + F.sum(F.length(piece)).over(within) <= max_chars)
    kept = whole.unionByName(crossing).withColumn(piece, F.when(F.col(fits), F.col(piece)).otherwise(""))
    ranges = kept.groupBy(key, part).agg(in_range(piece).alias(piece), F.bool_and(fits).alias(fits))
    return ranges.groupBy(key).agg(by_range(piece).alias(out), (~F.bool_and(fits)).alias("truncated"))

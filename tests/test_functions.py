import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from noticeflow.functions import dates, text, urls


def values(spark, items, fn, kind="string"):
    rows = spark.createDataFrame(list(enumerate(items)), f"i int, x {kind}").select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


DATES = {
    "Monday, 01 January 2023": "2023-01-01", "Monday,  01  January 2023": "2023-01-01", "3/8/2025": "2025-03-08",
    "MARCH 05, 2024": "2024-03-05", "2024-5-3": "2024-05-03", "03-04-2024": "2024-03-04", "25-12-2023": "2023-12-25",
    "02/29/2023": None, "Mar 5, 2024": None, "March 5,2024": None, "03/28/25": "2025-03-28", "12/31/99": "2099-12-31",
    "03/28/2025 extra": "2025-03-28", "2011/5/12": "2012-11-05", "5 10 2024": "2024-05-10",
    "Issued March 5, 2024 (final)": "2024-03-05", "": None, "1/ 5/2024": "2024-01-05", "2024-10-031": None, "  3/8/2025 ": "2025-03-08",
    "05 March 2024": "2024-03-05", "March 05 2024": "2024-03-05", "99/99/2024": None, None: None,
}


def test_dates_of_known_texts(spark):
    got = values(spark, list(DATES), dates.parse_date)
    want = [v and dt.date.fromisoformat(v) for v in DATES.values()]
    # 2024-10-031: no written form, but the loose search finds 24-10-03: month 24 is none
    assert got == want


MONTHS = "January February March April May June July August September October November December".split()
WEEKDAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
#: Ways to write a day, each read as one day only.
WRITTEN = [
    lambda d: f"{d.month}/{d.day}/{d.year}", lambda d: f"{d.month:02}/{d.day:02}/{d.year}", lambda d: f"{MONTHS[d.month - 1]} {d.day}, {d.year}",
    lambda d: d.isoformat(), lambda d: f"{d.day} {MONTHS[d.month - 1].upper()} {d.year}", lambda d: f"{MONTHS[d.month - 1].lower()} {d.day:02} {d.year}",
    lambda d: f"{d.month:02}-{d.day:02}-{d.year}", lambda d: f"{WEEKDAYS[d.weekday()]}, {d.day:02} {MONTHS[d.month - 1]} {d.year}",
    lambda d: f"  {d.month}/{d.day}/{d.year}\n",
]
#: The same inside other text, where only the loose searches find it.
BURIED = [
    lambda d: f"Effective {d.month}/{d.day}/{d.year}, see below", lambda d: f"as of {d.month:02}-{d.day:02}-{d.year}.", lambda d: f"Issued on {MONTHS[d.month - 1]} {d.day}, {d.year} (final)",
    lambda d: f"rule of {d.month}/{d.day}/{d.year % 100:02} as amended",
]


def test_dates_known_by_construction(spark):
    rng = random.Random(5)
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(36_000)) for _ in range(2000)]
    texts = [rng.choice(WRITTEN + BURIED)(d) for d in days]
    assert [(t, g) for t, g, d in zip(texts, values(spark, texts, dates.parse_date), days, strict=True) if g != d] == []
    late = [d for d in days if d.day > 12]  # day first, which only a day beyond 12 tells
    assert values(spark, [f"{d.day}-{d.month}-{d.year}" for d in late], dates.parse_date) == late
    none = ["no date", "13/32/2024 x", "Foo 5, 2024", "2024", "12 of 2024", "31 June 2024"]
    assert values(spark, none, dates.parse_date) == [None] * len(none)


def test_numeric_date_text_and_labels(spark):
    assert values(spark, ["on 3/8/2025 or 4/9/2025", "x13/8/20255", "none", None], dates.numeric_date_text) == ["3/8/2025", None, None, None]
    row = spark.sql("select timestamp'2025-04-15 18:45:10' t").select(
        dates.quarter_label(F.col("t")).alias("q"), dates.snapshot_label(F.col("t")).alias("s"), dates.snapshot_label(F.col("t"), True).alias("d")
    ).first()
    assert tuple(row) == ("2025_Q2", "2025-04-15_18-45", "2025-04-15")
    assert values(spark, ["March 5, 2024", "3/5/2024", None], dates.one_form)[0] == dt.date(2024, 3, 5)


CODES = {
    "3A090.a, 3a090.A 4A090": ["3A090.a", "3a090.A", "4A090"], "3A090.a_b": ["3A090"], "5A002.A.1": ["5A002.A"],
    "12A345": [], "3A0901": [], "_3A090": [], "é3A090": [], "3A090é": [], "": [], None: [],
}


def test_codes(spark):
    assert values(spark, list(CODES), text.distinct_codes) == [sorted(v) for v in CODES.values()]


def test_codes_agree_with_re(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("3A09a.b_ é-") for _ in range(30)) for _ in range(2000)]
    got = values(spark, texts, text.codes)
    assert got == [re.findall(r"\b[0-9][A-Z][0-9]{3}(?:\.[a-z0-9]+)?\b", t, re.I) for t in texts]


def test_keywords(spark):
    match = lambda c: text.keyword_matches(c, ("PRC", "SMIC"))
    assert values(spark, ["cosmic PRCx", "none", None, ""], match) == [["PRC", "SMIC"], [], [], []]
    whole = lambda c: text.keyword_matches(c, ("PRC", "Entity List"), whole_word=True)
    assert values(spark, ["PRCx entity list.", "the prc"], whole) == [["Entity List"], ["PRC"]]
    df = spark.createDataFrame([(1, "Smic and prc"), (2, None)], "id int, title string")
    words = spark.createDataFrame([("PRC", 0), ("SMIC", 1)], "keyword string, rank int")
    got = {r["id"]: (r["flagged_keywords"], r["flagged"]) for r in text.flag_keywords_from_table(df, words).collect()}
    assert got == {1: (["PRC", "SMIC"], True), 2: ([], False)}


def test_keywords_of_a_table_are_flagged_as_those_of_a_list(spark):
    texts = ["on the Entity  List", "the entity list and cosmic PRCx", "a final Rule", None, "", "x", "military END use of ai", "ai"]
    known = (*text.KEYWORDS, "ai", "x", "")
    df = spark.createDataFrame([(None if t == "x" else i, t, "mine") for i, t in enumerate(texts)], "id int, title string, word string")
    table = spark.createDataFrame([(k, i) for i, k in enumerate(known)] + [(None, 99)], "keyword string, rank int")
    want = text.flag_keywords(df, "title", known[:-1]).collect()
    got = text.flag_keywords_from_table(df, table).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("part_size", [1, 7, 100_000])
def test_each_row_of_a_keyword_table_has_its_own_flags(spark, part_size):
    rng = random.Random(part_size)
    letters = "abAB é\U0001F600\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(150)] + ["every title has this"] * 60 + ["every title " * 2000 + "rare", None]
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(60)] + ["title", "every", "rare", "\U0001F600a", "no such piece"]
    words = list(dict.fromkeys(words))
    # no key, and one key for many rows
    df = spark.createDataFrame([(None if i % 3 else 1, t) for i, t in enumerate(texts)], "id int, title string").repartition(5)
    table = spark.createDataFrame([(k, i) for i, k in enumerate(words)], "keyword string, rank int")
    got, want = text.flag_keywords_from_table(df, table, part_size=part_size), text.flag_keywords(df, "title", words)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_keywords_are_filed_under_their_rarest_piece(spark):
    pieces = spark.createDataFrame([("abc",)] * 5 + [("bcd",)] * 2 + [("xyz",)] * 9, "gram string")
    words = spark.createDataFrame([("abcd", [0]), ("xyz", [1, 7]), ("abcq", [2])], "word string, labels array<int>")
    got = {r["word"]: (r["gram"], r["parts"], r["labels"]) for r in text.filed_keywords(pieces, words, 4).collect()}
    assert got == {"abcd": ("bcd", 1, [0]), "xyz": ("xyz", 3, [1, 7])}  # no text holds bcq
    assert {r["g"] for r in spark.range(1).select(F.explode(text.grams(F.lit("abcd"))).alias("g")).collect()} == {"abc", "bcd", "ab", "bc", "cd", "a", "b", "c", "d"}
    assert sorted(spark.range(1).select(text.grams(F.lit("ab")).alias("g")).first()["g"]) == ["a", "ab", "b"]


def test_each_list_of_matches_is_formed_once(spark):
    """``form`` runs before the lists meet the rows, and the text's pieces are made once, those that no keyword has left out before they are exchanged."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["Smic and prc", "PRC of smic", "prc", "none", "", None])], "id int, title string")
    words = spark.createDataFrame([("PRC", 0), ("SMIC", 1), ("prc", 2), ("ai", 3), (None, 4)], "keyword string, rank int")
    got = text.flag_keywords_from_table(df, words, form=text.joined)
    both, one, none = ("PRC, SMIC, prc", True), ("PRC, prc", True), ("", False)
    assert {r["id"]: (r["flagged_keywords"], r["flagged"]) for r in got.collect()} == {0: both, 1: both, 2: one, 3: none, 4: none, 5: none}
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [i for i, line in enumerate(plan) if "Join" in line]
    formed = [i for i, line in enumerate(plan) if "array_join(" in line and "collect_list(" in line]
    assert formed and joins[0] < formed[0]  # below the join with the rows
    made = [i for i, line in enumerate(plan) if "explode(" in line and "array_contains(sizes" in line]
    depth = lambda line: len(re.match(r"[ :+\-]*", line)[0])
    for i in made:  # the filter by getbit comes next to the pieces, before any other join or exchange of them
        above = [line for line in plan[:i] if depth(line) < depth(plan[i]) and ("Join" in line or "Repartition" in line)]
        assert "getbit(" in above[-1]
    assert made


def test_pieces_of_texts_that_no_keyword_has_go(spark):
    texts = [f"text {i} of many" for i in range(50)] + ["\U0001F600a", "ab", "a", ""]
    words = ["a", "\U0001F600a", "many", "7 of many", "text 41 of many", "no such text", "b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, title string")
    table = spark.createDataFrame([(k, i) for i, k in enumerate(words)], "keyword string, rank int")
    got, want = text.flag_keywords_from_table(df, table), text.flag_keywords(df, "title", words)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert {r["gram"] for r in text.cut_keywords(table.select(F.col("keyword").alias("word"), F.col("rank").alias("labels")), text.SIZES).where("labels < 4").collect()} == {
        "a", "\U0001F600a", "man", "any", "7 of m", " of ma", "of man", "f many"}


def test_topics_strip_blank_and_lists(spark):
    assert values(spark, ["RESEARCH", "ear", None, "Export Administration Regulations"], lambda c: text.topic_flag(c, "ear")) == [True, False, False, True]
    assert values(spark, ["  a b\t\n", "", None], text.strip) == ["a b", "", None]
    assert values(spark, [" \n ", "x", None], text.is_blank) == [True, False, True]


def test_assembly_in_page_order(spark):
    pages = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a"), ("u", 3, None), ("v", 1, "x")], "url string, page_no int, text string")
    assert {r["url"]: r["text"] for r in text.assemble(pages, "url", "page_no").collect()} == {"u": "ab", "v": "x"}
    cut = {r["url"]: (r["text"], r["truncated"]) for r in text.assemble(pages, "url", "page_no", max_chars=1).collect()}
    assert cut == {"u": ("a", True), "v": ("x", False)}
    odd = pages.unionByName(spark.createDataFrame([(None, 1, "n")], pages.schema)).withColumns({"fits": F.lit(1), "piece": F.lit(2)})
    for most in (None, 100):
        assert {r["url"]: r["text"] for r in text.assemble(odd, "url", "page_no", max_chars=most).collect()} == {"u": "ab", "v": "x", None: "n"}


PDF = {
    "https://h/x.pdf": True, "https://h/x.PDF": True, "https://h/a b.pdf": True, "ftp://h/x.pdf": True, "https://a_b/x.pdf": True,
    "https://[::1]/x.pdf": True, "http:///x.pdf": False, "//h/x.pdf": False, "https://h/x.pdf?y=1": False, "mailto:a.pdf": False,
    "https://[bad/x.pdf": False, "": False, None: False,
}


def test_pdf_urls(spark):
    assert values(spark, list(PDF), urls.is_pdf_url) == list(PDF.values())
    assert values(spark, ["https://h/x.PDF"], lambda c: urls.is_pdf_url(c, strict_case=True)) == [False]
    assert values(spark, ["x.pdf", "x.PDF"], lambda c: urls.is_pdf_url(c, suffix_only=True)) == [True, False]


@pytest.mark.parametrize(("mode", "want"), [
    ("always", ["B/a", "Bhttp://x", None]), ("relative", ["B/a", "http://x", None]), ("not_http", ["B/a", "http://x", None]),
])
def test_absolute_urls(spark, mode, want):
    assert values(spark, ["/a", "http://x", None], lambda c: urls.absolute(c, "B", mode)) == want


def test_file_names(spark):
    got = values(spark, ["https://h/a/b.pdf?x=/y#z", "https://h/a/", "https://h", "b.pdf"], urls.file_name)
    assert got[0] == "b.pdf" and got[3] == "b.pdf"
    assert re.fullmatch(r"pdf_[0-9a-f]{16}\.pdf", got[1]) and got[1] != got[2]


def test_long_keywords_that_share_short_pieces_meet_few_texts(spark):
    # each piece of three characters of a keyword stands in many texts, the keyword in none
    df = spark.createDataFrame([(f"Notice on 0A{k % 1000:03}.a and 5b{k * 7 % 1000:03}",) for k in range(2000)], "title string")
    table = spark.createDataFrame([(f"5B{k:04}", k) for k in range(1000, 3000)] + [("notice", 5000 + k) for k in range(3)] + [("NOTICE", 9000)], "keyword string, rank int")
    pieces = df.select(F.explode(F.concat(text.grams(F.lower("title")), text.pieces_of(F.lower("title"), 6))).alias("gram"))
    known = table.where("rank < 5000").select(F.lower("keyword").alias("word"), F.array("rank").alias("labels"))
    assert text.filed_keywords(pieces, known, sizes=text.SIZES).count() == 0  # by pieces of three all are filed
    got = text.flag_keywords_from_table(df, table).select("flagged_keywords").distinct().collect()
    assert [r[0] for r in got] == [["notice"] * 3 + ["NOTICE"]]


def test_each_written_form_gets_the_texts_that_fit_it_alone(spark):
    texts = ["7/4/2024", "07-04-2024", "2024-7-4", "July 4, 2024", "4 July 2024", "July 4 2024", "13-12-2024", "Thursday, 4 July 2024", "July 4,2024", "x"]
    for form in (*dates.FORMS, dates.WEEKDAY_FORM):
        loose = values(spark, texts, lambda c, f=form: dates.one_form(c, f))
        gated = values(spark, texts, lambda c, f=form: dates._of_form(dates._spaced(c), f))
        assert gated == loose
        fits = values(spark, texts, lambda c, f=form: c.rlike(dates._shape(f)))
        assert 1 <= sum(fits) <= 2  # before, each form tried nearly all

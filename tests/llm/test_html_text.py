import html as html_lib
import re
import sys
import time
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
import compare

from noticeflow.llm import html_text, queries


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.train(html_text.labelled_blocks(spark))


PAGES = {
    "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>A</a></ul></nav><!-- x --><div class=\"ad\">Buy this now and more words here.</div>"
    "<article><h1>Head &amp; tail</h1><p><b>One\n two<br>three<p>Four &lt;x&gt;</p></article><footer>&copy; f</footer></body></html>": "Head & tail\n\nOne two three\n\nFour <x>",
    "<body><header><h1>Site</h1></header><main><p class=lead>Lead</p><ul><li>a<li>b</ul><aside><p>no</aside><form><p>no</form><section id=comments><article><p>" + "no " * 60 + "</article></section></main><div class='cookie-notice'><p>" + "no " * 50 + "</div>":
    "Lead\n\na\n\nb",
    "<article>a < b <script>x<y</script>c<p class=ad>no<p>yes</article>": "a < b c\n\nyes",
    "<div class='site has-comments'><article><p>one</p><p>two</p></article></div>": "one\n\ntwo", "<main class='content has-sidebar'><h1>T</h1><p>short</p></main>": "T\n\nshort",
    "<article class='post share'><h1>T</h1><p>x</p><ul><li><a href=#>m1</a><li><a href=#>m2</a><li><a href=#>m3</a></ul><p>y</p></article>": "T\n\nx\n\nm1\n\nm2\n\nm3\n\ny",
    "<article><h1>T</h1><p>x</p><p><a href=#>only a link here</a></p><p>y</p></article>": "T\n\nx\n\nonly a link here\n\ny",
    "<article><p>a</p><button>go<p>rest of it</p><select>one</article>": "a\n\nrest of it",
    "<article><p>a <math><mi>x</mi><mo>+</mo><mn>1</mn></math> b</p><svg><text>label</text></svg></article>": "a x+1 b\n\nlabel",
    "<article>x<noscript>no</noscript><iframe>no</iframe><textarea>no</textarea> y<button>no</button> z</article><!-- open": "x y z",
    "<article><p>open": "open", "": "", None: "", "<p></p>": "", "</div></article><": "", "<article>" + "long " * 50_000 + "</article>": ("long " * 50_000).strip(),
    # pages without a hint, and with one that misleads
    "just plain text of a page": "just plain text of a page", "Plain text. " * 90: ("Plain text. " * 90).strip(),
    "<section><h1>Head</h1><p>Text one two three.": "Head\n\nText one two three.",
    "<div id=content><h1>Title here</h1><p>One two.</p><p>Three four five.</p></div>": "Title here\n\nOne two.\n\nThree four five.",
    "<div class='search-engine-history'><p>" + "prose words " * 65 + "</p></div>": ("prose words " * 65).strip(),
    "<body><h1>T</h1><p>An intro of ten words or so it is here.</p><p>Short.</p><ul><li>a b</li><li>c d</li></ul><p>end of it</p></body>": "T\n\nAn intro of ten words or so it is here.\n\nShort.\n\na b\n\nc d\n\nend of it",
    "<div>Home of words</div><ul><li><a href=#>a</a><li><a href=#>b c</a><li><a href=#>d</a></ul><h1>T</h1><p>" + "prose " * 40 + "</p><p>" + "prose " * 30 + "</p><ul><li><a href=#>e</a><li><a href=#>f g</a><li><a href=#>h</a></ul>": "T\n\n" + ("prose " * 40).strip() + "\n\n" + ("prose " * 30).strip(),
    # a main element that holds a menu and an advert ahead of its heading
    "<main><ul><li><a href=#>a</a><li><a href=#>b</a><li><a href=#>c</a></ul><div>Buy these now</div><h1>T</h1><p>one two three</p></main>": "T\n\none two three",
}


def test_main_text(spark, tree):
    rows = [(i, "u", h, "old") for i, h in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    out = html_text.extract(df.unionByName(df), tree).orderBy("page_id").collect()
    assert [r["text"] for r in out] == [t for t in PAGES.values() for _ in range(2)]
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert html_text.extract(df.limit(0), tree).count() == 0


def test_tree_tells_layouts_apart(tree):
    right = total = 0
    for page in html_text.labelled_pages(300, seed=99):
        found, main = html_text.labels(page)
        right += (html_text.classify(tree, html_text.features(found)) == main).sum()
        total += len(found)
    assert right / total > 0.98


def splits(tree):
    return set() if "share" in tree else {html_text.FEATURES[tree["feature"]]} | splits(tree["low"]) | splits(tree["high"])


def labelled():
    found = [html_text.labels(p) for p in html_text.labelled_pages()]
    return np.vstack([html_text.features(f) for f, _ in found]), np.concatenate([y for _, y in found])


def test_verdict_rests_on_words_links_and_neighbours(tree):
    assert {"words", "links", "kind", "text_before", "text_after", "since_title"} <= splits(tree) and {"words-1", "words+1", "links-1", "links+1"} & splits(tree)
    x, main = labelled()
    keep = html_text.classify(tree, x)
    for f in range(x.shape[1]):  # no feature alone gives it, at whatever cut
        for cut in np.unique(x[:, f]):
            agree = ((x[:, f] <= cut) == keep).mean()
            assert max(agree, 1 - agree) < 0.95
    shallow = len(html_text.SHALLOW)  # texts, links and tags of the blocks tell nine blocks of ten, the flags fewer
    right = [(html_text.classify(html_text.train_tree(part, main.astype(float)), part) == main).mean() for part in (x[:, :shallow], x[:, shallow:])]
    assert right[0] > 0.9 > right[1]


@pytest.mark.skipif(not compare.present, reason="no test tables")
def test_given_pages_without_the_flag_of_elements(spark):
    x, main = labelled()
    others = [k for k, f in enumerate(html_text.FEATURES) if f != "element"]
    tree = html_text.train_tree(x[:, others], main.astype(float))
    right = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        found = html_text.blocks(r["html"])
        inside = np.array([b.state.element == 1 for b in found])  # each of these pages has one article, and nothing else in it
        right += (html_text.classify(tree, html_text.features(found)[:, others]) == inside).sum()
        total += len(found)
    assert right / total > 0.95


def test_odd_markup_takes_linear_time():
    def seconds(piece, n):
        start = time.perf_counter()
        html_text.blocks(piece * n)
        return time.perf_counter() - start

    for piece in ("<", "<p class='", "<div>", "<div class=x>", "<!--", "&", "<p>", "<button>", "<button><p>", "<title", "<div class=x></b2>", "<svg>", "<select>a</select>", "<head>"):
        seconds(piece, 100)
        assert seconds(piece, 40_000) < 12 * seconds(piece, 10_000) + 0.2, piece


def article(page):
    """The text between the article's tags, for pages whose blocks are h1 and p."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    cut = [" ".join(html_lib.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in cut if b)


@pytest.mark.skipif(not compare.present, reason="no test tables")
def test_query_gives_every_article_exactly(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    out = queries.op3_html_text(spark, folder).collect()
    assert sorted(r["page_id"] for r in out) == sorted(pages)
    for r in out:
        assert r["url"] == pages[r["page_id"]]["url"] and r["text"] == article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])

"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at block-level tags into flat blocks of text. Each block gets shallow features: its
word count, link density, text density and kind of tag, word count, link density and kind of the two blocks before
and the two after it, and its place on the page: blocks since the last first-level heading, words outside of links before and after
it. Two plain flags come with them: the sectioning element it lies in, and whether a container's name says that
it is none of the page's text. A decision tree, trained on a small labelled table of blocks from pages of many
layouts, weighs them. In the training pages neither flag decides: main elements hold menus and adverts ahead of their heading, and
a third of the pages has no flag at all.

Defined results: a null or empty page has no text; character references are decoded, white space
inside a block becomes one space, blocks are trimmed and joined in page order by two line
breaks; nothing else is dropped, whatever the length; lists of links inside the text stay; tags that are not closed, or closed
without having been opened, are put up with: only script, style, textarea and title run to the
page's end, the label of a button or the like that is not closed ends at the next tag; pages that repeat
are extracted each; an empty table gives an empty result; further columns pass through, and columns that
have an output's name are replaced.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.llm.common import arrow_columns, sliced, with_fields

TOKENS = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<bad>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORDS_IN_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Names that say what a page has or lacks, not what a container is.
ABOUT = re.compile(r"(?:has|no|not|with|without|is|enable|disable)(?:[-_]|(?=[A-Z]))|.*[-_](?:enabled|disabled|open|closed|active)$")

#: Elements that hold raw text, up to their end tag or the page's end.
RAW = frozenset("script style textarea title".split())
#: Other elements whose content is no text of the page.
SKIPPED = frozenset("template noscript iframe canvas object audio video select datalist button head".split())
#: Elements that stay inside a line of text, those of formulas and drawings among them.
INLINE = frozenset(
    """a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter nobr output progress q rp rt ruby s samp small
    span strike strong sub sup time tt u var wbr math semantics annotation mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom menclose
    msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd svg g defs use symbol path rect circle ellipse line polyline polygon text tspan textpath""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ITEMS = frozenset(("li", "dt", "dd", "tr", "td", "th"))
#: Elements that hold no others of their kind directly; without attributes they are no containers.
LEAVES = frozenset(("p", *ITEMS, *HEADINGS))
MAIN = frozenset(("article", "main"))
ASIDE = frozenset("nav aside footer dialog menu fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Last words of a class or id that say a container is around the main text.
ASIDE_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar
    navigation menu breadcrumb breadcrumbs masthead footer sidebar aside widget related recommended recommendations share
    sharing social cookie cookies consent gdpr notice notices popup modal overlay subscribe subscription newsletter signup
    login search form pagination pager toolbar skip copyright disclaimer toc""".split()
)
#: The same for readers' comments.
COMMENT_NAMES = frozenset("comment comments commentlist commenter reply replies respond responses disqus discussion".split())
#: Words that say only where or how a container stands; the word before them is the one that counts.
PLACES = frozenset("area bar block body bottom box col column container content group inner item items left link links list page panel region right row section slot text top unit wide wrap wrapper zone".split())


class State(NamedTuple):
    """What the open containers say; a container's is made from its parent's, so a tag costs the same at any depth."""

    element: int = 0  # sectioning element: 1 main, -1 a form, -2 an aside or hidden
    name: int = 0  # named as something around the text: 1, as comments: 2
    marked: bool = False


class Block(NamedTuple):
    text: str
    words: int
    links: float
    kind: int
    state: State


#: Kinds of tags around a block's text, in this order.
TEXT, PARAGRAPH, ITEM, HEADING, TITLE = range(5)


@lru_cache(4096)
def _hints(attrs: str) -> tuple[int, bool, int]:
    """(name, "header" among the names, element) by an element's attributes."""
    at = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attrs)}
    name, header = 0, False
    for one in (n for k in ("class", "id") for n in at.get(k, "").split() if not ABOUT.match(n)):
        words = [w.lower() for w in WORDS_IN_NAME.findall(one)]
        last = next((w for w in reversed(words) if w not in PLACES), "")
        name = max(name, 2 if last in COMMENT_NAMES else int(last in ASIDE_NAMES))
        header = header or last == "header"
    style = at.get("style", "").replace(" ", "").lower()
    if "display:none" in style or at.get("aria-hidden") == "true" or re.search(r"(?:^|\s)hidden(?:\s|=|$)", attrs):
        return name, header, -2
    return name, header, 1 if at.get("role") in ("main", "article") or at.get("itemprop") == "articleBody" else -2 if at.get("role") in ASIDE_ROLES else 0


def _within(s: State, tag: str, attrs: str, mark: str | None) -> State:
    """The state inside a container that opens in ``s``: an aside holds no main element, a main element has the last word on names but those of comments."""
    hints = _hints if len(attrs) < 256 else _hints.__wrapped__
    name, header, element = hints(attrs) if attrs and tag not in ("body", "html") else (0, False, 0)
    in_main = s.element == 1
    element = element or (1 if tag in MAIN else -2 if tag in ASIDE or ((tag == "header" or header) and not in_main) else -2 if tag == "form" and in_main else -1 if tag == "form" else 0)
    label = re.search(rf"{mark}=(\d)", attrs) if mark else None
    marked = label[1] == "1" if label else s.marked
    if s.element == -2 or element == 0:
        return State(s.element, max(s.name, name), marked)
    if element == 1:
        return State(1, 2 if max(s.name, name) == 2 else s.name if in_main else 0, marked)
    return State(element, max(s.name, name), marked)


def blocks(page: str, mark: str | None = None) -> list[Block]:
    """Each flat block with text, in page order. ``mark`` is the name of an attribute that labels containers of training pages, 1 or 0."""
    out: list[Block] = []
    stack: list[tuple[str, State]] = []  # open containers
    n_open: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    in_link = heading = item = paragraph = 0
    outside = state = State()
    nexts: dict[tuple[str, str], tuple[int, int]] = {}  # of a pattern: where the last look-up began, and what it found
    at = 0
    had_head = False

    def end_block() -> None:
        nonlocal parts, linked
        text = " ".join(html_lib.unescape("".join(parts)).split())
        if text:
            n = text.count(" ") + 1
            link_words = len(html_lib.unescape(" ".join(linked)).split())
            kind = (HEADING if heading == 1 else TITLE) if heading else ITEM if item else PARAGRAPH if paragraph else TEXT
            out.append(Block(text, n, min(1.0, link_words / n), kind, state))
        parts, linked = [], []

    def text_until(end: int) -> None:
        if end > at:
            parts.append(page[at:end])
            if in_link:
                linked.append(page[at:end])

    def following(kind: str, tag: str, pattern: str) -> re.Match | int:
        """The place of the next match from here on, len(page) if there is none; each stretch of a page is searched once for a pattern."""
        begun, found = nexts.get((kind, tag), (-1, -1))
        if begun < 0 or found < at:
            m = re.compile(pattern, re.I).search(page, at)
            found = m.start() if m else len(page)
            nexts[kind, tag] = (at, found)
        return found

    def close(k: int) -> None:
        for t, _ in stack[k:]:
            n_open[t] -= 1
        del stack[k:]

    last = page.rfind(">") + 1  # behind it no tag ends, so none is looked for
    while True:
        m = TOKENS.search(page, at, last)
        if m is None:
            break
        text_until(m.start())
        at = m.end()
        if page.startswith("<!--", m.start()) and not m[0].endswith("-->"):
            at = len(page)
            break
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing = bool(m["close"] or m["bad"])
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            continue
        if tag in RAW or tag in SKIPPED:
            if not closing and not attrs.endswith("/") and not (tag == "head" and had_head):
                name = re.escape(tag)
                stop = following("close", tag, rf"</{name}\s*>")
                if tag == "head":
                    had_head = True
                    body = following("open", "body", r"<body[\s>]")
                    at = body if body < stop else stop
                elif tag in RAW or (stop < len(page) and stop <= following("open", tag, rf"<{name}[\s>]")):
                    at = stop
                else:  # not closed before the next one of its kind begins
                    at = following("any", "tag", r"<[a-zA-Z/]")
                if at == stop and stop < len(page):
                    at = page.index(">", stop) + 1
                parts.append(" ")
            continue
        end_block()
        in_link = 0
        if tag in HEADINGS:
            heading = 0 if closing else 2 if tag == "h1" else 1
        elif tag in ("p", "li"):
            heading = 0
        if tag in ITEMS:
            item = 0 if closing else 1
        elif tag in ("ul", "ol", "dl", "table"):
            item = 0
        if tag in VOID:
            continue
        paragraph = int(tag in ("p", "pre", "blockquote") and not closing)
        if stack and stack[-1][0] == "p" and not closing:
            close(len(stack) - 1)  # whatever begins a block ends a paragraph
        if (closing or tag in LEAVES) and n_open[tag]:  # an element that was not closed ends where the next of its kind begins
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag in LEAVES and stack[k][0] not in LEAVES:
                    break
        state = stack[-1][1] if stack else outside
        if not closing and not attrs.endswith("/") and (attrs or tag not in LEAVES):
            state = _within(state, tag, attrs, mark)
            stack.append((tag, state))
            n_open[tag] += 1
    rest = page.find("<!--", at)
    text_until(rest if rest >= 0 else len(page))
    end_block()
    return out


AROUND = (-2, -1, 0, 1, 2)
FEATURES = (
    *(f"{name}{at:+d}" if at else name for at in AROUND for name in ("words", "links", "kind")),
    "density", "since_title", "title_after", "text_before", "text_after", "blocks_after", "element", "name",
)
#: Those that are read off texts, links and tags of the blocks alone.
SHALLOW = FEATURES[:-2]


def features(found: Sequence[Block]) -> np.ndarray:
    """A row of FEATURES for each block of one page.

    ``density`` is words a line of 80 characters; ``since_title`` blocks since the last first-level heading, -1 ahead of the first; ``title_after`` whether
    one follows; ``text_before`` and ``text_after`` words outside of links. ``element`` is 1 in a main element, -1 outside of the page's, in asides and what is hidden, -0.5 in forms, else 0.
    """
    n = len(found)
    if not n:
        return np.empty((0, len(FEATURES)))
    own = np.array([[b.words, b.links, b.kind] for b in found], float)
    edge = np.array([[0.0, 0.0, -1.0]] * 2)
    padded = np.vstack([edge, own, edge])
    near = np.hstack([padded[2 + at : 2 + at + n] for at in AROUND])
    titles = own[:, 2] == TITLE
    place = np.arange(n)
    last = np.maximum.accumulate(np.where(titles, place, -1))
    since = np.where(last >= 0, place - last, -1)
    after = (np.cumsum(titles) < titles.sum()).astype(float)
    free = own[:, 0] * (1 - own[:, 1])
    run = np.cumsum(free)
    lines = np.array([(len(b.text) + 79) // 80 for b in found], float)
    element = np.array([b.state.element for b in found])
    name = np.array([b.state.name > 0 for b in found], float)
    has_main = bool(((element == 1) & (name == 0)).any())
    flag = np.where(element == 1, 1.0, -1.0 if has_main else np.where(element == -2, -1.0, element / 2))
    return np.hstack([near, np.column_stack([own[:, 0] / lines, since, after, run - free, run[-1] - run, n - 1 - place, flag, name])])


# ------------------------------------------------------------ decision tree


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 3) -> dict:
    """Binary splits by Gini impurity; leaves hold the share of main text."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return {"share": share}
    best = (2 * share * (1 - share) * len(y) - 1e-9, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        cuts = (v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least)
        if cuts.any():
            left, right = t[:-1] / n, (t[-1] - t[:-1]) / (len(y) - n)
            cost = np.where(cuts, 2 * left * (1 - left) * n + 2 * right * (1 - right) * (len(y) - n), np.inf)
            k = int(np.argmin(cost))
            if cost[k] < best[0]:
                best = (float(cost[k]), (f, float(v[k] + v[k + 1]) / 2))
    if best[1] is None:
        return {"share": share}
    f, cut = best[1]
    low = x[:, f] <= cut
    return {"feature": f, "cut": cut, "low": train_tree(x[low], y[low], depth - 1, least), "high": train_tree(x[~low], y[~low], depth - 1, least)}


def classify(tree: dict, x: np.ndarray) -> np.ndarray:
    """Whether each row is main text."""
    if "share" in tree:
        return np.full(len(x), tree["share"] > 0.5)
    low = x[:, tree["feature"]] <= tree["cut"]
    out = np.empty(len(x), bool)
    out[low], out[~low] = classify(tree["low"], x[low]), classify(tree["high"], x[~low])
    return out


class _Layouts:
    """Training pages of usual layouts; containers with data-main=1 hold main text, those with data-main=0 in them none."""

    WORDS = tuple("x" * k for k in range(1, 13))

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, a: int, b: int) -> str:
        """Words of one to twelve letters; only their number and length count."""
        return " ".join(self.rng.choices(self.WORDS, k=self.rng.randint(a, b)))

    def links(self, k: int) -> str:
        return "".join(f"<li><a href='#'>{self.words(1, 6)}</a></li>" for _ in range(k))

    def menu(self) -> str:
        """Links one after another, as a list or not."""
        k = self.rng.randint(2, 9)
        rows = "".join(f"<div><a href='#'>{self.words(1, 6)}</a></div>" for _ in range(k))
        return rows if self.rng.random() < 0.3 else f"<ul>{self.links(k)}</ul>"

    def aside(self, name: str = "") -> str:
        """Something that is no main text, told by an element or by ``name``."""
        rng, w = self.rng, self.words
        inner = rng.choice([w(1, 200), f"<p>{w(1, 200)}</p>", f"<ul>{self.links(rng.randint(1, 2))}</ul>", f"<h3>{w(1, 4)}</h3><p>{w(2, 120)}</p>", self.menu(), f"<p>{w(1, 6)} <a href='#'>{w(1, 6)}</a></p>"])
        if name:
            return f"<div class='{name}'>{inner}</div>"
        return rng.choice([
            f"<nav>{self.menu()}</nav>", f"<nav>{inner}</nav>", f"<aside>{inner}</aside>", f"<footer>{inner}</footer>", f"<form><p>{w(1, 20)}</p>{inner}</form>",
            f"<div role='complementary'>{inner}</div>", f"<div hidden>{inner}</div>", f"<div style='display: none'>{inner}</div>",
        ])

    def named(self) -> str:
        name = self.rng.choice(sorted(ASIDE_NAMES | COMMENT_NAMES))
        return self.aside(self.rng.choice([name, f"block-{name}", f"{name}-box wide", f"{name}Area"]))

    def cards(self) -> str:
        card = lambda: f"<article><h3><a href='#'>{self.words(2, 9)}</a></h3><p>{self.words(0, 30)}</p></article>"
        return f"<aside>{''.join(card() for _ in range(self.rng.randint(2, 4)))}</aside>"

    def comments(self) -> str:
        one = lambda tag: f"<{tag} class='{self.rng.choice(['comment', 'reply', 'comment-body'])}'><p>{self.words(1, 120)}</p></{tag}>"
        many = "".join(one(self.rng.choice(["div", "article", "li"])) for _ in range(self.rng.randint(1, 4)))
        plain = f"<article><p>{self.words(1, 120)}</p></article><article><p>{self.words(1, 120)}</p></article>"
        return self.rng.choice([many, f"<section class='comments'>{self.rng.choice([many, plain])}</section>"])

    def short(self) -> str:
        """Menus, slogans, dates, adverts and the like without any hint."""
        w = self.words
        return self.rng.choice([self.menu(), self.menu(), f"<div>{w(1, 12)}</div>", f"<div>{w(1, 5)} <a href='#'>{w(1, 8)}</a></div>", f"<div><a href='#'>{w(1, 3)}</a> | <a href='#'>{w(1, 3)}</a></div>", f"<div>{w(1, 30)}</div>"])

    def piece(self) -> str:
        """A piece of main text: long and short paragraphs, lists, also of links, tables, headings."""
        rng, w = self.rng, self.words
        return rng.choice([
            f"<p>{w(1, 4)}</p>", f"<p>{w(5, 40)}</p>", f"<p>{w(20, 200)}</p>", f"<p>{w(20, 200)}</p>", f"<p>{w(1, 90)} <a href='#'>{w(1, 6)}</a> {w(0, 40)}</p>", f"<div>{w(1, 90)}</div>", w(1, 60),
            f"<p><a href='#'>{w(1, 9)}</a></p><p>{w(1, 60)}</p>", f"<h2>{w(1, 8)}</h2><p>{w(1, 80)}</p>", f"<ul>{''.join(f'<li>{w(1, 25)}</li>' for _ in range(3))}</ul>", f"<p>{w(1, 60)}</p><p><a href='#'>{w(1, 9)}</a></p><p>{w(1, 60)}</p>",
            f"<p>{w(1, 60)}</p><ul>{self.links(rng.randint(1, 6))}</ul><p>{w(1, 60)}</p>", f"<p><b>{w(1, 9)}<br><p>{w(10, 90)}</p>",
            f"<table><tr><td>{w(1, 4)}</td><td>{w(1, 9)}</td></tr></table>", f"<blockquote><p>{w(5, 60)}</p></blockquote>",
        ])

    def body(self, hinted: bool, titled: bool = True, header: bool = False) -> str:
        """A heading, if ``titled``, in a ``header`` or not, and pieces; where the page hints, with asides, names and comments among them."""
        rng = self.rng
        title = f"<h1>{self.words(1, 14)}</h1>"
        out = [rng.choice([title, title, title, f"<header>{title}<p>{self.words(1, 8)}</p></header>" if header else title]) if titled else ""]
        out += [self.piece() for _ in range(rng.randint(1, 9))]
        if hinted:
            for extra in (self.aside, self.named, self.comments):
                if rng.random() < 0.25:
                    out.insert(rng.randint(1, len(out)), f"<div data-main=0>{extra()}</div>")
        return "".join(out)

    def untitled(self) -> str:
        """Text without a heading of the first level: it shows by its words."""
        rng, w = self.rng, self.words
        return "".join([f"<p>{w(15, 90)}</p>", *(rng.choice([f"<p>{w(25, 150)}</p>", f"<p>{w(15, 90)} <a href='#'>{w(1, 3)}</a> {w(10, 40)}</p>", f"<h2>{w(1, 8)}</h2><p>{w(25, 90)}</p>"]) for _ in range(rng.randint(1, 8)))])

    def plain(self) -> str:
        """A page of text and next to nothing else."""
        rng, w = self.rng, self.words
        title = f"<h1>{w(1, 9)}</h1>"
        few = "".join(f"<p>{w(1, 30)}</p>" for _ in range(rng.randint(1, 6)))
        return rng.choice([
            f"<div data-main=1>{rng.choice([w(4, 20), w(4, 300)])}</div>", f"<section data-main=1>{title}{few}</section>", f"<div id=content data-main=1>{title}{few}</div>", f"<div data-main=1>{few}</div>",
            f"<div class='{rng.choice(['search-engine-history', 'form-of-life', 'menu-prices'])}' data-main=1>{title}<p>{w(60, 200)}</p></div>", f"<div data-main=1>{self.body(False)}</div>",
        ])

    def page(self, kind: int) -> str:
        rng = self.rng
        if kind == 2:  # nothing but words, links and tags
            choice = rng.random()
            if choice < 0.05:  # no text at all but a few words or links
                return f"<html><body>{rng.choice([self.words(1, 3), self.menu(), self.short() + self.menu()])}</body></html>"
            if choice < 0.3:
                return f"<html><body>{self.plain()}</body></html>"
            inner = self.untitled() if choice < 0.5 else self.body(False)
            before = "".join(self.short() for _ in range(rng.randint(1, 4)))
            end = "".join(f"<div>{self.words(1, 12)}</div>" if rng.random() < 0.5 else self.menu() for _ in range(rng.randint(0, 3)))
            return f"<html><body>{before}<div data-main=1>{inner}</div>{end}</body></html>"
        if kind == 0 and rng.random() < 0.2:  # a main element of a few lines
            lines = [f"<h1>{self.words(1, 8)}</h1>"] * rng.randint(0, 1)
            for _ in range(rng.randint(1, 5)):
                lines.append(rng.choice([f"<p>{self.words(1, 8)}</p>", f"<div>{self.words(1, 8)}</div>", f"<p><a href='#'>{self.words(1, 8)}</a></p>", f"<ul>{self.links(rng.randint(1, 5))}</ul>"]))
            return f"<html><body><article data-main=1>{''.join(lines)}</article></body></html>"
        if kind == 0:  # main elements, some with names that mislead, some that hold menus and adverts too
            tag = rng.choice(["article", "main", "div role='main'", "article class='post'", "article class='post share'", "main class='content has-sidebar'", "section itemprop='articleBody'"])
            ahead = "".join(self.short() for _ in range(rng.randint(1, 3))) if rng.random() < 0.5 else ""
            main = f"<{tag} data-main=1><div data-main=0>{ahead}</div>{self.body(True, header=True)}</{tag.split()[0]}>" if ahead else f"<{tag} data-main=1>{self.body(True, rng.random() < 0.5, header=True)}</{tag.split()[0]}>"
        else:  # asides by elements and names, the text by itself
            main = f"<div class='{rng.choice(['post', 'entry', 'story', 'article-text', 'post-body'])}' data-main=1>{self.body(True)}</div>"
        wrap = rng.choice(["{}"] * 4 + ["<div class='site no-sidebar has-comments'>{}</div>", "<form>{}</form>"] + ["<div class='banner widget'>{}</div>"] * (kind == 0))
        around = [rng.choice([self.aside, self.named, self.comments, self.cards])() for _ in range(rng.randint(2, 6))]
        rng.shuffle(around)
        cut = rng.randint(0, len(around))
        if kind == 0:  # a page with a main element may have anything around it
            around.append(rng.choice([f"<p>{self.words(1, 60)}</p>", self.menu(), f"<div>{self.words(1, 30)}</div>"]))
        first = [self.short()] * (rng.random() < 0.6)
        if rng.random() < 0.4:
            first.append(f"<header>{rng.choice([f'<h1>{self.words(1, 5)}</h1>', f'<h2>{self.words(1, 5)}</h2>'])}</header>")
        return f"<html><body>{''.join(first + around[:cut])}{wrap.format(main)}{''.join(around[cut:])}</body></html>"


def labelled_pages(n: int = 2000, seed: int = 7) -> list[str]:
    """Pages of usual layouts: a third have main elements, a third asides and names alone, the others nothing but words, links and tags."""
    make = _Layouts(seed)
    return [make.page(k % 3) for k in range(n)]


def labels(page: str) -> tuple[list[Block], np.ndarray]:
    """A training page's blocks, and for each whether it is main text: whether the nearest container with data-main says 1."""
    found = blocks(page, "data-main")
    return found, np.array([b.state.marked for b in found], bool)


def labelled_blocks(spark: SparkSession, pages: Sequence[str] | None = None) -> DataFrame:
    """The labelled table: FEATURES and main (0/1) of each block of the training pages."""
    found = [labels(page) for page in pages or labelled_pages()]
    x = np.vstack([np.empty((0, len(FEATURES))), *[features(f) for f, _ in found]])
    columns = {f: pa.array(x[:, k]) for k, f in enumerate(FEATURES)}
    return spark.createDataFrame(pa.table({**columns, "main": pa.array(np.concatenate([y for _, y in found]).astype(np.int32))}))


#: Rows of a labelled table that a tree is trained on; it is meant to be small.
MAX_LABELLED = 100_000


def train(labelled: DataFrame, depth: int = 12) -> dict:
    """The tree of a labelled table of at most MAX_LABELLED rows."""
    rows = labelled.select(*(F.col(f"`{f}`") for f in FEATURES), "main").limit(MAX_LABELLED + 1).toPandas()
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"more than {MAX_LABELLED} labelled blocks")
    return train_tree(rows[list(FEATURES)].to_numpy(float), rows["main"].to_numpy(float), depth)


def _extract(batches: Iterator[pa.RecordBatch], tree: dict, html: str, text: str, n_chars: str) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        found = [blocks(h) if h else [] for h in batch.column(html).to_pylist()]
        keep = classify(tree, np.vstack([np.empty((0, len(FEATURES))), *[features(f) for f in found]]))
        texts, at = [], 0
        for f in found:
            texts.append("\n\n".join(b.text for b, k in zip(f, keep[at : at + len(f)], strict=True) if k))
            at += len(f)
        add = {text: pa.array(texts, pa.string()), n_chars: pa.array([len(t) for t in texts], pa.int64())}
        yield arrow_columns(batch, add, drop=[html] if html != text else [])


def extract(pages: DataFrame, tree: dict, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` with the main text and its length in code points in place of the html. ``tree`` comes from ``train``."""
    schema = with_fields(pages, {text: T.StringType(), n_chars: T.LongType()}, drop=[html] if html != text else [])
    return pages.mapInArrow(partial(_extract, tree=tree, html=html, text=text, n_chars=n_chars), schema)

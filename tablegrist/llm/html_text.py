"""Main text of web pages by boosted trees over elements and tree decoding.

Each element has features of itself, its subtree, its ancestors and its siblings.
Boosted trees give the odds that it belongs to the main text. Decoding picks the
likeliest labelling of the whole tree in which nothing contradicts: a container
holds main text somewhere, main text may have parts cut out, and what is cut out
holds no main text again.

The trees are fitted on pages composed of the table's own paragraphs (a bounded
sample) in varied layouts with known main text, besides the usual page parts:
menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegrist.llm.boosted import BoostedTrees
from tablegrist.llm.dom import HIDDEN, Page, blocks, read_page
from tablegrist.session import cut_lineage

#: Pages whose paragraphs are used for fitting, the number and size of paragraphs
#: taken from each, and the number of pages composed of them.
SAMPLE_PAGES, SAMPLE_BLOCKS, SAMPLE_CHARS = 300, 12, 600
COMPOSED = 1300

#: Elements inside a line of text. They have no label of their own: without a block
#: inside they share that of the block they stand in.
PHRASING = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)


def parts_of(page: Page) -> list[tuple[str, ...]]:
    """The tokens of each element: its name and the words of class, id and role."""
    out = []
    for tag, attributes in zip(page.tag, page.attributes):
        words = {f"<{tag}>"}
        for name in ("class", "id", "role", "itemprop", "aria-label"):
            if attributes.get(name):
                words.update(w for w in re.findall(r"[a-z]+", _uncamel(attributes[name])) if len(w) > 1)
        out.append(tuple(words))
    return out


def _uncamel(text: str) -> str:
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "-", text).lower()


def features(page: Page, odds: dict[str, float]) -> np.ndarray:
    """One row for each element. Subtrees are runs of elements in page order, so
    their sums are differences of running sums."""
    n = len(page.tag)
    parent, end = np.array(page.parent), np.array(page.end)
    chars, links, stops, pieces = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    in_link = np.zeros(n, bool)
    own_odds = np.zeros((n, 2))
    above = np.zeros((n, 2))
    depth = np.zeros(n)
    for i, words in enumerate(parts_of(page)):
        known = [odds.get(w, 0.0) for w in words]
        own_odds[i] = min(0.0, *known), max(0.0, *known)
        if i:
            p = page.parent[i]
            depth[i] = depth[p] + 1
            in_link[i] = in_link[p] or page.tag[i] == "a"
            above[i] = min(above[p, 0], own_odds[p, 0]), max(above[p, 1], own_odds[p, 1])
    for piece in page.flow:
        if piece is not None:
            i, text = piece
            size = len(text)
            chars[i] += size
            pieces[i] += 1
            stops[i] += text.count(".") + text.count(",")
            if in_link[i]:
                links[i] += size
    inside = lambda v: (s := np.concatenate([[0.0], np.cumsum(v)]))[end] - s[np.arange(n)]
    all_chars, all_links, all_stops, size = inside(chars), inside(links), inside(stops), end - np.arange(n)
    before = np.concatenate([[0.0], np.cumsum(chars)])[:n]
    total = max(1.0, all_chars[0])
    up = np.maximum(parent, 0)
    siblings = np.bincount(up[1:], minlength=n)[up] if n > 1 else np.ones(n)
    order = np.zeros(n)
    seen: dict[int, int] = {}
    for i in range(1, n):
        order[i] = seen.get(page.parent[i], 0)
        seen[page.parent[i]] = seen.get(page.parent[i], 0) + 1
    return np.column_stack([
        own_odds, above, depth, siblings, order, order / np.maximum(1, siblings),
        np.log1p(chars), np.log1p(all_chars), all_chars / total, all_chars / size,
        all_links / np.maximum(1, all_chars), all_stops / np.maximum(1, all_chars), np.log1p(size),
        before / total, all_chars / np.maximum(1, all_chars[up]), in_link,
        np.log1p(all_chars[up]), all_links[up] / np.maximum(1, all_chars[up]),
    ])


#: Parts of a list, table or figure go with the whole one, unless they hold blocks
#: of another kind, as cells of a layout do.
PARTS = frozenset("li dt dd tr td th thead tbody tfoot caption colgroup col figcaption".split())
IN_PARTS = PHRASING | PARTS | frozenset("ul ol dl".split())


def follows(page: Page) -> np.ndarray:
    """For each element whether it has the label of the element around it: parts of
    a line, with nothing else below, and plain parts of a list, table or figure."""
    n = len(page.tag)
    end = np.array(page.end)

    def only(names: frozenset[str]) -> np.ndarray:
        before = np.concatenate([[0], np.cumsum([t not in names for t in page.tag])])
        return before[end] == before[np.arange(n)]

    found = only(PHRASING) | np.array([t in PARTS for t in page.tag]) & only(IN_PARTS)
    found[0] = False
    return found


def decoded(page: Page, log_odds: np.ndarray) -> np.ndarray:
    """For each element whether it is main text. The best labelling of every
    subtree is found from the leaves up: cut (nothing below is main), container
    (not main, anything below) or main (below main or cut). What ``follows`` the
    element around it has its label."""
    n = len(page.tag)
    yes, no = -np.logaddexp(0, -log_odds), -np.logaddexp(0, log_odds)
    for i, tag in enumerate(page.tag):
        if tag in HIDDEN or tag in ("head", "title"):
            yes[i] = -1e9
    in_line = follows(page)
    yes[in_line] = no[in_line] = 0.0
    cut, container, main = no.tolist(), no.tolist(), yes.tolist()
    parent = page.parent
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if in_line[i]:
            continue
        cut[p] += cut[i]
        container[p] += max(container[i], main[i], cut[i])
        main[p] += max(main[i], cut[i])
    state = [0] * n  # 0 cut, 1 container, 2 main
    state[0] = 1
    for i in range(1, n):
        up = state[parent[i]]
        if in_line[i]:
            state[i] = up
        elif up == 2:
            state[i] = 2 if main[i] >= cut[i] else 0
        elif up == 1:
            best = max(container[i], main[i], cut[i])
            state[i] = 2 if main[i] == best else 1 if container[i] > cut[i] else 0
    return np.array(state) == 2


@dataclass
class PageModel:
    odds: dict[str, float]
    trees: BoostedTrees

    def texts(self, pages: list[str | None]) -> list[str]:
        read = [read_page(h or "") for h in pages]
        x = [features(p, self.odds) for p in read]
        scores = self.trees.log_odds(np.concatenate(x))
        out, at = [], 0
        for p in read:
            n = len(p.tag)
            out.append("\n".join(blocks(p, decoded(p, scores[at : at + n]))))
            at += n
        return out


def fitted(paragraphs: list[str], seed: int = 5) -> PageModel:
    """A model from pages composed of ``paragraphs``."""
    compose = _Composer(paragraphs or ["a", "text"], random.Random(seed))
    pages, truth = [], []
    for _ in range(COMPOSED):
        page = read_page(compose.page())
        inside = [False] * len(page.tag)
        for i in range(1, len(page.tag)):
            mark = page.attributes[i].pop("data-part", None)
            inside[i] = inside[page.parent[i]] if mark is None else mark == "main"
        pages.append(page)
        truth.append(np.array(inside))
    # Odds of tokens from one half of the pages, so that the trees, fitted on the
    # other half, see them as they are on pages that gave no odds.
    half = len(pages) // 2
    count: dict[str, list[float]] = {}
    for page, inside in zip(pages[:half], truth[:half]):
        for words, is_main in zip(parts_of(page), inside):
            for w in words:
                count.setdefault(w, [1.0, 1.0])[int(is_main)] += 1
    odds = {w: float(np.log(c[1] / c[0])) for w, c in count.items() if sum(c) >= 5}
    x = np.concatenate([features(p, odds) for p in pages[half:]])
    y = np.concatenate(truth[half:]).astype(np.float64)
    return PageModel(odds, BoostedTrees().fit(x, y))


class _Composer:
    """Pages in varied layouts; ``data-part`` marks what is main and what is not."""

    MAIN = [
        "article", "main", 'article class="post"', 'div class="content"', 'div id="content"',
        'div class="post-body"', 'div class="entry-content"', 'section class="article-body"',
        'div class="story"', 'div id="main"', 'div role="main"', 'div class="article-text"', "div",
        'section class="main-content"', 'div itemprop="articleBody"',
    ]
    SHORT = {
        "ad": ['div class="ad"', 'div class="advert"', 'div id="ads"', 'aside class="advertisement"',
               'div class="sponsored"', 'div class="banner-ad"', 'div class="promo"', 'section class="sponsor"'],
        "notice": ['div class="cookie-notice"', 'div id="cookie-consent"', 'div class="notice"', 'div role="alert"',
                   'div class="gdpr-banner"', 'div class="alert"', 'p class="disclaimer"', 'div class="notification"'],
        "side": ["aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"', 'div class="related"',
                 'section class="recommended"', 'div class="share"', 'div class="social"', 'div class="newsletter"',
                 'aside class="sidebar-right"'],
        "footer": ["footer", 'div class="footer"', 'div id="footer"', 'div class="copyright"', 'footer class="site-footer"'],
        "header": ["header", 'div class="header"', 'div id="masthead"', 'header class="site-header"', 'div class="topbar"'],
    }
    LISTS = ["nav", 'ul class="menu"', 'div class="nav"', 'div id="navigation"', 'nav class="main-nav"',
             'div class="breadcrumb"', 'ul class="pagination"', 'div class="tags"', 'div role="navigation"']
    COMMENTS = ['div class="comments"', 'section id="comments"', 'div class="comment-list"', 'ol class="replies"',
                'div id="disqus_thread"', 'section class="reader-comments"', 'div class="discussion"']

    def __init__(self, paragraphs: list[str], rng: random.Random):
        self.paragraphs, self.rng = paragraphs, rng

    def words(self, most: int) -> str:
        text = self.rng.choice(self.paragraphs).split()
        at = self.rng.randrange(len(text)) if text else 0
        return escape(" ".join(text[at : at + self.rng.randint(1, most)]) or "a")

    def paragraph(self) -> str:
        r = self.rng
        text = escape(r.choice(self.paragraphs)) if r.random() < 0.7 else self.words(25)
        if r.random() < 0.25:
            text = r.choice([
                f"<b>{text}</b>", f"{text} <a href='#'>{self.words(4)}</a> {self.words(8)}",
                f"{self.words(5)} <em>{self.words(3)}</em>, <code>{self.words(2)}</code> <a href='/x'>{self.words(4)}</a>.",
                f"<span>{text}</span> <sup>1</sup>", f"<a href='/y'>{self.words(6)}</a>",
            ])
        kind = r.random()
        if kind < 0.6:
            return f"<p>{text if r.random() < 0.85 else self.words(5)}</p>"
        if kind < 0.7:
            return f"<p><b>{text}<br>"
        if kind < 0.85:
            item = lambda: f"<a href='/z'>{self.words(5)}</a>" if links else self.words(8)
            links, rows = r.random() < 0.65, r.randint(1, 5)
            return r.choice([
                lambda: "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(rows)) + "</ul>",
                lambda: "<ol>" + "".join(f"<li>{item()}" for _ in range(rows)) + "</ol>",
                lambda: "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(rows)) + "</ul>",
                lambda: f"<table><caption>{self.words(5)}</caption><tr><th>{self.words(2)}</th><th>{self.words(2)}</th></tr>"
                + "".join(f"<tr><td>{item()}</td><td>{r.randrange(999)}</td></tr>" for _ in range(rows)) + "</table>",
                lambda: f"<figure><img src=i.png><figcaption>{self.words(9)}</figcaption></figure>",
                lambda: "<dl>" + "".join(f"<dt>{self.words(2)}</dt><dd>{item()}</dd>" for _ in range(rows)) + "</dl>",
                lambda: f"<h3>{self.words(5)}</h3>", lambda: f"<pre><code>{self.words(12)}</code></pre>",
            ])()
        return r.choice(["<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li><li>x</li></ul>", "<div>{}</div>",
                         "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>"]).format(text)

    def tagged(self, start: str, body: str, part: str) -> str:
        return f'<{start} data-part="{part}">{body}</{start.split()[0]}>'

    def other(self) -> str:
        r = self.rng
        kind = r.random()
        if kind < 0.3:
            links = [f'<a href="/{i}">{self.words(3)}</a>' for i in range(r.randint(2, 8))]
            body = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if r.random() < 0.8 else " ".join(links)
            return self.tagged(r.choice(self.LISTS), body, "cut")
        if kind < 0.4:
            body = f"<label>{self.words(4)}</label><input name=q><button>{self.words(2)}</button>"
            return self.tagged(r.choice(["form", 'form class="search"', 'form id="login"']), body, "cut")
        if kind < 0.55:
            each = lambda: f'<div class="comment"><span class="author">{self.words(2)}</span>{self.paragraph()}</div>'
            return self.tagged(r.choice(self.COMMENTS), "".join(each() for _ in range(r.randint(1, 4))), "cut")
        start = r.choice(self.SHORT[r.choice(list(self.SHORT))])
        if start.startswith("p "):
            body = self.words(30)
        else:
            body = r.choice([self.words(30), self.paragraph(), f"<h1>{self.words(3)}</h1>", f"<h1><a href='/'>{self.words(3)}</a></h1>", f"<p>{self.words(40)}</p><a href='#'>{self.words(3)}</a>",
                             f"<h3>{self.words(4)}</h3><ul><li>{self.words(5)}</li><li>{self.words(5)}</li></ul>",
                             f"&copy; {self.words(20)}"])
        return self.tagged(start, body, "cut")

    def loose(self) -> str:
        """A page or fragment with main text in the body itself."""
        r = self.rng
        own = lambda: escape(r.choice(self.paragraphs)) if r.random() < 0.6 else self.words(25)
        if r.random() < 0.35:  # nothing but a few words
            few = self.words(8) + r.choice(["", " &amp; more", "<br>"])
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                few = r.choice([f"{few} <p>{self.words(4)}</p> {self.words(4)}", f"<p>{self.words(3)}</p>{few}", f"<h2>{self.words(3)}</h2>{few}"])
            return f'<html><body data-part="main">{few}</body></html>'
        inner = [own() + r.choice(["", "\n", "<br><br>"])]
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            inner.insert(r.randrange(len(inner) + 1), r.choice([own, self.paragraph])() + r.choice(["", "\n", "<br>"]))
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            inner.insert(r.randrange(len(inner) + 1), self.other())
        head = r.choice(["", f"<head><title>{self.words(9)}</title></head>"])
        return f'<html>{head}<body data-part="main">{"".join(inner)}</body></html>'

    def page(self) -> str:
        r = self.rng
        if r.random() < 0.15:
            return self.loose()
        inner = [self.paragraph() for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 14]))]
        if r.random() < 0.7:
            title = f"<h1>{self.words(10)}</h1>"
            if r.random() < 0.35:
                title = f"<header>{title}{r.choice(['', f'<p>{self.words(6)}</p>', f'<time>{self.words(2)}</time>'])}</header>"
            inner.insert(0, title)
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            inner.insert(r.randrange(len(inner) + 1), self.other())
        core = self.tagged(r.choice(self.MAIN), "".join(inner), "main")
        # Every fifth page is nothing but its main text.
        most = r.choice([0, 4, 4, 4, 4])
        before = [self.other() for _ in range(r.randint(0, most))]
        after = [self.other() for _ in range(r.randint(0, most))]
        if r.random() < 0.3:
            wrap = r.choice(["div", 'div class="wrapper"', 'div id="page"', 'div class="container"', 'main class="site"'])
            core = f"<{wrap}>{''.join(before[:1])}{core}{''.join(after[:1])}</{wrap.split()[0]}>"
            before, after = before[1:], after[1:]
        if r.random() < 0.1:
            before.insert(0, f"{self.words(4)} ")
        if r.random() < 0.3:
            name = r.choice(["{}", "<a href='/'>{}</a>"]).format(self.words(3))
            before.insert(0, self.tagged(r.choice(self.SHORT["header"]), f"<h1>{name}</h1>", "cut"))
        head = f"<head><title>{self.words(9)}</title><style>p{{}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{core}{''.join(after)}</body></html>"


def fit(pages: DataFrame, html: str = "html", sample: int = SAMPLE_PAGES) -> PageModel:
    """A model from the paragraphs of ``sample`` pages, chosen by a hash of their
    html; at most SAMPLE_BLOCKS of each, of at most SAMPLE_CHARS characters, come
    to the driver."""
    rows = pages.select(F.col(html).alias("html"), F.xxhash64(html).alias("rank")).filter("length(html) > 0")
    ranks = [r[0] for r in rows.select("rank").distinct().orderBy("rank").limit(sample).collect()]
    chosen = rows.filter(F.col("rank") <= (max(ranks) if ranks else 0)).select("html")

    def paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for h in batch.column("html"):
                page = read_page(h.as_py())
                shown = [t not in HIDDEN and t not in ("head", "title") for t in page.tag]
                long_first = sorted(blocks(page, shown), key=lambda b: (-len(b), b))[:SAMPLE_BLOCKS]
                found += [b[:SAMPLE_CHARS] for b in long_first]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["text"])

    texts = cut_lineage(chosen.mapInArrow(paragraphs, "text string").distinct()).toArrow().column("text").to_pylist()
    return fitted(sorted(texts))


def with_main_text(pages: DataFrame, model: PageModel, html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the blocks of main text joined by line breaks.

    Null and empty html and pages without main text have an empty text. Repeated
    rows are extracted alike. A column ``text`` of ``pages`` is replaced.
    """
    kept = [c for c in pages.columns if c.lower() != "text"]
    shipped = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def extract(html):
        import pandas as pd

        texts: list[str] = []
        for at in range(0, len(html), 32):
            texts += shipped.value.texts(html.iloc[at : at + 32].tolist())
        return pd.Series(texts, dtype=object)

    return pages.select(*[F.col(f"`{c}`") for c in kept], extract(F.col(html)).alias("text"))

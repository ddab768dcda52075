"""A small HTML reader: elements in page order with what extraction needs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; of the first ones it is no text either.
HIDDEN = frozenset("script style noscript template iframe svg math object".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead title tr ul option select button textarea".split()
)
#: A start tag ends open elements of these names, up to the nearest of the bounds.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "body": (("head",), ("html",)),
}
#: Elements that open no body; all others and text outside a body do.
NO_BODY = frozenset("html head body title base link meta style script noscript template".split())
NO_P_INSIDE = BLOCKS - frozenset("body html head td th tr caption li dd dt option select button textarea legend title".split())
P_BOUNDS = frozenset("button td th caption table body html object".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>", re.S
)
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@dataclass
class Page:
    """Elements in page order; element 0 is the page. ``end`` is the first
    element behind an element's own ones."""

    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    end: list[int] = field(default_factory=lambda: [0])
    attributes: list[dict[str, str]] = field(default_factory=lambda: [{}])
    #: Texts with their element, and None where a block begins or ends.
    flow: list[tuple[int, str] | None] = field(default_factory=list)


def read_page(html: str) -> Page:
    page, stack = Page(), [0]
    at, size = 0, len(html)
    #: Where in the stack elements of each name are open, so that no tag walks it.
    open_at: dict[str, list[int]] = {"": [0]}
    last_end = html.rfind(">")

    def close(down_to: int) -> None:
        """Close open elements until ``down_to`` of them are left."""
        while len(stack) > down_to:
            i = stack.pop()
            open_at[page.tag[i]].pop()
            page.end[i] = len(page.tag)
            if page.tag[i] in BLOCKS:
                page.flow.append(None)

    def open_place(names, bounds) -> int:
        """Number of open elements before the innermost one of ``names``, or 0."""
        innermost = lambda among: max((open_at[t][-1] for t in among if open_at.get(t)), default=0)
        k = innermost(names)
        return k if k and k >= innermost(bounds) else 0

    def begin(name: str, attributes: dict[str, str]) -> int:
        if name in BLOCKS:
            page.flow.append(None)
        i = len(page.tag)
        page.tag.append(name)
        page.parent.append(stack[-1])
        page.end.append(i + 1)
        page.attributes.append(attributes)
        if name not in VOID:
            open_at.setdefault(name, []).append(len(stack))
            stack.append(i)
        return i

    def body() -> None:
        """Open the html and body that the page leaves out, if outside a body."""
        if page.tag[stack[-1]] == "head":
            close(len(stack) - 1)
        if len(stack) == 1:
            begin("html", {})
        if page.tag[stack[-1]] == "html":
            begin("body", {})

    def text(upto: int) -> None:
        if upto > at:
            if len(stack) <= 3 and page.tag[stack[-1]] in ("", "html", "head") and html[at:upto].strip():
                body()
            page.flow.append((stack[-1], unescape(html[at:upto])))

    last_quote = max(html.rfind('"'), html.rfind("'"))
    search = 0
    while True:
        start = html.find("<", search)
        if start > last_end and html.startswith("<!--", start):
            text(start)  # a comment that nothing ends
            break
        if start < 0 or start > last_end:
            text(size)
            break
        m = _MARKUP.match(html, start)
        if m is None and start <= last_quote:
            m = _LOOSE.match(html, start)  # a quote that nothing closes
        if m is None:
            search = start + 1
            continue
        text(start)
        at = search = m.end()
        name = m[2] and m[2].lower() if m.re is _MARKUP or m.re is _LOOSE else None
        if not name:
            continue
        if m[1] and name in ("html", "body"):
            page.flow.append(None)  # what follows belongs to them still
            continue
        if m[1]:
            k = open_place((name,), ("td", "th", "table") if name not in ("td", "th", "tr", "table", "body", "html") else ())
            if k:
                close(k)
            elif name == "p":
                page.flow.append(None)
            continue
        if name in NO_P_INSIDE:
            k = open_place(("p",), P_BOUNDS)
            if k:
                close(k)
        if name in ENDS:
            k = open_place(*ENDS[name])
            if k:
                close(k)
        attributes = {
            a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(m[3])
        } if m[3] else {}
        if name not in NO_BODY and page.tag[stack[-1]] in ("", "html", "head"):
            body()
        elif name == "body" and len(stack) == 1:
            begin("html", {})
        if name in ("html", "body"):
            again = next((i for i in stack[1:3] if page.tag[i] == name), None)
            if again is not None:
                page.attributes[again] = attributes | page.attributes[again]
                continue
        i = begin(name, attributes)
        if name in VOID:
            if name == "br":
                page.flow.append((i, " "))
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at, last_end + 1)
            upto = stop.start() if stop else size
            if name not in HIDDEN:
                text(upto)
            at = search = stop.end() if stop else size
            close(len(stack) - 1)
    close(0)
    return page


def blocks(page: Page, chosen) -> list[str]:
    """Texts of the blocks, of the elements for which ``chosen`` is true, each
    with single blanks inside, without empty ones."""
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        words = " ".join("".join(part).split())
        if words:
            out.append(words)
        part.clear()

    for piece in page.flow:
        if piece is None:
            if part:
                flush()
        elif chosen[piece[0]]:
            part.append(piece[1])
    flush()
    return out

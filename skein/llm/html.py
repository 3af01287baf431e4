"""Main-text extraction by line-block distribution.

Markup is stripped to lines, one for each block of the page. A line weighs its text length; text of links weighs nothing
where the page marks no article. Lines that HTML itself says are no article text (menus, page headers and footers, asides,
forms, hidden parts, boxes named for nothing else) and lines outside an article that the page marks part the page into
segments. Weights are summed over sliding windows of lines: a region surges where the sums rise above zero and dives where
they fall back to it, as they do in a run of lines without text of their own. A box whose name only hints at something
else is judged by its windows: it stays if they surge like those of the page, and goes if they stay flat.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import strings

#: Lines in a window.
WINDOW = 3
#: A box whose name hints at no article text is kept if one of its windows holds this share of the page's highest window,
#: or this many characters.
SURGE_SHARE, SURGE_CHARS = 0.25, 400

# Fixed values of HTML: elements whose content is no text, elements without content, inline elements.
RAW = "script style noscript template iframe svg object canvas audio video textarea select title".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
# Elements and roles that hold no article text; words in class and id that name such boxes.
BOXES = set("nav footer aside form button menu dialog fieldset head".split())
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
WORDS = set(
    """ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies
    consent gdpr notice notices sidebar sidenav menu menus nav navbar navigation navi breadcrumb breadcrumbs footer header
    masthead topbar comment comments commentlist disqus reply replies respond share sharing social related recommended
    newsletter subscribe subscription signup login popup modal overlay widget widgets toolbar pagination pager commentbox
    commentsection alert alerts copyright legal search searchbox searchform backtotop skiplink outbrain taboola adslot
    adsbygoogle adbox""".split()
)
STARTS = ("advert", "sponsor", "cookie", "newsletter", "sidebar", "breadcrumb", "subscri")
#: Words that say nothing of what a box holds.
PLAIN = set(
    """box boxes container wrapper wrap inner outer slot unit area block panel section bar list item items group row col column
    site page main body top bottom left right center global primary secondary sticky fixed mobile desktop mini small large
    content contents text post posts article articles entry story stories links link icons icon buttons button form field
    input title label heading count tools results result module component region view zone layer holder placeholder frame
    logo image img news feed""".split()
)
#: With one of these, a box named header or banner is an article's own heading.
HEADINGS, OWN = set("header banner masthead".split()), set("article post entry story content".split())
OF_ARTICLES = WORDS - set("header menu nav sidebar banner notice notices widget share social subscription".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^<>]*)>|<[!?/][^<>]*>",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _named(value: str, words: set[str], inside: bool) -> int:
    """What a class or id says: 2 a box without article text, and nothing else; 1 a hint at one; 0 nothing. A word hints
    where it is the last that says anything: a share price is a price."""
    said = [w.lower() for w in _WORD.findall(value)]
    of_box = [w in words or w.startswith(STARTS) for w in said]
    hit = {w for w, b in zip(said, of_box, strict=True) if b}
    if not hit or (hit <= HEADINGS and (inside or OWN.intersection(said))):
        return 0
    telling = [b for w, b in zip(said, of_box, strict=True) if b or (w not in PLAIN and len(w) > 1)]
    return 2 if all(telling) else int(telling[-1] or any(w.startswith(STARTS) for w in said))


def _boxed(name: str, attrs: str, inside: bool) -> int:
    """Whether an element opens a box without article text (2), or may do so by its name (1); inside: it stands within an
    article or main element."""
    if name in BOXES or (name == "header" and not inside):
        return 2
    if not attrs.strip() or name in ("html", "body", "main"):
        return 0
    words = OF_ARTICLES if name == "article" else WORDS
    most = 0
    for key, a, b, c, hidden in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if hidden or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE)):
            return 2
        if key == "role" and value.lower() in ROLES and name != "article":
            return 2
        if key in ("class", "id"):
            most = max([most, *(_named(one, words, inside) for one in value.split())])
    return most


class Line(NamedTuple):
    text: str
    #: Whether HTML says it is no article text.
    out: bool
    #: The outermost box around it whose name is a hint, from 1; 0 if there is none.
    hint: int
    #: Characters of its text in links.
    links: int


class Element(NamedTuple):
    """An open element, each with what its ancestors say."""

    name: str
    out: bool
    inside: bool
    hint: int


def page_lines(html: str) -> tuple[list[Line], bool]:
    """Lines of a page in order, and whether the page marks its article."""
    lines: list[tuple[Line, bool]] = []
    stack: list[Element] = []
    open_now: Counter[str] = Counter()
    piece: list[str] = []
    marked, links, at, hints = False, 0, 0, 0
    page = Element("", False, False, 0)

    def flush() -> None:
        nonlocal links
        if piece:
            text = " ".join("".join(piece).split())
            if text:
                top = stack[-1] if stack else page
                lines.append((Line(text, top.out, top.hint, min(links, len(text))), top.inside))
            piece.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            text = unescape(raw) if "&" in raw else raw
            piece.append(text)
            if any(e.name == "a" for e in stack[-4:]):
                links += len(text.strip())

    def pop(i: int) -> None:
        if any(e.name not in INLINE or e.out or e.hint for e in stack[i:]):
            flush()
        open_now.subtract(e.name for e in stack[i:])
        del stack[i:]

    for m in _TOKEN.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name = name.lower()
        if m["close"] or m["close2"]:
            if open_now[name] > 0:
                i = len(stack) - 1
                while stack[i].name != name:
                    i -= 1
                pop(i)
            elif name not in INLINE:
                flush()
            continue
        attrs = m["attrs"] if m["attrs"] is not None else m["attrs2"] or ""
        if name == "br":
            piece.append(" ")
            continue
        if name not in INLINE:
            flush()
            # a new block ends an open paragraph, a new item an open item
            for i in range(len(stack) - 1, -1, -1):
                n = stack[i].name
                if n == "p" or (n == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    pop(i)
                    break
                if n not in INLINE:
                    break
        if name in VOID:
            continue
        top = stack[-1] if stack else page
        opens = name in ("article", "main") or re.search(r"role\s*=\s*[\"']?(?:main|article)\b", attrs, re.IGNORECASE) is not None
        box = _boxed(name, attrs, top.inside)
        out, hint = top.out or box == 2, top.hint
        if box == 1 and not hint:
            hints += 1
            hint = hints
        if name in INLINE and (out != top.out or hint != top.hint):
            flush()
        marked |= opens and not out
        if not attrs.rstrip().endswith("/") or name in ("p", "div", "a", "span", "article", "main"):
            stack.append(Element(name, out, top.inside or (opens and not out), hint))
            open_now[name] += 1
    add(html[at:])
    flush()
    return [x._replace(out=x.out or (marked and not inside)) for x, inside in lines], marked


def window_sums(weights: list[int]) -> list[int]:
    """Sums over all windows of WINDOW neighbouring lines; a shorter run of lines is one window."""
    if len(weights) <= WINDOW:
        return [sum(weights)]
    return [sum(weights[i : i + WINDOW]) for i in range(len(weights) - WINDOW + 1)]


def regions(weights: list[int]) -> list[tuple[int, int]]:
    """The (surge, dive) ranges of a segment's lines: all lines but those in a window whose sum is zero."""
    flat = [False] * len(weights)
    for i, total in enumerate(window_sums(weights)):
        if not total:
            flat[i : i + WINDOW] = [True] * len(flat[i : i + WINDOW])
    out, i = [], 0
    while i < len(flat):
        j = i
        while j < len(flat) and flat[j] == flat[i]:
            j += 1
        if not flat[i] and any(weights[i:j]):
            out.append((i, j))
        i = j
    return out


def main_text(html: str | None) -> str:
    """The main text of a page: kept lines in page order, joined by one space; empty if there is none."""
    lines, marked = page_lines(html or "")
    weight = [0 if x.out else len(x.text) if marked else len(x.text) - x.links for x in lines]
    # boxes with a hint in their name against the rest of the page
    own: dict[int, list[int]] = {}
    for x, w in zip(lines, weight, strict=True):
        if x.hint and not x.out:
            own.setdefault(x.hint, []).append(w)
    peak = max(window_sums([w for x, w in zip(lines, weight, strict=True) if not x.hint]), default=0)
    flat = {h for h, ws in own.items() if max(window_sums(ws)) < min(SURGE_SHARE * peak, SURGE_CHARS)}
    kept: list[str] = []
    i = 0
    gone = [x.out or x.hint in flat for x in lines]
    while i < len(lines):
        j = i
        while j < len(lines) and gone[j] == gone[i]:
            j += 1
        if not gone[i]:
            for surge, dive in regions(weight[i:j]):
                kept += [x.text for x in lines[i + surge : i + dive]]
        i = j
    return " ".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x) for x in strings(b.column(2))]
        n = pa.array([len(x) for x in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), n], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text and n_chars (code points of text).

    Defined cases: null, empty and text-free html give the empty text; html without tags is one line and is kept; ids and
    urls pass through, nulls included; equal rows each give a row; other columns are ignored; unclosed tags end with
    their parent; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op9_html(spark, sf_dir: str) -> DataFrame:
    from skein.session import table

    return extract_main_text(table(spark, sf_dir, "pages"))

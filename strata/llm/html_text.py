"""Main text of web pages from the standard library's parser events.

Events are read in a stream. Every block element opens a *line*: its text, the
tags and link text inside it, and the containers around it. Elements that are
never article text (menus, forms, scripts, adverts, notices, comments, by tag,
role, class or id) yield no lines. Whether a form, or a part of the text outside
articles that only its id names so (``<section id="related-work">``), is one of
them is decided at the end of the page. The text-to-tag ratio of each line, without
link text, is smoothed with a Gaussian over its neighbours; two-means clustering
of the smoothed ratios sets the threshold between content and the rest. The
content lines select the region on every page: the innermost container that holds
all of them, or the one around it as long as it is a part (a section, a table's
part, one of several like it) or has text right beside it. ``<article>`` and
``<main>`` only weigh in: their lines' ratios count ``ARTICLE_WEIGHT`` times. All lines
of the region come out in page order, so that short paragraphs and lists of links
inside an article stay; only a container of nothing but short links (a menu) goes.

Work is linear in the page: a tag that is never closed by ``>`` ends the page, end
tags without a start are passed over, and containers nested deeper than
``MAX_DEPTH`` count as their ancestor at that depth.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm.common import rows_of, ships_by_value

#: Lines that the Gaussian reaches, as its standard deviation.
SIGMA = 1.5
#: A line with so much of its text in links is a line of links.
LINK_SHARE = 0.5
#: A menu has at least so many links, of so many characters at most in the mean.
MENU_LINKS = 3
MENU_CHARS = 30
#: How much more a line inside an article counts.
ARTICLE_WEIGHT = 1.25
#: Nesting of containers that is told apart.
MAX_DEPTH = 256
#: Between blocks of the text.
BLOCK_JOIN = "\n\n"

# Element names by their part in HTML, and words of classes and ids.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body center div form main section table tbody td tr".split())
#: Containers that are a part of a text, and those that can be a menu.
PARTS = frozenset("section table tbody td tr".split())
MENUS = frozenset("center div section table td".split())
NEVER_TEXT = frozenset(
    "annotation annotation-xml aside audio button canvas datalist dialog footer head iframe input menu nav noscript object option script select style svg "
    "template textarea title video".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE_WORDS = frozenset(
    "ad adbox ads advert advertisement advertisements advertising adverts alert banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies copyright disclaimer disqus form forms gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices "
    "notification pager pagination popup privacy promo promoted promotion recommended related replies respond responses search share sharing sidebar sidenav "
    "signup skip social sponsor sponsored subnav subscribe subscription toolbar topbar widget widgets".split())
#: Words of names that only tell where or how something is laid out. A
#: name is noise if it has a noise word and nothing but those beside it.
LAYOUT_WORDS = frozenset(
    "area bar block body bottom box btn button center col column container content desktop element field fixed float footer global grid group head "
    "header holder id inline inner item items js large layout left link links list main middle mini mobile module new outer page panel part post posts "
    "primary right row secondary section shell side site slot small stack sticky strip sub tab tabs text title top unit wide wrap wrapper zone".split())
#: What readers wrote, whatever element it is in; names of headers
#: that hold a title.
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond responses".split())
TITLED = frozenset("article content entry main page post section story text title".split())
#: Words that say what an element has, not what it is.
ABOUT_WORDS = frozenset("has no with without".split())
#: Elements whose id is an anchor made of their title.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ANCHORED = frozenset("blockquote dd dt figure li p pre section".split())
CLOSED_BY_BLOCK = "p"
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SIBLING_SCOPE = frozenset("ul ol dl table tbody thead tfoot select menu".split())

_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _names(text: str | None) -> set[str]:
    return {w.lower() for w in _WORDS.findall(text or "")}


def _is_noise(name: str, noise: frozenset) -> bool:
    words = {w for w in _names(name) if len(w) > 1}
    if "header" in words and words & TITLED:
        words -= {"header"}
    return bool(words & noise) and words <= noise | LAYOUT_WORDS


class _Frame:
    __slots__ = ("tag", "skip", "article", "path", "doubts")

    def __init__(self, tag, skip, article, path, doubts):
        self.tag, self.skip, self.article, self.path, self.doubts = tag, skip, article, path, doubts


class Lines(HTMLParser):
    """Collects lines ``(text, tags, link characters, containers, article, links,
    doubts)``; ``made`` has the tag and class of every container, ``kinds`` what is
    doubted of every doubt: ``form``, or an id that is ``slug`` or ``bare``, that is
    of noise words only."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_Frame("", False, 0, (), ())]
        self.lines: list[tuple] = []
        self.parts: list[str] = []
        self.tags = self.link_chars = self.links = self.anchors = 0
        self.opened = 0
        self.made: list[tuple] = [("", "")]
        self.kinds: list[str] = []
        self.open: dict[str, int] = {}  # elements on the stack by name

    # -- lines

    def _break(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = self.at
                self.lines.append((text, self.tags, self.link_chars, top.path, top.article, self.anchors, top.doubts))
            self.parts = []
        self.tags = self.link_chars = self.anchors = 0

    def handle_data(self, data):
        top = self.stack[-1]
        if not top.skip and data:
            if not self.parts:
                self.at = top
            self.parts.append(data)
            if self.links:
                self.link_chars += len(data)

    # -- elements

    def _noise(self, tag, attrs, article):
        """Whether an element is never article text, or the kind of doubt."""
        if tag in NEVER_TEXT:
            return True
        if not attrs or tag in ("html", "body", "main"):
            return "form" if tag == "form" else tag == "header" and not article
        a = dict(attrs)
        if "hidden" in a or a.get("aria-hidden") == "true" or (a.get("style") and _HIDDEN.search(a["style"].lower())):
            return True
        role = (a.get("role") or "").lower()
        if tag == "form":
            return True if role in NOISE_ROLES and role != "form" else "form"
        if role in NOISE_ROLES:
            return True
        if tag == "header" and not article:
            return True
        own, slug = _names(a.get("class")), _names(a.get("id"))
        if (own | slug) & ABOUT_WORDS:
            return False
        noise = NOISE_WORDS | {"footer"} if article else NOISE_WORDS | {"footer", "header"}
        if any(_is_noise(name, noise) for name in (a.get("class") or "").split()):
            return True
        if tag in HEADINGS or not _is_noise(a.get("id") or "", noise):
            return False
        if slug & COMMENT_WORDS and tag != "p":
            return True
        if tag in ANCHORED or (tag == "div" and "section" in own):
            return False if article else "bare" if slug <= noise else "slug"
        return True

    def _pop_to(self, k):
        for f in self.stack[k:]:
            self.open[f.tag] -= 1
            if f.tag == "a":
                self.links = max(0, self.links - 1)
        del self.stack[k:]

    def _close_open(self, tags, scope):
        if not any(self.open.get(t) for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            t = self.stack[k].tag
            if t in tags:
                self._pop_to(k)
                return
            if t in scope:
                return

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCKS
        if block:
            self._break()
            self._close_open((CLOSED_BY_BLOCK,), CONTAINERS)
        if tag in SIBLINGS:
            self._close_open(SIBLINGS[tag], SIBLING_SCOPE)
        if tag in VOID:
            if tag in ("br", "hr") and self.parts:
                self.parts.append(" ")
            self.tags += 1
            return
        if tag in ("main", "article") and self.stack[-1].skip:
            self._leave_menu(tag)
        top = self.stack[-1]
        noise = top.skip or self._noise(tag, attrs, top.article)
        skip, article, path, doubts = noise is True, top.article, top.path, top.doubts
        if isinstance(noise, str):
            doubts = (*doubts, len(self.kinds))
            self.kinds.append(noise)
        if not skip:
            self.tags += 1
            if tag in CONTAINERS:
                self.opened += 1
                self.made.append((tag, dict(attrs).get("class") or ""))
                if len(path) < MAX_DEPTH:
                    path = (*path, self.opened)
                if not article and (tag in ("article", "main") or dict(attrs).get("role") in ("main", "article")
                                    or dict(attrs).get("itemprop") == "articleBody"):
                    article = self.opened
        if tag == "a":
            self.links += 1
            self.anchors += not skip
        self.stack.append(_Frame(tag, skip, article, path, doubts))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _leave_menu(self, tag):
        """A menu or header that was never closed does not hold the page's text."""
        k = next(k for k, f in enumerate(self.stack) if f.skip)
        if self.stack[k].tag in ("nav", "header") or (tag == "main" and self.stack[k].tag in ("div", "ul", "menu", "section")):
            self._pop_to(k)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and tag not in ("a", "b", "i", "em", "strong", "span"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._break()
        if not self.open.get(tag):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self._pop_to(k)
                return

    def finish(self):
        self.close()
        self._break()
        return self.lines


def content_lines(ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Which lines the smoothed text-to-tag ratios put in the upper of two
    clusters, and the ratio between the two; all lines if the ratios do not differ."""
    reach = int(math.ceil(3 * SIGMA))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    smooth = np.convolve(ratios, kernel)[reach:reach + len(ratios)] / np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]
    low, high = smooth.min(), smooth.max()
    if high - low < 1e-9:
        return np.ones(len(ratios), bool), -1.0
    while True:
        cut = (low + high) / 2
        up = smooth > cut
        a, b = smooth[~up].mean(), smooth[up].mean()
        if abs(a - low) + abs(b - high) < 1e-6:
            return up, cut
        low, high = a, b


def _of_links(line) -> bool:
    return line[2] >= LINK_SHARE * len(line[0])


def menus(lines: list[tuple], made: list[tuple]) -> set[int]:
    """Containers of nothing but lines of short links."""
    links: dict[int, list[int]] = {}
    text = set()
    for line in lines:
        if _of_links(line) and not line[4]:
            for p in line[3]:
                seen = links.setdefault(p, [0, 0])
                seen[0] += line[5]
                seen[1] += line[2]
        else:
            text.update(line[3])
    return {p for p, (n, chars) in links.items() if p not in text and made[p][0] in MENUS and n >= MENU_LINKS and chars <= MENU_CHARS * n}


def region_of(lines: list[tuple], content: np.ndarray, made: list[tuple]) -> tuple[int, int]:
    """Depth and number of the container of the text; zeros for the whole page."""
    held = [k for k, up in enumerate(content) if up] or list(range(len(lines)))
    a, b = min(lines[k][3] for k in held), max(lines[k][3] for k in held)
    depth = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    def grown(lo, hi, depth):  # a container's lines lie together
        def inside(line):
            return not depth or (len(line[3]) >= depth and line[3][depth - 1] == a[depth - 1])
        while lo and inside(lines[lo - 1]):
            lo -= 1
        while hi < len(lines) and inside(lines[hi]):
            hi += 1
        return lo, hi

    lo, hi = grown(held[0], held[0] + 1, depth)
    found = depth
    while depth:
        own = made[a[depth - 1]]
        depth -= 1
        start, end = grown(lo, hi, depth)
        beside = [*range(start, lo), *range(hi, end)]
        # text right in the container above, or in one like this: this is a part of it.
        # Beside the page's own blocks stand its other parts too, so there one like this
        # has to hold content
        page = not depth or made[a[depth - 1]][0] == "body"

        def part(k):
            line = lines[k]
            if _of_links(line):
                return False
            return len(line[3]) == depth or (made[line[3][depth]] == own and (not page or own[0] == "article" or content[k]))

        if beside and own[0] not in PARTS and not any(map(part, beside)):
            break
        if beside or own[0] in PARTS:
            found = depth
        lo, hi = start, end
    return (found, a[found - 1]) if found else (0, 0)


def settled(lines: list[tuple], kinds: list[str]) -> list[str | None]:
    """Per line ``None`` for text, else the kind of what it is in. A form or a
    part with a noise word in its id is text if it holds more than the rest of
    the page does."""
    if not kinds:
        return [None] * len(lines)
    held, total = [0] * len(kinds), 0
    for line in lines:
        n = max(0, len(line[0]) - line[2])
        total += n
        for d in line[6]:
            held[d] += n
    open_ = {d for d, kind in enumerate(kinds) if kind == "bare" or 2 * held[d] <= total}
    found = [{kinds[d] for d in line[6] if d in open_} for line in lines]
    if all(found):
        return [None] * len(lines)
    return [next((kind for kind in ("form", "bare", "slug") if kind in f), None) for f in found]


def main_blocks(html: str | None) -> list[str]:
    """The article's blocks in page order; none for null, empty or text-free pages."""
    if not html:
        return []
    parser = Lines()
    end = html.rfind(">") + 1  # a tag after it is never closed
    tail = html[end:]
    parser.feed(html[:end] + (tail[:tail.find("<")] if "<" in tail else tail))
    lines = parser.finish()
    if not lines:
        return []
    doubts = settled(lines, parser.kinds)
    plain = [line for line, kind in zip(lines, doubts) if kind is None]
    ratios = np.array([max(0, len(t) - link) / (1 + tags) * (ARTICLE_WEIGHT if article else 1) for t, tags, link, _, article, *_ in plain], float)
    content, cut = content_lines(ratios)
    gone = menus([line for line, kind in zip(lines, doubts) if kind != "form"], parser.made)
    left = np.array([k for k, line in enumerate(plain) if gone.isdisjoint(line[3])], int)
    if not len(left):
        return []
    # a short line beside the text can be in the upper cluster for its neighbours
    # alone; it only counts where no line is content by its own ratio too
    own = content[left] & (ratios[left] > cut)
    depth, at = region_of([plain[k] for k in left], own if own.any() else content[left], parser.made)
    # inside the text's container an id is an anchor; the whole page is none, there only an id of other words too
    text = {None, "slug", "bare"} if parser.made[at][0] not in ("", "body") else {None, "slug"}
    return [line[0] for line, kind in zip(lines, doubts)
            if kind in text and gone.isdisjoint(line[3]) and (not depth or (len(line[3]) >= depth and line[3][depth - 1] == at))]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row, from its whole html.

    A null or empty html, and a page without text outside the skipped elements,
    give an empty text with 0 characters. Repeated rows give repeated results;
    other columns are not read, whatever their names.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
        out, held = [], 0
        for i, url, html in rows_of(batches, "page_id", "url", "html"):
            text = BLOCK_JOIN.join(main_blocks(html))
            out.append((i, url, text, len(text)))
            held += len(text) + 100
            if held > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], schema.field(k).type) for k in range(4)], schema=schema)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], schema.field(k).type) for k in range(4)], schema=schema)

    return pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")


ships_by_value(__name__)

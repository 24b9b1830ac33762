"""Main-text extraction from HTML by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf tag path. Every path gets two ratios: characters of text a
block, and punctuation marks a block; a block has at least its own. Both sequences, in page order, are smoothed with a small
Gaussian window and fused by product; blocks whose fused score passes a threshold are content, on every page and whatever
its elements are called. What the scores pass shows where the article is: its region is the innermost sectioning element that
holds most of the content's text, and grows to an enclosing one (up to the article or main around it, where there is one)
whose further text is content, too. Elements that never hold an article (menus, forms, footers, ...) and those named so have no
place in it.

Inside of the region a block is kept if it is content; one that is too short to pass by itself (a heading, a lead, an item,
a closing line) is kept as well unless links make up most of it. A block long enough to pass by itself that doesn't, isn't
content.

Elements that are hidden or hold no text for readers (scripts, forms, menus, ...), and those whose class or id names such
a role, are left out before the ratios are taken. For what is around or beside an article (adverts, comments, shares, related
stories, consent) a part of a name is enough (article-comments, cookiebar); for words that have other meanings as well
(header, form, side) all parts must be roles or neutral. A name alone doesn't rule out a wrapper: an element stays if it is
around the largest article or main or around most of the page's text.

Defined results: null or empty html, and pages without content, give an empty text and 0 characters. Broken mark-up
(unclosed or crossed tags, a cut end) never raises. Time and memory are in proportion to the page however deep its
elements are nested.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import schema_with, ship

# Element names of the HTML standard (fixed values).
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg".split())
#: Never part of an article.
OUT = frozenset("head nav header footer aside form menu dialog button select option label input object audio video canvas search fieldset".split())
#: Words in class and id tokens that name roles. A token names one if all its parts are such words or neutral ones, so
#: that side-effects, header-image and form-follows-function name none.
ROLES = frozenset(
    "feedback responses response ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion promos nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer foot sidebar side aside widget widgets cookie cookies consent notice notices alert alerts gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist discussion reactions thread replies reply disqus respond copyright legal disclaimer pagination pager toolbar search form tags".split()
)
#: Of these, the roles of parts of an article, and those that an article or main element can have.
CONTENT_ROLES = frozenset("feedback responses response ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promos related recommended recommendations comment comments commentlist discussion reactions thread replies reply disqus respond".split())
_NEUTRAL = frozenset("box block wrapper wrap container list section bar area widget top bottom left right main site page global primary secondary inner outer item items user users reader readers post posts links link icons buttons button text message form holder slot unit articles stories news videos reading zone panel row col column left1 js the".split())


#: Of the roles, those that one part of a name is enough for, and the beginnings of parts that are.
PLAIN_ROLES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos breadcrumb breadcrumbs sidebar cookie cookies consent gdpr newsletter comment comments commentlist disqus respond responses feedback recommended recommendations navbar masthead pagination".split())
_BEGINNINGS = ("cookie", "advert", "sponsor", "breadcrumb", "newsletter", "comments", "commentlist", "disqus", "gdpr")
#: Elements that a part of a name is enough for; headings and inline elements are named after what they say.
_BOXES = frozenset("div section ul ol aside table tr td dl details figure article li".split())


def roles_of(names: str, box: bool = True) -> frozenset[str]:
    """The roles that the tokens of a class or id attribute name."""
    out: set[str] = set()
    for token in names.split():
        parts = [x for x in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if x]
        named = ROLES.intersection(parts)
        if named and all(x in ROLES or x in _NEUTRAL for x in parts):
            out |= named
        elif box:
            out |= PLAIN_ROLES.intersection(parts)
            out |= {"comments" if x.startswith("comment") else "cookie" if x.startswith(("cookie", "gdpr")) else "ads" for x in parts if x.startswith(_BEGINNINGS)}
    return frozenset(out)


OUT_TAG, OUT_ROLE, OUT_MINOR = 1, 2, 3
ROLE_ATTRS = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
CONTENT = frozenset(("article", "main"))
_SECTIONS = frozenset("body div section td article main".split())
# An attribute's value is quoted only where a quote follows its equals sign; a quote elsewhere is a character like any.
_VALUE = r"\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]*"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:{_VALUE}))*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?")
_PUNCT = re.compile(r"[.,;:!?…。，、！？；：¿¡]")
_SPACE = re.compile(r"\s+")
#: Elements whose start closes an open one of the same family.
_CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SIGMA = 1.0
#: A block is content if its fused, smoothed score is at least this share of the page's mean score.
SHARE = 0.5
#: A region holds at least this share of the content's text.
MOST = 0.75


def _is_out(tag: str, attrs: str, inside: bool) -> int:
    """0: no; OUT_ROLE or OUT_MINOR: by a role that its class or id names, see _barred; OUT_TAG: for good."""
    if tag in OUT and not (tag == "header" and inside):
        return OUT_TAG
    if attrs:
        a = {k.lower(): x or y or z for k, x, y, z in _ATTR.findall(attrs)}
        if a.get("role", "").lower() in ROLE_ATTRS or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower() or "hidden" in a:
            return OUT_TAG
        if tag not in ("html", "body"):
            named = roles_of(f"{a.get('class', '')} {a.get('id', '')}", tag in _BOXES)
            if named & CONTENT_ROLES:
                return OUT_MINOR
            if named and tag not in CONTENT:
                return OUT_ROLE
    return 0


class Page:
    """The tree of a page: for each element its tag, parent, path of block elements and role; and its text nodes in order,
    each with its element. Elements are numbered from 1 in the order of their starts, 0 being the page, so one pass from
    the last to the first sums over subtrees, however deep they are nested."""

    def __init__(self, html_text: str):
        self.tag, self.parent, self.kind, self.path = [""], [0], [0], [0]
        #: (block number, element, decoded text, in a link)
        self.nodes: list[tuple[int, int, str, bool]] = []
        self._read(html_text)

    def _read(self, page: str) -> None:
        paths: dict[tuple[int, str], int] = {}
        # Of the open elements: number, innermost block (place in the stack or -1), links and elements left out so far.
        stack: list[tuple[int, int, int, int]] = []
        open_tags: dict[str, int] = {}
        block, inside = 0, 0

        def close(down_to: int) -> None:
            nonlocal inside
            for x in stack[down_to:]:
                open_tags[self.tag[x[0]]] -= 1
                inside -= self.tag[x[0]] in CONTENT
            del stack[down_to:]

        at, end = 0, len(page)
        while at < end:
            m = _TOKEN.match(page, at)
            at = m.end()
            tag = m[2]
            top = stack[-1] if stack else (0, -1, 0, 0)
            if tag is None:
                if m[4] and not top[3]:
                    self.nodes.append((block, top[0], html.unescape(m[4]), top[2] > 0))
                continue
            tag = tag.lower()
            if tag in BLOCKS:
                block += 1
            if m[1]:
                if open_tags.get(tag):
                    # An inline end tag doesn't reach out of the block that it stands in.
                    least = 0 if tag in BLOCKS else top[1] + 1
                    k = next((k for k in range(len(stack) - 1, least - 1, -1) if self.tag[stack[k][0]] == tag), -1)
                    if k >= 0:
                        close(k)
                continue
            if tag == "br":
                if not top[3] and self.nodes:
                    self.nodes.append((block, self.nodes[-1][1], " ", self.nodes[-1][3]))
                continue
            if tag in RAW:
                m2 = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = m2.end() if m2 else end
                continue
            if tag in VOID:
                continue
            while stack and (c := stack[-1][1]) >= 0 and tag in _CLOSES.get(self.tag[stack[c][0]], ()):
                # A closed paragraph also ends the inline elements left open in it.
                close(c)
            number, up, around, links, out = len(self.tag), *((stack[-1]) if stack else (0, -1, 0, 0))
            kind = _is_out(tag, m[3], inside > 0)
            self.tag.append(tag)
            self.parent.append(up)
            self.kind.append(kind)
            self.path.append(paths.setdefault((self.path[up], tag), len(paths) + 1) if tag in BLOCKS else self.path[up])
            stack.append((number, len(stack) if tag in BLOCKS else around, links + (tag == "a"), out + (kind == OUT_TAG)))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            inside += tag in CONTENT

    def sums(self, own: list[int]) -> list[int]:
        """Of each element, the sum of own over itself and what is in it."""
        out = list(own)
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] += out[k]
        return out

    def barred(self) -> list[bool]:
        """The elements that a role leaves out, with all that is in them. A wrapper stays: one around the article or main
        with the most text, or one that most of the page's text lies in. Of adverts, comments and the like, which often
        hold articles of their own, only an article with most of the page's text makes a wrapper, or, without any article
        outside, that nearly all text is in it and in nothing so named within it. Text of links doesn't
        count."""
        n = len(self.tag)
        minor = [False] * n
        for k in range(1, n):
            minor[k] = minor[self.parent[k]] or self.kind[k] == OUT_MINOR
        text, main = [0] * n, [0] * n
        for _, e, t, link in self.nodes:
            size = 0 if link else len(t.strip())
            text[e] += size
            main[e] += 0 if minor[e] else size
        # Of each element so named its text, without that of others so named within it.
        bare = list(text)
        for k in range(n - 1, 0, -1):
            bare[self.parent[k]] += 0 if self.kind[k] == OUT_MINOR else bare[k]
        text, main = self.sums(text), self.sums(main)
        articles = [k for k in range(1, n) if self.tag[k] in CONTENT]
        largest = max((text[k] for k in articles if not minor[k]), default=0)
        inner = [0] * n  # the largest article in an element, itself included
        for k in articles:
            inner[k] = text[k]
        for k in range(n - 1, 0, -1):
            inner[self.parent[k]] = max(inner[self.parent[k]], inner[k])
        out = [False] * n
        for k in range(1, n):
            out[k] = out[self.parent[k]]
            if self.kind[k] == OUT_MINOR:
                out[k] |= 2 * inner[k] <= text[0] and (largest > 0 or bare[k] < MOST * text[0])
            elif self.kind[k] == OUT_ROLE:
                out[k] |= not (inner[k] >= largest > 0 or 2 * main[k] > main[0])
        return out


_REACH = math.ceil(3 * SIGMA)
_KERNEL = np.exp(-0.5 * (np.arange(-_REACH, _REACH + 1) / SIGMA) ** 2)
_KERNEL /= _KERNEL.sum()


def _smooth(x: np.ndarray) -> np.ndarray:
    return np.convolve(np.pad(x, _REACH, mode="edge"), _KERNEL, "valid")


def extract(page: str | None) -> str:
    """The page's main text, a block a line."""
    if not page:
        return ""
    tree = Page(page)
    barred = tree.barred() if any(tree.kind) else None
    blocks: dict[int, list] = {}
    for b, e, t, link in tree.nodes:
        if barred and barred[e]:
            continue
        x = blocks.setdefault(b, [e, [], 0, False])
        # A block belongs to the element of its first text.
        if not x[3] and t.strip():
            x[0], x[3] = e, True
        x[1].append(t)
        x[2] += len(t.strip()) if link else 0
    rows = [(e, t, links) for e, raw, links, _ in blocks.values() if (t := _SPACE.sub(" ", "".join(raw)).strip())]
    if not rows:
        return ""
    content, short = judge([tree.path[e] for e, _, _ in rows], [t for _, t, _ in rows])
    if not content.any():
        return ""
    inside = _region(tree, rows, content)
    # What is too short for its score to tell is kept by its place, but for links.
    place = short & np.array([2 * links <= len(t) for _, t, links in rows])
    return "\n".join(t for keep, (_, t, _) in zip(inside & (content | place), rows, strict=True) if keep)


def judge(paths: list, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(content, short) of a page's blocks by their tag paths and texts: whether a block's score passes the threshold, and
    whether it can't by its own text alone."""
    size, marks = np.array([len(t) for t in texts]), np.array([len(_PUNCT.findall(t)) for t in texts])
    # Inline elements don't split a paragraph's path.
    _, of = np.unique(paths, return_inverse=True)
    n = np.bincount(of)
    chars_ratio, marks_ratio = (np.maximum((np.bincount(of, x) / n)[of], x) for x in (size, marks))
    fused = _smooth(chars_ratio) * (1 + _smooth(marks_ratio))
    least = SHARE * fused.mean()
    own = _KERNEL.max() * size * (1 + _KERNEL.max() * marks)
    return fused > least, own <= least


def _region(tree: Page, rows: list, content: np.ndarray) -> np.ndarray:
    """Which blocks lie in the region of the page's content."""
    count = len(tree.tag)
    own, every, links, good = ([0] * count for _ in range(4))
    named = [False] * count
    for k in range(1, count):
        named[k] = named[tree.parent[k]] or tree.tag[k] in CONTENT
    for keep, (e, t, link) in zip(content, rows, strict=True):
        own[e] += len(t) if keep else 0
        every[e] += len(t)
        links[e] += link
        good[e] += len(t) if keep or _block_tag(tree, e) in _HEADINGS else 0
    marked = sum(w for w, x in zip(own, named, strict=True) if x)
    own, every, links, good = (tree.sums(x) for x in (own, every, links, good))
    total = own[0]
    strong = [k for k in range(1, count) if tree.tag[k] in _SECTIONS and own[k] >= MOST * total]
    if marked >= MOST * total and not any(tree.tag[k] in CONTENT for k in strong):  # several articles hold it together
        regions = {k for k in range(1, count) if tree.tag[k] in CONTENT and own[k]}
    else:
        region = strong[-1] if strong else 0
        around = next((k for k in reversed(strong) if tree.tag[k] in CONTENT), None)
        up = tree.parent[region]
        while region and up and (around is not None and around < region or tree.tag[up] not in ("body", "html")):
            more, further = every[up] - every[region], good[up] - good[region]
            if around is None or region <= around:
                if around is not None or 2 * further < more or 2 * (links[up] - links[region]) > more:
                    break
            region, up = up, tree.parent[up]
        regions = {region}
    within = [False] * count
    for k in range(count):
        within[k] = k in regions or (k > 0 and within[tree.parent[k]])
    return np.array([within[e] for e, _, _ in rows])


_HEADINGS = frozenset(f"h{k}" for k in range(1, 7))


def _block_tag(tree: Page, e: int) -> str:
    while e and tree.tag[e] not in BLOCKS:
        e = tree.parent[e]
    return tree.tag[e]


def extract_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without ``column``, with ``text`` and ``n_chars``; a column of these names is replaced."""
    ship(pages.sparkSession)
    pages = pages.drop(*({"text", "n_chars"} - {column}))
    keep = [c for c in pages.columns if c != column]

    def run(batches):
        for b in batches:
            t = [extract(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(t, pa.string()), pa.array([len(x) for x in t], pa.int64())], names=[*keep, "text", "n_chars"])

    schema = schema_with(pages.select(keep), ("text", "string"), ("n_chars", "long"))
    return pages.select(column, *keep).mapInArrow(run, schema)

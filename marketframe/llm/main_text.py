"""The main text of web pages by composite text density.

Every page becomes a small tree. A node's density is its characters per tag, lowered the more of its
characters and tags are links; a node's sum adds the densities of its children. The subtree of the largest
sum holds the article. The least density on its path to the body is the threshold: other nodes that reach it
belong to the article too. Menus, adverts and the like leave the tree before anything is counted.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of HTML: elements by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"caption", "legend", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body"}
#: an element that starts ends an open one of the same list, unless the boundary lies between
ENDS = {
    **dict.fromkeys(["li"], (("li",), ("ul", "ol", "menu", "dir"))),
    **dict.fromkeys(["dt", "dd"], (("dt", "dd"), ("dl",))),
    **dict.fromkeys(["td", "th"], (("td", "th"), ("table",))),
    **dict.fromkeys(["tr"], (("tr",), ("table",))),
    **dict.fromkeys(["tbody", "thead", "tfoot"], (("tbody", "thead", "tfoot"), ("table",))),
    **dict.fromkeys(["option"], (("option",), ("select",))),
}
P_STAYS_IN = ("table", "td", "th", "caption", "button", "object", "template")
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])

#: elements that never hold the article's text
DROPPED = frozenset(
    "head title script style noscript template nav aside footer form fieldset button select option textarea label dialog menu search "
    "iframe svg canvas object audio video map datalist".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog toolbar tablist status".split())
#: words in a class or id that name something else than the article
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored promo promos promoted promotion "
    "cookie cookies consent gdpr notice notices notification notifications disclaimer popup modal overlay newsletter subscribe subscription paywall signup login "
    "sidebar sidebars rail aside menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar footer colophon "
    "comment comments commentlist reply replies respond disqus discussion related recommended recommendations share sharing social widget widgets form search".split()
)
#: words for a header: of the site, but inside an article for its own heading
HEADER_HINTS = frozenset("header masthead heading".split())
NOT_HINTED = frozenset(["html", "body", "main"]) | HEADINGS
_WORD = re.compile(r"[a-z0-9]+")
_COPYRIGHT = re.compile(r"(©|copyright\b).{0,200}$", re.I)
#: elements whose content is not markup
RAW = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")}
_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(=?[^\s/>=]+|=)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)|(?=>)))?)?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _hinted(attrs: list) -> tuple[bool, bool, bool]:
    """Whether attributes name something else than the article, name a header, hide the element."""
    hint = header = hidden = False
    for name, value in attrs:
        value = value or ""
        if name in ("class", "id"):
            words = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower())
            named = {w for i, w in enumerate(words) if not (i and words[i - 1] in ("has", "with", "no", "without"))}
            hint |= not HINTS.isdisjoint(named)
            header |= not HEADER_HINTS.isdisjoint(named)
        elif name == "role":
            hint |= value.lower() in ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            hidden = True
    return hint, header, hidden


class _Tree:
    """Nodes in page order, a parent before its children, and texts with the node and the block they stand in."""

    def __init__(self, page: str):
        self.tag, self.parent, self.hint, self.header, self.hidden = ["#root"], [-1], [False], [False], [False]
        self.texts: list[tuple[int, int, str]] = []
        self.open = [0]
        self.places = defaultdict(list)  # of open elements by tag
        self.blocks: list[int] = []  # places of open block elements
        self.block = 0
        self._read(page)

    def _read(self, page: str) -> None:
        """One pass over the page. A comment, tag or quoted value that does not end runs to the end of the page."""
        at = 0
        while True:
            to = page.find("<", at)
            if to != at:
                self._text(page[at : to if to >= 0 else None])
            if to < 0:
                return
            sign = page[to + 1 : to + 2]
            if sign.isascii() and sign.isalpha():
                name = _NAME.match(page, to + 1)
                end, attrs = self._attributes(page, name.end())
                if end < 0:
                    return
                tag = name[0].lower()
                self._start(tag, attrs)
                if tag in RAW:
                    close = RAW[tag].search(page, end)
                    self._text(page[end : close.start() if close else None])
                    end = close.start() if close else len(page)
                at = end
            elif page.startswith("<!--", to):
                at = to + 5 if page.startswith("<!-->", to) else page.find("-->", to + 4) + 3
                if at == 2:
                    return
            elif sign and sign in "/!?":
                at = page.find(">", to) + 1
                if not at:
                    return
                if sign == "/" and (name := _NAME.match(page, to + 2, at)):
                    self._end(name[0].lower())
            else:
                self._text("<")
                at = to + 1

    @staticmethod
    def _attributes(page: str, at: int) -> tuple[int, list]:
        """Where the tag ends, or -1, and its attributes."""
        found = []
        while page[at : at + 1] != ">":
            m = _ATTRIBUTE.match(page, at)
            if m.end() == at or m.end() >= len(page):
                return -1, found
            if m[1]:
                found.append((m[1].lower(), m[2] or m[3] or m[4] or ""))
            at = m.end()
        return at + 1, found

    def _text(self, piece: str) -> None:
        self.texts.append((self.open[-1], self.block, unescape(piece) if "&" in piece else piece))

    def _last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def _cut(self, place: int) -> None:
        """End the open element at a place and everything in it."""
        while len(self.open) > place:
            tag = self.tag[self.open.pop()]
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
                self.block += 1

    def _start(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P and (at := self._last(("p",))) > self._last(P_STAYS_IN):
            self._cut(at)
        if tag in ENDS:
            ends, within = ENDS[tag]
            if (at := self._last(ends)) > self._last(within):
                self._cut(at)
        if tag == "body":  # a head that was never ended
            if at := self._last(("head",)):
                self._cut(at)
        if tag in VOID:
            if tag == "br":
                self.texts.append((self.open[-1], self.block, " "))
            elif tag == "hr":
                self.block += 1
            return
        hint, header, hidden = _hinted(attrs) if attrs else (False, False, False)
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.hint.append(hint)
        self.header.append(header or tag == "header")
        self.hidden.append(hidden)
        self.places[tag].append(len(self.open))
        if tag in BLOCK:
            self.blocks.append(len(self.open))
            self.block += 1
        self.open.append(len(self.tag) - 1)

    def _end(self, tag: str) -> None:
        if tag in ("body", "html"):  # what follows still belongs to the body
            return
        at = self.places[tag][-1] if self.places[tag] else 0
        if at and (tag in BLOCK or not self.blocks or self.blocks[-1] < at):
            self._cut(at)


def _kept_nodes(t: _Tree) -> list[bool]:
    """Whether each node is part of what is looked at: in the body and outside menus, adverts and the like."""
    n = len(t.tag)
    holds_article, holds_title, holds_heading, inside = [False] * n, [False] * n, [False] * n, [False] * n
    for i in range(n - 1, 0, -1):
        p = t.parent[i]
        holds_article[p] |= holds_article[i] or t.tag[i] == "main" or (t.tag[i] == "article" and not t.hint[i])
        holds_title[p] |= holds_title[i] or t.tag[i] == "h1"
        holds_heading[p] |= holds_heading[i] or t.tag[i] in HEADINGS
    kept = [True] * n
    for i in range(1, n):
        p, tag = t.parent[i], t.tag[i]
        inside[i] = inside[p] or tag == "main" or (tag == "article" and not t.hint[i])
        # what holds the title or the article is a wrapper, such as class="page sidebar-right"
        other = t.hint[i] and tag not in NOT_HINTED and not holds_article[i] and not holds_title[i]
        other |= tag in DROPPED and not (tag in ("form", "fieldset") and holds_article[i])
        # a header inside an article is kept for the article's own heading
        other |= t.header[i] and tag not in NOT_HINTED and not holds_article[i] and not (inside[p] and holds_heading[i])
        kept[i] = kept[p] and not t.hidden[i] and not other
    return kept


def main_text(html: str | None) -> str:
    """The article of one page: its blocks in page order, joined by an empty line; empty if there is none.

    Character references are decoded and white space inside a block is one space. A line break is white
    space; a table cell, list item or heading is a block. Broken markup is read as browsers do for what
    matters here: a paragraph ends where a block starts, stray end tags are left out, and ends may lack.
    """
    t = _Tree(html or "")
    n = len(t.tag)
    kept = _kept_nodes(t)
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[t.parent[i]] or t.tag[i] == "a"
    chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for i, _, s in t.texts:
        if kept[i]:
            c = len(s) - sum(map(s.count, " \n\t\r"))
            chars[i] += c
            if linked[i]:
                link_chars[i] += c
    for i in range(n - 1, 0, -1):
        if kept[i]:
            p = t.parent[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (t.tag[i] == "a")
    for i in range(1, n):  # lists of nothing but links are menus
        kept[i] = kept[i] and kept[t.parent[i]] and not (link_tags[i] > 1 and chars[i] == link_chars[i] and t.tag[i] not in NOT_HINTED)

    whole = link_chars[0] / max(chars[0], 1)
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c, lc = chars[i], link_chars[i]
        if kept[i] and c:
            k, lk = max(tags[i], 1), max(link_tags[i], 1)
            base = math.log(c / max(c - lc, 1) * lc + whole * c + math.e)
            density[i] = c / k * math.log(max(c / max(lc, 1) * k / lk, 1.0)) / max(math.log(base), 1.0)
            if i:
                total[t.parent[i]] += density[i]

    best = max(range(n), key=lambda i: (total[i], chars[i], -i))
    marked = [False] * n
    around = [best]
    while around[-1] > 0:
        around.append(t.parent[around[-1]])
    article = [i for i in around if t.tag[i] == "article"]
    if article:
        marked[article[-1]] = True
    else:
        scope = next((i for i in around if t.tag[i] in ("main", "body")), 0)
        threshold = min(density[i] for i in around if i >= scope)
        marked[best] = True
        wraps = set(around)  # marking one of these would mark everything
        for i in range(scope + 1, n):
            marked[i] |= kept[i] and chars[i] > 0 and density[i] >= threshold and i not in wraps and t.tag[i] not in ("main", "body")
    for i in range(1, n):
        marked[i] |= marked[t.parent[i]]

    blocks: list[list] = []
    for i, b, s in t.texts:
        if kept[i]:
            if not blocks or blocks[-1][0] != b:
                blocks.append([b, False, _heading(t, i), []])
            blocks[-1][1] |= marked[i]
            blocks[-1][3].append(s)
    blocks = [[keep, heading, " ".join("".join(parts).split())] for _, keep, heading, parts in blocks]
    blocks = [b for b in blocks if b[2]]
    if not article:
        for b in blocks:
            b[0] = b[0] and not _COPYRIGHT.match(b[2])
    for at in range(len(blocks) - 2, -1, -1):  # a heading belongs to the text that it stands above
        blocks[at][0] |= blocks[at][1] and blocks[at + 1][0]
    return "\n\n".join(text for keep, _, text in blocks if keep)


def _heading(t: _Tree, i: int) -> bool:
    while i > 0 and t.tag[i] not in BLOCK:
        i = t.parent[i]
    return t.tag[i] in HEADINGS


def main_text_of(html: Column) -> Column:
    """``main_text`` of a column of pages; a null page has an empty text."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return run(F.coalesce(html, F.lit("")))

"""A page's html as a flat sequence of element starts, element ends and text blocks.

One scan, linear in the page: comments, raw text (scripts, styles) and unclosed quotes are each
searched once. Elements are told apart by their path, a hash over tag, role and class words from
the root down; elements that are left open are closed where their parent ends. A block is the
text between two starts or ends of block elements: inline elements and line breaks don't divide.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

from xxhash import xxh3_64_intdigest

OPEN, CLOSE, TEXT = 0, 1, 2
#: What a block is by its own elements: nothing known, left out, or part of the article.
PLAIN, NOISE, MAIN = 0, 1, 2

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
#: A start of the key ends an open element of the values, unless one of the last stands between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "body": (("head",), ()),
}
#: Elements that may stand in a paragraph though they aren't inline, and those of the head.
IN_PARAGRAPH = frozenset("script style noscript template button select textarea iframe object svg canvas audio video math option".split())
IN_HEAD = frozenset("title style script noscript template base meta link".split())

NOISE_TAGS = frozenset("head script style noscript template title nav footer aside form button select option textarea iframe noembed noframes xmp object svg canvas audio video menu dialog".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
MAIN_ROLES = frozenset("main article".split())
#: Words of class or id that mark what isn't the article.
NOISE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies
    consent gdpr notice notices notification alert alerts newsletter subscribe subscription signup sidebar sidebars sidenav menu menus nav navs
    navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus reply replies respond share sharing social related
    recommended recommendations widget widgets popup modal overlay login search searchbox pagination pager copyright toolbar topbar masthead
    disclaimer""".split()
)
#: The same, but for a part of the article's own.
HEADER_WORDS = frozenset("header masthead topbar".split())
#: Words after one of these say what an element has, not what it is.
HAVING = frozenset("has with no without not is".split())
#: Class or id words of an element that holds the article where no tag or role says so.
ARTICLE_WORDS = frozenset("article articlebody content post entry story main maincontent mainbody".split())

ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[A-Za-z][^\s/>]*")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Event(NamedTuple):
    kind: int
    #: Identity across pages: the path for starts and ends, path and text for blocks.
    token: int
    text: str = ""
    n_link: int = 0
    mark: int = PLAIN


class _Element:
    __slots__ = ("tag", "path", "mark", "inline")

    def __init__(self, tag: str, path: int, mark: int, inline: bool):
        self.tag, self.path, self.mark, self.inline = tag, path, mark, inline


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _name_words(value: str) -> list[str]:
    """The words of a class or id, in order, without those after has-, with-, no-."""
    out: list[str] = []
    for name in value.split():
        having = False
        for w in WORD.findall(name):
            w = w.lower()
            having |= w in HAVING
            if not having:
                out.append(w)
    return out


def _mark(tag: str, attributes: dict[str, str], words: list[str], within: int) -> int:
    """The mark of an element inside one of mark within. What is left out stays left out."""
    if within == NOISE or "hidden" in attributes:
        return NOISE
    role = attributes.get("role", "").lower()
    if tag in NOISE_TAGS or role in NOISE_ROLES:
        return NOISE
    if tag == "header" and within != MAIN:
        return NOISE
    frame = tag in ("html", "body", "main") or tag == "article" and not {"comment", "comments", "reply"} & set(words)
    if not frame and any(w in NOISE_WORDS or w in HEADER_WORDS and within != MAIN for w in words):
        return NOISE
    if tag in ("article", "main") or role in MAIN_ROLES or "articlebody" in attributes.get("itemprop", "").lower():
        return MAIN
    return within


class Page:
    """The events of a page, and whether an element of it is marked as the article."""

    def __init__(self, html: str):
        self.events: list[Event] = []
        #: 2: a tag or role says article; 1: only a class or id does.
        self.marked = 0
        self._stack = [_Element("", 0, PLAIN, False)]
        self._open: dict[str, int] = {}
        self._links = 0
        self._pieces: list[str] = []
        self._n_link = 0
        self._by_name: list[tuple[int, int]] = []
        self._scan(html)
        self._text_ends()
        while len(self._stack) > 1:
            self._pop()
        self._name_articles()

    def _scan(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            start = html.find("<", at)
            if start < 0:
                start = end
            if start > at:
                self._add(html[at:start])
            if start == end:
                break
            after = html[start + 1 : start + 2]
            if html.startswith("<!--", start):
                stop = html.find("-->", start + 4)
                at = stop + 3 if stop >= 0 else end
            elif after in ("!", "?") and after:
                stop = html.find(">", start)
                at = stop + 1 if stop >= 0 else end
            elif after == "/" and (name := NAME.match(html, start + 2)):
                stop = html.find(">", name.end())
                at = stop + 1 if stop >= 0 else end
                self._end(name.group().lower())
            elif name := NAME.match(html, start + 1):
                stop = self._tag_end(html, name.end())
                tag, at = name.group().lower(), stop + 1
                attributes = {m[1].lower(): next((v for v in m.group(2, 3, 4) if v is not None), "") for m in ATTRIBUTE.finditer(html, name.end(), stop)}
                if tag in RAW:
                    at = self._raw(html, tag, at)
                elif tag == "br":
                    self._add(" ")
                else:
                    self._start(tag, attributes, html[stop - 1 : stop] == "/")
            else:
                self._add("<")
                at = start + 1

    _closers: dict[str, re.Pattern[str]] = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}

    def _raw(self, html: str, tag: str, at: int) -> int:
        """Where the text after a raw element goes on; its content is never part of the article."""
        closer = self._closers[tag].search(html, at)
        return closer.end() if closer else len(html)

    def _tag_end(self, html: str, at: int) -> int:
        """The position of the tag's last character; a quote that never ends is no quote."""
        quoted = html.find(">", at)
        if quoted < 0:
            return len(html)
        while True:
            quote = min((q for q in (html.find('"', at, quoted), html.find("'", at, quoted)) if q >= 0), default=-1)
            if quote < 0:
                return quoted
            close = html.find(html[quote], quote + 1)
            if close < 0:
                return quoted
            at = close + 1
            if at > quoted:
                more = html.find(">", at)
                if more < 0:
                    return quoted
                quoted = more

    def _add(self, text: str) -> None:
        if self._stack[-1].mark != NOISE:
            text = unescape(text) if "&" in text else text
            self._pieces.append(text)
            if self._links:
                self._n_link += len(text)

    def _text_ends(self) -> None:
        if self._pieces:
            text = " ".join("".join(self._pieces).split())
            if text:
                top = self._block()
                token = signed(xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed=top.path))
                self.events.append(Event(TEXT, token, text, min(self._n_link, len(text)), self._stack[-1].mark))
            self._pieces.clear()
        self._n_link = 0

    def _block(self) -> _Element:
        return next(e for e in reversed(self._stack) if not e.inline)

    def _pop(self) -> None:
        e = self._stack.pop()
        self._open[e.tag] -= 1
        if e.tag == "a":
            self._links -= 1
        if not e.inline:
            self.events.append(Event(CLOSE, signed(e.path ^ 1), mark=e.mark))

    def _end(self, tag: str) -> None:
        """Close the innermost open element of that tag and all in it; an end without a start is ignored."""
        if tag == "p" and not self._open.get("p"):
            self._text_ends()
        if not self._open.get(tag):
            return
        if tag in INLINE:
            # an end of an inline element reaches no further than its block
            if all(e.tag != tag for e in self._inside()):
                return
            if any(e.mark != self._block().mark for e in self._inside()):
                self._text_ends()
        else:
            self._text_ends()
        while self._stack[-1].tag != tag:
            self._pop()
        self._pop()

    def _inside(self) -> list[_Element]:
        """Inline elements that are open in the innermost block."""
        out = []
        for e in reversed(self._stack):
            if not e.inline:
                break
            out.append(e)
        return out

    def _ended_by(self, tags: tuple[str, ...], borders: tuple[str, ...]) -> None:
        for e in reversed(self._stack):
            if e.tag in borders:
                return
            if e.tag in tags:
                self._end(e.tag)
                return

    def _start(self, tag: str, attributes: dict[str, str], closed: bool) -> None:
        inline = tag in INLINE
        if self._open.get("head") and tag not in IN_HEAD:
            self._end("head")
        if not inline and self._open.get("p") and tag not in IN_PARAGRAPH and tag not in VOID:
            self._ended_by(("p",), ("article", "div", "section", "td", "th", "li", "body", "blockquote", "button", "object"))
        if tag in ENDS and any(self._open.get(t) for t in ENDS[tag][0]):
            self._ended_by(*ENDS[tag])
        words = _name_words(f"{attributes.get('class', '')} {attributes.get('id', '')}")
        if tag in VOID:
            if tag == "hr":
                self._text_ends()
            return
        top = self._stack[-1]
        mark = _mark(tag, attributes, words, top.mark)
        if not inline or mark != top.mark:
            self._text_ends()
        path = top.path
        if not inline:
            role = attributes.get("role", "")
            path = xxh3_64_intdigest(f"{tag} {role} {' '.join(sorted(words))}".encode("utf-8", "surrogatepass"), seed=top.path) & ~1
        e = _Element(tag, path, mark, inline)
        self._stack.append(e)
        self._open[tag] = self._open.get(tag, 0) + 1
        if tag == "a":
            self._links += 1
        if mark == MAIN:
            self.marked = 2
        if not inline:
            if mark == PLAIN and tag not in ("html", "body") and ARTICLE_WORDS & set(words):
                self._by_name.append((len(self.events), len(self._stack)))
            self.events.append(Event(OPEN, signed(path), mark=mark))
        if closed and tag in ("svg", "math"):
            self._pop()

    def _name_articles(self) -> None:
        """Where no tag or role says article, elements named like one are marked, if they hold text."""
        if self.marked or not self._by_name:
            return
        marked = list(self.events)
        for start, _ in self._by_name:
            depth = 0
            if marked[start].mark == MAIN:
                continue
            for i in range(start, len(marked)):
                e = marked[i]
                depth += (e.kind == OPEN) - (e.kind == CLOSE)
                if e.mark == PLAIN:
                    marked[i] = e._replace(mark=MAIN)
                if not depth:
                    break
        if any(e.kind == TEXT and e.mark == MAIN for e in marked):
            self.events, self.marked = marked, 1

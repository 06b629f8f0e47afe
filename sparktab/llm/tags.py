"""Leaf blocks of an HTML page: text runs with the path of elements above them."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

#: Elements that stand within a line of text and do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp "
    "small span strike strong sub sup time tt u var "
    "math annotation maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace "
    "msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
#: Elements without content; a line break is white space, others end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
VOID_INLINE = frozenset("img wbr input".split())
#: Elements whose content is no text of the page, and those of them that hold raw text and no elements.
SILENT = frozenset("script style noscript template iframe object svg canvas audio video textarea select title".split())
RAW = frozenset("script style iframe textarea title".split())
#: Start tags that end a drawing left open.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta "
    "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Elements whose end tag may be left out, and the start tags that end them.
_SECTIONS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
_CELLS = frozenset("td th tr tbody tfoot".split())
ENDED_BY = {
    "p": _SECTIONS,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": _CELLS,
    "th": _CELLS,
}
#: A comment, a tag (slash, name, attributes), or a declaration. Possessive: no place is tried twice.
MARKUP = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*+)((?:[^"'>]|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)[^>]*+>|<[!?/][^>]*+>""",
    re.DOTALL,
)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
NAME_PARTS = re.compile(r"[a-z]+")


class Block(NamedTuple):
    """A run of text, the element and name parts on its path, and how many characters are links."""

    path: tuple[str, ...]
    text: str
    link_chars: int


class _Page:
    """Open elements and the text gathered since the last block ended."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.names: list[tuple[str, ...]] = []
        self.blocks: list[Block] = []
        self.pieces: list[str] = []
        self.link_chars = self.links = 0

    def flush(self) -> None:
        if self.pieces:
            text = " ".join(unescape("".join(self.pieces)).split())
            if text:
                path = tuple(part for names in self.names for part in names)
                self.blocks.append(Block(path, text, self.link_chars))
            self.pieces = []
        self.link_chars = 0

    def cut(self, spot: int) -> None:
        if "a" in self.tags[spot:]:
            self.links = self.tags[:spot].count("a")
        del self.tags[spot:], self.names[spot:]

    def open(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.flush()
            while self.tags:  # an element whose end tag was left out, and inline ones open in it
                spot = len(self.tags) - 1
                while spot >= 0 and self.tags[spot] in INLINE:
                    spot -= 1
                if spot < 0 or tag not in ENDED_BY.get(self.tags[spot], ()):
                    break
                self.cut(spot)
        elif tag == "a":
            self.links += 1
        names = [] if tag in INLINE else [tag]
        if attributes and "=" in attributes:
            for found in NAMES.findall(attributes):
                names += ["." + part for part in NAME_PARTS.findall("".join(found).lower())]
        self.tags.append(tag)
        self.names.append(tuple(names))

    def close(self, tag: str) -> None:
        inline = tag in INLINE
        if not inline:
            self.flush()
        for spot in range(len(self.tags) - 1, -1, -1):
            if self.tags[spot] == tag:
                self.cut(spot)
                return
            if inline and self.tags[spot] not in INLINE:
                return  # closes nothing outside its block

    def add(self, text: str) -> None:
        self.pieces.append(text)
        if self.links:
            self.link_chars += len(text)


def _past(html: str, at: int, tag: str) -> int:
    """The place behind the end tag of a silent element; those of its kind within it have ends of their own."""
    if tag in RAW:
        end = re.compile(f"</{tag}[^>]*>", re.IGNORECASE).search(html, at)
        return end.end() if end else len(html)
    depth, embedded = 1, 0
    while match := MARKUP.search(html, at):
        at = match.end()
        name = (match[2] or match[5] or "").lower()
        closing = bool(match[1] or match[4])
        if name == tag:
            depth += -1 if closing else 0 if self_closed(tag, match[3]) else 1
            if not depth:
                return at
        elif tag == "svg" and name == "foreignobject":
            embedded += -1 if closing else 0 if self_closed("svg", match[3]) else 1
        elif tag == "svg" and embedded <= 0 and not closing and name in BREAKOUT:
            return match.start()
    return len(html)


def self_closed(tag: str, attributes: str | None) -> bool:
    """Whether a start tag ends itself; only drawings and formulas can."""
    return tag in ("svg", "math") and (attributes or "").rstrip().endswith("/")


def leaf_blocks(html: str) -> list[Block]:
    """The page's text blocks in order; comments, scripts, styles and other silent parts are left out."""
    page, at = _Page(), 0
    search = MARKUP.search
    while match := search(html, at):
        if match.start() > at:
            page.add(html[at : match.start()])
        at = match.end()
        tag = (match[2] or match[5] or "").lower()
        if not tag:
            continue
        if tag == "br":  # its end tag is a line break too
            page.add(" ")
        elif match[1] or match[4]:
            if tag not in VOID:
                page.close(tag)
        elif tag in VOID:
            if tag not in VOID_INLINE:
                page.flush()
        elif self_closed(tag, match[3]):
            page.add(" ")
        elif tag in SILENT:
            page.flush()
            at = _past(html, at, tag)
        else:
            page.open(tag, match[3] or "")
    if at < len(html):
        page.add(html[at:])
    page.flush()
    return page.blocks

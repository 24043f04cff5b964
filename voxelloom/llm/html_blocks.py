"""Leaf blocks of an HTML page: runs of inline text between block boundaries,
with the tags and the class and id words of their ancestors.

One pass over the page, in time linear in its length whatever it holds: open
quotes, comments and tags are looked for once, ancestor words are kept as sets
shared along the stack.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

# HTML's block-level elements, elements without an end tag, elements whose
# content is text up to their own end tag, and elements whose content is never page text.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5
h6 head header hgroup hr html label legend li listing main menu nav noscript ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead
tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
HIDDEN = frozenset("head noscript svg template".split())
SECTIONS = frozenset("article aside body dialog fieldset figure footer form header main menu nav section".split())
#: Start tags that end an open element of the same family right above them.
FAMILIES = {t: f for f in (("li",), ("dt", "dd"), ("td", "th"), ("tr",), ("option",)) for t in f}

NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")
STOP = re.compile(r"[>\"']")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])", re.IGNORECASE) for t in RAW}


@dataclass(slots=True)
class Block:
    text: str
    tag: str  # innermost block element
    section: str  # innermost sectioning element
    above: frozenset[str]  # tags and class words of all ancestors
    named: frozenset[str]  # class and id words of the innermost ancestor that has any
    own: frozenset[str]  # class and id words of the innermost block element
    linked: int  # characters inside links
    depth: int


@dataclass(slots=True)
class Frame:
    tag: str
    section: str
    above: frozenset[str]
    named: frozenset[str]
    own: frozenset[str]
    hidden: bool


@dataclass
class Reader:
    known: frozenset[str] | None = None  # only these ancestor words are kept, if given
    stack: list[Frame] = field(default_factory=lambda: [Frame("", "", frozenset(), frozenset(), frozenset(), False)])
    open: Counter = field(default_factory=Counter)
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    link_depth: int = 0  # depth of the stack where the open link began, 0 for none
    title: str = ""

    def text(self, raw: str) -> None:
        if raw and not self.stack[-1].hidden:
            piece = html.unescape(raw) if "&" in raw else raw
            self.parts.append(piece)
            if self.link_depth:
                self.linked += len(piece) - piece.count(" ")

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = self.stack[-1]
                self.blocks.append(Block(text, top.tag, top.section, top.above, top.named, top.own, self.linked, len(self.stack)))
            self.parts, self.linked = [], 0

    def pop(self) -> None:
        self.open[self.stack.pop().tag] -= 1
        if self.link_depth > len(self.stack):
            self.link_depth = 0

    def start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.link_depth = len(self.stack)
        if tag == "br" or tag in ("img", "wbr"):
            self.parts.append(" " if tag != "wbr" else "")
        if tag not in BLOCK:
            return
        self.flush()
        if self.open["p"] and tag not in ("button", "label", "option", "select"):
            while self.stack[-1].tag != "p":
                self.pop()
            self.pop()
        if self.stack[-1].tag in FAMILIES.get(tag, ()):
            self.pop()
        if tag in VOID:
            return
        top = self.stack[-1]
        words, hidden = names(attributes) if attributes else ((), False)
        fresh = {w for w in (f"<{tag}", *words) if self.known is None or w in self.known} - top.above
        named = frozenset(w for w in words if self.known is None or w in self.known)
        self.open[tag] += 1
        self.stack.append(Frame(tag, tag if tag in SECTIONS else top.section, top.above | fresh if fresh else top.above, named or top.named, named,
                                top.hidden or hidden or tag in HIDDEN))

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link_depth = 0
        if tag not in BLOCK:
            return
        self.flush()
        if self.open[tag]:
            while self.stack[-1].tag != tag:
                self.pop()
            self.pop()


def names(attributes: str) -> tuple[tuple[str, ...], bool]:
    """Lower-case words of class, id and role values, and whether the element is hidden."""
    words, hidden = [], False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
        if name in ("class", "id", "role"):
            words += [w.lower() for w in WORD.findall(value)]
        elif name == "hidden":
            hidden = True
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
    return tuple(words), hidden


def read(page: str, known: frozenset[str] | None = None) -> Reader:
    """The page's blocks in order, and its title."""
    out = Reader(known)
    at, size = 0, len(page)
    gone = {c: size for c in ">\"'"}  # from here on the character does not occur again
    while at < size:
        left = page.find("<", at)
        if left < 0:
            left = size
        out.text(page[at:left])
        if left >= size - 1:
            out.text(page[left:])
            break
        follow = page[left + 1]
        if follow.isascii() and follow.isalpha() or follow == "/" and page[left + 2 : left + 3].isascii() and page[left + 2 : left + 3].isalpha():
            m = NAME.match(page, left + 1 + (follow == "/"))
            tag, right = m.group().lower(), tag_end(page, m.end(), gone)
            if right < 0:  # an unfinished tag at the end is no text
                break
            at = right + 1
            if follow == "/":
                out.end(tag)
                continue
            if tag in RAW:
                stop = RAW_END[tag].search(page, at)
                if tag == "title" and not out.title:
                    out.title = " ".join(html.unescape(page[at : stop.start() if stop else size]).split())
                at = stop.start() if stop else size
                continue
            out.start(tag, page[m.end() : right])
        elif follow in "!?/":
            if page.startswith("<!--", left):
                right = page.find("-->", left + 4) if not page.startswith(("<!-->", "<!--->"), left) else page.find(">", left) - 2
                at = right + 3 if right >= 0 else size
            else:
                right = page.find(">", left)
                at = right + 1 if right >= 0 else size
        else:
            out.text("<")
            at = left + 1
    out.flush()
    return out


def tag_end(page: str, at: int, gone: dict[str, int]) -> int:
    """Place of the ``>`` that ends a tag; one inside a quoted value does not.
    A quote that is never closed is an ordinary character."""
    while True:
        if at >= gone[">"]:
            return -1
        m = STOP.search(page, at)
        if m is None:
            gone[">"] = at
            return -1
        c, at = m.group(), m.end()
        if c == ">":
            return m.start()
        if at < gone[c] and page[: m.start()][-8:].rstrip().endswith("="):
            close = page.find(c, at)
            if close < 0:
                gone[c] = at
            elif page.find(">", close) >= 0:
                at = close + 1
            else:
                gone[c] = at  # closing there would leave the tag open for ever

"""Leaf blocks of raw HTML, with the context that tells articles from the rest.

A block is a run of text between two block-level tags. Malformed pages are read as
browsers would: a paragraph ends where the next block begins, tags left open are
closed by the end of what encloses them, an unfinished tag at the end is dropped.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Element classes of the HTML standard.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td "
    "tfoot th thead title tr ul video audio button".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "object", "canvas", "select", "xmp", "noembed", "noframes")
CLOSES_PARAGRAPH = BLOCK_TAGS - {"body", "head", "html", "option", "button", "tbody", "td", "tfoot", "th", "thead", "tr", "caption"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SELF_SCOPE = frozenset("ul ol dl table menu select".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(" + "|".join(RAW_TAGS) + r")\b[^>]*>.*?(?:</\1\s*[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Block:
    text: str
    own: str  # the innermost block-level tag
    tags: frozenset  # of the open elements
    names: frozenset  # words of their class, id and role attributes
    linked: int  # characters within links


class _Open:
    """The open elements. Each entry carries what holds for all up to it, and each tag knows its
    places, so that no step looks through the stack."""

    def __init__(self, known: frozenset | None):
        self.known, self.stack, self.places = known, [], {}
        self.blocks: list[int] = []  # places of block-level elements

    def last(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else -1

    def last_block(self) -> int:
        return self.blocks[-1] if self.blocks else -1

    def push(self, tag: str, names: frozenset) -> None:
        _, own, tags, all_names = self.stack[-1] if self.stack else ("", "none", frozenset(), frozenset())
        if self.known is not None:
            names = names & self.known
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK_TAGS:
            own = tag
            self.blocks.append(len(self.stack))
        known_tag = tag in tags or self.known is not None and tag not in self.known
        self.stack.append((tag, own, tags if known_tag else tags | {tag}, all_names if names <= all_names else all_names | names))

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in BLOCK_TAGS:
                self.blocks.pop()


def _attribute_words(attributes: str) -> frozenset:
    if "=" not in attributes:
        return frozenset()
    found = " ".join(_NAMES.findall(attributes))
    return frozenset(_WORD.findall(_CAMEL.sub(" ", found).lower())) if found else frozenset()


def leaf_blocks(page: str, known: frozenset | None = None) -> list[Block]:
    """All blocks with text, in page order; each text has its references decoded and white space
    joined. Only tags and names among ``known`` are noted, if it is given: their number bounds the
    work for a block, however deep it is nested."""
    blocks: list[Block] = []
    open_ = _Open(known)
    parts: list[str] = []
    linked = 0

    def close_block():
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, own, tags, names = open_.stack[-1] if open_.stack else ("", "none", frozenset(), frozenset())
                blocks.append(Block(text, own, tags, names, linked))
            parts, linked = [], 0

    def add(text: str):
        nonlocal linked
        if text:
            parts.append(text)
            if open_.last("a") >= 0:
                linked += len(text.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if m[1] or not m[3]:
            continue
        tag = m[3].lower()
        if tag == "br":
            add(" ")
        if m[2]:  # an end tag
            k = open_.last(tag)
            if tag in BLOCK_TAGS:
                close_block()
            if k >= 0 and (tag in BLOCK_TAGS or open_.last_block() < k):
                open_.pop_to(k)
            continue
        if tag in BLOCK_TAGS:
            close_block()
            if tag in CLOSES_PARAGRAPH and (k := open_.last("p")) >= 0 and open_.last_block() == k:
                open_.pop_to(k)
            if tag in SELF_CLOSING:
                k = max(map(open_.last, SELF_CLOSING[tag]))
                if k > max(map(open_.last, SELF_SCOPE)):
                    open_.pop_to(k)
            if tag in ("body", "article", "main", "nav", "header", "footer") and open_.places.get("head"):
                open_.pop_to(open_.places["head"][0])
        if tag not in VOID_TAGS and not (m[4] or "").endswith("/"):
            open_.push(tag, _attribute_words(m[4] or ""))
    add(page[at:])
    close_block()
    return blocks


def block_features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that each block has."""
    out = []
    for k, b in enumerate(blocks):
        n = len(b.text)
        f = ["own " + b.own, "bias"]
        f += ["in " + t for t in sorted(b.tags)]
        f += ["name " + w for w in sorted(b.names)]
        share = b.linked / n
        f.append("links " + ("all" if share > 0.8 else "many" if share > 0.3 else "few" if share > 0 else "none"))
        f.append(f"length {min(8, n.bit_length())}")
        f.append("ends " + ("sentence" if b.text[-1] in ".!?\"')" else "open"))
        if b.text[0] in "©" or "©" in b.text[:40]:
            f.append("copyright")
        if not k:
            f.append("first")
        out.append(f)
    return out

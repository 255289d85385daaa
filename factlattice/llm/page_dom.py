"""A small HTML reader: a tree of elements whose text is gathered into blocks."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Comments, sections, declarations, end tags, start tags, and start tags with a quote that nothing closes.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:>|\Z)|[^>]*(?:>|\Z))",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Element names (fixed values of the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe canvas audio video title textarea select".split())
#: Raw elements whose content isn't parsed as markup; of the others in RAW the parsed content is left out.
OPAQUE = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math object q ruby rt rp s samp small span strike strong sub sup svg time tt u var wbr img".split())
#: Start tags that end an open paragraph, and items that end an open item of the same kind.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table div section article main body".split())
#: Elements of HTML that end an open svg or math; all others in there are inline.
BLOCK = ENDS_P | SCOPE | frozenset(ITEMS) | frozenset("html tbody thead tfoot caption colgroup center button dialog legend listing optgroup summary".split())
_RAW_TAG = re.compile(rf"<(?:{'|'.join(sorted(RAW - OPAQUE))})\b", re.I)


@dataclass(eq=False)
class Node:
    tag: str
    attrs: str = ""
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    #: Text blocks directly in this element, with their place in page order.
    blocks: list[tuple[int, str]] = field(default_factory=list)
    #: Characters of links directly in this element.
    link_chars: int = 0
    #: The nearest open paragraph and, by end-giving start tag, the nearest open item, this element included,
    #: up to the next element of SCOPE. Shared with the parent where they are the same.
    open_p: Node | None = None
    open_items: dict[str, Node] = field(default_factory=dict)

    def child(self, tag: str, attrs: str) -> Node:
        """A new last child; what it needs to know of its ancestors is handed down, never looked up."""
        scope = tag in SCOPE
        node = Node(tag, attrs, self, open_p=None if scope else self.open_p, open_items={} if scope else self.open_items)
        if tag == "p":
            node.open_p = node
        ended = [by for by, ends in ITEMS.items() if tag in ends]
        if ended:
            node.open_items = node.open_items | dict.fromkeys(ended, node)
        self.children.append(node)
        return node


def _bare(raw: str) -> str:
    """A start tag's inside after its name, without the end."""
    return raw.removesuffix(">").rstrip()


def _attr_text(raw: str) -> str:
    if "=" not in raw:
        return ""
    return " ".join(v1 or v2 or v3 or "" for name, v1, v2, v3 in _ATTR.findall(raw) if name.lower() in ("class", "id", "role", "itemprop", "aria-label"))


def _after(page: str, tag: str, at: int) -> int:
    """Where an opaque element that starts before ``at`` ends."""
    end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
    return end.end() if end else len(page)


def _closed(page: str) -> dict[int, int]:
    """For the raw elements that have an end tag before the element around them ends: from the end of
    the start tag to the end of the end tag."""
    out: dict[int, int] = {}
    if not _RAW_TAG.search(page):
        return out
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    at = 0
    while token := _TOKEN.search(page, at):
        at = token.end()
        tag = (token.group(1) or token.group(2) or "").lower()
        if not tag or tag in INLINE or tag in VOID:
            continue
        if token.group(2):
            if tag in OPAQUE:
                at = _after(page, tag, at)
            elif not _bare(token.group(3)).endswith("/"):
                stack.append((tag, at))
                opened[tag] = opened.get(tag, 0) + 1
        elif opened.get(tag):
            while True:
                top, start = stack.pop()
                opened[top] -= 1
                if top == tag:
                    break
            if tag in RAW:
                out[start] = at
    return out


def parse(page: str) -> Node:
    """The tree of block elements. Inline elements dissolve into the block they stand in, except that
    the text of links is marked on it (see ``links``). The text of svg, math and object is inline. A
    head has no text of its own: what isn't head content belongs to the body, whose tag is optional. A
    raw element without an end tag ends at the next block or with the element it stands in."""
    root = Node("#root")
    opened: dict[str, int] = {}  # how many elements of a tag are open: an end tag of none costs nothing
    here, at, place = root, 0, 0
    skip = ""  # the unclosed raw element whose text is left out
    foreign = 0  # open svg and math elements
    closed = _closed(page)
    buffer: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal place, buffer
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                here.blocks.append((place, text))
                place += 1
            buffer = []

    def put(text: str) -> None:
        if text and not skip:
            buffer.append(text)
            if linked:
                here.link_chars += len(text.strip())

    def leave(node: Node) -> None:
        """Close all up to and with ``node``, an open element."""
        nonlocal here
        while True:
            opened[here.tag] -= 1
            last, here = here, here.parent
            if last is node:
                return

    size = len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        if token is None:
            put(page[at:])
            break
        put(page[at : token.start()])
        at = token.end()
        close, open_, raw = token.group(1), token.group(2), _bare(token.group(3) or "")
        if open_:
            tag = open_.lower()
            if tag in OPAQUE:
                at = _after(page, tag, at)
                continue
            if tag in RAW:
                if at in closed:
                    at = closed[at]
                elif not raw.endswith("/"):
                    skip = tag
                continue
            if tag == "head":
                flush()
                continue
            if skip == "select" and tag in ("option", "optgroup"):
                continue
            if tag in ("svg", "math"):
                foreign += not raw.endswith("/")
            elif foreign and tag not in BLOCK:
                if tag == "text":  # a label of a drawing
                    put(" ")
                if tag != "a":
                    continue
            if tag == "br":
                buffer.append("\n")
                continue
            if tag == "a":
                linked += 1
            if tag in INLINE or tag in VOID:
                if tag == "hr":
                    flush()
                continue
            flush()
            skip, foreign = "", 0
            if tag in ENDS_P:
                if here.open_p is not None:
                    leave(here.open_p)
            elif tag in here.open_items:
                leave(here.open_items[tag])
            linked = 0
            node = here.child(tag, _attr_text(raw))
            if not raw.endswith("/"):
                here = node
                opened[tag] = opened.get(tag, 0) + 1
        elif close:
            tag = close.lower()
            if tag == skip:
                skip = ""
                continue
            if tag == "head":
                flush()
                continue
            if tag == "a":
                linked = max(0, linked - 1)
                continue
            if tag in ("svg", "math"):
                foreign = max(0, foreign - 1)
            if tag in INLINE or tag in VOID:
                continue
            if opened.get(tag):
                flush()
                up = here
                while up.tag != tag:
                    up = up.parent
                leave(up)
                linked, skip, foreign = 0, "", 0
    flush()
    return root

"""Edit-aware token counts: a segment tree per document over blocks of pre-tokens.

A text is cut into leaves at places that are always pre-token boundaries (a white space between two
letters or digits starts a new pre-token). The leaves are those of a balanced binary tree, whose nodes
hold the characters and tokens of their subtree. An edit replaces a span of characters: the leaves it
touches, with one leaf of context on either side, are cut out and encoded again, and the parts of the
tree before, between and after are joined; sums change on the paths that this makes, the rest of the
tree is neither encoded nor summed again.

``counts`` counts every document before and after edits that redact e-mail addresses and long numbers.
Defined results: null text counts as empty, with 0 tokens; texts of any length are counted whole; edits
may not overlap and apply to the text as it was; an edit may empty a text; repeated rows are counted
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .byte_bpe import VOCABULARY, read_ranks

LEAF = 512
#: A cut goes before the space: letters or digits on both sides, so no pre-token spans it.
_CUT = re.compile(r"(?<=[^\W_])(?= [^\W_])")
#: What the query's edits replace (fixed patterns).
REDACT = [(re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), "[EMAIL]"), (re.compile(r"\d[\d -]{7,}\d"), "[NUMBER]")]


@functools.lru_cache(maxsize=2)
def encoder(name: str = VOCABULARY):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path(name)), special_tokens={})


def leaves(text: str, size: int = LEAF) -> list[str]:
    out, start = [], 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]] if start < len(text) else out


class Node:
    """A leaf (its text) or two subtrees, with the subtree's sums."""

    __slots__ = ("chars", "height", "left", "right", "text", "tokens")

    def __init__(self, left: Node | None, right: Node | None, text: str = "", tokens: int = 0):
        self.left, self.right, self.text = left, right, text
        if left is None:
            self.chars, self.tokens, self.height = len(text), tokens, 0
        else:
            self.chars, self.tokens, self.height = left.chars + right.chars, left.tokens + right.tokens, 1 + max(left.height, right.height)


def _balanced(left: Node, right: Node) -> Node:
    """A node over two subtrees whose heights differ by two at most."""
    if left.height > right.height + 1:
        if left.left.height >= left.right.height:
            return Node(left.left, Node(left.right, right))
        return Node(Node(left.left, left.right.left), Node(left.right.right, right))
    if right.height > left.height + 1:
        if right.right.height >= right.left.height:
            return Node(Node(left, right.left), right.right)
        return Node(Node(left, right.left.left), Node(right.left.right, right.right))
    return Node(left, right)


def _join(left: Node | None, right: Node | None) -> Node | None:
    """One tree of two, in as many steps as their heights differ."""
    if left is None or right is None:
        return left if right is None else right
    if left.height > right.height + 1:
        return _balanced(left.left, _join(left.right, right))
    if right.height > left.height + 1:
        return _balanced(_join(left, right.left), right.right)
    return Node(left, right)


def _over(leaves_: list[Node]) -> Node | None:
    """A tree over leaves."""
    while len(leaves_) > 1:
        leaves_ = [Node(*leaves_[i : i + 2]) if i + 1 < len(leaves_) else leaves_[i] for i in range(0, len(leaves_), 2)]
    return leaves_[0] if leaves_ else None


def _split(node: Node | None, at: int) -> tuple[Node | None, Node | None]:
    """The leaves that end at or before character ``at``, and the others."""
    if node is None or node.chars <= at:
        return node, None
    if node.left is None:
        return None, node
    if at < node.left.chars:
        left, right = _split(node.left, at)
        return left, _join(right, node.right)
    left, right = _split(node.right, at - node.left.chars)
    return _join(node.left, left), right


def _end(node: Node | None, last: bool) -> int:
    """Characters of the first or last leaf."""
    while node is not None and node.left is not None:
        node = node.right if last else node.left
    return 0 if node is None else node.chars


def _leaves_of(node: Node | None) -> Iterator[Node]:
    stack = [node] if node is not None else []
    while stack:
        node = stack.pop()
        if node.left is None:
            yield node
        else:
            stack += [node.right, node.left]


class Tree:
    """The segment tree of one text; ``encoded`` counts the leaves encoded so far."""

    def __init__(self, text: str, count):
        self.count, self.encoded = count, 0
        self.root = self._of(text)

    def _of(self, text: str) -> Node | None:
        parts = leaves(text)
        self.encoded += len(parts)
        return _over([Node(None, None, p, self.count(p)) for p in parts])

    @property
    def tokens(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def segments(self) -> int:
        return sum(1 for _ in _leaves_of(self.root))

    @property
    def text(self) -> str:
        return "".join(leaf.text for leaf in _leaves_of(self.root))

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters [start, end) by ``new``."""
        before, rest = _split(self.root, start)  # the first leaf of the rest holds ``start``
        context = before.chars - _end(before, last=True) if before else 0
        before, first = _split(before, context)
        rest = _join(first, rest)
        region, after = _split(rest, end - context)  # all leaves but the one that holds ``end``
        for _ in range(2):  # that one, and one of context
            more, after = _split(after, _end(after, last=False))
            region = _join(region, more)
        old = "".join(leaf.text for leaf in _leaves_of(region))
        middle = self._of(old[: start - context] + new + old[end - context :])
        self.root = _join(_join(before, middle), after)


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Spans to replace, from the end of the text on, without overlaps."""
    found = sorted((m.start(), m.end(), to) for pattern, to in REDACT for m in pattern.finditer(text))
    out, free = [], 0
    for start, end, to in found:
        if start >= free:
            out.append((start, end, to))
            free = end
    return out[::-1]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = encoder().encode_ordinary
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            tree = Tree(text or "", lambda s: len(encode(s)))
            before, segments, tree.encoded = tree.tokens, tree.segments, 0
            edits = redactions(text or "")
            for edit in edits:
                tree.edit(*edit)
            rows.append((before, tree.tokens, len(edits), segments, tree.encoded))
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_tokens", "n_tokens_edited", "n_edits", "n_segments", "n_encoded_again"])


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_edits, n_segments, n_encoded_again for ``docs`` (doc_id, text)."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(common.tidy(_run), "doc_id long, n_tokens long, n_tokens_edited long, n_edits long, n_segments long, n_encoded_again long")


def query(spark, sf_dir: str) -> DataFrame:
    return counts(common.table(spark, sf_dir, "documents").select("doc_id", "text"))

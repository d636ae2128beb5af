"""Token counts that follow edits: a segment tree over runs of pre-tokens for each document, kept as a table.

A leaf is a stretch of text between safe boundaries (see ``bpe``), so a document's count is the sum of its leaves' counts. An edit
re-encodes the leaves it touches, and the neighbours whose boundary it makes unsafe, and updates the sums above them. What it rewrites is
cut into leaves again, so leaves stay short however often a place is edited; a subtree that has become lopsided is built anew.

``build_trees`` stores a document's leaves and their counts in a row; ``edit_trees`` takes such rows up, edits them and gives rows of the
same form, so a text is encoded whole only once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidestream.llm.bpe import encode_part, encoding
from slidestream.llm.common import arrow_map, texts

RANKS = "byte_bpe_50k.tiktoken"
LEAF_CHARS = 512
#: A subtree is built anew once one of its sides has more than this share of its leaves.
LOPSIDED = 0.75
TREES = "doc_id long, leaves array<string>, counts array<long>"
EDITED = "n_tokens long, n_edits long, n_tokens_edited long, n_leaves long, n_chars_edited long, n_chars_encoded long"
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
Edit = tuple[int, int, str]


def segments(text: str, size: int = LEAF_CHARS) -> list[str]:
    """The text in stretches of about ``size``; each but the first starts with a space or line feed after another character."""
    out, at = [], 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


class Node:
    """A leaf with its text, or two subtrees; characters, tokens and leaves below."""

    __slots__ = ("chars", "tokens", "leaves", "text", "left", "right")

    def __init__(self, text: str | None, tokens: int = 0, left: Node | None = None, right: Node | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.chars, self.tokens, self.leaves = len(text), tokens, 1
        else:
            self.sum()

    def sum(self) -> None:
        a, b = self.left, self.right
        self.chars, self.tokens, self.leaves = a.chars + b.chars, a.tokens + b.tokens, a.leaves + b.leaves


def built(leaves: list[Node]) -> Node | None:
    """A tree of least depth, level by level."""
    while len(leaves) > 1:
        leaves = [Node(None, 0, *leaves[k : k + 2]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
    return leaves[0] if leaves else None


def leaves_of(node: Node) -> list[Node]:
    out, left = [], [node]
    while left:
        n = left.pop()
        if n.left is None:
            out.append(n)
        else:
            left += (n.right, n.left)
    return out


def spliced(node: Node, a: int, b: int, new: list[Node]) -> Node | None:
    """The tree with leaves a to b - 1 replaced. Only nodes above them change."""
    if a <= 0 and b >= node.leaves:
        return built(new)
    mid = node.left.leaves
    left = spliced(node.left, a, min(b, mid), new) if a < mid else node.left
    right = spliced(node.right, max(a - mid, 0), b - mid, [] if a < mid else new) if b > mid else node.right
    if left is None or right is None:
        return left or right
    node.left, node.right = left, right
    node.sum()
    if max(left.leaves, right.leaves) > LOPSIDED * node.leaves + 1:
        return built(leaves_of(node))
    return node


class CountTree:
    """Characters and tokens of every subtree of a text."""

    def __init__(self, text: str, count: Callable[[str], int], leaf_chars: int = LEAF_CHARS):
        self._start(segments(text, leaf_chars), None, count, leaf_chars)

    @classmethod
    def stored(cls, leaves: list[str], counts: list[int], count: Callable[[str], int], leaf_chars: int = LEAF_CHARS) -> CountTree:
        """The tree of leaves that were encoded before."""
        out = cls.__new__(cls)
        out._start(leaves, counts, count, leaf_chars)
        return out

    def _start(self, leaves: list[str], counts: list[int] | None, count: Callable[[str], int], leaf_chars: int) -> None:
        self.count, self.leaf_chars, self.encoded_chars = count, leaf_chars, 0
        counts = [count(x) for x in leaves] if counts is None else counts
        self.root = built([Node(x, n) for x, n in zip(leaves, counts)]) or Node("")

    @property
    def total(self) -> int:
        return self.root.tokens

    @property
    def leaves(self) -> list[str]:
        return [n.text for n in leaves_of(self.root)]

    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf_at(self, offset: int) -> tuple[int, int]:
        """The number of the leaf that holds the offset, and where it starts; the last leaf for the end of the text."""
        node, number, start = self.root, 0, 0
        while node.left is not None:
            if offset - start >= node.left.chars and node.right.chars:
                number, start, node = number + node.left.leaves, start + node.left.chars, node.right
            else:
                node = node.left
        return number, start

    def _leaf(self, number: int) -> str:
        node = self.root
        while node.left is not None:
            if number >= node.left.leaves:
                number, node = number - node.left.leaves, node.right
            else:
                node = node.left
        return node.text

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters ``start`` to ``end - 1`` by ``new``."""
        self._rewrite([(start, end, new)])

    def _rewrite(self, edits: list[Edit]) -> None:
        """Edits that touch the same leaves, as one region."""
        first, at = self._leaf_at(edits[0][0])
        last = self._leaf_at(max(edits[-1][0], edits[-1][1] - 1))[0]
        old, out, done = "".join(self._leaf(k) for k in range(first, last + 1)), [], 0
        for start, end, new in edits:
            out += [old[done : start - at], new]
            done = end - at
        text, n = "".join([*out, old[done:]]), self.root.leaves
        while True:  # context: until both borders are safe again; a short rest joins its neighbour
            short = len(text) < self.leaf_chars // 4
            if first > 0 and text and (text[0] not in " \n" or short):
                first -= 1
                text = self._leaf(first) + text
            elif last + 1 < n and text and (text[-1].isspace() or short):
                last += 1
                text += self._leaf(last)
            else:
                break
        new_leaves = [Node(x, self.count(x)) for x in segments(text, self.leaf_chars)] if text else []
        self.encoded_chars += len(text)
        self.root = spliced(self.root, first, last + 1, new_leaves) or Node("")

    def apply(self, edits: list[Edit]) -> None:
        """Edits in ascending order, without overlap, by offsets of the text as it was. Each leaf is encoded once for all edits in it."""
        groups: list[tuple[list[Edit], int]] = []
        for e in edits:
            first, last = self._leaf_at(e[0])[0], self._leaf_at(max(e[0], e[1] - 1))[0]
            if groups and first <= groups[-1][1]:
                groups[-1][0].append(e)
                groups[-1] = (groups[-1][0], max(last, groups[-1][1]))
            else:
                groups.append(([e], last))
        for group, _ in reversed(groups):
            self._rewrite(group)


def valid_edits(edits: list[Edit], size: int) -> list[Edit]:
    """In ascending order, clamped to a text of ``size`` characters; without those that start before an earlier one's end."""
    out: list[Edit] = []
    for start, end, new in sorted(edits):
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        if not out or start >= out[-1][1]:
            out.append((start, end, new))
    return out


_ADDRESS = re.compile(r"(?<!\S)[^\s@]++@\S+")
_NUMBER = re.compile(r"(?<![0-9])[0-9]{5,}")


def mask_edits(text: str) -> list[Edit]:
    """What a privacy pass changes: words with an @, digit runs of five or more; and a line feed at the end if there is none."""
    edits = [(m.start(), m.end(), "<address>") for m in _ADDRESS.finditer(text)] if "@" in text else []
    starts, ends = [-1, *(a for a, _, _ in edits)], [-1, *(b for _, b, _ in edits)]
    edits += [(m.start(), m.end(), "<number>") for m in _NUMBER.finditer(text) if m.start() >= ends[bisect_right(starts, m.start()) - 1]]
    if text[-1:] != "\n":
        edits.append((len(text), len(text), "\n"))
    return sorted(edits)


def _counter(path: str) -> Callable[[str], int]:
    enc = encoding(path)
    return lambda s: len(encode_part(enc, s))


def build_trees(docs: DataFrame, ranks: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``TREES``: the leaves of each row's text, which in a row are the text, and their token counts.

    A null or empty text is one empty leaf; a null doc_id stays null; repeated rows give repeated results; other columns are ignored; an
    empty table gives no rows. A text without a safe boundary is one leaf, however long.
    """
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for b in batches:
            leaves = [segments(t, leaf_chars) for t in texts(b.column(1))]
            counts = [[count(x) for x in row] for row in leaves]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(leaves, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "leaves", "counts"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, TREES)


def edit_trees(trees: DataFrame, edits: DataFrame | None = None, edits_of: Callable[[str], list[Edit]] = mask_edits, ranks: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """The columns of ``TREES`` after edits, and of each row ``EDITED``: tokens before, edits, tokens, leaves and characters after, and
    how many characters were encoded anew.

    ``edits(doc_id, start, end, new)`` holds edits by offsets in code points of the texts as stored; without it ``edits_of`` names them
    from the text. Offsets are clamped to the text; an edit that starts before the end of an earlier one, by (start, end, new), is left
    out, as are edits with a null or of no stored document; a repeated document gets them in every copy. Null leaves count as empty.
    An empty table gives no rows.
    """
    path = ranks or public_tokenizers.path(RANKS)
    given = edits is not None
    rows = trees.select("doc_id", "leaves", "counts")
    if given:
        known = edits.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.col("start").cast("long").alias("a"), F.col("end").cast("long").alias("b"), F.col("new").alias("t")).alias("e"))
        known = known.where("doc_id is not null and e.a is not null and e.b is not null and e.t is not null")
        rows = rows.join(known.groupBy("doc_id").agg(F.collect_list("e").alias("edits")), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, names = _counter(path), [x.split()[0] for x in EDITED.split(", ")]
        for b in batches:
            leaves, counts, out = [], [], []
            of = b.column(3).to_pylist() if given else [None] * b.num_rows
            for texts_, numbers, asked in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), of):
                tree = CountTree.stored(texts_ or [], numbers or [], count, leaf_chars)
                before = tree.total
                todo = valid_edits([(e["a"], e["b"], e["t"]) for e in asked or []] if given else edits_of(tree.text()), tree.root.chars)
                tree.apply(todo)
                nodes = leaves_of(tree.root)
                leaves.append([n.text for n in nodes])
                counts.append([n.tokens for n in nodes])
                out.append((before, len(todo), tree.total, len(nodes), tree.root.chars, tree.encoded_chars))
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(leaves, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64())), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "leaves", "counts", *names])

    return arrow_map(rows, run, f"{TREES}, {EDITED}")


def token_counts(docs: DataFrame, folder: str, edits_of: Callable[[str], list[Edit]] = mask_edits, ranks: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``doc_id`` and ``EDITED`` of each row: trees of the texts are written to ``folder`` as Parquet, read again and edited.

    ``n_tokens`` counts the text, ``n_tokens_edited`` the text after ``edits_of(text)``, found by encoding ``n_chars_encoded`` of its
    ``n_chars_edited`` characters anew. A null text counts as empty; repeated rows give repeated results; other columns are ignored; an
    empty table gives no rows.
    """
    build_trees(docs, ranks, leaf_chars).write.mode("overwrite").parquet(folder)
    trees = docs.sparkSession.read.schema(TREES).parquet(folder)
    return edit_trees(trees, None, edits_of, ranks, leaf_chars).drop("leaves", "counts")

"""Token counts under edits: a segment tree over each document's pre-tokens.

A leaf holds the length and the number of tokens of one pre-token, an inner node the sums below it.  An edit
(start, end, replacement; code points) descends to the pre-tokens it touches, takes a few characters of
context before them, and finds pre-tokens anew only until a boundary meets an old one behind the edit: from
there on the pattern sees what it saw before.  Counts of known pre-tokens are kept; only new ones are encoded.
The replaced leaves become a subtree of their own and the sums on the path to it change; all other leaves stay.

Null text counts as empty; edits are clipped to the text and applied one after another, each in the
coordinates that its predecessors left; a null or empty list of edits changes nothing.  Repeated rows give
repeated results, an empty table none.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.bpe import VOCABULARY, read_ranks
from strandmill.llm.common import rows, tune
from strandmill.llm.pretokens import LONG, Words, chunks, pattern, pre_tokens

#: The pattern looks at most two characters past the end of a pre-token ('ll against a lone mark, or the
#: character after white space), so those that end this far before an edit stay as they are.
CONTEXT = 3
EDIT = "struct<start:long,stop:long,text:string>"
#: Pre-tokens whose counts a worker keeps.
SINGLES = 300_000


class Node:
    """A part of the sequence of pre-tokens: a leaf block (arrays of lengths and counts) or two parts."""

    __slots__ = ("chars", "counts", "left", "lengths", "leaves", "right", "tokens")

    def __init__(self, lengths: np.ndarray | None, counts: np.ndarray | None, left: Node | None = None, right: Node | None = None):
        self.lengths, self.counts, self.left, self.right = lengths, counts, left, right
        if left is None:
            self.leaves, self.chars, self.tokens = len(lengths), int(lengths.sum()), int(counts.sum())
        else:
            self.leaves, self.chars, self.tokens = left.leaves + right.leaves, left.chars + right.chars, left.tokens + right.tokens


#: Pre-tokens that one block at the bottom of a tree holds.
BLOCK = 64


def build(lengths: np.ndarray, counts: np.ndarray) -> Node:
    if len(lengths) <= BLOCK:
        return Node(lengths, counts)
    mid = len(lengths) // 2
    return Node(None, None, build(lengths[:mid], counts[:mid]), build(lengths[mid:], counts[mid:]))


def split(node: Node, leaf: int) -> tuple[Node, Node]:
    """The parts before and from the leaf of that number; only the nodes on one path are made anew."""
    if node.left is None:
        return Node(node.lengths[:leaf], node.counts[:leaf]), Node(node.lengths[leaf:], node.counts[leaf:])
    if leaf < node.left.leaves:
        a, b = split(node.left, leaf)
        return a, joined(b, node.right)
    a, b = split(node.right, leaf - node.left.leaves)
    return joined(node.left, a), b


def joined(a: Node, b: Node) -> Node:
    """Both parts in order; along the larger one's edge, so that the tree stays shallow."""
    if not a.leaves:
        return b
    if not b.leaves:
        return a
    if a.left is None and b.left is None and a.leaves + b.leaves <= BLOCK:
        return Node(np.concatenate([a.lengths, b.lengths]), np.concatenate([a.counts, b.counts]))
    if a.leaves > 3 * b.leaves and a.left is not None:
        return Node(None, None, a.left, joined(a.right, b))
    if b.leaves > 3 * a.leaves and b.left is not None:
        return Node(None, None, joined(a, b.left), b.right)
    return Node(None, None, a, b)


def locate(node: Node, char: int) -> tuple[int, int]:
    """Number and first character of the leaf that holds a character; past the end: of the end."""
    if char >= node.chars:
        return node.leaves, node.chars
    leaf = at = 0
    while node.left is not None:
        if char - at < node.left.chars:
            node = node.left
        else:
            leaf, at, node = leaf + node.left.leaves, at + node.left.chars, node.right
    ends = np.cumsum(node.lengths)
    k = int(np.searchsorted(ends, char - at, side="right"))
    return leaf + k, at + (int(ends[k - 1]) if k else 0)


class Counter:
    def __init__(self, path: str):
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
        self.one, self.find = encoding.encode_ordinary, pattern().finditer
        self.known = Words(lambda words: [self._scan(w) for w in words])
        #: token counts of short pre-tokens, at most SINGLES of them
        self.single: dict[str, int] = {}

    def _count(self, pre_token: str) -> int:
        n = self.single.get(pre_token)
        if n is None:
            n = len(self.one(pre_token))
            if len(pre_token) <= LONG:
                if len(self.single) >= SINGLES:
                    self.single.clear()
                self.single[pre_token] = n
        return n

    def _scan(self, chunk: str) -> bytes:
        """Lengths, then token counts, of the chunk's pre-tokens."""
        words = pre_tokens(chunk)
        return np.array([*map(len, words), *map(self._count, words)], np.int32).tobytes()

    def trees(self, texts: list[str]) -> list[Node]:
        parts = list(map(chunks, texts))
        self.known.of(parts)
        out = []
        for p in parts:
            got = [self.known[c] for c in p]
            out.append(build(*(np.frombuffer(b"".join([g[len(g) // 2 :] if i else g[: len(g) // 2] for g in got]), np.int32) for i in (0, 1))))
        return out

    def edited(self, text: str, tree: Node, start: int, stop: int, new: str) -> tuple[str, Node, int]:
        """Text and tree after an edit, and how many pre-tokens were found anew."""
        start = min(max(start, 0), len(text))
        stop = min(max(stop, start), len(text))
        after = text[:start] + new + text[stop:]
        first, at = locate(tree, max(0, start - CONTEXT))
        if first == tree.leaves and first:  # the edit follows the last pre-token
            first, at = locate(tree, tree.chars - 1)
        shift, resume = len(new) - (stop - start), start + len(new)
        lengths, counts, pos, last = [], [], at, None
        found = self.find(after, at)
        while last is None:
            if pos >= resume:  # behind the edit: did an old pre-token start here as well?
                leaf, char = locate(tree, pos - shift)
                last = leaf if char == pos - shift else None
            if last is None:
                m = next(found)
                lengths.append(m.end() - pos)
                counts.append(self._count(m.group()))
                pos = m.end()
        head = split(tree, first)[0]
        tail = split(tree, last)[1]
        middle = build(np.array(lengths, np.int32), np.array(counts, np.int32))
        return after, joined(joined(head, middle), tail), len(lengths)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_edited(docs: DataFrame, edits: Column, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens (before), n_tokens_edited, n_recounted (pre-tokens found anew by all edits).

    ``edits`` is an array of ``EDIT`` for each row.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    tune(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), edits.cast(f"array<{EDIT}>").alias("edits"))
    names = ["doc_id", "n_pretokens", "n_tokens", "n_tokens_edited", "n_recounted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in rows(batches):
            texts, out = b.column(1).to_pylist(), []
            for text, tree, changes in zip(texts, c.trees(texts), b.column(2).to_pylist(), strict=True):
                before, found = (tree.leaves, tree.tokens), 0
                for e in changes or ():
                    text, tree, n = c.edited(text, tree, e["start"] or 0, e["stop"] or 0, e["text"] or "")
                    found += n
                out.append((*before, tree.tokens, found))
            yield pa.record_batch([b.column(0), *(pa.array([x[i] for x in out], pa.int64()) for i in range(4))], names)

    return source.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def sample_edits(text: Column, seed: Column) -> Column:
    """Three edits for each text, by a rule: a correction, a deletion and an insertion.

    They replace 5 characters, delete 40 and insert a short passage, at places that a hash of ``seed`` chooses.
    """
    n = F.length(F.coalesce(text, F.lit(""))).cast("long")
    place = lambda k: F.pmod(F.xxhash64(seed, F.lit(k)), F.greatest(n, F.lit(1)))
    return F.array(
        F.struct(place(1).alias("start"), (place(1) + 5).alias("stop"), F.lit("fixed").alias("text")),
        F.struct(place(2).alias("start"), (place(2) + 40).alias("stop"), F.lit("").alias("text")),
        F.struct(place(3).alias("start"), place(3).alias("stop"), F.lit(" It's one more line,\n  with 12 marks; ").alias("text")),
    )

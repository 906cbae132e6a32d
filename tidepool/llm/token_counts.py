"""Edit-aware token counts: a segment tree over the pre-tokens of each document, kept from one edit to the next.

A text is cut into pre-tokens by the vocabulary's pattern; no token crosses
one, so a text's count is the sum of its pre-tokens' counts. The tree holds
those in its leaves and sums above. An edit re-cuts from a pre-token before
the one it touches, as far as the new cuts meet old ones behind the edit, and
replaces only those leaves; the sums above them follow.

Leaves lie in blocks of ``BLOCK`` pre-tokens. Blocks are the nodes of a tree in
the order of the text that is kept balanced by random priorities: blocks that
an edit replaces are cut out and others joined in, each along one path, so
nothing is built anew however the number of blocks changes.

A tree can leave the operator as a column (lengths and counts of pre-tokens,
compressed) and come back with later edits: then only what those touch is cut
and counted, and the rest of the text is never looked at again.

Defined results: null and empty texts count 0 tokens; an edit beyond a text's
end is one at its end; edits apply in order, each to the result of the one
before; a tree that doesn't fit its text is made anew; rows are independent, so
ties, repeats and null ids need no rule; results replace input columns of the
same name.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from random import Random

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stored import press, unpress

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A fixed value: the pre-token pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK, REMEMBERED = 64, 300_000
#: Pre-tokens after which a cut no longer depends on what precedes: a run of spaces gives its last one to what follows.
CONTEXT = 2


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> Counter:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return Counter(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), pattern)


class Counter:
    """Counts of single pre-tokens, remembered up to a bound."""

    def __init__(self, encoding: tiktoken.Encoding, pattern: str):
        self.encoding, self.pattern = encoding, regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            new = [p for p in set(pieces) if p not in known]
            known.update(zip(new, map(len, map(self.encoding.encode_ordinary, new))))
            return [known[p] for p in pieces]


class Block:
    """Some successive pre-tokens, and the sums over all blocks below it in the tree."""

    __slots__ = ("text", "lengths", "counts", "priority", "left", "right", "size", "chars", "tokens")

    def __init__(self, text: str, lengths: list[int], counts: list[int], priority: float):
        self.text, self.lengths, self.counts, self.priority = text, lengths, counts, priority
        self.left: Block | None = None
        self.right: Block | None = None
        self.sum_up()

    def sum_up(self) -> None:
        self.size, self.chars, self.tokens = 1, len(self.text), sum(self.counts)
        for below in (self.left, self.right):
            if below is not None:
                self.size, self.chars, self.tokens = self.size + below.size, self.chars + below.chars, self.tokens + below.tokens

    def pieces(self) -> list[str]:
        ends = list(accumulate(self.lengths))
        return [self.text[b - n : b] for b, n in zip(ends, self.lengths)]


def _join(a: Block | None, b: Block | None) -> Block | None:
    """One tree of two, the first's blocks before the second's."""
    if a is None or b is None:
        return a or b
    if a.priority > b.priority:
        a.right = _join(a.right, b)
        a.sum_up()
        return a
    b.left = _join(a, b.left)
    b.sum_up()
    return b


def _split(node: Block | None, first: int) -> tuple[Block | None, Block | None]:
    """The first so many blocks, and the others."""
    if node is None:
        return None, None
    before = node.left.size if node.left else 0
    if first <= before:
        a, node.left = _split(node.left, first)
        node.sum_up()
        return a, node
    node.right, b = _split(node.right, first - before - 1)
    node.sum_up()
    return node, b


def _mark(text: str) -> bytes:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")).to_bytes(4, "little")


class CountedText:
    """A text whose token count follows edits. ``tree``: one that was kept of the same text."""

    def __init__(self, text: str, counter: Counter, tree: bytes | None = None):
        self.counter, self.random, self.root, self.recounted = counter, Random(7), None, 0
        if tree and tree[:4] == _mark(text):
            lengths, counts = (c.tolist() for c in unpress(tree[4:], [np.uint32, np.uint32]))
        else:
            pieces = counter.pattern.findall(text)
            lengths, counts = [len(p) for p in pieces], counter.counts(pieces)
            self.recounted = len(pieces)  # pre-tokens counted so far
        self.root = self._grown(text, lengths, counts)

    def _grown(self, text: str, lengths: list[int], counts: list[int], step: int = BLOCK) -> Block | None:
        """A tree over blocks of ``step`` pre-tokens, built from left to right along its right edge."""
        edge: list[Block] = []
        at = 0
        for i in range(0, len(lengths), step):
            size = lengths[i : i + step]
            end = at + sum(size)
            block = Block(text[at:end], size, counts[i : i + step], self.random.random())
            last = None
            while edge and edge[-1].priority < block.priority:
                last = edge.pop()
                last.sum_up()
            block.left = last
            if edge:
                edge[-1].right = block
            edge.append(block)
            at = end
        for block in reversed(edge):
            block.sum_up()
        return edge[0] if edge else None

    @property
    def total(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def blocks(self) -> int:
        return self.root.size if self.root else 0

    def __len__(self) -> int:
        return self.root.chars if self.root else 0

    def each(self) -> Iterator[Block]:
        """Blocks in order."""
        above, node = [], self.root
        while above or node:
            while node:
                above.append(node)
                node = node.left
            node = above.pop()
            yield node
            node = node.right

    def text(self) -> str:
        return "".join(b.text for b in self.each())

    def tree(self) -> bytes:
        """A mark of the text, and lengths and counts of all pre-tokens, to be kept."""
        lengths, counts = [], []
        for b in self.each():
            lengths += b.lengths
            counts += b.counts
        return _mark(self.text()) + press([np.array(lengths, np.uint32), np.array(counts, np.uint32)])

    def _block_at(self, char: int) -> tuple[int, int]:
        """The number of the block that holds a character, or the last one, and the characters before it."""
        node, number, before = self.root, 0, 0
        while True:
            left = node.left
            if left is not None and char < before + left.chars:
                node = left
                continue
            if left is not None:
                number, before = number + left.size, before + left.chars
            if char < before + len(node.text) or node.right is None:
                return number, before
            number, before, node = number + 1, before + len(node.text), node.right

    def _block(self, number: int) -> Block:
        node = self.root
        while True:
            before = node.left.size if node.left else 0
            if number == before:
                return node
            number, node = (number, node.left) if number < before else (number - before - 1, node.right)

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Put ``replacement`` in place of the characters from ``start`` to ``end``."""
        n = len(self)
        start, end = min(start, n), min(max(start, end), n)
        if self.root is None:
            pieces = self.counter.pattern.findall(replacement)
            self.recounted += len(pieces)
            self.root = self._grown(replacement, [len(p) for p in pieces], self.counter.counts(pieces))
            return
        # blocks around the edit: CONTEXT pre-tokens before it; behind it as far as new cuts differ from old ones
        first, before = self._block_at(start)
        last, _ = self._block_at(max(start, end - 1))
        starts = self._starts(first, before, start)
        while first > 0 and len(starts) <= CONTEXT:
            first -= 1
            before -= len(self._block(first).text)
            starts = self._starts(first, before, start)
        keep = max(0, len(starts) - 1 - CONTEXT)
        at = starts[keep] if starts else before
        around = [self._block(i) for i in range(first, last + 1)]
        tail = [p for b in around for p in b.pieces()][keep:]
        while True:
            old = "".join(tail)
            new = old[: start - at] + replacement + old[end - at :]
            cuts = self.counter.pattern.findall(new)
            # the new cuts must meet old ones behind the edit, with a whole pre-token of lookahead to spare
            shift = len(new) - len(old)
            ends = {at + shift + x for x in accumulate(map(len, tail))}
            x, agreed = at, None
            for k, p in enumerate(cuts):
                if x in ends and x >= start + len(replacement) + 1 and x - shift > end and k + 1 < len(cuts):
                    agreed = k
                    break
                x += len(p)
            if agreed is not None or last == self.blocks - 1:
                break
            last += 1
            around.append(self._block(last))
            tail += around[-1].pieces()
        done = cuts if agreed is None else cuts[:agreed]
        self.recounted += len(done)
        lengths, counts = around[0].lengths[:keep] + [len(p) for p in done], around[0].counts[:keep] + self.counter.counts(done)
        if agreed is not None:
            # what stands behind the place where cuts agree keeps its counts
            known = [c for b in around for c in b.counts][keep:]
            k = next(k for k, y in enumerate(accumulate((len(p) for p in tail), initial=at)) if y + shift >= x)
            lengths += [len(p) for p in tail[k:]]
            counts += known[k:]
        text = around[0].text[: at - before] + new
        parts = max(1, -(-len(lengths) // (2 * BLOCK)))
        made = self._grown(text, lengths, counts, -(-len(lengths) // parts) or 1)
        head, rest = _split(self.root, first)
        _, rest = _split(rest, last - first + 1)
        self.root = _join(_join(head, made), rest)

    def _starts(self, number: int, before: int, upto: int) -> list[int]:
        """Where the block's pre-tokens start, up to a character."""
        return [x for x in accumulate(self._block(number).lengths[:-1], initial=before) if x <= upto]


def count_tokens(
    docs: DataFrame,
    edits: str | None = None,
    *,
    tree: str | None = None,
    keep: bool = False,
    vocabulary_path: str = VOCABULARY,
    pattern: str = PATTERN,
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with n_tokens; with ``edits``, also n_pretokens, n_tokens_after and n_recounted (pre-tokens counted for the edits).

    edits: a column of arrays of structs (start, end, replacement), in characters. tree: a column of trees that
    an earlier call kept of these texts. keep: also text_after and tree_after, for the next edits.
    """
    docs.sparkSession.sparkContext.addFile(vocabulary_path)
    name = vocabulary_path.rsplit("/", 1)[-1]
    fields = ["n_tokens long", *(["n_pretokens long", "n_tokens_after long", "n_recounted long"] if edits else [])]
    made = T.StructType.fromDDL(", ".join([*fields, *(["text_after string", "tree_after binary"] if keep else [])]))
    others = [c for c in docs.columns if c not in made.names]
    schema = T.StructType([*(docs.schema[c] for c in others), *made])
    asked = F.to_json(edits) if edits else F.lit(None).cast("string")
    kept = F.col(tree) if tree else F.lit(None).cast("binary")

    def run(batches):
        counter = vocabulary(SparkFiles.get(name), pattern)
        for batch in batches:
            numbers, texts, trees = [], [], []
            for text, wanted, known in zip(*(batch.column(i) for i in range(3))):
                t = text.as_py() or ""
                if not edits and not keep:
                    numbers.append((sum(counter.counts(counter.pattern.findall(t))),))
                    continue
                counted = CountedText(t, counter, known.as_py())
                before, cut = counted.total, counted.recounted
                row = [before, sum(len(b.lengths) for b in counted.each())]
                for e in json.loads(wanted.as_py() or "[]"):
                    if e:
                        counted.edit(max(0, e.get("start") or 0), max(0, e.get("end") or 0), e.get("replacement") or "")
                numbers.append((*row, counted.total, counted.recounted - cut) if edits else (before,))
                if keep:
                    texts.append(counted.text() if edits else t)
                    trees.append(counted.tree())
            columns = np.array(numbers, np.int64).reshape(-1, len(fields))
            more = [pa.array(texts, pa.string()), pa.array(trees, pa.binary())] if keep else []
            yield pa.RecordBatch.from_arrays([*(batch.column(3 + i) for i in range(len(others))), *(pa.array(np.ascontiguousarray(columns[:, i])) for i in range(len(fields))), *more], names=schema.names)

    return docs.select(F.col(text_col).alias("_tp_text"), asked.alias("_tp_edits"), kept.alias("_tp_tree"), *others).mapInArrow(run, schema)

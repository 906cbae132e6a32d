"""Seed-and-extend substring dedup of words.

``substring_dedup`` removes every word covered by a run of ``length`` words
that also starts in a document with a smaller id. Documents are joined on
winnowed anchors of a few words (``repeats``). Where the text around a shared
anchor differs, the words on either side come together and each seed is
extended word by word: pieces are sorted by the words that follow the anchor
and by those that precede it, so neighbours tell how far any two agree on
either side. A run with x words before the anchor is repeated where two pieces
agree on x words to the left and on the others to the right. The union of such
runs, the maximal repeats of at least ``length`` words, is removed. Nothing is
paired: a thousand copies cost a thousand places in two orders.

Defined results: null and empty texts have no words; rows with a null id keep
all their words; ids are taken to be unique (rows that share an id are cut by
the same intervals); an empty table gives an empty one; input columns named
like results are replaced.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .hashing import U, Runs, Words
from .repeats import Repeats, mask, remove

#: Words of pieces that are extended at once, unless one anchor has more.
BLOCK = 400_000


def gram_of(length: int) -> int:
    """Words of an anchor."""
    return max(1, min(8, length // 2))


def symbols(flat: np.ndarray, w: Words) -> np.ndarray:
    """A number for each word, the same for equal bytes only: what hashes say is compared with the first such word."""
    _, first, number = np.unique(w.hashes, return_index=True, return_inverse=True)
    size, other = w.ends - w.starts, first[number]
    same = size == size[other]
    at = np.flatnonzero(same & (other != np.arange(len(size))))
    reps = size[at]
    step = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    differs = flat[np.repeat(w.starts[at], reps) + step] != flat[np.repeat(w.starts[other[at]], reps) + step]
    same[np.repeat(at, reps)[differs]] = False
    if not same.all():
        known: dict[bytes, int] = {}
        return np.array([known.setdefault(flat[a:b].tobytes(), len(known)) for a, b in zip(w.starts.tolist(), w.ends.tolist())])
    return number


def extend(columns: list[np.ndarray], text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of runs of ``length`` words that another piece of the same anchor has in an earlier document."""
    anchor, doc, lo, count = columns
    flat = np.frombuffer(text, np.uint8)
    w = Words(flat, np.array([0, len(flat)]))
    size = count.astype(np.int64) - 1 + length
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    order = np.argsort(anchor, kind="stable")
    a = anchor[order]
    cuts = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)]), len(a))
    # the anchor is the gram with the least hash of its piece, the leftmost of those
    gram = gram_of(length)
    least = Runs(w.hashes).all_of(gram) >> U(24)
    spots = size - gram + 1
    place = np.arange(spots.sum()) - np.repeat(np.cumsum(spots) - spots, spots)
    seen = least[np.repeat(begin, spots) + place]
    heads = np.cumsum(spots) - spots
    seed = np.minimum.reduceat(np.where(seen == np.repeat(np.minimum.reduceat(seen, heads), spots), place, 1 << 60), heads)
    word = symbols(flat, w)
    upto = np.concatenate([[0], np.cumsum(size[order])])[cuts]
    out, at = [], 0
    while at < len(cuts) - 1:
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + BLOCK, "right")) - 1)
        rows = order[cuts[at] : cuts[end]]
        out += _extended(word, anchor[rows], begin[rows], seed[rows], doc[rows], lo[rows].astype(np.int64), count[rows].astype(np.int64), length, gram)
        at = end
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _reach(word: np.ndarray, anchor: np.ndarray, start: np.ndarray, steps: np.ndarray, most: int, way: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of pieces by the words from ``start`` on, and how many each shares with the one before it (-1: another anchor)."""
    far = np.arange(most)
    sides = np.where(far < steps[:, None], word[np.clip(start[:, None] + way * far, 0, len(word) - 1)], -1)
    order = np.lexsort((*sides.T[::-1], anchor))
    differs = np.ones((len(anchor), most + 1), bool)
    differs[1:, :most] = sides[order[1:]] != sides[order[:-1]]
    shared = differs.argmax(axis=1)
    shared[np.append(True, anchor[order[1:]] != anchor[order[:-1]])] = -1
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, shared


def _extended(word, anchor, begin, seed, doc, lo, count, length, gram):
    most = length - gram
    right = _reach(word, anchor, begin + seed + gram, count - 1 + most - seed, most, 1)
    left = _reach(word, anchor, begin + seed - 1, seed, most, -1)
    for x in range(most + 1):
        # runs with x words before the anchor
        own = np.flatnonzero((seed - x >= 0) & (seed - x < count))
        if len(own) < 2:
            continue
        before, after = (np.cumsum(shared < depth)[rank[own]] for (rank, shared), depth in ((left, x), (right, most - x)))
        key = before * (len(anchor) + 1) + after
        by = np.lexsort((doc[own], key))
        own, key = own[by], key[by]
        opens = np.append(True, key[1:] != key[:-1])
        first = doc[own[np.maximum.accumulate(np.where(opens, np.arange(len(own)), 0))]]
        gone = own[doc[own] != first]
        start = lo[gone] + seed[gone] - x
        yield doc[gone], start, start + length


def _finish(flat, offsets, of, found):
    first = Words(flat, offsets, hashed=False).first
    lost = mask(int(first[-1]), first[of] + found["start"], np.minimum(first[of] + found["end"], first[of + 1]))
    before = np.concatenate([[0], np.cumsum(lost)])
    removed = before[first[1:]] - before[first[:-1]]
    text, keep, kept = flat.tobytes(), (~lost).view(np.uint8).tobytes(), []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        words = text[a:b].split()
        kept.append(b" ".join(compress(words, keep[first[i] : first[i + 1]]) if removed[i] else words))
    return [pa.array(np.diff(first).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary())]


def substring_dedup(docs: DataFrame, *, length: int = 50, together: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without ``text_col``, with n_words, n_removed and kept (the words that remain, joined by one space, as UTF-8).

    together: differing pieces of one anchor that one task extends (the runs of more are dealt out).
    """
    spec = Repeats(words=True, length=length, gram=gram_of(length), same_document=False, compare=extend, together=together)
    return remove(docs, spec, _finish, "n_words long, n_removed long, kept binary", id_col, text_col)

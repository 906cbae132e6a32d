"""Suffix-array dedup of bytes: linear suffix sorting by Lyndon-prefix groups.

``suffix_dedup`` removes every byte covered by a string of ``length`` bytes
that also starts earlier: in a document with a smaller id, or earlier in the
same one. Copies are brought together by anchors (``repeats``); where pieces
of text around an anchor differ, a suffix array over their tokens, built by
``gsaca``, tells which windows of them are equal.

Defined results: null and empty texts give 0 bytes and an empty rest; rows
with a null id keep all their text; a row given again (same id and text) is
cut as it would be alone, each time; other rows may not share an id (they are
cut by the same intervals); an empty table gives an empty one;
input columns named like results are replaced.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blobs import binary_column
from .gsaca import common_prefixes, suffix_array
from .hashing import IS_WORD, U, mix, span_hash
from .repeats import Repeats, distinct, mask, remove

#: Tokens that one suffix array holds, unless one anchor has more.
BLOCK = 60_000


def compare_pieces(columns: list[np.ndarray], text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of windows that also start earlier in another piece of the same anchor."""
    anchor, doc, lo, count = columns
    size = count.astype(np.int64) - 1 + length
    begin = np.concatenate([[0], np.cumsum(size)])
    flat = np.frombuffer(text, np.uint8)
    order = np.argsort(anchor, kind="stable")
    a = anchor[order]
    cuts = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a))
    out, at = [], 0
    while at < len(cuts) - 1:
        end, tokens = at + 1, 0
        while end < len(cuts) - 1 and (tokens := tokens + int(size[order[cuts[end - 1] : cuts[end]]].sum())) < 6 * BLOCK:
            end += 1
        rows = order[cuts[at] : cuts[end]]
        whole = np.concatenate([flat[begin[r] : begin[r + 1]] for r in rows.tolist()])
        out.append(_block(whole, size[rows], count[rows].astype(np.int64), doc[rows], lo[rows].astype(np.int64), length))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _block(flat, size, count, doc, lo, length):
    first = np.concatenate([[0], np.cumsum(size)])
    # tokens: a word and the spaces after it; where one begins shows in the two bytes around
    word = IS_WORD[flat]
    opens = np.append(True, word[1:] & ~word[:-1])
    opens[first[:-1]] = True
    start = np.flatnonzero(opens)
    bound = np.append(start, len(flat))
    token = np.cumsum(opens) - 1
    hashes = lambda a, b: span_hash(flat, a, b)
    _, symbol = np.unique(hashes(bound[:-1], bound[1:]), return_inverse=True)
    # a symbol less than any other parts the pieces
    piece_of = np.searchsorted(first, start, "right") - 1
    place = np.arange(len(start)) + piece_of
    text = np.zeros(len(start) + len(size), np.int64)
    text[place] = symbol + 1
    ends = np.searchsorted(start, first[1:])  # tokens up to the piece's end
    room = np.zeros(len(text), np.int64)
    room[place] = ends[piece_of] - np.arange(len(start))
    order = suffix_array(text)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # windows
    owner = np.repeat(np.arange(len(size)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = first[owner] + offset
    left, right = token[at], token[at + length - 1]
    inner = np.maximum(right - left - 1, 0)
    most = int(inner.max(initial=0))
    lcp = common_prefixes(text, order, room, most)
    same = np.zeros(len(at), np.int64)
    by = np.argsort(inner, kind="stable")
    steps = np.searchsorted(inner[by], np.arange(most + 2))
    for c in range(1, most + 1):
        w = by[steps[c] : steps[c + 1]]
        if len(w):
            same[w] = np.cumsum(lcp < c)[rank[place[left[w] + 1]]]
    tail = hashes(at, np.minimum(bound[left + 1], at + length))
    head = np.where(right > left, hashes(np.where(right > left, bound[right], at), at + length), U(0))
    key = mix(tail ^ mix(head ^ mix(same.astype(U) << U(32) | inner.astype(U)) ^ U(length)))
    # of equal windows the first stays
    begins = lo[owner] + offset
    del tail, head, same, inner, left, right
    gone, kept = _repeated(key, doc[owner], begins)
    span = np.arange(length)
    for i in range(0, len(gone), 10_000):  # what goes is compared with what stays, byte by byte
        one, other = (flat[at[rows[i : i + 10_000], None] + span] for rows in (gone, kept))
        if not np.array_equal(one, other):  # two strings with one key
            known: dict[bytes, int] = {}
            exact = np.array([known.setdefault(flat[a : a + length].tobytes(), len(known)) for a in at.tolist()], np.int64)
            gone, _ = _repeated(exact.astype(U), doc[owner], begins)
            break
    return doc[owner[gone]], begins[gone], begins[gone] + length


def _repeated(key: np.ndarray, doc: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows with equal keys all but the first, and that one for each."""
    order = np.lexsort((begins, doc, key))
    order = order[distinct(key[order], doc[order], begins[order])]  # a row given again is no copy of itself
    equal = np.append(False, key[order[1:]] == key[order[:-1]]) if len(order) else np.zeros(0, bool)
    first = order[np.maximum.accumulate(np.where(equal, 0, np.arange(len(order))))] if len(order) else order
    return order[equal], first[equal]


def _finish(flat, offsets, of, found, whole_characters=False):
    lost = mask(len(flat), offsets[of] + found["start"], np.minimum(offsets[of] + found["end"], offsets[of + 1]))
    before = np.concatenate([[0], np.cumsum(lost)])
    removed = before[offsets[1:]] - before[offsets[:-1]]
    opens = lost.copy()
    opens[1:] &= ~lost[:-1]
    inside = offsets[:-1][offsets[:-1] < len(flat)]
    opens[inside] = lost[inside]
    spans = np.concatenate([[0], np.cumsum(opens)])
    size = np.diff(offsets)
    if whole_characters and lost.any():
        opens = (flat & 0xC0) != 0x80
        opens[inside] = True
        character = np.cumsum(opens) - 1
        lost = (np.bincount(character, lost) > 0)[character]
        before = np.concatenate([[0], np.cumsum(lost)])
        size = size - (before[offsets[1:]] - before[offsets[:-1]])
    else:
        size = size - removed
    kept = flat[~lost]
    bounds = np.concatenate([[0], np.cumsum(size)])
    return [pa.array(np.diff(offsets).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array((spans[offsets[1:]] - spans[offsets[:-1]]).astype(np.int64)), binary_column(kept, bounds)]


def suffix_dedup(docs: DataFrame, *, length: int = 100, together: int = 4096, whole_characters: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without ``text_col``, with n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes that remain).

    together: differing pieces of one anchor that one suffix array takes at most (the windows of more are dealt out).
    whole_characters: kept also leaves out what a cut leaves of a character, so that it is text again.
    """
    spec = Repeats(words=False, length=length, gram=max(1, min(24, length // 2)), same_document=True, compare=compare_pieces, together=together)
    finish = partial(_finish, whole_characters=whole_characters)
    return remove(docs, spec, finish, "n_bytes long, n_removed long, n_spans long, kept binary", id_col, text_col)

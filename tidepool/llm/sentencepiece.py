"""SentencePiece encoding and decoding by batched Viterbi in numpy.

Texts are cut into units: a run of spaces (each a word mark) and what follows
up to the next space; no piece crosses a unit's start. Long units (text
without spaces) are cut again wherever no piece of the vocabulary can cross.
Distinct units advance together, very long ones with others of like length:
hashes of all their substrings of a length probe the sorted hashes of the
pieces, and at each place the maximum over the pieces that end there gives the
best score and a backpointer. A character without a piece of its own costs a
penalty and is written as byte pieces, so every text can be encoded.

The best sequence is the one of greatest total score (the unigram rule),
ties going to the earlier start of the last piece, whatever way the
vocabulary was made. The model file is read from a path that the caller gives;
nothing is trained. Decoding gives the text back exactly: a literal word mark
in a text is written as bytes, so it stays apart from a space.

Defined results: null texts encode to null and decode to null, empty ones to
no pieces; ids outside the vocabulary decode to nothing; rows are independent,
so ties, repeats and null ids need no rule; results replace input columns of
the same name.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import Prefixes, U, chunks, span_hash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PENALTY = 10.0  # a fixed value: what an unknown character costs below the least score
#: Units of more bytes are cut again, and advance with others up to a quarter longer; fewer of those than ``FEW`` go place by
#: place in a plain loop over the same recurrence. Distinct units that a task remembers; bytes of units that advance together.
LONG, FEW, REMEMBERED, CELLS = 96, 16, 300_000, 1 << 17


def _fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + n]
        at += n


class Pieces:
    """A vocabulary: sorted hashes of pieces with scores and ids, and the bytes of each id."""

    def __init__(self, data: bytes):
        self.text: list[bytes] = []
        scores, keys, ids = [], [], []
        self.bytes = np.zeros(256, np.int32)
        self.dummy, self.squeeze, self.unknown, charsmap = True, True, 0, b""
        least = 0.0
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = b"", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v
                    elif n == 2:
                        score = float(np.frombuffer(v, np.float32)[0])
                    elif n == 3:
                        kind = v
                i = len(self.text)
                if kind == BYTE:
                    byte = int(piece[3:5], 16)
                    self.bytes[byte] = i
                    self.text.append(bytes([byte]))
                elif kind in (NORMAL, USER):
                    least = min(least, score)
                    self.text.append(piece.replace(MARK, b" "))
                    keys.append(self.text[-1])
                    scores.append(score)
                    ids.append(i)
                else:
                    self.text.append(b"")
                    if kind == UNKNOWN:
                        self.unknown = i
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        charsmap = v
                    elif n == 3:
                        self.dummy = bool(v)
                    elif n == 4:
                        self.squeeze = bool(v)
        if charsmap or self.squeeze:
            raise ValueError("only models that leave texts as they are can give them back exactly")
        if not self.bytes.all():
            raise ValueError("the model has no byte pieces")
        self.penalty = least - PENALTY
        bound = np.cumsum([0, *map(len, keys)])
        flat = np.frombuffer(b"".join(keys), np.uint8)
        h = Prefixes(flat)(bound[:-1], bound[1:])
        order = np.argsort(h)
        self.hashes, self.scores, self.ids = h[order], np.array(scores)[order], np.array(ids, np.int32)[order]
        assert (np.diff(self.hashes) > 0).all()
        self.longest = max(map(len, keys))
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[self.hashes >> U(44)] = True
        self.by_key = dict(zip(keys, zip(scores, ids)))
        self.starts = np.cumsum([0, *map(len, self.text)])
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` that are pieces, and where those are."""
        at = np.flatnonzero(self.bitmap[h >> U(44)])
        where = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        hit = self.hashes[where] == h[at]
        return at[hit], where[hit]

    def uncrossed(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans cut where a character begins and no piece has bytes on both sides, and the span that each part is of."""
        size = end - start
        own = flat[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]
        stop = np.repeat(np.cumsum(size), size)
        hashes = Prefixes(own)
        depth = np.zeros(len(own) + 1, np.int32)
        for length in range(2, self.longest + 1):
            at = np.flatnonzero(np.arange(len(own)) + length <= stop)
            at = at[self.probe(hashes(at, at + length))[0]]
            depth[at + 1] += 1
            depth[at + length] -= 1
        cut = (np.cumsum(depth[:-1]) == 0) & ((own & 0xC0) != 0x80)
        cut[np.cumsum(size) - size] = True
        places = np.flatnonzero(cut)
        of = np.searchsorted(np.cumsum(size), places, "right")
        return places - (np.cumsum(size) - size)[of] + start[of], of

    def segment(self, own: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units end to end, of these sizes: ids unit by unit, and how many each has.

        Pieces are looked for by length, over all units at once; then units advance together from end to end of pieces.
        """
        m, all_ = len(size), np.arange(len(own))
        first = np.cumsum(size) - size
        unit, stop = np.repeat(np.arange(m), size), np.repeat(first + size, size)
        whole = np.where(own < 0x80, 1, np.where(own < 0xE0, 2, np.where(own < 0xF0, 3, 4)))
        whole[(own & 0xC0) == 0x80] = 0
        hashes, single, at = Prefixes(own), np.zeros(len(own), bool), np.flatnonzero(whole)
        starts, lengths, wheres = [], [], []
        for length in range(1, self.longest + 1):
            at = at[at + length <= stop[at]]
            hit, where = self.probe(hashes(at, at + length))
            found = at[hit]
            single[found[whole[found] == length]] = True
            starts.append(found)
            lengths.append(np.full(len(found), length))
            wheres.append(where)
        alone = np.flatnonzero((whole > 0) & ~single & (all_ + whole <= stop))  # characters of their own, in bytes
        where = np.concatenate(wheres)
        start, length = np.concatenate([*starts, alone]), np.concatenate([*lengths, whole[alone]])
        score = np.concatenate([self.scores[where], np.full(len(alone), self.penalty)])
        ids = np.concatenate([self.ids[where], np.full(len(alone), -1, np.int32)])
        end = start + length
        place = end - first[unit[start]]
        # by place, unit, pieces first, and the earlier start first
        by = np.argsort(((place * (len(own) + 1) + end) * 2 + (ids < 0)) * (self.longest + 5) - length)
        score, ids, place, shift = score[by], ids[by], place[by], unit[start[by]]
        begin, end = start[by] + shift, end[by] + shift  # a unit has a place more than bytes
        heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(end)), bool), end[1:] != end[:-1]]))
        ends = np.append(heads[1:], len(end))
        best, chosen = np.full(len(own) + m, -np.inf), np.zeros(len(own) + m, np.int64)
        best[first + np.arange(m)] = 0
        cuts = np.searchsorted(place[heads], np.arange(1, int(size.max()) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            low, high = heads[a], ends[b - 1]
            total = best[begin[low:high]] + score[low:high]
            top = np.maximum.reduceat(total, heads[a:b] - low)
            at = np.flatnonzero(total == np.repeat(top, ends[a:b] - heads[a:b]))
            at = at[np.searchsorted(at, heads[a:b] - low)]  # of equal ones the first
            best[end[heads[a:b]]], chosen[end[heads[a:b]]] = top, at + low
        out, of, order = [], [], []
        at, rows = first + size + np.arange(m), np.arange(m)
        opens = first + np.arange(m)
        while len(rows):
            c = chosen[at[rows]]
            i, p = begin[c], ids[c]
            known = p >= 0
            out.append(p[known])
            of.append(rows[known])
            order.append(i[known])
            if not known.all():
                r, a, reps = rows[~known], i[~known], (end - begin)[c[~known]]
                r, a = np.repeat(r, reps), np.repeat(a, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                out.append(self.bytes[own[a - r]])
                of.append(r)
                order.append(a)
            at[rows] = i
            rows = rows[i > opens[rows]]
        by = np.argsort(np.concatenate(order))
        return np.concatenate(out)[by].astype(np.int32), np.bincount(np.concatenate(of), minlength=m)

    def segment_one(self, text: bytes) -> list[int]:
        """The same recurrence for one long unit."""
        n = len(text)
        best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            b = text[i]
            if b & 0xC0 == 0x80:
                continue
            size, alone = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4, False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                if found := self.by_key.get(text[i:j]):
                    alone |= j == i + size
                    if (s := best[i] + found[0]) > best[j]:
                        best[j], back[j], piece[j] = s, i, found[1]
            if not alone and (j := i + size) <= n and (s := best[i] + self.penalty) > best[j]:
                best[j], back[j], piece[j] = s, i, -1
        out, j = [], n
        while j > 0:
            i = back[j]
            out += [piece[j]] if piece[j] >= 0 else [int(self.bytes[b]) for b in reversed(text[i:j])]
            j = i
        return out[::-1]


@lru_cache(2)
def load(path: str) -> Pieces:
    with open(path, "rb") as f:
        return Pieces(f.read())


class Encoder:
    """Encodes chunks; remembers the units it has seen, up to a bound."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.forget()

    def forget(self):
        self.hashes, self.rows = np.zeros(0, U), np.zeros(0, np.int64)
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _learn(self, flat, hashes, start, end):
        """Distinct units that aren't known."""
        # parts: units, or what long ones are cut into, in their order
        long = np.flatnonzero(end - start > LONG)
        places, of = self.pieces.uncrossed(flat, start[long], end[long])
        short = np.flatnonzero(end - start <= LONG)
        part, unit = np.concatenate([start[short], places]), np.concatenate([short, long[of]])
        order = np.lexsort((part, unit))
        part, unit = part[order], unit[order]
        last = np.append(unit[1:] != unit[:-1], True)
        size = np.where(last, end[unit], np.append(part[1:], 0)) - part
        ids, rows_of, counts = [], [], np.zeros(len(part), np.int64)
        order = np.argsort(size, kind="stable")
        by = size[order]
        until, a = np.cumsum(by), 0
        while a < len(by):
            longest = LONG if by[a] <= LONG else int(by[a] * 5 // 4)
            b = min(int(np.searchsorted(by, longest, "right")), max(a + 1, int(np.searchsorted(until, until[a] - by[a] + CELLS, "right"))))
            rows, length = order[a:b], int(by[b - 1])
            if length > LONG and len(rows) < FEW:
                got = [self.pieces.segment_one(flat[part[r] : part[r] + size[r]].tobytes()) for r in rows.tolist()]
                ids.append(np.array([i for g in got for i in g], np.int32))
                counts[rows] = [len(g) for g in got]
            else:
                # only the parts' own bytes, end to end
                own, _ = gather(flat, part[rows], part[rows] + size[rows])
                found, counts[rows] = self.pieces.segment(own, size[rows])
                ids.append(found)
            rows_of.append(rows)
            a = b
        rows_of = np.concatenate(rows_of)
        ends = np.empty(len(part), np.int64)
        ends[rows_of] = np.cumsum(counts[rows_of])
        made, _ = gather(np.concatenate(ids), ends - counts, ends)
        places = np.cumsum(counts)[last] + self.starts[-1]
        rows = np.arange(len(start)) + len(self.starts) - 1
        self.starts = np.concatenate([self.starts, places])
        self.ids = np.concatenate([self.ids, made])
        all_hashes, all_rows = np.concatenate([self.hashes, hashes]), np.concatenate([self.rows, rows])
        by = np.argsort(all_hashes, kind="stable")
        self.hashes, self.rows = all_hashes[by], all_rows[by]

    def encode(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all documents, and the offset at which each document's begin."""
        n = len(offsets) - 1
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        full = np.flatnonzero(np.diff(offsets) > 0)
        if self.pieces.dummy:
            flat = np.insert(flat, offsets[full], 32)
            offsets = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        space = flat == 32
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[offsets[full]] = True
        start = np.flatnonzero(opens)
        end = np.append(start[1:], len(flat))
        hashes = span_hash(flat, start, end)
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED:
            self.forget()
        new = np.ones(len(keys), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
            new = self.hashes[at] != keys
        if new.any():
            self._learn(flat, keys[new], start[first[new]], end[first[new]])
        rows = self.rows[np.searchsorted(self.hashes, keys)][back]
        ids, bounds = gather(self.ids, self.starts[rows], self.starts[rows + 1])
        return ids, bounds[np.searchsorted(start, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all documents, and the offset at which each one's begin."""
        p = self.pieces
        valid = (ids >= 0) & (ids < len(p.text))
        safe = np.where(valid, ids, 0)
        start = p.starts[safe]
        flat, bounds = gather(p.flat, start, np.where(valid, p.starts[safe + 1], start))
        at = bounds[offsets]
        if p.dummy and len(flat):
            drop = at[:-1][(at[1:] > at[:-1])]
            drop = drop[flat[drop] == 32]
            keep = np.ones(len(flat), bool)
            keep[drop] = False
            flat = flat[keep]
            at = np.concatenate([[0], np.cumsum(keep)])[at]
        return flat, at


def gather(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of ``values`` end to end, and their bounds."""
    size = end - start
    bounds = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], size)
    return values[at], bounds


def _shipped(df: DataFrame, path: str) -> str:
    """The model's name among the files that Spark sends to every executor."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, *, model: str = MODEL, text_col: str = "text", out_col: str = "pieces") -> DataFrame:
    """``docs`` with the ids of each whole text's pieces."""
    name = _shipped(docs, model)
    others = [c for c in docs.columns if c != out_col]
    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField(out_col, T.ArrayType(T.IntegerType()))])

    def run(batches):
        coder = Encoder(load(SparkFiles.get(name)))
        for batch in batches:
            for rows, flat, offsets in chunks(batch, 0):
                ids, bounds = coder.encode(flat, offsets)
                part = batch.slice(rows.start, rows.stop - rows.start)
                none = part.column(0).is_null()
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids), mask=none if none.true_count else None)
                yield pa.RecordBatch.from_arrays([*(part.column(1 + i) for i in range(len(others))), lists], names=schema.names)

    return docs.select(F.col(text_col).cast("binary").alias("_tp_text"), *others).mapInArrow(run, schema)


def decode(docs: DataFrame, *, model: str = MODEL, pieces_col: str = "pieces", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that the pieces stand for."""
    name = _shipped(docs, model)
    others = [c for c in docs.columns if c != out_col]
    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField(out_col, T.BinaryType())])

    def run(batches):
        coder = Encoder(load(SparkFiles.get(name)))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                lists = batch.column(0)
                none = lists.is_null()
                ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat, bounds = coder.decode(ids, np.concatenate([[0], np.cumsum(counts)]))
                text = pa.array([None if n else flat[a:b].tobytes() for n, a, b in zip(none.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(1 + i) for i in range(len(others))), text], names=schema.names)

    return docs.select(F.col(pieces_col).cast("array<int>").alias("_tp_pieces"), *others).mapInArrow(run, schema)

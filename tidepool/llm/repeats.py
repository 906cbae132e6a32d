"""Repeated runs of units (words or bytes) across a corpus, exactly and without pairs.

Both substring operators share this plan; they differ in the unit and in how
copies that are not wholly equal are compared.

1. *Seeds.* In every window of ``length`` units the k-gram with the least hash
   is its anchor, so equal windows have equal anchors. Successive windows with
   one anchor form a *piece*: an anchor and all that its windows reach.
2. *Whole pieces.* Pieces are dealt out by anchor. Of equal pieces the first
   one stays and the windows of the others are repeats. A place (document and
   start) counts once, however often its row is given. A task keeps only the
   first of its own equal pieces for the exchange, so a passage in a third of
   all documents costs one row a task.
3. *Differing pieces.* Where an anchor has several different pieces (edges of
   passages, edits), the first copy of each is fetched from its document and
   windows are compared by content, with ``compare``. An anchor of more pieces
   than fit one task is split by what its windows extend to: each window is
   dealt out by two hashes of its own, so no anchor is ever left out or cut.
4. Repeats return to their documents as intervals and their union is removed.

Every exchange moves anchors, intervals or text once, whatever the sizes of
groups are; nothing is collected and no pairs are made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blobs
from .hashing import ByteRuns, Runs, U, Words, again, chunks, mix, sliding_argmin

SEED, REMOVED, WANTED, PIECE, WINDOW = range(5)
_SEED = [np.uint32, U, np.int64, np.int32, np.int32]  # anchor, piece, document, first window, windows
_REMOVED = [np.int64, np.int32, np.int32]  # document, start, end
_WANTED = [np.int64, np.int32, np.int32, np.uint32, np.int32, np.int8]  # document, first window, windows, anchor, shard, by windows
_PIECE = [np.uint32, np.int64, np.int32, np.int32]  # anchor, document, first window, windows
_WINDOW = [U, U, np.int64, np.int32]  # two hashes of a window, document, start
#: Records that a task holds before it combines and sends them.
HELD = 400_000


@dataclass(frozen=True)
class Repeats:
    """What is repeated: runs of ``length`` words or bytes, found by k-grams of ``gram``.

    same_document: whether an earlier start in the same document counts.
    compare: tells which windows of differing pieces are repeats, from the pieces' columns and content.
    together: differing pieces of an anchor that one task compares; beyond, their windows are dealt out.
    """

    words: bool
    length: int
    gram: int
    same_document: bool
    compare: Callable
    together: int = 4096

    def units(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[Runs, np.ndarray]:
        if self.words:
            w = Words(flat, offsets)
            return Runs(w.hashes), w.first
        return ByteRuns(flat), offsets

    def spans(self, flat: np.ndarray, offsets: np.ndarray, of: np.ndarray, lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``flat`` pieces begin and end."""
        if not self.words:
            return offsets[of] + lo, offsets[of] + lo + count - 1 + self.length
        w = Words(flat, offsets, hashed=False)
        at = w.first[of] + lo
        return w.starts[at], w.ends[at + count - 2 + self.length]

    def anchors(self, hashes: Runs, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """k-gram hashes, the anchor of each window, each window's document, and whether it lies in one."""
        grams = hashes.all_of(self.gram)
        anchor = sliding_argmin(grams, self.length - self.gram + 1)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(anchor)]
        return grams, anchor, doc, np.arange(len(anchor)) + self.length <= first[1:][doc]

    def seeds(self, flat: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        hashes, first = self.units(flat, offsets)
        grams, anchor, doc, inside = self.anchors(hashes, first)
        if not len(anchor):
            return [np.zeros(0, d) for d in (U, U, np.int64, np.int32, np.int32)]
        opens = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1]))
        lo = np.flatnonzero(opens)
        hi = np.append(lo[1:], len(anchor)) - 1
        keep = inside[lo]
        lo, hi = lo[keep], hi[keep]
        a = anchor[lo]
        piece = mix(hashes(lo, hi + self.length) ^ mix((a - lo).astype(U) << U(32) | (hi - lo).astype(U)))
        # mixed again: least hashes have few high bits, and those deal the anchors out
        return [mix(grams[a] ^ U(0xA2C3)), piece, ids[doc[lo]], (lo - first[doc[lo]]).astype(np.int32), (hi - lo + 1).astype(np.int32)]

    def settle(self, anchor, piece, doc, lo, n) -> tuple[np.ndarray, np.ndarray]:
        """An order by piece, and who in it stays: the first copy, and the first document's others if those aren't repeats.

        A place that comes again, from a row that is given again, is no copy of itself: the order has it once.
        """
        order = np.lexsort((lo, doc, anchor, piece))
        order = order[distinct(piece[order], anchor[order], doc[order], lo[order])]
        p, a, d = piece[order], anchor[order], doc[order]
        first = np.append(True, (p[1:] != p[:-1]) | (a[1:] != a[:-1])) if len(order) else np.zeros(0, bool)
        if self.same_document:
            return order, first
        return order, d == d[np.maximum.accumulate(np.where(first, np.arange(len(d)), 0))]


def distinct(*columns: np.ndarray) -> np.ndarray:
    """Marks the first of equal rows, which stand together."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _removed(doc: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> Iterator[blobs.Blob]:
    """Intervals, joined where they touch, for the shards of their documents."""
    if not len(doc):
        return
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    opens = np.append(True, doc[1:] != doc[:-1])
    rank = np.cumsum(opens) * np.int64(1 << 33)
    reach = np.maximum.accumulate(end + rank) - rank  # by document
    opens[1:] |= start[1:] > reach[:-1]
    lo = np.flatnonzero(opens)
    hi = np.append(lo[1:], len(doc)) - 1
    yield from blobs.deal([doc[lo], start[lo].astype(np.int32), reach[hi].astype(np.int32)], blobs.shard_of(mix(doc[lo]), n), REMOVED)


def _windows(parts: list[list[np.ndarray]], spec: Repeats, n: int, last: bool) -> Iterator[blobs.Blob]:
    """The first copies of windows for their shards; intervals of the others."""
    key, second, doc, start = blobs.join(parts, _WINDOW)
    order, stays = spec.settle(second, key, doc, start, start)
    gone = order[~stays]
    yield from _removed(doc[gone], start[gone], start[gone] + spec.length, n)
    if not last:
        at = order[stays]
        yield from blobs.deal([key[at], second[at], doc[at], start[at]], blobs.shard_of(key[at], n), WINDOW)


def _seed_map(spec: Repeats, n: int):
    def flush(parts):
        anchor, piece, doc, lo, count = blobs.join(parts, [U, U, np.int64, np.int32, np.int32])
        order, stays = spec.settle(anchor, piece, doc, lo, count)
        at = order[stays]
        yield from blobs.deal([anchor[at].astype(np.uint32), piece[at], doc[at], lo[at], count[at]], blobs.shard_of(anchor[at], n), SEED)
        at = order[~stays]
        yield from _removed(doc[at], lo[at], lo[at] + count[at] - 1 + spec.length, n)

    def rows(batches):
        parts, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, flat, offsets in chunks(batch, 1):
                parts.append(spec.seeds(flat, offsets, ids[rows]))
                held += len(parts[-1][0])
                if held >= HELD:
                    yield from flush(parts)
                    parts, held = [], 0
        if held:
            yield from flush(parts)

    return lambda batches: blobs.batches_of(rows(batches))


def _seed_join(spec: Repeats, n: int):
    def rows(batches):
        parts: dict[int, list] = {}
        for shard, kind, data, _ in blobs.blobs_in(batches):
            if kind == REMOVED:
                yield shard, kind, data, None
            else:
                parts.setdefault(shard, []).append(blobs.unpack(data, _SEED))
        for shard, found in parts.items():
            anchor, piece, doc, lo, count = blobs.join(found, _SEED)
            order, stays = spec.settle(anchor, piece, doc, lo, count)
            gone, at = order[~stays], order[stays]
            yield from _removed(doc[gone], lo[gone], lo[gone] + count[gone] - 1 + spec.length, n)
            p, a = piece[at], anchor[at]
            first = np.append(True, (p[1:] != p[:-1]) | (a[1:] != a[:-1])) if len(at) else np.zeros(0, bool)
            _, back, pieces = np.unique(a, return_inverse=True, return_counts=True)
            pieces = np.bincount(back[first], minlength=len(pieces))[back] if len(at) else pieces
            at, pieces = at[pieces > 1], pieces[pieces > 1]
            yield from blobs.deal([doc[at], lo[at], count[at], anchor[at], np.full(len(at), shard, np.int32), (pieces > spec.together).astype(np.int8)], blobs.shard_of(mix(doc[at]), n), WANTED)

    return lambda batches: blobs.batches_of(rows(batches))


def _fetch(spec: Repeats, n: int):
    """Contents of the wanted pieces: bytes for the anchor's shard, or windows for their own."""
    dtype = blobs.record_type(_WANTED)

    glue = b" " if spec.words else b""

    def rows(batches):
        windows, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found = batch.column(2)
            for rows, flat, offsets in chunks(batch, 1):
                want = [np.frombuffer(found[i].as_py(), dtype) for i in range(rows.start, rows.stop)]
                of = np.repeat(np.arange(len(want)), [len(x) for x in want])
                want = np.concatenate(want)
                lo, count = want["f0"].astype(np.int64), want["f1"].astype(np.int64)
                each = want["f4"] > 0
                if each.any():
                    hashes, first = spec.units(flat, offsets)
                    reps = count[each]
                    start = np.repeat(lo[each] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
                    doc = np.repeat(of[each], reps)
                    at = start + first[doc]
                    key, second = hashes(at, at + spec.length), Runs(again(hashes.base), hashes.level)(at, at + spec.length)
                    windows.append([key, second, ids[rows][doc], start.astype(np.int32)])
                    held += len(key)
                    if held >= HELD:
                        yield from _windows(windows, spec, n, False)
                        windows, held = [], 0
                if not each.all():
                    w, o = want[~each], of[~each]
                    begin, end = spec.spans(flat, offsets, o, w["f0"].astype(np.int64), w["f1"].astype(np.int64))
                    order = np.argsort(w["f3"], kind="stable")
                    s = w["f3"][order]
                    cuts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
                    for x, y in zip(cuts, np.append(cuts[1:], len(s))):
                        at = order[x:y]
                        data = blobs.pack([w["f2"][at], ids[rows][o[at]], w["f0"][at], w["f1"][at]])
                        yield int(s[x]), PIECE, data, glue.join(flat[a:b].tobytes() for a, b in zip(begin[at].tolist(), end[at].tolist())) + glue
        if held:
            yield from _windows(windows, spec, n, False)

    return lambda batches: blobs.batches_of(rows(batches))


def _compare(spec: Repeats, n: int):
    def rows(batches):
        windows, pieces = [], {}
        for shard, kind, data, extra in blobs.blobs_in(batches):
            if kind == REMOVED:
                yield shard, kind, data, None
            elif kind == WINDOW:
                windows.append(blobs.unpack(data, _WINDOW))
            else:
                pieces.setdefault(shard, []).append((blobs.unpack(data, _PIECE), extra))
        if windows:
            yield from _windows(windows, spec, n, True)
        for found in pieces.values():
            yield from _removed(*spec.compare(blobs.join([x for x, _ in found], _PIECE), b"".join(x for _, x in found), spec.length), n)

    return lambda batches: blobs.batches_of(rows(batches))


def remove(docs: DataFrame, spec: Repeats, finish: Callable, result: str, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the columns of ``result``, which ``finish(flat, offsets, found)`` gives for each chunk.

    Input columns of the same names as results are replaced. Rows without an
    id take no part and keep all their text.
    """
    spark = docs.sparkSession
    n = blobs.shards(spark)
    made = T.StructType.fromDDL(result)
    others = [c for c in docs.columns if c not in {id_col, text_col, *made.names}]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    seeds = texts.where("id is not null").mapInArrow(_seed_map(spec, n), blobs.ROWS)
    settled = blobs.cut(blobs.exchange(seeds, n).mapInArrow(_seed_join(spec, n), blobs.ROWS))
    wanted = blobs.exchange(settled.where(F.col("kind") == WANTED), n).mapInArrow(blobs.by_document(WANTED, _WANTED), "id long, found binary")
    fetched = texts.join(wanted, "id").mapInArrow(_fetch(spec, n), blobs.ROWS)
    compared = blobs.exchange(fetched, n).mapInArrow(_compare(spec, n), blobs.ROWS)
    gone = blobs.exchange(settled.where(F.col("kind") == REMOVED).unionAll(compared), n).mapInArrow(blobs.by_document(REMOVED, _REMOVED), "id long, found binary")
    whole = docs.select(F.col(id_col).cast("long").alias("_tp_id"), F.col(text_col).cast("binary").alias("_tp_text"), *others)
    joined = whole.join(gone.select(F.col("id").alias("_tp_at"), F.col("found").alias("_tp_found")), F.col("_tp_id") == F.col("_tp_at"), "left").drop("_tp_at")
    joined = joined.select("_tp_id", "_tp_text", "_tp_found", *others)
    schema = T.StructType([T.StructField(id_col, T.LongType()), *(docs.schema[c] for c in others), *made])

    def last(batches):
        dtype = np.dtype([("start", np.int32), ("end", np.int32)])
        for batch in batches:
            found = batch.column(2)
            for rows, flat, offsets in chunks(batch, 1):
                got = [np.frombuffer(x, dtype) if (x := found[i].as_py()) else np.zeros(0, dtype) for i in range(rows.start, rows.stop)]
                out = finish(flat, offsets, np.repeat(np.arange(len(got)), [len(x) for x in got]), np.concatenate(got))
                part = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([part.column(0), *(part.column(3 + i) for i in range(len(others))), *out], names=schema.names)

    return joined.mapInArrow(last, schema)


def mask(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Units that an interval covers."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, np.minimum(start, n), 1)
    np.add.at(depth, np.minimum(end, n), -1)
    return np.cumsum(depth[:-1]) > 0

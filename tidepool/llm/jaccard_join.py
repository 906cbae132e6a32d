"""N-gram Jaccard join by a token-group matrix, exact at any group size.

Documents are sets of shingles (hashed runs of words); two link when their
Jaccard similarity reaches a threshold. The result is the components of links.

1. Equal sets are one *class*. Three quarters of all shingles, chosen by hash and
   so the same ones in every document, are dealt out by shingle with the classes
   that hold them. A link needs a number of shared shingles among those (the
   class's *need*); classes that don't share as many with all others together
   drop out.
2. What remains is parted into *groups* of similar classes: those with an equal
   least hash are compared with one leader, and links found join a group.
   Copies by the thousand become one group at a cost linear in their number. An
   equal hash is dealt out over ``SALTS`` shards, with a leader each, and those
   meet once more.
3. The *token-group matrix*: which shingles the unions of several groups hold is
   aggregated before anything meets, so what only one group has, however large
   it is, comes together nowhere. A class brings only its rarest shingles, as many as leave
   less than its need aside, so any link between groups shows in one of those,
   and passages that many documents share stay aside. Groups that don't meet in
   any such shingle are never opened.
4. Groups that do, and what these meet in turn, are a *cluster*. The sets of a
   cluster come together once, not once for each two of them; a large cluster is
   dealt out in blocks, and each two blocks come together. Where clusters are so
   large and so thin that this would send more sets, the classes that share a
   shingle come together instead, once for all shingles that the same classes
   share. A class whose overlap with the union of the other groups' sets is
   below its bound opens none; the others are joined by their rarest shingles
   among those present.

A shingle that many of a task's classes hold is shared for certain. Those classes
learn so directly, and the shingle's shard gets one row, which makes it the most
common of all everywhere: no shard sees all holders of a passage that a third of
all documents have.

Very small sets, of which the choice says little, bring all their shingles as
well, to meet each other. No step makes pairs within a group, and each is exact: a
missed link in step 2 is found in steps 3 and 4.

Defined results: words are lower-cased A-Z; with fewer words than a shingle
has, all of them are one shingle; without words, or with a null text, a
document has no shingles and is linked with nothing; rows with a null id have
a null component and a null count; rows that share an id count as one document,
with the set of its least class if their texts differ; an empty table gives an
empty result. Only the id and text columns are read.

Sets are told apart by two 64-bit hashes, and every link is found by comparing
the sets of two classes, shingle by shingle (64 bits each).
``jaccard_components`` gives classes and components, and doesn't look for links
within a component that it knows already. ``jaccard_links`` gives every link
between classes, and each document's number of links: its cost grows with the
number of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .components import components
from .hashing import FOLD, U, Words, chunks, grams, mix

CLASS, VIEW, SHARED, MEMBER, PREFIX, KEY, FETCH, SET, TOKEN, LOCAL, COMMON = range(11)
_CLASS = [U, U, np.int64]  # two digests, document
_VIEW = [U, U, np.int8, np.int32, np.int32, np.int32, np.int32]  # two digests, universe, shingles, brought in all, need, here; extra: tokens
_SHARED = _VIEW  # the same, here: shared; extra: tokens, then in how many classes
_LOCAL = [np.int64, np.int64, np.int64]  # document, first one of its class that its task has seen, shingles
_MEMBER = [np.int64, np.int64]  # such a first one, and the first document of its class
_KEY = [U, np.int64]  # least hash, document
_FETCH = [np.int64, U, np.int8, np.int64]  # document, where its set is wanted, as what, group
_SET = [U, np.int64, np.int8, np.int64, np.int32]  # where, document, as what, group, shingles; extra: shingles
_TOKEN = [U, np.int64, np.int64, np.int32]  # token, document, group, shingles
FOLLOWER, LEADER, MEETING, UPPER, LOWER = range(5)  # UPPER: meets only sets of the size band below, or of another block; LOWER: of that other block
#: Hash functions of step 2, classes that one task compares with a leader, and shingles a task holds before it sends them.
FUNCTIONS, PER_LEADER, HELD = 3, 1024, 2_000_000
#: Parts of those with an equal least hash.
SALTS = 64
#: Classes of a task that hold a token from which it is common; how often common tokens count.
LOCALLY, MOST = 20, 65535
#: Possible partners in other groups, on average over a token's holders, beyond which they all meet at once; beyond
#: so many holders, those of like sizes do.
PARTNERS, BANDED = 200, 500
#: Classes of a block of a cluster, and their shingles.
WHOLE = (1024, 1_000_000)


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, and the bounds of each document's."""
    w = Words(FOLD[flat], offsets)
    n, counts = len(offsets) - 1, w.counts()
    doc = w.docs()
    g = grams(w.hashes, width)
    inside = np.flatnonzero(np.arange(len(g)) + width <= w.first[1:][doc[: len(g)]]) if len(g) else np.zeros(0, np.int64)
    h, d = g[inside], doc[inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.zeros(len(short), U)
        for k in range(1, width):
            at = short[counts[short] == k]
            if len(at):
                whole[counts[short] == k] = mix(grams(w.hashes, k)[w.first[at]] ^ U(k))
        h, d = np.concatenate([h, whole]), np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], np.searchsorted(d[new], np.arange(n + 1))


def _numbers(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A number for each pair of values, the same for equal pairs."""
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _ragged(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]


def _deal_views(kind: int, head: list[np.ndarray], of: np.ndarray, shard: np.ndarray, *columns: np.ndarray) -> Iterator[blobs.Blob]:
    """Tokens (and what goes with them) with what is known of the view that each is of, to shards."""
    order = np.lexsort((of, shard))
    shard, of, columns = shard[order], of[order], [c[order] for c in columns]
    cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard)) if len(shard) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        views, here = np.unique(of[a:b], return_counts=True)
        yield int(shard[a]), kind, blobs.pack([*(c[views] for c in head), here.astype(np.int32)]), b"".join(c[a:b].tobytes() for c in columns)


def _numbered(low: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """A token's name: what its shard keeps of it, and the shard."""
    return low.astype(U) | shard.astype(U) << U(32)


def _first_map(width: int, share: tuple[int, int], n: int):
    num, den = share

    def flush(held):
        digest, second, doc, sizes, sets = (np.concatenate(x) for x in zip(*held))
        start = np.cumsum(sizes) - sizes
        number = _numbers(digest, second)
        # copies stay here: the task's first one stands for them
        order = np.lexsort((doc, number))
        first = order[np.append(True, number[order[1:]] != number[order[:-1]])]
        near = doc[first][number]
        near[sizes == 0] = doc[sizes == 0]
        yield from blobs.deal([doc, near, sizes], blobs.shard_of(mix(doc), n), LOCAL)
        first = first[sizes[first] > 0]
        if not len(first):
            return
        digest, second, sizes, start = digest[first], second[first], sizes[first], start[first]
        yield from blobs.deal([digest, second, doc[first]], blobs.shard_of(digest, n), CLASS)
        tokens, of = mix(_ragged(sets, start, sizes)), np.repeat(np.arange(len(first)), sizes)
        chosen = tokens >> U(62) < 3
        brought = np.bincount(of[chosen], minlength=len(first))
        least = -(-num * sizes // den)
        need = least - (sizes - brought)
        small = (need < 1) | (sizes <= 12)
        # those chosen, and for small sets all, as tokens of another kind
        again = small[of]
        head = [np.concatenate([c, c[small]]) for c in (digest, second, sizes)]
        kind = np.concatenate([np.zeros(len(first), np.int8), np.ones(small.sum(), np.int8)])
        total = np.concatenate([brought, sizes[small]])
        needs = np.concatenate([np.maximum(np.where(small, 1, need), 1), least[small]])
        place = np.cumsum(small) - 1 + len(first)
        of = np.concatenate([of[chosen], place[of[again]]])
        # the upper bits are used up by the choice
        every = np.concatenate([mix(tokens[chosen] ^ U(1)), mix(tokens[again] ^ U(2))])
        head = [head[0], head[1], kind, head[2].astype(np.int32), total.astype(np.int32), needs.astype(np.int32)]
        shard, low = blobs.shard_of(every, n), every.astype(np.uint32)
        del every, tokens
        # common ones: first those whose lowest bits are, then exactly
        bits = low & np.uint32((1 << 21) - 1)
        likely = np.flatnonzero(np.bincount(bits)[bits] >= LOCALLY) if len(bits) else np.zeros(0, np.int64)
        names = _numbered(low[likely], shard[likely])
        different, back, held_by = np.unique(names, return_inverse=True, return_counts=True)
        common = held_by >= LOCALLY
        yield from blobs.deal([different[common].astype(np.uint32)], (different[common] >> U(32)).astype(np.int32), COMMON)
        names, likely = names[common[back]], likely[common[back]]
        many = np.zeros(len(low), bool)
        many[likely] = True
        yield from _deal_views(SHARED, head, of[likely], blobs.shard_of(head[0], n)[of[likely]], names, np.full(len(likely), MOST, np.uint16))
        yield from _deal_views(VIEW, head, of[~many], shard[~many], low[~many])

    def rows(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, flat, offsets in chunks(batch, 1):
                sets, bounds = shingle_sets(flat, offsets, width)
                sizes = np.diff(bounds)
                digests = []
                for salt in (0xA5A5, 0x5A5A5A):
                    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(sets ^ U(salt)), dtype=U)])
                    digests.append(mix(sums[bounds[1:]] - sums[bounds[:-1]] ^ mix(sizes)))
                held.append((*digests, ids[rows], sizes.astype(np.int64), sets))
                size += len(sets) + len(sizes)
                if size >= HELD:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return lambda batches: blobs.batches_of(rows(batches))


def _shared(n: int):
    """Of tokens that several classes hold, back to the classes: which, and in how many."""

    def rows(batches):
        views: dict[int, list] = {}
        common: dict[int, list] = {}
        for shard, kind, data, extra in blobs.blobs_in(batches):
            if kind == COMMON:
                common.setdefault(shard, []).append(np.unique(blobs.unpack(data, [np.uint32])[0]))
            elif kind != VIEW:
                yield shard, kind, data, extra
            else:
                views.setdefault(shard, []).append((blobs.unpack(data, _VIEW), extra))
        for shard, found in views.items():
            head = blobs.join([x for x, _ in found], _VIEW)
            token = np.concatenate([np.frombuffer(x, np.uint32) for _, x in found])
            view = np.repeat(np.arange(len(head[0])), head[6])
            of = _numbers(head[0], head[1])
            order = np.lexsort((of[view], token))
            token, view = token[order], view[order]
            of = of[view]
            new = np.append(True, (token[1:] != token[:-1]) | (of[1:] != of[:-1]))
            token, view = token[new], view[new]
            opens = np.append(True, token[1:] != token[:-1])
            group = np.cumsum(opens) - 1
            count = np.minimum(np.bincount(group)[group], MOST)
            if shard in common:
                count[np.isin(token, np.concatenate(common[shard]))] = MOST
            keep = count > 1
            token, view, count = token[keep], view[keep], count[keep].astype(np.uint16)
            yield from _deal_views(SHARED, head[:6], view, blobs.shard_of(head[0], n)[view], _numbered(token, np.full(len(token), shard)), count)

    return lambda batches: blobs.batches_of(rows(batches))


def _classes(n: int):
    """By class: members; and for those that share enough, their rarest shared tokens and keys for leaders."""

    def rows(batches):
        members, shared = [], []
        for shard, kind, data, extra in blobs.blobs_in(batches):
            if kind == LOCAL:
                yield shard, kind, data, None
            elif kind == CLASS:
                members.append(blobs.unpack(data, _CLASS))
            else:
                shared.append((blobs.unpack(data, _SHARED), extra))
        digest, second, doc = blobs.join(members, _CLASS)
        del members
        if not len(digest):
            return
        order = np.lexsort((doc, second, digest))
        digest, second, doc = digest[order], second[order], doc[order]
        opens = np.append(True, (digest[1:] != digest[:-1]) | (second[1:] != second[:-1]))
        first = doc[np.maximum.accumulate(np.where(opens, np.arange(len(doc)), 0))]
        yield from blobs.deal([doc, first], blobs.shard_of(mix(doc), n), MEMBER)
        digest, second, rep = digest[opens], second[opens], doc[opens]
        if not shared:
            return
        head = blobs.join([x for x, _ in shared], _SHARED)
        # every view is of a class that is here; classes have the same order as their numbers
        of = _numbers(np.concatenate([digest, head[0]]), np.concatenate([second, head[1]]))[len(digest) :]
        head = head[1:]
        tokens = np.concatenate([np.frombuffer(x, U, len(x) // 10) for _, x in shared])
        counts = np.concatenate([np.frombuffer(x, np.uint16, len(x) // 10, len(x) // 10 * 8) for _, x in shared])
        del shared
        owner = np.repeat(2 * of + head[1], head[5])  # class and universe
        at = np.repeat(np.arange(len(of)), head[5])
        order = np.lexsort((tokens, counts, owner))
        owner, tokens, at = owner[order], tokens[order], at[order]
        cuts = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(owner))
        begin, have = cuts[:-1], np.diff(cuts)
        own = at[begin]
        enough = have >= head[4][own]
        begin, have, own = begin[enough], have[enough], own[enough]
        if not len(own):
            return
        # all but need - 1 of a class's tokens, rarest first; those that no one shares come before
        keep = have - head[4][own] + 1
        place = rep[of[own]]
        yield 0, PREFIX, blobs.pack([place, head[2][own], keep.astype(np.int32)]), _ragged(tokens, begin, keep).tobytes()
        every = _ragged(tokens, begin, have)
        starts = np.cumsum(have) - have
        for k in range(FUNCTIONS):
            least = np.minimum.reduceat(mix(every ^ U(1000 + k)), starts)
            key = mix(least ^ U(k))
            yield from blobs.deal([key, place], blobs.shard_of(mix(key ^ _salt(place)), n), KEY)

    return lambda batches: blobs.batches_of(rows(batches))


def _salt(doc: np.ndarray) -> np.ndarray:
    return mix(doc ^ np.int64(0x5A17)) % U(SALTS)


def _leaders(n: int, salted: bool):
    """Of classes with an equal key: whose sets to compare with the first one's. Salted: within each part, and parts' first ones go on."""

    def rows(batches):
        found = []
        for shard, kind, data, _ in blobs.blobs_in(batches):
            if kind == KEY:
                found.append(blobs.unpack(data, _KEY))
            else:
                yield shard, kind, data, None
        key, doc = blobs.join(found, _KEY)
        part = _salt(doc) if salted else np.zeros(len(doc), U)
        order = np.lexsort((doc, part, key))
        key, doc, part = key[order], doc[order], part[order]
        new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])) if len(key) else np.zeros(0, bool)
        key, doc, part = key[new], doc[new], part[new]
        cuts = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]))), len(key)) if len(key) else np.zeros(1, np.int64)
        if salted:
            yield from blobs.deal([key[cuts[:-1]], doc[cuts[:-1]]], blobs.shard_of(key[cuts[:-1]], n), KEY)
        size = np.diff(cuts)
        parts = -(-size // PER_LEADER)
        lead = np.repeat(doc[cuts[:-1]], size)
        part = (np.arange(len(key)) - np.repeat(cuts[:-1], size)) // PER_LEADER
        where = mix(mix(lead) + part.astype(U))
        keep = np.repeat(size > 1, size) & (doc != lead)
        reps = np.where(size > 1, parts, 0)
        leader = np.repeat(doc[cuts[:-1]], reps)
        nth = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        out = [
            np.concatenate([doc[keep], leader]),
            np.concatenate([where[keep], mix(mix(leader) + nth.astype(U))]),
            np.concatenate([np.full(keep.sum(), FOLLOWER, np.int8), np.full(len(leader), LEADER, np.int8)]),
        ]
        out.append(np.zeros(len(out[0]), np.int64))
        yield from blobs.deal(out, blobs.shard_of(mix(out[0]), n), FETCH)

    return lambda batches: blobs.batches_of(rows(batches))


def _send_sets(width: int, n: int):
    dtype = blobs.record_type(_FETCH)

    def rows(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found = batch.column(2)
            for rows, flat, offsets in chunks(batch, 1):
                sets, bounds = shingle_sets(flat, offsets, width)
                want = [np.unique(np.frombuffer(found[i].as_py(), dtype)) for i in range(rows.start, rows.stop)]
                of = np.repeat(np.arange(len(want)), [len(x) for x in want])
                want = np.concatenate(want)
                shard = blobs.shard_of(want["f0"], n)
                order = np.argsort(shard, kind="stable")
                cuts = np.append(np.flatnonzero(np.append(True, shard[order][1:] != shard[order][:-1])), len(order))
                size = np.diff(bounds)
                for a, b in zip(cuts[:-1], cuts[1:]):
                    at = order[a:b]
                    d = of[at]
                    yield int(shard[at[0]]), SET, blobs.pack([want["f0"][at], ids[rows][d], want["f1"][at], want["f2"][at], size[d].astype(np.int32)]), _ragged(sets, bounds[:-1][d], size[d]).tobytes()

    return lambda batches: blobs.batches_of(rows(batches))


def _overlap(one: np.ndarray, many: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Elements that the sorted set ``one`` shares with each slice of ``many``."""
    at = np.minimum(np.searchsorted(one, many), len(one) - 1)
    return np.diff(np.concatenate([[0], np.cumsum(one[at] == many)])[bounds])


def _star(leader: np.ndarray, sets: np.ndarray, start: np.ndarray, size: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Which of the sets link with the leader's."""
    num, den = share
    if len(start) == 1:
        many = sets[start[0] : start[0] + size[0]]
        both = np.count_nonzero(leader[np.minimum(np.searchsorted(leader, many), len(leader) - 1)] == many)
        return np.array([den * both >= num * (len(leader) + len(many) - both)])
    many, bounds = _ragged(sets, start, size), np.concatenate([[0], np.cumsum(size)])
    both = _overlap(leader, many, bounds)
    return den * both >= num * (len(leader) + size - both)


def _meeting(doc: np.ndarray, group: np.ndarray, size: np.ndarray, role: np.ndarray, sets: np.ndarray, share: tuple[int, int], every: bool) -> list[tuple[int, int]]:
    """Links between sets of different groups: a small join of its own, by the rarest elements of each set here.

    Unless ``every`` link is asked for, those found join groups.
    """
    num, den = share
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(doc)), size)
    _, back, df = np.unique(sets, return_inverse=True, return_counts=True)
    order = np.lexsort((back, df[back], of))
    # of each set in that order, as many as a link can't do without
    rank = np.arange(len(of)) - start[of[order]]
    prefix = order[rank < (size + (-num * size // den) + 1)[of[order]]]
    prefix = prefix[df[back[prefix]] > 1]
    order = np.argsort(back[prefix], kind="stable")
    holder = of[prefix][order]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(back[prefix], minlength=len(df)))])
    mine = np.searchsorted(of[prefix], np.arange(len(doc) + 1))  # each set's own slice of ``prefix``
    label = np.unique(group, return_inverse=True)[1]
    out = []
    for a in range(len(doc)):
        tokens = back[prefix[mine[a] : mine[a + 1]]]
        near = np.unique(_ragged(holder, bounds[tokens], bounds[tokens + 1] - bounds[tokens]))
        near = near[(near > a) & (label[near] != label[a]) & ((role[near] < UPPER) | (role[near] != role[a])) & (den * np.minimum(size[near], size[a]) >= num * np.maximum(size[near], size[a]))]
        while len(near):
            part, near = near[:64], near[64:]
            hit = part[_star(sets[start[a] : start[a] + size[a]], sets, start[part], size[part], share)]
            if len(hit):
                out += [(int(doc[a]), int(doc[b])) for b in hit.tolist()]
                if not every:
                    label[np.isin(label, label[hit])] = label[a]
                    near = near[label[near] != label[a]]
    return out


def _compare(share: tuple[int, int], every: bool):
    """Links among the sets that came together: with a leader, or of groups that meet."""
    num, den = share

    def rows(batches):
        found: dict[int, list] = {}
        for shard, _, data, extra in blobs.blobs_in(batches):
            found.setdefault(shard, []).append((blobs.unpack(data, _SET), extra))
        for parts in found.values():
            where, doc, role, group, size = blobs.join([x for x, _ in parts], _SET)
            sets = np.frombuffer(b"".join(x for _, x in parts), U)
            del parts
            size = size.astype(np.int64)
            start = np.cumsum(size) - size
            order = np.lexsort((doc, role, where))
            w = where[order]
            cuts = np.append(np.flatnonzero(np.append(True, w[1:] != w[:-1])), len(w))
            links: list[tuple[int, int]] = []
            for x, y in zip(cuts[:-1], cuts[1:]):
                at = order[x:y]
                if role[at[-1]] >= MEETING and len(at) <= 6:
                    for i, one in enumerate(at[:-1].tolist()):
                        other = at[i + 1 :]
                        other = other[(group[other] != group[one]) & ((role[other] < UPPER) | (role[other] != role[one]))]
                        if len(other):
                            hit = other[_star(sets[start[one] : start[one] + size[one]], sets, start[other], size[other], share)]
                            links += [(int(doc[one]), int(d)) for d in doc[hit].tolist()]
                elif role[at[-1]] >= MEETING:
                    # the bound by the groups' unions: what no other group's union shares enough of stays closed
                    at = _open(at, group, size, start, sets, share)
                    if len(at) > 1:
                        links += _meeting(doc[at], group[at], size[at], role[at], _ragged(sets, start[at], size[at]), share, every)
                elif role[at[-1]] == LEADER and len(at) > 1:
                    lead, at = at[-1], at[:-1]
                    hit = at[_star(sets[start[lead] : start[lead] + size[lead]], sets, start[at], size[at], share)]
                    links += [(int(doc[lead]), int(d)) for d in doc[hit].tolist() if d != doc[lead]]
            if links:
                a, b = np.array(links, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return rows


def _open(at: np.ndarray, group: np.ndarray, size: np.ndarray, start: np.ndarray, sets: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Those whose overlap with the union of the other groups reaches their bound."""
    num, den = share
    values = _ragged(sets, start[at], size[at])
    of = np.repeat(np.arange(len(at)), size[at])
    _, back = np.unique(values, return_inverse=True)
    g = np.unique(group[at], return_inverse=True)[1][of]
    # an element is in another group's union unless all that hold it are of one group
    low, high = np.full(back.max() + 1, len(at)), np.full(back.max() + 1, -1)
    np.minimum.at(low, back, g)
    np.maximum.at(high, back, g)
    elsewhere = np.bincount(of, (low != high)[back], len(at))
    return at[den * elsewhere >= num * size[at]]


def _exploded(batches):
    """Rarest tokens with the class and the group that hold them."""
    for batch in batches:
        doc, group, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        tokens = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(3)]
        reps = [len(t) for t in tokens]
        columns = [np.concatenate(tokens), np.repeat(doc, reps), np.repeat(group, reps), np.repeat(size, reps)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["token", "id", "group", "size"])


def _groups(batches):
    """Different pairs of token and group of a task's batches: in one worker, not after another's."""
    for batch in _exploded(batches):
        token, group = (batch.column(i).to_numpy() for i in (0, 2))
        order = np.lexsort((group, token))
        new = np.append(True, (token[order][1:] != token[order][:-1]) | (group[order][1:] != group[order][:-1]))[: len(order)]
        at = order[new]
        yield pa.RecordBatch.from_arrays([pa.array(token[at]), pa.array(group[at])], names=["token", "group"])


def _tokens(n: int):
    """Tokens with the class and the group that hold them, to the tokens' shards."""

    def rows(batches):
        for batch in batches:
            token, doc, group, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            token = token.view(U)
            yield from blobs.deal([token, doc, group, size.astype(np.int32)], blobs.shard_of(mix(token), n), TOKEN)

    return lambda batches: blobs.batches_of(rows(batches))


def _meet(share: tuple[int, int], n: int, limits: tuple[int, int]):
    """Groups that meet in a token: which classes of theirs come together, once for all tokens that the same ones hold.

    Where a token has few pairs across groups, the classes of each two groups
    meet by themselves, as they do in other tokens; else all of the token's
    holders meet at once, so sets never travel once per pair.
    """
    num, den = share
    partners, banded = limits

    def rows(batches):
        token, doc, group, size = blobs.join([blobs.unpack(data, _TOKEN) for *_, data, _ in blobs.blobs_in(batches)], _TOKEN)
        if not len(token):
            return
        order = np.lexsort((doc, token))
        token, doc, group, size = token[order], doc[order], group[order], size[order].astype(np.int64)
        opens = np.append(True, token[1:] != token[:-1])
        which = np.cumsum(opens) - 1
        begin = np.flatnonzero(opens)
        held = np.diff(np.append(begin, len(token)))
        several = np.minimum.reduceat(group, begin) != np.maximum.reduceat(group, begin)
        name = mix(np.add.reduceat(mix(doc), begin) ^ held.astype(U))
        lists = np.flatnonzero(several)
        lists = lists[np.unique(name[lists], return_index=True)[1]]
        out, pairs = [], []
        for at in lists.tolist():
            d, g, s = (c[begin[at] : begin[at] + held[at]] for c in (doc, group, size))
            _, own = np.unique(g, return_counts=True)
            m = len(d)
            by = np.argsort(s, kind="stable")
            d, g, s = d[by], g[by], s[by]
            upto = np.searchsorted(s, s * den // num, "right")  # sizes that a link allows
            across = min((m * (m - 1) - (own * (own - 1)).sum()) // 2, (upto - np.arange(m) - 1).sum())
            if across > partners * m:  # together: fewer sets travel than in pairs
                if m <= banded:
                    out.append([d, np.full(m, name[at]), g, np.full(m, MEETING)])
                    continue
                # sizes that a link allows lie in one band or in two that follow each other
                band = np.floor(np.log(s) / (np.log(den / num) * 1.0001)).astype(np.int64)
                out.append([d, mix(name[at] ^ mix(band)), g, np.full(m, MEETING)])
                up = np.isin(band - 1, band)
                out.append([d[up], mix(name[at] ^ mix(band[up] - 1)), g[up], np.full(up.sum(), UPPER)])
                continue
            for i in range(m - 1):
                other = np.arange(i + 1, upto[i])
                other = other[g[other] != g[i]]
                if len(other):
                    pairs.append(np.stack([np.full(len(other), d[i]), np.full(len(other), g[i]), d[other], g[other]], axis=1))
            if len(pairs) > 20_000:
                pairs = [np.unique(np.concatenate(pairs), axis=0)]
        if pairs:
            x, gx, y, gy = np.unique(np.concatenate(pairs), axis=0).T
            where = mix(mix(np.minimum(gx, gy)) + mix(np.maximum(gx, gy) ^ np.int64(1)))
            out += [[x, where, gx, np.full(len(x), MEETING)], [y, where, gy, np.full(len(y), MEETING)]]
        if out:
            d, where, g, role = (np.concatenate(c) for c in zip(*out))
            sent = np.unique(np.rec.fromarrays([d, where, role.astype(np.int8), g]))
            yield from blobs.deal([sent[f] for f in sent.dtype.names], blobs.shard_of(mix(sent["f0"]), n), FETCH)

    return lambda batches: blobs.batches_of(rows(batches))


def _forest(partners: int):
    """Which classes of different groups a shard's tokens bring together: as links of a spanning forest, with the sets that ``_meet`` would send, at most."""

    def rows(batches):
        token, doc, group, _ = blobs.join([blobs.unpack(data, _TOKEN) for *_, data, _ in blobs.blobs_in(batches)], _TOKEN)
        if not len(token):
            return
        order = np.lexsort((group, token))
        token, doc, group = token[order], doc[order], group[order]
        opens = np.append(True, token[1:] != token[:-1])
        begin = np.flatnonzero(opens)
        held = np.diff(np.append(begin, len(token)))
        name = mix(np.add.reduceat(mix(doc), begin) ^ held.astype(U))
        several = np.flatnonzero(group[begin] != group[begin + held - 1])
        lists = several[np.unique(name[several], return_index=True)[1]]
        if not len(lists):
            return
        runs = np.flatnonzero(opens | np.append(True, group[1:] != group[:-1]))
        own = np.diff(np.append(runs, len(token)))
        pairs = (held * (held - 1) - np.add.reduceat(own * (own - 1), np.searchsorted(runs, begin))) // 2
        sent = np.where(pairs > partners * held, held, 2 * pairs)[lists]
        node, at = np.unique(_ragged(doc, begin[lists], held[lists]), return_inverse=True)
        starts = np.cumsum(held[lists]) - held[lists]
        label = np.arange(len(node))
        while True:
            least = np.minimum.reduceat(label[at], starts)
            after = label.copy()
            np.minimum.at(after, at, np.repeat(least, held[lists]))
            after = after[after]
            if (after == label).all():
                break
            label = after
        cost = np.bincount(label[at[starts]], sent, len(node)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[label]), pa.array(cost)], names=["a", "b", "sent"])

    return rows


def _together(n: int):
    """The classes of clusters to the places where each two of its blocks come together."""

    def rows(batches):
        for batch in batches:
            doc, group, cluster, blocks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            own = (mix(mix(doc) ^ U(0xB10C)) % blocks.astype(U)).astype(np.int64)
            other = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            doc, group, cluster, own = (np.repeat(c, blocks) for c in (doc, group, cluster, own))
            low, high = np.minimum(own, other), np.maximum(own, other)
            role = np.where(low == high, MEETING, np.where(own == low, LOWER, UPPER)).astype(np.int8)
            where = mix(mix(mix(cluster ^ np.int64(0xC1)) + low.astype(U)) + high.astype(U))
            yield from blobs.deal([doc, where, role, group], blobs.shard_of(mix(doc), n), FETCH)

    return lambda batches: blobs.batches_of(rows(batches))


def _prefixes(batches):
    for _, _, data, extra in blobs.blobs_in(batches):
        doc, size, keep = blobs.unpack(data, [np.int64, np.int32, np.int32])
        tokens = np.frombuffer(extra, U)
        for at in range(0, len(doc), 5000):
            k = keep[at : at + 5000].astype(np.int64)
            begin = int(keep[:at].sum())
            bounds = np.concatenate([[0], np.cumsum(k)])
            yield pa.RecordBatch.from_arrays([pa.array(doc[at : at + 5000]), pa.array(size[at : at + 5000].astype(np.int64)), blobs.binary_column(tokens[begin : begin + bounds[-1]].tobytes(), bounds * 8)], names=["id", "size", "tokens"])


def _members(batches):
    for _, _, data, _ in blobs.blobs_in(batches):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in blobs.unpack(data, _MEMBER)], names=["id", "first"])


def _locals(batches):
    for _, _, data, _ in blobs.blobs_in(batches):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in blobs.unpack(data, _LOCAL)], names=["id", "near", "size"])


class _Join:
    """What both results begin with: texts, classes and their rarest shared tokens, and the comparison of sets that are asked for."""

    def __init__(self, docs: DataFrame, width: int, threshold: tuple[int, int], id_col: str, text_col: str, every: bool = False, limits: tuple[int, int] = (PARTNERS, BANDED), whole: tuple[int, int] | None = WHOLE):
        self.limits, self.whole = limits, whole
        self.n = n = blobs.shards(docs.sparkSession)
        self.width, self.threshold, self.every = width, threshold, every
        self.texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).where("id is not null")
        sets = blobs.exchange(self.texts.mapInArrow(_first_map(width, threshold, n), blobs.ROWS), n)
        shared = blobs.exchange(sets.mapInArrow(_shared(n), blobs.ROWS), n)
        self.classes = blobs.cut(shared.mapInArrow(_classes(n), blobs.ROWS))
        del sets, shared
        blobs.forget(docs.sparkSession)
        self.prefixes = self.of(PREFIX).mapInArrow(_prefixes, "id long, size long, tokens binary")
        self.members = self.of(MEMBER).mapInArrow(_members, "id long, first long")
        self.locals = self.of(LOCAL).mapInArrow(_locals, "id long, near long, size long")

    def of(self, kind: int) -> DataFrame:
        return self.classes.where(F.col("kind") == kind)

    def compared(self, fetch: DataFrame) -> DataFrame:
        wanted = blobs.exchange(fetch, self.n).mapInArrow(blobs.by_document(FETCH, _FETCH), "id long, found binary")
        sent = self.texts.join(wanted, "id").mapInArrow(_send_sets(self.width, self.n), blobs.ROWS)
        return blobs.exchange(sent, self.n).mapInArrow(_compare(self.threshold, self.every), "a long, b long")

    def met(self, groups: DataFrame) -> DataFrame:
        """Links between classes of different groups (id, group, size, tokens)."""
        rows = groups.mapInArrow(_exploded, "token long, id long, group long, size long")
        pairs = groups.mapInArrow(_groups, "token long, group long").groupBy("token").agg(F.min("group").alias("least"), F.max("group").alias("most"))
        held_by_several = rows.join(pairs.where("least <> most").select("token"), "token").select("token", "id", "group", "size")
        held = blobs.cut(held_by_several)
        dealt = lambda rows: blobs.exchange(rows.mapInArrow(_tokens(self.n), blobs.ROWS), self.n)
        if self.whole is None:
            return self.compared(dealt(held).mapInArrow(_meet(self.threshold, self.n, self.limits), blobs.ROWS))
        forest = blobs.cut(dealt(held).mapInArrow(_forest(self.limits[0]), "a long, b long, sent long"))
        clusters = components(forest.select("a", "b"))
        of = F.col("component")
        sent = forest.groupBy(F.col("a").alias("node")).agg(F.sum("sent").alias("sent"))
        own = groups.select(F.col("id").alias("node"), "group", "size").distinct().join(clusters, "node").join(sent, "node")
        most, shingles = self.whole
        blocks = F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("size") / shingles)).alias("blocks")
        sizes = own.groupBy(of).agg(blocks, F.count("*").alias("members"), F.sum("sent").alias("sent"))
        planned = sizes.select(of, F.when((F.col("blocks") == 1) | (F.col("members") * F.col("blocks") <= F.col("sent")), F.col("blocks")).alias("blocks"))
        planned = blobs.cut(own.join(planned, "component").select("node", "group", "component", "blocks"))
        fetch = planned.where("blocks is not null").mapInArrow(_together(self.n), blobs.ROWS)
        thin = planned.where("blocks is null").select(F.col("node").alias("id"))
        if not thin.isEmpty():
            fetch = fetch.unionAll(dealt(held.join(thin, "id", "left_semi").select(held.columns)).mapInArrow(_meet(self.threshold, self.n, self.limits), blobs.ROWS))
        return self.compared(fetch)


def jaccard_links(docs: DataFrame, *, width: int = 5, threshold: tuple[int, int] = (75, 100), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, as (a, b) of their classes' least ids with a < b; and (id, class_id, n_links) of every document.

    A document's links are the other members of its class and all members of the classes that link with it.
    """
    j = _Join(docs, width, threshold, id_col, text_col, every=True)
    links = blobs.cut(j.met(j.prefixes.select("id", F.col("id").alias("group"), "size", "tokens")).distinct())
    first = j.members.groupBy(F.col("id").alias("near")).agg(F.min("first").alias("first"))
    every = j.locals.join(first, "near", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("first", "id").alias("class_id"), "size")).alias("own")).select("id", "own.class_id", "own.size")
    sizes = every.groupBy("class_id").agg(F.count("*").alias("members"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("class_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("class_id"), F.col("a").alias("other")))).alias("way")
    around = links.select(ways).select("way.*").join(sizes.withColumnRenamed("class_id", "other"), "other").groupBy("class_id").agg(F.sum("members").alias("around"))
    counted = sizes.join(around, "class_id", "left").select("class_id", (F.col("members") - 1 + F.coalesce("around", F.lit(0))).alias("n_links"))
    known = every.join(counted, "class_id").select("id", "class_id", F.when(F.col("size") > 0, F.col("n_links")).otherwise(0).alias("n_links"))
    whole = docs.select(F.col(id_col).cast("long").alias(id_col)).join(known.withColumnRenamed("id", id_col), id_col, "left")
    return links, whole.select(id_col, "class_id", "n_links")


def jaccard_components(docs: DataFrame, *, width: int = 5, threshold: tuple[int, int] = (75, 100), id_col: str = "doc_id", text_col: str = "text", limits: tuple[int, int] = (PARTNERS, BANDED), whole: tuple[int, int] | None = WHOLE) -> DataFrame:
    """(id, n_shingles, class_id, component_id) of every document.

    class_id: the least id of those with an equal set; component_id: the least
    id reachable by links. ``threshold`` is a fraction of at least one half.
    limits: from how many possible partners a holder of a shingle, and from how
    many holders, other plans are used. whole: classes and shingles of a block of a
    cluster; without it, classes meet by shingles alone. Results are the same.
    """
    j = _Join(docs, width, threshold, id_col, text_col, limits=limits, whole=whole)
    parts = blobs.exchange(j.of(KEY), j.n).mapInArrow(_leaders(j.n, True), blobs.ROWS)
    near = blobs.cut(j.compared(blobs.exchange(parts, j.n).mapInArrow(_leaders(j.n, False), blobs.ROWS)))
    del parts
    blobs.forget(docs.sparkSession)
    groups = components(near)
    grouped = j.prefixes.join(groups.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("group"), "size", "tokens")
    # groups as links: a group's members to its name
    links = j.met(grouped).unionAll(groups.select(F.col("node").alias("a"), F.col("component").alias("b")))
    joined = components(links)
    # the first ones that tasks have seen, a row a task and class; and from there to all documents
    known = j.members.join(joined.withColumnRenamed("node", "first"), "first", "left").groupBy(F.col("id").alias("near"))
    known = known.agg(F.min(F.struct("first", F.coalesce("component", "first").alias("component"))).alias("known"))
    found = j.locals.join(known, "near", "left")
    own = F.struct(F.coalesce("known.first", "id").alias("class_id"), F.coalesce("known.component", "id").alias("component_id"), F.col("size").alias("n_shingles"))
    found = found.groupBy("id").agg(F.min(own).alias("own")).select("id", "own.*")
    every = docs.select(F.col(id_col).cast("long").alias(id_col))
    return every.join(found.withColumnRenamed("id", id_col), id_col, "left").select(id_col, "n_shingles", "class_id", "component_id")

"""An n-gram language model in a trie of Elias-Fano levels, trained and read by Spark tasks.

Tokens are words and one end per document; the end also stands before the
first word. Every word, bigram and trigram of the training documents is kept,
with its exact count, those that occur once included. A shorter context takes over for n-grams that training
documents don't have, with the probability that discounting leaves it:

    p1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))
    p2(w | v) = (c(v w) - D)+ / c(v) + left(v) p1(w)
    p3(w | u v) = (c(u v w) - D)+ / c(u v) + left(u v) p2(w | v)

Each shard of the trie holds the words of a range of hashes and what they
begin: sorted hashes and counts of its words; for each word a pointer to its
successors, which lie in one monotone sequence (their numbers, raised by the
last value before their context). Bigrams are numbered in that order, and the
shards of trigrams are ranges of those numbers, cut so that a shard's bigrams
occur about equally often: what begins with a common word fills many of them.
For each bigram they have a pointer to its own successors, which are stored as
places among the successors of its last word.
Pointers and sequences are Elias-Fano coded; discounted probabilities and left
masses take one byte each. A query finds a bigram by successor search within
its context's range, and a trigram by the place that its last bigram has there.

Shards are files in a folder that all executors see, memory-mapped where they
are read: neither the driver nor a broadcast ever holds the model, and a task
touches only the pages that its words need, in the order in which they lie.
Pointers stay encoded. Files are written beside and renamed, so a task that
runs again does no harm; a folder that ``train`` makes goes when the driver's
process ends, or with ``Trie.remove``.

Defined results: words are lower-cased A-Z; null and empty texts are one end;
a null id counts as held out; repeated rows count each time; an empty table or
one without training rows gives a model without words, in which every token
has base probability 1 (N = V = 0); input columns named like
results are replaced.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blobs
from .elias_fano import Monotone
from .hashing import FOLD, U, Words, chunks, mix
from .stored import Stored, press, save, shared_folder, unpress

WORD, PAIR, TRIPLE = range(3)
_WORD = [U, np.int64]
_GRAM = [np.uint32, np.uint64, np.uint32]  # context within its shard, item, occurrences
END = mix(np.array([0xE4D], U))[0]
#: Tokens that a task holds before it combines them; bytes of text that are looked up at once.
HELD, CHUNK = 2_000_000, 4 << 20
DISCOUNT = 0.75


class Bytes8:
    """Values of (0, 1] in 255 steps of their logarithm, and 0."""

    @staticmethod
    def code(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        logs = np.log(np.maximum(values, 1e-30))
        some = logs[values > 1e-30]
        low, high = (some.min(), some.max()) if len(some) else (0.0, 0.0)
        code = np.where(values > 1e-30, 1 + np.round((logs - low) * (254 / max(high - low, 1e-9))), 0)
        table = np.concatenate([[0.0], np.exp(low + np.arange(255) * ((high - low) / 254))])
        return code.astype(np.uint8), table


def _by_key(parts: list[list[np.ndarray]], dtypes: list) -> list[np.ndarray]:
    """Sums of the last column by the others, in their order."""
    *keys, n = blobs.join(parts, dtypes)
    if not len(n):
        return [*keys, n.astype(np.int64)]
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
    return [*(k[new] for k in keys), np.add.reduceat(n[order].astype(np.int64), np.flatnonzero(new))]


@dataclass
class Trie(Stored):
    """The folder, and what little is known of all shards."""

    shards: int = 1
    total: int = 0  # N
    distinct: int = 0  # V
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # number of each shard's first word
    pair_first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # number of each shard's first bigram
    parts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # number of each trigram shard's first bigram

    end: int = -1  # the end's number

    def level(self, level: int, shard: int) -> dict:
        return self.arrays(self.file(level, shard))

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words in the training documents, and their numbers (-1: none)."""
        count, number = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1, np.int64)
        for shard, at in self.by_shard(blobs.shard_of(hashes, self.shards)):
            words = self.level(1, shard)
            if not len(words.get("hashes", ())):
                continue
            h = hashes[at]
            place = np.minimum(np.searchsorted(words["hashes"], h), len(words["hashes"]) - 1)
            known = words["hashes"][place] == h
            at, place = at[known], place[known]
            count[at] = words["counts"][place]
            number[at] = self.first[shard] + place
        return count, number

    def home(self, number: np.ndarray) -> np.ndarray:
        return (np.searchsorted(self.first, number, "right") - 1).astype(np.int32)

    def part(self, pair: np.ndarray) -> np.ndarray:
        return (np.searchsorted(self.parts, pair, "right") - 1).astype(np.int32)

    def totals(self, part: int) -> np.ndarray:
        """Occurrences of the bigrams that begin a trigram shard's trigrams. While training only."""
        home = int(np.searchsorted(self.pair_first, self.parts[part], "right")) - 1
        end = self.parts[part + 1] if part + 1 < len(self.parts) else None
        begin = self.pair_first[home]
        return self.level(0, home)["n"][self.parts[part] - begin : None if end is None else end - begin]

    def pairs(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of words v w by number, sorted by v: the bigram's number (-1: none), its place among v's, its discounted probability, and what v leaves."""
        place, rank = np.full(len(v), -1, np.int64), np.full(len(v), -1, np.int64)
        prob, left = np.zeros(len(v)), np.ones(len(v))
        for shard, at in self.by_shard(self.home(v)):
            level = self.level(2, shard)
            local = v[at] - self.first[shard]
            left[at] = level["left_table"][level["left"][local]]
            found, begin = _find(level, local, w[at])
            hit = found >= 0
            place[at], rank[at] = np.where(hit, found + self.pair_first[shard], -1), np.where(hit, found - begin, -1)
            prob[at[hit]] = level["prob_table"][level["prob"][found[hit]]]
        return place, rank, prob, left

    def triples(self, pair: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of bigrams by number, sorted, and the place of the next word among the last word's: discounted probability, and what the bigram leaves."""
        prob, left = np.zeros(len(pair)), np.ones(len(pair))
        for part, at in self.by_shard(self.part(pair)):
            level = self.level(3, part)
            if not level:
                continue
            local = pair[at] - self.parts[part]
            left[at] = level["left_table"][level["left"][local]]
            some = np.flatnonzero(rank[at] >= 0)
            found, _ = _find(level, local[some], rank[at[some]])
            hit = found >= 0
            prob[at[some[hit]]] = level["prob_table"][level["prob"][found[hit]]]
        return prob, left

    def located(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """By token: its count and number, the number of the word before it, and its bigram's number, place, probability and left mass."""
        unique, back = np.unique(tokens, return_inverse=True)
        count, number = (x[back] for x in self.words(unique))
        before = np.where(first, self.end, np.append(-1, number[:-1])[: len(number)])
        pair, rank = np.full(len(tokens), -1, np.int64), np.full(len(tokens), -1, np.int64)
        prob, left = np.zeros(len(tokens)), np.ones(len(tokens))
        at = np.flatnonzero((before >= 0) & (number >= 0))
        v, w, back = _distinct(before[at], number[at])
        pair[at], rank[at], prob[at], left[at] = (x[back] for x in self.pairs(v, w))
        # what v leaves holds before unknown words too
        at = np.flatnonzero((before >= 0) & (number < 0))
        v, back = np.unique(before[at], return_inverse=True)
        mass = np.ones(len(v))
        for shard, x in self.by_shard(self.home(v)):
            level = self.level(2, shard)
            mass[x] = level["left_table"][level["left"][v[x] - self.first[shard]]]
        left[at] = mass[back]
        return count, number, before, pair, rank, prob, left

    def keys(self, tokens: np.ndarray, first: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Contexts and items of the bigrams or trigrams of a chunk, by number."""
        if kind == PAIR:
            unique, back = np.unique(tokens, return_inverse=True)
            number = self.words(unique)[1][back]
            return np.where(first, self.end, np.append(-1, number[:-1])[: len(number)]), number
        _, _, _, pair, rank, _, _ = self.located(tokens, first)
        at = np.flatnonzero(~first)
        return pair[at - 1], rank[at]

    def score(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By token: count in the training documents, base and model probability. ``first``: marks documents' first tokens."""
        count, _, _, pair, rank, prob, left = self.located(tokens, first)
        base = (count + 0.1) / (self.total + 0.1 * (self.distinct + 1))
        p = prob + left * base
        # the bigram that ends before a token is its context, if it begins in the document; each trigram is looked up once
        context = np.append(-1, pair[:-1])[: len(pair)]
        context[first] = -1
        at = np.flatnonzero(context >= 0)
        c, r, back = _distinct(context[at], rank[at] + 1)
        prob, left = self.triples(c, r - 1)
        p[at] = prob[back] + left[back] * p[at]
        return count, base, p


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of numbers of at least 0 in order, and the place there of each."""
    top = int(b.max(initial=0)) + 1
    if (int(a.max(initial=0)) + 1) * top < 1 << 63:
        key, back = np.unique(a * top + b, return_inverse=True)
        return *np.divmod(key, top), back
    order = np.lexsort((b, a))
    new = _opens(a[order], b[order])
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return a[order][new], b[order][new], back


def _opens(*columns: np.ndarray) -> np.ndarray:
    """Marks the first of equal rows, which stand together."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _find(level: dict, context: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of items within the ranges of their contexts, which are sorted (-1: none), and where those begin."""
    items = level["items"]
    if not items.n or not len(context):
        return np.full(len(context), -1, np.int64), np.zeros(len(context), np.int64)
    new = _opens(context)
    one, of = context[new], np.cumsum(new) - 1
    begin, end = level["pointers"][one], level["pointers"][one + 1]
    raised = np.where(begin > 0, items[np.maximum(begin - 1, 0)], 0)[of]
    begin, end = begin[of], end[of]
    place = np.full(len(context), -1, np.int64)
    some = np.flatnonzero(end > begin)
    place[some] = items.find((item + raised)[some], begin[some], end[some])
    return place, begin


def _level(context: np.ndarray, item: np.ndarray, n: np.ndarray, total: np.ndarray) -> dict:
    """A level from n-grams sorted by context and item; ``total``: occurrences of every context."""
    counts = np.bincount(context, minlength=len(total))
    pointers = np.concatenate([[0], np.cumsum(counts)])
    full = np.flatnonzero(counts)
    # each context's items are raised by the last value before them
    last = item[pointers[full + 1] - 1]
    raise_by = np.zeros(len(total), np.int64)
    raise_by[full] = np.concatenate([[0], np.cumsum(last)[:-1]]) if len(full) else []
    mass = np.maximum(n - DISCOUNT, 0) / np.maximum(total[context], 1)
    left = np.maximum(1 - np.bincount(context, mass, len(total)), 1e-9)
    prob, prob_table = Bytes8.code(mass)
    left, left_table = Bytes8.code(left)
    return {"pointers": Monotone.of(pointers), "items": Monotone.of(item + raise_by[context]), "prob": prob, "prob_table": prob_table, "left": left, "left_table": left_table}


def _tokens(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and ends, and a mark on each document's first token."""
    w = Words(FOLD[flat], offsets)
    tokens = np.insert(w.hashes, w.first[1:], END)
    first = np.zeros(len(tokens), bool)
    first[w.first[:-1] + np.arange(len(offsets) - 1)] = True
    return tokens, first


def _count_words(n: int):
    def rows(batches):
        held, size = [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            yield from blobs.deal([h, c.astype(np.int64)], blobs.shard_of(h, n), WORD)

        for batch in batches:
            for _, flat, offsets in chunks(batch, 0, CHUNK):
                held.append(_tokens(flat, offsets)[0])
                size += len(held[-1])
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return lambda batches: blobs.batches_of(rows(batches))


def _write_words(trie: Trie):
    def rows(batches):
        found: dict[int, list] = {}
        for shard, _, data, _ in blobs.blobs_in(batches):
            found.setdefault(shard, []).append(blobs.unpack(data, _WORD))
        for shard, parts in found.items():
            h, n = _by_key(parts, _WORD)
            save(trie.file(1, shard), {"hashes": h, "counts": n})
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, len(h), int(n.sum()))], names=["shard", "words", "tokens"])

    return rows


def _empty_levels(trie: Trie):
    """A next level without bigrams for every shard; those that begin some are written over it."""

    def rows(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                none = np.zeros(0, np.int64)
                save(trie.file(2, shard), _level(none, none, none, trie.level(1, shard).get("counts", none)))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64())], names=["shard"])

    return rows


def _count_grams(trie: Trie, kind: int):
    shard_of, begins = (trie.home, trie.first) if kind == PAIR else (trie.part, trie.parts)

    def rows(batches):
        held, size = [], 0

        def flush():
            context, item, back = _distinct(*(np.concatenate(x) for x in zip(*held)))
            n = np.bincount(back, minlength=len(context))
            shard = shard_of(context)
            columns = [(context - begins[shard]).astype(np.uint32), item.astype(np.uint64), n.astype(np.uint32)]
            for s, at in trie.by_shard(shard):
                yield s, kind, press([c[at] for c in columns]), None

        for batch in batches:
            for _, flat, offsets in chunks(batch, 0, CHUNK):
                tokens, first = _tokens(flat, offsets)
                held.append(trie.keys(tokens, first, kind))
                size += len(tokens)
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return lambda batches: blobs.batches_of(rows(batches))


def _write_grams(trie: Trie, kind: int):
    def rows(batches):
        found: dict[int, list] = {}
        for shard, _, data, _ in blobs.blobs_in(batches):
            context, item, n = unpress(data, _GRAM)
            found.setdefault(shard, []).append([context.astype(np.int64), item.astype(np.int64), n])
        for shard in list(found):
            context, item, n = (np.concatenate(x) for x in zip(*found.pop(shard)))
            context, item, back = _distinct(context, item)
            n = np.bincount(back, n, len(context)).astype(np.int64)
            total = trie.level(1, shard)["counts"] if kind == PAIR else trie.totals(shard)
            level = _level(context, item, n, total)
            save(trie.file(2 if kind == PAIR else 3, shard), level)
            share = max(1, -(-trie.total // trie.shards))
            cuts = np.zeros(0, np.int64)
            if kind == PAIR:
                save(trie.file(0, shard), {"n": n})  # for the next level
                share_of = (np.cumsum(n) - n) // share
                cuts = np.flatnonzero(share_of[1:] != share_of[:-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([len(n)], pa.int64()), pa.array([cuts.astype(np.int64).tobytes()], pa.binary())], names=["shard", "grams", "cuts"])

    return rows


def is_held_out(id_col: str, folds: int = 10):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> Trie:
    """Train on the rows that aren't held out (crc32 of the id modulo 10 is not 0); gives the trie on the shared folder."""
    spark = docs.sparkSession
    n = blobs.shards(spark)
    trie = Trie(folder or shared_folder(docs, "trie"), n, first=np.zeros(n, np.int64))
    texts = docs.where(~is_held_out(id_col)).select(F.col(text_col).cast("binary").alias("text"))
    counted = blobs.exchange(texts.mapInArrow(_count_words(n), blobs.ROWS), n)
    # a row a shard, here and below
    written = counted.mapInArrow(_write_words(trie), "shard long, words long, tokens long").collect()
    trie.total, trie.distinct = sum(r.tokens for r in written), sum(r.words for r in written)
    words = dict.fromkeys(range(n), 0) | {r.shard: r.words for r in written}
    # a shard without words begins where the next one does; home() finds the last of those, which has them
    trie.first = np.concatenate([[0], np.cumsum([words[shard] for shard in range(n)])])[:-1].astype(np.int64)
    trie.end = int(trie.words(np.array([END], U))[1][0])
    spark.range(0, n, 1, n).mapInArrow(_empty_levels(trie), "shard long").agg(F.count("*")).first()
    made = "shard long, grams long, cuts binary"
    pairs = blobs.exchange(texts.mapInArrow(_count_grams(trie, PAIR), blobs.ROWS), n)
    written = {r.shard: r for r in pairs.mapInArrow(_write_grams(trie, PAIR), made).collect()}  # a row a shard, and all cuts are as many as shards at most
    grams = [written[shard].grams if shard in written else 0 for shard in range(n)]
    trie.pair_first = np.concatenate([[0], np.cumsum(grams)])[:-1].astype(np.int64)
    trie.parts = np.unique(np.concatenate([trie.pair_first, *(trie.pair_first[shard] + np.frombuffer(r.cuts, np.int64) for shard, r in written.items())]))
    triples = blobs.exchange(texts.mapInArrow(_count_grams(trie, TRIPLE), blobs.ROWS), len(trie.parts))
    triples.mapInArrow(_write_grams(trie, TRIPLE), made).agg(F.sum("grams")).first()
    for shard in range(n):
        if os.path.exists(trie.file(0, shard)):
            os.remove(trie.file(0, shard))
    trie.held.clear()
    return trie


def score(docs: DataFrame, trie: Trie, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of whole texts)."""
    made = T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    others = [c for c in docs.columns if c not in made.names]
    schema = T.StructType([*(docs.schema[c] for c in others), *made])

    def run(batches):
        for batch in batches:
            for rows, flat, offsets in chunks(batch, 1, CHUNK):
                tokens, first = _tokens(flat, offsets)
                count, base, p = trie.score(tokens, first)
                doc, n = np.cumsum(first) - 1, len(offsets) - 1
                part = batch.slice(rows.start, rows.stop - rows.start)
                total = np.bincount(doc, minlength=n)
                columns = [total, np.bincount(doc, count > 0, n).astype(np.int64), np.full(n, trie.total), np.bincount(doc, np.log10(base), n), np.bincount(doc, np.log10(p), n)]
                yield pa.RecordBatch.from_arrays([*(part.column(2 + i) for i in range(len(others))), part.column(0), *map(pa.array, columns)], names=schema.names)

    return docs.select(is_held_out(id_col).alias("_tp_held"), F.col(text_col).cast("binary").alias("_tp_text"), *others).mapInArrow(run, schema)

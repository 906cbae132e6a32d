"""Quality rules, with an n-gram perplexity that must lie within its language's band.

Spark counts n-grams of code points over all documents, for each language. The
model is an interpolated modified Kneser-Ney one: the highest order has counts,
each lower one the number of different symbols that its n-grams follow. A
context's n-grams lie in one shard, and a shard of an order is a file of arrays
sorted by hash, of n-grams with their discounted probabilities and of contexts
with the mass that they leave to the order below. Files lie in the folder that
executors share and are memory-mapped, so the model may grow with the corpus:
neither the driver nor a broadcast holds it. Tasks pre-aggregate what they
count; an exchange moves each different n-gram once a task.

Symbols are code points with A-Z lower-cased, digits as one and runs of the six
word-ending bytes as one space; those beyond the basic plane fold into its
private area, so that four fit one number.

A language's band lies around the median of log perplexity over all its
documents that pass the base rules. The mean over n symbols is the rougher the
fewer there are, so the band is as wide as ``widths`` times the root of
far + near / n, which the spreads of the quartiles by length give: a weighted
fit over powers of two of n. Medians and quartiles come from a histogram, so
reruns agree.

Defined results: null and empty texts have no words and fail the base rules; a
null language is a language; languages without a passing document reject
nothing; repeated rows and ids count as rows of their own; an empty table
gives an empty result; input columns named like results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blobs
from .hashing import FOLD, U, Words, chunks, grams, mix, span_hash
from .stored import Stored, press, save, shared_folder, unpress

ORDER = 4  # symbols of 16 bits in a number of 64
MOST_FAILED_REPEATS, LEAST_WORDS, WINDOW = 20, 10, 5  # fixed values of the base rules
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
STEP = 0.002  # of the histogram of log perplexities
#: Different n-grams that a task holds before it combines and sends them; symbols that are looked at together.
HELD, SLICE = 1_500_000, 400_000
COUNTED, OF_COUNTS = 0, 10  # kinds of rows: n-grams of an order, and how many of them have which count
_GRAM = [U, U, np.uint32]  # language, n-gram, count
_OF_COUNTS = [U, np.int64, np.int64, np.int64, np.int64]  # language, n-grams counted once, twice, three and four times

_SIGN = np.zeros(256, bool)
_SIGN[list(b"#*$%&|<>")] = True
_SPACE, _DIGIT = 32, 48


def symbols(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all documents, and the offset at which each one's begin."""
    lead = (flat & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    begins = np.concatenate([[0], np.cumsum(lead)])[offsets]
    b0 = FOLD[flat[at]]
    s = b0
    if len(at) < len(flat):
        b0 = b0.astype(np.uint32)
        padded = np.concatenate([flat, np.zeros(3, np.uint8)])
        b1, b2, b3 = (padded[at + k].astype(np.uint32) & 63 for k in (1, 2, 3))
        two, three = (b0 & 31) << 6 | b1, (b0 & 15) << 12 | b1 << 6 | b2
        four = (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3
        s = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, 0xE000 + four % 6400)))
    s = s.astype(np.uint16)
    s[(s >= 48) & (s < 58)] = _DIGIT
    s[(s >= 9) & (s <= 13)] = _SPACE
    again = s == _SPACE
    again[1:] &= again[:-1].copy()
    again[:1] = False
    again[begins[:-1][begins[:-1] < len(s)]] = False
    return s[~again], begins - np.concatenate([[0], np.cumsum(again)])[begins]


def codes(s: np.ndarray, begins: np.ndarray):
    """(documents, n-grams that end at each symbol) of slices of the symbols; documents begin after spaces."""
    for low in range(0, len(s), SLICE):
        high = min(len(s), low + SLICE)
        doc = np.searchsorted(begins, np.arange(low, high), "right") - 1
        at = np.arange(low, high) - begins[doc]
        code = s[low:high].astype(U)
        for k in range(1, ORDER):
            back = np.full(high - low, _SPACE, U)
            inside = at >= k
            back[inside] = s[low - k : high - k][inside] if low >= k else s[np.maximum(np.arange(low, high) - k, 0)][inside]
            code |= back << U(16 * k)
        yield doc, code


def _of(code: np.ndarray, n: int) -> np.ndarray:
    return code & U((1 << 16 * n) - 1)


def _places(language: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-grams and of their contexts, whose upper halves name the shards."""
    salt = mix(language ^ U(n))
    return mix(code * U(ORDER + 1) + U(n) ^ salt), mix((code >> U(16)) ^ mix(salt))


@dataclass
class KneserNey(Stored):
    """Log probabilities from sorted hash arrays."""

    shards: int = 1

    def score(self, language: int, code: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each of different n-grams."""
        below, p = np.zeros(1, U), np.full(1, 1 / 65536)
        for n in range(1, ORDER + 1):
            mine = np.unique(_of(code, n))
            p = p[np.searchsorted(below, _of(mine, n - 1))]
            gram, context = _places(np.full(len(mine), language, U), mine, n)
            alpha, left = np.zeros(len(mine)), np.ones(len(mine))
            for shard, at in self.by_shard(blobs.shard_of(context, self.shards)):
                level = self.arrays(self.file(n, shard))
                if not level:
                    continue
                for keys, values, wanted, out in ((level["grams"], level["alpha"], gram, alpha), (level["contexts"], level["left"], context, left)):
                    place = np.minimum(np.searchsorted(keys, wanted[at]), len(keys) - 1)
                    hit = keys[place] == wanted[at]
                    out[at[hit]] = values[place[hit]]
            below, p = mine, alpha + left * p
        return np.log(p[np.searchsorted(below, code)])


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """What modified Kneser-Ney takes from counts of none, one, two and more, from the number of n-grams with counts of one to four."""
    n = np.maximum(of_counts, 1).astype(np.float64)
    y = n[:, 0] / (n[:, 0] + 2 * n[:, 1])
    taken = [np.clip(k - (k + 1) * y * n[:, k] / n[:, k - 1], 0.1 * k, k - 0.05) for k in (1, 2, 3)]
    return np.stack([np.zeros(len(n)), *taken], axis=1)


def measures(flat: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base rules' counts for each document."""
    n = len(offsets) - 1
    w = Words(flat, offsets)
    doc, words = w.docs(), w.counts()
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    depth = np.zeros(len(flat) + 1, np.int8)
    depth[w.starts] += 1
    depth[w.ends] -= 1
    inside = np.cumsum(depth[:-1], dtype=np.int8) > 0
    out = {"n_words": words, "word_chars": total(inside & ((flat & 0xC0) != 0x80)), "n_symbols": total(_SIGN[flat])}
    # lines: from a document's start or a line feed on
    opens = np.zeros(len(flat), bool)
    feeds = np.flatnonzero(flat[:-1] == 10) + 1 if len(flat) else np.zeros(0, np.int64)
    opens[feeds] = True
    opens[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(opens)
    end = np.append(start[1:], len(flat)) if len(start) else start
    end = end - ((end > start) & (flat[np.maximum(end - 1, 0)] == 10)) if len(start) else end
    repeats = np.zeros(n, np.int64)
    if len(start):
        held = np.searchsorted(w.starts, end) > np.searchsorted(w.starts, start)
        of = np.searchsorted(offsets, start, "right") - 1
        start, end, of = start[held], end[held], of[held]
        h = span_hash(flat, start, end)
        order = np.lexsort((h, of))
        again = np.append(False, (h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1])) if len(order) else np.zeros(0, bool)
        repeats = np.bincount(of[order[again]], minlength=n)
    out["n_dup_lines"] = repeats
    g = grams(w.hashes, WINDOW)
    at = np.flatnonzero(np.arange(len(g)) + WINDOW <= w.first[1:][doc[: len(g)]]) if len(g) else np.zeros(0, np.int64)
    order = np.lexsort((g[at], doc[at]))
    s, d = g[at][order], doc[at][order]
    equal = (s[1:] == s[:-1]) & (d[1:] == d[:-1])
    twice = at[order[np.append(equal, False) | np.append(False, equal)]] if len(order) else at
    depth = np.zeros(len(doc) + 1, np.int32)
    np.add.at(depth, twice, 1)
    np.add.at(depth, np.minimum(twice + WINDOW, len(doc)), -1)
    covered = np.cumsum(depth[:-1]) > 0
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    out["base_failed"] = (words < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_FAILED_REPEATS * words)
    return out


def _summed(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Counts by language and n-gram, in their order."""
    language, code, n = blobs.join(parts, _GRAM)
    order = np.lexsort((code, language))
    language, code = language[order], code[order]
    new = np.ones(len(order), bool)
    new[1:] = (language[1:] != language[:-1]) | (code[1:] != code[:-1])
    total = np.add.reduceat(n[order].astype(np.int64), np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)
    return [language[new], code[new], np.minimum(total, (1 << 32) - 1).astype(np.uint32)]


def _dealt(columns: list[np.ndarray], order: int, n: int):
    """N-grams of an order to the shards of their contexts."""
    shard = blobs.shard_of(_places(columns[0], columns[1], order)[1], n)
    for s, at in Stored.by_shard(shard):
        yield s, COUNTED + order, press([c[at] for c in columns]), None


def _count(n: int):
    def rows(batches):
        held, size = [], 0

        for batch in batches:
            languages = batch.column(0).to_numpy(zero_copy_only=False).view(U)
            for rows, flat, offsets in chunks(batch, 1):
                for doc, code in codes(*symbols(flat, offsets)):
                    for language, at in _by_language(languages[rows], doc):
                        gram, count = np.unique(code[at], return_counts=True)
                        held.append([np.full(len(gram), language, U), gram, count.astype(np.uint32)])
                        size += len(gram)
                if size >= HELD:
                    held = [_summed(held)]  # copies of what is held already take no room
                    size = len(held[0][0])
                    if size >= HELD // 2:
                        yield from _dealt(held[0], ORDER, n)
                        held, size = [], 0
        if held:
            yield from _dealt(_summed(held), ORDER, n)

    return lambda batches: blobs.batches_of(rows(batches))


def _by_language(languages: np.ndarray, doc: np.ndarray):
    """(language, places of its documents' symbols)."""
    known, of = np.unique(languages, return_inverse=True)
    if len(known) == 1:
        yield int(known[0]), slice(None)
        return
    each = of[doc]
    for i in np.unique(each).tolist():
        yield int(known[i]), each == i


def _lower(order: int, n: int):
    """Of an order's shard: its n-grams, how many have which count, and what it adds to the order below."""

    def rows(batches):
        found: dict[int, list] = {}
        for shard, _, data, _ in blobs.blobs_in(batches):
            found.setdefault(shard, []).append(unpress(data, _GRAM))
        for shard in list(found):
            language, code, count = _summed(found.pop(shard))
            yield shard, COUNTED + order, press([language, code, count]), None
            known, of = np.unique(language, return_inverse=True)
            yield 0, OF_COUNTS + order, blobs.pack([known, *(np.bincount(of[count == k], minlength=len(known)) for k in (1, 2, 3, 4))]), None
            if order > 1:
                yield from _dealt(_summed([[language, _of(code, order - 1), np.ones(len(code), np.uint32)]]), order - 1, n)

    return lambda batches: blobs.batches_of(rows(batches))


def _write_discounts(model: KneserNey):
    def rows(batches):
        found: dict[int, list] = {}
        for _, kind, data, _ in blobs.blobs_in(batches):
            found.setdefault(kind - OF_COUNTS, []).append(blobs.unpack(data, _OF_COUNTS))
        for order, parts in found.items():
            language, *counts = blobs.join(parts, _OF_COUNTS)
            known, of = np.unique(language, return_inverse=True)
            totals = np.stack([np.bincount(of, c, len(known)) for c in counts], axis=1)
            save(model.file(order + OF_COUNTS, 0), {"languages": known, "discounts": discounts(totals).ravel()})
            yield pa.RecordBatch.from_arrays([pa.array([order], pa.int32())], names=["order"])

    return rows


def _write_level(model: KneserNey):
    def rows(batches):
        for shard, kind, data, _ in blobs.blobs_in(batches):
            order = kind - COUNTED
            language, code, count = unpress(data, _GRAM)
            known = model.arrays(model.file(order + OF_COUNTS, 0))
            table = known["discounts"].reshape(-1, 4)
            off = table[np.searchsorted(known["languages"], language), np.minimum(count, 3)]
            gram, context = _places(language, code, order)
            contexts, of = np.unique(context, return_inverse=True)
            total = np.bincount(of, count, len(contexts))
            by = np.argsort(gram)
            alpha = (count - off) / total[of]
            arrays = {"grams": gram[by], "alpha": alpha[by].astype(np.float32), "contexts": contexts, "left": (np.bincount(of, off, len(contexts)) / total).astype(np.float32)}
            save(model.file(order, shard), arrays)
            yield pa.RecordBatch.from_arrays([pa.array([len(code)], pa.int64())], names=["grams"])

    return rows


def _language(lang_col: str) -> Column:
    return F.xxhash64(F.col(lang_col).cast("string"))


def fit_perplexity(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> KneserNey:
    """Counted over every document, for each language."""
    n = blobs.shards(docs.sparkSession)
    model = KneserNey(shared_folder(docs, "ngrams"), n)
    texts = docs.select(_language(lang_col).alias("language"), F.col(text_col).cast("binary").alias("text"))
    found = texts.mapInArrow(_count(n), blobs.ROWS)
    levels = []
    for order in range(ORDER, 0, -1):
        levels.append(blobs.cut(blobs.exchange(found, n).mapInArrow(_lower(order, n), blobs.ROWS)))
        found = levels[-1].where(F.col("kind") == COUNTED + order - 1)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionAll(level)
    # a row a shard, language and order at most: the counts of counts
    blobs.exchange(every.where(F.col("kind") > OF_COUNTS), n).mapInArrow(_write_discounts(model), "order int").agg(F.count("*")).first()
    for order, level in zip(range(ORDER, 0, -1), levels):
        level.where(F.col("kind") == COUNTED + order).mapInArrow(_write_level(model), "grams long").agg(F.sum("grams")).first()
    return model


def bands(scored: DataFrame, lang_col: str, doubt: float) -> DataFrame:
    """(_of, _middle, _far, _near): of each language the median of log perplexity, and what its spread is made of."""
    passed = scored.where(~F.col("base_failed") & (F.col("n_scored") > 0))
    length = F.floor(F.log2("n_scored")).cast("int")
    bins = passed.groupBy(F.col(lang_col).alias("_of"), length.alias("_length"), F.floor(F.col("log_perplexity") / STEP).alias("_bin"))
    bins = blobs.cut(bins.agg(F.count("*").alias("_n"), F.sum(1 / F.col("n_scored")).alias("_inverse")))

    def quantiles(parts: list[str], table: DataFrame, **wanted: float) -> DataFrame:
        by = Window.partitionBy(*parts)
        upto = F.sum("_n").over(by.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ranked = table.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(by))
        each = [F.min(F.when(F.col("_upto") >= q * F.col("_all"), F.col("_bin"))).alias(name) for name, q in wanted.items()]
        return ranked.groupBy(*parts).agg(*each, F.sum("_n").alias("_n"), *([F.sum("_inverse").alias("_inverse")] if "_inverse" in table.columns else []))

    middle = quantiles(["_of"], bins.groupBy("_of", "_bin").agg(F.sum("_n").alias("_n")), _median=0.5)
    x, y = F.col("_inverse") / F.col("_n"), F.pow((F.col("_high") - F.col("_low") + 1) * STEP, 2)
    # squared spreads against 1 / n, each weighing as exactly as it is known
    w = F.col("_n") / (x * x)
    sums = quantiles(["_of", "_length"], bins, _low=0.25, _high=0.75).groupBy("_of").agg(*(F.sum(e).alias(a) for e, a in ((w, "s0"), (w * x, "s1"), (w * x * x, "s2"), (w * y, "t0"), (w * x * y, "t1"))))
    det = F.expr("s0 * s2 - s1 * s1")
    level = det > 1e-9 * F.expr("s0 * s2")
    far, near = F.when(level, F.expr("t0 * s2 - t1 * s1") / det).otherwise(0.0), F.when(level, F.expr("s0 * t1 - s1 * t0") / det).otherwise(F.expr("t1 / s2"))
    sums = sums.select("_of", F.when(near < 0, F.expr("t0 / s0")).otherwise(F.greatest(far, F.lit(0.0))).alias("_far"), F.when(far < 0, F.expr("t1 / s2")).otherwise(near).alias("_near"))
    sums = sums.withColumn("_near", F.greatest("_near", F.lit(doubt * doubt)))
    middle = middle.select(F.col("_of").alias("_of2"), ((F.col("_median") + 0.5) * STEP).alias("_middle"))
    return sums.join(middle, F.col("_of").eqNullSafe(F.col("_of2"))).drop("_of2")


def quality(docs: DataFrame, model: KneserNey | None = None, *, widths: float = 2.0, doubt: float = 0.8, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without ``text_col``, with the base rules' counts, n_scored (symbols), log_perplexity, kept, and the band that decided.

    widths: half of the band, in spreads between the quartiles. doubt: the least such spread of one symbol,
    which languages of a few documents have.
    """
    made = T.StructType.fromDDL(FIELDS + ", n_scored long, log_perplexity double")
    results = {*made.names, "kept", "band_low", "band_high"}
    others = [c for c in docs.columns if c not in results | {text_col}]
    model = model or fit_perplexity(docs, text_col=text_col, lang_col=lang_col)
    carried = ["_tp_lang", *(f"_tp_c{i}" for i in range(len(others)))]  # the caller's columns, by names that no name here equals
    schema = T.StructType([T.StructField("_tp_lang", T.StringType()), *(T.StructField(n, docs.schema[c].dataType) for n, c in zip(carried[1:], others)), *made])

    def run(batches):
        for batch in batches:
            languages = batch.column(0).to_numpy(zero_copy_only=False).view(U)
            for rows, flat, offsets in chunks(batch, 1):
                m = measures(flat, offsets)
                s, begins = symbols(flat, offsets)
                size = np.diff(begins)
                loss = np.zeros(len(size))
                for doc, code in codes(s, begins):
                    for language, at in _by_language(languages[rows], doc):
                        back, distinct = pd.factorize(code[at])
                        loss -= np.bincount(doc[at], model.score(language, distinct)[back], len(size))
                loss /= np.maximum(size, 1)
                part = batch.slice(rows.start, rows.stop - rows.start)
                counts = [pa.array(m[f.name].astype(np.int64)) for f in made.fields[:5]]
                yield pa.RecordBatch.from_arrays([*(part.column(2 + i) for i in range(len(carried))), *counts, pa.array(m["base_failed"]), pa.array(size), pa.array(loss)], names=schema.names)

    whole = docs.select(_language(lang_col).alias("_tp_language"), F.col(text_col).cast("binary").alias("_tp_text"), F.col(lang_col).cast("string").alias("_tp_lang"), *(F.col(f"`{c}`").alias(n) for n, c in zip(carried[1:], others)))
    scored = blobs.cut(whole.mapInArrow(run, schema))
    joined = scored.join(bands(scored, "_tp_lang", doubt), F.col("_tp_lang").eqNullSafe(F.col("_of")), "left")
    half = widths * F.sqrt(F.col("_far") + F.col("_near") / F.greatest("n_scored", F.lit(1)))
    joined = joined.withColumn("band_low", F.col("_middle") - half).withColumn("band_high", F.col("_middle") + half)
    verdict = F.coalesce(F.col("log_perplexity").between(F.col("band_low"), F.col("band_high")), F.lit(True))
    shown = [F.col(n).alias(c) for n, c in zip(carried[1:], others)]
    return joined.select(*shown, *made.names, "band_low", "band_high", (~F.col("base_failed") & verdict).alias("kept"))

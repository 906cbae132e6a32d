"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

A lexicon of terms and term beginnings is counted over labelled documents;
trees then see its densities beside second-person proximity, capitals,
punctuation and obfuscation rates. Each labelled row's lexicon features come
from a lexicon of the other folds, and the calibration from trees of the other
folds, so neither sees its own label.

The fit takes at most ``MOST_ROWS`` labelled rows (chosen by a hash of the id),
the documented bound of what reaches the driver; scoring is one pass over all
texts without a shuffle.

Defined results: null and empty texts are scored as texts without words; rows
of ``labels`` with a null id or label are left out, repeated ones count as
toxic if any is; without labels of both kinds every score is the share of
toxic rows (0 without labels); rows with a null id are scored and not held
out; input columns named like results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import FOLD, Prefixes, U, chunks, mix

#: Labelled rows that the fit takes at most, on average over hashes of ids.
MOST_ROWS = 30_000
FOLDS = 3
#: Lengths in bytes of term beginnings that the lexicon holds, beside whole terms.
BEGINNINGS = (4, 5, 6, 7)
#: Second-person words of the four languages.
SECOND_PERSON = "you your yours yourself u ur tu te ti tus usted ustedes vosotros vous toi ton votre vos du dich dir dein deine ihr euch euer sie".split()
NEAR = 5
BANDS = (1.0, 2.0, 3.0)  # log-odds from which terms count to a band's density

_TERM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _TERM[_a:_b] = True
_LETTER = _TERM.copy()
_LETTER[48:58] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _kinds(flat: np.ndarray, offsets: np.ndarray):
    """Terms (runs of letters, digits and bytes of longer code points), lower-cased: starts, ends, documents, and hashes by kind."""
    term = _TERM[flat]
    opens = term.copy()
    opens[1:] &= ~term[:-1]
    inside = offsets[:-1][offsets[:-1] < len(flat)]
    opens[inside] = term[inside]
    start = np.flatnonzero(opens)
    after = ~term
    bound = np.append(np.flatnonzero(after | np.append(False, opens[1:] & term[:-1])), len(flat)) if len(flat) else np.zeros(1, np.int64)
    end = bound[np.searchsorted(bound, start, "right")] if len(start) else start
    doc = np.searchsorted(offsets, start, "right") - 1
    hashes = Prefixes(FOLD[flat]) if len(flat) else None
    kinds = []
    if len(start):
        kinds.append((hashes(start, end), np.arange(len(start))))
        for k in BEGINNINGS:
            at = np.flatnonzero(end - start > k)
            kinds.append((mix(hashes(start[at], start[at] + k) ^ U(k)), at))
    return start, end, doc, kinds


@dataclass
class Lexicon:
    """Log-odds by hash, found through a bitmap of the upper 18 bits first."""

    hashes: np.ndarray
    weights: np.ndarray
    bitmap: np.ndarray = field(init=False)

    def __post_init__(self):
        order = np.argsort(self.hashes)
        self.hashes, self.weights = self.hashes[order], self.weights[order]
        self.bitmap = np.zeros(1 << 18, bool)
        self.bitmap[self.hashes >> U(46)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` of what the lexicon has, and their weights."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.flatnonzero(self.bitmap[h >> U(46)])
        where = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        hit = self.hashes[where] == h[at]
        return at[hit], self.weights[where[hit]]


def _hash_of(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    bound = np.cumsum([0, *map(len, data)])
    return Prefixes(np.frombuffer(b"".join(data), np.uint8))(bound[:-1], bound[1:])


def features(flat: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of dense features per document."""
    n = len(offsets) - 1
    start, end, doc, kinds = _kinds(flat, offsets)
    size = np.diff(offsets).astype(float)
    terms = np.bincount(doc, minlength=n).astype(float) if len(start) else np.zeros(n)
    per_term, per_byte = 1 / np.maximum(terms, 1), 1 / np.maximum(size, 1)
    weight = np.zeros(len(start))
    for h, at in kinds:
        hit, w = lexicon.find(h)
        np.maximum.at(weight, at[hit], w)
    you = np.zeros(len(start) + 1, np.int64)
    if len(start):
        second = np.isin(kinds[0][0], _hash_of(SECOND_PERSON))
        you[1:] = np.cumsum(second)
    out = []
    count = lambda mask, values=None: np.bincount(doc[mask], weights=None if values is None else values[mask], minlength=n).astype(float) if len(start) else np.zeros(n)
    for band in BANDS:
        hits = count(weight >= band)
        out += [hits, hits * per_term]
    most = np.zeros(n)
    if len(start):
        np.maximum.at(most, doc, weight)
    out += [most, count(weight > 0, weight) * per_term]
    near = np.zeros(len(start), bool)
    if len(start):
        at = np.flatnonzero(weight >= BANDS[0])
        first = np.searchsorted(doc, np.arange(n + 1))  # of each document's terms: neighbours in a batch don't count
        lo, hi = np.maximum(at - NEAR, first[doc[at]]), np.minimum(at + NEAR + 1, first[doc[at] + 1])
        near[at] = you[hi] - you[lo] > 0
        out.append(count(near))
        out.append(count(second) * per_term)
    else:
        out += [np.zeros(n)] * 2
    total = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[offsets]).astype(float)
    term, upper, digit, space = _TERM[flat], _UPPER[flat], _DIGIT[flat], _SPACE[flat]
    letter = _LETTER[flat]
    out += [total(upper) * per_byte, total(digit) * per_byte, total(~term & ~space) * per_byte, total(flat == 33) * per_byte, total(flat == 63) * per_byte]
    # obfuscation: a sign or digit between two letters, and a byte three times over
    odd = np.zeros(len(flat), bool)
    if len(flat) > 2:
        odd[1:-1] = letter[:-2] & letter[2:] & ~letter[1:-1] & ~space[1:-1]
    inside_of = lambda places: places[(places >= 0) & (places < len(flat))]
    odd[inside_of(np.concatenate([offsets[:-1], offsets[1:] - 1]))] = False  # what stands in another document is no neighbour
    out.append(total(odd) * per_byte)
    thrice = np.zeros(len(flat), bool)
    if len(flat) > 2:
        thrice[2:] = letter[2:] & (flat[2:] == flat[1:-1]) & (flat[2:] == flat[:-2])
    thrice[inside_of(np.concatenate([offsets[:-1], offsets[:-1] + 1]))] = False
    out.append(total(thrice) * per_byte)
    capitals = np.diff(np.concatenate([[0], np.cumsum(upper)])[np.stack([start, end])], axis=0)[0] if len(start) else np.zeros(0)
    out.append(count((capitals > 1) & (capitals == end - start)) * per_term)
    out += [np.log1p(terms), size / np.maximum(terms, 1)]
    return np.nan_to_num(np.stack(out, axis=1)) if n else np.zeros((0, len(out)))


class Boosted:
    """Gradient-boosted trees for the logistic loss, on features in quantile bins."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        rows, columns = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(columns)]
        for j in range(columns):  # most rows may share a value; bins of what is above it too
            above = x[:, j][x[:, j] > np.median(x[:, j])]
            if len(self.edges[j]) < self.bins // 2 and len(above):
                self.edges[j] = np.unique(np.append(self.edges[j], np.quantile(above, np.linspace(0, 1, self.bins // 2 + 1)[:-1]) - 1e-9))
        binned = self._bin(x)
        width = max(len(e) for e in self.edges) + 1
        self.base = float(np.log((y.sum() + 1) / (rows - y.sum() + 1)))
        score = np.full(rows, self.base)
        self.nodes = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node, tree = np.zeros(rows, np.int64), []
            for d in range(self.depth):
                parts, at = 1 << d, node * width
                gains = []
                for j in range(columns):
                    k = at + binned[:, j]
                    gs = np.cumsum(np.bincount(k, g, parts * width).reshape(parts, width), axis=1)
                    hs = np.cumsum(np.bincount(k, h, parts * width).reshape(parts, width), axis=1)
                    G, H = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (G - gs) ** 2 / (H - hs + self.l2) - G**2 / (H + self.l2)
                    gain[(hs < 0.5) | (H - hs < 0.5)] = 0
                    gains.append(gain)
                gains = np.stack(gains, axis=1).reshape(parts, -1)
                best = gains.argmax(axis=1)
                feature, edge = best // width, best % width
                edge = np.where(gains[np.arange(parts), best] > 1e-6, edge, width)
                tree.append((feature, edge))
                node = 2 * node + (binned[np.arange(rows), feature[node]] > edge[node])
            G, H = np.bincount(node, g, 1 << self.depth), np.bincount(node, h, 1 << self.depth)
            leaf = -self.rate * G / (H + self.l2)
            score += leaf[node]
            self.nodes.append((tree, leaf))
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self._bin(x), np.arange(len(x))
        score = np.full(len(x), self.base)
        for tree, leaf in self.nodes:
            node = np.zeros(len(x), np.int64)
            for feature, edge in tree:
                node = 2 * node + (binned[rows, feature[node]] > edge[node])
            score += leaf[node]
        return score


class Isotonic:
    """Pool-adjacent-violators fit, read by interpolation between the blocks' means."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        blocks: list[list[float]] = []
        for value, target in zip(x[order].tolist(), y[order].tolist()):
            blocks.append([value, target, 1.0])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
                last = blocks.pop()
                blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
        # half a row of doubt in each block keeps the order of what a block pools at the ends
        self.x = np.array([b[0] / b[2] for b in blocks])
        self.y = np.maximum.accumulate([(b[1] + 0.5 * y.mean()) / (b[2] + 0.5) for b in blocks])
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        inner = np.interp(x, self.x, self.y)
        return np.clip(inner + 1e-6 * np.tanh(x / 10), 0.0, 1.0)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted | None
    calibration: Isotonic | None
    share: float

    def score(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offsets) - 1, self.share)
        return self.calibration(self.trees.margin(features(flat, offsets, self.lexicon)))


def _lexicon(counts: np.ndarray, toxic: int, clean: int) -> Lexicon:
    """From (hash, toxic, clean) document counts: what is much likelier in toxic documents."""
    t, c = counts["toxic"].astype(float), counts["clean"].astype(float)
    odds = np.log((t + 0.3) / (toxic + 1)) - np.log((c + 0.3) / (clean + 1)) - 0.5 / np.sqrt(t + 0.3)
    keep = (t >= max(3, 0.002 * toxic)) & (odds >= BANDS[0])
    return Lexicon(counts["hash"][keep], odds[keep])


def is_held_out(id_col, folds: int = 5):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS) -> Model:
    """Fit on the rows of ``labels`` that aren't held out (crc32 of the id modulo 5 is not 0)."""
    ids = F.col(id_col).cast("long")
    known = labels.select(ids.alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    known = known.groupBy("id").agg(F.max(F.least(F.greatest("toxic", F.lit(0)), F.lit(1))).alias("toxic")).where(~is_held_out("id"))
    rows = known.count()
    if rows > most_rows:
        known = known.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(rows)) < most_rows)
    known = known.withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    texts = docs.select(ids.alias("id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(known), "id").select("toxic", "fold", "text")

    def count(batches):
        for batch in batches:
            label, fold = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows, flat, offsets in chunks(batch, 2):
                _, _, doc, kinds = _kinds(flat, offsets)
                if not kinds:
                    continue
                h = np.concatenate([x for x, _ in kinds])
                d = np.concatenate([doc[at] for _, at in kinds])
                order = np.lexsort((h, d))
                h, d = h[order], d[order]
                new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
                h, group = h[new], fold[rows][d[new]] * 2 + label[rows][d[new]]
                u, back = np.unique(h, return_inverse=True)
                table = np.bincount(back * 2 * FOLDS + group, minlength=len(u) * 2 * FOLDS).reshape(len(u), -1)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), *(pa.array(table[:, i]) for i in range(2 * FOLDS))], names=["hash", *(f"n{i}" for i in range(2 * FOLDS))])

    groups = [f"n{i}" for i in range(2 * FOLDS)]
    counted = texts.mapInArrow(count, "hash long, " + ", ".join(f"{g} long" for g in groups)).groupBy("hash").agg(*(F.sum(g).alias(g) for g in groups))
    # at most the terms of the bounded sample; what can't enter a lexicon, whatever the share of toxic labels, stays behind
    found = counted.where(sum((F.col(g) for g in groups[1::2]), F.lit(0)) >= 3).toPandas()
    totals = {(r["fold"], r["toxic"]): r["n"] for r in texts.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = (sum(v for k, v in totals.items() if k[1] == t) for t in (1, 0))
    if n1 < 2 or n0 < 2:
        return Model(Lexicon(np.zeros(0, U), np.zeros(0)), None, None, n1 / max(1, n0 + n1))

    def of(folds):
        counts = np.zeros(len(found), [("hash", U), ("toxic", np.int64), ("clean", np.int64)])
        counts["hash"] = found["hash"].to_numpy().view(U)
        counts["toxic"], counts["clean"] = (found[[f"n{2 * f + t}" for f in folds]].sum(axis=1).to_numpy() for t in (1, 0))
        return _lexicon(counts, *(sum(totals.get((f, t), 0) for f in folds) for t in (1, 0)))

    others = [of([f for f in range(FOLDS) if f != k]) for k in range(FOLDS)]

    def dense(batches):
        for batch in batches:
            label, fold = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows, flat, offsets in chunks(batch, 2):
                each = [features(flat, offsets, x) for x in others]
                x = np.stack(each)[fold[rows], np.arange(len(offsets) - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(label[rows]), pa.array(fold[rows]), pa.array(list(x.astype(np.float64)), pa.list_(pa.float64()))], names=["toxic", "fold", "x"])

    seen = texts.mapInArrow(dense, "toxic int, fold int, x array<double>").toPandas()
    x, y, fold = np.array(seen["x"].tolist()), seen["toxic"].to_numpy().astype(float), seen["fold"].to_numpy()
    order = np.lexsort((*x.T, y, fold))  # the fit doesn't depend on the order in which rows arrive
    x, y, fold = x[order], y[order], fold[order]
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any():
            margin[fold == k] = Boosted().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Model(of(range(FOLDS)), Boosted().fit(x, y), Isotonic().fit(margin, y), n1 / (n0 + n1))


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 from 0.5 on)."""
    made = T.StructType.fromDDL("held_out boolean, score double, predicted int")
    others = [c for c in docs.columns if c not in made.names]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    whole = docs.select(F.coalesce(is_held_out(id_col), F.lit(False)).alias("_tp_held"), F.col(text_col).cast("binary").alias("_tp_text"), *others)
    schema = T.StructType([*(docs.schema[c] for c in others), *made])

    def score(batches):
        for batch in batches:
            for rows, flat, offsets in chunks(batch, 1):
                s = shared.value.score(flat, offsets)
                part = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([*(part.column(2 + i) for i in range(len(others))), part.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return whole.mapInArrow(score, schema)

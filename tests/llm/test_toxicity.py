"""The parts of the toxicity classifier against plain versions of themselves."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm.hashing import U, mix
from tidepool.llm.toxicity import BANDS, BEGINNINGS, NEAR, SECOND_PERSON, Boosted, Isotonic, Lexicon, _hash_of, features, fit_toxicity, score_toxicity


def plain_terms(data: bytes):
    """Runs of letters, digits and bytes from 0x80 on."""
    out, at = [], None
    for i, b in enumerate(data + b" "):
        term = chr(b).isalnum() if b < 128 else True
        if term and at is None:
            at = i
        elif not term and at is not None:
            out.append(data[at:i])
            at = None
    return out


def plain_features(data: bytes, whole: dict[bytes, float], begin: dict[bytes, float]):
    terms = plain_terms(data)
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in t) for t in terms]
    n, size = len(terms), len(data)
    weight = [max([0.0, whole.get(t, 0.0), *(begin.get(t[:k], 0.0) for k in BEGINNINGS if len(t) > k)]) for t in low]
    you = [t.decode(errors="replace") in SECOND_PERSON for t in low]
    per, part = 1 / max(n, 1), 1 / max(size, 1)
    out = []
    for band in BANDS:
        hits = sum(w >= band for w in weight)
        out += [hits, hits * per]
    out += [max(weight, default=0), sum(w for w in weight if w > 0) * per]
    out.append(sum(w >= BANDS[0] and any(you[max(0, i - NEAR) : i + NEAR + 1]) for i, w in enumerate(weight)))
    out.append(sum(you) * per)
    upper = [65 <= b <= 90 for b in data]
    letter = [65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in data]
    digit, space = [48 <= b <= 57 for b in data], [b in (9, 10, 11, 12, 13, 32) for b in data]
    out += [sum(upper) * part, sum(digit) * part, sum(not x and not d and not s for x, d, s in zip(letter, digit, space)) * part, data.count(33) * part, data.count(63) * part]
    out.append(sum(letter[i - 1] and letter[i + 1] and not letter[i] and not space[i] for i in range(1, size - 1)) * part)
    out.append(sum(letter[i] and data[i] == data[i - 1] == data[i - 2] for i in range(2, size)) * part)
    out.append(sum(len(t) > 1 and all(65 <= b <= 90 for b in t) for t in terms) * per)
    return [*out, math.log1p(n), size / max(n, 1)]


def test_features_equal_plain_ones():
    whole, begin = {b"blorg": 2.5, b"snurf": 1.2, "größe".encode(): 3.5}, {b"blor": 1.5, b"uglyx": 0.5, b"snurfle": 3.2}
    hashes = [*_hash_of([t.decode() for t in whole]), *(mix(_hash_of([t.decode()]) ^ U(len(t)))[0] for t in begin)]
    lexicon = Lexicon(np.array(hashes, U), np.array([*whole.values(), *begin.values()]))
    rng = random.Random(9)
    parts = ["blorg", "BLORGISH", "snurfled", "you", "Your", "du", "größe", "a", "X", "st.op", "w0rd", "b-l-o", "sooo", "!!", "?", " ", "  ", "\n", "123", "ÀÉ", "uglyxs", "tu"]
    texts = ["", "you", "!!!", "blorg"] + ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(60))) for _ in range(200)]
    data = [t.encode() for t in texts]
    got = features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), lexicon)
    for i, d in enumerate(data):
        assert got[i] == pytest.approx(plain_features(d, whole, begin)), texts[i]


def plain_boosting(x, y, trees, depth, rate, edges, l2):
    """One row and one split at a time; of equal gains the first feature and edge."""
    rows = range(len(y))
    place = [[sum(e < x[i][j] for e in edges[j]) for j in range(len(edges))] for i in rows]
    base = math.log((sum(y) + 1) / (len(y) - sum(y) + 1))
    score, model = [base] * len(y), []
    width = max(map(len, edges)) + 1
    for _ in range(trees):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g, h = [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]
        node, tree = [0] * len(y), []
        for d in range(depth):
            splits = []
            for k in range(1 << d):
                mine = [i for i in rows if node[i] == k]
                G, H = sum(g[i] for i in mine), sum(h[i] for i in mine)
                best = (0.0, 0, 0)
                for j in range(len(edges)):
                    for e in range(width):
                        gs, hs = sum(g[i] for i in mine if place[i][j] <= e), sum(h[i] for i in mine if place[i][j] <= e)
                        if hs >= 0.5 and H - hs >= 0.5:
                            gain = gs**2 / (hs + l2) + (G - gs) ** 2 / (H - hs + l2) - G**2 / (H + l2)
                            if gain > best[0] + 1e-12:
                                best = (gain, j, e)
                splits.append((best[1], best[2] if best[0] > 1e-6 else width))
            tree.append(splits)
            node = [2 * node[i] + (place[i][splits[node[i]][0]] > splits[node[i]][1]) for i in rows]
        leaf = []
        for k in range(1 << depth):
            mine = [i for i in rows if node[i] == k]
            leaf.append(-rate * sum(g[i] for i in mine) / (sum(h[i] for i in mine) + l2))
        score = [s + leaf[node[i]] for i, s in enumerate(score)]
        model.append((tree, leaf))
    return score


def test_trees_equal_plain_ones():
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(120, 3)), 1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0.4)).astype(float)
    m = Boosted(trees=6, depth=2, bins=8).fit(x, y)
    want = plain_boosting(x.tolist(), y.tolist(), 6, 2, m.rate, [e.tolist() for e in m.edges], m.l2)
    assert m.margin(x) == pytest.approx(want)


def test_calibration_equals_a_plain_one():
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=300), 1)  # with ties
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * x))).astype(float)
    order = np.argsort(x, kind="stable")
    blocks = [([v], [t]) for v, t in zip(x[order], y[order])]
    while True:  # pool any two neighbours that violate the order, until none do
        at = next((i for i in range(len(blocks) - 1) if np.mean(blocks[i][1]) >= np.mean(blocks[i + 1][1])), None)
        if at is None:
            break
        blocks[at : at + 2] = [(blocks[at][0] + blocks[at + 1][0], blocks[at][1] + blocks[at + 1][1])]
    iso = Isotonic().fit(x, y)
    assert iso.x == pytest.approx([np.mean(b[0]) for b in blocks])
    assert iso.y == pytest.approx(np.maximum.accumulate([(sum(b[1]) + 0.5 * y.mean()) / (len(b[1]) + 0.5) for b in blocks]))


def test_toxicity_of_no_rows_and_of_odd_ones(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    assert score_toxicity(docs, fit_toxicity(docs, labels)).collect() == []
    rows = [(i, "blorgs " * 5 if i % 2 else "fine words") for i in range(50)] + [(7, "blorgs again"), (7, "blorgs again"), (None, None), (60, ""), (61, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"predicted": F.lit("clash"), "toxic": F.lit(9), "fold": F.lit("f")})
    got = score_toxicity(docs, fit_toxicity(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.toxic == 9 for r in got)
    assert len({r.score for r in got if r.doc_id == 7}) <= 2

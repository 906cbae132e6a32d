from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm.mixing import mix_sources, mixed
from tidepool.llm.sentencepiece import MODEL, decode, encode, load
from tidepool.llm.token_counts import PATTERN, VOCABULARY, CountedText, count_tokens, vocabulary
from tidepool.llm.topk import top_k


def plain_targets(sizes, weights, cap=3.0):
    """Fill, clamp what is above its cap, and fill again with the rest."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    done, left = {}, float(sum(sizes.values()))
    free = set(names)
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > cap * sizes[s]}
        if not over:
            return done | {s: left * w[s] / total for s in free}
        for s in over:
            done[s] = cap * sizes[s]
        left -= sum(done[s] for s in over)
        free -= over
    return done


def test_mix(docs, texts):
    got = mix_sources(docs.withColumn("size", F.lit("clash"))).collect()
    by_id = lambda rows: sorted(rows, key=lambda r: r.doc_id)
    assert len(got) == len(texts) and by_id(got) == by_id(mix_sources(docs.repartition(5).withColumn("size", F.lit("clash"))).collect())
    sizes, taken, longest = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        longest[r.source] = max(longest.get(r.source, 0), r.size)
        assert r.taken <= 3 * r.size
    want = plain_targets(sizes, (5, 2, 1))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1
    copies = {r.doc_id: r["count"] for r in mixed(docs).groupBy("doc_id").count().collect()}
    assert copies == {r.doc_id: r.taken // r.size for r in got if r.taken}


def test_mix_of_rows_given_many_times(spark):
    rows = [(None, "a", "some ten words that are the same in every row")] * 1000 + [(7, "a", "x y z")] * 500 + [(i, "b", "one two") for i in range(9000)]
    rows += [(None, None, None), (None, "b", ""), (3, None, "a b")] + [(None, "b", f"w{i} w") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7)
    results = []
    for again in (df, df.repartition(4)):
        got = mix_sources(again).collect()
        taken, target = {}, {}
        for r in got:
            taken[r.source] = taken.get(r.source, 0) + r.taken
            target[r.source] = r.target
            assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        assert all(abs(taken[s] - target[s]) <= 6 for s in taken) and len(got) == len(rows)
        results.append(sorted((r.doc_id or -1, str(r.source), r.size, r.taken) for r in got))
    assert results[0] == results[1]


def test_mix_of_no_rows(empty):
    assert mix_sources(empty).collect() == [] and mixed(empty).collect() == []


def plain_viterbi(pieces, text):
    """Over whole texts, without units or batches."""
    s = (b" " if pieces.dummy else b"") + text if text else b""
    best, back = [0.0] + [-np.inf] * len(s), [None] * (len(s) + 1)
    for i in range(len(s)):
        if s[i] & 0xC0 == 0x80:
            continue
        size, alone = 1 if s[i] < 0x80 else 2 if s[i] < 0xE0 else 3 if s[i] < 0xF0 else 4, False
        for j in range(i + 1, min(len(s), i + pieces.longest) + 1):
            if found := pieces.by_key.get(s[i:j]):
                alone |= j == i + size
                if best[i] + found[0] > best[j]:
                    best[j], back[j] = best[i] + found[0], (i, [found[1]])
        if not alone and best[i] + pieces.penalty > best[i + size]:
            best[i + size], back[i + size] = best[i] + pieces.penalty, (i, [int(pieces.bytes[b]) for b in s[i : i + size]])
    out, j = [], len(s)
    while j:
        j, ids = back[j]
        out = ids + out
    return out


def test_sentencepiece(docs, texts):
    rng = random.Random(8)
    odd = [(800, "日本語 ☃ \U0001f600"), (801, "▁mark ▁"), (802, "   lead and trail  "), (803, "x" * 500), (804, "tab\tnew\nline"), (805, ""), (806, " ")]
    odd += [(810 + i, "".join(rng.choice("日本語東京都☃ñthestion\U0001f600▁") for _ in range(100 + 7 * i))) for i in range(40)]
    odd += [(860 + i, "".join(chr(rng.randrange(97, 123)) for _ in range(130 + i % 9))) for i in range(30)] + [(899, "".join(chr(rng.randrange(33, 127)) for _ in range(5000)))]
    df = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(odd, "doc_id long, text string"))
    there = decode(encode(df.withColumn("pieces", F.lit(1)))).collect()
    pieces = load(MODEL)
    for r in there:
        assert r.decoded == (None if r.text is None else bytearray(r.text.encode()))
        if r.text is not None:
            assert r.pieces == plain_viterbi(pieces, r.text.encode()), r.doc_id
    assert len(there) == len(texts) + len(odd)


def test_sentencepiece_of_no_rows_and_of_unknown_ids(spark, empty):
    assert decode(encode(empty)).collect() == []
    odd = spark.createDataFrame([(1, [5, -3, 10**8, None]), (2, None), (3, [])], "doc_id long, pieces array<int>")
    one = decode(spark.createDataFrame([(1, [5])], "doc_id long, pieces array<int>")).first().decoded
    assert {r.doc_id: r.decoded for r in decode(odd).collect()} == {1: one, 2: None, 3: bytearray()}


def test_token_counts_follow_edits():
    counter = vocabulary(VOCABULARY, PATTERN)
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "a", "the", "'s", "'", "9", "!", "é", "\t", " x", "word"]
    for round_ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 900 if round_ % 3 == 0 else 60)))
        counted = CountedText(text, counter)
        for _ in range(4):
            a = rng.randrange(0, len(text) + 2)
            b, new = a + rng.randrange(0, 12), "".join(rng.choice(parts) for _ in range(rng.randrange(0, 6)))
            counted.edit(a, b, new)
            text = text[: min(a, len(text))] + new + text[min(b, len(text)) :]
            assert counted.text() == text and counted.total == len(counter.encoding.encode_ordinary(text))
            assert [p for b in counted.each() for p in b.pieces()] == counter.pattern.findall(text)
            if rng.random() < 0.2:
                counted = CountedText(text, counter, counted.tree())
                assert counted.recounted == 0


def test_edits_recount_little():
    counter = vocabulary(VOCABULARY, PATTERN)
    counted = CountedText("some words here and there " * 2000, counter)
    before = counted.recounted
    counted.edit(20_000, 20_005, "other")
    assert counted.recounted - before < 50
    # blocks come and go along single paths, and the tree stays shallow
    for k in range(200):
        counted.edit(3000 * (k % 30), 3000 * (k % 30) + (2500 if k % 3 else 0), "put in here " * (250 if k % 2 else 1))

    def depth(node):
        return 1 + max(depth(node.left), depth(node.right)) if node else 0

    assert depth(counted.root) < 5 * counted.blocks.bit_length() and counted.total == len(counter.encoding.encode_ordinary(counted.text()))


def test_count_tokens(docs, texts):
    counter = vocabulary(VOCABULARY, PATTERN)
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs).collect()}
    assert got == {d: len(counter.encoding.encode_ordinary(t or "")) for d, t in texts}
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("New").alias("replacement")), F.lit(None))
    after = {r.doc_id: r.n_tokens_after for r in count_tokens(docs.withColumn("e", edits), "e").collect()}
    assert after == {d: len(counter.encoding.encode_ordinary("New" + (t or "")[3:])) for d, t in texts}
    assert count_tokens(docs.where("false")).collect() == []
    # trees that are kept: the next edits count little, whatever the text's length, and a tree of another text is made anew
    kept = count_tokens(docs.withColumn("n_tokens", F.lit("clash")).withColumn("e", edits), "e", keep=True).drop("text").withColumnRenamed("text_after", "text")
    again = count_tokens(kept.withColumn("t", F.col("tree_after")), "e", tree="t").collect()
    assert {r.doc_id: (r.n_tokens, r.n_tokens_after) for r in again} == {d: (after[d], len(counter.encoding.encode_ordinary("New" + ("New" + (t or "")[3:])[3:]))) for d, t in texts}
    assert max(r.n_recounted for r in again) < 200
    wrong = count_tokens(kept.withColumn("text", F.lit("other")).withColumn("t", F.col("tree_after")), "e", tree="t").collect()
    assert {r.n_tokens for r in wrong} == {len(counter.encoding.encode_ordinary("other"))}


def plain_top_k(rows, k):
    ok = [(i, [math.floor(64 * v) for v in x]) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(x).all()]
    want = {}
    for n, (i, x) in enumerate(ok):
        if i % 20 == 0:
            score = lambda y: min(max(sum(a * b for a, b in zip(x, y)), -(2**63)), 2**63 - 1)  # noqa: E731, B023
            found = sorted((-score(y), j) for m, (j, y) in enumerate(ok) if m != n and len(y) == len(x))[:k]
            want.setdefault(i, []).extend((r + 1, j, -s) for r, (s, j) in enumerate(found))
    return {q: sorted(v) for q, v in want.items() if v}


def top_k_of(df, **options):
    got = {}
    for r in top_k(df, **options).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in got.items()}


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(rng.normal(size=(400, 16)))]
    rows += [(400, rows[0][1]), (20, rows[1][1]), (500, None), (501, [1.0, None]), (502, [float("nan")] * 16), (None, rows[2][1]), (503, [1e30, 1.0]), (520, [3.0, 4.0]), (540, [])]
    rows += [(600 + i, x.tolist()) for i, x in enumerate(rng.normal(size=(40, 16)) * 10.0 ** rng.integers(0, 40, (40, 1)))]
    rows += [(700, [1.0, 1.0]), (701, [1e12, 1.0]), (702, [2e12, 1.0]), (703, [-1e200, 1e200]), (720, [1e200, -3.0]), (740, []), (760, [2.5]), (761, [-4.0])]
    assert top_k_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=7) == plain_top_k(rows, 7)
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_top_k_beyond_what_doubles_hold(spark):
    rows = [(0, [1.0, 1.0]), (1, [1e12, 1.0]), (2, [2e12, 1.0])]
    assert top_k_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == {0: [(1, 2, 8192000000004096), (2, 1, 4096000000004096)]}


def test_top_k_resolves_few_pairs(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 16)) * rng.pareto(2, (6000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    counters = {}
    got = top_k_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6), k=10, counters=counters)
    q, c = np.floor(64 * x[::20]).astype(np.int64), np.floor(64 * x).astype(np.int64)
    score = q @ c.T
    score[np.arange(300), np.arange(0, 6000, 20)] = -(2**62)
    want = {}
    for i, row in enumerate(score):
        order = np.lexsort((np.arange(6000), -row))[:10]
        want[20 * i] = [(r + 1, int(j), int(row[j])) for r, j in enumerate(order)]
    assert got == want
    assert counters["pairs"].value == 300 * 6000 and counters["resolved"].value < 0.05 * counters["pairs"].value
    assert counters["products"].value < 0.9 * 300 * 6000 * 16


def test_top_k_saves_products_without_structure(spark):
    """Vectors of one length in any direction: what is left of most pairs is too little after three quarters."""
    x = np.random.default_rng(6).normal(size=(8000, 64))
    rows = [(i, (v / np.linalg.norm(v)).tolist(), float(v[0])) for i, v in enumerate(x)]
    counters = {}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double").repartition(6)
    got = top_k_of(df, k=20, counters=counters)
    assert got == plain_top_k_fast(rows, 20)
    assert counters["pairs"].value == 400 * 8000 and counters["products"].value < 0.99 * 400 * 8000 * 64


def plain_top_k_fast(rows, k):
    c = np.array([[math.floor(64 * v) for v in r[1]] for r in rows], np.int64)
    score = c[::20] @ c.T
    score[np.arange(len(score)), np.arange(0, len(c), 20)] = -(2**62)
    order = [np.lexsort((np.arange(len(c)), -row))[:k] for row in score]
    return {20 * i: [(r + 1, int(j), int(score[i, j])) for r, j in enumerate(o)] for i, o in enumerate(order)}


def test_pieces_are_looked_for_by_length_over_all_units(monkeypatch):
    import random

    import numpy as np

    from tidepool.llm import sentencepiece

    rng, pieces, calls = random.Random(9), sentencepiece.load(sentencepiece.MODEL), []
    units = ["".join(rng.choices("abcdeéß世🙂1", k=n)) for n in range(1, 40) for _ in range(3)]
    parts = [u.encode() for u in units]
    probe = sentencepiece.Pieces.probe
    monkeypatch.setattr(sentencepiece.Pieces, "probe", lambda self, h: calls.append(len(h)) or probe(self, h))
    flat = np.frombuffer(b" ".join(parts), np.uint8)
    ids, _ = sentencepiece.Encoder(pieces).encode(flat, np.array([0, len(flat)]))
    assert len(calls) <= 3 * pieces.longest
    assert ids.tolist() == [i for p in parts for i in pieces.segment_one((b" " if pieces.dummy or p is not parts[0] else b"") + p)]

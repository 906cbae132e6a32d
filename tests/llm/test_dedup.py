from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepool.llm.components import components
from tidepool.llm.gsaca import common_prefixes, suffix_array
from tidepool.llm.jaccard_join import jaccard_components, jaccard_links
from tidepool.llm.substring_dedup import substring_dedup
from tidepool.llm.suffix_dedup import suffix_dedup


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60))
def test_suffix_array(symbols):
    order = suffix_array(np.array(symbols, np.int64)).tolist()
    assert order == sorted(range(len(symbols)), key=lambda i: symbols[i:])
    if symbols:
        lcp = common_prefixes(np.array(symbols), np.array(order), len(symbols) - np.arange(len(symbols)), 5)
        for k in range(1, len(order)):
            a, b = symbols[order[k - 1] :], symbols[order[k] :]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == min(same, 5)


def bytes_removed(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, bytes(x for x, y in zip(b, gone) if not y))
    return out


def words_removed(rows, length):
    seen, out = {}, {}
    for d, t in sorted(rows):
        w = (t or "").encode().split()
        gone = bytearray(len(w))
        for p in range(len(w) - length + 1):
            if seen.setdefault(tuple(w[p : p + length]), d) < d:
                gone[p : p + length] = b"\1" * length
        out[d] = (len(w), sum(gone), b" ".join(x for x, y in zip(w, gone) if not y))
    return out


@pytest.mark.parametrize("length", [100, 12])
def test_suffix_dedup_equals_brute_force(docs, texts, length):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(docs, length=length).collect()}
    want = bytes_removed(texts, length)
    assert got == want and sum(x[1] for x in want.values()) > 1000


def test_hot_anchors_are_split(docs, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(docs, length=30, together=1).collect()}
    assert got == bytes_removed(texts, 30)
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in substring_dedup(docs, length=6, together=1).collect()}
    assert got == words_removed(texts, 6)


@pytest.mark.parametrize("together", [4096, 1])
def test_suffix_dedup_of_rows_given_twice(docs, texts, together):
    got = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in suffix_dedup(docs.unionAll(docs).repartition(3), length=30, together=together).collect()]
    want = bytes_removed(texts, 30)
    assert sorted(got) == sorted(2 * list(want.items()))


@pytest.mark.parametrize("length", [50, 17, 4])
def test_substring_dedup_equals_brute_force(docs, texts, length):
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in substring_dedup(docs, length=length).collect()}
    want = words_removed(texts, length)
    assert got == want and sum(x[1] for x in want.values()) > 100


def test_cuts_of_whole_characters(spark):
    same = "\u0416" * 60
    rows = [(1, "x\ufffd " + same + "é"), (2, "\ufffdy \u0436" + same + "è \ufffd"), (3, "z\u0426" + same + "\u0426")]
    # the bytes of the second letters agree in part with what is cut
    got = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), whole_characters=True).collect()}
    cut = {d: x[3] for d, x in bytes_removed(rows, 100).items()}
    for d, t in rows:
        assert got[d] == cut[d].decode(errors="ignore") or len(got[d].encode()) <= len(cut[d])
    assert got[1].startswith("x\ufffd ") and got[2].startswith("\ufffdy ") and got[2].endswith(" \ufffd") and same not in got[2] + got[3]


def test_one_seed_extends_over_windows(spark):
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    rows = [(1, [*a, *b[:30]]), (2, [*c[:20], *a[20:], *b[:25], *c[20:]]), (3, [*b[10:25], *c[30:], *a[:49]])]
    rows = [(d, " ".join(w)) for d, w in rows]
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == words_removed(rows, 50) and [got[d][1] for d in (1, 2, 3)] == [0, 65, 0]


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def test_patterns_that_polynomials_take_for_equal(spark):
    one, other = "".join(thue_morse(2048, "a", "b")), "".join(thue_morse(2048, "b", "a"))
    rows = [(1, one), (2, other), (3, " ".join(thue_morse(2048, "xx", "yy"))), (4, " ".join(thue_morse(2048, "yy", "xx")) + " zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == components_by_pairs(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(docs).collect()}
    assert got == bytes_removed(rows, 100)
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in substring_dedup(docs).collect()}
    assert got == words_removed(rows, 50)


def test_dedup_of_no_rows_and_of_null_ids(spark, empty):
    assert suffix_dedup(empty).collect() == [] and substring_dedup(empty).collect() == []
    odd = spark.createDataFrame([(None, "word " * 200), (None, None), (1, "x")], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup(odd).collect()) == [0, 0, 0]
    assert sorted(r.n_words for r in substring_dedup(odd).collect()) == [0, 1, 200]


def components_by_pairs(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_jaccard_components_equal_all_pairs(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    want = components_by_pairs(texts)
    assert got == want and len({c for _, c in want.values()}) < len(want) - 10


def test_jaccard_links_equal_all_pairs(spark, docs, texts):
    sets = {}
    for d, t in texts:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    linked = {(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    least = {}
    for d in sorted(sets):
        least.setdefault(sets[d] or d, d)
    links, each = jaccard_links(docs)
    assert {(r.a, r.b) for r in links.collect()} == {(a, b) for a, b in linked if least[sets[a]] == a and least[sets[b]] == b and sets[a] != sets[b]}
    count = {d: sum(d in pair for pair in linked) for d in sets}
    assert {r.doc_id: (r.class_id, r.n_links) for r in each.collect()} == {d: (least[sets[d] or d], count[d]) for d in sets} and sum(count.values()) > 20
    links, each = jaccard_links(spark.createDataFrame([], "doc_id long, text string"))
    assert links.collect() == [] and each.collect() == []


def test_jaccard_of_no_rows_and_of_null_ids(spark, empty):
    assert jaccard_components(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (1, "A b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in jaccard_components(odd).collect()) == [(0, None), (1, 1), (2, 1)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).where(F.lit(True)).collect() == []


def test_rows_that_share_an_id(spark):
    same, other = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(5, same), (5, same), (5, other), (7, other), (8, None), (9, "ÄÖ " * 60_000), (3, same.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n_shingles", "component_id", "class_id", "id", "size", "near")})
    got = {(r.doc_id, r.n_shingles, r.class_id, r.component_id) for r in jaccard_components(df).collect()}
    assert {x[0] for x in got} == {3, 5, 7, 8, 9} and len(got) == 5  # one answer an id
    of = {x[0]: x for x in got}
    assert of[3] == (3, 2, 3, 3) and of[5][2:] == (3, 3) and of[8] == (8, 0, 8, 8) and of[9][3] == 9


def test_dedup_replaces_columns_of_its_results(spark):
    rows = [(1, "alpha beta " * 60), (2, "alpha beta " * 60), (2, "alpha beta " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n_bytes", "n_removed", "kept", "n_words", "n_spans")})
    bytes_, words = suffix_dedup(df).collect(), substring_dedup(df).collect()
    assert all(isinstance(r.n_removed, int) and r.n_words == "clash" for r in bytes_) and all(isinstance(r.n_words, int) and r.n_spans == "clash" for r in words)
    assert sorted(r.n_removed for r in words) == [0, 120, 120]


def test_jaccard_of_common_passages(spark):
    """Shingles that are common in one task and rare in another count the same in both."""
    import random

    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for c in range(25):
        base = [word() for _ in range(rng.choice([20, 40, 90]))]
        for k in range(rng.choice([1, 2, 9])):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = word()
            rows.append(passage[: rng.choice([0, 30, 60])] + own)
    rows += [passage + [word() for _ in range(rng.randrange(14))] for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    few, many = [r for r in rows if r[0] % 17 == 3], [r for r in rows if r[0] % 17 != 3]
    df = spark.createDataFrame(many, "doc_id long, text string").coalesce(1).unionAll(spark.createDataFrame(few, "doc_id long, text string").coalesce(1))
    want = components_by_pairs(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()} == want
    assert len({c for _, c in want.values()}) < len(rows) - 60
    for limits in ((0, 1), (0, 10**6)):  # all holders of a shingle together, by size and at once
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, limits=limits).collect()} == want


def test_jaccard_of_a_cluster_fetches_each_set_once(spark, monkeypatch):
    """Versions of one text that are mostly too different to link, all of which meet: their sets don't travel for each two of them."""
    import random

    from tidepool.llm import blobs
    from tidepool.llm import jaccard_join as join

    rng, base = random.Random(7), [f"w{i}" for i in range(200)]
    versions = [[f"x{d % 2}{i}" if rng.random() < 0.001 + d % 9 / 100 else w for i, w in enumerate(base)] for d in range(60)]
    rows = [(d, " ".join(w)) for d, w in enumerate(versions)] + [(60 + d, f"other text of its own {d} and nothing else") for d in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, sent = components_by_pairs(rows), []
    compared = join._Join.compared
    of = lambda r: [tuple(x) for x in zip(*(c.tolist() for c in blobs.unpack(bytes(r.data), join._FETCH)))]

    def counted(self, fetch):
        fetch = blobs.cut(fetch)
        sent.append({x[:2] for r in fetch.collect() for x in of(r) if x[2] >= join.MEETING})
        return compared(self, fetch)

    monkeypatch.setattr(join._Join, "compared", counted)
    for whole in (join.WHOLE, (8, 10**6), (10**6, 3000), None, (1, 1)):
        sent.clear()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, whole=whole).collect()}
        assert got == want
        each = len(sent[-1]) / len({d for d, _ in sent[-1]})
        assert each == 1 if whole == join.WHOLE else each > 1.5, (whole, each)

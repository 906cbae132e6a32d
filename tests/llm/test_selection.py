"""Importance resampling, URL rules and centroid clustering against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import centroids as C
from tidepool.llm.importance import importance_resample, resampled
from tidepool.llm.mixing import mix_sources, mixed
from tidepool.llm.quality import quality
from tidepool.llm.url_filter import filter_urls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- importance resampling ------------------------------------------------------------------------


def plain_features(text, longest):
    words = WORD.findall((text or "").translate(FOLD))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain_resample(rows, target, longest, buckets, percent, least, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    raw = Counter(bucket(f) for _, t in rows for f in plain_features(t, longest)[1])
    want = Counter(bucket(f) for t in target for f in plain_features(t, longest)[1])
    s, t = sum(raw.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = {}
    for d, text in rows:
        words, features = plain_features(text, longest)
        weight = sum(gain[bucket(f)] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        out[d] = [len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    order = sorted((-v[3], d) for d, v in out.items() if v[0] >= least)
    for rank, (_, d) in enumerate(order[: percent * len(order) // 100], 1):
        out[d][4] = rank
    return {d: tuple(v) for d, v in out.items()}


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (3, 97, 60), (2, 5, 100)])
def test_importance(spark, docs, texts, longest, buckets, percent):
    odd = [(400, "É\x00b ß9 x/y:z`q{r\x7fs ÀÉ 中文 abc"), (401, "Zoë" * 3000), (402, "0 " * 50), (403, "a b c d " * 20)]
    rows = [*texts, *odd]
    target = [t for d, t in texts if d % 5 == 0] + ["", "zz yy"]
    more = spark.createDataFrame([(d, t, 0, "x", "y") for d, t in odd], docs.schema)
    bench = spark.createDataFrame([(t, 1) for t in target] + [(None, 2)], "text string, weight int")
    got = importance_resample(docs.unionByName(more), bench, longest=longest, buckets=buckets, percent=percent).collect()
    want = plain_resample(rows, target, longest, buckets, percent, 20, 2024)
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
    assert sum(r.rank is not None for r in got) > 3


def test_importance_of_odd_tables(spark, docs, empty):
    bench = spark.createDataFrame([("alpha beta",)], "text string")
    assert importance_resample(empty, bench).collect() == []
    nothing = importance_resample(docs, bench.where("false"), percent=0).collect()
    assert len(nothing) == docs.count() and all(r.rank is None for r in nothing)
    words = "one two three four five six seven eight nine ten " * 3
    rows = [(None, words), (None, None), *[(1, words)] * 30, *[(2, f"{words} more")] * 20]
    got = importance_resample(spark.createDataFrame(rows, "doc_id long, text string"), bench, percent=50).collect()
    assert len(got) == 52 and sorted(r.rank for r in got if r.rank) == list(range(1, 26))
    assert all(r.score is None and r.rank is None and r.weight is not None for r in got if r.doc_id is None)


def test_drawn_documents_keep_their_columns(spark, docs):
    bench = spark.createDataFrame([("alpha1 beta2 gamma3",)], "text string")
    odd = docs.select("*", F.lit(1.5).alias("weight"), F.lit("x").alias("score"), F.lit("y").alias("rank"))
    got = resampled(odd, bench, percent=20)
    ids = {r.doc_id for r in importance_resample(odd, bench, percent=20).where("rank is not null").collect()}
    assert got.columns == odd.columns and {r.doc_id for r in got.collect()} == ids and {r.weight for r in got.collect()} == {1.5}


# --- URL rules ------------------------------------------------------------------------------------


def plain_verdict(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(FOLD), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, default)))


RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/es/a/b"), ("allow", "net", "/es/a"), ("block", "com", "/en/long/path/"),
    ("block", "xample.com", ""), ("allow", "a.b.net", "/e"), ("block", "a.b.net", "/e"), ("block", "org", "/~"), ("allow", "org", "/~x"), ("block", "ORG", "/z"),
]


def some_urls(rng, n):
    hosts = ["example.com", "www.example.com", "a.www.example.com", "Example.COM", "xexample.com", "a.xample.com", "net", "x.net", "a.b.net", "c.a.b.net", "org", "b.org", "com", "com.net", "a..com", "example.com:80", "", "例.com"]
    paths = ["", "/", "/en/", "/en", "/en/long/path/x", "/es/", "/es/a", "/es/a/b/c", "/es/b", "/e", "/~", "/~x/y", "/z", "//", "/EN/", "/en/é"]
    tails = ["", "?a=://b/c", "#x", "?q#y", "/more"]
    return [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(tails)}" for _ in range(n)]


@pytest.mark.parametrize("extra", [[], [("block", "", ""), ("allow", "", "/es/")]])
def test_url_rules(spark, extra):
    rng = random.Random(3)
    urls = [*some_urls(rng, 1500), None, "", "no scheme", "://", "a://b\nc/d\n?e", *["https://www.example.com/en/hot"] * 500]
    rows = [(i, u, "kept", i * 2, "clash", None) for i, u in enumerate(urls)] + [(3, urls[3], "kept", 6, "clash", None)] * 4
    df = spark.createDataFrame(rows, "page_id int, url string, rule string, `odd.name` int, _tp_x string, verdict int").repartition(5)
    rules = [*RULES, *extra, ("allow", f"h{0}.example.com", "/q")]
    given = spark.createDataFrame([*rules, ("block", "com", "/")], "verdict string, host string, path string")
    got = filter_urls(df, given)
    assert got.columns == ["page_id", "url", "odd.name", "_tp_x", "host", "path", "rule", "verdict"]
    found = got.collect()
    assert len(found) == len(rows)
    lowered = [(v, h.lower(), p) for v, h, p in rules] + [("block", "com", "/")]
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict) == plain_verdict(r.url, lowered) and r["odd.name"] == r.page_id * 2


def test_url_rules_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id int, url string")
    rules = spark.createDataFrame([("block", None, None)], "verdict string, host string, path string")
    assert [tuple(r)[2:] for r in filter_urls(df, rules).collect()] == [("a.com", "/", "", "block")]
    assert [tuple(r)[2:] for r in filter_urls(df, rules.where("false"), default="block").collect()] == [("a.com", "/", None, "block")]
    assert filter_urls(df.where("false"), rules).collect() == []


def test_urls_of_one_host_are_dealt_out(spark):
    """A host of all URLs lands in several ranges."""
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        df = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("https://hot.example.com/en/1").alias("url"))
        rules = spark.createDataFrame([("block", "example.com", "/en/"), ("allow", "com", "/")], "verdict string, host string, path string")
        sizes = [r["count"] for r in filter_urls(df, rules).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 4000 and len(sizes) == 8 and max(sizes) < 1200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


# --- centroids ------------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * v) for v in x]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [x for _, x in first]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    nearest = lambda x: min((far(x, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        centres = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    out = [(i, nearest(x)) for i, x in kept]
    within = Counter()
    for _, (d, n) in out:
        within[n] += d
    fits = lambda v: v if v < 2**63 else None
    return [(i, n, fits(d), fits(within[n]), fits(sum(within.values())), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, (d, n) in out]


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, x, i, "clash") for i, x in rows], "vec_id long, embedding array<double>, cluster long, distance string").repartition(3)


def same(got, want):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("size", [1.0, 2.0**18, 2.0**24, 2.0**40, 1e30])
def test_centroids(spark, size):
    """Beyond 2^53 distances are made in 64-bit integers, beyond 2^63 in Python's."""
    rng = random.Random(11)
    middles = [[rng.uniform(-size, size) for _ in range(6)] for _ in range(5)]
    rows = [(i, [m + rng.gauss(0, size / 20) for m in rng.choice(middles)]) for i in range(300)]
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [None] + [0.0] * 5), (904, [math.nan] * 6), (905, [math.inf] + [0.0] * 5), (906, [1e306] * 6)] + [(7, rows[7][1])] * 5 + [(None, [0.5] * 6)]
    want = plain_clusters([r for r in rows if r[0] != 906], 4, 5, 6, 1024, 3)
    same(C.cluster_vectors(vectors_of(spark, rows), k=4, rounds=5, dims=6), want)


def test_few_vectors_ties_and_empty_clusters(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(6)]
    same(C.cluster_vectors(vectors_of(spark, rows), k=8, rounds=3, dims=2), plain_clusters(rows, 8, 3, 2, 1024, 3))
    alike = [(i, [1.0, 1.0]) for i in range(20)]
    same(C.cluster_vectors(vectors_of(spark, alike), k=3, rounds=2, dims=2), plain_clusters(alike, 3, 2, 2, 1024, 3))
    assert C.cluster_vectors(vectors_of(spark, rows), dims=9).collect() == [] and C.cluster_vectors(vectors_of(spark, rows).where("false"), dims=2).collect() == []


@pytest.mark.parametrize("bits", [10, 24, 25, 26, 28, 30, 31, 40, 70])
def test_distances_and_sums_are_exact(bits):
    rng = random.Random(bits)
    x = [[rng.randrange(-(2**bits), 2**bits + 1) for _ in range(7)] for _ in range(50)]
    c = [[rng.randrange(-(2**bits), 2**bits + 1) for _ in range(7)] for _ in range(3)]
    a, b = np.array(x, object), np.array(c, object)
    a = a.astype(np.int64) if bits < 62 else a
    assert C.distances(a, b).tolist() == [[sum((p - q) ** 2 for p, q in zip(v, w)) for w in c] for v in x]
    cluster = np.array([i % 3 for i in range(50)])
    assert C.sums(a, cluster, 4).tolist() == [[sum(v[j] for i, v in enumerate(x) if i % 3 == k) for j in range(7)] for k in range(4)]


# --- names of callers' columns that inner ones could clash with ------------------------------------

NAMES = ["weight", "_size", "_hash", "_of", "_bucket", "_far", "_near", "_middle", "_tie", "_source", "_whole", "_part", "_edge", "_below", "_last", "_copy", "_tp_c0", "_tp_lang", "_tp_row", "language", "kind", "a.b"]


def with_names(docs):
    return docs.select("doc_id", "text", "source", "lang", *((F.col("doc_id") * 10 + i + 0.5).alias(c) for i, c in enumerate(NAMES)))


def unchanged(rows):
    return all(r[c] == r.doc_id * 10 + i + 0.5 for r in rows for i, c in enumerate(NAMES))


def test_mixing_keeps_columns_of_any_name(docs):
    plain = sorted(tuple(r) for r in mix_sources(docs).select("doc_id", "size", "taken").collect())
    odd = with_names(docs)
    got = mix_sources(odd)
    assert got.columns == [*odd.columns, "size", "source_size", "target", "taken"]
    rows = got.collect()
    assert sorted((r.doc_id, r["size"], r.taken) for r in rows) == plain and unchanged(rows)
    copies = mixed(odd)
    assert copies.columns == odd.columns and unchanged(copies.collect()) and copies.count() == mixed(docs).count()


def test_mixing_of_equal_rows_keeps_columns(spark):
    """Rows that are told apart by number alone."""
    df = with_names(spark.createDataFrame([(None, "a", "some words", "en")] * 50 + [(1, "b", "w " * 400, "en")], "doc_id long, source string, text string, lang string").withColumn("doc_id", F.coalesce("doc_id", F.lit(None).cast("long"))))
    rows = mix_sources(df).collect()
    assert len(rows) == 51 and all(r.weight is None for r in rows if r.doc_id is None)


def test_quality_keeps_columns_of_any_name(docs):
    plain = sorted(tuple(r) for r in quality(docs).select("doc_id", "n_words", "kept").collect())
    odd = with_names(docs)
    got = quality(odd)
    rows = got.collect()
    assert sorted((r.doc_id, r.n_words, r.kept) for r in rows) == plain and unchanged(rows) and set(odd.columns) - {"text"} <= set(got.columns)

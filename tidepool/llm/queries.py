"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import cluster_vectors
from .importance import importance_resample
from .jaccard_join import jaccard_components
from .language_model import score, train
from .mixing import mix_sources
from .quality import quality
from .sentencepiece import decode, encode
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import count_tokens
from .topk import top_k
from .toxicity import fit_toxicity, score_toxicity
from .url_filter import filter_urls

WORD = r"[^\x20\x09-\x0D]+"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op3_substring_dedup",
    rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
    win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
    firsts AS (SELECT run, min(doc_id) AS least FROM win GROUP BY run HAVING count(DISTINCT doc_id) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM win JOIN firsts USING (run) WHERE doc_id > least),
    each AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS rest FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


@query("op6_sentencepiece")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, as a digest, and whether they decode to the same bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    there = decode(encode(docs))
    digest = F.sha2(F.concat_ws(" ", F.col("pieces").cast("array<string>")), 256)
    return there.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"),
        digest.alias("pieces_sha256"),
        F.col("decoded").eqNullSafe(F.col("text").cast("binary")).alias("round_trip"),
    )


@query(
    "op10_mixing",
    rf"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('7:' || coalesce(doc_id::VARCHAR, '-' || md5(coalesce(text, '')))) AS h FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM d GROUP BY source),
    o AS (SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST) AS rk FROM s),
    l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
        (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM o),
    f AS (SELECT *, (SELECT arg_min(level, rk) FROM l WHERE level * weight <= cap) AS final FROM l),
    p AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target FROM f),
    q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM p),
    r AS (SELECT doc_id, size, source_size, target, whole, greatest(0, target - whole * source_size) AS part,
        sum(size) OVER (PARTITION BY d.source ORDER BY h, size) AS upto FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
    SELECT doc_id, size, source_size, target::DOUBLE AS target, (size * (whole + CASE WHEN upto - size / 2 <= part THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op2_jaccard_join",
    rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
    sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
    SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


@query(
    "op4_topk_search",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    e AS (SELECT vec_id, unnest(q) AS x, unnest(range(len(q))) AS i FROM v),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, sum(a.x * b.x)::BIGINT AS score FROM e a JOIN e b USING (i) WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality(docs).select("doc_id", *columns, F.round("log_perplexity", 6).alias("log_perplexity"))


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, and again after three edits: a cut at a third, words put in at two thirds, a line at the end.

    The trees of the first count are kept as a column, and the edits start from those.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda start, end, new: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(new).alias("replacement"))
    edits = F.array(edit(n / 3, n / 3 + 20, ""), edit(n * 2 / 3, n * 2 / 3, " and some more words"), edit(n + 20, n + 20, "\nThe end."))
    kept = count_tokens(docs, keep=True).select("doc_id", F.col("text_after").alias("text"), F.col("tree_after").alias("tree"))
    counted = count_tokens(kept.withColumn("edits", edits), "edits", tree="tree")
    return counted.select("doc_id", "n_tokens", "n_pretokens", "n_tokens_after", "n_recounted")


@query("op5_language_model")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query(
    "op11_importance",
    r"""
    WITH t AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: xor(c >> 1, 3988292384 * (c & 1)), i::BIGINT)) AS crc),
    given AS (SELECT true AS raw, doc_id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
    w AS MATERIALIZED (SELECT raw, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM given),
    f AS MATERIALIZED (SELECT raw, doc_id, feature, count(*) AS n FROM (SELECT raw, doc_id, unnest(ws) AS feature FROM w) GROUP BY ALL),
    b AS (SELECT feature, list_transform(range(1, octet_length(encode(feature)) * 2, 2), lambda i: ('0x' || hex(encode(feature))[i:i + 1])::BIGINT) AS bytes FROM (SELECT DISTINCT feature FROM f)),
    h AS MATERIALIZED (SELECT feature, xor(4294967295, list_reduce(bytes, lambda c, x: xor(c >> 8, crc[1 + (xor(c, x) & 255)]), 4294967295::BIGINT)) % 10000 AS bucket FROM b, t),
    c AS MATERIALIZED (SELECT raw, doc_id, bucket, sum(n) AS n FROM f JOIN h USING (feature) GROUP BY ALL),
    s AS (SELECT bucket, coalesce(sum(n) FILTER (raw), 0) AS s, coalesce(sum(n) FILTER (NOT raw), 0) AS t FROM c GROUP BY bucket),
    g AS MATERIALIZED (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM s),
    d AS (SELECT doc_id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM c JOIN g USING (bucket) WHERE raw GROUP BY doc_id),
    e AS (SELECT doc_id, len(ws) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
        ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT AS h FROM w LEFT JOIN d USING (doc_id) WHERE raw),
    p AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score FROM e),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 10 * count(*) OVER () // 100 AS drawn FROM p WHERE n_words >= 20)
    SELECT p.doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM p LEFT JOIN r USING (doc_id)
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = importance_resample(docs, table(spark, sf_dir, "benchmark").select("text"), longest=1, buckets=10_000, percent=10, least_words=20, seed=2024)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query(
    "op12_url_filter",
    f"""
    WITH rules(verdict, host, path) AS (VALUES {", ".join(map(str, RULES))}),
    u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
    SELECT page_id, any_value(p.host) AS host, any_value(p.path) AS path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, coalesce(arg_max(r.verdict, length(r.host || r.path)), 'allow') AS verdict
    FROM p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY page_id
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def _cluster_sql(k: int, rounds: int, dims: int, scale: int, seed: int) -> str:
    """Rounds as a chain of common table expressions."""
    assign = lambda i: f"""a{i} AS MATERIALIZED (SELECT vec_id, q, unnest(best) FROM (SELECT vec_id, q, min(struct_pack(far := list_sum(list_transform(list_zip(q, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, cl := cl)) AS best FROM v, c{i} GROUP BY vec_id, q))"""
    update = lambda i: f"""m{i} AS (SELECT cl, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cl, unnest(q) AS x, unnest(range({dims})) AS j FROM a{i}) GROUP BY cl, j),
    c{i + 1} AS MATERIALIZED (SELECT cl, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM m{i} GROUP BY cl UNION ALL SELECT cl, c FROM c{i} ANTI JOIN m{i} USING (cl))"""  # noqa: E731
    chain = ",\n    ".join(f"{assign(i)},\n    {update(i)}" for i in range(rounds))
    return f"""
    WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1)::INTEGER AS cl, q AS c FROM v ORDER BY sha256('{seed}:' || vec_id) LIMIT {k}),
    {chain},
    {assign(rounds)}
    SELECT vec_id, cl AS cluster, far AS distance, (sum(far) OVER (PARTITION BY cl))::BIGINT AS cluster_inertia, (sum(far) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} USING (cl)
    """


@query("op13_centroids", _cluster_sql(8, 10, 64, 1024, 3))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=8, rounds=10, dims=64, scale=1024.0, seed=3)

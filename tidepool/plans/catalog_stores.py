"""Queries of what is kept between calls: streams with state, stores, indexes, resumable jobs, mergeable profiles, events and raw records, with the SQL that checks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aspect_table, aspects
from ..functions.aspects import KEYWORDS
from ..functions.text import phrase
from ..operators import eda, profile, profile_states, resume, reviews, text_index, vector_index
from ..session import scratch, spread
from ..sources import raw
from ..sources.store import Store
from ..streaming import events, versions
from .catalog import CUT, DOCS, FIELDS, GAPS, PROFILE, _canonical, _hits, gappy
from .registry import query
from .views import NEGATIVE, POSITIVE, doc_reviews, table

WORDS = r"regexp_extract_all(lower(review_text), '[\p{L}\p{N}]+')"


# --- streams and stores ---------------------------------------------------------------------------


@query(
    """SELECT 'c' || o_custkey AS review_id, o_orderdate AS review_date, o_orderpriority AS review_text, o_orderstatus AS source_url FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderpriority, o_orderstatus) = 1"""
)
def latest_wins_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's latest order, kept in a store by a stream over all orders: state says which version wins."""
    path = scratch(spark, "latest")
    have = table(spark, sf_dir, "orders")
    stream = spark.readStream.schema(have.schema).parquet(f"{sf_dir}/orders*.parquet")
    rows = stream.select(
        F.concat(F.lit("c"), "o_custkey").alias("review_id"), F.col("o_orderdate").cast("timestamp").alias("review_date"), F.col("o_orderpriority").alias("review_text"), F.col("o_orderstatus").alias("source_url"),
    )
    store = Store.create(spark, f"{path}/store", rows.schema, "review_id", 8)
    versions.into_store(rows, store, f"{path}/checkpoint").awaitTermination()
    return store.read().withColumn("review_date", F.col("review_date").cast("timestamp_ntz"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_name END AS p_name FROM part WHERE p_partkey % 5 <> 1 UNION ALL SELECT -p_partkey, 'new' FROM part WHERE p_partkey % 3 = 0 AND p_partkey > 0")
def stored_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of all parts after a third were replaced, as many put in and a fifth deleted."""
    have = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    store = Store.create(spark, scratch(spark, "store"), have.schema, "p_partkey", 16)
    store.upsert(have)
    third = have.where("p_partkey % 3 = 0").withColumn("p_name", F.lit("new"))
    store.upsert(third.unionAll(third.where("p_partkey > 0").withColumn("p_partkey", -F.col("p_partkey"))))
    store.delete(have.where("p_partkey % 5 = 1").select("p_partkey"))
    return store.read()


# --- indexes --------------------------------------------------------------------------------------


def _level_sql(name: str, first: str, second: str, where: str = "") -> str:
    rows = f"(SELECT review_id, {WORDS} AS w FROM doc_reviews {where})"
    level = f"CASE WHEN contains(' ' || array_to_string(w, ' ') || ' ', ' {first} {second} ') THEN 3 WHEN list_contains(w, '{first}') AND list_contains(w, '{second}') THEN 2 WHEN list_contains(w, '{first}') OR list_contains(w, '{second}') THEN 1 ELSE 0 END"
    return f"SELECT '{name}' AS asked, review_id, level FROM (SELECT *, max(level) OVER () AS best FROM (SELECT review_id, {level} AS level FROM {rows})) WHERE level = best AND level > 0"


@query(
    _level_sql("row", "that", "was", "WHERE lower(source) = 'src5'") + " UNION ALL " + _level_sql("all", "this", "that") + " UNION ALL " + _level_sql("any", "was", "nosuchterm"),
    (DOCS,),
)
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical ladder from a positional index of all documents: the terms of three questions, one within a source."""
    index = text_index.build(doc_reviews(spark, sf_dir, costly=True), scratch(spark, "text-index"), "review_id", "review_text", ("source",), buckets=16)
    asked = {"row": ("what that was", "SRC5"), "all": ("this, that", None), "any": ("was nosuchterm", None)}
    found = [text_index.search(spark, index, q, source).select(F.lit(name).alias("asked"), F.col("id").alias("review_id"), F.col("level").cast("int").alias("level")) for name, (q, source) in asked.items()]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query(
    rf"""SELECT review_id, len(list_filter(w, lambda x: x IN ('that', 'was', 'this')))::BIGINT AS occurrences FROM (SELECT review_id, {WORDS} AS w FROM doc_reviews)
    WHERE len(list_filter(w, lambda x: x IN ('that', 'was', 'this'))) > 0 ORDER BY 2 DESC, 1 LIMIT 20""",
    (DOCS,),
)
def indexed_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with most occurrences of a question's terms: blocks that can't reach them stay closed."""
    index = text_index.build(doc_reviews(spark, sf_dir, costly=True), scratch(spark, "text-index"), "review_id", "review_text", (), buckets=16, per_block=256)
    return text_index.best(spark, index, "that was this", 20).select(F.col("id").alias("review_id"), "occurrences")


_NEAR = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
    n AS (SELECT q.vec_id AS query_id, r.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - list_dot_product(q.v, r.v), r.vec_id) AS rank, 1 - list_dot_product(q.v, r.v) AS distance
        FROM v q JOIN v r ON q.vec_id <> r.vec_id AND {0} WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10)"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[vector_index.VectorIndex, DataFrame]:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("L"), F.col("label").cast("string")).alias("source"))
    index = vector_index.build(v, scratch(spark, "vector-index"), cells=16)
    return index, v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")


@query("SELECT query_id, rank::INTEGER AS rank, id, round(distance, 6) AS distance FROM n", (_NEAR.format("r.label = 1"),))
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of a source for every hundredth row, from cells: those that could hold a nearer row are opened."""
    index, asked = _vectors(spark, sf_dir)
    found = vector_index.search(spark, index, asked, 10, " l1", exact=True, others=True)
    return found.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


@query("SELECT count(*) AS neighbours, true AS enough FROM n", (_NEAR.format("true"),))
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine in ten of the true neighbours of every hundredth row at least come from the cells that the index says are enough."""
    index, asked = _vectors(spark, sf_dir)
    true = vector_index.search(spark, index, asked, 10, exact=True, others=True).select("query_id", "id")
    found = vector_index.search(spark, index, asked, 10, others=True).select("query_id", "id", F.lit(1).alias("hit"))
    return true.join(found, ["query_id", "id"], "left").agg(F.count("*").alias("neighbours"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


# --- jobs, profiles and events --------------------------------------------------------------------


@query(
    r"""SELECT review_id, len(regexp_extract_all(review_text, '\S+'))::INT AS text_length_words, length(review_text)::INT AS text_length_chars FROM doc_reviews""",
    (DOCS,),
)
def resumed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job in four parts that is stopped after two and goes on: its input is read once."""
    target, done = scratch(spark, "resume"), []

    def make(part: DataFrame) -> DataFrame:
        if len(done) == 2:
            done.append(0)
            raise InterruptedError
        done.append(1)
        return reviews.features(part).select("review_id", "text_length_words", "text_length_chars")

    d = doc_reviews(spark, sf_dir, costly=True).select("review_id", "review_text")
    try:
        resume.run(d, make, target, 4, {"job": "features"})
    except InterruptedError:
        resume.run(d, make, target, 4, {"job": "features"})
    return resume.result(spark, target)


@query(f"SELECT coalesce(lower(source), 'overall') AS scope, {PROFILE}, true AS texts_near FROM g GROUP BY GROUPING SETS ((lower(source)), ())", (DOCS, GAPS))
def profile_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of three runs that together are all documents, from their states; sketches are within their error of the exact counts."""
    d = gappy(spark, sf_dir).withColumn("_run", F.pmod(F.xxhash64("review_id"), F.lit(3)))
    kept = profile_states.Profiles(spark, scratch(spark, "profiles"))
    for run in range(3):
        kept.add(f"run-{run}", d.where(F.col("_run") == run).drop("_run"))
    p = kept.profile()
    quality = profile.quality_metrics(gappy(spark, sf_dir)).select("scope", "duplicate_count")
    near = F.abs(F.col("repeated_texts") - F.col("duplicate_count")) <= profile_states.DISTINCT_ERROR * F.greatest(F.col("distinct_texts"), F.lit(1))
    exact = ["scope", "record_count", *(f"null_{f}" for f in FIELDS), "average_words", "min_rating", "max_rating", "mean_rating", "missing_value_ratio", "distinct_products", "distinct_reviewers"]
    return p.join(quality, "scope").select(*exact, *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("min_date", "max_date")), near.alias("texts_near"))


@query("SELECT counter, n FROM (SELECT count(*) AS \"rows.rows\", count(*) FILTER (rating_normalized IS NULL) AS \"rows.null_rating_normalized\", count(*) FILTER (review_text IS NULL) AS \"rows.null_review_text\" FROM doc_reviews) UNPIVOT (n FOR counter IN (\"rows.rows\", \"rows.null_rating_normalized\", \"rows.null_review_text\"))", (DOCS,))
def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the event of a job says about the rows that it wrote."""
    path = scratch(spark, "events")
    d = doc_reviews(spark, sf_dir)
    events.job_event(spark, f"{path}/events", "load", d, lambda rows: rows.write.parquet(f"{path}/rows"), ("rating_normalized", "review_text"))
    return events.events(spark, f"{path}/events").select(F.explode("counters").alias("counter", "n"))


@query(
    r"""SELECT 'missing_values' AS chart, 'review_text' AS mark, round(count(*) FILTER (review_text IS NULL) * 100.0 / count(*), 4)::DOUBLE AS n FROM doc_reviews
    UNION ALL SELECT 'missing_values', 'rating_normalized', round(count(*) FILTER (rating_normalized IS NULL) * 100.0 / count(*), 4) FROM doc_reviews UNION ALL SELECT 'missing_values', 'review_date', 0 UNION ALL SELECT 'missing_values', 'product_name', round(count(*) FILTER (product_name IS NULL) * 100.0 / count(*), 4) FROM doc_reviews
    UNION ALL SELECT 'ratings', rating_normalized::DECIMAL(9, 1)::VARCHAR, count(*) FROM doc_reviews GROUP BY rating_normalized
    UNION ALL SELECT 'text_lengths', least(floor(least(len(regexp_extract_all(review_text, '\S+')), 500) / 10), 49)::INT::VARCHAR, count(*) FROM doc_reviews GROUP BY 2
    UNION ALL SELECT 'reviews_by_month', strftime(review_date, '%Y-%m'), count(*) FROM doc_reviews GROUP BY 2
    UNION ALL SELECT 'top_products', product_name, count(*) FROM doc_reviews GROUP BY 2""",
    (DOCS,),
)
def chart_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers behind every chart of all documents, written and read again."""
    path = scratch(spark, "charts")
    names = eda.save_charts(doc_reviews(spark, sf_dir, costly=True).select("review_text", "rating_normalized", "review_date", "product_name"), path)
    frames = []
    for name in names:
        rows = spark.read.parquet(f"{path}/{name}")
        mark, n = F.col(rows.columns[0]).cast("string"), F.col(rows.columns[1]).cast("double")
        frames.append(rows.select(F.lit(name).alias("chart"), mark.alias("mark"), n.alias("n")))
    return reduce(DataFrame.unionAll, frames)


# --- text to aspects in SQL, and aspects over tables ----------------------------------------------

_LISTED = ", ".join(f"({k}, '{name}', '{'|'.join(dict.fromkeys((name, *words)))}', '{_canonical(name)}')" for k, (name, words) in enumerate(KEYWORDS.items()))
_PLAIN = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f""", lab(k, name, words, canonical) AS (VALUES {_LISTED}), s AS (SELECT review_id, unnest(ss) AS s, unnest(range(len(ss))) AS pos FROM c),
    m AS (SELECT review_id, pos, s, {_PLAIN.format('s')} AS t, {_hits(POSITIVE, 's')} AS p, {_hits(NEGATIVE, 's')} AS n FROM s)
    SELECT review_id, pos::INT AS sentence, name AS aspect, CASE WHEN p + n > 0 THEN round((p - n) / (p + n), 4) ELSE 0 END::DOUBLE AS sentiment, trim(substr(trim(regexp_replace(s, '\\s+', ' ', 'g')), 1, 240)) AS quote
    FROM m JOIN lab ON length(t) >= 4 AND regexp_matches(t, words)""",
    (DOCS, CUT),
)
def lateral_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention in every document, asked for in SQL."""
    aspect_table.register(spark, "tidepool_aspects", KEYWORDS, POSITIVE, NEGATIVE)
    d = doc_reviews(spark, sf_dir, costly=True).select("review_id", "review_text")
    return spark.sql("SELECT review_id, a.sentence, a.aspect, a.sentiment, trim(a.quote) AS quote FROM {reviews}, LATERAL tidepool_aspects(review_text) a", reviews=d)


@query(
    f"""WITH lab(k, name, words, canonical) AS (VALUES {_LISTED}), p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+')) AS part FROM documents),
    t AS (SELECT DISTINCT {_PLAIN.format('part')} AS phrase FROM p), n AS (SELECT phrase, arg_min(name, k) AS aspect FROM t JOIN lab ON regexp_matches(phrase, words) GROUP BY phrase)
    SELECT aspect, count(*) AS phrases FROM t LEFT JOIN n USING (phrase) GROUP BY aspect"""
)
def canonical_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of all documents by the label that each stands for, if any: words may match inside others, the first label counts."""
    d = spread(table(spark, sf_dir, "documents").select("text"))
    phrases = d.select(F.explode(F.split("text", "[.!?]+")).alias("p")).select(phrase("p").alias("phrase")).distinct()
    return phrases.select(aspects.canonical("phrase").alias("aspect")).groupBy("aspect").agg(F.count("*").alias("phrases"))



# --- raw records as VARIANT -----------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guides made of the table of pages: keys differ from line to line, some hold objects, some lines aren't records."""
    p, i, url = table(spark, sf_dir, "pages").select("page_id", "url"), F.col("page_id"), F.col("url")
    named = lambda **fields: F.to_json(F.struct(*((v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in fields.items())))
    text = i.cast("string")
    full = named(guideid=i, title=F.concat(F.lit("Guide "), text), category="Phone", author=F.struct(F.concat(F.lit("u"), (i % 7).cast("string")).alias("username")), introduction_raw=" ", summary=url, modified_date=i + 1_600_000_000, difficulty_score=1 + i % 10, extra=i)
    other = named(guide_id=F.concat(F.lit("g"), text), subject="Pad", author="someone", introduction_raw=url, published_date="2024-01-01T00:00:00Z", repairability_score="7", favorites=3)
    odd = named(id=i, title=F.struct(F.lit("text").alias("no")), author=F.struct(F.lit(1).alias("id")), url=url)
    kind = i % 5
    return p.select(F.when(kind == 0, full).when(kind == 1, other).when(kind == 2, F.concat(F.lit("["), text, F.lit("]"))).when(kind == 3, "not JSON").otherwise(odd).alias("value"))


@query(
    """SELECT CASE page_id % 5 WHEN 1 THEN 'g' ELSE '' END || page_id AS guide_id, CASE page_id % 5 WHEN 0 THEN 'Phone' WHEN 1 THEN 'Pad' END AS device_name, CASE page_id % 5 WHEN 0 THEN 'Guide ' || page_id END AS title,
    CASE WHEN page_id % 5 < 2 THEN url END AS review_text, CASE page_id % 5 WHEN 0 THEN (1600000000 + page_id)::VARCHAR WHEN 1 THEN '2024-01-01T00:00:00Z' END AS published_date,
    CASE page_id % 5 WHEN 0 THEN 'u' || page_id % 7 WHEN 1 THEN 'someone' END AS author, CASE page_id % 5 WHEN 1 THEN '3' END AS helpful_votes, CASE page_id % 5 WHEN 0 THEN (1 + page_id % 10)::VARCHAR WHEN 1 THEN '7' END AS repairability_score,
    CASE page_id % 5 WHEN 4 THEN url END AS url, CASE page_id % 5 WHEN 0 THEN 'extra=' || page_id ELSE '' END AS unknown FROM pages WHERE page_id % 5 NOT IN (2, 3)"""
)
def variant_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw guides whose fields have several names, as VARIANT: the first filled field counts, objects don't pass for text, and fields that no mapping names are told."""
    parsed = raw.records(_lines(spark, sf_dir))
    known = [k for keys in raw.IFIXIT_KEYS.values() for k in keys]
    rest = F.array_join(F.transform(F.map_entries(raw.unknown("record", known)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    fields = ["guide_id", "device_name", "title", "review_text", "published_date", "author", "helpful_votes", "repairability_score", "url"]
    return parsed.select(*(raw.first_of("record", raw.IFIXIT_KEYS[f]).alias(f) for f in fields), rest.alias("unknown"))


@query(
    """SELECT 'c' || conv_id AS source_id, string_agg(trim(text), ' ' ORDER BY turn) FILTER (trim(text) <> '') AS text, sum(turn + 0.5)::DOUBLE AS duration_seconds, count(*)::INT AS segment_count, any_value('role ' || conv_id) AS title FROM conversations GROUP BY conv_id"""
)
def variant_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as videos of segments, read from raw JSON."""
    c = table(spark, sf_dir, "conversations")
    segments = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: F.struct(s["text"].alias("text"), (s["turn"] + 0.5).alias("duration")))
    lines = c.groupBy("conv_id").agg(segments.alias("segments")).select(
        F.to_json(F.struct(F.concat(F.lit("c"), "conv_id").alias("video_id"), F.struct(F.concat(F.lit("role "), "conv_id").alias("title")).alias("snippet"), "segments")).alias("value")
    )
    return raw.youtube_records(raw.records(lines)).select("source_id", "text", "duration_seconds", "segment_count", "title")

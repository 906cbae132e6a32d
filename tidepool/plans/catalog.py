"""Every query of the library over the test tables, with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import authenticity, guardrails, sentiment
from ..functions.aspects import KEYWORDS, RECORD, mention_rows, record_rows
from ..functions.text import count_of, phrase, sentences, text_key, token_count
from ..operators import analytics, eda, profile, retrieval, reviews
from ..operators.enrich import enrich_by_key, with_lexicon
from ..operators.reviews import ReviewFilter
from ..schema import UNIFIED, align
from ..sources import readers
from ..sources.specs import SPECS, unified, unify, with_businesses
from .registry import ORACLES, QUERIES, query  # noqa: F401
from .views import ASPECTS, NEGATIVE, POSITIVE, doc_reviews, sale_reviews, table

DOCS = """doc_reviews AS (SELECT 'doc_' || d.doc_id AS review_id, lang AS product_name, 'text_' || lang AS product_category, source, q::DOUBLE AS rating_normalized, text AS review_text,
    'user_' || (d.doc_id % 97) AS reviewer_id, make_timestamp((1600000000 + d.doc_id * 40000) * 1000000) AS review_date, (d.doc_id % 7)::INT AS helpful_votes,
    'https://shop.example/' || lang || '-reader/dp/' || d.doc_id AS source_url, lang AS display_name
    FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id)"""
SALES = """sale_reviews AS (SELECT l_orderkey || '_' || l_linenumber AS review_id, p_name AS product_name, p_type AS product_category, o_orderpriority AS source,
    round(least(1, greatest(0, (l_quantity - 1) / 49.0)), 4) AS rating_normalized, p_name || ' ' || l_returnflag || ' ' || p_brand AS review_text, l_shipdate AS review_date,
    o_custkey::VARCHAR AS reviewer_id, l_linestatus = 'O' AS verified_purchase, l_linenumber AS helpful_votes, 'https://shop.example/' || l_suppkey AS source_url, l_returnflag AS flag,
    CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' ELSE 'neutral' END AS sentiment_label, round(l_discount * 10 - l_tax * 5, 4) AS sentiment_score,
    concat_ws(', ', p_brand, CASE WHEN l_quantity > 25 THEN 'Bulk' END, l_linestatus) AS aspect_labels
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey)"""
BIN = "CASE WHEN rating_normalized >= 0.8 THEN '0.8-1.0' WHEN rating_normalized >= 0.6 THEN '0.6-0.8' WHEN rating_normalized >= 0.4 THEN '0.4-0.6' WHEN rating_normalized >= 0.2 THEN '0.2-0.4' WHEN rating_normalized >= 0 THEN '0.0-0.2' END"
ASPECT_ROWS = "a AS (SELECT *, unnest(list_filter(list_transform(string_split(aspect_labels, ','), lambda x: lower(trim(x))), lambda x: x <> '')) AS aspect FROM sale_reviews)"
TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9'']+')"
PRODUCTS = "SELECT p_name FROM part ORDER BY p_partkey LIMIT 3"


def some_products(spark: SparkSession, sf_dir: str) -> list[str]:
    """Three products that a caller asks to compare, and one that nobody reviewed."""
    return [r.p_name for r in table(spark, sf_dir, "part").orderBy("p_partkey").limit(3).collect()] + ["No such thing"]


# --- normalization, deduplication, features -------------------------------------------------------


@query(
    """SELECT 'yelp_' || l_orderkey || '-' || l_linenumber AS review_id, coalesce(s_name, l_suppkey::VARCHAR) AS product_name, coalesce(n_name, 'local_business') AS product_category,
    round(least(1, greatest(0, ((1 + l_linenumber % 5) - 1) / 4.0)), 4) AS rating_normalized, l_returnflag AS review_text, l_shipdate AS review_date, 'https://yelp.com/biz/' || l_suppkey AS source_url
    FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey"""
)
def normalize_joined_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw reviews joined with their businesses, then unified."""
    line = table(spark, sf_dir, "lineitem")
    raw = line.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("review_id"), F.col("l_suppkey").cast("string").alias("business_id"), (1 + F.col("l_linenumber") % 5).alias("stars"), F.col("l_returnflag").alias("text"), F.col("l_shipdate").cast("string").alias("date"))
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    businesses = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "left").select(F.col("s_suppkey").cast("string").alias("business_id"), F.col("s_name").alias("name"), F.col("n_name").alias("categories"))
    out = unify(with_businesses(raw, businesses), SPECS["yelp"])
    return out.select("review_id", "product_name", "product_category", "rating_normalized", "review_text", F.col("review_date").cast("timestamp_ntz").alias("review_date"), "source_url")


@query(
    """SELECT source, count(*) AS n, round(avg(rating_normalized), 6) AS rating, sum(length(review_text))::BIGINT AS chars, min(review_date) AS first_date, max(review_date) AS last_date FROM (
    SELECT 'ebay' AS source, round(least(1, greatest(0, l_quantity * 2 / 100.0)), 4) AS rating_normalized, l_returnflag AS review_text, l_shipdate AS review_date FROM lineitem
    UNION ALL SELECT 'reddit', NULL, lang || '. ' || text, make_timestamp((1500000000 + doc_id) * 1000000) FROM documents
    UNION ALL SELECT 'youtube', NULL, role || ' says', make_timestamp((1400000000 + conv_id) * 1000000) FROM conversations) GROUP BY source"""
)
def normalize_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three raw shapes, one schema, one frame."""
    ebay = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), (F.col("l_quantity") * 2).alias("seller_rating"), F.col("l_returnflag").alias("feedback_text"), F.col("l_shipdate").cast("string").alias("listing_date"))
    reddit = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.col("lang").alias("title"), "text", (1_500_000_000 + F.col("doc_id")).alias("created_utc"))
    video = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.concat("role", F.lit(" says")).alias("transcript"), (1_400_000_000 + F.col("conv_id")).alias("created_utc"))
    every = unified({"ebay": ebay, "reddit": reddit, "youtube": video})
    ntz = F.col("review_date").cast("timestamp_ntz")
    return every.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("rating_normalized"), 6).alias("rating"), F.sum(F.length("review_text")).alias("chars"), F.min(ntz).alias("first_date"), F.max(ntz).alias("last_date"))


@query("SELECT review_id, review_date, review_text, source_url FROM sale_reviews QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY review_date DESC NULLS LAST, review_text, source_url) = 1", (SALES,))
def dedup_latest_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.latest(sale_reviews(spark, sf_dir)).select("review_id", F.col("review_date").cast("timestamp_ntz").alias("review_date"), "review_text", "source_url")


@query("SELECT p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand")
def distinct_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.keep_first(table(spark, sf_dir, "part"), "p_brand", "p_partkey").select("p_brand", "p_partkey")


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is listed but no longer wanted."""
    wanted = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(wanted, "o_orderkey", "left_anti").select("o_orderkey").distinct()


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_name END AS p_name FROM part UNION ALL SELECT -p_partkey, 'new' FROM part WHERE p_partkey % 3 = 0")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    third = have.where("p_partkey % 3 = 0").withColumn("p_name", F.lit("new"))
    return readers.merged(have, third.unionAll(third.withColumn("p_partkey", -F.col("p_partkey"))), "p_partkey")


@query(
    r"""SELECT review_id, len(regexp_extract_all(review_text, '\S+'))::INT AS text_length_words, length(review_text)::INT AS text_length_chars,
    round(CASE WHEN len(regexp_extract_all(review_text, '[A-Za-z]')) > 0 THEN len(regexp_extract_all(review_text, '[A-Z]')) / len(regexp_extract_all(review_text, '[A-Za-z]')) ELSE 0 END, 6) AS caps_ratio,
    round(CASE WHEN length(review_text) > 0 THEN len(regexp_extract_all(review_text, '!')) / length(review_text) ELSE 0 END, 6) AS exclamation_ratio FROM doc_reviews""",
    (DOCS,),
)
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = reviews.features(doc_reviews(spark, sf_dir, costly=True))
    return f.select("review_id", "text_length_words", "text_length_chars", F.round("caps_ratio", 6).alias("caps_ratio"), F.round("exclamation_ratio", 6).alias("exclamation_ratio"))


# --- filters, pages, options ----------------------------------------------------------------------


@query("SELECT review_id, review_date, rating_normalized FROM doc_reviews WHERE source = 'src3' AND contains(product_category, 'text_e') AND rating_normalized >= 0.5 AND review_date >= TIMESTAMP '2020-09-20' AND contains(lower(review_text), 'the') ORDER BY review_date DESC, review_id LIMIT 25", (DOCS,))
def explore_filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ReviewFilter(query="THE", source=" SRC3 ", category="Text_E", min_rating=0.5, date_start="2020-09-20 00:00:00")
    return reviews.page(doc_reviews(spark, sf_dir), 25, 0, f).select("review_id", F.col("review_date").cast("timestamp_ntz").alias("review_date"), "rating_normalized")


@query("SELECT count(*) AS n, count(DISTINCT source) AS sources FROM sale_reviews WHERE lower(source) = '2-high' AND sentiment_label = 'negative' AND rating_normalized <= 0.4 AND contains(lower(concat_ws(' ', review_text, product_name, product_category, source, aspect_labels)), 'brand#1')", (SALES,))
def explore_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ReviewFilter(query="Brand#1", source="2-HIGH", sentiment="Negative", max_rating=0.4)
    return f.apply(sale_reviews(spark, sf_dir)).agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query("SELECT trim(product_name) AS product_name, count(*) AS review_count FROM sale_reviews GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 200", (SALES,))
def filter_options_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.filter_options(sale_reviews(spark, sf_dir))["products"]


@query("SELECT trim(product_category) AS product_category, count(*) AS review_count FROM sale_reviews GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 200", (SALES,))
def filter_options_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.filter_options(sale_reviews(spark, sf_dir))["categories"]


@query(
    """SELECT kind, value, n AS review_count, min_date, max_date FROM (SELECT 'products' AS kind, trim(product_name) AS value, count(*) AS n, min(review_date) AS min_date, max(review_date) AS max_date FROM sale_reviews GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 20)
    UNION ALL SELECT * FROM (SELECT 'categories', trim(product_category), count(*) AS n, min(review_date), max(review_date) FROM sale_reviews GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 20)
    UNION ALL SELECT 'sources', lower(source), count(*), min(review_date), max(review_date) FROM sale_reviews GROUP BY 2 UNION ALL SELECT 'sentiments', sentiment_label, count(*), min(review_date), max(review_date) FROM sale_reviews GROUP BY 2
    UNION ALL SELECT 'date_range', NULL, count(*), min(review_date), max(review_date) FROM sale_reviews""",
    (SALES,),
)
def filter_option_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All filter options from one scan."""
    return analytics.option_cube(sale_reviews(spark, sf_dir), 20).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("min_date", "max_date")})


@query("SELECT min(review_date) AS min_date, max(review_date) AS max_date FROM sale_reviews", (SALES,))
def filter_options_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.filter_options(sale_reviews(spark, sf_dir))["date_range"]
    return found.select(*(F.col(c).cast("timestamp_ntz").alias(c) for c in found.columns))


@query("SELECT count(*) AS total_reviews, count(DISTINCT lower(source)) AS source_count, count(DISTINCT product_name) AS product_count, max(review_date) AS latest_review_date, count(*) FILTER (sentiment_label = 'positive') AS positive_reviews, count(*) FILTER (sentiment_label = 'negative') AS negative_reviews FROM sale_reviews", (SALES,))
def dashboard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = analytics.summary(sale_reviews(spark, sf_dir))
    return s.withColumn("latest_review_date", F.col("latest_review_date").cast("timestamp_ntz"))


# --- analytics ------------------------------------------------------------------------------------


@query("SELECT sentiment_label, count(*) AS review_count FROM sale_reviews GROUP BY ALL", (SALES,))
def sentiment_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.sentiment_distribution(sale_reviews(spark, sf_dir))


@query(f"SELECT b AS rating_bin, count(review_id) AS review_count FROM (VALUES ('0.0-0.2'), ('0.2-0.4'), ('0.4-0.6'), ('0.6-0.8'), ('0.8-1.0')) v(b) LEFT JOIN (SELECT review_id, {BIN} AS bin FROM doc_reviews) r ON r.bin = b GROUP BY b", (DOCS,))
def rating_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.rating_histogram(doc_reviews(spark, sf_dir))


@query("SELECT lower(source) AS source, sentiment_label, count(*) AS review_count FROM sale_reviews GROUP BY ALL", (SALES,))
def source_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.source_sentiment(sale_reviews(spark, sf_dir))


@query("SELECT strftime(review_date, '%Y-%m') AS month, sentiment_label, count(*) AS review_count FROM sale_reviews GROUP BY ALL", (SALES,))
def monthly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.monthly_sentiment(sale_reviews(spark, sf_dir))


@query("SELECT lower(source) AS source, count(*) FILTER (sentiment_label = 'positive') AS positive, count(*) FILTER (sentiment_label = 'neutral') AS neutral, count(*) FILTER (sentiment_label = 'negative') AS negative FROM sale_reviews GROUP BY 1", (SALES,))
def source_sentiment_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.sentiment_pivot(sale_reviews(spark, sf_dir))


@query("SELECT strftime(review_date, '%Y-%m') AS month, count(*) FILTER (sentiment_label = 'positive') AS positive, count(*) FILTER (sentiment_label = 'neutral') AS neutral, count(*) FILTER (sentiment_label = 'negative') AS negative FROM sale_reviews GROUP BY 1", (SALES,))
def monthly_sentiment_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.sentiment_pivot(sale_reviews(spark, sf_dir), "month")


@query("SELECT aspect, count(*) AS mention_count FROM a GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25", (SALES, ASPECT_ROWS))
def top_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_aspects(sale_reviews(spark, sf_dir))


SUMMARY = "SELECT aspect, count(*) AS mention_count, count(*) FILTER (sentiment_label = 'positive') AS positive_count, count(*) FILTER (sentiment_label = 'neutral') AS neutral_count, count(*) FILTER (sentiment_label = 'negative') AS negative_count, round(avg(sentiment_score), 4) AS average_sentiment_score, min(review_id) AS example_review_id, arg_min(substr(trim(review_text), 1, 280), review_id) AS example_text FROM a GROUP BY aspect ORDER BY 2 DESC, 1 LIMIT 50"


@query(SUMMARY, (SALES, ASPECT_ROWS))
def aspect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.aspect_summary(sale_reviews(spark, sf_dir, placed=True), order=["place"])


@query(f"SELECT aspect, positive_count FROM ({SUMMARY}) ORDER BY positive_count DESC, mention_count DESC, aspect LIMIT 10", (SALES, ASPECT_ROWS))
def aspect_top_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.aspects_by(sale_reviews(spark, sf_dir), "positive").select("aspect", "positive_count")


@query(f"SELECT aspect, negative_count FROM ({SUMMARY}) ORDER BY negative_count DESC, mention_count DESC, aspect LIMIT 10", (SALES, ASPECT_ROWS))
def aspect_top_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.aspects_by(sale_reviews(spark, sf_dir), "negative").select("aspect", "negative_count")


@query("SELECT count(*) FILTER (len(aspect_labels) > 0) AS rows_with_aspects FROM sale_reviews", (SALES,))
def aspect_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.rows_with_aspects(sale_reviews(spark, sf_dir))


@query(
    f""", w AS (SELECT lower(p_name) AS product_key FROM ({PRODUCTS}) UNION SELECT 'no such thing')
    SELECT product_key, count(review_id) AS review_count, round(avg(rating_normalized), 4) AS average_rating, round(avg(sentiment_score), 4) AS average_sentiment_score,
    count(*) FILTER (sentiment_label = 'positive') AS positive_count, count(*) FILTER (sentiment_label = 'neutral') AS neutral_count, count(*) FILTER (sentiment_label = 'negative') AS negative_count, max(review_date) AS latest_review_date
    FROM w LEFT JOIN sale_reviews ON lower(product_name) = product_key GROUP BY product_key""",
    (SALES,),
)
def product_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.compare_products(sale_reviews(spark, sf_dir), some_products(spark, sf_dir))
    return found.withColumn("latest_review_date", F.col("latest_review_date").cast("timestamp_ntz"))


@query(f"SELECT lower(product_name) AS product_key, aspect, count(*) AS mention_count, row_number() OVER (PARTITION BY lower(product_name) ORDER BY count(*) DESC, aspect)::INT AS rank FROM a WHERE sentiment_label = 'positive' AND product_name IN ({PRODUCTS}) GROUP BY 1, 2 QUALIFY rank <= 5", (SALES, ASPECT_ROWS))
def product_top_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.product_aspects(sale_reviews(spark, sf_dir), some_products(spark, sf_dir), "positive")


@query(f"SELECT lower(product_name) AS product_key, lower(source) AS source, count(*) AS review_count FROM sale_reviews WHERE product_name IN ({PRODUCTS}) GROUP BY 1, 2", (SALES,))
def product_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.product_sources(sale_reviews(spark, sf_dir), some_products(spark, sf_dir))


@query("SELECT aspect, count(*) AS mention_count FROM a GROUP BY 1", (SALES, ASPECT_ROWS))
def source_stats_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.source_stats(sale_reviews(spark, sf_dir))["aspects"]


# --- profile, comparison, quality -----------------------------------------------------------------

FIELDS = ("review_id", "product_name", "product_category", "source", "rating_normalized", "review_text", "review_date", "reviewer_id", "verified_purchase", "helpful_votes", "source_url")
#: A quarter of the products, a fifth of the votes and all purchases are missing, so that gaps differ.
GAPS = """g AS (SELECT review_id, CASE WHEN right(review_id, 1) IN ('1', '6') THEN ' ' ELSE product_name END AS product_name, product_category, source, rating_normalized, review_text, review_date, reviewer_id, NULL::BOOLEAN AS verified_purchase,
    CASE WHEN helpful_votes = 3 THEN NULL ELSE helpful_votes END AS helpful_votes, source_url FROM doc_reviews)"""
_MISSING = {f: f"count(*) FILTER ({f} IS NULL OR trim({f}::VARCHAR) = '')" for f in FIELDS}
_GAP_SUM = " + ".join(_MISSING.values())
_WORDS = r"len(regexp_extract_all(review_text, '\S+'))"
PROFILE = f"""count(*) AS record_count, {", ".join(f"{sql} AS null_{f}" for f, sql in _MISSING.items())}, round(avg({_WORDS}), 2) AS average_words,
    round(min(rating_normalized), 4) AS min_rating, round(max(rating_normalized), 4) AS max_rating, round(avg(rating_normalized), 4) AS mean_rating, min(review_date) AS min_date, max(review_date) AS max_date,
    round(({_GAP_SUM}) / (count(*) * 11), 4) AS missing_value_ratio, count(DISTINCT nullif(trim(product_name), '')) AS distinct_products, count(DISTINCT reviewer_id) AS distinct_reviewers"""


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc_reviews(spark, sf_dir, costly=True)
    return d.withColumns({"product_name": F.when(F.substring("review_id", -1, 1).isin("1", "6"), " ").otherwise(F.col("product_name")), "helpful_votes": F.when(F.col("helpful_votes") != 3, F.col("helpful_votes"))})


@query(f"SELECT coalesce(lower(source), 'overall') AS scope, {PROFILE} FROM g GROUP BY GROUPING SETS ((lower(source)), ())", (DOCS, GAPS))
def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.dataset_profile(gappy(spark, sf_dir))
    return p.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("min_date", "max_date")})


@query(
    f"""SELECT lower(source) AS source, count(*) AS record_count, round(avg({_WORDS}), 2) AS average_words, round(avg(rating_normalized), 4) AS average_rating, round(({_GAP_SUM}) / (count(*) * 11), 4) AS missing_value_ratio,
    round({_MISSING["rating_normalized"]} / count(*), 4) AS missing_rating_ratio, round({_MISSING["review_text"]} / count(*), 4) AS missing_text_ratio FROM g GROUP BY 1""",
    (DOCS, GAPS),
)
def source_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.source_comparison(gappy(spark, sf_dir))


@query(
    rf""", k AS (SELECT lower(source) AS s, regexp_replace(lower(regexp_replace(review_text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') AS t FROM g),
    d AS (SELECT s AS scope, count(*) FILTER (t <> '') - count(DISTINCT t) FILTER (t <> '') AS duplicate_count FROM k GROUP BY s
        UNION ALL SELECT 'overall', count(*) FILTER (t <> '') - count(DISTINCT t) FILTER (t <> '') FROM k)
    SELECT b.*, duplicate_count, round(duplicate_count / record_count, 4) AS duplicate_ratio FROM d
    JOIN (SELECT coalesce(lower(source), 'overall') AS scope, count(*) AS record_count, round(({_GAP_SUM}) / (count(*) * 11), 4) AS null_ratio, {_MISSING["review_text"]} AS empty_text_count,
        count(*) FILTER (helpful_votes IS NULL) AS invalid_date_count, count(*) FILTER (rating_normalized IS NULL) AS missing_rating_count FROM g GROUP BY GROUPING SETS ((lower(source)), ())) b USING (scope)""",
    (DOCS, GAPS),
)
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of the rows without votes can't be read."""
    d = gappy(spark, sf_dir)
    return profile.quality_metrics(d.withColumn("review_date", F.when(F.col("helpful_votes").isNull(), "not a date").otherwise(F.col("review_date").cast("string"))))


@query("SELECT field, null_count FROM (SELECT " + ", ".join(f"{sql} AS {f}" for f, sql in _MISSING.items()) + " FROM g) UNPIVOT (null_count FOR field IN (" + ", ".join(FIELDS) + "))", (DOCS, GAPS))
def null_counts_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.null_counts(gappy(spark, sf_dir), FIELDS)


# --- text models ----------------------------------------------------------------------------------


def _canonical(label: str, keywords=KEYWORDS) -> str:
    """By the plain rule: the first label that equals the phrase or has a word in it."""
    return next(name for name, words in keywords.items() if label in (name, *words) or any(w in label for w in (name, *words)))


def _hits(words, text: str = "review_text") -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter({TOKENS.format(text)}, lambda x: x IN ({listed})))"


LEXICON = f"l AS (SELECT *, {_hits(POSITIVE)} AS p, {_hits(NEGATIVE)} AS n FROM doc_reviews), s AS (SELECT *, CASE WHEN p + n > 0 THEN round((p - n) / (p + n), 4) ELSE 0 END AS score FROM l)"


@query("SELECT review_id, score::DOUBLE AS sentiment_score, CASE WHEN score > 0.2 THEN 'positive' WHEN score < -0.2 THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM s", (DOCS, LEXICON))
def lexicon_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = doc_reviews(spark, sf_dir, costly=True).withColumn("sentiment_score", sentiment.lexicon_score("review_text", POSITIVE, NEGATIVE))
    return found.select("review_id", "sentiment_score", sentiment.label("sentiment_score").alias("sentiment_label"))


@query(f"SELECT count(*) AS n, sum({_hits(sentiment.POSITIVE)})::BIGINT AS p, sum({_hits(sentiment.NEGATIVE)})::BIGINT AS n_neg FROM doc_reviews", (DOCS,))
def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc_reviews(spark, sf_dir, costly=True)
    return d.agg(F.count("*").alias("n"), F.sum(count_of("review_text", sentiment.POSITIVE)).cast("long").alias("p"), F.sum(count_of("review_text", sentiment.NEGATIVE)).cast("long").alias("n_neg"))


CUT = r"""c AS (SELECT review_id, list_filter(list_transform(string_split(regexp_replace(review_text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM doc_reviews)"""


@query("SELECT review_id, len(ss)::INT AS sentence_count FROM c", (DOCS, CUT))
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_reviews(spark, sf_dir, costly=True).select("review_id", F.size(sentences("review_text")).alias("sentence_count"))


@query(
    f", x AS (SELECT review_id, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS t, {_hits(POSITIVE, 's')} > {_hits(NEGATIVE, 's')} AS good FROM (SELECT review_id, unnest(ss) AS s FROM c)) "
    + "SELECT aspect, count(*) AS mention_count, sum(good::INT)::BIGINT AS positive_count, count(DISTINCT review_id) AS reviews FROM ("
    + " UNION ALL ".join(f"SELECT '{a}' AS aspect, good, review_id FROM x WHERE length(t) >= 4 AND regexp_matches(t, '{'|'.join(dict.fromkeys((a, *ws)))}')" for a, ws in ASPECTS.items())
    + ") GROUP BY aspect",
    (DOCS, CUT),
)
def aspect_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_reviews(spark, sf_dir, costly=True).select("review_id", "review_text")
    m = mention_rows(rows, "review_text", ASPECTS, POSITIVE, NEGATIVE)
    return m.groupBy("aspect").agg(F.count("*").alias("mention_count"), F.sum((F.col("sentiment") > 0).cast("int")).alias("positive_count"), F.count_distinct("review_id").alias("reviews"))


def _records_sql() -> str:
    """Every mention with its place, and of each canonical label of a text the strongest record, the first of equals."""
    labels = ", ".join(f"({k}, '{'|'.join(dict.fromkeys((name, *words)))}', '{_canonical(name, ASPECTS)}')" for k, (name, words) in enumerate(ASPECTS.items()))
    return f"""lab(k, words, aspect) AS (VALUES {labels}),
    m AS (SELECT review_id, pos, k, aspect, {_hits(POSITIVE, 's')} AS p, {_hits(NEGATIVE, 's')} AS n, trim(substr(trim(regexp_replace(s, '\\s+', ' ', 'g')), 1, 240)) AS quote
        FROM (SELECT review_id, unnest(ss) AS s, unnest(range(len(ss))) AS pos FROM c) x JOIN lab ON length(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))) >= 4 AND regexp_matches(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), words)),
    v AS (SELECT *, CASE WHEN p + n > 0 THEN round((p - n) / (p + n), 4) ELSE 0 END AS score FROM m),
    r AS (SELECT review_id, aspect, score::DOUBLE AS sentiment, quote, first_value(pos * 100 + k) OVER (PARTITION BY review_id, aspect ORDER BY pos, k) AS place FROM v QUALIFY row_number() OVER (PARTITION BY review_id, aspect ORDER BY abs(score) DESC, pos, k) = 1)"""


RECORDS = _records_sql()


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_by_key(doc_reviews(spark, sf_dir, costly=True).select("review_id", "review_text"), "review_id", with_lexicon(POSITIVE, NEGATIVE), ASPECTS, POSITIVE, NEGATIVE)


@query(
    ", q AS (SELECT review_id, string_agg(aspect, ', ' ORDER BY place) AS aspect_labels, count(*)::INT AS aspect_count FROM r GROUP BY 1) SELECT review_id, s.score::DOUBLE AS sentiment_score, CASE WHEN s.score > 0.2 THEN 'positive' WHEN s.score < -0.2 THEN 'negative' ELSE 'neutral' END AS sentiment_label, coalesce(aspect_labels, '') AS aspect_labels, coalesce(aspect_count, 0)::INT AS aspect_count FROM s LEFT JOIN q USING (review_id)",
    (DOCS, CUT, RECORDS, LEXICON),
)
def enriched_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir).select("review_id", "sentiment_label", "sentiment_score", "aspect_labels", "aspect_count")


@query("SELECT review_id, aspect, sentiment, quote FROM r", (DOCS, CUT, RECORDS))
def enriched_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that the JSON column holds, read back."""
    details = F.from_json("aspect_details_json", "array<struct<aspect:string,sentiment:double,quote:string>>")
    return _enriched(spark, sf_dir).select("review_id", F.explode(details).alias("d")).select("review_id", "d.*")


PROMOTED = " + ".join(f"contains(lower(t), '{p}')::INT" for p in authenticity.PROMOTIONS)


RISK = rf"""t AS (SELECT review_id, trim(review_text) AS t, {TOKENS.format('review_text')} AS w FROM doc_reviews),
    u AS (SELECT *, len(w) AS n, len(list_distinct(w)) AS d, {PROMOTED} AS promo, len(list_filter(map_values(list_histogram(w)), lambda c: c >= 4)) AS rep,
        len(list_filter(w, lambda x: x IN ({", ".join(repr(x) for x in authenticity.SUPERLATIVES)}))) AS sup, len(list_filter(w, lambda x: x IN ({", ".join(repr(x) for x in authenticity.CONCRETE)}))) AS con FROM t),
    r AS (SELECT review_id, t, [CASE WHEN n < 8 THEN 0.15 ELSE 0 END, CASE WHEN regexp_matches(t, '(?i)https?://|www\.') OR regexp_matches(t, '\b[\w.+-]+@[\w.-]+\.[A-Za-z]{{2,}}\b') THEN 0.25 ELSE 0 END,
        CASE WHEN promo > 0 THEN least(0.35, 0.15 + 0.08 * promo) ELSE 0 END, CASE WHEN n >= 10 AND d / n < 0.45 THEN 0.2 ELSE 0 END, CASE WHEN rep > 0 THEN least(0.2, 0.08 * rep) ELSE 0 END,
        CASE WHEN len(regexp_extract_all(t, '!')) >= 3 OR len(regexp_extract_all(t, '\?')) >= 3 THEN 0.1 ELSE 0 END,
        CASE WHEN len(regexp_extract_all(t, '\p{{L}}')) >= 20 AND len(regexp_extract_all(t, '\p{{Lu}}')) / len(regexp_extract_all(t, '\p{{L}}')) > 0.45 THEN 0.12 ELSE 0 END,
        CASE WHEN sup >= 3 AND con = 0 THEN 0.2 ELSE 0 END, CASE WHEN regexp_matches(t, '(?i)\b(5\s*stars|five\s*stars|must\s*buy|buy\s*now)\b') THEN 0.12 ELSE 0 END]::DOUBLE[] AS parts FROM u),
    s AS (SELECT review_id, CASE WHEN t = '' THEN 0 ELSE round(least(1, list_sum(parts)), 4) END::DOUBLE AS score, CASE WHEN t = '' THEN '' ELSE array_to_string(list_filter(list_transform(range(1, 10),
        lambda i: CASE WHEN parts[i] > 0 THEN ['very_short_review', 'external_link_or_contact', 'promotional_language', 'low_vocabulary_diversity', 'repeated_terms', 'excessive_punctuation', 'excessive_caps', 'generic_superlatives', 'review_bait_phrase'][i] END),
        lambda f: f IS NOT NULL), ',') END AS flags FROM r)"""


@query("SELECT review_id, score, flags, CASE WHEN score >= 0.7 THEN 'likely_fake' WHEN score >= 0.42 THEN 'suspicious' ELSE 'low_risk' END AS label FROM s", (DOCS, RISK))
def authenticity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authenticity.scored(doc_reviews(spark, sf_dir, costly=True).select("review_id", "review_text")).select("review_id", "risk.score", "risk.label", F.array_join("risk.flags", ",").alias("flags"))


@query("SELECT review_id FROM s WHERE score < 0.45", (DOCS, RISK))
def authenticity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.genuine(doc_reviews(spark, sf_dir, costly=True), threshold=0.45).select("review_id")


@query(
    r""", g AS (SELECT conv_id, turn, trim(text) AS t, len(regexp_extract_all(text, '[A-Za-z0-9'']+')) AS n FROM conversations),
    f AS (SELECT *, list_filter([CASE WHEN regexp_matches(t, '(?i)\bignore (all )?(previous|prior|system|developer) instructions\b|\breveal (the )?(system|developer) prompt\b|\bjailbreak\b|\bDAN mode\b') THEN 'prompt_injection' END,
        CASE WHEN regexp_matches(t, '(?i)\b(api[_ -]?key|password|secret|token|credential)s?\b|\b.env\b|\benvironment variables?\b') THEN 'secret_extraction' END,
        CASE WHEN regexp_matches(t, '(?i)\b(write|generate|fabricate|create)\b.*\bfake\b.*\breviews?\b|\b(hide|remove|delete|suppress)\b.*\bnegative\b.*\breviews?\b') THEN 'review_manipulation' END], lambda x: x IS NOT NULL) AS flags,
        CASE WHEN n = 0 THEN 0 WHEN n = 1 OR length(t) > 1200 THEN 0.35 WHEN n <= 3 THEN 0.6 ELSE 0.9 END AS sure FROM g)
    SELECT conv_id, turn, CASE WHEN t = '' OR len(flags) > 0 THEN 'block' WHEN sure < 0.5 THEN 'needs_human_review' ELSE 'allow' END AS action, t <> '' AND len(flags) = 0 AND sure >= 0.5 AS allowed,
    CASE WHEN t = '' THEN 'empty_query' WHEN len(flags) > 0 THEN array_to_string(flags, ',') WHEN sure < 0.5 THEN 'low_confidence_query' ELSE '' END AS flags,
    CASE WHEN t = '' THEN 0 WHEN len(flags) > 0 THEN 0.95 ELSE sure END::DOUBLE AS confidence FROM f""",
    ("none AS (SELECT 1)",),
)
def guardrail_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", guardrails.decision("text", reviewed=True).alias("d"))
    return d.select("conv_id", "turn", "d.action", "d.allowed", F.array_join("d.flags", ",").alias("flags"), "d.confidence")


@query(
    r"""SELECT p_partkey, nullif(CASE WHEN p_partkey % 3 <> 0 AND NOT regexp_matches(replace(slug, ' ', ''), '^[A-Za-z0-9_-]{10,}$') THEN slug END, '') AS slug
    FROM (SELECT p_partkey, trim(regexp_replace(CASE WHEN p_partkey % 7 = 1 THEN 'B0ABCDEFGH' WHEN p_partkey % 7 = 2 THEN 'tea-_pot' ELSE replace(p_name, ' ', '-') || '~' END, '[-_\s]+', ' ', 'g')) AS slug FROM part)"""
)
def page_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from product links, some of which have none, or an id in its place."""
    key = F.col("p_partkey")
    name = F.when(key % 7 == 1, "B0ABCDEFGH").when(key % 7 == 2, "tea-_pot").otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("~")))
    url = F.when(key % 3 == 0, F.concat(F.lit("https://shop.example/dp/"), key)).otherwise(F.concat(F.lit("https://shop.example/"), name, F.lit("/dp/"), key, F.lit("?ref=1")))
    return table(spark, sf_dir, "part").withColumn("url", url).select("p_partkey", reviews.title_from_url("url").alias("slug"))


@query(f"SELECT lower(source) AS source, sum(len({TOKENS.format('review_text')}))::BIGINT AS tokens, count(DISTINCT regexp_replace(lower(trim(review_text)), '\\s+', ' ', 'g')) AS texts, count(DISTINCT trim(regexp_replace(lower(review_text), '[^a-z0-9]+', ' ', 'g'))) AS phrases FROM doc_reviews GROUP BY 1", (DOCS,))
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc_reviews(spark, sf_dir, costly=True)
    return d.groupBy(F.lower("source").alias("source")).agg(F.sum(token_count("review_text")).cast("long").alias("tokens"), F.count_distinct(text_key("review_text")).alias("texts"), F.count_distinct(phrase("review_text")).alias("phrases"))


# --- retrieval ------------------------------------------------------------------------------------


@query("SELECT vec_id, round(1 - list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) + 0.0 AS distance FROM embeddings ORDER BY 2, 1 LIMIT 5")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    probe = [float(x) for x in vectors.where("vec_id = 7").first().embedding]
    found = retrieval.nearest(vectors, probe, 5, "vec_id")
    return found.select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"))


@query(
    r""", t AS (SELECT review_id, regexp_extract_all(lower(review_text), '[\p{L}\p{N}]+') AS w FROM doc_reviews WHERE lower(source) = 'src5'),
    l AS (SELECT review_id, CASE WHEN contains(' ' || array_to_string(w, ' ') || ' ', ' that was ') THEN 3 WHEN list_contains(w, 'that') AND list_contains(w, 'was') THEN 2 WHEN list_contains(w, 'that') OR list_contains(w, 'was') THEN 1 ELSE 0 END AS level FROM t)
    SELECT review_id, level FROM l WHERE level > 0 AND level = (SELECT max(level) FROM l)""",
    (DOCS,),
)
def lexical_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.lexical(doc_reviews(spark, sf_dir), "what that was", "SRC5", "review_text").select("review_id", F.col("level").cast("int").alias("level"))


@query(
    """SELECT * FROM (SELECT 'words' AS asked, review_id FROM doc_reviews WHERE contains(lower(review_text), 'that') OR contains(lower(review_text), 'this') ORDER BY review_date DESC, review_id LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'short', review_id FROM doc_reviews WHERE contains(lower(review_text), 'was on') ORDER BY review_date DESC, review_id LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'none', review_id FROM doc_reviews WHERE contains(lower(review_text), 'review') ORDER BY review_date DESC, review_id LIMIT 5)""",
    (DOCS,),
)
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with punctuation, of short words only, and of none."""
    d = doc_reviews(spark, sf_dir)
    found = [retrieval.keywords(d, q).select(F.lit(name).alias("asked"), "review_id") for name, q in (("words", "\"That\" is in (this)?"), ("short", "Was on?"), ("none", "?!"))]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query()
def hashing_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.index(doc_reviews(spark, sf_dir, costly=True), 64)
    return found.select("id", F.size("embedding").alias("dimensions"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


@query()
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.hybrid(retrieval.index(doc_reviews(spark, sf_dir, costly=True), 64), "that was from", 10, dimensions=64)
    return retrieval.citations(found)


# --- exploration ----------------------------------------------------------------------------------


@query("SELECT l_linenumber AS votes, count(*) AS review_count, round(count(*) * 100 / sum(count(*)) OVER (), 4) AS percent FROM lineitem GROUP BY 1")
def eda_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.shares(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("votes")), "votes")


@query(r"SELECT least(floor(least(len(regexp_extract_all(review_text, '\S+')), 500) / 10), 49)::INT AS bin, count(*) AS review_count FROM doc_reviews GROUP BY 1", (DOCS,))
def eda_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.length_histogram(doc_reviews(spark, sf_dir))


@query("SELECT strftime(review_date, '%Y-%m') AS month, count(*) AS review_count FROM sale_reviews GROUP BY 1", (SALES,))
def eda_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.monthly(sale_reviews(spark, sf_dir))


@query("SELECT product_name, count(*) AS review_count FROM sale_reviews GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", (SALES,))
def eda_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.top_products(sale_reviews(spark, sf_dir))


@query(f"SELECT verified_purchase AS verified, {BIN} AS rating_bin, round(count(*) / sum(count(*)) OVER (PARTITION BY verified_purchase), 4) AS density FROM sale_reviews GROUP BY 1, 2", (SALES,))
def eda_verified_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.verified_density(sale_reviews(spark, sf_dir).withColumnRenamed("verified_purchase", "verified"))


@query(
    r"SELECT count(*) AS record_count, round(avg(rating_normalized), 4) AS mean_rating, round(avg(len(regexp_extract_all(review_text, '\S+'))), 2) AS mean_words, median(len(regexp_extract_all(review_text, '\S+')))::DOUBLE AS median_words, round(avg(verified_purchase::INT), 4) AS verified_share, round(count(*) FILTER (helpful_votes = 0) / count(*), 4) AS no_votes_share, round(count(*) FILTER (year(review_date) >= 2015) / count(*), 4) AS since_2015_share FROM sale_reviews",
    (SALES,),
)
def eda_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sale_reviews(spark, sf_dir).withColumnsRenamed({"rating_normalized": "rating", "verified_purchase": "verified", "helpful_votes": "votes"})
    return eda.overview(d).select("record_count", "mean_rating", "mean_words", "median_words", "verified_share", "no_votes_share", "since_2015_share")


#: Aspects and signs that documents are expected to have, by whether their number of votes is even.
GOLDEN = {0: [("place", "positive"), ("past", "negative")], 1: [("link", "positive"), ("price", "neutral")]}


@query(
    f""", w AS (SELECT review_id, aspect, sign FROM doc_reviews JOIN (VALUES {", ".join(f"({k}, '{a}', '{s}')" for k, names in GOLDEN.items() for a, s in names)}) v(k, aspect, sign) ON helpful_votes % 2 = k),
    h AS (SELECT * FROM r JOIN w USING (review_id, aspect)),
    t AS (SELECT (SELECT count(*) FROM r) AS got, (SELECT count(*) FROM w) AS want, (SELECT count(*) FROM h) AS hit, (SELECT count(*) FROM h WHERE sign = CASE WHEN sentiment > 0 THEN 'positive' WHEN sentiment < 0 THEN 'negative' ELSE 'neutral' END) AS agree)
    SELECT round(hit / got, 4) AS precision, round(hit / want, 4) AS recall, round(2 * (hit / got) * (hit / want) / (hit / got + hit / want), 4) AS f1, round(agree / hit, 4) AS sign_accuracy FROM t""",
    (DOCS, CUT, RECORDS),
)
def golden_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aspects found in all documents against those expected."""
    d = doc_reviews(spark, sf_dir, costly=True).select("review_id", F.col("review_text").alias("text"), "helpful_votes")
    listed = lambda names: F.array(*(F.struct(F.lit(a).alias("aspect"), F.lit(s).alias("sign")) for a, s in names))
    golden = d.withColumn("expected", F.when(F.col("helpful_votes") % 2 == 0, listed(GOLDEN[0])).otherwise(listed(GOLDEN[1])))
    found = record_rows(d, "review_id", "text", ASPECTS, POSITIVE, NEGATIVE)
    both = golden.join(found, "review_id", "left").withColumn("records", F.coalesce("records", F.array().cast(RECORD)))
    return eda.evaluate(both, F.col("records"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def aligned_partial_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that lacks most of the schema's columns, fitted to it."""
    return align(table(spark, sf_dir, "documents"), UNIFIED).groupBy("source").agg(F.count("*").alias("n"))

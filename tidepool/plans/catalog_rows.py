"""Queries of whole rows: every source's projection, payloads, labels, scalar functions and indexes, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aspects, sentiment, text, values
from ..operators import analytics, eda, retrieval, reviews, warehouse
from ..operators.reviews import FALLBACKS, STOCK_NAMES, ReviewFilter
from ..schema import UNIFIED
from ..session import spread
from ..sources.specs import SPECS, unify
from .catalog import ASPECT_ROWS, DOCS, PRODUCTS, SALES, some_products
from .registry import query
from .views import NEGATIVE, POSITIVE, doc_reviews, sale_reviews, table

NTZ = "timestamp_ntz"
CLAMP = "round(least(1, greatest(0, ({0} - {1}) / {2}.0)), 4)"


def _unified(raw: DataFrame, source: str) -> DataFrame:
    return unify(raw, SPECS[source]).withColumn("review_date", F.col("review_date").cast(NTZ))


def _null(kind: str) -> str:
    return f"NULL::{kind}"


def _row(**columns: str) -> str:
    """The unified columns in SQL; those that aren't given are null."""
    kinds = {"double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}
    return ", ".join(f"({columns.get(f.name, _null(kinds.get(f.dataType.simpleString(), 'VARCHAR')))}) AS {f.name}" for f in UNIFIED)


# --- every source, all columns --------------------------------------------------------------------


@query(
    "SELECT " + _row(
        review_id="'amazon_' || l_partkey || '_' || CASE WHEN l_linenumber % 4 = 0 THEN 'unknown' ELSE l_suppkey::VARCHAR END", product_name="CASE WHEN l_linenumber % 3 = 0 THEN l_orderkey ELSE l_partkey END::VARCHAR", product_category="'electronics'", source="'amazon'",
        rating_normalized="CASE WHEN l_linenumber <> 2 THEN " + CLAMP.format("l_linenumber", 1, 4) + " END", review_text="CASE WHEN l_returnflag = 'A' THEN l_linestatus ELSE l_returnflag || '. ' || l_linestatus END",
        review_date="make_timestamp(1500000000123000 + l_orderkey * 86400000000)", reviewer_id="CASE WHEN l_linenumber % 4 = 0 THEN 'unknown' ELSE l_suppkey::VARCHAR END", verified_purchase="l_linestatus = 'O'", helpful_votes="l_quantity::INT",
        source_url="CASE WHEN l_linenumber = 1 THEN 'https://own.example/1' ELSE 'https://amazon.com/dp/' || l_partkey END", display_name="CASE WHEN l_returnflag = 'A' THEN 'Amazon Electronics Item ' || l_partkey ELSE l_returnflag END", display_category="'Electronics Product'", entity_type="'product_review'",
    ) + " FROM lineitem"
)
def normalize_amazon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw product reviews: missing parents, blank users and titles, ratings that aren't numbers, times in milliseconds, votes with a fraction."""
    n = F.col("l_linenumber")
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("asin"), F.when(n % 3 == 0, F.col("l_orderkey").cast("string")).when(n % 3 == 1, " ").alias("parent_asin"), F.when(n % 4 != 0, F.col("l_suppkey").cast("string")).otherwise("").alias("user_id"),
        F.when(n == 2, "five").otherwise(n.cast("string")).alias("rating"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).otherwise("  ").alias("title"), F.col("l_linestatus").alias("text"),
        (1_500_000_000_123 + F.col("l_orderkey") * 86_400_000).alias("timestamp"), (F.col("l_linestatus") == "O").alias("verified_purchase"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".7")).alias("helpful_vote"),
        F.when(n == 1, "https://own.example/1").alias("url"),
    )
    return _unified(raw, "amazon")


@query(
    "SELECT " + _row(
        review_id="'ebay_' || l_orderkey", product_name="CASE WHEN l_linenumber % 3 = 0 THEN l_orderkey::VARCHAR WHEN l_linenumber % 3 = 1 THEN l_returnflag ELSE 'item ' || l_partkey END", product_category="CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus ELSE 'unknown' END", source="'ebay'",
        rating_normalized=CLAMP.format("l_quantity * 2.5", 0, 100), review_text="CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE 'second' END", review_date="CASE WHEN l_linenumber <> 3 THEN l_shipdate END", reviewer_id="CASE WHEN l_linenumber = 1 THEN l_suppkey::VARCHAR ELSE 'unknown' END",
        helpful_votes="l_partkey::INT", source_url="'https://www.ebay.com/itm/' || l_orderkey", display_name="CASE WHEN l_linenumber % 3 = 0 THEN l_orderkey::VARCHAR WHEN l_linenumber % 3 = 1 THEN l_returnflag ELSE 'item ' || l_partkey END",
        display_category="CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus ELSE 'Marketplace Listing' END", entity_type="'listing_review'",
    ) + " FROM lineitem"
)
def normalize_ebay(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item_id"), F.when(n % 3 == 1, F.col("l_returnflag")).alias("title"), F.when(n % 3 == 2, F.concat(F.lit("item "), "l_partkey")).alias("item_title"), F.when(n % 2 == 0, F.col("l_linestatus")).alias("primary_category"),
        (F.col("l_quantity") * 2.5).cast("string").alias("seller_rating"), F.when(n % 2 == 0, F.col("l_returnflag")).otherwise("").alias("feedback_text"), F.lit("second").alias("review_text"),
        F.when(n != 3, F.col("l_shipdate").cast("string")).otherwise("2024-13-45").alias("listing_date"), F.when(n == 1, F.col("l_suppkey").cast("string")).alias("seller"), F.col("l_partkey").alias("feedback_count"),
    )
    return _unified(raw, "ebay")


@query(
    "SELECT " + _row(
        review_id="'ifixit_' || p_partkey", product_name="CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END", product_category="CASE WHEN p_partkey % 3 = 0 THEN 'repairability' ELSE p_type END", source="'ifixit'", rating_normalized=CLAMP.format("p_size", 1, 9),
        review_text="p_name", review_date="CASE WHEN p_partkey % 2 = 0 THEN make_timestamp((1600000000 + p_partkey) * 1000000) ELSE TIMESTAMP '2023-05-06 07:08:09' END", reviewer_id="'unknown'", helpful_votes="NULL::INTEGER", source_url="'https://www.ifixit.com/Guide/' || p_partkey",
        display_name="p_name", display_category="CASE WHEN p_partkey % 3 = 0 THEN 'Repair Guide' ELSE p_type END", entity_type="'repair_review'",
    ) + " FROM part"
)
def normalize_ifixit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guides, dated by seconds or by ISO text with an offset."""
    k = F.col("p_partkey")
    raw = table(spark, sf_dir, "part").select(
        k.cast("string").alias("source_id"), F.when(k % 2 == 0, F.col("p_brand")).alias("device_name"), F.col("p_name").alias("title"), F.when(k % 3 != 0, F.col("p_type")).alias("device_category"), F.col("p_name").alias("text"),
        F.when(k % 2 == 0, (1_600_000_000 + k).cast("string")).otherwise("2023-05-06T09:08:09+02:00").alias("published_date"), F.lit("many").alias("helpful_votes"), F.col("p_size").cast("string").alias("repairability_score"),
    )
    return _unified(raw, "ifixit")


@query(
    "SELECT " + _row(
        review_id="'youtube_' || conv_id || '-' || turn", product_name="CASE WHEN turn = 1 THEN role ELSE 'unknown' END", product_category="'unknown'", source="'youtube'", review_text="text",
        review_date="CASE WHEN turn = 0 THEN TIMESTAMP '2022-02-03 00:00:00' ELSE make_timestamp((1400000000 + conv_id) * 1000000) END", reviewer_id="role", helpful_votes="(conv_id % 9)::INT", source_url="''", display_name="CASE WHEN turn = 2 THEN role ELSE 'YouTube Review' END",
        display_category="'Video Review'", entity_type="'video_transcript'",
    ) + " FROM conversations"
)
def normalize_youtube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts; a published date goes before the time of the upload."""
    t = F.col("turn")
    raw = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("video_id"), F.when(t == 1, F.col("role")).alias("product_name"), F.col("text").alias("transcript"), F.when(t == 0, "2022-02-03").otherwise("soon").alias("published_date"),
        (1_400_000_000 + F.col("conv_id")).alias("created_utc"), F.col("role").alias("channel_id"), (F.col("conv_id") % 9).alias("like_count"), F.when(t == 2, F.col("role")).alias("title"),
    )
    return _unified(raw, "youtube")


@query(
    "SELECT " + _row(
        review_id="'reddit_' || doc_id", product_name="'unknown'", product_category="CASE WHEN doc_id % 5 = 0 THEN 'general' ELSE lang END", source="'reddit'", review_text="CASE WHEN doc_id % 3 = 0 THEN text ELSE source || '. ' || text END", review_date="make_timestamp((1500000000 + doc_id) * 1000000)",
        reviewer_id="'unknown'", helpful_votes="(doc_id % 50 - 10)::INT", source_url="''", display_name="CASE WHEN doc_id % 3 = 0 THEN 'Reddit Discussion' ELSE source END", display_category="CASE WHEN doc_id % 5 = 0 THEN 'general' ELSE lang END", entity_type="'forum_post'",
    ) + " FROM documents WHERE trim(text) <> ''"
)
def normalize_reddit(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    raw = table(spark, sf_dir, "documents").where("trim(text) <> ''").select(i.alias("source_id"), F.when(i % 3 != 0, F.col("source")).alias("title"), "text", F.when(i % 5 != 0, F.col("lang")).alias("subreddit"), (1_500_000_000 + i).alias("created_utc"), (i % 50 - 10).alias("score"))
    return _unified(raw, "reddit")


# --- payloads, labels, tables ---------------------------------------------------------------------


@query(
    r"""SELECT review_id, product_name, product_category, lower(source) AS source, rating_normalized, review_text, strftime(review_date, '%Y-%m-%dT%H:%M:%S+00:00') AS review_date, reviewer_id, source_url, '' AS aspect_labels, '' AS sentiment_label,
    NULL::DOUBLE AS sentiment_score, len(regexp_extract_all(review_text, '\S+'))::INT AS text_length_words FROM doc_reviews""",
    (DOCS,),
)
def review_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.payload(doc_reviews(spark, sf_dir))


@query(
    r"""SELECT review_id AS id, regexp_replace(review_text, '^\s+|\s+$', '', 'g') AS document, source, product_name, product_category, display_name, strftime(review_date, '%Y-%m-%dT%H:%M:%S+00:00') AS review_date, 0 AS aspect_count, 0.0::DOUBLE AS sentiment_score, '' AS sentiment_label, source_url
    FROM doc_reviews WHERE length(regexp_replace(review_text, '^\s+|\s+$', '', 'g')) >= 20""",
    (DOCS,),
)
def embedding_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("metadata")
    names = ["source", "product_name", "product_category", "display_name", "review_date", "aspect_count", "sentiment_score", "sentiment_label", "source_url"]
    return retrieval.payloads(doc_reviews(spark, sf_dir)).select("id", "document", *(m[c].alias(c) for c in names))


_NAMED = """n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'B0' || lpad(p_partkey::VARCHAR, 9, '0') WHEN 1 THEN ' Unknown Item ' WHEN 2 THEN 'Amazon Electronics Item B0X' WHEN 3 THEN ' ' || p_name || ' ' WHEN 4 THEN '' ELSE p_name END AS title FROM part)"""


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    title = F.when(k == 0, F.concat(F.lit("B0"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))).when(k == 1, " Unknown Item ").when(k == 2, "Amazon Electronics Item B0X").when(k == 3, F.concat(F.lit(" "), "p_name", F.lit(" "))).when(k == 4, "").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", title.alias("title"))


@query(
    f"""SELECT p_partkey, CASE WHEN trim(title) <> '' AND NOT regexp_matches(trim(title), '^[A-Za-z0-9_-]{{10,}}$') AND NOT starts_with(lower(trim(title)), 'amazon electronics item ') AND lower(trim(title)) NOT IN ({", ".join(repr(x) for x in STOCK_NAMES)}) THEN trim(title) END AS title,
    trim(title) = '' OR regexp_matches(trim(title), '^[A-Za-z0-9_-]{{10,}}$') AS machine_id FROM n""",
    (_NAMED,),
)
def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("p_partkey", reviews.clean_title("title").alias("title"), reviews.machine_id("title").alias("machine_id"))


_KINDS = """k AS (SELECT doc_id, (doc_id % 9)::INT AS m, ['amazon', 'yelp', 'ebay', 'reddit'][1 + doc_id % 4] AS source, 'B0' || lpad((doc_id % 36)::VARCHAR, 10, '0') AS name FROM documents)"""


@query(
    ", r AS (SELECT source, CASE WHEN m = 8 THEN lang_name ELSE name END AS product_name, CASE WHEN m = 0 THEN 'Title ' || name END AS title, CASE WHEN m = 1 THEN 'slug of ' || right(name, 2) END AS slug, CASE WHEN m IN (2, 3) THEN 'Shown' WHEN m = 4 THEN 'Other' || doc_id END AS shown "
    "FROM (SELECT *, 'Plain name' AS lang_name FROM k)), c AS (SELECT source, product_name, shown, count(*) AS n FROM r WHERE shown IS NOT NULL GROUP BY ALL), u AS (SELECT source, product_name, arg_max(shown, (n, shown)) AS usual, max(n) AS most, sum(n) AS every FROM c GROUP BY ALL) "
    "SELECT source, product_name, coalesce(max(title), CASE WHEN product_name = 'Plain name' THEN product_name END, max(slug), max(CASE WHEN most >= 2 AND most >= 0.6 * every THEN usual END), CASE source "
    + " ".join(f"WHEN '{s}' THEN '{f.split('{}')[0]}' || product_name || '{f.split('{}')[1]}'" for s, f in FALLBACKS.items())
    + " ELSE product_name END) AS product_label FROM r LEFT JOIN u USING (source, product_name) GROUP BY source, product_name",
    (_KINDS,),
)
def product_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of the cascade decides for some product: titles, telling names, links, usual names, stock phrases."""
    i, m = F.col("doc_id"), F.col("doc_id") % 9
    name = F.concat(F.lit("B0"), F.lpad((i % 36).cast("string"), 10, "0"))
    source = F.element_at(F.array(*map(F.lit, ("amazon", "yelp", "ebay", "reddit"))), (1 + i % 4).cast("int"))
    rows = table(spark, sf_dir, "documents").select(
        source.alias("source"), F.when(m == 8, " Plain name ").otherwise(name).alias("product_name"), F.when(m == 0, F.concat(F.lit("Title "), name)).otherwise("unknown").alias("product_title"),
        F.when(m == 1, F.concat(F.lit("https://shop.example/slug-of_"), F.right(name, F.lit(2)), F.lit("/dp/"), name)).otherwise(F.concat(F.lit("https://shop.example/"), name, F.lit("/dp/x"))).alias("source_url"),
        F.when(m.isin(2, 3), "Shown").when(m == 4, F.concat(F.lit("Other"), i)).alias("display_name"),
    )
    return reviews.product_labels(rows).select("source", "product_name", "product_label")


@query(
    """, t AS (SELECT name AS product_name, 'T' || name AS product_title FROM k WHERE doc_id < 36 AND doc_id % 5 = 0)
    SELECT doc_id, coalesce(CASE WHEN source = 'amazon' THEN product_title END, CASE WHEN m = 8 THEN 'Plain name' WHEN source = 'amazon' THEN 'Amazon Product (ASIN ' || name || 'LONGER)' ELSE name || 'LONGER' END) AS product_label FROM k LEFT JOIN t ON t.product_name || 'LONGER' = CASE WHEN m = 8 THEN '' ELSE k.name || 'LONGER' END""",
    (_KINDS,),
)
def attached_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels on result rows, with a dimension of titles for Amazon."""
    i = F.col("doc_id")
    name = F.concat(F.lit("B0"), F.lpad((i % 36).cast("string"), 10, "0"), F.lit("LONGER"))
    source = F.element_at(F.array(*map(F.lit, ("amazon", "yelp", "ebay", "reddit"))), (1 + i % 4).cast("int"))
    docs = table(spark, sf_dir, "documents").select(i, source.alias("source"), F.when(i % 9 == 8, "Plain name").otherwise(name).alias("product_name"))
    titles = table(spark, sf_dir, "documents").where("doc_id < 36 and doc_id % 5 = 0").select(name.alias("product_name"), F.concat(F.lit("T"), F.substring(name, 1, 12)).alias("product_title"))
    return warehouse.attach_labels(docs, titles).select("doc_id", "product_label")


@query(
    """SELECT doc_id, CASE source WHEN 'amazon' THEN CASE m WHEN 0 THEN 'Amazon Product Review' WHEN 1 THEN 'Shown' ELSE 'Amazon Electronics Item ' || name END WHEN 'yelp' THEN CASE m WHEN 1 THEN 'Shown' ELSE 'Yelp Business Review' END
        WHEN 'ebay' THEN CASE m WHEN 0 THEN 'unknown' WHEN 1 THEN 'Shown' ELSE name END ELSE CASE m WHEN 1 THEN 'Shown' ELSE 'Reddit Discussion' END END AS display_name,
    CASE WHEN m = 2 THEN 'Shelf' ELSE CASE source WHEN 'amazon' THEN 'Electronics Product' WHEN 'yelp' THEN 'Local Business' WHEN 'ebay' THEN CASE WHEN m > 4 THEN 'Category' ELSE 'Marketplace Listing' END ELSE CASE WHEN m > 4 THEN 'Category' ELSE 'Forum Discussion' END END END AS display_category,
    CASE source WHEN 'amazon' THEN 'product_review' WHEN 'yelp' THEN 'business_review' WHEN 'ebay' THEN 'listing_review' ELSE 'forum_post' END AS entity_type FROM k""",
    (_KINDS,),
)
def shown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, m = F.col("doc_id"), F.col("doc_id") % 9
    name = F.concat(F.lit("B0"), F.lpad((i % 36).cast("string"), 10, "0"))
    source = F.element_at(F.array(*map(F.lit, ("amazon", "yelp", "ebay", "reddit"))), (1 + i % 4).cast("int"))
    docs = table(spark, sf_dir, "documents").select(i, source.alias("source"), F.when(m == 0, "unknown").otherwise(name).alias("product_name"), F.when(m == 1, "Shown").alias("display_name"), F.when(m == 2, " Shelf").alias("display_category"), F.when(m > 4, "Category").alias("product_category"), F.lit("").alias("entity_type"))
    return warehouse.shown_names(docs).select("doc_id", "display_name", "display_category", "entity_type")


@query("SELECT review_id, source, coalesce(nullif(trim(product_name), ''), display_name) AS product_label, rating_normalized, '' AS sentiment_label, '' AS aspect_labels, helpful_votes, source_url FROM doc_reviews", (DOCS,))
def explorer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.explorer_table(doc_reviews(spark, sf_dir)).drop("review_date")


# --- filters --------------------------------------------------------------------------------------


@query("SELECT review_id FROM sale_reviews WHERE lower(product_name) = (SELECT lower(p_name) FROM part ORDER BY p_partkey LIMIT 1) AND review_date <= TIMESTAMP '1996-06-30 12:00:00' AND review_date >= TIMESTAMP '1994-01-01'", (SALES,))
def filter_product_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ReviewFilter(product=f" {some_products(spark, sf_dir)[0].upper()} ", date_start="1994-01-01", date_end="1996-06-30 12:00:00")
    return f.apply(sale_reviews(spark, sf_dir)).select("review_id")


@query("SELECT review_id FROM sale_reviews WHERE (review_text ILIKE '%d_widg%' OR product_name ILIKE '%d_widg%' OR product_category ILIKE '%d_widg%' OR aspect_labels ILIKE '%d_widg%') AND source ILIKE '2-high' AND product_category ILIKE '%eco%' AND rating_normalized >= 0.5 AND sentiment_label ILIKE 'NEUTRAL'", (SALES,))
def table_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter as a warehouse has it: patterns, column by column."""
    d = sale_reviews(spark, sf_dir).withColumn("display_name", F.lit(None).cast("string"))
    return d.where(warehouse.table_condition(ReviewFilter(query="d_widg", source="2-high", category="eco", min_rating=0.5, sentiment="NEUTRAL"), d.columns, True)).select("review_id")


@query("SELECT least(count(*), 500) AS rows_scanned, count(*) >= 500 AS scan_limited, 500 AS max_rows FROM lineitem")
def scan_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = warehouse.Scan.of(table(spark, sf_dir, "lineitem"), 500).metadata()
    return spark.createDataFrame([said], "rows_scanned long, scan_limited boolean, max_rows int")


# --- scalar functions -----------------------------------------------------------------------------


@query(
    """SELECT doc_id, m, CASE m WHEN 0 THEN doc_id + 0.7 WHEN 1 THEN -3 WHEN 4 THEN 1e3 END::DOUBLE AS number, CASE m WHEN 0 THEN doc_id WHEN 1 THEN -3 WHEN 4 THEN 1000 END::INT AS whole,
    CASE m WHEN 0 THEN make_timestamp(doc_id * 1000000 + 700000) WHEN 1 THEN make_timestamp(-3000000) WHEN 4 THEN make_timestamp(1000000000) END AS seconds,
    CASE WHEN doc_id % 3 = 0 THEN make_timestamp((1600000000 + doc_id) * 1000000) WHEN doc_id % 3 = 1 THEN TIMESTAMP '2020-02-29 12:30:00' END AS any_time,
    strftime(make_timestamp(doc_id * 86400000000), '%Y-%m') AS month, strftime(make_timestamp(doc_id * 86400000000), '%Y-%m-%dT%H:%M:%S+00:00') AS iso
    FROM (SELECT doc_id, (doc_id % 5)::INT AS m FROM documents)"""
)
def value_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and times as text, some of which can't be read."""
    i, m = F.col("doc_id"), (F.col("doc_id") % 5).cast("int")
    x = F.when(m == 0, F.concat(i.cast("string"), F.lit(".7"))).when(m == 1, " -3 ").when(m == 2, "NaN").when(m == 3, "many").otherwise("1e3")
    at = F.when(i % 3 == 0, (1_600_000_000 + i).cast("string")).when(i % 3 == 1, "2020-02-29T14:30:00+02:00").otherwise("29.2.2020")
    days = F.timestamp_seconds(i * 86_400)
    ntz = lambda c: c.cast(NTZ)
    return table(spark, sf_dir, "documents").withColumns({"x": x, "at": at, "m": m}).select(
        "doc_id", "m", values.number("x").alias("number"), values.whole_number("x").alias("whole"), ntz(values.epoch_seconds("x")).alias("seconds"), ntz(values.iso_or_epoch("at")).alias("any_time"), values.month(days).alias("month"), values.iso_text(days).alias("iso"),
    )


@query(
    r"""SELECT conv_id, turn, '{' || role || '}' AS unfenced, CASE (conv_id % 4) WHEN 3 THEN NULL ELSE lpad(conv_id::VARCHAR, 11, 'v') END AS video, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 240) AS quote,
    len(list_filter(list_transform(string_split(text, ','), lambda x: lower(trim(x))), lambda x: x <> ''))::INT AS items, upper(left(role, 1)) || lower(substr(role, 2)) || ' Item' AS title, text AS joined FROM conversations WHERE trim(text) <> ''"""
)
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code fences, video links, quotes, lists and labels."""
    m, v = F.col("conv_id") % 4, F.lpad(F.col("conv_id").cast("string"), 11, "v")
    url = F.when(m == 0, F.concat(F.lit("https://youtube.com/watch?a=1&v="), v)).when(m == 1, F.concat(F.lit(" https://youtu.be/"), v, F.lit("?t=3"))).when(m == 2, F.concat(F.lit("https://youtube.com/embed/"), v)).otherwise("no link")
    d = table(spark, sf_dir, "conversations").where("trim(text) <> ''").withColumns({"url": url, "fenced": F.concat(F.lit("```json\n{"), "role", F.lit("}\n``` ")), "named": F.concat("role", F.lit("_item")), "blank": F.lit(" ")})
    return d.select("conv_id", "turn", text.unfenced("fenced").alias("unfenced"), text.video_id("url").alias("video"), text.quote("text").alias("quote"), F.size(text.csv_items("text")).alias("items"), text.title_case("named").alias("title"), text.joined_text("blank", "text").alias("joined"))


@query(
    """SELECT doc_id, round(CASE WHEN doc_id % 7 IN (0, 5) THEN 2 * c - 1 WHEN doc_id % 7 IN (1, 3) THEN 1 - 2 * c ELSE 0 END, 4) + 0.0 AS score
    FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 0.5 ELSE least(1, greatest(0, (doc_id % 121 - 10) / 100)) END AS c FROM documents)"""
)
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier's labels and confidences, some below a half, above one, missing or unreadable, as signed scores."""
    i = F.col("doc_id")
    name = F.element_at(F.array(*map(F.lit, ("POSITIVE", "label_0", "3 stars", "very negative", "Neutral", " rather positive", "other"))), (1 + i % 7).cast("int"))
    sure = F.when(i % 22 == 0, "unknown").when(i % 11 != 0, ((i % 121 - 10) / 100).cast("string"))
    return table(spark, sf_dir, "documents").select(i, (sentiment.model_score(name, sure) + 0.0).alias("score"))


@query(
    ", c AS (SELECT review_id, pos, trim(s) AS s, list_distinct(list_filter(regexp_split_to_array(lower(trim(s)), '\\s+'), lambda w: w <> '')) AS w FROM (SELECT review_id, unnest(x) AS s, unnest(range(len(x))) AS pos FROM (SELECT review_id, regexp_split_to_array(review_text, '[.!?]+') AS x FROM doc_reviews)) WHERE length(regexp_replace(s, '^\\s+|\\s+$', '', 'g')) >= 10), "
    + "k(aspect, words) AS (VALUES ('past', 'was'), ('link', 'and|or')), "
    + "m AS (SELECT review_id, aspect, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS s, len(list_filter(w, lambda x: x IN ('the', 'best', 'and'))) AS p, len(list_filter(w, lambda x: x IN ('on', 'that', 'with', 'was'))) AS n FROM c JOIN k ON regexp_matches(lower(s), words) QUALIFY row_number() OVER (PARTITION BY review_id, aspect ORDER BY pos) = 1) "
    + "SELECT review_id, aspect, round(CASE WHEN p > n THEN least(0.5 + p * 0.2, 1) WHEN n > p THEN greatest(-0.5 - n * 0.2, -1) ELSE 0 END, 2)::DOUBLE AS sentiment, substr(s, 1, 150) AS quote FROM m",
    (DOCS,),
)
def first_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarser aspect rule: each label once a text."""
    d = doc_reviews(spark, sf_dir, costly=True).select("review_id", "review_text")
    return aspects.first_mention_rows(d, "review_id", "review_text", {"past": ("was",), "link": ("and", "or")}, POSITIVE, NEGATIVE)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, 1.0 AS unit_norm, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS dot FROM embeddings")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return v.select("vec_id", F.round(values.norm("embedding"), 6).alias("norm"), F.round(values.norm(values.unit("embedding")), 6).alias("unit_norm"), F.round(values.dot("embedding", "embedding"), 6).alias("dot"))


# --- indexes, reports, exploration ----------------------------------------------------------------


@query(
    r"""SELECT term, count(*) AS documents, sum(n)::BIGINT AS occurrences FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(CASE WHEN doc_id % 10 = 3 THEN 'replaced text ' || lang ELSE text END), '[\p{L}\p{N}]+')) AS term FROM documents WHERE doc_id % 10 <> 7) GROUP BY ALL) GROUP BY term"""
)
def postings_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text index after a tenth of the documents were replaced and another tenth deleted."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    changed = d.where("doc_id % 10 = 3").withColumn("text", F.concat(F.lit("replaced text "), "lang"))
    found = retrieval.updated_postings(retrieval.postings(d, "doc_id", "text"), changed, d.where("doc_id % 10 = 7"), "doc_id", "text")
    return found.groupBy("term").agg(F.count("*").alias("documents"), F.sum("occurrences").alias("occurrences"))


@query(
    f""", w AS (SELECT lower(p_name) AS product_key FROM ({PRODUCTS}) UNION SELECT 'no such thing'), c AS (SELECT lower(product_name) AS product_key, lower(source) AS source, count(*) AS n FROM sale_reviews GROUP BY ALL),
    t AS (SELECT lower(product_name) AS product_key, aspect, count(*) AS n, row_number() OVER (PARTITION BY lower(product_name) ORDER BY count(*) DESC, aspect) AS rank FROM a WHERE sentiment_label = 'negative' GROUP BY 1, 2)
    SELECT product_key, (SELECT count(*) FROM sale_reviews WHERE lower(product_name) = product_key) AS review_count, (SELECT coalesce(string_agg(source || ':' || n, ',' ORDER BY source), '') FROM c WHERE c.product_key = w.product_key) AS sources,
    (SELECT coalesce(string_agg(aspect, ',' ORDER BY rank), '') FROM t WHERE t.product_key = w.product_key AND rank <= 5) AS negative_aspects FROM w""",
    (SALES, ASPECT_ROWS),
)
def product_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.product_report(sale_reviews(spark, sf_dir), some_products(spark, sf_dir))
    sources = F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["source"], s["review_count"])), ",")
    return found.select("product_key", "review_count", F.coalesce(sources, F.lit("")).alias("sources"), F.coalesce(F.array_join(F.transform("negative_aspects", lambda a: a["aspect"]), ","), F.lit("")).alias("negative_aspects"))


@query(f"SELECT lower(product_name) AS product_key, count(*) AS review_count FROM sale_reviews WHERE product_name IN ({PRODUCTS}) GROUP BY 1", (SALES,))
def reviewed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.reviewed_only(analytics.compare_products(sale_reviews(spark, sf_dir), some_products(spark, sf_dir))).select("product_key", "review_count")


@query("SELECT count(*) AS items, count(*) FILTER (doc_id % 3 = 0) AS pending, round(avg((doc_id % 100) / 100), 4) AS average_confidence FROM documents")
def queue_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return eda.queue_summary(table(spark, sf_dir, "documents").select(F.when(i % 3 == 0, "Pending").otherwise("done").alias("status"), (i % 100 / 100).alias("confidence")))


@query("SELECT count(DISTINCT source) AS groups, round(avg(length(text)), 2) AS average_length, min(doc_id) AS min_score, max(doc_id) AS max_score FROM documents")
def forum_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.text_summary(table(spark, sf_dir, "documents"), "source", "text", "doc_id")


@query("SELECT field, null_percent FROM (SELECT " + ", ".join(f"round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 4)::DOUBLE AS {c}" for c in ("quality", "toxic", "text", "lang")) + " FROM documents LEFT JOIN labels USING (doc_id)) UNPIVOT (null_percent FOR field IN (quality, toxic, text, lang))")
def null_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return eda.null_shares(d.select("quality", "toxic", "text", "lang"))


@query("SELECT lower(product_name) AS product_key, round(avg(rating_normalized), 4) AS average_rating FROM sale_reviews GROUP BY 1", (SALES,))
def average_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.average_ratings(sale_reviews(spark, sf_dir))

"""The test tables seen as reviews; ``catalog`` has the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import scaled
from ..session import spread

#: Words that the synthetic prose has: the lexicons and aspects that exercise every branch on it.
POSITIVE, NEGATIVE = ("the", "best", "and"), ("on", "that", "with", "was")
ASPECTS = {"place": ("in", "on", "at"), "link": ("and", "or"), "past": ("was",), "price": ("price", "cost")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_reviews(spark: SparkSession, sf_dir: str, costly: bool = False) -> DataFrame:
    """Documents as reviews. ``costly``: what follows is worth dealing them out to all cores."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    docs = spread(docs.select("doc_id", "text", "lang", "source")) if costly else docs
    rating = labels.groupBy("doc_id").agg(F.max("quality").cast("double").alias("rating_normalized"))
    return docs.join(rating, "doc_id", "left").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("review_id"), F.col("lang").alias("product_name"), F.concat(F.lit("text_"), "lang").alias("product_category"), "source",
        "rating_normalized", F.col("text").alias("review_text"), F.concat(F.lit("user_"), F.pmod("doc_id", F.lit(97)).cast("string")).alias("reviewer_id"),
        F.timestamp_seconds(1_600_000_000 + F.col("doc_id") * 40_000).alias("review_date"), F.lit(None).cast("boolean").alias("verified_purchase"),
        F.pmod("doc_id", F.lit(7)).cast("int").alias("helpful_votes"), F.concat(F.lit("https://shop.example/"), "lang", F.lit("-reader/dp/"), F.col("doc_id").cast("string")).alias("source_url"),
        F.col("lang").alias("display_name"), F.col("lang").alias("display_category"), F.lit("document").alias("entity_type"),
    )


def sale_reviews(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """Line items as reviews; ids are not unique, so deduplication has work. ``placed``: with each row's place in its table."""
    line, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    line = line.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place")) if placed else line
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(part, line.l_partkey == part.p_partkey, "left")
    return joined.select(
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("review_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("product_category"), F.col("o_orderpriority").alias("source"),
        scaled("l_quantity", 1, 50).alias("rating_normalized"), F.concat("p_name", F.lit(" "), "l_returnflag", F.lit(" "), "p_brand").alias("review_text"), F.col("l_shipdate").cast("timestamp").alias("review_date"),
        F.col("o_custkey").cast("string").alias("reviewer_id"), (F.col("l_linestatus") == "O").alias("verified_purchase"), F.col("l_linenumber").alias("helpful_votes"),
        F.concat(F.lit("https://shop.example/"), F.col("l_suppkey").cast("string")).alias("source_url"), F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "R", "negative").otherwise("neutral").alias("sentiment_label"),
        F.round(F.col("l_discount") * 10 - F.col("l_tax") * 5, 4).alias("sentiment_score"),
        F.concat_ws(", ", F.col("p_brand"), F.when(F.col("l_quantity") > 25, "Bulk"), F.col("l_linestatus")).alias("aspect_labels"), *(["place"] if placed else []),
    )

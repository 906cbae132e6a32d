"""Exploration: shares, histograms and trends of a review sample, and the evaluation of extracted aspects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import aspects
from ..functions.text import word_count
from ..functions.values import month, rating_bin


def sample(df: DataFrame, most: int = 100_000) -> DataFrame:
    """The first rows of a dataset, for a look at it: the cap is the feature."""
    return df.limit(most)


def save_sample(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A sample as one folder of parquet, for notebooks and charts."""
    sample(df, most).write.mode("overwrite").parquet(path)


def chart_data(df: DataFrame) -> dict[str, DataFrame]:
    """What each chart of an exploration shows, as small frames by the chart's name: only those whose columns ``df`` has.

    A chart reads its frame and no reviews. Each has as many rows as the chart has marks.
    """
    have = set(df.columns)
    rated = F.col("rating") if "rating" in have else F.col("rating_normalized")
    charts = {
        "missing_values": (set(), lambda: null_shares(df)),
        "ratings": ({"rating"} & have or {"rating_normalized"}, lambda: shares(df.select(rated.alias("rating")), "rating")),
        "text_lengths": ({"review_text"}, lambda: length_histogram(df)),
        "reviews_by_month": ({"review_date"}, lambda: monthly(df)),
        "top_products": ({"product_name"}, lambda: top_products(df)),
        "verified_ratings": ({"verified", "rating_normalized"}, lambda: verified_density(df)),
    }
    return {name: make() for name, (needs, make) in charts.items() if needs <= have}


def save_charts(df: DataFrame, path: str) -> list[str]:
    """``chart_data`` as parquet, a folder a chart; their names."""
    found = chart_data(df)
    for name, rows in found.items():
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
    return sorted(found)


def null_shares(df: DataFrame) -> DataFrame:
    """(field, null_percent), in order of the columns' names."""
    wide = df.agg(*(F.round(F.count_if(F.col(c).isNull()) * 100 / F.count("*"), 4).alias(c) for c in df.columns))
    return wide.unpivot([], list(df.columns), "field", "null_percent").orderBy("field")


def overview(df: DataFrame) -> DataFrame:
    """One row of numbers. The median is exact: its aggregate holds a count of every different number of words, some thousands."""
    words = word_count("review_text")
    n = F.count("*")
    return df.agg(
        n.alias("record_count"), F.round(F.avg("rating"), 4).alias("mean_rating"), F.min("rating").alias("min_rating"), F.max("rating").alias("max_rating"),
        F.round(F.count_if(words == 0) / n, 4).alias("empty_text_share"), F.round(F.avg(words), 2).alias("mean_words"), F.percentile(words, 0.5).alias("median_words"),
        F.round(F.avg(F.col("verified").cast("int")), 4).alias("verified_share"), F.round(F.count_if(F.col("votes") == 0) / n, 4).alias("no_votes_share"),
        F.min("review_date").alias("min_date"), F.max("review_date").alias("max_date"), F.round(F.count_if(F.year("review_date") >= 2015) / n, 4).alias("since_2015_share"),
    )


def shares(df: DataFrame, c: str) -> DataFrame:
    """(c, review_count, percent of all)."""
    found = df.groupBy(c).agg(F.count("*").alias("review_count"))
    return found.withColumn("percent", F.round(F.col("review_count") * 100 / F.sum("review_count").over(Window.partitionBy()), 4)).orderBy(c)


def length_histogram(df: DataFrame, bins: int = 50, most: int = 500) -> DataFrame:
    """(bin, review_count) of word counts, longer texts in the last bin."""
    width = most / bins
    b = F.least(F.floor(F.least(word_count("review_text"), F.lit(most)) / width), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("review_count")).orderBy("bin")


def monthly(df: DataFrame) -> DataFrame:
    return df.where("review_date is not null").groupBy(month("review_date").alias("month")).agg(F.count("*").alias("review_count")).orderBy("month")


def top_products(df: DataFrame, k: int = 20) -> DataFrame:
    return df.groupBy("product_name").agg(F.count("*").alias("review_count")).orderBy(F.desc("review_count"), "product_name").limit(k)


def verified_density(df: DataFrame) -> DataFrame:
    """Of verified and other reviews, the share in each rating bin."""
    found = df.where("rating_normalized is not null and verified is not null").groupBy("verified", rating_bin("rating_normalized").alias("rating_bin")).agg(F.count("*").alias("n"))
    return found.withColumn("density", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("verified")), 4)).select("verified", "rating_bin", "density")


def text_summary(df: DataFrame, group: str, text: str, score: str) -> DataFrame:
    return df.agg(F.count_distinct(group).alias("groups"), F.round(F.avg(F.length(text)), 2).alias("average_length"), F.min(score).alias("min_score"), F.max(score).alias("max_score"))


def queue_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("items"), F.count_if(F.lower("status") == "pending").alias("pending"), F.round(F.avg("confidence"), 4).alias("average_confidence"))


def evaluate(golden: DataFrame, extracted=None) -> DataFrame:
    """Precision, recall, F1 and agreement in sign of aspects found in ``text`` with ``expected`` (aspect, sign)."""
    found = aspects.extract("text") if extracted is None else extracted
    rows = golden.withColumn("_found", found)
    names = F.transform("expected", lambda e: e["aspect"])
    got = F.transform("_found", lambda a: a["aspect"])
    sign = lambda s: F.when(s > 0, "positive").when(s < 0, "negative").otherwise("neutral")
    agree = F.size(F.filter("expected", lambda e: F.exists("_found", lambda a: (a["aspect"] == e["aspect"]) & (sign(a["sentiment"]) == e["sign"]))))
    totals = rows.agg(F.sum(F.size(F.array_intersect(names, got))).alias("hit"), F.sum(F.size(F.array_distinct(names))).alias("want"), F.sum(F.size(F.array_distinct(got))).alias("got"), F.sum(agree).alias("agree"))
    p, r = F.try_divide("hit", "got"), F.try_divide("hit", "want")
    return totals.select(F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 4).alias("f1"), F.round(F.try_divide("agree", "hit"), 4).alias("sign_accuracy"))

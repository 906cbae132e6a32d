"""Reviews: filters, features, one row per review, pages and labels."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import authenticity, text
from ..functions.text import folded, strip
from ..functions.values import iso_text

SEARCHED = ("review_text", "product_name", "product_category", "display_name", "display_category", "source", "aspect_labels")
MACHINE_ID = r"^[A-Za-z0-9_-]{10,}$"
#: Names that stand for no product, and what names one otherwise, by source.
STOCK_NAMES = ("amazon product review", "yelp business review", "ebay listing", "ifixit guide", "reddit discussion", "youtube review", "unknown item", "unknown")
FALLBACKS = {"amazon": "Amazon Product (ASIN {})", "yelp": "Yelp Business ({})", "ebay": "eBay Listing ({})", "ifixit": "iFixit Guide ({})", "youtube": "YouTube Review ({})", "reddit": "Reddit Discussion ({})"}


@dataclass(frozen=True)
class ReviewFilter:
    """All conditions that are set hold; a condition on a column that a frame lacks lets nothing through."""

    query: str | None = None
    source: str | None = None
    sentiment: str | None = None
    product: str | None = None
    category: str | None = None
    min_rating: float | None = None
    max_rating: float | None = None
    date_start: datetime | str | None = None
    date_end: datetime | str | None = None

    def condition(self, columns: list[str]) -> Column:
        have = set(columns)
        tests: list[Column] = []

        def on(name: str, value, test) -> None:
            if value is not None and value != "":
                tests.append(test(value) if name in have else F.lit(False))

        equal = lambda name: lambda v: folded(name) == str(v).strip().lower()
        on("source", self.source, equal("source"))
        on("sentiment_label", self.sentiment, equal("sentiment_label"))
        on("product_name", self.product, equal("product_name"))
        on("product_category", self.category, lambda v: F.contains(folded("product_category"), F.lit(str(v).strip().lower())))
        on("rating_normalized", self.min_rating, lambda v: F.col("rating_normalized") >= v)
        on("rating_normalized", self.max_rating, lambda v: F.col("rating_normalized") <= v)
        on("review_date", self.date_start, lambda v: F.col("review_date") >= F.lit(v).cast("timestamp"))
        on("review_date", self.date_end, lambda v: F.col("review_date") <= F.lit(v).cast("timestamp"))
        if self.query and self.query.strip():
            searched = F.concat_ws(" ", *(folded(c) for c in SEARCHED if c in have))
            tests.append(F.contains(searched, F.lit(self.query.strip().lower())))
        out = F.lit(True)
        for t in tests:
            out = out & t
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.condition(df.columns))


def features(df: DataFrame, column: str = "review_text") -> DataFrame:
    return df.withColumns({
        "text_length_words": text.word_count(column).cast("int"),
        "text_length_chars": F.coalesce(F.length(column), F.lit(0)).cast("int"),
        "caps_ratio": text.caps_ratio(column),
        "exclamation_ratio": text.exclamation_ratio(column),
    })


def latest(df: DataFrame, key: str = "review_id") -> DataFrame:
    """One row per review: the latest, ties going to the lesser text and then the lesser link.

    ``row_number() = 1`` prunes to a row per key before the shuffle, so a key
    with very many rows doesn't meet in one task.
    """
    w = Window.partitionBy(key).orderBy(F.col("review_date").desc_nulls_last(), F.col("review_text").asc_nulls_last(), F.col("source_url").asc_nulls_last())
    return df.withColumn("_tp_rank", F.row_number().over(w)).where("_tp_rank = 1").drop("_tp_rank")


def genuine(df: DataFrame, column: str = "review_text", threshold: float = 0.7, observed: Observation | None = None) -> DataFrame:
    """Without reviews that are likely fake. ``observed`` receives removed_count, when rows are read."""
    found = authenticity.scored(df, column, threshold)
    fake = F.col("risk.label") == "likely_fake"
    if observed is not None:
        found = found.observe(observed, F.count_if(fake).alias("removed_count"))
    # a filter on the label itself would go below the projections, with all rules' texts and words worked out again wherever they are named
    return found.withColumn("_tp_fake", F.explode(F.array(fake))).where("not _tp_fake").drop("risk", "_tp_fake")


def payload(df: DataFrame) -> DataFrame:
    """The fields that answers show, with defaults."""
    filled = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in df.columns else F.lit(d)
    return df.select(
        "review_id", filled("product_name", "").alias("product_name"), filled("product_category", "").alias("product_category"), folded("source").alias("source"),
        F.col("rating_normalized").cast("double").alias("rating_normalized"), filled("review_text", "").alias("review_text"), iso_text("review_date").alias("review_date"),
        filled("reviewer_id", "unknown").alias("reviewer_id"), filled("source_url", "").alias("source_url"), filled("aspect_labels", "").alias("aspect_labels"),
        (folded("sentiment_label") if "sentiment_label" in df.columns else F.lit("")).alias("sentiment_label"),
        (F.col("sentiment_score").cast("double") if "sentiment_score" in df.columns else F.lit(None).cast("double")).alias("sentiment_score"),
        text.word_count("review_text").cast("int").alias("text_length_words"),
    )


def page(df: DataFrame, limit: int = 25, offset: int = 0, filters: ReviewFilter | None = None) -> DataFrame:
    """Reviews that match, latest first, then by id."""
    if not (1 <= limit <= 100) or offset < 0:
        raise ValueError("limit is 1 to 100 and offset at least 0")
    return (filters or ReviewFilter()).apply(df).orderBy(F.col("review_date").desc_nulls_last(), "review_id").offset(offset).limit(limit)


def machine_id(c: Column | str) -> Column:
    t = strip(F.col(c) if isinstance(c, str) else c)
    return (t == "") | t.rlike(MACHINE_ID)


def clean_title(c: str) -> Column:
    """A title that names a product; null for ids and stock names."""
    t = strip(F.coalesce(F.col(c), F.lit("")))
    low = F.lower(t)
    return F.when(~machine_id(t) & ~F.startswith(low, F.lit("amazon electronics item ")) & ~low.isin(*STOCK_NAMES), t)


def title_from_url(c: str) -> Column:
    """The slug before /dp/ in a product link, if it isn't an id."""
    parts = F.filter(F.transform(F.split(F.try_parse_url(strip(F.col(c)), F.lit("PATH")), "/"), lambda p: F.trim(p)), lambda p: p != "")
    at = F.array_position(parts, "dp")
    slug = F.trim(F.regexp_replace(F.get(parts, at.cast("int") - 2), r"[-_\s]+", " "))
    return F.when((at > 1) & (slug != "") & ~machine_id(F.replace(slug, F.lit(" "), F.lit(""))), slug)


def product_labels(df: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(source, product_name, product_label): a title, a telling name, a link's slug, the usual display name, or a stock phrase.

    ``titles`` (product_name, product_title) is a dimension of Amazon products.
    """
    if titles is not None:
        one = titles.groupBy("product_name").agg(F.max("product_title").alias("_title"))
        df = df.join(one, "product_name", "left")
        known = F.when(folded("source") == "amazon", F.col("_title"))
        df = df.withColumn("product_title", F.coalesce(F.col("product_title"), known) if "product_title" in df.columns else known)
    elif "product_title" not in df.columns:
        df = df.withColumn("product_title", F.lit(None).cast("string"))
    rows = df.select(folded("source").alias("source"), strip(F.coalesce("product_name", F.lit(""))).alias("product_name"), clean_title("product_title").alias("title"), title_from_url("source_url").alias("slug"), F.col("display_name").alias("display"))
    by = ["source", "product_name"]
    # names are counted before anything is ranked
    shown = rows.where("display is not null").groupBy(*by, "display").agg(F.count("*").alias("n")).groupBy(*by).agg(F.max_by("display", F.struct("n", "display")).alias("display"), F.max("n").alias("most"), F.sum("n").alias("shown"))
    slugs = rows.where("slug is not null").groupBy(*by, "slug").agg(F.count("*").alias("n")).groupBy(*by).agg(F.max_by("slug", F.struct("n", "slug")).alias("slug"))
    each = rows.groupBy(*by).agg(F.max("title").alias("title")).join(shown, by, "left").join(slugs, by, "left")
    name = F.col("product_name")
    usual = F.when((F.col("most") >= 2) & (F.col("most") >= 0.6 * F.col("shown")), F.col("display"))
    stock = name
    for source, form in FALLBACKS.items():
        before, after = form.split("{}")
        stock = F.when(F.col("source") == source, F.concat(F.lit(before), name, F.lit(after))).otherwise(stock)
    stock = F.when(name == "", "Unknown Product").otherwise(stock)
    return each.select(*by, F.coalesce("title", F.when(~machine_id(name), name), "slug", usual, stock).alias("product_label"))

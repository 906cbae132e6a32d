"""Where each source keeps what the unified schema asks for, and the one projection that reads it.

A source is data: field names to try in order, bounds, prefixes, defaults.
``unify`` turns any of them into the unified schema, so adding a source adds a
spec. Raw schemas are explicit: reading infers nothing, and a field that a file
lacks is null.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_filled, joined_text
from ..functions.values import epoch_millis, epoch_seconds, iso_or_epoch, iso_time, scaled, whole_number
from ..schema import UNIFIED, align, struct

TIMES = {"iso": iso_time, "seconds": epoch_seconds, "millis": epoch_millis, "any": iso_or_epoch}


@dataclass(frozen=True)
class SourceSpec:
    """Fields are tried in order; the first filled one counts. Constants are defaults where all are missing."""

    name: str
    entity: str
    raw: str
    key: tuple[str, ...]  # parts of the id, joined by _
    key_fields: int = 1  # how many alternatives of ``key`` make one part (all of them: one part of alternatives)
    product: tuple[str, ...] = ()
    category: tuple[str, ...] = ()
    category_default: str = "unknown"
    rating: tuple[str, float, float] | None = None
    text: tuple[tuple[str, ...], ...] = (("text",),)  # parts, each with alternatives
    time: tuple[tuple[str, str], ...] = ()
    reviewer: tuple[str, ...] = ()
    votes: tuple[str, ...] = ()
    verified: str | None = None
    url: tuple[str, ...] = ("url",)
    url_prefix: str = ""
    url_key: tuple[str, ...] = ()
    display: tuple[str, ...] = ()
    display_default: str = "unknown"
    display_prefix_key: str | None = None  # the default is a prefix of this field
    shelf: tuple[str, ...] = ()
    shelf_default: str = ""
    shelf_first_of_list: bool = False

    @property
    def schema(self) -> T.StructType:
        return struct(self.raw)


SPECS = {
    s.name: s
    for s in (
        SourceSpec(
            "amazon", "product_review",
            "asin string, parent_asin string, user_id string, rating string, title string, text string, timestamp string, verified_purchase boolean, helpful_vote string, url string",
            key=("asin", "user_id"), key_fields=2, product=("parent_asin", "asin"), category_default="electronics", rating=("rating", 1, 5),
            text=(("title",), ("text",)), time=(("timestamp", "millis"),), reviewer=("user_id",), votes=("helpful_vote",), verified="verified_purchase",
            url_prefix="https://amazon.com/dp/", url_key=("asin",), display=("title",), display_default="Amazon Electronics Item ", display_prefix_key="asin",
            shelf_default="Electronics Product",
        ),
        SourceSpec(
            "yelp", "business_review",
            "review_id string, business_id string, user_id string, stars string, text string, date string, url string, name string, categories string",
            key=("review_id",), product=("name", "business_id"), category=("categories",), category_default="local_business", rating=("stars", 1, 5),
            time=(("date", "iso"),), reviewer=("user_id",), url_prefix="https://yelp.com/biz/", url_key=("business_id",), display=("name", "business_id"),
            shelf=("categories",), shelf_default="Local Business", shelf_first_of_list=True,
        ),
        SourceSpec(
            "ebay", "listing_review",
            "item_id string, title string, item_title string, category string, primary_category string, feedback_text string, review_text string, listing_date string, review_date string, "
            "seller_id string, seller string, reviewer_id string, feedback_count string, helpful_votes string, seller_rating string, url string",
            key=("item_id",), product=("title", "item_title", "item_id"), category=("category", "primary_category"), rating=("seller_rating", 0, 100),
            text=(("feedback_text", "review_text"),), time=(("listing_date", "iso"), ("review_date", "iso")), reviewer=("seller_id", "seller", "reviewer_id"),
            votes=("feedback_count", "helpful_votes"), url_prefix="https://www.ebay.com/itm/", url_key=("item_id",), display=("title", "item_title", "item_id"),
            shelf=("category", "primary_category"), shelf_default="Marketplace Listing",
        ),
        SourceSpec(
            "ifixit", "repair_review",
            "guide_id string, source_id string, device_name string, title string, device_category string, review_text string, text string, published_date string, author string, "
            "helpful_votes string, repairability_score string, url string",
            key=("guide_id", "source_id"), product=("device_name", "title", "guide_id"), category=("device_category",), category_default="repairability",
            rating=("repairability_score", 1, 10), text=(("review_text", "text"),), time=(("published_date", "any"),), reviewer=("author",), votes=("helpful_votes",),
            url_prefix="https://www.ifixit.com/Guide/", url_key=("guide_id", "source_id"), display=("title", "device_name", "guide_id"), shelf=("device_category",), shelf_default="Repair Guide",
        ),
        SourceSpec(
            "youtube", "video_transcript",
            "source_id string, video_id string, title string, text string, transcript string, published_date string, created_utc string, channel string, channel_id string, "
            "like_count string, url string, product_name string, product_category string",
            key=("source_id", "video_id"), product=("product_name",), category=("product_category",), text=(("text", "transcript"),),
            time=(("published_date", "iso"), ("created_utc", "seconds")), reviewer=("channel", "channel_id"), votes=("like_count",), display=("title",),
            display_default="YouTube Review", shelf_default="Video Review",
        ),
        SourceSpec(
            "reddit", "forum_post",
            "source_id string, title string, text string, subreddit string, created_utc string, author string, score string, url string, product_name string",
            key=("source_id",), product=("product_name",), category=("subreddit",), category_default="general", text=(("title",), ("text",)), time=(("created_utc", "seconds"),),
            reviewer=("author",), votes=("score",), display=("title",), display_default="Reddit Discussion", shelf=("subreddit",), shelf_default="general",
        ),
    )
}


def unified_columns(spec: SourceSpec) -> list[Column]:
    """The unified schema's columns, of records that have the source's raw ones."""
    unknown = F.lit("unknown")
    filled = lambda names, default: F.coalesce(first_filled(*names), default) if names else default
    parts = [spec.key] if spec.key_fields == 1 else [(k,) for k in spec.key]
    key = F.concat_ws("_", F.lit(spec.name), *(filled(p, unknown) for p in parts))
    default_name = F.lit(spec.display_default)
    if spec.display_prefix_key:
        default_name = F.concat(default_name, filled((spec.display_prefix_key,), unknown))
    default_url = F.concat(F.lit(spec.url_prefix), filled(spec.url_key, unknown)) if spec.url_prefix else F.lit("")
    shelf = filled(spec.shelf, F.lit(spec.shelf_default))
    if spec.shelf_first_of_list:
        shelf = F.trim(F.split(shelf, ",")[0])
    times: list[Column] = [TIMES[kind](name) for name, kind in spec.time]
    category = filled(spec.category, F.lit(spec.category_default))
    columns = {
        "review_id": key,
        "product_name": filled(spec.product, unknown),
        "product_category": category,
        "source": F.lit(spec.name),
        "rating_normalized": scaled(*spec.rating) if spec.rating else F.lit(None),
        "review_text": joined_text(*(first_filled(*p) for p in spec.text)),
        "review_date": F.coalesce(*times),
        "reviewer_id": filled(spec.reviewer, unknown),
        "verified_purchase": F.col(spec.verified) if spec.verified else F.lit(None),
        "helpful_votes": whole_number(first_filled(*spec.votes)) if spec.votes else F.lit(None),
        "source_url": filled(spec.url, default_url),
        "display_name": filled(spec.display, default_name),
        "display_category": shelf,
        "entity_type": F.lit(spec.entity),
    }
    return [columns[f.name].cast(f.dataType).alias(f.name) for f in UNIFIED]


def unify(raw: DataFrame, spec: SourceSpec) -> DataFrame:
    """Raw records of a source in the unified schema."""
    return align(raw, spec.schema).select(*unified_columns(spec))


def with_businesses(reviews: DataFrame, businesses: DataFrame | None) -> DataFrame:
    """Yelp reviews with their business's name and categories; one business per id, the last by name.

    Not hinted: adaptive execution broadcasts the businesses if they turn out small.
    """
    plain = reviews.drop("name", "categories")
    if businesses is None:
        return plain
    one = businesses.groupBy("business_id").agg(F.max_by(F.struct("name", "categories"), F.struct("name", "categories")).alias("b"))
    return plain.join(one.select("business_id", "b.name", "b.categories"), "business_id", "left")


def unified(raw: Mapping[str, DataFrame]) -> DataFrame:
    """All sources in one frame, by column name."""
    frames: Iterable[DataFrame] = (unify(df, SPECS[name]) for name, df in raw.items())
    return reduce(DataFrame.unionByName, frames)


# --- what connectors deliver, in the raw shapes above ---------------------------------------------


def ebay_records(items: DataFrame) -> DataFrame:
    """Search results (nested seller and categories) as raw eBay records."""
    return items.select(
        F.col("itemId").alias("item_id"), "title", F.element_at("categories", 1)["categoryName"].alias("category"), F.col("seller")["username"].alias("seller_id"),
        F.col("seller")["feedbackScore"].cast("string").alias("feedback_count"), F.replace(F.col("seller")["feedbackPercentage"].cast("string"), F.lit("%"), F.lit("")).alias("seller_rating"),
        F.col("itemWebUrl").alias("url"), F.col("itemCreationDate").alias("listing_date"),
    )


def ifixit_records(guides: DataFrame) -> DataFrame:
    """Guides (author as struct or text) as raw iFixit records."""
    kind = dict(guides.dtypes).get("author", "string")
    author = F.col("author")["username"] if kind.startswith("struct") else F.col("author")
    return align(guides.withColumn("author", author), SPECS["ifixit"].schema)


def youtube_records(videos: DataFrame) -> DataFrame:
    """Videos with transcript segments (text, duration) as raw YouTube records, with their length and number of segments."""
    s = F.col("segments")
    return videos.withColumns({
        "text": F.concat_ws(" ", F.transform(s, lambda x: F.trim(x["text"]))),
        "duration_seconds": F.aggregate(s, F.lit(0.0), lambda t, x: t + F.coalesce(x["duration"], F.lit(0.0))),
        "segment_count": F.size(s),
    }).drop("segments")


def explain(name: str, raw: DataFrame, at: int = 0) -> DataFrame:
    """(field, before, after) of the ``at``-th raw record in order of its fields: how normalization reads it."""
    spec = SPECS[name]
    one = align(raw, spec.schema).orderBy(*spec.schema.names).offset(at).limit(1)
    both = one.select(F.to_json(F.struct(*spec.schema.names)).alias("before"), F.struct(*unified_columns(spec)).alias("after"))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col("after")[f].cast("string").alias("after")) for f in UNIFIED.names))
    return both.select(F.explode(pairs).alias("p"), "before").select("p.field", "before", "p.after")

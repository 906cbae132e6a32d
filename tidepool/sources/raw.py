"""Raw JSON records as VARIANT: fields by name, the first filled of several, nested ones, and those that nobody expected.

Services rename and add fields. A VARIANT keeps each record as it came, parsed
once, so a mapping can name as many keys as it likes and what it doesn't name
isn't lost. Lines that aren't JSON objects are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, strip
from .specs import SPECS

#: Where a guide's fields are, the first that is filled counts; and a video's.
IFIXIT_KEYS = {
    "guide_id": ("guideid", "guide_id", "id"), "source_id": ("source_id", "guideid"), "device_name": ("device_name", "subject", "topic", "category"), "title": ("title", "display_title"),
    "device_category": ("device_category", "category", "type"), "review_text": ("review_text", "introduction_raw", "summary", "conclusion_raw"), "published_date": ("published_date", "modified_date", "created_date"),
    "author": ("author.username", "author.name", "author"), "helpful_votes": ("helpful_votes", "favorites", "completed_count"), "repairability_score": ("repairability_score", "difficulty_score"), "url": ("url", "canonical_url"),
}
YOUTUBE_KEYS = {
    "source_id": ("source_id", "video_id", "id"), "video_id": ("video_id", "id"), "title": ("title", "snippet.title"), "published_date": ("published_date", "snippet.publishedAt"), "channel": ("channel", "snippet.channelTitle", "author_name"),
    "like_count": ("like_count", "statistics.likeCount"), "url": ("url", "webpage_url"), "product_name": ("product_name",), "product_category": ("product_category",),
}


def records(lines: DataFrame, column: str = "value", name: str = "record") -> DataFrame:
    """``lines`` with the column parsed as a VARIANT; rows that aren't JSON objects go."""
    parsed = lines.withColumn(name, F.try_parse_json(column))
    return parsed.where(F.schema_of_variant(name).startswith("OBJECT"))


def path(key: str) -> str:
    return "$." + ".".join(f"['{part}']" if not part.isidentifier() else part for part in key.split(".")) if "." in key else f"$['{key}']"


def field(record: str, key: str, kind: str = "string") -> Column:
    """A field by its name, or by names with dots for one inside others; null if it isn't there or is of another kind."""
    return F.try_variant_get(record, path(key), kind)


def scalar(record: str, key: str) -> Column:
    """A field as text; objects and arrays count as missing, so that a struct doesn't pass for a name."""
    value = F.try_variant_get(record, path(key), "variant")
    return F.when(~F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)"), field(record, key))


def first_of(record: str, keys: Sequence[str]) -> Column:
    """The first of the fields that is neither missing nor blank."""
    return F.coalesce(*(blank_to_null(scalar(record, k)) for k in keys))


def unknown(record: str, known: Sequence[str]) -> Column:
    """(key, value) of the fields of a record that a mapping doesn't name, values as JSON: what a source has newly added."""
    whole = F.try_variant_get(record, "$", "map<string,variant>")
    top = sorted({k.split(".")[0] for k in known})
    rest = F.map_filter(whole, lambda k, v: ~k.isin(*top))
    return F.map_from_entries(F.transform(F.array_sort(F.map_keys(rest)), lambda k: F.struct(k.alias("key"), F.to_json(F.element_at(rest, k)).alias("value"))))


def mapped(parsed: DataFrame, keys: dict[str, Sequence[str]], record: str = "record") -> DataFrame:
    """The mapping's fields as text, in its order."""
    return parsed.select(*(first_of(record, k).alias(name) for name, k in keys.items()))


def ifixit_records(parsed: DataFrame, record: str = "record") -> DataFrame:
    """Guides as raw iFixit records (``specs``)."""
    found = mapped(parsed, IFIXIT_KEYS, record)
    return found.select(*(F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in SPECS["ifixit"].schema.names))


def youtube_records(parsed: DataFrame, record: str = "record") -> DataFrame:
    """Videos with segments (text, duration) as raw YouTube records, with their length and number of segments; a text of its own goes before segments."""
    segments = F.coalesce(F.try_variant_get(record, "$.segments", "array<struct<text:string,duration:double>>"), F.array().cast("array<struct<text:string,duration:double>>"))
    spoken = F.concat_ws(" ", F.filter(F.transform(segments, lambda s: strip(s["text"])), lambda t: t != ""))
    with_text = parsed.withColumns({"_text": F.coalesce(first_of(record, ("text", "transcript")), F.nullif(spoken, F.lit(""))), "_s": segments})
    length = F.aggregate("_s", F.lit(0.0), lambda t, s: t + F.coalesce(s["duration"], F.lit(0.0)))
    return with_text.select(*(first_of(record, k).alias(name) for name, k in YOUTUBE_KEYS.items()), F.col("_text").alias("text"), length.alias("duration_seconds"), F.size("_s").alias("segment_count"))

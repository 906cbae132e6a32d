"""Enrichment: sentiment, aspects and the flat columns that stand for them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aspects, sentiment
from . import resume

#: A backend gives a signed score for a text column; the lexicon is the one that needs no model.
Backend = Callable[[str], Column]


def enrich(df: DataFrame, backend: Backend = sentiment.lexicon_score, extract: Callable[[str], Column] = aspects.extract) -> DataFrame:
    """``df`` with sentiment_label, sentiment_score, aspect_labels, aspect_count and aspect_details_json."""
    blank = F.trim(F.coalesce("review_text", F.lit(""))) == ""
    scored = df.withColumn("sentiment_score", F.when(blank, 0.0).otherwise(backend("review_text")))
    scored = scored.withColumn("sentiment_label", sentiment.label("sentiment_score")).withColumn("_tp_aspects", extract("review_text"))
    return scored.withColumns(aspects.serialized(F.col("_tp_aspects"))).drop("_tp_aspects")


def enrich_by_key(
    df: DataFrame, key: str = "review_id", backend: Backend = sentiment.lexicon_score, keywords: Mapping[str, Iterable[str]] = aspects.KEYWORDS, positive: Iterable[str] = sentiment.POSITIVE, negative: Iterable[str] = sentiment.NEGATIVE
) -> DataFrame:
    """``enrich`` by keywords for rows with unique keys: mentions are rows, and records come back by the key.

    Rows without a key keep their sentiment and have no aspects.
    """
    blank = F.trim(F.coalesce("review_text", F.lit(""))) == ""
    scored = df.withColumn("sentiment_score", F.when(blank, 0.0).otherwise(backend("review_text"))).withColumn("sentiment_label", sentiment.label("sentiment_score"))
    found = aspects.record_rows(df.where(F.col(key).isNotNull()), key, "review_text", keywords, positive, negative).withColumnRenamed("records", "_tp_aspects")
    both = scored.join(found, key, "left").withColumn("_tp_aspects", F.coalesce("_tp_aspects", F.array().cast(aspects.RECORD)))
    return both.withColumns(aspects.serialized(F.col("_tp_aspects"))).select(*df.columns, "sentiment_label", "sentiment_score", "aspect_labels", "aspect_count", "aspect_details_json")


def with_lexicon(positive: Iterable[str], negative: Iterable[str]) -> Backend:
    return lambda c: sentiment.lexicon_score(c, positive, negative)


def enrich_in_parts(df: DataFrame, target: str, parts: int = 100, settings: dict | None = None, **options) -> dict:
    """``enrich`` a part at a time below ``target``; a run that was cut short goes on, unless its settings have changed."""
    return resume.run(df, lambda part: enrich(part, **options), target, parts, {"job": "enrich", **(settings or {})})

"""Profiles of a dataset: gaps, distincts, ranges and duplicates, over all and by source in one pass.

Two levels of grouping take the place of exact distincts inside grouping sets,
which would copy every row once per distinct: values are reduced to one row
per source first, and totals are made from those.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, text_key, word_count
from ..functions.values import iso_time
from ..schema import REPORTED
from .analytics import source_key

ALL = "overall"


def missing(c: str) -> Column:
    """Null, or nothing but white space."""
    return F.col(c).isNull() | (strip(F.col(c).cast("string")) == "")


def _words(df: DataFrame) -> Column:
    counted = word_count("review_text")
    return F.coalesce("text_length_words", counted) if "text_length_words" in df.columns else counted


def _date(df: DataFrame) -> Column:
    return F.col("review_date") if dict(df.dtypes)["review_date"] == "timestamp" else iso_time("review_date")


def _by_source(df: DataFrame, *aggregates: Column) -> DataFrame:
    """The aggregates by source and, as 'overall', over all."""
    keyed = df.withColumn("_source", source_key())
    return keyed.groupingSets([[F.col("_source")], []], F.col("_source")).agg(*aggregates, F.grouping("_source").alias("_all")).select(F.when(F.col("_all") == 1, ALL).otherwise(F.col("_source")).alias("scope"), "*").drop("_source", "_all")


def _distinct(df: DataFrame, c: str, name: str) -> DataFrame:
    """Distinct filled values of a column, by source and over all."""
    pairs = df.where(~missing(c)).select(source_key().alias("_s"), strip(F.col(c).cast("string")).alias("_v")).groupBy("_v", "_s").count()
    by = pairs.groupBy(F.col("_s").alias("scope")).agg(F.count("*").alias(name))
    total = pairs.groupBy("_v").agg(F.lit(1).alias("_1")).agg(F.count("*").alias(name)).select(F.lit(ALL).alias("scope"), name)
    return by.unionByName(total)


def dataset_profile(df: DataFrame, fields: Sequence[str] = REPORTED) -> DataFrame:
    fields = [f for f in fields if f in df.columns]
    gaps = [F.count_if(missing(f)).alias(f"null_{f}") for f in fields]
    share = sum((F.count_if(missing(f)) for f in fields), F.lit(0)) / (F.count("*") * len(fields))
    x, d = F.col("rating_normalized").cast("double"), _date(df)
    out = _by_source(
        df, F.count("*").alias("record_count"), *gaps, F.round(F.avg(_words(df)), 2).alias("average_words"), F.round(F.min(x), 4).alias("min_rating"), F.round(F.max(x), 4).alias("max_rating"),
        F.round(F.avg(x), 4).alias("mean_rating"), F.min(d).alias("min_date"), F.max(d).alias("max_date"), F.round(share, 4).alias("missing_value_ratio"),
    )
    for c, name in (("product_name", "distinct_products"), ("reviewer_id", "distinct_reviewers")):
        if c in df.columns:
            out = out.join(_distinct(df, c, name), "scope", "left").fillna(0, [name])
    return out.orderBy(F.col("scope") != ALL, "scope")


def source_comparison(df: DataFrame, fields: Sequence[str] = REPORTED) -> DataFrame:
    fields = [f for f in fields if f in df.columns]
    n = F.count("*")
    gaps = sum((F.count_if(missing(f)) for f in fields), F.lit(0))
    return df.groupBy(source_key().alias("source")).agg(
        n.alias("record_count"), F.round(F.avg(_words(df)), 2).alias("average_words"), F.round(F.avg("rating_normalized"), 4).alias("average_rating"), F.round(gaps / (n * len(fields)), 4).alias("missing_value_ratio"),
        F.round(F.count_if(missing("rating_normalized")) / n, 4).alias("missing_rating_ratio"), F.round(F.count_if(missing("review_text")) / n, 4).alias("missing_text_ratio"),
    ).orderBy("source")


def quality_metrics(df: DataFrame, fields: Sequence[str] = REPORTED) -> DataFrame:
    """Duplicates (texts equal but for case and spacing, beyond the first), gaps, empty texts and dates that can't be read."""
    fields = [f for f in fields if f in df.columns]
    n = F.count("*")
    gaps = sum((F.count_if(missing(f)) for f in fields), F.lit(0))
    bad = F.count_if(~missing("review_date") & _date(df).isNull())
    base = _by_source(df, n.alias("record_count"), F.round(gaps / (n * len(fields)), 4).alias("null_ratio"), F.count_if(missing("review_text")).alias("empty_text_count"), bad.alias("invalid_date_count"), F.count_if(missing("rating_normalized")).alias("missing_rating_count"))
    texts = df.where(~missing("review_text")).select(source_key().alias("_s"), text_key("review_text").alias("_k")).groupBy("_s", "_k").agg(F.count("*").alias("_n"))
    by = texts.groupBy(F.col("_s").alias("scope")).agg(F.sum(F.col("_n") - 1).alias("duplicate_count"))
    total = texts.groupBy("_k").agg(F.sum("_n").alias("_n")).agg(F.sum(F.col("_n") - 1).alias("duplicate_count")).select(F.lit(ALL).alias("scope"), "duplicate_count")
    out = base.join(by.unionByName(total), "scope", "left").fillna(0, ["duplicate_count"])
    return out.withColumn("duplicate_ratio", F.round(F.col("duplicate_count") / F.greatest("record_count", F.lit(1)), 4)).orderBy(F.col("scope") != ALL, "scope")


def null_counts(df: DataFrame, fields: Sequence[str] = REPORTED) -> DataFrame:
    """(field, null_count), the most first."""
    fields = [f for f in fields if f in df.columns]
    wide = df.agg(*(F.count_if(missing(f)).alias(f) for f in fields))
    return wide.unpivot([], fields, "field", "null_count").orderBy(F.desc("null_count"), "field")

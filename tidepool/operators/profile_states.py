"""Profiles that add up: each run leaves a small state, and the profile of a dataset is the states of its runs merged.

A state has a row a source: counts, sums, least and greatest values, and
sketches of distinct values and of ratings. Adding a run reads that run alone;
a run that is added again replaces its state, and one that is taken away takes
its state with it. Everything that adds up exactly equals
``profile.dataset_profile``. Distinct products, reviewers and texts come from
HyperLogLog sketches of 2^14 buckets, whose standard error is 0.8 %
(``DISTINCT_ERROR`` is three of those), and quantiles of ratings from KLL
sketches of ``KLL`` items, whose rank error is below ``RANK_ERROR``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip, text_key
from ..schema import REPORTED
from ..sources.readers import exists, listing, remove, run_id
from .analytics import source_key
from .profile import ALL, _date, _words, missing

LG, KLL = 14, 400
DISTINCT_ERROR, RANK_ERROR = 0.025, 0.01
DISTINCT = {"distinct_products": "product_name", "distinct_reviewers": "reviewer_id"}


def state(df: DataFrame, fields: Sequence[str] = REPORTED) -> DataFrame:
    """One row a source, from one scan."""
    fields = [f for f in fields if f in df.columns]
    words, x, d = _words(df), F.col("rating_normalized").cast("double"), _date(df)
    filled = lambda c: F.when(~missing(c), strip(F.col(c).cast("string")))
    empty = F.lit(None).cast("string")
    sketch = lambda c: F.hll_sketch_agg(c, F.lit(LG))
    return df.groupBy(source_key().alias("source")).agg(
        F.count("*").alias("record_count"), *(F.count_if(missing(f)).alias(f"null_{f}") for f in fields), F.sum(words).cast("long").alias("words"), F.count(words).alias("worded"),
        F.min(x).alias("min_rating"), F.max(x).alias("max_rating"), F.sum(x).alias("rating_sum"), F.count(x).alias("rated"), F.min(d).alias("min_date"), F.max(d).alias("max_date"),
        F.count_if(~missing("review_date") & d.isNull()).alias("invalid_dates"), *(sketch(filled(c) if c in df.columns else empty).alias(f"s_{name}") for name, c in DISTINCT.items()),
        sketch(F.when(~missing("review_text"), text_key("review_text"))).alias("s_texts"), F.kll_sketch_agg_double(x, F.lit(KLL)).alias("s_rating"),
    )


def _estimate(name: str) -> Column:
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"s_{name}")), F.lit(0)).cast("long").alias(name)


def merged(states: DataFrame) -> DataFrame:
    """The profile by source and, as 'overall', over all, of the states of any number of runs."""
    nulls = [c for c in states.columns if c.startswith("null_")]
    total = lambda c: F.sum(c).cast("long")
    ratings = F.when(F.sum("rated") > 0, F.kll_merge_agg_double("s_rating"))
    out = states.groupingSets([[F.col("source")], []], F.col("source")).agg(
        total("record_count").alias("record_count"), *(total(c).alias(c) for c in nulls), F.round(F.sum("words") / F.sum("worded"), 2).alias("average_words"), F.round(F.min("min_rating"), 4).alias("min_rating"),
        F.round(F.max("max_rating"), 4).alias("max_rating"), F.round(F.sum("rating_sum") / F.sum("rated"), 4).alias("mean_rating"), F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date"),
        F.round(sum((F.sum(c) for c in nulls), F.lit(0)) / (F.sum("record_count") * len(nulls)), 4).alias("missing_value_ratio"), total("invalid_dates").alias("invalid_date_count"),
        _estimate("distinct_products"), _estimate("distinct_reviewers"), _estimate("texts").alias("distinct_texts"), ratings.alias("_ratings"), F.grouping("source").alias("_all"),
    )
    quantiles = F.kll_sketch_get_quantile_double("_ratings", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    scoped = out.withColumn("scope", F.when(F.col("_all") == 1, ALL).otherwise(F.col("source")))
    # texts that repeat an earlier one, as far as the sketch tells; never below none
    filled = F.col("record_count") - F.col("null_review_text") if "null_review_text" in nulls else F.col("record_count")
    repeated = F.greatest(F.lit(0).cast("long"), filled - F.col("distinct_texts")).alias("repeated_texts")
    return scoped.select("scope", *(c for c in out.columns if c not in ("source", "_all", "_ratings")), repeated, quantiles.alias("rating_quartiles")).orderBy(F.col("scope") != ALL, "scope")


class Profiles:
    """States of a dataset's runs, a folder each below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, run: str) -> str:
        return f"{self.root}/run={run_id(run)}"

    def add(self, run: str, df: DataFrame, fields: Sequence[str] = REPORTED) -> None:
        """Read the run and keep its state, a row a source."""
        state(df, fields).coalesce(1).write.mode("overwrite").parquet(self._path(run))

    def drop(self, run: str) -> None:
        remove(self.spark, self._path(run))

    def runs(self) -> list[str]:
        return sorted({f[0].split("/run=", 1)[1].split("/", 1)[0] for f in listing(self.spark, self.root) if "/run=" in f[0] and f[0].endswith("_SUCCESS")})

    def states(self, runs: Sequence[str] | None = None) -> DataFrame:
        wanted = self.runs() if runs is None else [run_id(r) for r in runs]
        if not wanted or not all(exists(self.spark, self._path(r)) for r in wanted):
            raise FileNotFoundError(f"no states of {wanted or 'any run'} below {self.root}")
        return self.spark.read.option("mergeSchema", "true").parquet(*(self._path(r) for r in wanted))

    def profile(self, runs: Sequence[str] | None = None) -> DataFrame:
        """Of all runs, or of some: reads states, no reviews."""
        return merged(self.states(runs))

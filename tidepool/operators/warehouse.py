"""Datasets as tables: which one answers, how far it was read, and rows as a table or an answer shows them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.readers import listing
from .reviews import FALLBACKS, ReviewFilter

#: What the explorer's table shows, and names by source where a row has none.
EXPLORED = ("review_id", "source", "product_label", "rating_normalized", "sentiment_label", "aspect_labels", "review_date", "helpful_votes", "source_url")
NAMES = {"amazon": "Amazon Product Review", "yelp": "Yelp Business Review", "ebay": "eBay Listing", "ifixit": "iFixit Guide", "reddit": "Reddit Discussion", "youtube": "YouTube Review"}
CATEGORIES = {"amazon": "Electronics Product", "yelp": "Local Business", "ebay": "Marketplace Listing", "ifixit": "Repair Guide", "reddit": "Forum Discussion", "youtube": "Video Review"}
ENTITIES = {"amazon": "product_review", "yelp": "business_review", "ebay": "listing_review", "ifixit": "repair_review", "reddit": "forum_post", "youtube": "video_transcript"}
LONG_ID = r"^[A-Za-z0-9_-]{16,}$"


def table_exists(spark: SparkSession, name: str) -> bool:
    """Whether a table is there and can be read."""
    if not spark.catalog.tableExists(name):
        return False
    try:
        spark.table(name).limit(1).collect()
    except Exception:  # whatever a catalog's storage raises
        return False
    return True


def choose_table(spark: SparkSession, names: Sequence[str]) -> str | None:
    """The first of the tables that answers."""
    return next((n for n in names if table_exists(spark, n)), None)


def has_parquet(spark: SparkSession, path: str) -> bool:
    return any(f[0].endswith(".parquet") for f in listing(spark, path))


def choose_dataset(spark: SparkSession, enriched: str, normalized: str, tables: Sequence[str] = ()) -> DataFrame | None:
    """Enriched reviews, else normalized ones, else the first table that answers."""
    for path in (enriched, normalized):
        if has_parquet(spark, path):
            return spark.read.parquet(path)
    name = choose_table(spark, tables)
    return spark.table(name) if name else None


@dataclass(frozen=True)
class Scan:
    """A frame, and how much of its dataset it is. ``rows`` counts when it is asked for."""

    df: DataFrame
    max_rows: int | None = None

    @classmethod
    def of(cls, df: DataFrame, max_rows: int | None = None) -> Scan:
        return cls(df if max_rows is None else df.limit(max_rows), max_rows)

    def metadata(self) -> dict:
        rows = self.df.count()
        return {"rows_scanned": rows, "scan_limited": self.max_rows is not None and rows >= self.max_rows, "max_rows": self.max_rows}


def table_condition(f: ReviewFilter, columns: Sequence[str], aspects: bool = False) -> Column:
    """A filter as a warehouse has it: text patterns with % and _ on each column by itself, products by exact name."""
    scored, tests = "sentiment_label" in columns, []
    like = lambda c, v: F.col(c).ilike(v)
    if f.query:
        searched = ["review_text", "product_name", "product_category", "display_name", *(["aspect_labels"] if aspects and scored else [])]
        tests.append(F.coalesce(F.greatest(*(F.coalesce(like(c, f"%{f.query}%"), F.lit(False)) for c in searched)), F.lit(False)))
    for value, test in (
        (f.source, lambda v: like("source", v)),
        (f.product, lambda v: F.col("product_name") == v),
        (f.category, lambda v: like("product_category", f"%{v}%")),
        (f.date_start, lambda v: F.col("review_date") >= F.lit(v).cast("timestamp")),
        (f.date_end, lambda v: F.col("review_date") <= F.lit(v).cast("timestamp")),
        (f.min_rating, lambda v: F.col("rating_normalized") >= v),
        (f.max_rating, lambda v: F.col("rating_normalized") <= v),
        (f.sentiment, lambda v: like("sentiment_label", v) if scored else F.lit(False)),
    ):
        if value is not None and value != "":
            tests.append(test(value))
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def _text(df: DataFrame, c: str) -> Column:
    return strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in df.columns else F.lit("")


def _filled(*options: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*(F.nullif(o, F.lit("")) for o in options))


def _by(source: Column, names: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for name, value in names.items():
        out = F.when(source == name, F.lit(value)).otherwise(out)
    return out


def shown_names(df: DataFrame) -> DataFrame:
    """``df`` with display_name, display_category and entity_type as answers show them: never blank."""
    source, display, product = _text(df, "source"), _text(df, "display_name"), _text(df, "product_name")
    stock = _by(source, NAMES, "Unknown Item")
    item = F.when((product != "") & (F.lower(product) != "unknown"), F.concat(F.lit("Amazon Electronics Item "), product))
    name = (
        F.when(source == "amazon", _filled(display, F.coalesce(item, stock)))
        .when(source == "yelp", F.when((display != "") & ~display.rlike(LONG_ID), display).otherwise(stock))
        .when(source.isin("reddit", "youtube"), _filled(display, stock))
        .otherwise(_filled(display, product, stock))
    )
    shelf, category = _text(df, "display_category"), _text(df, "product_category")
    usual = _by(source, CATEGORIES, "Unknown Category")
    shelf = F.when(source.isin("amazon", "yelp", "youtube"), _filled(shelf, usual)).otherwise(_filled(shelf, category, usual))
    return df.withColumns({"display_name": name, "display_category": shelf, "entity_type": _filled(_text(df, "entity_type"), _by(source, ENTITIES, "unknown"))})


def attach_labels(df: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """``df`` with product_title and product_label: a title, a name that isn't an id, or a phrase with the id.

    ``titles`` (product_name, product_title) is a dimension of Amazon products.
    """
    source, name = F.lower(_text(df, "source")), _text(df, "product_name")
    title = F.nullif(_text(df, "product_title"), F.lit(""))
    if titles is not None:
        one = titles.groupBy(F.trim("product_name").alias("_tp_name")).agg(F.max("product_title").alias("_tp_title"))
        df = df.withColumn("_tp_key", name).join(one, F.col("_tp_key") == F.col("_tp_name"), "left")
        title = F.coalesce(title, F.when(source == "amazon", F.nullif(F.col("_tp_title"), F.lit(""))))
    before, after = FALLBACKS["amazon"].split("{}")
    known = F.when((name != "") & ~name.rlike(LONG_ID), name)
    numbered = F.when((source == "amazon") & (name != "") & (F.lower(name) != "unknown"), F.concat(F.lit(before), name, F.lit(after)))
    label = F.coalesce(title, known, numbered, F.nullif(name, F.lit("")), F.lit("Unknown Product"))
    return df.withColumns({"product_title": title, "product_label": label}).drop("_tp_key", "_tp_name", "_tp_title")


def explorer_table(df: DataFrame) -> DataFrame:
    """The explorer's columns; a blank label falls back to a title or name, and what a frame lacks is ''."""
    label = F.coalesce(_filled(*(_text(df, c) for c in ("product_label", "product_title", "product_name", "display_name"))), F.lit(""))
    have = df.withColumn("product_label", label)
    return have.select(*(F.col(c) if c in have.columns else F.lit("").alias(c) for c in EXPLORED))


def latest_change(spark: SparkSession, path: str) -> datetime | None:
    changed = max((f[2] for f in listing(spark, path)), default=None)
    return datetime.fromtimestamp(changed / 1000) if changed is not None else None

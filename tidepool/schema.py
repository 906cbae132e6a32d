"""The unified review schema, and fitting frames of other shapes to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType())}


def struct(fields: str) -> T.StructType:
    """From "name type, ...", without a session."""
    pairs = (f.split() for f in fields.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


UNIFIED = struct(
    "review_id string, product_name string, product_category string, source string, rating_normalized double, review_text string, "
    "review_date timestamp, reviewer_id string, verified_purchase boolean, helpful_votes int, source_url string, "
    "display_name string, display_category string, entity_type string"
)
FEATURES = struct("text_length_words int, text_length_chars int, caps_ratio double, exclamation_ratio double")
ENRICHED = struct("aspect_labels string, aspect_count int, aspect_details_json string, sentiment_label string, sentiment_score double")
#: Fields whose gaps the profile and quality reports count.
REPORTED = UNIFIED.names[:11]


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order: what ``df`` lacks is null, what doesn't cast is null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def available(df: DataFrame, names: list[str]) -> list[str]:
    """Those of the names that ``df`` has."""
    return [n for n in names if n in df.columns]

"""Numbers, dates and vectors as columns. What can't be read is null, under ANSI mode too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import ColumnOrName, col
from .text import strip

#: The bounds and names of rating bins; the last one is closed.
RATING_BINS = ((0.0, 0.2, "0.0-0.2"), (0.2, 0.4, "0.2-0.4"), (0.4, 0.6, "0.4-0.6"), (0.6, 0.8, "0.6-0.8"), (0.8, 1.01, "0.8-1.0"))


def number(c: ColumnOrName) -> Column:
    x = strip(col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(x), x)


def whole_number(c: ColumnOrName) -> Column:
    """Digits after the point are cut off, not a reason for null."""
    return number(c).try_cast("int")


def scaled(c: ColumnOrName, low: float, high: float) -> Column:
    """From [low, high] to [0, 1], clamped, four places; null stays null."""
    x = number(c)
    return F.when(x.isNotNull(), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low))), 4))


def rating_bin(c: ColumnOrName) -> Column:
    x = col(c)
    out = F.lit(None).cast("string")
    for low, high, name in reversed(RATING_BINS):
        out = F.when((x >= low) & (x < high), F.lit(name)).otherwise(out)
    return out


def iso_time(c: ColumnOrName) -> Column:
    """ISO dates and times; without an offset they are UTC."""
    return F.try_to_timestamp(strip(col(c).cast("string")))


def epoch_seconds(c: ColumnOrName) -> Column:
    return F.timestamp_micros(F.round(number(c) * 1_000_000).try_cast("long"))


def epoch_millis(c: ColumnOrName) -> Column:
    return F.timestamp_millis(number(c).try_cast("long"))


def iso_or_epoch(c: ColumnOrName) -> Column:
    """Digits only are seconds; anything else is ISO."""
    text = strip(col(c).cast("string"))
    return F.when(text.rlike(r"^\d+$"), epoch_seconds(text)).otherwise(iso_time(text))


def iso_text(c: ColumnOrName) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ssxxx")


def month(c: ColumnOrName) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: ColumnOrName) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def unit(a: ColumnOrName) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(col(a), lambda v: v.cast("double") / n)).otherwise(col(a))


def cosine_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    """1 - the dot product of unit vectors; 1 where one is empty or lengths differ."""
    fits = (F.size(col(a)) == F.size(col(b))) & (F.size(col(a)) > 0)
    return F.when(fits, F.lit(1.0) - dot(a, b)).otherwise(F.lit(1.0))

"""Lexicon sentiment, and labels of signed scores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import ColumnOrName, col
from .text import count_of

#: Fixed values.
POSITIVE = (
    "amazing", "awesome", "best", "brilliant", "comfortable", "durable", "easy", "excellent", "fantastic", "fast", "good", "great", "improved",
    "impressive", "incredible", "intuitive", "love", "perfect", "premium", "recommend", "reliable", "smooth", "solid", "stunning", "value", "worth",
)
NEGATIVE = (
    "awful", "bad", "broke", "broken", "cheap", "complicated", "defective", "disappointing", "expensive", "fail", "failed", "fails", "flimsy", "frustrating",
    "garbage", "hate", "issue", "lag", "overpriced", "poor", "problem", "refund", "return", "slow", "terrible", "useless", "worst",
)
THRESHOLD = 0.2
MODEL_LABELS = {1: ("positive", "label_1", "4 stars", "5 stars"), -1: ("negative", "label_0", "1 star", "2 stars"), 0: ("neutral", "3 stars")}


def lexicon_score(c: ColumnOrName, positive: Iterable[str] = POSITIVE, negative: Iterable[str] = NEGATIVE) -> Column:
    """(p - n) / (p + n) of the tokens' hits, four places; 0 without hits."""
    p, n = count_of(c, tuple(positive)), count_of(c, tuple(negative))
    return F.when(p + n > 0, F.round((p - n) / (p + n), 4)).otherwise(F.lit(0.0))


def label(score: ColumnOrName) -> Column:
    s = col(score)
    return F.when(s > THRESHOLD, "positive").when(s < -THRESHOLD, "negative").otherwise("neutral")


def model_score(name: ColumnOrName, confidence: ColumnOrName) -> Column:
    """A classifier's label and confidence as a signed score, as ``backends.signed_score`` has it.

    Confidences are clamped to 0 and 1; below a half they turn the sign, and missing or unreadable ones count as a half.
    """
    n = F.lower(F.trim(col(name)))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(col(confidence).try_cast("double"), F.lit(0.5))))
    means = lambda sign: n.isin(*MODEL_LABELS[sign]) | F.contains(n, F.lit(MODEL_LABELS[sign][0]))
    return F.round(F.when(means(1), 2 * sure - 1).when(means(-1), 1 - 2 * sure).otherwise(0.0), 4)

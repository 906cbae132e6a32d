"""Which questions may be answered, and how sure that is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import ColumnOrName, col
from .text import strip

#: What blocks a question, by family.
BLOCKING = {
    "prompt_injection": r"(?i)\bignore (all )?(previous|prior|system|developer) instructions\b|\breveal (the )?(system|developer) prompt\b|\bjailbreak\b|\bDAN mode\b",
    "secret_extraction": r"(?i)\b(api[_ -]?key|password|secret|token|credential)s?\b|\b.env\b|\benvironment variables?\b",
    "review_manipulation": r"(?i)\b(write|generate|fabricate|create)\b.*\bfake\b.*\breviews?\b|\b(hide|remove|delete|suppress)\b.*\bnegative\b.*\breviews?\b",
}
ANSWER = "I can only answer questions about the reviews, and not this one."


def confidence(c: ColumnOrName) -> Column:
    text = F.coalesce(col(c), F.lit(""))
    n = F.regexp_count(text, F.lit("[A-Za-z0-9']+"))
    return F.when(n == 0, 0.0).when((n == 1) | (F.length(strip(text)) > 1200), 0.35).when(n <= 3, 0.6).otherwise(0.9)


def decision(c: ColumnOrName, least: float = 0.5, reviewed: bool = False) -> Column:
    """struct(allowed, action, flags, confidence). ``reviewed``: people look at doubtful questions."""
    text = strip(F.coalesce(col(c), F.lit("")))
    flags = F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in BLOCKING.items())))
    sure = confidence(text)
    empty, blocked, doubtful = text == "", F.size(flags) > 0, sure < least
    low = F.array(F.lit("low_confidence_query"))
    action = F.when(empty | blocked, "block").when(doubtful, "needs_human_review" if reviewed else "allow").otherwise("allow")
    none = F.array().cast("array<string>")
    return F.struct(
        (action == "allow").alias("allowed"),
        action.alias("action"),
        F.when(empty, F.array(F.lit("empty_query"))).when(blocked, flags).when(doubtful, low).otherwise(none).alias("flags"),
        F.when(empty, 0.0).when(blocked, 0.95).otherwise(sure).alias("confidence"),
    )

"""Risk that a review isn't genuine: rules that add to a score, and the flags they set."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import any_of, char_count, count_of, ratio, run_length, strip, tokens

#: Fixed values.
PROMOTIONS = ("promo code", "discount code", "click here", "limited time", "free gift", "sponsored", "affiliate", "use my code", "guaranteed results")
SUPERLATIVES = ("amazing", "awesome", "best", "excellent", "fantastic", "incredible", "perfect", "wonderful")
CONCRETE = ("battery", "camera", "screen", "display", "shipping", "support", "warranty", "comfort", "sound", "audio", "build", "price", "durability", "performance", "repair", "service")
LINK, MAIL = r"(?i)https?://|www\.", r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"
BAIT = r"(?i)\b(5\s*stars|five\s*stars|must\s*buy|buy\s*now)\b"


def scored(
    df: DataFrame,
    text: str = "review_text",
    threshold: float = 0.7,
    promotions: Iterable[str] = PROMOTIONS,
    superlatives: Iterable[str] = SUPERLATIVES,
    concrete: Iterable[str] = CONCRETE,
) -> DataFrame:
    """``df`` with ``risk``, a struct(score, label, flags) of a text; a blank one is no risk.

    Each step is a projection of its own, so what several rules look at is worked out once a row, in generated code.
    """
    t, low, words = F.col("_tp_text"), F.col("_tp_low"), F.col("_tp_words")
    one = df.withColumn("_tp_text", strip(F.coalesce(text, F.lit(""))))
    two = one.withColumn("_tp_low", F.lower(t))
    # in order of the alphabet: a word that occurs four times stands four times in a row
    three = two.withColumn("_tp_words", F.sort_array(tokens(t)))
    counts = three.select(
        *df.columns, t, low,
        F.size(words).alias("size"), F.size(F.array_distinct(words)).alias("distinct"),
        F.regexp_count(F.array_join(words, " "), F.lit(r"(?<![^ ])([a-z0-9']++)(?: \1(?![^ ])){3,}+")).alias("repeated"),
        sum((F.contains(low, F.lit(p)).cast("int") for p in promotions), F.lit(0)).alias("promoted"),
        run_length(t, r"\p{L}++").alias("letters"), run_length(t, r"\p{Lu}++").alias("upper"), char_count(t, "!").alias("marks"), char_count(t, "?").alias("asks"),
        count_of(t, tuple(superlatives)).alias("praise"), low.rlike(any_of(tuple(concrete))).alias("concrete"),
        (t.rlike(LINK) | (F.contains(t, F.lit("@")) & t.rlike(MAIL))).alias("contact"), t.rlike(BAIT).alias("bait"),
    )
    made = counts.columns[len(df.columns) :]
    c = {name: F.col(name) for name in made}
    rules = [
        ("very_short_review", c["size"] < 8, F.lit(0.15)),
        ("external_link_or_contact", c["contact"], F.lit(0.25)),
        ("promotional_language", c["promoted"] > 0, F.least(F.lit(0.35), 0.15 + 0.08 * c["promoted"])),
        ("low_vocabulary_diversity", (c["size"] >= 10) & (ratio(c["distinct"], c["size"]) < 0.45), F.lit(0.2)),
        ("repeated_terms", c["repeated"] > 0, F.least(F.lit(0.2), 0.08 * c["repeated"])),
        ("excessive_punctuation", (c["marks"] >= 3) | (c["asks"] >= 3), F.lit(0.1)),
        ("excessive_caps", (c["letters"] >= 20) & (ratio(c["upper"], c["letters"]) > 0.45), F.lit(0.12)),
        ("generic_superlatives", (c["praise"] >= 3) & ~c["concrete"], F.lit(0.2)),
        ("review_bait_phrase", c["bait"], F.lit(0.12)),
    ]
    added = counts.select(*df.columns, (t == "").alias("_tp_blank"), *(F.when(test, add).otherwise(0.0).alias(f"_tp_{name}") for name, test, add in rules))
    parts = {name: F.col(f"_tp_{name}") for name, _, _ in rules}
    total = F.least(F.lit(1.0), sum(parts.values(), F.lit(0.0)))
    blank = F.col("_tp_blank")
    summed = added.withColumn("_tp_score", F.when(blank, 0.0).otherwise(F.round(total, 4)))
    score, none = F.col("_tp_score"), F.array().cast("array<string>")
    label = F.when(score >= threshold, "likely_fake").when((score >= min(0.6 * threshold, 0.55)) & ~blank, "suspicious").otherwise("low_risk")
    flags = F.when(blank, none).otherwise(F.array_compact(F.array(*(F.when(part > 0, F.lit(name)) for name, part in parts.items()))))
    return summed.select(*df.columns, F.struct(score.alias("score"), label.alias("label"), flags.alias("flags")).alias("risk"))


def annotated(df: DataFrame, text: str = "review_text", threshold: float = 0.7) -> DataFrame:
    """With fake_review_score, fake_review_label and fake_review_flags."""
    made = ["fake_review_score", "fake_review_label", "fake_review_flags"]
    found = scored(df.drop(*made), text, threshold)
    return found.select(*(c for c in found.columns if c != "risk"), *(F.col(f"risk.{f}").alias(name) for f, name in zip(("score", "label", "flags"), made)))

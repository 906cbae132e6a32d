"""Aspects that a text mentions: which, with what sentiment, in what sentence."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sentiment
from ._columns import ColumnOrName, col, let
from .text import phrase, quote, sentences, strip

#: Labels in the order in which they are tried, and what stands for them.
KEYWORDS: dict[str, tuple[str, ...]] = {
    "battery": ("battery", "battery life", "charge", "charging", "power", "lasts"),
    "camera": ("camera", "photo", "picture", "photos", "pictures", "lens", "zoom"),
    "sound quality": ("sound", "sound quality", "audio", "bass", "treble", "speaker", "noise cancellation", "anc"),
    "build quality": ("build", "build quality", "construction", "material", "materials", "plastic", "metal", "sturdy", "flimsy"),
    "comfort": ("comfort", "comfortable", "fit", "fits", "ear", "ergonomic", "lightweight", "heavy"),
    "screen": ("screen", "display", "brightness", "resolution", "oled", "lcd", "refresh rate"),
    "performance": ("performance", "speed", "fast", "slow", "lag", "laggy", "smooth", "processor", "cpu", "gpu"),
    "price": ("price", "cost", "expensive", "cheap", "overpriced", "value", "worth", "affordable", "deal"),
    "design": ("design", "look", "looks", "style", "aesthetic", "sleek", "beautiful", "ugly", "color"),
    "durability": ("durable", "durability", "broke", "broken", "cracked", "lasted", "lasting", "wear"),
    "customer service": ("customer service", "support", "warranty", "return", "refund", "replacement", "service team"),
    "ease of use": ("easy", "simple", "intuitive", "complicated", "setup", "set up", "install", "installation", "user friendly"),
}
RECORD = "array<struct<aspect:string,sentiment:double,quote:string>>"


def _has_any(text: Column, words: Iterable[str]) -> Column:
    """Whether the text has one of the words, which are patterns. Plain ones are looked for as bytes, which costs much less."""
    words = tuple(dict.fromkeys(words))
    if not words or not all(re.fullmatch("[a-z0-9 ]+", w) for w in words):
        return text.rlike("|".join(words))
    short = [w for w in words if not any(x != w and x in w for x in words)]  # what has another word inside says no more
    return reduce(lambda x, y: x | y, (F.contains(text, F.lit(w)) for w in short))


def canonical(c: ColumnOrName, keywords: Mapping[str, Iterable[str]] = KEYWORDS, exact_first: bool = False) -> Column:
    """The first label of the map that the phrase equals, or contains one of the words of; null if none.

    Words match inside others, so a label whose own name contains an earlier
    label's word turns into that one. ``exact_first`` tries equality with all
    labels and words before any containment.
    """
    return let(phrase(c), lambda text: _canonical(text, keywords, exact_first))


def _canonical(text: Column, keywords: Mapping[str, Iterable[str]], exact_first: bool) -> Column:
    names = {name: tuple(dict.fromkeys((name, *words))) for name, words in keywords.items()}
    equal = [(text.isin(*words), name) for name, words in names.items()]
    inside = [(_has_any(text, words), name) for name, words in names.items()]
    tests = equal + inside if exact_first else [x for pair in zip(equal, inside) for x in pair]
    out = F.lit(None).cast("string")
    for test, name in reversed(tests):
        out = F.when(test, F.lit(name)).otherwise(out)
    return F.when(text != "", out)


def deduplicated(records: Column, keywords: Mapping[str, Iterable[str]] = KEYWORDS, exact_first: bool = False) -> Column:
    """One record per canonical label, where it is first mentioned, with the strongest sentiment's payload.

    A record that has a quote takes the place of one that has none.
    """
    clean = F.filter(
        F.transform(
            F.coalesce(records, F.array().cast(RECORD)),
            lambda r, i: F.struct(
                canonical(r["aspect"], keywords, exact_first).alias("aspect"),
                F.round(F.coalesce(r["sentiment"], F.lit(0.0)), 4).alias("sentiment"),
                quote(r["quote"]).alias("quote"),
                i.alias("at"),
            ),
        ),
        lambda r: r["aspect"].isNotNull(),
    )
    stronger = lambda have, r: (F.abs(r["sentiment"]) > F.abs(have["sentiment"])) | ((have["quote"] == "") & (r["quote"] != ""))
    field = lambda r: F.struct(*(r[f].alias(f) for f in ("aspect", "sentiment", "quote")))

    def best(rows: Column, name: Column) -> Column:
        same = F.filter(rows, lambda r: r["aspect"] == name)
        return let(same, lambda x: field(F.aggregate(x, x[0], lambda have, r: F.when(stronger(have, r), r).otherwise(have))))

    return let(clean, lambda rows: F.transform(F.array_distinct(F.transform(rows, lambda r: r["aspect"])), lambda name: best(rows, name)))


def mentions(
    c: ColumnOrName,
    keywords: Mapping[str, Iterable[str]] = KEYWORDS,
    positive: Iterable[str] = sentiment.POSITIVE,
    negative: Iterable[str] = sentiment.NEGATIVE,
    whole_words: bool = False,
) -> Column:
    """Every label that a sentence of four characters or more mentions, in order, once per sentence."""
    tests = {}
    for name, words in keywords.items():
        parts = "|".join(dict.fromkeys((name, *words)))
        tests[name] = rf"\b(?:{parts})\b" if whole_words else parts

    def of(sentence: Column) -> Column:
        return let(phrase(sentence), lambda text: let(sentiment.lexicon_score(sentence, positive, negative), lambda score: in_sentence(sentence, text, score)))

    def in_sentence(sentence: Column, text: Column, score: Column) -> Column:
        found = F.array(*(F.when(text.rlike(p), F.struct(F.lit(n).alias("aspect"), score.alias("sentiment"), quote(sentence).alias("quote"))) for n, p in tests.items()))
        return F.when(F.length(text) >= 4, F.filter(found, lambda r: r.isNotNull())).otherwise(F.array().cast(RECORD))

    return F.flatten(F.transform(sentences(strip(F.coalesce(col(c), F.lit("")))), of))


def mention_rows(
    df: DataFrame,
    text: str = "review_text",
    keywords: Mapping[str, Iterable[str]] = KEYWORDS,
    positive: Iterable[str] = sentiment.POSITIVE,
    negative: Iterable[str] = sentiment.NEGATIVE,
) -> DataFrame:
    """``mentions`` as rows: ``df``'s other columns with sentence (its number), aspect, sentiment and quote.

    Sentences become rows first, so that labels are tried and scores made in generated code.
    """
    others = [c for c in df.columns if c != text]
    cut = df.select(*others, F.posexplode(sentences(strip(F.coalesce(text, F.lit(""))))).alias("sentence", "_tp_sentence"))
    # exploded, so that filters stay above it and don't work it out again for each label
    plain = cut.withColumn("_tp_phrase", F.explode(F.array(phrase("_tp_sentence")))).where(F.length("_tp_phrase") >= 4)
    found = F.array_compact(F.array(*(F.when(_has_any(F.col("_tp_phrase"), (name, *words)), F.lit(name)) for name, words in keywords.items())))
    named = plain.withColumn("_tp_found", found).where(F.size("_tp_found") > 0)
    each = named.select(*others, "sentence", "_tp_found", sentiment.lexicon_score("_tp_sentence", positive, negative).alias("sentiment"), quote("_tp_sentence").alias("quote"))
    return each.select(*others, "sentence", F.explode("_tp_found").alias("aspect"), "sentiment", "quote")


def canonical_name(label: str, keywords: Mapping[str, Iterable[str]] = KEYWORDS, exact_first: bool = False) -> str:
    """``canonical`` of one of the map's own labels."""
    names = {name: {name, *words} for name, words in keywords.items()}
    plain = re.sub("[^a-z0-9]+", " ", label.lower()).strip(" ")
    if exact_first and (same := next((name for name, words in names.items() if plain in words), None)):
        return same
    return next(name for name, words in names.items() if plain in words or any(re.search(w, plain) for w in words))


def record_rows(
    df: DataFrame,
    key: str,
    text: str = "review_text",
    keywords: Mapping[str, Iterable[str]] = KEYWORDS,
    positive: Iterable[str] = sentiment.POSITIVE,
    negative: Iterable[str] = sentiment.NEGATIVE,
    exact_first: bool = False,
) -> DataFrame:
    """(key, records): what ``extract`` gives each text that mentions anything, made from ``mention_rows``. Keys are unique.

    Labels are tried and scores made in generated code; of each label the first mention and the strongest one (the
    first of equals) are kept where texts are read, so one narrow row a key is exchanged, and no text.
    """
    labels = list(keywords)
    found = mention_rows(df.select(key, text), text, keywords, positive, negative)
    turn = F.array_position(F.array(*map(F.lit, labels)), F.col("aspect")).cast("int")
    name = F.element_at(F.array(*(F.lit(canonical_name(x, keywords, exact_first)) for x in labels)), turn)
    found = found.withColumns({"_tp_turn": turn, "_tp_name": name})
    made = list(dict.fromkeys(canonical_name(x, keywords, exact_first) for x in labels))
    mine = lambda x, of: F.when(F.col("_tp_name") == x, of)
    strength = F.struct(F.abs("sentiment"), -F.col("sentence"), -F.col("_tp_turn"))
    each = [F.min(mine(x, F.struct("sentence", "_tp_turn"))).alias(f"_tp_first{i}") for i, x in enumerate(made)]
    each += [F.max_by(F.struct("sentiment", "quote"), mine(x, strength)).alias(f"_tp_best{i}") for i, x in enumerate(made)]
    one = lambda i, x: F.struct(F.col(f"_tp_first{i}").alias("at"), F.lit(x).alias("aspect"), F.round(F.col(f"_tp_best{i}.sentiment"), 4).alias("sentiment"), quote(f"_tp_best{i}.quote").alias("quote"))
    rows = F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"_tp_first{i}").isNotNull(), one(i, x)) for i, x in enumerate(made)))))
    records = F.transform(rows, lambda r: F.struct(r["aspect"].alias("aspect"), r["sentiment"].alias("sentiment"), r["quote"].alias("quote")))
    return found.groupBy(key).agg(*each).select(key, records.alias("records"))


def extract(c: ColumnOrName, keywords: Mapping[str, Iterable[str]] = KEYWORDS, positive: Iterable[str] = sentiment.POSITIVE, negative: Iterable[str] = sentiment.NEGATIVE, exact_first: bool = False) -> Column:
    return deduplicated(mentions(c, keywords, positive, negative), keywords, exact_first)


def first_mentions(
    c: ColumnOrName, keywords: Mapping[str, Iterable[str]] = KEYWORDS, positive: Iterable[str] = sentiment.POSITIVE, negative: Iterable[str] = sentiment.NEGATIVE
) -> Column:
    """A coarser rule: each label once, from the first sentence of ten characters or more that has one of its words.

    A sentence scores half and a fifth for each different word of the winning lexicon; quotes end after 150 characters.
    """
    cut = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), r"[.!?]+"), strip), lambda s: F.length(s) >= 10)

    def scored(s: Column) -> Column:
        words = F.array_distinct(F.filter(F.split(F.lower(s), r"(?U)\s+"), lambda w: w != ""))
        p, n = (F.size(F.array_intersect(words, F.array(*map(F.lit, x)))) for x in (tuple(positive), tuple(negative)))
        up, down = F.least(F.lit(0.5) + p * 0.2, F.lit(1.0)), F.greatest(F.lit(-0.5) - n * 0.2, F.lit(-1.0))
        return F.round(F.when(p > n, up).when(n > p, down).otherwise(0.0), 2)

    def record(rows: Column, name: str, words: Iterable[str]) -> Column:
        hit = F.filter(rows, lambda s: F.lower(s).rlike("|".join(words)))
        return F.when(F.size(hit) > 0, let(F.get(hit, 0), lambda s: F.struct(F.lit(name).alias("aspect"), scored(s).alias("sentiment"), F.substring(s, 1, 150).alias("quote"))))

    return let(cut, lambda rows: F.array_compact(F.array(*(record(rows, name, words) for name, words in keywords.items()))))


def first_mention_rows(
    df: DataFrame,
    key: str,
    text: str = "review_text",
    keywords: Mapping[str, Iterable[str]] = KEYWORDS,
    positive: Iterable[str] = sentiment.POSITIVE,
    negative: Iterable[str] = sentiment.NEGATIVE,
) -> DataFrame:
    """``first_mentions`` as rows, (key, aspect, sentiment, quote), with sentences tried in generated code. Keys are unique."""
    cut = df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"[.!?]+")).alias("sentence", "_tp_part")).withColumn("_tp_s", strip("_tp_part")).where(F.length("_tp_s") >= 10)
    low = F.lower("_tp_s")
    found = F.array_compact(F.array(*(F.when(low.rlike("|".join(words)), F.lit(name)) for name, words in keywords.items())))
    named = cut.withColumn("_tp_found", found).where(F.size("_tp_found") > 0)
    words = F.split(low, r"(?U)\s+")
    p, n = (F.size(F.array_intersect(words, F.array(*map(F.lit, x)))) for x in (tuple(positive), tuple(negative)))
    up, down = F.least(F.lit(0.5) + p * 0.2, F.lit(1.0)), F.greatest(F.lit(-0.5) - n * 0.2, F.lit(-1.0))
    score = F.round(F.when(p > n, up).when(n > p, down).otherwise(0.0), 2)
    rows = named.select(key, "sentence", F.explode("_tp_found").alias("aspect"), score.alias("sentiment"), F.substring("_tp_s", 1, 150).alias("quote"))
    return rows.groupBy(key, "aspect").agg(F.min_by(F.struct("sentiment", "quote"), "sentence").alias("m")).select(key, "aspect", "m.sentiment", "m.quote")


def serialized(records: Column) -> dict[str, Column]:
    """The three flat columns that stand for the records."""
    return {
        "aspect_labels": F.concat_ws(", ", F.transform(records, lambda r: r["aspect"])),
        "aspect_count": F.size(records),
        "aspect_details_json": F.to_json(records),
    }

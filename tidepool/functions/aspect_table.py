"""Aspects as a table function for SQL: ``SELECT ... FROM reviews, LATERAL aspects(review_text)``.

A row a mention, (sentence, aspect, sentiment, quote), by the rules of
``aspects.mention_rows``. Rows travel in Arrow batches; Spark's tables of whole
Arrow arrays can't stand in a lateral join. ``mention_rows`` is the faster form
for a whole frame, as its rules run in generated code; this one is for SQL,
where a text's mentions are joined to its other columns. (Spark plans an outer
lateral join with a table function as an inner one: texts without mentions have
no row.)
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import sentiment
from .aspects import KEYWORDS
from .text import SPACES, any_of

SCHEMA = "sentence int, aspect string, sentiment double, quote string"
_SPACE = "[" + re.escape(SPACES) + "]+"
_CUT = re.compile(rf"(?<=[.!?]){_SPACE}|\n+")


class Mentions:
    """The mentions of one text."""

    def __init__(self, keywords: Mapping[str, Iterable[str]] = KEYWORDS, positive: Iterable[str] = sentiment.POSITIVE, negative: Iterable[str] = sentiment.NEGATIVE):
        self.tests = [(name, re.compile("|".join(dict.fromkeys((name, *words))))) for name, words in keywords.items()]
        self.positive, self.negative = (re.compile(any_of(tuple(w))) if w else None for w in (tuple(positive), tuple(negative)))

    def _score(self, sentence: str) -> float:
        low = sentence.lower()
        p, n = (sum(1 for _ in x.finditer(low)) if x else 0 for x in (self.positive, self.negative))
        return round((p - n) / (p + n), 4) if p + n else 0.0

    def __call__(self, text: str | None) -> Iterator[tuple[int, str, float, str]]:
        stripped = [s for part in _CUT.split((text or "").strip(SPACES)) if (s := part.strip(SPACES))]
        for number, sentence in enumerate(stripped):
            plain = re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")
            named = [name for name, test in self.tests if test.search(plain)] if len(plain) >= 4 else []
            if named:
                score, quote = self._score(sentence), re.sub(_SPACE, " ", sentence).strip(SPACES)[:240]
                yield from ((number, name, score, quote) for name in named)


def register(spark: SparkSession, name: str = "aspects", keywords: Mapping[str, Iterable[str]] = KEYWORDS, positive: Iterable[str] = sentiment.POSITIVE, negative: Iterable[str] = sentiment.NEGATIVE) -> None:
    """Make the table function known to the session's SQL under a name."""
    keywords, positive, negative = {k: tuple(v) for k, v in keywords.items()}, tuple(positive), tuple(negative)

    class Aspects:
        def __init__(self):
            self.mentions = Mentions(keywords, positive, negative)

        def eval(self, text: str):
            yield from self.mentions(text)

    spark.udtf.register(name, F.udtf(Aspects, returnType=SCHEMA, useArrow=True))

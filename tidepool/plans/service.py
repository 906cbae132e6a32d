"""Answers as plain dictionaries, one function per endpoint of a review service. No web server: callers bring their own.

Only bounded results reach the driver: pages, top lists, and one row per
source, month or label.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import guardrails
from ..operators import analytics, profile, retrieval, reviews, warehouse
from ..operators.backends import generated_answer
from ..operators.reviews import ReviewFilter
from ..sources import readers
from ..sources.specs import explain
from . import params, status


def rows(df: DataFrame) -> list[dict[str, Any]]:
    """Rows as JSON has them: times are ISO text."""
    return [json.loads(r.j) for r in df.select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssxxx", "ignoreNullFields": "false"}).alias("j")).collect()]


class Cache:
    """Answers by their parameters and the dataset's signature, for a time."""

    def __init__(self, seconds: float = 300):
        self.seconds, self.held = seconds, {}

    def get(self, name: str, params: dict, make: Callable[[], Any], signature: Any = None) -> Any:
        key = hashlib.sha256(json.dumps([name, params, signature], sort_keys=True, default=str).encode()).hexdigest()
        if (hit := self.held.get(key)) and hit[0] > time.monotonic():
            return hit[1]
        value = make()
        self.held = {k: v for k, v in self.held.items() if v[0] > time.monotonic()} | {key: (time.monotonic() + self.seconds, value)}
        return value


class ReviewService:
    def __init__(
        self,
        spark: SparkSession,
        enriched: DataFrame,
        index: DataFrame | None = None,
        queue_path: str | None = None,
        titles: DataFrame | None = None,
        generate: Callable[[str, list[dict]], str] | None = None,
        max_rows: int | None = None,
    ):
        """``titles``: a dimension of products; ``generate``: a model that answers; ``max_rows``: a cap on what analytics read."""
        params.checked(max_rows=max_rows)
        self.spark, self.index, self.queue_path, self.titles, self.generate = spark, index, queue_path, titles, generate
        self.scan = warehouse.Scan.of(enriched, max_rows)
        self.df = self.scan.df
        self._indexed: int | None = None

    def health(self) -> dict:
        parts = {"dataset": "healthy" if self.df.columns else "unhealthy", "index": "healthy" if self.index is not None else "degraded", "queue": "healthy" if self.queue_path else "degraded"}
        status = next((s for s in ("unhealthy", "degraded") if s in parts.values()), "healthy")
        return {"status": status, "checks": parts}

    def dashboard_summary(self) -> dict:
        """The index is counted once: it doesn't change under a service."""
        if self._indexed is None:
            self._indexed = self.index.count() if self.index is not None else 0
        waiting = readers.queue(self.spark, self.queue_path, None, 1_000_000).count() if self.queue_path and readers.exists(self.spark, self.queue_path) else 0
        return rows(analytics.summary(self.df))[0] | {"indexed": self._indexed, "queue_items": waiting}

    def scanned(self) -> dict:
        """How far analytics read the dataset."""
        return self.scan.metadata()

    def pipeline_status(self, artefacts: dict[str, str], data: str, logs: Sequence[str] = (), jobs: str | None = None) -> dict:
        return status.pipeline_status(self.spark, artefacts, data, logs, jobs, self.index)

    def normalize_explain(self, source: str, raw: DataFrame, at: int = 0) -> list[dict]:
        return rows(explain(source, raw, at))

    def review_options(self, limit: int = 200) -> dict:
        return analytics.from_option_cube(rows(analytics.option_cube(self.df, limit)))

    def explore(self, filters: ReviewFilter | None = None, limit: int = 25, offset: int = 0) -> dict:
        f = filters or ReviewFilter()
        matched = f.apply(self.df).count()
        shown = warehouse.attach_labels(reviews.payload(reviews.page(self.df, limit, offset, f)), self.titles)
        items = rows(shown)
        return {"items": items, "matched_count": matched, "has_more": matched > offset + len(items), "limit": limit, "offset": offset}

    def source_stats(self, most: int = 1000) -> dict:
        return {k: rows(v) for k, v in analytics.source_stats(self.df, most).items()}

    def data_profile(self) -> list[dict]:
        return rows(profile.dataset_profile(self.df))

    def data_compare(self) -> list[dict]:
        return rows(profile.source_comparison(self.df))

    def data_quality(self) -> list[dict]:
        return rows(profile.quality_metrics(self.df))

    def sentiment(self, filters: ReviewFilter | None = None) -> dict:
        df = (filters or ReviewFilter()).apply(self.df)
        return analytics.from_cube(rows(analytics.sentiment_cube(df))) | {"top_aspects": rows(analytics.top_aspects(df))}

    def compare(self, names: Sequence[str], filters: ReviewFilter | None = None) -> dict:
        df = (filters or ReviewFilter()).apply(self.df)
        order = {k: i for i, k in enumerate(analytics.keys_of(names))}
        return {"products": sorted(rows(analytics.product_report(df, names)), key=lambda r: order[r["product_key"]])}

    def aspects(self, filters: ReviewFilter | None = None) -> dict:
        df = (filters or ReviewFilter()).apply(self.df)
        return {"aspects": rows(analytics.aspect_summary(df)), "top_positive": rows(analytics.aspects_by(df, "positive")), "top_negative": rows(analytics.aspects_by(df, "negative")), **rows(analytics.rows_with_aspects(df))[0]}

    def search(self, query: str, n: int = 5, source: str | None = None) -> dict:
        params.checked(n_results=n)
        removed = Observation("search")
        if self.index is None:
            found = rows(reviews.payload(reviews.genuine(retrieval.keywords(self.df, query, n, source), observed=removed)))
        else:
            found = rows(retrieval.citations(retrieval.hybrid(self.index, query, n, source, self._dimensions()), observed=removed))
        return {"query": query, "results": found, "removed_count": removed.get["removed_count"]}

    def _dimensions(self) -> int:
        first = self.index.select(F.size("embedding").alias("n")).first()
        return first.n if first else retrieval.DIMENSIONS

    def queue(self, status: str | None = "pending", limit: int = 50) -> list[dict]:
        return rows(readers.queue(self.spark, self.queue_path, status, limit)) if self.queue_path and readers.exists(self.spark, self.queue_path) else []

    def chat(self, query: str, n: int = 5, source: str | None = None, reviewed: bool = False) -> dict:
        """Guardrails, retrieval, and an answer made of the reviews found."""
        asked = self.spark.createDataFrame([(query,)], "q string").select(guardrails.decision("q", reviewed=reviewed).alias("d")).first().d.asDict()
        if not asked["allowed"]:
            if asked["action"] == "needs_human_review" and self.queue_path:
                request = [(hashlib.sha256(query.encode()).hexdigest()[:16], time.strftime("%Y-%m-%dT%H:%M:%S+00:00", time.gmtime()), "pending", query, source, "low confidence", 0, asked["flags"], asked["confidence"])]
                readers.append_queue(self.spark.createDataFrame(request, readers.QUEUE), self.queue_path)
            return {"answer": guardrails.ANSWER, "citations": [], "guardrail": asked}
        found = self.search(query, n, source)["results"]
        return {"answer": generated_answer(self.generate, query, found, answer), "citations": found, "guardrail": asked}


def answer(query: str, found: list[dict]) -> str:
    """Two examples of each sentiment among the first five reviews."""
    if not found:
        return f"No reviews match: {query}"
    lines = [f"{len(found)} reviews match: {query}"]
    for label in ("positive", "negative", "neutral"):
        some = [r for r in found[:5] if r.get("sentiment_label") == label]
        if some:
            lines.append(f"{label.capitalize()} ({len(some)}): " + " | ".join((r.get("review_text") or "")[:240] for r in some[:2]))
    return "\n".join(lines)

"""What outside services deliver, page by page. Transport is the caller's: ``fetch(url, params, headers) -> dict``.

Each generator yields raw records in the shapes of ``specs``. ``Records`` runs
one as a Spark data source, a partition a query, so pages are fetched where
rows are needed.
"""

from __future__ import annotations

import base64
import importlib
import json
import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[..., dict]
#: Where the services answer, and what they are asked for at once.
EBAY_TOKEN, EBAY_SEARCH = "https://api.ebay.com/identity/v1/oauth2/token", "https://api.ebay.com/buy/browse/v1/item_summary/search"
EBAY_SCOPE, EBAY_PAGE = "https://api.ebay.com/oauth/api_scope", 200
IFIXIT_GUIDE = "https://www.ifixit.com/api/2.0/guides/{}"
YOUTUBE_SEARCH, YOUTUBE_VIDEOS, YOUTUBE_OEMBED = "https://www.googleapis.com/youtube/v3/search", "https://www.googleapis.com/youtube/v3/videos", "https://www.youtube.com/oembed"
REDDIT_TOKEN, REDDIT_SEARCH = "https://www.reddit.com/api/v1/access_token", "https://oauth.reddit.com/r/{}/search"
REDDIT_LEAST = 20


class TooMany(Exception):
    """A transport raises this where the service asks to wait (429)."""


def basic(user: str, secret: str) -> dict[str, str]:
    return {"Authorization": "Basic " + base64.b64encode(f"{user}:{secret}".encode()).decode()}


def token(fetch: Fetch, user: str, secret: str, url: str = EBAY_TOKEN, **form: str) -> str:
    """An access token for the application itself."""
    answer = fetch(url, {"grant_type": "client_credentials", **({"scope": EBAY_SCOPE} if url == EBAY_TOKEN else {}), **form}, basic(user, secret))
    if not answer.get("access_token"):
        raise RuntimeError("no access token in the answer")
    return answer["access_token"]


def patient(fetch: Fetch, tries: int = 3, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Fetch:
    """One request a ``pause``, and again after twice the time whenever the service asks to wait."""

    def run(*args, **kwargs):
        for k in range(tries):
            sleep(pause * 2**k if k else pause)
            try:
                return fetch(*args, **kwargs)
            except TooMany:
                if k == tries - 1:
                    raise
        raise AssertionError

    return run


def ebay_items(fetch: Fetch, access: str, queries: Sequence[str] = (), categories: Sequence[str] = (), page: int = EBAY_PAGE, most: int = 1000, seen: set[str] | None = None) -> Iterator[dict]:
    """Items of searches and of categories, each id once over all of them; blank ids are left out."""
    seen = set() if seen is None else seen
    page = max(1, min(page, EBAY_PAGE))
    for asked in ({"q": q} for q in queries), ({"category_ids": c} for c in categories):
        for params in asked:
            offset = taken = 0
            while taken < most:
                answer = fetch(EBAY_SEARCH, {**params, "limit": page, "offset": offset}, {"Authorization": f"Bearer {access}"})
                items = answer.get("itemSummaries") or []
                for item in items:
                    name = str(item.get("itemId") or "").strip()
                    if name and name not in seen:
                        seen.add(name)
                        taken += 1
                        yield item
                        if taken >= most:
                            break
                if not items or not answer.get("next"):
                    break
                offset += page


def ifixit_guides(fetch: Fetch, ids: Sequence[str]) -> Iterator[dict]:
    for i in dict.fromkeys(ids):
        yield {"guide_id": str(i), **fetch(IFIXIT_GUIDE.format(i), {}, {})}


def video_ids(fetch: Fetch, key: str, queries: Sequence[str], configured: Sequence[str] = (), most: int = 25) -> list[str]:
    """Ids that are configured, then those that searches find, each once."""
    found = [str(v) for v in configured]
    for q in queries:
        answer = fetch(YOUTUBE_SEARCH, {"key": key, "q": q, "part": "id", "type": "video", "maxResults": most}, {})
        found += [item["id"]["videoId"] for item in answer.get("items") or [] if (item.get("id") or {}).get("videoId")]
    return list(dict.fromkeys(v for v in found if v.strip()))


def videos(fetch: Fetch, transcripts: Callable[[str], list[dict]], ids: Sequence[str], key: str | None = None) -> Iterator[dict]:
    """Videos with their segments; what the service's own interface says goes before what the embedding page says."""
    for v in ids:
        page = fetch(YOUTUBE_OEMBED, {"url": f"https://www.youtube.com/watch?v={v}", "format": "json"}, {})
        said = {"title": page.get("title"), "channel": page.get("author_name")}
        if key:
            items = fetch(YOUTUBE_VIDEOS, {"key": key, "id": v, "part": "snippet,statistics"}, {}).get("items") or [{}]
            shown, counts = items[0].get("snippet") or {}, items[0].get("statistics") or {}
            own = {"title": shown.get("title"), "channel": shown.get("channelTitle"), "published_date": shown.get("publishedAt"), "like_count": counts.get("likeCount")}
            said |= {k: x for k, x in own.items() if x}
        yield {"source_id": v, "video_id": v, "url": f"https://www.youtube.com/watch?v={v}", "segments": transcripts(v), **said}


def posts(fetch: Fetch, access: str, forum: str, query: str, most: int = 100, page: int = 100) -> Iterator[dict]:
    """Posts that a search finds, page after page, with 20 characters of text or more."""
    after, taken = None, 0
    while taken < most:
        answer = fetch(REDDIT_SEARCH.format(forum), {"q": query, "restrict_sr": 1, "limit": page, "after": after}, {"Authorization": f"Bearer {access}"})
        data = answer.get("data") or {}
        for child in data.get("children") or []:
            post = child.get("data") or {}
            text = str(post.get("selftext") or "").strip()
            if len(text) >= REDDIT_LEAST:
                taken += 1
                yield {"source_id": post.get("id"), "title": post.get("title"), "text": text, "subreddit": post.get("subreddit") or forum, "created_utc": post.get("created_utc"), "author": post.get("author"), "score": post.get("score"), "url": post.get("url")}
                if taken >= most:
                    return
        after = data.get("after")
        if not after:
            return


class Records(DataSource):
    """``spark.read.format("tidepool_records")``: JSON records of ``option("producer", "module:function")``.

    The function gets one of the strings of ``option("queries", '["..."]')`` and yields dictionaries.
    """

    @classmethod
    def name(cls) -> str:
        return "tidepool_records"

    def schema(self) -> str:
        return "query string, record string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.producer, self.queries = options["producer"], json.loads(options.get("queries", "[]"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in self.queries]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, function = self.producer.partition(":")
        for record in getattr(importlib.import_module(module), function)(partition.value):
            yield partition.value, json.dumps(record)

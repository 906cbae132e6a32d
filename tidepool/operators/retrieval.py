"""Retrieval: text embeddings by hashing, exact nearest neighbours, the lexical ladder, and both together."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import authenticity
from . import resume
from ..functions.text import folded, strip
from ..functions.values import cosine_distance, iso_text

#: Words that a question's search leaves out.
STOP_WORDS = (
    "a", "an", "and", "are", "about", "as", "at", "be", "by", "can", "did", "do", "does", "for", "from", "how", "i", "in", "is", "it", "of", "on", "or",
    "people", "review", "reviews", "say", "says", "the", "they", "to", "what", "with",
)
DIMENSIONS, LEAST_DIMENSIONS, LEAST_CHARACTERS, MOST_TERMS = 384, 16, 20, 16
TOKEN = re.compile(r"[A-Za-z0-9']+")


def query_terms(query: str) -> list[str]:
    """Up to 16 distinct terms in order, without stop words."""
    return list(dict.fromkeys(t for t in TOKEN.findall(query.lower()) if t not in STOP_WORDS))[:MOST_TERMS]


class Hashed:
    """Unit vectors of texts: each token adds to two places. Tokens are numbered and hashed once, vectors are summed a few texts at a time."""

    #: Tokens that are remembered; cells of sums and characters of texts that are taken at a time, so memory doesn't grow with a batch.
    MOST, CELLS, CHARACTERS = 100_000, 1 << 19, 1 << 20

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.rows: list[bytes] = []

    def _number(self, token: str) -> int:
        if token not in self.numbers:
            self.numbers[token] = len(self.rows)
            self.rows.append(hashlib.blake2b(token.encode(), digest_size=16).digest()[:10])
        return self.numbers[token]

    def __call__(self, texts: list[str]) -> np.ndarray:
        parts = [self._some(texts[a:b]) for a, b in self.steps(np.fromiter(map(len, texts), np.int64, len(texts)))]
        return np.concatenate(parts) if parts else np.zeros((0, self.dimensions))

    def steps(self, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
        """Bounds of texts that are taken together: so many characters, or one text."""
        until, most, at = np.cumsum(sizes), max(1, self.CELLS // self.dimensions), 0
        while at < len(sizes):
            end = int(np.searchsorted(until, (until[at - 1] if at else 0) + self.CHARACTERS, "right"))
            yield at, (at := max(at + 1, min(end, at + most, len(sizes))))

    def _some(self, texts: list[str]) -> np.ndarray:
        if len(self.rows) > self.MOST:
            self.forget()
        each = [[self._number(t) for t in TOKEN.findall(text.lower())] for text in texts]
        doc, number = np.repeat(np.arange(len(texts)), [len(x) for x in each]), np.array([n for x in each for n in x], np.int64)
        digest = np.frombuffer(b"".join(self.rows), [("one", "<u4"), ("two", "<u4"), ("sign", "u1"), ("half", "u1")])[number]
        out = np.zeros(len(texts) * self.dimensions)
        for place, value in ((digest["one"], np.where(digest["sign"] % 2 == 0, 1.0, -1.0)), (digest["two"], np.where(digest["half"] % 2 == 0, 0.5, -0.5))):
            out += np.bincount(doc * self.dimensions + (place % self.dimensions).astype(np.int64), value, len(out))
        v = out.reshape(len(texts), self.dimensions)
        n = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return v / np.where(n > 0, n, 1)


def embedding(c: str | Column, dimensions: int = DIMENSIONS) -> Column:
    """A unit vector of hashed tokens. BLAKE2b isn't among Spark's functions, so this is a UDF over Arrow arrays, of which a few texts at a time become strings."""
    if dimensions < LEAST_DIMENSIONS:
        raise ValueError(f"dimensions must be at least {LEAST_DIMENSIONS}")

    @F.arrow_udf("array<double>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashed = Hashed(dimensions)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)
            parts = [hashed([t or "" for t in batch.slice(a, b - a).to_pylist()]).ravel() for a, b in hashed.steps(sizes)]
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * dimensions, pa.int32()), pa.array(np.concatenate([np.zeros(0), *parts])))

    return encode(F.col(c) if isinstance(c, str) else c)


def embed_query(query: str, dimensions: int = DIMENSIONS) -> list[float]:
    return Hashed(dimensions)([query])[0].tolist()


def payloads(df: DataFrame) -> DataFrame:
    """(id, document, metadata) of reviews with an id and 20 characters or more; what a frame lacks is '' or 0."""
    texts = ["source", "product_name", "product_category", "display_name", "display_category", "entity_type", "aspect_labels", "sentiment_label", "source_url"]
    have = set(df.columns)
    has = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)
    date = (iso_text("review_date") if dict(df.dtypes).get("review_date") == "timestamp" else F.col("review_date")) if "review_date" in have else F.lit("")
    metadata = F.struct(*(has(c, "").cast("string").alias(c) for c in texts), F.coalesce(date, F.lit("")).alias("review_date"), has("aspect_count", 0).cast("int").alias("aspect_count"), has("sentiment_score", 0.0).cast("double").alias("sentiment_score"))
    text = strip(F.coalesce("review_text", F.lit("")))
    return df.where((strip(F.coalesce("review_id", F.lit(""))) != "") & (F.length(text) >= LEAST_CHARACTERS)).select(F.col("review_id").alias("id"), text.alias("document"), metadata.alias("metadata"))


def index(df: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    return payloads(df).withColumn("embedding", embedding("document", dimensions))


def index_in_parts(df: DataFrame, target: str, parts: int = 100, dimensions: int = DIMENSIONS, settings: dict | None = None) -> dict:
    """``index`` a part at a time below ``target``; refuses to go on with another model or number of dimensions."""
    return resume.run(df, lambda part: index(part, dimensions), target, parts, {"job": "index", "model": f"hashing-{dimensions}", **(settings or {})})


def nearest(vectors: DataFrame, query: list[float], n: int = 5, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The n nearest by cosine distance, ties to the lesser id: a map and a bounded top-k, no sort of all rows."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.withColumn("distance", cosine_distance(vector_col, q)).orderBy("distance", id_col).limit(n)


def document_terms(c: str) -> Column:
    """Terms of a document: letters and digits, apostrophes part them."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def postings(indexed: DataFrame, id_col: str = "id", document: str = "document") -> DataFrame:
    """(term, id, occurrences): the text index of a store, a row a term and document."""
    terms = indexed.select(F.col(id_col).alias("id"), F.explode(document_terms(document)).alias("term"))
    return terms.groupBy("term", "id").agg(F.count("*").alias("occurrences"))


def updated_postings(have: DataFrame, changed: DataFrame, deleted: DataFrame | None = None, id_col: str = "id", document: str = "document") -> DataFrame:
    """Postings after documents were put in, replaced or (by ``id``) deleted: only rows of those documents change."""
    gone = changed.select(F.col(id_col).alias("id"))
    if deleted is not None:
        gone = gone.unionByName(deleted.select(F.col(id_col).alias("id")))
    return have.join(gone.distinct(), "id", "left_anti").select("term", "id", "occurrences").unionByName(postings(changed, id_col, document))


def lexical_level(terms: list[str], c: str = "document") -> Column:
    """3 where all terms stand in a row, 2 where all occur, 1 where one does, else 0; one term alone is at most 1."""
    q = [p for t in terms for p in re.findall(r"[a-z0-9]+", t)]
    if not q:
        return F.lit(0)
    have, want = document_terms(c), F.array(*map(F.lit, q))
    any_ = F.arrays_overlap(have, want)
    if len(q) == 1:
        return F.when(any_, 1).otherwise(0)
    in_row = F.contains(F.concat(F.lit(" "), F.concat_ws(" ", have), F.lit(" ")), F.lit(f" {' '.join(q)} "))
    return F.when(in_row, 3).when(F.size(F.array_except(want, have)) == 0, 2).when(any_, 1).otherwise(0)


def lexical(df: DataFrame, query: str, source: str | None = None, document: str = "document", source_col: str = "source") -> DataFrame:
    """Rows of the best level that any row of the source reaches."""
    if source:
        df = df.where(folded(source_col) == source.strip().lower())
    rows = df.withColumn("level", lexical_level(query_terms(query), document)).where("level > 0")
    best = rows.agg(F.max("level").alias("_best"))  # one row
    return rows.join(F.broadcast(best), F.col("level") == F.col("_best")).drop("_best")


def hybrid(indexed: DataFrame, query: str, n: int = 5, source: str | None = None, dimensions: int = DIMENSIONS) -> DataFrame:
    """Lexical candidates, ranked by the distance of their vectors; all rows where a question has no terms."""
    flat = indexed.withColumn("source", F.col("metadata")["source"])
    if query_terms(query):
        flat = lexical(flat, query, source)
    elif source:
        flat = flat.where(folded("source") == source.strip().lower())
    return nearest(flat, embed_query(query, dimensions), n)


def keywords(df: DataFrame, query: str, n: int = 5, source: str | None = None) -> DataFrame:
    """Reviews that contain one of the question's first five words of more than three letters, at a distance of 0.5.

    Punctuation is left out first; a question of short words only is looked for as a whole, and one without words as "review".
    """
    plain = re.sub(r"[^\w\s]", "", query.lower())
    words = [w for w in plain.split() if len(w) > 3][:5] or [plain.strip() or "review"]
    text = F.lower(F.coalesce("review_text", F.lit("")))
    test = F.lit(False)
    for w in words:
        test = test | F.contains(text, F.lit(w))
    rows = df.where(test)
    if source:
        rows = rows.where(folded("source") == source.strip().lower())
    return rows.withColumn("distance", F.lit(0.5)).orderBy(F.col("review_date").desc_nulls_last(), "review_id").limit(n)


def citations(found: DataFrame, threshold: float = 0.7, observed: Observation | None = None) -> DataFrame:
    """What an answer cites, without reviews that are likely fake. ``observed`` receives removed_count, when rows are read."""
    m = F.col("metadata")
    names = ["source", "product_name", "product_category", "display_name", "display_category", "entity_type", "aspect_labels", "sentiment_label", "sentiment_score", "review_date", "source_url"]
    rows = authenticity.annotated(found, "document", threshold)
    if observed is not None:
        rows = rows.observe(observed, F.count_if(F.col("fake_review_label") == "likely_fake").alias("removed_count"))
    rows = rows.where("fake_review_label <> 'likely_fake'")
    return rows.select(F.col("id").alias("review_id"), F.col("document").alias("review_text"), *(m[c].alias(c) for c in names), F.round("distance", 6).alias("distance"), "fake_review_score", "fake_review_label")

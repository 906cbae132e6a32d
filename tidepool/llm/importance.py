"""Importance resampling towards a target distribution over hashed n-grams.

Each task hands its texts to a DuckDB of its own, a few megabytes at a time.
SQL takes the words, unnests them, windows them into runs, counts the runs of a
document, and hashes each distinct run of the batch once with a registered CRC
function. What comes out, the number of runs in each bucket of a document, is
spilled to Parquet in the folder that the session names; texts are read once.

Spark merges the spilled counts into one count a bucket for the corpus and the
target, which gives each bucket's gain, and scores each document from its own
buckets and that table of gains (a number a bucket, so its size is known). A
Gumbel number of the seeded hash of the id is added, so that the highest scores
are a sample without replacement by weight.

Ranks come without a sort of all documents: scores are counted by value first,
and only documents at or above the last drawn value are ordered, within equal
scores. The values are bounded by what a gain and a Gumbel number of 32 bits
can be, and the number of an id differs from its neighbours', so one score
holds about a 2,700th of the documents at most, whatever their weights.

Defined results: null and empty texts and texts without words have no features
and weight 0; repeated rows are documents each; rows without an id have a
weight but neither score nor rank, and don't count for the number drawn; with
an empty target every bucket's gain follows from the corpus alone; an empty
table gives an empty one; other columns of the input aren't looked at.
"""

from __future__ import annotations

import json
import math
import os
import tempfile
import zlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blobs import spill

#: Letters A-Z are lower-cased first; a word is then a run of digits, a-z and code points above 7F.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that one SQL statement gets, or one text if it is longer, and what a task's DuckDB may hold before it spills itself.
CHUNK, MEMORY = 4 << 20, "300MB"
_COUNTED = "id long, n_words long, n_features long, buckets array<int>, counts array<int>"


def _crc(features: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(f.encode()) for f in features.to_pylist()], pa.int64())


def _statement(longest: int, buckets: int) -> str:
    """Bucket counts of the documents in ``chunk`` (place, text)."""
    run = lambda k: " || ' ' || ".join(["w", *(f"lead(w, {j}) OVER run" for j in range(1, k))])
    runs = " UNION ALL ".join(f"SELECT place, {run(k)} AS feature FROM words{' WINDOW run AS (PARTITION BY place ORDER BY i)' if k > 1 else ''}" for k in range(1, longest + 1))
    return rf"""
    WITH given AS MATERIALIZED (SELECT place, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM chunk),
    words AS (SELECT place, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM given),
    counted AS MATERIALIZED (SELECT place, feature, count(*) AS n FROM ({runs}) WHERE feature IS NOT NULL GROUP BY ALL),
    hashed AS MATERIALIZED (SELECT feature, crc(feature) % {buckets} AS bucket FROM (SELECT DISTINCT feature FROM counted)),
    summed AS (SELECT place, bucket, sum(n) AS n FROM counted JOIN hashed USING (feature) GROUP BY ALL),
    found AS (SELECT place, sum(n)::BIGINT AS n_features, list(bucket::INTEGER ORDER BY bucket) AS buckets, list(n::INTEGER ORDER BY bucket) AS counts FROM summed GROUP BY place)
    SELECT place, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n_features, 0) AS n_features, coalesce(buckets, []) AS buckets, coalesce(counts, []) AS counts
    FROM given LEFT JOIN found USING (place) ORDER BY place
    """


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size, begin = 0, 0
    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    for i, n in enumerate(lengths):
        if i > begin and size + n > CHUNK:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _count(longest: int, buckets: int):
    sql = _statement(longest, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as own, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": os.path.join(own, "spill")}) as db:
            db.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
            for batch in batches:
                for part in _chunks(batch):
                    db.register("chunk", pa.table({"place": pa.array(range(part.num_rows), pa.int32()), "text": part.column("text")}))
                    found = db.sql(sql).to_arrow_table()
                    db.unregister("chunk")
                    lists = [found.column(c).combine_chunks().cast(pa.list_(pa.int32())) for c in ("buckets", "counts")]
                    yield pa.RecordBatch.from_arrays([part.column("id"), *(found.column(c).combine_chunks() for c in ("n_words", "n_features")), *lists], names=["id", "n_words", "n_features", "buckets", "counts"])

    return run


def bucket_counts(docs: DataFrame, longest: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, buckets, counts), a row a document, in Parquet."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return spill(rows.mapInArrow(_count(longest, buckets), _COUNTED), "bucket-counts")


def merged_counts(counted: DataFrame) -> dict[int, int]:
    """Features by bucket over all documents: at most as many numbers as there are buckets."""
    each = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(F.col("x.buckets").alias("bucket"))
    return {r.bucket: r.n for r in each.agg(F.sum("x.counts").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """A thousand times the logarithm of each bucket's smoothed share in the target over that in the corpus, down to a whole number."""
    s, t = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((float(target.get(b, 0) + 1) * s) / (float(corpus.get(b, 0) + 1) * t))) for b in range(buckets)]


def scored(counted: DataFrame, gain: list[int], seed: int) -> DataFrame:
    """``counted`` with weight, the floored mean of the gains over all features, and score."""
    table = F.from_json(F.lit(json.dumps(gain)), "array<bigint>")
    total = F.aggregate(F.zip_with("buckets", "counts", lambda b, n: F.get(table, b) * n), F.lit(0).cast("long"), lambda a, x: a + x)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = counted.withColumn("_total", total)
    weight = F.when(F.col("n_features") > 0, F.expr("(_total - pmod(_total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("weight", weight).withColumn("score", F.col("weight") + gumbel).select("id", "n_words", "n_features", "weight", "score")


def ranked(rows: DataFrame, eligible, percent: int) -> DataFrame:
    """``rows`` (id, score, ...) with the rank of those drawn: ``percent`` of the eligible ones, the highest scores, ties to the lesser id."""
    values = rows.where(eligible).groupBy("score").agg(F.count("*").alias("_n"))
    above = F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = F.expr(f"sum(_n) over () * {int(percent)} div 100")
    values = spill(values.select("score", above.alias("_above"), drawn.alias("_drawn")).where("_above < _drawn"), "scores")
    least = values.agg(F.min("score")).first()[0]
    if least is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    in_reach = F.coalesce(eligible & (F.col("score") >= F.lit(least)), F.lit(False))
    place = F.col("_above") + F.row_number().over(Window.partitionBy("score").orderBy("id"))
    best = rows.where(in_reach).join(values, "score").withColumn("rank", place.cast("long"))
    best = best.withColumn("rank", F.when(F.col("rank") <= F.col("_drawn"), F.col("rank"))).select(*rows.columns, "rank")
    return best.unionByName(rows.where(~in_reach).withColumn("rank", F.lit(None).cast("long")))


def importance_resample(
    docs: DataFrame, target: DataFrame, *, longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text"
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank): every document, and its place among the drawn ones."""
    counted = bucket_counts(docs, longest, buckets, id_col, text_col)
    wanted = bucket_counts(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text).alias("text")), longest, buckets, "id", "text")
    rows = scored(counted, gains(merged_counts(counted), merged_counts(wanted), buckets), seed)
    eligible = F.col("id").isNotNull() & (F.col("n_words") >= least_words)
    return ranked(rows, eligible, percent).withColumnRenamed("id", id_col)


def resampled(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns. Ids must be unique for this."""
    drawn = importance_resample(docs, target, id_col=id_col, **options).where("rank IS NOT NULL").select(id_col)
    return docs.join(drawn, id_col, "left_semi").select(*docs.columns)

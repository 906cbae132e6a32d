"""A training corpus from raw documents: toxic and repeated texts go, sources are mixed, texts become pieces.

Each stage works on all rows that the one before it kept and returns the
columns of ``documents``; the last returns the encoded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.blobs import cut
from tidepool.llm.jaccard_join import jaccard_components
from tidepool.llm.mixing import mixed
from tidepool.llm.sentencepiece import encode
from tidepool.llm.suffix_dedup import suffix_dedup
from tidepool.llm.toxicity import fit_toxicity, score_toxicity

#: SQL doesn't express fitted trees, suffix arrays or Viterbi; tests hold the stages against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    copies = jaccard_components(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 100 bytes that came before; what a cut leaves of a character goes with it."""
    cut_texts = suffix_dedup(docs.withColumn("_none", F.col("text").isNull()), whole_characters=True)
    text = F.when(~F.col("_none"), F.col("kept").cast("string"))
    return cut_texts.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those without words, also where a cut left none, have no copy."""
    return mixed(docs).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as the ids of its pieces."""
    return encode(docs).select("doc_id", "lang", "source", F.size("pieces").cast("long").alias("n_pieces"), "pieces")


STAGES = [
    ("toxicity", toxicity),
    ("jaccard_join", jaccard_join),
    ("suffix_array", suffix_array),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

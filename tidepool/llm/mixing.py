"""Mixing sources to target weights by capped water-filling.

Every source gets words in proportion to its weight; a source whose share
would exceed ``max_epochs`` times its size is clamped there, and what it can't
take is shared again among the others. Clamped sources are those with the
least capacity per weight, so one pass in that order finds the fixed point.

A target is a number of whole epochs of its source and a fraction of one. The
fraction takes whole documents in the order of a seeded hash (of the id, or of
the text where there is none): those in lower hash buckets, and within the one
bucket where the target falls, document by document. Bucket sums are made
before anything is ordered, so only one bucket of a source is ever sorted,
however large the source, and rows that are the same in all that orders them
count as one entry with a number: of the entry in which the target falls, as
many rows are taken as bring the sum nearest to it. Those are numbered by
partition, so that an entry of any size needs no task of its own.

All plain DataFrame operations. Defined results: null and empty texts have
size 0 and target as their source's; a null source is a source, ordered last;
rows that share an id are ordered by size and text hash, and if they agree in
those too, some are taken and others not; an empty table gives
an empty one; input columns named like results are replaced, all others come
back as they were, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blobs import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Buckets of a source's documents; the order is exact at any number.
BUCKETS = 4096  # three hexadecimal digits
MADE = {"size", "source_size", "target", "taken"}
#: Sources up to which their plan (some 100 bytes each) is broadcast.
MOST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """``sources`` (_source, source_size, weight: one row each) with ``target``, sharing ``share`` of all sizes."""
    everyone = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    s = s.withColumn("_rank", F.row_number().over(order))
    left = F.sum("source_size").over(everyone) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    # the level that water would have if everyone from here on were free; the first who can hold it is, and so are those after
    s = s.withColumn("_level", left / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    free = F.col("_level") * F.col("weight") <= F.col("cap")
    s = s.withColumn("_final", F.min(F.when(free, F.struct("_rank", "_level"))).over(everyone)["_level"])
    target = F.when(F.col("_final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("_final") * F.col("weight")))
    return s.withColumn("target", target).drop("cap", "_rank", "_level", "_final")


def mix_sources(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.0,
    max_epochs: float = 3.0,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words the mix takes, repeats counted).

    The sources in order of code points, null last, weigh ``weights`` in turn.
    ``taken / size`` is the number of copies of a document.
    """
    others = [c for c in docs.columns if c not in MADE]
    hidden = [F.col(f"`{c}`").alias(f"_tp_c{i}") for i, c in enumerate(others)]  # names of the caller's that no name here equals
    shown = [F.col(f"_tp_c{i}").alias(c) for i, c in enumerate(others)]
    source = F.col(source_col).alias("_source")
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    place = [source, word_count(F.col(text_col)).alias("_size"), digest.alias("_hash"), F.xxhash64(text_col).alias("_tie")]
    bucket = F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int")
    slim = docs.select(*place).withColumn("_bucket", bucket)
    buckets = cut(slim.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_words")))
    sources = buckets.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1
    sources = sources.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn.cast("int")))
    plan = water_fill(sources, share, max_epochs)
    plan = plan.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("_part", F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size")))
    # the bucket in which the fraction of an epoch ends
    below = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = buckets.withColumn("_below", F.coalesce(F.sum("_words").over(below), F.lit(0))).withColumnRenamed("_source", "_of")
    edges = edges.join(plan.select("_source", "_part"), F.col("_of").eqNullSafe(F.col("_source")))
    edges = edges.where((F.col("_below") <= F.col("_part")) & (F.col("_part") < F.col("_below") + F.col("_words"))).select("_of", F.col("_bucket").alias("_edge"), "_below")
    plan = cut(plan.join(edges, F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of").withColumnRenamed("_source", "_of"))
    few = F.broadcast if plan.count() <= MOST_SOURCES else (lambda df: df)  # beyond, AQE splits the large sources of a sort-merge join
    # entries of edge buckets are ordered by digest; a row is in if no more than half of it is above the target
    entry = ["_hash", "_size", "_tie"]
    before = Window.partitionBy("_source").orderBy(*entry).rowsBetween(Window.unboundedPreceding, -1)
    at_edge = slim.join(few(plan.where("_edge is not null")), F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_bucket") == F.col("_edge")))
    at_edge = at_edge.groupBy("_source", *entry).agg(F.count("*").alias("_rows"), F.first("_below").alias("_below"), F.first("_part").alias("_part"))
    at_edge = at_edge.withColumn("_room", F.col("_part") - F.col("_below") - F.coalesce(F.sum(F.col("_size") * F.col("_rows")).over(before), F.lit(0)))
    fit = F.when(F.col("_size") == 0, F.col("_rows")).otherwise(F.least(F.col("_rows"), F.floor(F.col("_room") / F.col("_size") + 0.5)))
    at_edge = at_edge.withColumn("_fit", fit.cast("long")).where("_fit > 0")
    last = F.max(F.struct(F.struct(*entry).alias("key"), "_fit", (F.col("_fit") < F.col("_rows")).alias("torn")))
    plan = cut(plan.join(at_edge.groupBy("_source").agg(last.alias("_last")), F.col("_of").eqNullSafe(F.col("_source")), "left").drop("_source"))
    rows = docs.select(*hidden, *place).withColumn("_bucket", bucket).join(few(plan), F.col("_source").eqNullSafe(F.col("_of")), "left")
    key = F.struct(*entry)
    inside = (F.col("_bucket") < F.col("_edge")) | ((F.col("_bucket") == F.col("_edge")) & F.coalesce(key <= F.col("_last.key"), F.lit(False)))

    def counted(part: DataFrame, taken: Column) -> DataFrame:
        copies = F.col("_whole") + F.when(taken, 1).otherwise(0)
        return part.select(*shown, F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * copies).cast("long").alias("taken"))

    if plan.where("_last.torn").isEmpty():
        return counted(rows, inside)
    torn = F.coalesce(F.col("_last.torn") & (key == F.col("_last.key")), F.lit(False))
    equal = cut(rows.where(torn).withColumn("_at", F.spark_partition_id()))
    parts = equal.groupBy("_of", "_at").agg(F.count("*").alias("_n"))
    parts = parts.withColumn("_first", F.coalesce(F.sum("_n").over(Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.select(F.col("_of").alias("_of2"), F.col("_at").alias("_at2"), "_first")
    number = F.row_number().over(Window.partitionBy("_of", "_at").orderBy("_hash"))
    numbered = equal.withColumn("_number", number).join(parts, F.col("_of").eqNullSafe(F.col("_of2")) & (F.col("_at") == F.col("_at2")))
    return counted(rows.where(~torn), inside).unionByName(counted(numbered, F.col("_first") + F.col("_number") <= F.col("_last._fit")))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as the mix takes it, with the columns of ``docs`` (but for those named like results).

    Documents without words have nothing to take, and so no copy.
    """
    counted = mix_sources(docs, **options)
    copies = (F.col("taken") / F.col("size")).cast("int")
    taken = counted.where((F.col("size") > 0) & (F.col("taken") > 0))
    others = [c for c in docs.columns if c not in MADE]
    each = taken.select(*(F.col(f"`{c}`").alias(f"_tp_c{i}") for i, c in enumerate(others)), F.explode(F.sequence(F.lit(1), copies)))
    return each.select(*(F.col(f"_tp_c{i}").alias(c) for i, c in enumerate(others)))

"""A vector index of cells for nearest neighbours by cosine distance, with conditions on source.

``build`` fits centroids on a bounded sample (``SAMPLE`` rows, the least by a
hash of their id) with Spark's k-means, assigns every row to its nearest one,
and writes rows into a folder per cell, sorted by source, so that a search
reads the folders of the cells that it probes and, in those, the row groups of
its source. ``build`` also measures within that sample, for a bounded number of
its rows as questions, how many cells must be probed to find ``recall`` of
their nearest rows, over all and in each source, and keeps those numbers with
the index. What few questions find differs from what others find, so a number
is enough only if the mean less ``SURE`` standard errors is: of the measured
questions' mean and of that of the questions to come, of which fewer vary more.
Numbers are kept for sets of 1, 2, 4 and more questions. In a sample neighbours
are further apart than among all rows, which is on the safe side; a source that
the sample lacks is searched in all cells.

``search`` probes as many cells as its set of questions needs, where questions
that repeat make a smaller set. ``exact`` instead opens every cell that could
hold a nearer row than the n-th found so far: a row of a cell can't be nearer
to the question than the question's angle to the centroid less the cell's
widest angle. Questions are rows of a frame, all answered in one job: rows and
questions of a cell meet as blocks of bounded size, a matrix product says which
rows of a block can be among a question's n nearest, and of those alone
distances are worked out component by component, in their order, as SQL does.

Defined results: rows without an id or vector, with a null, a component that
isn't finite or length zero aren't indexed and answer nothing, nor do questions
of another number of components; ties go to the lesser id; a row isn't its own
neighbour if ``others`` is set.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import folded
from ..functions.values import dot, unit
from ..sources.readers import read_text, write_text

ABOUT = "_index.json"
#: Rows that centroids are fitted on and that recall is measured for; both bounds are parameters of ``build``.
SAMPLE, QUESTIONS = 20_000, 200
#: Standard errors by which a measured recall must lie above the promised one, and the sizes of sets of questions that numbers of probes are kept for.
SURE, SETS = 3.0, tuple(1 << i for i in range(11))
#: Questions and centroids are compared in the driver's plan as literals; so many cells at most.
MOST_CELLS = 4096
#: Angles are compared with this allowance for rounding.
SLACK = 1e-9
#: Bytes of a block of vectors, questions of a block, tasks that a cell's questions are packed in, and products or components that are held at once.
BLOCK, ASKED, DEALT, HELD = 1 << 22, 1024, 4, 1 << 22


@dataclass(frozen=True)
class VectorIndex:
    path: str
    cells: int
    probes: int
    by_source: dict[str, int]
    recall: float
    centroids: tuple[tuple[float, ...], ...]
    widest: tuple[float, ...]
    #: Probes for sets of ``SETS`` questions; ``probes`` and ``by_source`` are those of the largest. An index written without them has only those.
    by_set: tuple[int, ...] = ()
    by_source_set: dict[str, tuple[int, ...]] = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        said = read_text(spark, f"{path}/{ABOUT}")
        if said is None:
            raise FileNotFoundError(f"no vector index at {path}")
        about = json.loads(said)
        sets = {"by_set": tuple(about.get("by_set", ())), "by_source_set": {k: tuple(v) for k, v in about.get("by_source_set", {}).items()}}
        return cls(**{**about, "path": path, "centroids": tuple(map(tuple, about["centroids"])), "widest": tuple(about["widest"]), **sets})

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")

    def enough(self, source: str | None, asked: Column) -> Column:
        """The number of probes for a set of so many questions."""
        if source is not None:
            last, of = self.by_source.get(source, self.cells), self.by_source_set.get(source, ())
        else:
            last, of = self.probes, self.by_set
        return F.coalesce(*(F.when(asked >= size, F.lit(probes)) for size, probes in reversed(list(zip(SETS, of)))), F.lit(self.cells if of else last))


def usable(c: Column) -> Column:
    """Vectors that have a direction."""
    return c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(c, lambda v: v != 0)


def _angles(v: Column, centroids: list[list[float]]) -> Column:
    """(angle, cell) to every centroid."""
    table = F.from_json(F.lit(json.dumps(centroids)), "array<array<double>>")
    return F.transform(table, lambda c, i: F.struct(_angle(dot(v, c)).alias("angle"), i.alias("cell")))


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def _fit(sample: DataFrame, cells: int, seed: int) -> tuple[KMeansModel | None, list[list[float]]]:
    """k-means by cosine, and its centroids as unit vectors; without rows, none."""
    features = sample.select(array_to_vector("v").alias("features"))
    if features.isEmpty():
        return None, []
    model = KMeans(k=cells, seed=seed, maxIter=15, initMode="random", distanceMeasure="cosine").fit(features)
    norms = [math.sqrt(sum(x * x for x in c)) or 1.0 for c in model.clusterCenters()]
    return model, [[float(x / norm) for x in c] for c, norm in zip(model.clusterCenters(), norms)]


def build(
    df: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding", source_col: str | None = "source", cells: int = 64, recall: float = 0.9, n: int = 10, sample: int = SAMPLE, questions: int = QUESTIONS, seed: int = 5
) -> VectorIndex:
    """Index every usable row of ``df`` below ``path``; ``n`` is the number of neighbours that recall is measured for."""
    if not 1 <= cells <= MOST_CELLS:
        raise ValueError(f"cells are 1 to {MOST_CELLS}")
    spark = df.sparkSession
    x = F.col(vector_col).cast("array<double>")
    rows = df.where(F.col(id_col).isNotNull() & usable(x)).select(F.col(id_col).alias("id"), (folded(source_col) if source_col else F.lit("")).alias("source"), unit(x).alias("v"))
    few = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).persist()  # read once, used for the fit and for recall
    model, centroids = _fit(few, cells, seed)
    if model is None:
        raise ValueError("there is no row that can be indexed")
    table = F.from_json(F.lit(json.dumps(centroids)), "array<array<double>>")
    placed = model.setPredictionCol("cell").setFeaturesCol("_features").transform(rows.withColumn("_features", array_to_vector("v")))
    placed = placed.select("id", "source", "v", _angle(dot("v", F.get(table, F.col("cell")))).alias("angle"), "cell")
    parts = max(len(centroids), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a cell of any share of the rows is dealt out to several tasks
    placed.repartition(parts, "cell", F.pmod(F.xxhash64("id"), F.lit(max(1, parts // 8)))).sortWithinPartitions("cell", "source", "id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    widest = {r.cell: r.angle for r in spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.max("angle").alias("angle")).collect()}  # a row a cell
    found = spark.read.parquet(f"{path}/rows").join(few.select("id"), "id", "left_semi")
    by_set, by_source_set = _calibrated(found, centroids, few.limit(questions), recall, n)
    few.unpersist()
    by_source = {k: v[-1] for k, v in by_source_set.items()}
    index = VectorIndex(path, len(centroids), by_set[-1], by_source, recall, tuple(map(tuple, centroids)), tuple(widest.get(i, -1.0) for i in range(len(centroids))), by_set, by_source_set)
    write_text(spark, f"{path}/{ABOUT}", json.dumps({k: v for k, v in asdict(index).items() if k != "path"}))
    return index


def _calibrated(rows: DataFrame, centroids: list[list[float]], asked: DataFrame, recall: float, n: int) -> tuple[tuple[int, ...], dict[str, tuple[int, ...]]]:
    """The least numbers of probes that surely find ``recall`` of the n nearest ``rows`` of sets of ``SETS`` questions: over all, and by source."""
    order = F.transform(F.array_sort(_angles(F.col("v"), centroids)), lambda a: a["cell"])
    questions = [[r.id, list(r.v), list(r.cells)] for r in asked.select(F.col("id").cast("string").alias("id"), "v", order.alias("cells")).collect()]  # as many as the caller bounds
    table = F.from_json(F.lit(json.dumps([{"id": i, "q": v, "cells": c} for i, v, c in questions])), "array<struct<id:string,q:array<double>,cells:array<int>>>")
    pairs = rows.select("*", F.explode(table).alias("a")).where(F.col("id").cast("string") != F.col("a.id"))
    pairs = pairs.select("source", F.col("a.id").alias("query"), "id", dot("v", "a.q").alias("near"), F.array_position("a.cells", F.col("cell")).alias("probe"))
    place = lambda *by: F.row_number().over(Window.partitionBy("query", *by).orderBy(F.desc("near"), "id"))
    nearest = pairs.withColumn("r", place("source")).where(F.col("r") <= n).withColumn("all", place() <= n)
    nearest = nearest.select("query", "probe", "source", F.explode(F.when(F.col("all"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("all"))
    nearest = nearest.withColumn("source", F.when(~F.col("all"), F.col("source")))
    # a question's share of t grows by 1/t with its i-th hit, and the square of its share by (2i - 1)/t^2
    w = Window.partitionBy("all", "source", "query")
    hits = nearest.withColumn("i", F.row_number().over(w.orderBy("probe"))).withColumn("t", F.count("*").over(w))
    grown = hits.groupBy("all", "source", "probe").agg(F.sum(1 / F.col("t")).alias("share"), F.sum((2 * F.col("i") - 1) / (F.col("t") * F.col("t"))).alias("square"), F.count_if(F.col("i") == 1).alias("asked"))
    found: dict[tuple[bool, str | None], dict[int, tuple[float, float, int]]] = {}
    for r in grown.collect():  # a row a source and cell at most
        found.setdefault((r["all"], r.source), {})[r.probe] = (r.share, r.square, r.asked)

    def least(of: dict[int, tuple[float, float, int]]) -> tuple[int, ...]:
        enough, m = [len(centroids)] * len(SETS), sum(asked for _, _, asked in of.values())
        share = square = 0.0
        sums = []
        for probe in range(1, len(centroids) + 1):
            more = of.get(probe, (0.0, 0.0, 0))
            share, square = share + more[0], square + more[1]
            sums.append((share, square))
        for at, size in enumerate(SETS):
            for probe, (share, square) in enumerate(sums, 1):
                if m > 1 and share / m - SURE * math.sqrt(max(0.0, square - share * share / m) / (m - 1) * (1 / size + 1 / m)) >= recall:
                    enough[at] = probe
                    break
        return tuple(enough)

    return least(found.get((True, None), {})), {k: least(v) for (over_all, k), v in found.items() if not over_all and k is not None}


def search(
    spark: SparkSession, index: VectorIndex, asked: DataFrame, n: int = 5, source: str | None = None, exact: bool = False, probes: int | None = None, id_col: str = "query_id", vector_col: str = "embedding",
    others: bool = False,
) -> DataFrame:
    """(query_id, rank, id, distance): the n nearest rows of each question, of one source if it is given."""
    x = F.col(vector_col).cast("array<double>")
    q = asked.where(usable(x) & (F.size(x) == len(index.centroids[0]))).select(F.col(id_col).alias("query_id"), unit(x).alias("q"))
    near = F.array_sort(_angles(F.col("q"), [list(c) for c in index.centroids]))
    probed = q.withColumn("_near", near)
    if exact:
        found = _opened(spark, index, probed, n, source, others)
    else:
        if probes:
            many = F.lit(max(1, min(index.cells, probes)))
        else:
            # a set's size is that of one of different questions whose mean varies as much
            size = q.groupBy(F.xxhash64("q")).agg(F.count("*").cast("double").alias("c")).agg((F.sum("c") * F.sum("c") / F.sum(F.col("c") * F.col("c"))).alias("_asked"))
            probed, many = probed.crossJoin(F.broadcast(size)), index.enough(source.strip().lower() if source else None, F.col("_asked"))
        pairs = probed.select("query_id", "q", F.explode(F.transform(F.slice("_near", F.lit(1), many), lambda a: a["cell"])).alias("cell"))
        found = _scored(spark, index, pairs, n, source, others)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return ranked.select("query_id", "rank", "id", "distance")


def _scored(spark: SparkSession, index: VectorIndex, pairs: DataFrame, n: int, source: str | None, others: bool) -> DataFrame:
    """(query_id, id, cell, distance) of the n nearest rows in every block of a question's cells."""
    rows = index.rows(spark)
    if source:
        rows = rows.where(F.col("source") == source.strip().lower())
    asked_type, id_type, dimensions = pairs.schema["query_id"].dataType, rows.schema["id"].dataType, len(index.centroids[0])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, -(-parts // index.cells))  # a cell's blocks are dealt out to so many tasks
    field = lambda name, kind: T.StructField(name, kind)
    of_row = T.StructType([field("cell", T.IntegerType()), field("salt", T.IntegerType()), field("ids", T.ArrayType(id_type)), field("vs", T.BinaryType())])
    of_asked = T.StructType([field("cell", T.IntegerType()), field("query_ids", T.ArrayType(asked_type)), field("own", T.ArrayType(id_type)), field("qs", T.BinaryType())])
    blocks = rows.select(F.col("cell").cast("int"), "id", "v").mapInArrow(_packer(max(1, BLOCK // (8 * dimensions)), 1, salts), of_row)
    dealt = pairs.select(F.col("cell").cast("int"), "query_id", F.col("query_id").try_cast(id_type).alias("own"), "q").repartition("cell", F.pmod(F.xxhash64("query_id"), F.lit(DEALT)))
    questions = dealt.sortWithinPartitions("cell").mapInArrow(_packer(ASKED, 2, None), of_asked)
    both = blocks.join(questions.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["cell", "salt"]).select("cell", "ids", "vs", "query_ids", "own", "qs")
    out = T.StructType([field("query_id", asked_type), field("id", id_type), field("cell", T.IntegerType()), field("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, vs, qs = (batch.column(c).to_pylist() for c in ("cell", "vs", "qs"))
            for i in range(batch.num_rows):
                ids, asked, own = (batch.column(c)[i].values for c in ("ids", "query_ids", "own"))
                v, q = (np.frombuffer(x[i], np.float64).reshape(-1, dimensions) for x in (vs, qs))
                for question, row, distance in _nearest(v, q, n, _same(own, ids) if others else None):
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(question)), ids.take(pa.array(row)), pa.array([cell[i]] * len(row), pa.int32()), pa.array(distance)], names=out.names)

    found = both.mapInArrow(run, out)
    return found.where(F.col("id") != F.col("query_id")) if others else found


def _packer(most: int, ids: int, salts: int | None):
    """Rows of (cell, columns of ids, vector) as rows of so many at most of one cell, in the order of the first ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = pc.sort_indices(batch, [("cell", "ascending"), (batch.schema.names[1], "ascending")])
            batch = batch.take(order)
            cells, v = batch.column(0).to_numpy(), batch.column(1 + ids)
            flat, width = v.flatten().to_numpy(), len(v[0]) if batch.num_rows else 0
            at = 0
            while at < len(cells):
                end = min(at + most, int(np.searchsorted(cells, cells[at], "right")))
                packed = flat[at * width : end * width].tobytes()
                salt = [] if salts is None else [pa.array([zlib.crc32(packed) % salts], pa.int32())]
                lists = [pa.ListArray.from_arrays(pa.array([0, end - at], pa.int32()), batch.column(k).slice(at, end - at)) for k in range(1, 1 + ids)]
                columns = [pa.array([cells[at]], pa.int32()), *salt, *lists, pa.array([packed], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", *([] if salts is None else ["salt"]), *(["ids"] if ids == 1 else ["query_ids", "own"]), "vs" if ids == 1 else "qs"])
                at = end

    return run


def _same(own: pa.Array, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(question, row) where a question's id is a row's."""
    left = pa.table({"id": own, "question": pa.array(np.arange(len(own)))})
    both = left.join(pa.table({"id": ids, "row": pa.array(np.arange(len(ids)))}), "id", join_type="inner", use_threads=False)
    return both["question"].to_numpy(), both["row"].to_numpy()


def _nearest(v: np.ndarray, q: np.ndarray, n: int, same: tuple[np.ndarray, np.ndarray] | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(question, row, distance) of the n nearest rows of each question, ties to the lesser row.

    The products' sums may be taken in any order, so rows within their rounding of the n-th are compared again.
    """
    step, slack = max(1, HELD // len(v)), 1e-15 * (v.shape[1] + 16)
    for low in range(0, len(q), step):
        some = q[low : low + step]
        near = some @ v.T
        if same is not None:
            here = (same[0] >= low) & (same[0] < low + step)
            near[same[0][here] - low, same[1][here]] = -np.inf
        least = np.partition(near, len(v) - n, axis=1)[:, len(v) - n] if len(v) > n else np.full(len(some), -np.inf)
        question, row = np.nonzero(near >= np.maximum(least - slack, -2.0)[:, None])  # without the rows left out
        distance = np.empty(len(row))
        for at in range(0, len(row), held := max(1, HELD // v.shape[1])):
            a, b = some[question[at : at + held]], v[row[at : at + held]]
            total = np.zeros(len(a))
            for k in range(v.shape[1]):
                total += a[:, k] * b[:, k]
            distance[at : at + held] = 1.0 - total
        order = np.lexsort((row, distance, question))
        question, row, distance = question[order], row[order], distance[order]
        kept = np.arange(len(row)) - np.searchsorted(question, question) < n
        yield question[kept] + low, row[kept], distance[kept]


def _opened(spark: SparkSession, index: VectorIndex, probed: DataFrame, n: int, source: str | None, others: bool) -> DataFrame:
    """Scores from the cells of the first guess, and from those others that could hold a nearer row than its n-th."""
    guess = max(1, min(index.cells, index.probes if index.probes < index.cells else index.cells // 4))
    cells = probed.select("query_id", "q", F.posexplode("_near").alias("at", "a")).select("query_id", "q", "at", "a.angle", "a.cell")
    widest = F.from_json(F.lit(json.dumps(list(index.widest))), "array<double>")
    least = F.greatest(F.lit(0.0), F.col("angle") - F.get(widest, F.col("cell")))  # no row of the cell is nearer than this angle
    cells = cells.where(F.get(widest, F.col("cell")) >= 0).withColumn("least", F.lit(1.0) - F.cos(F.least(least, F.lit(math.pi))))
    begun = _scored(spark, index, cells.where(F.col("at") < guess).select("query_id", "q", "cell"), n, source, others)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    kept = begun.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    far = kept.groupBy("query_id").agg(F.when(F.count("*") == n, F.max("distance")).alias("far"))
    rest = cells.where(F.col("at") >= guess).join(far, "query_id", "left").where(F.col("far").isNull() | (F.col("least") <= F.col("far") + SLACK))
    more = _scored(spark, index, rest.select("query_id", "q", "cell"), n, source, others)
    return kept.select("query_id", "id", "cell", "distance").unionByName(more)

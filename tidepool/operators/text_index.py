"""A positional text index on disk, and the lexical ladder from it.

``build`` writes a row a term and block, or a few where a block has many words:
a block is a hash part of the documents, so a term that every document has is
many rows of bounded size and no task gets all of it. A row holds the ids with
the term's places in each, as flat lists, how many there are, and the greatest
number of places that one of them has. Texts are exchanged once by block and
inverted where they then lie; what is exchanged after that is a packed row a
block and folder, not a row a word. Rows lie in folders by a hash of the term
and are sorted by term in their files, so a question reads the folders and row
groups of its own terms and nothing else.

``search`` has the levels of ``retrieval.lexical``: 3 where all terms stand in
a row, 2 where all occur, 1 where one does; only documents of the best level
that any document reaches come back. ``best`` ranks documents by how often the
question's terms occur in them; blocks whose greatest counts can't reach the
n-th place are left unopened.

Defined results: ids are unique, as a store's are (the terms of rows that share
one are taken together); documents without an id aren't indexed; null and empty
texts have no terms; a question without terms finds nothing.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import folded
from ..sources.readers import read_text, write_text
from .retrieval import document_terms, query_terms

ABOUT = "_index.json"
#: Documents of a block that a row of the index has at most, about.
PER_BLOCK = 20_000
#: Documents of a block from which there are more blocks than that, to use all cores; words that a task inverts at once, about.
LEAST_BLOCK, WORDS = 1_000, 1 << 21


@dataclass(frozen=True)
class TextIndex:
    path: str
    buckets: int
    blocks: int
    documents: int
    kept: tuple[str, ...]

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TextIndex:
        said = read_text(spark, f"{path}/{ABOUT}")
        if said is None:
            raise FileNotFoundError(f"no text index at {path}")
        return cls(**{**json.loads(said), "path": path, "kept": tuple(json.loads(said)["kept"])})

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/postings")

    def of_terms(self, spark: SparkSession, terms: list[str]) -> DataFrame:
        """The index's rows of the terms: folders are pruned by hash, row groups by term."""
        if not terms:
            return self.rows(spark).where("false")
        hashed = {_bucket(t.encode(), self.buckets) for t in terms}
        return self.rows(spark).where(F.col("bucket").isin(sorted(hashed)) & F.col("term").isin(*terms))


def _bucket(term: bytes, buckets: int) -> int:
    return zlib.crc32(term) % buckets


def build(df: DataFrame, path: str, id_col: str = "id", document: str = "document", kept: tuple[str, ...] = ("source",), buckets: int = 64, per_block: int = PER_BLOCK) -> TextIndex:
    """Index ``df`` below ``path``; the ``kept`` columns can be conditions of a search. One exchange brings blocks together, one orders the postings."""
    spark = df.sparkSession
    own = ["id", *(f"k_{c}" for c in kept)]
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *(F.col(c).alias(f"k_{c}") for c in kept), F.col(document).alias("document"))
    n = rows.count()
    blocks = max(1, -(-n // per_block), min(4 * spark.sparkContext.defaultParallelism, n // LEAST_BLOCK))
    parts = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    together = rows.withColumn("block", F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.lit(blocks)).cast("int")).repartition(parts, "block").sortWithinPartitions("block", *own)
    lists = [T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in own]
    schema = T.StructType([*T._parse_datatype_string("bucket int, term string, block int, documents int, greatest int").fields, *lists, *T._parse_datatype_string("n array<int>, at array<int>, places array<int>").fields])
    packed = together.select("block", *own, document_terms("document").alias("terms")).mapInArrow(_inverter(own, buckets), "bucket int, block int, packed binary")
    # blocks of a folder are dealt out to several tasks, so a term of all documents is too
    dealt = packed.repartition(parts, "bucket", F.pmod(F.xxhash64("block"), F.lit(-(-parts // buckets)))).mapInArrow(_unpacker(own, schema.names), schema).sortWithinPartitions("bucket", "term", "block")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    index = TextIndex(path, buckets, blocks, n, tuple(kept))
    write_text(spark, f"{path}/{ABOUT}", json.dumps({k: v for k, v in asdict(index).items() if k != "path"}))
    return index


def _inverter(own: list[str], buckets: int):
    """A task's documents, in the order of their blocks and ids, as packed rows."""

    def run(batches):
        held, words, block = [], 0, None
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            size = np.cumsum(batch.column("terms").value_lengths().to_numpy())
            at = 0
            while at < batch.num_rows:
                if held and (blocks[at] != block or words >= WORDS):
                    yield _inverted(held, block, own, buckets)
                    held, words = [], 0
                block, before = blocks[at], size[at - 1] if at else 0
                # to the block's end, or to the document that fills what is inverted at once
                end = min(int(np.searchsorted(blocks, block, "right")), int(np.searchsorted(size, before + WORDS - words)) + 1)
                held.append(batch.slice(at, end - at))
                words += size[end - 1] - before
                at = end
        if held:
            yield _inverted(held, block, own, buckets)

    return run


def _changes(column: pa.Array) -> np.ndarray:
    """Whether a value differs from the one before it; nulls are equal."""
    here, before = column.slice(1), column.slice(0, max(0, len(column) - 1))
    one_null = pc.xor(here.is_null(), before.is_null())
    return np.concatenate([[True][: len(column)], pc.or_(pc.fill_null(pc.not_equal(here, before), False), one_null).to_numpy(zero_copy_only=False)]).astype(bool)


def _starts(*by: np.ndarray) -> np.ndarray:
    """Places at which one of the columns differs from the place before."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(by[0])), bool), np.logical_or.reduce([x[1:] != x[:-1] for x in by])]))


def _inverted(held: list[pa.RecordBatch], block: int, own: list[str], buckets: int) -> pa.RecordBatch:
    """A packed row a folder of these documents, which are sorted by id."""
    columns = {c: pa.concat_arrays([b.column(c) for b in held]) for c in (*own, "terms")}
    sizes = columns["terms"].value_lengths().to_numpy()
    coded = columns["terms"].flatten().dictionary_encode()
    folder = np.array([_bucket(t, buckets) for t in coded.dictionary.cast(pa.binary()).to_pylist()], np.int64)
    by_folder = np.argsort(folder, kind="stable")  # terms in the order of their folders
    code = np.argsort(by_folder)[coded.indices.to_numpy()]
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    new_id = _changes(columns["id"])
    new = np.logical_or.reduce([new_id, *(_changes(columns[c]) for c in own[1:])])
    first = np.flatnonzero(new)  # rows that share id and kept columns are one document
    document = np.repeat(np.cumsum(new) - 1, sizes)
    order = np.argsort(code, kind="stable") if new.all() else np.lexsort((place, document, code))
    code, document, place = code[order], document[order], place[order]
    word = _starts(code, document)  # where an entry begins among words, and a term among entries
    n = np.diff(np.append(word, len(code)))
    term, document = code[word], document[word]
    entry = _starts(term)
    same = _starts(term, (np.cumsum(new_id) - 1)[first][document])
    greatest = np.maximum.reduceat(np.add.reduceat(n, same), np.searchsorted(same, entry)) if len(entry) else n
    terms = coded.dictionary.take(pa.array(by_folder[term[entry]]))
    entry, word = np.append(entry, len(term)), np.append(word, len(code))
    of_row = folder[by_folder][term[entry[:-1]]]
    out = []
    for a, b in zip(first_rows := _starts(of_row).tolist(), [*first_rows[1:], len(of_row)]):
        some = slice(entry[a], entry[b])
        used, number = np.unique(document[some], return_inverse=True)
        values = [terms.slice(a, b - a), np.diff(entry[a : b + 1]), greatest[a:b], number, n[some], place[word[entry[a]] : word[entry[b]]], *(columns[c].take(pa.array(first[used])) for c in own)]
        out.append(_packed([pa.array(x, pa.int32()) if isinstance(x, np.ndarray) else x for x in values]))
    return pa.RecordBatch.from_arrays([pa.array(of_row[first_rows], pa.int32()), pa.array([block] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["bucket", "block", "packed"])


def _packed(values: list[pa.Array]) -> bytes:
    """Arrays of any lengths as one compressed value."""
    row = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in values], names=[str(i) for i in range(len(values))])
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "zstd") as out, pa.ipc.new_stream(out, row.schema) as writer:
        writer.write_batch(row)
    return sink.getvalue().to_pybytes()


def _unpacker(own: list[str], names: list[str]):
    """Packed rows as rows of the index."""

    def listed(values, bounds):
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)

    def run(batches):
        for batch in batches:
            for bucket, block, packed in zip(*(batch.column(i) for i in range(3))):
                row = pa.ipc.open_stream(pa.CompressedInputStream(pa.BufferReader(packed.as_buffer()), "zstd")).read_next_batch()
                terms, documents, greatest, number, n, places, *columns = (c.flatten() for c in row.columns)
                entry = np.concatenate([[0], np.cumsum(documents.to_numpy())])
                word = np.concatenate([[0], np.cumsum(n.to_numpy())])
                at = word[:-1] - np.repeat(word[entry[:-1]], np.diff(entry)) + 1
                made = [pa.array([bucket.as_py()] * len(terms), pa.int32()), terms, pa.array([block.as_py()] * len(terms), pa.int32()), documents, greatest]
                yield pa.RecordBatch.from_arrays([*made, *(listed(c.take(number), entry) for c in columns), listed(n, entry), listed(pa.array(at, pa.int32()), entry), listed(places, word[entry])], names=names)

    return run


def _terms(query: str) -> list[str]:
    """The question's terms as documents have them; repeated ones stay, for the order of a phrase."""
    return [p for t in query_terms(query) for p in re.findall(r"[a-z0-9]+", t)]


def _back(k: int):
    return lambda p: p - F.lit(k)


def _matching(index: TextIndex, rows: DataFrame, source: str | None, places: bool = True) -> DataFrame:
    """(term, id, kept columns, n, places) of the index's rows."""
    own = ["id", *(f"k_{c}" for c in index.kept)]
    # every entry's places are cut out before entries become rows, so that no row carries all of them
    entry = F.transform(F.arrays_zip(*own, "n", "at"), lambda e: F.struct(*(e[c].alias(c) for c in (*own, "n")), *([F.slice("places", e["at"], e["n"]).alias("places")] if places else [])))
    each = rows.select("term", "block", F.explode(entry).alias("e")).select("term", "block", "e.*")
    if source:
        if "source" not in index.kept:
            raise ValueError("the index was made without sources")
        each = each.where(folded("k_source") == source.strip().lower())
    return each.withColumnsRenamed({f"k_{c}": c for c in index.kept})


def search(spark: SparkSession, index: TextIndex, query: str, source: str | None = None) -> DataFrame:
    """(id, kept columns, level) of the documents of the best level reached."""
    q = _terms(query)
    terms = list(dict.fromkeys(q))
    each = _matching(index, index.of_terms(spark, terms), source)
    columns = ["id", *index.kept]
    if not q:
        return each.select(*columns, F.lit(0).alias("level")).where("false")
    have = [F.flatten(F.collect_list(F.when(F.col("term") == t, F.col("places")))).alias(f"_{i}") for i, t in enumerate(terms)]
    found = each.groupBy(*columns).agg(*have)
    level = F.lit(1)
    if len(q) > 1:
        starts = [F.transform(f"_{terms.index(t)}", _back(k)) for k, t in enumerate(q)]
        all_ = reduce(lambda x, y: x & y, (F.size(f"_{i}") > 0 for i in range(len(terms))))
        in_row = F.size(reduce(F.array_intersect, starts)) > 0
        level = F.when(all_ & in_row, 3).when(all_, 2).otherwise(1)
    rows = found.select(*columns, level.alias("level"))
    top = rows.agg(F.max("level").alias("_best"))  # one row
    return rows.join(F.broadcast(top), F.col("level") == F.col("_best")).drop("_best")


def best(spark: SparkSession, index: TextIndex, query: str, n: int = 10) -> DataFrame:
    """(id, occurrences): the n documents with most occurrences of the question's terms, ties to the lesser id.

    A block's documents have at most the sum of its terms' greatest counts. Blocks are opened in two steps: those
    with the greatest bounds first, then those whose bound reaches the n-th place found so far.
    """
    terms = list(dict.fromkeys(_terms(query)))
    rows = index.of_terms(spark, terms)
    bounds = rows.groupBy("block").agg(F.sum("greatest").alias("bound"), F.max("documents").alias("documents"))
    first = [r.block for r in bounds.where(F.col("documents") >= 1).orderBy(F.desc("bound"), "block").limit(max(1, index.blocks // 16)).collect()]

    def ranked(some: DataFrame) -> DataFrame:
        each = _matching(index, some, None, places=False).groupBy("id").agg(F.sum("n").alias("occurrences"))
        return each.orderBy(F.desc("occurrences"), "id").limit(n)

    so_far = ranked(rows.where(F.col("block").isin(first))).collect() if first else []
    least = so_far[-1].occurrences if len(so_far) == n else 0
    open_ = [r.block for r in bounds.where(F.col("bound") >= least).select("block").collect()]
    return ranked(rows.where(F.col("block").isin(open_)))

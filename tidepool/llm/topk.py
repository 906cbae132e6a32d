"""Exact top-k search by inner product: a three-phase uniform threshold.

The components of a vector are dealt to ``SLICES`` nodes; a node's local score
is the inner product over its components and a score is the sum of local ones.

1. Every node gathers its lists of the k best local scores of each query, a row
   a query block and node, over a share of the candidates (one bucket in
   ``PROBED``, or a part of it), and the list of the best sums. The scores of the listed candidates are summed, and the k-th
   best of different ones is a safe cutoff: at least k candidates reach it.
2. The cutoff is sent out with the queries. A block of candidates whose norms
   can't bring any of a block's queries to its cutoff is skipped whole. Of the
   others, the first node's local scores and half of the second's are made; a
   candidate that reaches the cutoff has at least cutoff / nodes on some node,
   whatever the signs, and so a bound on what is left that brings it there.
   Only pairs with such a bound are entries.
3. The remaining components of the entries alone are gathered and resolved. A
   task goes on with the k best it has, which raises its queries' cutoffs.

Both nodes of a block lie in one row, so entries needn't leave their task: they
are several hundredths of all pairs, many times the table. A query that has no
cutoff yet (fewer than k candidates so far) and scores beyond 2^52 are made
from whole local scores.

Vectors and queries lie in blocks of about ``BYTES``. Queries are dealt to
groups and candidates to buckets, and a group meets a bucket in one shard, so
the table is sent once a group (of ``GROUP`` bytes), not once a block. Only
lists leave a task: k entries a query. Cutoffs travel inside the query blocks:
nothing that grows with the input is broadcast.

Scores are exact at any size: components lie in blocks by magnitude, and a
product of two blocks is made in doubles, long or unbounded integers, whichever
can't round.

Defined results: a vector that is null, or holds null or non-finite
components, takes no part, nor does a row without an id; vectors meet only
those of the same length; components are floor(scale * x) with x as double,
and one for which that product isn't finite counts as not finite;
scores beyond a long count as its greatest or least value; ties go to the
smaller id, and rows that share an id are rows of their own, each a candidate
of the others; fewer than k candidates give fewer rows; an empty table gives
an empty result. Only the id and vector columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blobs import cut, shards

#: Nodes; of buckets, one in so many gives the cutoff; bytes of a block, and of the query blocks of a group.
SLICES, PROBED, BYTES, GROUP = 2, 16, 1 << 19, 32 << 20
#: Entries whose remaining components are gathered at once; a share of a cell's pairs from which a quarter node more is made for all first.
GATHERED, MANY = 1 << 15, 0.25
#: Least and most of a long; powers of two up to which inner products stay exact in doubles, and in longs.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
PLAIN, LONG = 52, 61
_BLOCK = "block long, dims int, wide int, n int, ids binary, parts binary, norms binary"
_QUERY = "qblock long, dims int, qwide int, qn int, qids binary, qparts binary, homes binary, places binary"


def _norms(x: np.ndarray) -> np.ndarray:
    """Of each vector on each node, rounded up."""
    bounds = _bounds(x.shape[1])
    with np.errstate(over="ignore"):
        return np.stack([np.sqrt((x[:, a:b] ** 2).sum(axis=1)) * (1 + 1e-9) for a, b in zip(bounds[:-1], bounds[1:])], axis=1)


def _bounds(dims: int) -> list[int]:
    return [dims * s // SLICES for s in range(SLICES + 1)]


def _rows_of(dims: int) -> int:
    return min(4096, max(16, BYTES // (8 * max(1, dims))))


def _record(values: list, fields: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    named = [f.split() for f in fields.split(", ")]
    arrays = [pa.array([v.tobytes() if isinstance(v, np.ndarray) else v], kinds[kind]) for v, (_, kind) in zip(values, named)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in named])


def _pack(scale: float):
    """Vectors to blocks of one length and one class of magnitude."""

    def run(batches):
        held: dict[tuple[int, int], list] = {}
        made = 0
        part = TaskContext.get().partitionId()

        def block(kind):
            nonlocal made
            ids, rows = zip(*held.pop(kind))
            made += 1
            x = np.stack(rows)
            return _record([(part << 24) + made, kind[0], kind[1], len(ids), np.array(ids, np.int64), x, _norms(x)], _BLOCK)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).tolist()
            lists = batch.column(1)
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            with np.errstate(over="ignore"):
                values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                x = values[a:b]
                top = np.abs(x).max(initial=0.0)
                with np.errstate(over="ignore"):
                    most = top * top * (b - a)  # of any inner product with such vectors
                kind = (b - a, 0 if most <= 2.0**PLAIN else 1 if most <= 2.0**LONG else 2)
                held.setdefault(kind, []).append((ids[i], x))
                if len(held[kind]) == (_rows_of(b - a) if kind[1] == 0 else 64):
                    yield block(kind)
        for kind in list(held):
            yield block(kind)

    return run


def _queries_of(every: int):
    """The rows of blocks that are queries, in blocks of their own, with the block and place that each comes from."""

    def run(batches):
        held: dict[tuple[int, int], list] = {}
        made = 0
        part = TaskContext.get().partitionId()

        def block(kind):
            nonlocal made
            ids, x, homes, places = (np.concatenate(c) for c in zip(*held.pop(kind)))
            most = _rows_of(kind[0]) // 2
            for at in range(0, len(ids), most):
                upto = slice(at, at + most)
                made += 1
                yield _record([(part << 24) + made, *kind, len(ids[upto]), ids[upto], x[upto], homes[upto], places[upto]], _QUERY)

        for batch in batches:
            for i in range(batch.num_rows):
                number, dims, wide, n = (batch.column(c)[i].as_py() for c in range(4))
                ids = np.frombuffer(batch.column(4)[i].as_buffer(), np.int64)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    x = np.frombuffer(batch.column(5)[i].as_buffer(), np.float64).reshape(n, dims)[at]
                    parts = held.setdefault((dims, wide), [])
                    parts.append((ids[at], x, np.full(len(at), number), at.astype(np.int64)))
                    if sum(len(p[0]) for p in parts) >= _rows_of(dims) // 2:
                        yield from block((dims, wide))
        for kind in list(held):
            yield from block(kind)

    return run


@dataclass
class _Cell:
    """A query block and a candidate block."""

    name: tuple[int, int]
    query: np.ndarray  # ids
    homes: np.ndarray
    places: np.ndarray
    q: np.ndarray
    block: int
    ids: np.ndarray
    c: np.ndarray
    norms: np.ndarray
    wide: int
    cutoff: np.ndarray | None

    def node(self, s: int) -> np.ndarray:
        """Local scores on a node, exactly."""
        bounds = _bounds(self.q.shape[1])
        q, c = self.q[:, bounds[s] : bounds[s + 1]], self.c[:, bounds[s] : bounds[s + 1]]
        if self.wide:  # beyond doubles: long integers, or unbounded ones
            if self.wide == 2 and not q.shape[1]:
                return np.zeros((len(q), len(c)), object)
            q, c = (x.astype(np.int64) if self.wide == 1 else np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape) for x in (q, c))
        return q @ c.T

    def key(self) -> np.ndarray:
        return self.block * 4096 + np.arange(len(self.ids))

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.homes == self.block)
        return at, self.places[at]


def _longs(x: np.ndarray) -> np.ndarray:
    """As long integers, saturated where they are unbounded ones."""
    return np.array([min(max(int(v), LEAST), MOST) for v in x.ravel()], np.int64).reshape(x.shape) if x.dtype == object else x.astype(np.int64)


def _doubles(x: np.ndarray) -> np.ndarray:
    if x.dtype != object:
        return x.astype(np.float64)
    return np.array([float(v) if abs(v) < 1 << 1000 else np.copysign(np.inf, v >> 900) for v in x.ravel()]).reshape(x.shape)


def _cells(batches) -> Iterator[_Cell]:
    for batch in batches:
        col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            array = lambda name, t=np.int64: np.frombuffer(col[name][i].as_buffer(), t)  # noqa: E731, B023
            dims, n, qn = col["dims"][i].as_py(), col["n"][i].as_py(), col["qn"][i].as_py()
            wide = max(col["wide"][i].as_py(), col["qwide"][i].as_py())
            cutoff = array("cutoffs") if "cutoffs" in col and col["cutoffs"][i].is_valid else None
            q, c = array("qparts", np.float64).reshape(qn, dims), array("parts", np.float64).reshape(n, dims)
            norms = array("norms", np.float64).reshape(n, SLICES)
            yield _Cell((col["qblock"][i].as_py(), dims), array("qids"), array("homes"), array("places"), q, col["block"][i].as_py(), array("ids"), c, norms, wide, cutoff)


def _best(k: int, *columns: np.ndarray) -> list[np.ndarray]:
    """The k best of each row by the first column, ties to the smaller in the others; columns are (rows, entries)."""
    order = np.lexsort((*columns[:0:-1], ~columns[0]), axis=1)
    return [np.take_along_axis(c, order[:, :k], axis=1) for c in columns]


def _phase_one(k: int, part: float, products):
    """The k best local scores of each query on each node, and the k best sums, of a part of each block, with those candidates' scores."""

    def run(batches):
        lists: dict[tuple, list[np.ndarray]] = {}
        for cell in _cells(batches):
            some = max(k + 1, math.ceil(len(cell.ids) * part))
            cell.ids, cell.c = cell.ids[:some], cell.c[:some]
            local = [cell.node(s) for s in range(SLICES)]
            products.add(cell.q.shape[0] * cell.c.size)
            row, place = (x[cell.own()[1] < some] for x in cell.own())
            for s, listed in enumerate([*local, sum(local)]):
                x = _longs(listed).copy()
                x[row, place] = LEAST
                top = np.argpartition(x, max(0, x.shape[1] - k), axis=1)[:, -k:]
                score = _longs(sum(np.take_along_axis(y, top, axis=1) for y in local))
                key, listed = cell.key()[top], np.take_along_axis(x, top, axis=1)
                mine = (cell.homes[:, None] == cell.block) & (cell.places[:, None] == top)
                key, score, listed = np.where(mine, -1, key), np.where(mine, LEAST, score), np.where(mine, LEAST, listed)
                name = (*cell.name, s)
                if name in lists:
                    key, score, listed = (np.concatenate(c, axis=1) for c in zip(lists[name], (key, score, listed)))
                listed, key, score = _best(k, listed, key, score)
                lists[name] = [key, score, listed]
        for (block, dims, s), (key, score, _) in lists.items():
            yield _record([block, dims, s, key.shape[1], np.ascontiguousarray(key), np.ascontiguousarray(score)], "qblock long, dims int, node int, width int, keys binary, scores binary")

    return run


def _cutoffs(k: int):
    """The k-th best score of the different candidates that nodes have listed for each query; the least long without so many."""

    def run(batches):
        found: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                name = (r["qblock"], r["dims"])
                key, score = (np.frombuffer(r[c], np.int64).reshape(-1, r["width"]) for c in ("keys", "scores"))
                if name in found:
                    key, score = (np.concatenate(c, axis=1) for c in zip(found[name], (key, score)))
                order = np.argsort(key, axis=1, kind="stable")
                key, score = (np.take_along_axis(c, order, axis=1) for c in (key, score))
                again = np.zeros(key.shape, bool)
                again[:, 1:] = key[:, 1:] == key[:, :-1]
                score, key = _best(k, np.where(again, LEAST, score), np.where(again, -1, key))
                found[name] = [key, score]
        for (block, dims), (_, score) in found.items():
            cutoff = score[:, k - 1] if score.shape[1] >= k else np.full(len(score), LEAST)
            yield _record([block, dims, np.ascontiguousarray(cutoff)], "qblock long, dims int, cutoffs binary")

    return run


def _entries(cell: _Cell, cutoff: np.ndarray, free: np.ndarray, alive: np.ndarray, reach: np.ndarray, products) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the pairs of a cell that can reach their cutoffs."""
    bounds = _bounds(cell.q.shape[1])
    whole = cell.q.shape[0] * cell.c.shape[0]
    entries = np.broadcast_to(alive[:, None], (len(cell.q), len(cell.ids))).copy()
    entries[cell.own()] = False
    if cell.wide or free.any() or bounds[1] < 2:
        # no cutoff yet, or scores that doubles don't hold: local scores of whole nodes, and entries by the uniform share
        share = np.where(free, -np.inf, cutoff / SLICES - np.abs(cutoff) * 1e-15)[:, None]
        local: list[np.ndarray | None] = [None] * SLICES
        listed = np.zeros(entries.shape, bool)
        for s in range(SLICES):
            if (alive & (reach[:, s] >= share[:, 0])).any():
                local[s] = cell.node(s)
                products.add(whole * (bounds[s + 1] - bounds[s]))
                listed |= _doubles(local[s]) >= share
        i, j = np.nonzero(entries & listed)
        for s in range(SLICES if len(i) else 0):
            if local[s] is None:
                local[s] = cell.node(s)
                products.add(whole * (bounds[s + 1] - bounds[s]))
        return i, j, _longs(sum(x[i, j] for x in local)) if len(i) else np.zeros(0, np.int64)
    # the first node's list and the first half of the second's; a pair that what is left can't bring to its cutoff goes no further
    at, so_far = bounds[1], cell.node(0)
    for upto in ((bounds[1] + bounds[2]) // 2, (bounds[1] + 3 * bounds[2]) // 4):
        so_far = so_far + cell.q[:, at:upto] @ cell.c[:, at:upto].T
        at = upto
        left = np.sqrt((cell.q[:, at:] ** 2).sum(axis=1))[:, None] * np.sqrt((cell.c[:, at:] ** 2).sum(axis=1))[None, :] * (1 + 1e-9)
        entries &= so_far + left >= cutoff[:, None].astype(np.float64) - 2  # sums of whole numbers below 2^52 are off by 1 at most
        if np.count_nonzero(entries) < MANY * whole:
            break
    i, j = np.nonzero(entries)
    products.add(whole * at + len(i) * (cell.q.shape[1] - at))
    score = so_far[i, j]
    for begin in range(0, len(i), GATHERED):
        part = slice(begin, begin + GATHERED)
        score[part] += np.einsum("ij,ij->i", cell.q[i[part], at:], cell.c[j[part], at:])
    return i, j, _longs(score)


def _phase_three(k: int, pairs, resolved, products):
    def run(batches):
        best: dict[tuple, list[np.ndarray]] = {}
        about: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for cell in _cells(batches):
            cutoff = cell.cutoff if cell.cutoff is not None else np.full(len(cell.q), LEAST)
            have = best.get(cell.name)
            if have is not None and have[0].shape[1] == k:
                cutoff = np.maximum(cutoff, have[0][:, -1])
            pairs.add(cutoff.size * len(cell.ids))
            own, most = _norms(cell.q), cell.norms.max(axis=0)
            free = cutoff == LEAST
            with np.errstate(over="ignore", invalid="ignore"):
                reach = np.nan_to_num(own * most, nan=np.inf, posinf=np.inf)  # what a node can add at most
            alive = free | (reach.sum(axis=1) >= cutoff)
            if not alive.any():
                continue
            i, j, score = _entries(cell, cutoff, free, alive, reach, products)
            if not len(i):
                continue
            resolved.add(len(i))
            keep = score >= cutoff[i]
            i, j, score = i[keep], j[keep], score[keep]
            # rows of equal width: those of each query, the best first
            order = np.lexsort((cell.ids[j], ~score, i))
            i, j, score = i[order], j[order], score[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            first = rank < k
            i, j, score, rank = i[first], j[first], score[first], rank[first]
            width = int(rank.max(initial=-1)) + 1
            table = [np.full((len(cell.q), width), LEAST), np.ones((len(cell.q), width), bool), np.zeros((len(cell.q), width), np.int64)]
            table[0][i, rank], table[1][i, rank], table[2][i, rank] = score, False, cell.ids[j]
            if have is not None:
                table = [np.concatenate(c, axis=1) for c in zip(have, table)]
            best[cell.name] = _best(k, *table)
            about[cell.name] = (cell.homes, cell.places, cell.query)
        for name, (score, none, ids) in best.items():
            i, j = np.nonzero(~none)
            columns = [*(c[i] for c in about[name]), ids[i, j], score[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["home", "place", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, *, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", counters: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, its k best other rows.

    ``counters`` receives accumulators: "pairs" that cells were asked about,
    those that were "resolved" to their last component, and the "products" of
    components made in all phases; brute force makes as many a pair as there are components.
    """
    spark = vectors.sparkSession
    n = shards(spark)
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < F.lit(float("inf"))))
    valid = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & finite)
    packed = cut(valid.mapInArrow(_pack(scale), _BLOCK))
    asked = cut(packed.mapInArrow(_queries_of(every), _QUERY))
    size = asked.agg(F.sum(F.length("qparts")).alias("bytes"), F.count("*").alias("blocks")).first()
    groups = max(1, -(-max(size.bytes or 0, BYTES // 4 * size.blocks) // GROUP))
    buckets = max(1, min(n, packed.count()))
    counts = {name: spark.sparkContext.accumulator(0) for name in ("pairs", "resolved", "products")}
    if counters is not None:
        counters.update(counts)

    def cells(queries: DataFrame, probed: int) -> DataFrame:
        """Every query block with the candidate blocks of every ``probed``-th bucket, beginning at one of its own."""
        of = lambda key, m: F.pmod(F.xxhash64(key), F.lit(m)).cast("int")
        steps = F.sequence(F.lit(0), F.lit(buckets - 1), F.lit(probed))
        q = queries.withColumn("g", of("qblock", groups)).withColumn("b", F.explode(F.transform(steps, lambda i: (i + of("qblock", buckets)) % buckets)))
        c = packed.withColumn("b", of("block", buckets)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return c.join(q, ["dims", "g", "b"])

    part = min(1.0, buckets / (-(-buckets // PROBED) * PROBED))  # where there are too few buckets to take one in PROBED
    lists = cells(asked, PROBED).mapInArrow(_phase_one(k, part, counts["products"]), "qblock long, dims int, node int, width int, keys binary, scores binary")
    cutoffs = lists.repartition(n, "qblock", "dims").mapInArrow(_cutoffs(k), "qblock long, dims int, cutoffs binary")
    sent = cut(asked.join(cutoffs, ["qblock", "dims"], "left"))
    found = cells(sent, 1).mapInArrow(_phase_three(k, counts["pairs"], counts["resolved"], counts["products"]), "home long, place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("home", "place", "query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Exact top-k search by inner products of whole numbers, block at a time.

A vector is a document whose terms are its dimensions. Documents of a shard are put in an order in which alike ones stand
together, and cut into ranges; of each range the index keeps every term's greatest and least weight. A query's bound for
a range is the sum over terms of what it can get at most there. For each query ranges are taken in order of their bounds, and
scored through their forward indexes (the documents' weights), until the bounds fall below the k-th best score so far.
Queries are packed in blocks that meet the index's shards by a join; neither goes through the driver.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countaxis.llm.neighbours import matrix, nearest_cell
from countaxis.llm.shared import released, stored

#: Documents in a range, weights in a shard and in a block of queries (so rows have about a megabyte), shards that one task searches,
#: and blocks of queries whose best a task holds at once.
RANGE, SHARD_WEIGHTS, QUERY_WEIGHTS, SHARDS, HELD = 64, 1 << 18, 1 << 17, 8, 64
#: Below this, sums of whole numbers are exact in doubles.
EXACT = 2.0**53
#: A score of a pair that isn't one, and the bounds that scores beyond a long are set to.
NONE, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max - 1
SHARD = "shard long, dims int, ids binary, weights binary, most binary, least binary"
BLOCK = "block long, dims int, ids binary, weights binary"


def whole_weights(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, weights (floor(scale * x) of the components as doubles) of rows with an id whose vector is not null and has neither null
    nor non-finite components."""
    x = F.col("embedding")
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).filter(fine & F.col("vec_id").isNotNull())
    return rows.select("vec_id", F.transform("embedding", lambda v: _floor(v * scale)).alias("weights"))


def _floor(x: Column) -> Column:
    """The floor as a double; doubles from 2**53 on are whole already, and may be beyond a long."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


def alike(x: np.ndarray, size: int) -> np.ndarray:
    """An order of vectors in which ranges of ``size`` hold alike ones. Whatever it is, bounds hold; only their tightness differs."""
    cells = -(-len(x) // size)
    if cells < 2 or not x.shape[1]:
        return np.arange(len(x))
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)]
    for _ in range(3):
        own = nearest_cell(x, centres)[0]
        filled = np.bincount(own, minlength=len(centres)) > 0
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = sums[filled] / np.bincount(own, minlength=len(centres))[filled, None]
    own, far = nearest_cell(x, centres)
    return np.lexsort((far, own))


def _packed(rows: DataFrame, most: int, schema: str, pack) -> DataFrame:
    """Rows of vec_id, weights gathered within tasks, by length, to at most ``most`` weights, and made one row by ``pack``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        task, number = TaskContext.get().partitionId(), 0

        def put(d: int) -> pa.RecordBatch:
            ids, x = (np.concatenate(part) for part in zip(*waiting.pop(d), strict=True))
            row = {schema.split()[0]: task << 32 | number, "dims": d, **pack(ids, x)}
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i == 0 else pa.int32() if i == 1 else pa.binary()) for i, v in enumerate(row.values())], list(row))

        for batch in batches:
            ids = np.asarray(batch.column(0))
            for at, m in matrix(batch.column(1)) if batch.num_rows else ():
                d = m.shape[1]
                step = max(1, most // max(1, d))
                low = 0
                while low < len(at):
                    held = sum(len(x) for x, _ in waiting.get(d, []))
                    high = min(len(at), low + step - held)
                    waiting.setdefault(d, []).append((ids[at[low:high]], m[low:high]))
                    if held + high - low >= step:
                        yield put(d)
                        number += 1
                    low = high
        for d in list(waiting):
            yield put(d)
            number += 1
        released()

    return rows.select("vec_id", "weights").mapInArrow(run, schema)


def build_index(vectors: DataFrame) -> DataFrame:
    """Shards of ranges (see the module), written to the shared folder; every row of ``vectors`` (of whole_weights()) is in it."""

    def pack(ids: np.ndarray, x: np.ndarray) -> dict[str, bytes]:
        order = alike(x, RANGE)
        for low in range(0, len(order), RANGE):  # ids rise within a range
            part = order[low : low + RANGE]
            order[low : low + RANGE] = part[np.argsort(ids[part], kind="stable")]
        ids, x = ids[order], x[order]
        edges = np.arange(0, len(x), RANGE)
        most, least = (f.reduceat(x, edges, axis=0) for f in (np.maximum, np.minimum))
        return {"ids": ids.astype("<i8").tobytes(), "weights": _small(x), "most": most.astype("<f8").tobytes(), "least": least.astype("<f8").tobytes()}

    return stored(_packed(vectors, SHARD_WEIGHTS, SHARD, pack), "top-k-index")


def _small(x: np.ndarray) -> bytes:
    """Weights as four bytes each where all fit, else as eight."""
    return x.astype("<i4").tobytes() if not x.size or np.abs(x).max() < 2**31 else x.astype("<f8").tobytes()


def _weights(data: bytes, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, "<i4" if len(data) == 4 * rows * dims else "<f8").reshape(rows, dims).astype(np.float64)


class Shard:
    def __init__(self, dims: int, ids: bytes, weights: bytes, most: bytes, least: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.x = _weights(weights, len(self.ids), dims)
        self.edges = np.append(np.arange(0, len(self.ids), RANGE), len(self.ids))
        self.most, self.least = (np.frombuffer(b, "<f8").reshape(len(self.edges) - 1, dims) for b in (most, least))
        self.largest = float(np.abs(self.x).max()) if self.x.size else 0.0


class Queries:
    """A block of queries and the k best documents of each so far, ties to the smaller id."""

    def __init__(self, dims: int, ids: bytes, weights: bytes, k: int):
        self.ids, self.k = np.frombuffer(ids, "<i8"), k
        self.x = _weights(weights, len(self.ids), dims)
        self.plus, self.minus = np.maximum(self.x, 0), np.minimum(self.x, 0)
        self.largest = float(np.abs(self.x).max()) if self.x.size else 0.0
        self.best = np.full((len(self.ids), k), NONE)
        self.who = np.full((len(self.ids), k), np.iinfo(np.int64).max)
        self.scored = 0

    def take(self, shard: Shard) -> None:
        exact = self.largest * shard.largest * max(1, self.x.shape[1]) < EXACT
        if exact:
            bounds = (self.plus @ shard.most.T + self.minus @ shard.least.T).astype(np.int64)
        else:  # no bound that doubles can tell: all ranges are scored
            bounds = np.full((len(self.ids), len(shard.most)), MOST)
        order = np.argsort(-bounds, axis=1, kind="stable")
        bounds = np.take_along_axis(bounds, order, 1)
        first = shard.ids[shard.edges[:-1]]
        place, width = 0, 1
        while place < order.shape[1]:
            part, bound = order[:, place : place + width], bounds[:, place : place + width]
            kth, last = self.best[:, -1:], self.who[:, -1:]
            if not (bound[:, 0] >= kth[:, 0]).any():
                return
            # A range whose bound is the k-th score can only help by a smaller id.
            q, c = np.nonzero((bound > kth) | (bound == kth) & (first[part] < last))
            ranges = part[q, c]
            sort = np.argsort(ranges, kind="stable")
            q, ranges = q[sort], ranges[sort]
            edges = np.flatnonzero(np.diff(ranges, prepend=-1, append=-1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                self._score(q[a:b], shard, int(ranges[a]), exact)
            place, width = place + width, 2 * width

    def _score(self, q: np.ndarray, shard: Shard, r: int, exact: bool) -> None:
        at = slice(shard.edges[r], shard.edges[r + 1])
        ids, x = shard.ids[at], shard.x[at]
        self.scored += len(q) * len(ids)
        if exact:
            scores = (self.x[q] @ x.T).astype(np.int64)
        else:
            products = np.dot(_whole(self.x[q]), _whole(x).T) if x.shape[1] else np.zeros((len(q), len(x)), object)
            scores = np.array([[min(max(v, -MOST), MOST) for v in row] for row in products], np.int64).reshape(len(q), len(x))
        own = ids == self.ids[q][:, None]
        scores[own] = NONE
        limit = self.best[q, -1]
        if len(ids) >= self.k:
            limit = np.maximum(limit, np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        i, j = np.nonzero((scores >= limit[:, None]) & ~own)
        if not len(i):
            return
        touched = np.unique(q[i])
        who_q = np.concatenate((q[i], np.repeat(touched, self.k)))
        score = np.concatenate((scores[i, j], self.best[touched].ravel()))
        who = np.concatenate((ids[j], self.who[touched].ravel()))
        order = np.lexsort((who, -np.maximum(score, -np.iinfo(np.int64).max), who_q))
        who_q, score, who = who_q[order], score[order], who[order]
        rank = np.arange(len(who_q)) - np.searchsorted(who_q, who_q, "left")
        top = rank < self.k
        self.best[who_q[top], rank[top]], self.who[who_q[top], rank[top]] = score[top], who[top]

    def rows(self) -> pa.RecordBatch:
        have = self.best > NONE
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, have.sum(1))), pa.array(self.who[have]), pa.array(self.best[have])], ["query_id", "vec_id", "score"])


def _whole(x: np.ndarray) -> np.ndarray:
    """Doubles as Python's whole numbers, of any size."""
    out = np.empty(x.shape, object)
    out.ravel()[:] = [int(v) for v in x.ravel().tolist()]
    return out


def search(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k documents with the highest inner products with each of ``queries`` (vec_id,
    weights), other than those of the query's own id; fewer if there are fewer. Exact; ties go to the smaller vec_id.

    Repeated query ids are answered once, by the least of their vectors (as arrays are ordered); documents that repeat an id each stand
    for themselves. Vectors of another length than the query's aren't compared with it. A score beyond a long is given as the greatest or
    least long but one, and such scores tie. Empty tables give no rows. Blocks of queries are dealt to slots of SHARDS shards each, and
    a slot's task keeps the k best of its shards; only these are shuffled.
    """
    queries = queries.groupBy("vec_id").agg(F.min("weights").alias("weights"))
    weights, shards = queries.agg(F.sum(F.size("weights").cast("long"))).head()[0] or 0, index.count()
    block = lambda ids, x: {"ids": ids.astype("<i8").tobytes(), "weights": _small(x)}
    blocks = stored(_packed(queries.repartition(-(-weights // QUERY_WEIGHTS) or 1, "vec_id"), QUERY_WEIGHTS, BLOCK, block), "top-k-queries")
    slots = -(-shards // SHARDS) or 1
    dealt = index.withColumn("slot", F.pmod(F.xxhash64("shard"), F.lit(slots)).cast("int"))
    asked = blocks.select("block", F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("weights").alias("q_weights"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("q_slot"))
    met = dealt.join(asked, (dealt.slot == asked.q_slot) & (dealt.dims == asked.q_dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, Queries] = OrderedDict()
        shard = number = None
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, i=i, batch=batch: batch.column(name)[i].as_py()
                if get("shard") != number:
                    number, shard = get("shard"), Shard(get("dims"), get("ids"), get("weights"), get("most"), get("least"))
                block = get("block")
                if block not in held:
                    if len(held) == HELD:
                        yield held.popitem(last=False)[1].rows()
                    held[block] = Queries(get("dims"), get("q_ids"), get("q_weights"), k)
                held.move_to_end(block)
                held[block].take(shard)
        for state in held.values():
            yield state.rows()
        released()

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    from pyspark.sql import Window as W

    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # each task sends k of them at most before they are dealt by query
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """search() of ``queries`` in an index of all rows of ``vectors`` (vec_id, embedding; others ignored, whatever their names), with
    components made whole by floor(scale * x). Rows whose id is null, or whose vector is null or holds null or non-finite components, take no
    part; vectors of zeros do."""
    return search(build_index(whole_weights(vectors, scale)), whole_weights(queries, scale), k)

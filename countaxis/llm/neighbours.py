"""Nearest neighbours by randomly rotated one-bit codes.

A vector's residual from the centroid is normalised and rotated; its code is the signs, one bit a dimension, packed in 64-bit
words, with correction scalars: the residual's norm, and the inner product of the code's unit vector with the rotated
residual. A query's rotated residual is quantised to four bits a dimension, so an inner product is estimated by counting
bits of words and-ed with the query's bit planes. A few independent rotations give as many codes: the first is looked at for
all vectors, each further one only for those that the error bound so far can't rule out, and what is left is reranked by
exact distances. Vectors of a task are sorted into coarse cells; a block of a cell that no vector of it can be near enough
to by the triangle inequality isn't looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countaxis.llm.shared import stored

#: Vectors in a block of the index at most, and vectors that a task sorts into cells at once.
BLOCK, SORTED = 4096, 32768
#: Coarse cells, and vectors that their centres are taken from (those with the smallest hashes of vec_id).
CELLS, SAMPLE = 32, 4096
#: Rotations, each of which gives a code of one bit a dimension; and bits that a query's components are quantised to.
ROTATIONS, QUERY_BITS = 6, 4
#: Bytes of query vectors broadcast at once; more queries are searched group by group.
QUERY_BYTES = 32 << 20
#: Width of the error bound in standard deviations of the estimate; a wider one reranks more and misses less.
SIGMAS = 4.0
INDEX = "dims int, n int, nearest double, farthest double, centre binary, ids binary, codes binary, norms binary, factors binary, vectors binary"
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of rows with an id whose vector is neither null, empty nor zero and has only finite components."""
    x = F.col("embedding")
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).filter(fine & F.col("vec_id").isNotNull())


def code_bits(dims: int) -> int:
    """Bits of one code: one a dimension, padded to whole words."""
    return -(-dims // 64) * 64


@functools.cache
def rotations(dims: int, seed: int = 7) -> np.ndarray:
    """The first ``dims`` columns of ROTATIONS random orthogonal matrices (what padded vectors need of them); the same each time."""
    out = []
    for i in range(ROTATIONS):
        q, r = np.linalg.qr(np.random.default_rng([seed, dims, i]).standard_normal((code_bits(dims), dims)))
        out.append(q * np.sign(np.diag(r)))
    return np.array(out)


def matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of an array column as matrices, one for each length: positions, matrix."""
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten(), np.float64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return [(np.flatnonzero(lengths == d), flat[starts[lengths == d][:, None] + np.arange(d)]) for d in np.unique(lengths)]


def centroids(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector for each length of vector: sums within tasks, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for _, m in matrix(batch.column(0)) if batch.num_rows else ():
                n, s = sums.get(m.shape[1], (0, 0.0))
                sums[m.shape[1]] = n + len(m), s + m.sum(0)
        rows = [(d, n, list(s)) for d, (n, s) in sums.items()]
        yield pa.RecordBatch.from_pylist([{"dims": d, "n": n, "s": s} for d, n, s in rows], pa.schema([("dims", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.float64()))]))

    parts = vectors.select("embedding").mapInArrow(run, "dims int, n long, s array<double>")
    summed = parts.select("dims", "n", F.posexplode("s").alias("i", "x")).groupBy("dims", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    rows = summed.groupBy("dims").agg(F.array_sort(F.collect_list(F.struct("i", "x", "n"))).alias("s")).collect()
    return {r.dims: np.array([e.x / e.n for e in r.s]) for r in rows}


def cells_of(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vector CELLS centres at most: a few rounds of means over a bounded sample. They only say which vectors
    stand together; the bounds taken from them are exact."""
    out = {}
    rows = vectors.select(F.size("embedding").alias("d"), F.xxhash64("vec_id").alias("h"), "vec_id", "embedding").orderBy("h", "vec_id").limit(SAMPLE).collect()
    for d in {r.d for r in rows}:
        x = np.array([r.embedding for r in rows if r.d == d])
        centres = x[:CELLS].copy()
        for _ in range(4):
            own = nearest_cell(x, centres)[0]
            centres = np.array([x[own == i].mean(0) if (own == i).any() else c for i, c in enumerate(centres)])
        out[d] = centres
    return out


def nearest_cell(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centre, and its distance from it."""
    own = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
    return own, np.sqrt(((x - centres[own]) ** 2).sum(1))


def build_index(vectors: DataFrame, centres: dict[int, np.ndarray], block: int = BLOCK) -> DataFrame:
    """Blocks of codes, correction scalars and vectors, written to the shared folder. Every usable row is in it."""
    cells = cells_of(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        schema = pa.schema([("dims", pa.int32()), ("n", pa.int32()), ("nearest", pa.float64()), ("farthest", pa.float64()), *((x, pa.binary()) for x in ("centre", "ids", "codes", "norms", "factors", "vectors"))])

        def pack(d: int) -> Iterator[pa.RecordBatch]:
            all_ids, all_ = (np.concatenate(x) for x in zip(*waiting.pop(d), strict=True))
            places = cells.get(d, centres[d][None])
            own, far = nearest_cell(all_, places)
            order = np.lexsort((far, own))
            edges = np.flatnonzero(np.concatenate(([True], np.diff(own[order]) != 0, [True])))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                for low in range(a, b, block):
                    at = order[low : min(low + block, b)]
                    ids, m = all_ids[at], all_[at]
                    residual = m - centres[d]
                    norms = np.sqrt((residual * residual).sum(1))
                    rotated = (residual / np.where(norms > 0, norms, 1)[:, None]) @ rotations(d).transpose(0, 2, 1)
                    factors = np.abs(rotated).sum(2) / np.sqrt(code_bits(d))  # inner products of the codes' unit vectors and the residual's
                    row = {
                        "dims": d, "n": len(ids), "nearest": float(far[at].min()), "farthest": float(far[at].max()), "centre": places[own[at[0]]].astype("<f8").tobytes(),
                        "ids": ids.astype("<i8").tobytes(), "codes": np.packbits(rotated > 0, axis=2, bitorder="little").tobytes(),
                        "norms": norms.tobytes(), "factors": factors.tobytes(), "vectors": m.tobytes(),
                    }
                    yield pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column(0))
            for at, m in matrix(batch.column(1)):
                d = m.shape[1]
                for low in range(0, len(at), SORTED):
                    waiting.setdefault(d, []).append((ids[at[low : low + SORTED]], m[low : low + SORTED]))
                    if sum(len(x) for x, _ in waiting[d]) >= SORTED:
                        yield from pack(d)
        for d in list(waiting):
            yield from pack(d)

    return stored(vectors.select("vec_id", "embedding").mapInArrow(run, INDEX), "vector-index")


def distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, summed in order of the components."""
    squares = queries - vectors
    squares *= squares
    return np.sqrt(np.add.accumulate(squares, axis=1)[:, -1])


class Nearest:
    """The k best candidates of each query so far, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        d = queries.shape[1]
        self.bits = code_bits(d)
        residual = queries - centre
        self.norms = np.sqrt((residual * residual).sum(1))
        rotated = (residual / np.where(self.norms > 0, self.norms, 1)[:, None]) @ rotations(d).transpose(0, 2, 1)  # rotation, query, component
        low, high = rotated.min(2), rotated.max(2)
        levels = (1 << QUERY_BITS) - 1
        self.low, self.step = low, np.maximum(high - low, 1e-12) / levels
        whole = np.rint((rotated - low[..., None]) / self.step[..., None]).astype(np.uint8)
        self.total = self.low * self.bits + self.step * whole.sum(2, dtype=np.int64)
        planes = [np.packbits(whole >> j & 1, axis=2, bitorder="little") for j in range(QUERY_BITS)]
        self.planes = np.stack([np.ascontiguousarray(p).view("<u8") for p in planes])  # bit, rotation, query, word
        self.best = np.full((len(ids), k), np.inf)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.estimates = self.reranked = 0

    def estimate(self, r: int, q: np.ndarray, codes: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of unit residuals by rotation ``r``'s codes (words last; q and codes broadcast), and the variances."""
        dot = np.zeros(np.broadcast_shapes(q.shape, codes.shape[:-1]), np.uint16 if self.bits < 4096 else np.uint32)
        for w in range(codes.shape[-1]):
            for j in range(QUERY_BITS):
                dot += np.bitwise_count(codes[..., w] & self.planes[j, r, q, w]).astype(dot.dtype) << j
        ones = np.bitwise_count(codes).sum(-1, dtype=np.int64)
        over = 1 / (np.sqrt(self.bits) * factors)
        product = (2 * self.step[r, q]) * dot * over
        product += (2 * self.low[r, q]) * (ones * over) - self.total[r, q] * over
        error = np.maximum(1 - factors**2, 0) / max(self.bits - 1, 1) / factors**2
        return product, error + self.step[r, q] ** 2 / 12 / factors**2

    def block(self, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, factors: np.ndarray, vectors: np.ndarray, centre: np.ndarray, nearest: float, farthest: float) -> None:
        away = np.sqrt(((self.queries - centre) ** 2).sum(1))
        least = np.maximum(np.maximum(away - farthest, nearest - away), 0)
        may = np.flatnonzero(least <= self.best[:, -1] * (1 + 1e-9) + 1e-9)
        step = max(1, (1 << 20) // len(ids))  # bounds the estimates held at once
        for first in range(0, len(may), step):
            self._some(may[first : first + step], ids, codes, norms, factors, vectors)

    def _some(self, queries: np.ndarray, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, factors: np.ndarray, vectors: np.ndarray) -> None:
        def bounds(q: np.ndarray, c: np.ndarray | slice, total: np.ndarray, spread: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
            scale = 2 * self.norms[q] * norms[c]
            middle = self.norms[q] ** 2 + norms[c] ** 2 - scale * total / n
            slack = SIGMAS * scale * np.sqrt(spread) / n + 1e-6 * (1 + np.abs(middle))
            return middle - slack, middle + slack

        # The first code, for all vectors of the block; the k-th upper bound in it is a limit beside the best so far.
        total, spread = self.estimate(0, queries[:, None], codes[0][None], factors[0][None])
        low, high = bounds(queries[:, None], slice(None), total, spread, 1)
        own = ids == self.ids[queries][:, None]
        limit = self.best[:, -1] ** 2
        if len(ids) > self.k:
            high[own] = np.inf
            limit[queries] = np.minimum(limit[queries], np.partition(high, self.k - 1, axis=1)[:, self.k - 1])
        self.estimates += low.size
        at, c = np.nonzero((low <= limit[queries][:, None] * (1 + 1e-9)) & ~own)
        q, total, spread = queries[at], total[at, c], spread[at, c]
        for r in range(1, ROTATIONS):  # further codes, for those that are left
            if not len(q):
                return
            self.estimates += len(q)
            product, variance = self.estimate(r, q, codes[r][c], factors[r][c])
            total, spread = total + product, spread + variance
            low, high = bounds(q, c, total, spread, r + 1)
            if r == ROTATIONS - 1:
                order = np.lexsort((high, q))
                start = np.flatnonzero(np.concatenate(([True], np.diff(q[order]) != 0)))
                kth = start + self.k - 1
                some = order[kth[kth < np.append(start[1:], len(order))]]
                limit[q[some]] = np.minimum(limit[q[some]], high[some])
            keep = low <= limit[q] * (1 + 1e-9)
            q, c, total, spread = q[keep], c[keep], total[keep], spread[keep]
        if not len(q):
            return
        self.reranked += len(q)
        exact = np.concatenate([distances(self.queries[q[i : i + 65536]], vectors[c[i : i + 65536]]) for i in range(0, len(q), 65536)])
        touched = np.unique(q)
        q = np.concatenate((q, np.repeat(touched, self.k)))
        exact = np.concatenate((exact, self.best[touched].ravel()))
        who = np.concatenate((ids[c], self.who[touched].ravel()))
        order = np.lexsort((who, exact, q))
        q, exact, who = q[order], exact[order], who[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        top = rank < self.k
        self.best[q[top], rank[top]], self.who[q[top], rank[top]] = exact[top], who[top]


def search(index: DataFrame, queries: DataFrame, centres: dict[int, np.ndarray], k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of the k nearest of the index to each of ``queries``
    (vec_id, embedding, usable), other than the query's own id; fewer if there are fewer. Ties go to the smaller vec_id.

    Queries are taken in groups of at most ``query_bytes``; each group passes over all blocks of the index, each task
    keeping the best k of its blocks for each query, and the best of all tasks are kept. Vectors of another length than
    a query's are not compared with it. Repeated queries give one answer; repeated ids in the index each stand for
    themselves, but for one that equals the query's id. Other columns don't matter, whatever their names. Empty tables give
    no rows. What is missed lies outside the error bound of SIGMAS standard deviations.
    """
    spark = queries.sparkSession
    size = queries.agg(F.sum(F.size("embedding").cast("long") * 8)).head()[0] or 0
    groups = max(1, -(-size // query_bytes))
    parts = []
    for g in range(groups):
        own = queries if groups == 1 else queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g)
        rows = own.dropDuplicates(["vec_id"]).collect()
        by_dims: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: r.vec_id):
            by_dims.setdefault(len(r.embedding), []).append(r)
        shared = spark.sparkContext.broadcast({d: (np.array([r.vec_id for r in x]), np.array([r.embedding for r in x])) for d, x in by_dims.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            state: dict[int, Nearest] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    d, n = row["dims"], row["n"]
                    if d in shared.value:
                        if d not in state:
                            state[d] = Nearest(*shared.value[d], centres[d], k)
                        get = lambda x, kind: np.frombuffer(row[x], kind)
                        codes = get("codes", "<u8").reshape(ROTATIONS, n, -1)
                        factors = np.maximum(get("factors", float), 1e-9).reshape(ROTATIONS, n)
                        state[d].block(get("ids", "<i8"), codes, get("norms", float), factors, get("vectors", float).reshape(n, d), get("centre", "<f8"), row["nearest"], row["farthest"])
            for s in state.values():
                have = np.isfinite(s.best)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(s.ids, have.sum(1))), pa.array(s.who[have]), pa.array(s.best[have])], ["query_id", "vec_id", "score"])

        parts.append(index.mapInArrow(run, FOUND))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # Each task sends k rows a query at most; they are summed up query by query, whatever the number of vectors.
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("i", "x")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """search() of ``queries`` in an index of all usable rows of ``vectors`` (vec_id, embedding; others ignored). Rows whose id is
    null, or whose vector is null, empty, zero or holds a null or non-finite component, take no part; equal distances go by
    vec_id; empty tables give no rows."""
    vectors, queries = usable(vectors), usable(queries)
    centres = centroids(vectors)
    return search(build_index(vectors, centres), queries, centres, k)

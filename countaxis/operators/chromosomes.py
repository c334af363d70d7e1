"""Smoothed profiles of groups along chromosomes, for many draws: a chromosome and some draws at a time.

Counts keep a row for each gene and cell, with the cell's numbers of all draws; they are packed, shuffled once by chromosome and slab of
draws, and kept in the shared folder. No table has a row for each draw, group and gene: a task makes one draw's genes x groups of one
chromosome, uses it and drops it. Medians over a group's genes on all chromosomes are exact: values are counted in bins, then those of
the middle bins are gathered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countaxis.operators.shared import cut

#: Draws in a slab, rows that are packed at a time, bins of the values' range for medians.
SLAB, ROWS, BINS = 16, 1 << 18, 4096


def placed(genes: DataFrame, rank: str = "idx") -> DataFrame:
    """genes with place: 0, 1, ... within their chromosome, in the order of ``rank``."""
    return genes.withColumn("place", (F.row_number().over(W.partitionBy("chrom").orderBy(rank)) - 1).cast("int"))


def triangular(x: np.ndarray, radius: int) -> np.ndarray:
    """Means of rows near each row, weights radius + 1 - distance, renormalised at the ends: two boxes one after the other."""

    def box(y: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, y.shape[1])), np.cumsum(y, 0)])
        ends = np.arange(len(y) + radius)
        return sums[np.minimum(ends + 1, len(y))] - sums[np.maximum(ends - radius, 0)]

    weights = np.ones((len(x), 1))
    top, all_ = (box(box(y))[radius : radius + len(x)] for y in (x, weights))
    return top / all_


@dataclass
class Part:
    """One chromosome's counts in a slab of draws: place and group of each as one number, how many, how often each draw takes them."""

    chrom: str
    first: int
    size: int
    groups: int
    key: np.ndarray
    n: np.ndarray
    mults: np.ndarray

    def draws(self) -> range:
        return range(self.first, self.first + len(self.mults))

    def counts(self, draw: int) -> np.ndarray:
        """Genes x groups in a draw (0: the data)."""
        return np.bincount(self.key, self.n * self.mults[draw - self.first], self.size * self.groups).reshape(self.size, self.groups)


@dataclass(frozen=True)
class Profiles:
    """Counts as parts, and what all chromosomes together say: by draw the groups' libraries, the middle one, the reference's library,
    the middle of all with it, and the groups' medians."""

    frame: DataFrame
    sizes: dict[str, int]
    names: list
    draws: int
    window: int
    limit: float = 3.0
    library: np.ndarray | None = None
    middle: np.ndarray | None = None
    cohort: np.ndarray | None = None
    level: np.ndarray | None = None
    medians: np.ndarray | None = None

    @classmethod
    def of(cls, rows: DataFrame, sizes: dict[str, int], names: list, draws: int, window: int) -> Profiles:
        """rows: chrom, place, group, n, and mults (numbers of draws 1, 2, ...; the data is draw 0) if there are more draws than one."""
        frame = rows.mapInArrow(_pack(names, draws), "chrom string, slab int, size int, blob binary")
        slabs = -(-draws // SLAB)
        whole = cls(cut(frame.repartition(max(1, slabs * len(sizes)), "chrom", "slab").sortWithinPartitions("chrom", "slab")), sizes, names, draws, window)
        return whole._with_libraries()._with_medians()

    def each(self, work: Callable[[Part], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """``work`` on every chromosome's slab, where it lies."""
        sizes, groups, draws = self.sizes, len(self.names), self.draws

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, own = [], None
            for batch in batches:
                for chrom, slab, size, blob in zip(*(batch.column(c).to_pylist() for c in ("chrom", "slab", "size", "blob")), strict=True):
                    if held and own != (chrom, slab):
                        yield from work(_part(own, held, sizes, groups, draws))
                        held = []
                    own = chrom, slab
                    held.append((size, blob))
            if held:
                yield from work(_part(own, held, sizes, groups, draws))

        return self.frame.mapInArrow(run, schema)

    def _with_libraries(self) -> Profiles:
        def libraries(part: Part) -> Iterator[pa.RecordBatch]:
            column = part.key % part.groups
            for draw in part.draws():
                own = np.bincount(column, part.n * part.mults[draw - part.first], part.groups)
                yield _row(draw=pa.array([draw], pa.int32()), chrom=pa.array([part.chrom]), x=pa.array([own], pa.list_(pa.float64())))

        schema = "draw int, chrom string, x array<double>"
        library = np.zeros((self.draws, len(self.names)))
        for r in sorted(self.each(libraries, schema).collect()):
            library[r.draw] += r.x
        if (library == 0).any():
            draw, column = np.argwhere(library == 0)[0]
            raise ValueError(f"group {self.names[column]} has no counts in {'the data' if not draw else f'draw {draw - 1}'}")
        middle = np.median(library, 1)

        def shares(part: Part) -> Iterator[pa.RecordBatch]:
            for draw in part.draws():
                total = np.median(part.counts(draw) / library[draw], 1).sum()
                yield _row(draw=pa.array([draw], pa.int32()), chrom=pa.array([part.chrom]), x=pa.array([[total]], pa.list_(pa.float64())))

        terms: list[list[float]] = [[] for _ in range(self.draws)]
        for r in self.each(shares, schema).collect():
            terms[r.draw].append(r.x[0])
        cohort = middle * [math.fsum(t) for t in terms]
        return replace(self, library=library, middle=middle, cohort=cohort, level=np.median(np.column_stack([library, cohort]), 1))

    def smoothed(self, part: Part, draw: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of genes with any count, and their smoothed log ratios (genes x groups) to the reference, whose own are 0."""
        return _smoothed(part, draw, self.library, self.middle, self.cohort, self.level, self.limit, self.window // 2)

    def _with_medians(self) -> Profiles:
        me = self.light()
        limit, groups = self.limit, len(self.names)
        bin_of = lambda v: np.minimum((v + limit) / (2 * limit) * BINS, BINS - 1).astype(np.int64)

        def counted(part: Part) -> Iterator[pa.RecordBatch]:
            for draw in part.draws():
                _, v = me.smoothed(part, draw)
                own = np.bincount((bin_of(v) + np.arange(groups) * BINS).ravel(), minlength=groups * BINS).astype("<i4")
                yield _row(draw=pa.array([draw], pa.int32()), blob=pa.array([pa.compress(own.tobytes(), "zstd", asbytes=True)], pa.binary()))

        def middles(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(pa.decompress(b, groups * BINS * 4, "zstd"), "<i4").reshape(groups, BINS).astype(np.int64) for b in table.column("blob").to_pylist())
            ends, n = np.cumsum(total, 1), total.sum(1)
            low, high = ((ends <= rank[:, None]).sum(1) for rank in ((n - 1) // 2, n // 2))
            before = (ends - total)[np.arange(groups), low]
            return pa.table({"draw": table.column("draw").slice(0, 1).combine_chunks().take(pa.array(np.zeros(groups, int))), "column": pa.array(np.arange(groups, dtype=np.int32)), "low": low, "high": high, "n": n, "before": before})

        found = self.each(counted, "draw int, blob binary").groupBy("draw").applyInArrow(middles, "draw int, column int, low long, high long, n long, before long")
        low, high, n, before = np.zeros((4, self.draws, groups), np.int64)
        for r in found.collect():
            at = r.draw, r.column
            low[at], high[at], n[at], before[at] = r.low, r.high, r.n, r.before

        def gathered(part: Part) -> Iterator[pa.RecordBatch]:
            for draw in part.draws():
                _, v = me.smoothed(part, draw)
                own = bin_of(v)
                inside = (own >= low[draw]) & (own <= high[draw])
                values = pa.array([v[inside[:, k], k] for k in range(groups)], pa.list_(pa.float64()))
                yield _row(draw=pa.array(np.full(groups, draw, np.int32)), column=pa.array(np.arange(groups, dtype=np.int32)), x=values)

        def exact(table: pa.Table) -> pa.Table:
            draw, column = table.column("draw")[0].as_py(), table.column("column")[0].as_py()
            values = np.sort(np.concatenate([np.asarray(c.flatten()) for c in table.column("x").chunks]))
            own, first = n[draw, column], before[draw, column]
            return pa.table({"draw": table.column("draw").slice(0, 1), "column": table.column("column").slice(0, 1), "m": [(values[(own - 1) // 2 - first] + values[own // 2 - first]) / 2]})

        medians = np.zeros((self.draws, groups))
        for r in self.each(gathered, "draw int, column int, x array<double>").groupBy("draw", "column").applyInArrow(exact, "draw int, column int, m double").collect():
            medians[r.draw, r.column] = r.m
        return replace(self, medians=medians)

    def light(self) -> Profiles:
        """Without the table, for tasks."""
        return replace(self, frame=None)


def _row(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _smoothed(part: Part, draw: int, library: np.ndarray, middle: np.ndarray, cohort: np.ndarray, level: np.ndarray, limit: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    x = part.counts(draw)
    known = np.flatnonzero(x.any(1))
    x = x[known]
    reference = np.median(x / library[draw], 1) * middle[draw]
    v = np.log2(1 + x * level[draw] / library[draw])
    if cohort[draw] > 0:
        v -= np.log2(1 + reference * level[draw] / cohort[draw])[:, None]
    np.clip(v, -limit, limit, out=v)
    return known, np.clip(triangular(v, radius), -limit, limit) if len(v) else v


def _pack(names: list, draws: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    number = {name: i for i, name in enumerate(names)}

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        chrom, group = (table.column(c).combine_chunks().dictionary_encode() for c in ("chrom", "group"))
        at = np.array([number[x] for x in group.dictionary.to_pylist()], "<i4")[group.indices.to_numpy()]
        place, n = table.column("place").to_numpy().astype("<i4"), table.column("n").to_numpy().astype("<f8")
        mults = np.ones((table.num_rows, draws), "<i2")
        if draws > 1:
            mults[:, 1:] = table.column("mults").combine_chunks().flatten().to_numpy().reshape(-1, draws - 1)
        code, rows = chrom.indices.to_numpy(), []
        for c, name in enumerate(chrom.dictionary.to_pylist()):
            own = np.flatnonzero(code == c)
            for slab in range(-(-draws // SLAB)):
                some = np.ascontiguousarray(mults[own, slab * SLAB : (slab + 1) * SLAB].T)
                raw = b"".join(x.tobytes() for x in (place[own], at[own], n[own], some))
                rows.append((name, slab, len(own), pa.compress(raw, "zstd", asbytes=True)))
        return _row(**{k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("chrom", pa.string()), ("slab", pa.int32()), ("size", pa.int32()), ("blob", pa.binary())))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS:
                yield pack(held)
                held, size = [], 0
        if size:
            yield pack(held)

    return run


def _part(own: tuple[str, int], held: list[tuple[int, bytes]], sizes: dict[str, int], groups: int, draws: int) -> Part:
    chrom, first = own[0], own[1] * SLAB
    width = min(SLAB, draws - first)
    keys, ns, mults = [], [], []
    for size, blob in held:
        raw = pa.decompress(blob, size * (16 + 2 * width), "zstd", asbytes=True)
        place, at = np.frombuffer(raw, "<i4", size), np.frombuffer(raw, "<i4", size, 4 * size)
        keys.append(place.astype(np.int64) * groups + at)
        ns.append(np.frombuffer(raw, "<f8", size, 8 * size))
        mults.append(np.frombuffer(raw, "<i2", size * width, 16 * size).reshape(width, size))
    return Part(chrom, first, sizes[chrom], groups, np.concatenate(keys), np.concatenate(ns), np.concatenate(mults, 1))

"""Whole-entity resampling: cells drawn with replacement inside their group, for expression profiles and haplotype windows.

Draws are made where the cells are, from hashes of draw, seed, group and slot; everything they weigh is a distributed
aggregation in which the draw is one more key.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from countaxis.operators import chromosomes

try:  # a third of the time that hashlib takes for short strings
    from _md5 import md5
except ImportError:
    from hashlib import md5

LEAST_DRAWS = 20
#: Cells of a group that are one row of places.
PLACES = 4096


def cell_multiples(cells: DataFrame, replicates: int, seed: int) -> DataFrame:
    """group, cell, mults: how often each draw takes each cell, an array of a number a draw. In each draw a group has as many slots as
    cells, and a slot takes the cell whose place in the group (by id) a hash of draw, seed, group and slot gives. Cells without a group
    have no row.

    A task counts one group's slots in some draws, so what is shuffled is a byte or two for each cell and draw, by blocks of places.
    """
    if replicates < LEAST_DRAWS:
        raise ValueError(f"at least {LEAST_DRAWS} draws are needed")
    cells = cells.select("group", "cell").filter("group is not null")
    kind = dict(cells.dtypes)["group"]
    place = F.row_number().over(W.partitionBy("group").orderBy("cell")) - 1
    own = cells.withColumn("place", place).withColumn("block", F.floor(F.col("place") / PLACES).cast("int"))
    sizes = cells.groupBy("group").agg(F.count("*").alias("n")).withColumn("name", F.col("group").cast("string"))
    tasks = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).repartition(replicates, "group", "draw")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, name, draw = (batch.column(c)[i].as_py() for c in ("n", "name", "draw"))
                head, taken = f"{draw}:{seed}:{name}:".encode(), np.zeros(n, np.int32)
                for low in range(0, n, 1 << 16):
                    slots = range(low, min(low + (1 << 16), n))
                    data = np.frombuffer(b"".join([md5(head + b"%d" % k).digest() for k in slots]), "u1").reshape(-1, 16)
                    chance = np.pad(data[:, :6], ((0, 0), (2, 0))).view(">u8")[:, 0].astype(float) / float(1 << 48)
                    taken += np.bincount((chance * n).astype(np.int64), minlength=n).astype(np.int32)
                blocks = [taken[low : low + PLACES] for low in range(0, n, PLACES)]
                rows = batch.slice(i, 1).column("group").take(pa.array(np.zeros(len(blocks), np.int64)))
                packed = [(x.astype("u1") if x.max() < 255 else x).tobytes() for x in blocks]
                yield pa.RecordBatch.from_arrays([rows, pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array(np.full(len(blocks), draw, np.int32)), pa.array([len(x) for x in blocks], pa.int32()), pa.array(packed, pa.binary())], ["group", "block", "draw", "size", "taken"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x = batch.column(1)[i].values, batch.column(2)[i].values
                table = np.zeros((len(ids), replicates), np.int16)
                for row in x.to_pylist():
                    table[:, row["draw"]] = np.frombuffer(row["taken"], "u1" if len(row["taken"]) == row["size"] else "<i4")
                mults = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * replicates), pa.array(table.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(ids), i))), ids, mults], ["group", "cell", "mults"])

    counted = tasks.mapInArrow(count, f"group {kind}, block int, draw int, size int, taken binary")
    counted = counted.groupBy("group", "block").agg(F.collect_list(F.struct("draw", "size", "taken")).alias("x"))
    ids = own.groupBy("group", "block").agg(F.array_sort(F.collect_list(F.struct("place", "cell"))).alias("y")).select("group", "block", F.col("y.cell").alias("ids"))
    met = ids.join(counted, ["group", "block"]).select("group", "ids", "x")
    return met.mapInArrow(across, f"group {kind}, cell {dict(cells.dtypes)['cell']}, mults array<smallint>")


def cell_draws(cells: DataFrame, replicates: int, seed: int) -> DataFrame:
    """draw (-1: the data, each cell once; 0 ... replicates - 1), group, cell, mult: cell_multiples() with a row for each cell that a draw
    takes."""
    drawn = cell_multiples(cells, replicates, seed).select("group", "cell", F.posexplode("mults").alias("draw", "mult")).filter("mult > 0")
    drawn = drawn.select("draw", "group", "cell", F.col("mult").cast("long").alias("mult"))
    return cells.select(F.lit(-1).alias("draw"), "group", "cell", F.lit(1).cast("long").alias("mult")).unionByName(drawn)


def bootstrap_profiles(counts: DataFrame, cells: DataFrame, genes: DataFrame, replicates: int = 64, seed: int = 270929, window: int = 101, block: int = 25, wide: bool = False) -> DataFrame:
    """draw, group, chrom, block, y: block means of each draw's smoothed profiles, whose cohort reference is that draw's own; only
    blocks known in the data and in all draws. genes: gene, chrom, idx. Cells without a group count nowhere.
    wide: chrom, block, y instead, a row for each block (`grouping.Features`), the groups in order.

    Counts carry their cell's numbers of all draws (`chromosomes`), so what is shuffled grows with the counts and the result alone."""
    own = chromosomes.placed(genes.select("gene", "chrom", "idx"))
    sizes = {r.chrom: r["count"] for r in own.groupBy("chrom").count().collect()}
    names = [r.group for r in cells.select("group").filter("group is not null").distinct().orderBy("group").collect()]
    rows = counts.select("gene", "cell", F.col("n").cast("double").alias("n")).join(own.select("gene", "chrom", "place"), "gene").join(cell_multiples(cells, replicates, seed), "cell")
    profiles = chromosomes.Profiles.of(rows.select("chrom", "place", "group", "n", "mults"), sizes, names, replicates + 1, window)
    me, values = profiles.light(), pa.array(names, to_arrow_type(cells.schema["group"].dataType))

    def drawn(part: chromosomes.Part) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for draw in part.draws():
            known, v = me.smoothed(part, draw)
            blocks, first = np.unique(known // block, return_index=True)
            if len(blocks):
                genes_in = np.minimum(block, part.size - blocks * block)
                yield draw, blocks, (np.add.reduceat(v - me.medians[draw], first) / np.diff(first, append=len(known))[:, None]) * np.sqrt(genes_in)[:, None]

    def means(part: chromosomes.Part) -> Iterator[pa.RecordBatch]:
        for draw, blocks, y in drawn(part):
            n = len(values)
            for low in range(0, len(blocks), max(1, 100_000 // n)):
                some = blocks[low : low + max(1, 100_000 // n)]
                size = len(some) * n
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, draw - 1, np.int32)), values.take(pa.array(np.tile(np.arange(n), len(some)))), pa.array([part.chrom]).take(pa.array(np.zeros(size, int))), pa.array(np.repeat(some, n).astype(np.int32)), pa.array(y[low : low + len(some)].ravel())], ["draw", "group", "chrom", "block", "y"])

    def slabs(part: chromosomes.Part) -> Iterator[pa.RecordBatch]:
        """Blocks known in all draws of the part, with these draws' values of all groups."""
        found = list(drawn(part))
        if len(found) < len(part.draws()):
            return
        common = functools.reduce(np.intersect1d, [blocks for _, blocks, _ in found])
        cube = np.stack([y[np.searchsorted(blocks, common)] for _, blocks, y in found], 1)
        for low in range(0, len(common), 1024):
            some = common[low : low + 1024].astype(np.int32)
            columns = pa.array([part.chrom] * len(some), pa.string()), pa.array(some), pa.array(np.full(len(some), part.first, np.int32)), pa.array([y.tobytes() for y in cube[low : low + 1024]], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns), ["chrom", "block", "first", "y"])

    if wide:
        rows = profiles.each(slabs, "chrom string, block int, first int, y binary").groupBy("chrom", "block").agg(F.array_sort(F.collect_list(F.struct("first", "y"))).alias("y"))
        return rows.filter(F.size("y") == -(-(replicates + 1) // chromosomes.SLAB)).select("chrom", "block", F.col("y.y").alias("y"))

    def known(part: chromosomes.Part) -> Iterator[pa.RecordBatch]:
        inside = [np.unique(np.flatnonzero(part.counts(draw).any(1)) // block) for draw in part.draws()]
        blocks, draws = np.unique(np.concatenate(inside), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([part.chrom] * len(blocks), pa.string()), pa.array(blocks.astype(np.int32)), pa.array(draws.astype(np.int64))], ["chrom", "block", "draws"])

    whole = profiles.each(known, "chrom string, block int, draws long").groupBy("chrom", "block").agg(F.sum("draws").alias("draws")).filter(F.col("draws") == replicates + 1)
    out = profiles.each(means, f"draw int, group {dict(cells.dtypes)['group']}, chrom string, block int, y double")
    return out.join(F.broadcast(whole.select("chrom", "block")), ["chrom", "block"], "left_semi").select("draw", "group", "chrom", "block", "y")


def feature_arrays(blocks: DataFrame, groups: list) -> tuple[np.ndarray, np.ndarray, list]:
    """x (features x groups) and boot (draws x features x groups) out of bootstrap_profiles(), features in axis order."""
    rows = blocks.toPandas()
    features = sorted(set(zip(rows["chrom"], rows["block"], strict=True)))
    place, column = {f: i for i, f in enumerate(features)}, {g: i for i, g in enumerate(groups)}
    draws = sorted(rows["draw"].unique())
    cube = np.full((len(draws), len(features), len(groups)), np.nan)
    cube[np.searchsorted(draws, rows["draw"]), [place[f] for f in zip(rows["chrom"], rows["block"], strict=True)], rows["group"].map(column)] = rows["y"]
    return cube[0], cube[1:], features


def stream(*key) -> np.random.Generator:
    """A stream of random numbers for a key, the same wherever and in whatever order keys are taken: a counter-based generator whose key
    is the digest of ``key``."""
    digest = hashlib.blake2b(":".join(map(str, key)).encode(), digest_size=16).digest()
    return np.random.Generator(np.random.Philox(key=np.frombuffer(digest, np.uint64)))


def weighed_bins(bins_by_cell: DataFrame, cells: DataFrame, replicates: int, seed: int) -> DataFrame:
    """draw (-1: the data), group, chrom, bin, a, b: counts of bins summed over the cells of each draw, as often as it takes them. A cell's row
    carries its numbers of all draws, so the rows that are shuffled are those of the counts."""
    kind = dict(cells.dtypes)["group"]
    rows = bins_by_cell.select("cell", "chrom", "bin", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")).join(cell_multiples(cells, replicates, seed), "cell")

    def run(table: pa.Table) -> pa.Table:
        group = table.column("group").combine_chunks().dictionary_encode()
        at, size = group.indices.to_numpy(), len(group.dictionary)
        sums = np.zeros((2, replicates + 1, size))
        for low in range(0, len(at), 4096):
            part = table.slice(low, 4096).combine_chunks()
            mults = part.column("mults").combine_chunks().flatten().to_numpy().reshape(-1, replicates)
            whole = np.column_stack([np.ones(len(mults)), mults])
            own = (at[low : low + 4096][:, None] == np.arange(size)).astype(float)
            for k, name in enumerate("ab"):
                sums[k] += (whole * part.column(name).to_numpy()[:, None]).T @ own
        n = size * (replicates + 1)
        one = lambda name: table.column(name).slice(0, 1).combine_chunks().take(pa.array(np.zeros(n, np.int64)))
        return pa.table({"draw": pa.array(np.repeat(np.arange(-1, replicates, dtype=np.int32), size)), "chrom": one("chrom"), "group": group.dictionary.take(pa.array(np.tile(np.arange(size), replicates + 1))), "bin": one("bin"), "a": sums[0].ravel(), "b": sums[1].ravel()})

    return rows.groupBy("chrom", "bin").applyInArrow(run, f"draw int, chrom string, group {kind}, bin long, a double, b double")


def haplotype_profiles(bins: DataFrame, bins_by_cell: DataFrame, cells: DataFrame, replicates: int = 64, seed: int = 42, resampling_seed: int | None = None, radius: int = 2) -> DataFrame:
    """draw (-1: the data), group, chrom, bin, x, coverage of the haplotype windows, for every group and every bin of any group.

    In a draw cells are redrawn, each base bin's share is a beta draw from the redrawn counts, and a window's mean is weighted by counts
    plus one; x is centred on the median over groups. Windows reach ``radius`` bins to each side by number: gaps aren't bridged.
    bins_by_cell: cell, chrom, bin, a, b. Cells are drawn as by cell_draws() with ``resampling_seed``, so that they can match the
    profiles', or else with ``seed``; beta draws come from a stream of each draw and chromosome. A draw's chromosome (groups x bins) is
    one group of a task; the driver has the names of groups and bins alone.
    """
    spark, kind = cells.sparkSession, dict(cells.dtypes)["group"]
    groups = [r["group"] for r in cells.select("group").distinct().orderBy("group").collect()]
    places: dict[str, list[int]] = {}
    for r in bins.select("chrom", "bin").distinct().orderBy("chrom", "bin").collect():
        places.setdefault(r.chrom, []).append(r.bin)
    weighed = weighed_bins(bins_by_cell, cells, replicates, seed if resampling_seed is None else resampling_seed)
    # Chromosomes of draws in which no cell has counts have windows, too.
    each = spark.createDataFrame([(d, c) for d in range(-1, replicates) for c in places], "draw int, chrom string")
    weighed = weighed.join(each.select("chrom").distinct(), "chrom", "left_semi").unionByName(each, allowMissingColumns=True)
    column = {g: i for i, g in enumerate(groups)}
    names = pa.array(groups, to_arrow_type(cells.schema["group"].dataType))

    def run(table: pa.Table) -> pa.Table:
        draw, chrom = table.column("draw")[0].as_py(), table.column("chrom")[0].as_py()
        own = np.array(places[chrom])
        table = table.filter(pc.and_(pc.is_valid(table.column("bin")), pc.is_in(table.column("bin"), pa.array(own))))
        a, b = np.zeros((2, len(groups), len(own)))
        at = np.array([column[g] for g in table.column("group").to_pylist()], int), np.searchsorted(own, table.column("bin").to_numpy())
        a[at], b[at] = table.column("a").to_numpy(), table.column("b").to_numpy()
        near = [(to := np.minimum(np.searchsorted(own, own + k), len(own) - 1), own[to] == own + k) for k in range(-radius, radius + 1)]
        window = lambda y: sum(y[:, to] * there for to, there in near)  # noqa: E731  sums over bins of near numbers
        depth = a + b + 1
        share = (a + 0.5) / depth if draw < 0 else stream(seed, draw, chrom).beta(a + 0.5, b + 0.5)
        x = 2 * window(share * depth) / window(depth) - 1
        x -= np.median(x, 0)
        size = len(groups) * len(own)
        return pa.table({"draw": pa.array(np.full(size, draw, np.int32)), "group": names.take(pa.array(np.repeat(np.arange(len(groups)), len(own)))), "chrom": pa.array([chrom] * size), "bin": pa.array(np.tile(own, len(groups))), "x": x.ravel(), "coverage": window(a + b).ravel()})

    return weighed.groupBy("draw", "chrom").applyInArrow(run, f"draw int, group {kind}, chrom string, bin long, x double, coverage double")


def haplotype_features(bins: DataFrame, bins_by_cell: DataFrame, cells: DataFrame, replicates: int = 64, seed: int = 42, resampling_seed: int | None = None, radius: int = 2) -> dict:
    """haplotype_profiles() as arrays for the groups' refinement: x and coverage (regions x groups), boot (draws x regions x groups), and the
    names of regions and groups, all in order."""
    rows = haplotype_profiles(bins, bins_by_cell, cells, replicates, seed, resampling_seed, radius).toPandas().sort_values(["draw", "chrom", "bin", "group"])
    groups = sorted(rows["group"].unique())
    first = rows[(rows["draw"] == -1) & (rows["group"] == groups[0])]
    regions = list(zip(first["chrom"], first["bin"], strict=True))
    x, coverage = (rows[c].to_numpy().reshape(replicates + 1, len(regions), len(groups)) for c in ("x", "coverage"))
    return {"x": x[0], "boot": x[1:], "coverage": coverage[0], "regions": regions, "groups": groups}


def profiles(values: DataFrame, genes: DataFrame, window: int = 101) -> DataFrame:
    """expression_profiles() against the cohort's own median. A chromosome's genes and samples are one part (`chromosomes`), with an array
    of all samples for each gene."""
    own = values.select(F.col("sample").cast("string").alias("sample"), "gene", F.col("n").cast("double").alias("n"))
    sites = chromosomes.placed(genes.select("gene", "chrom", "idx")).select("gene", "chrom", "place")
    sizes = {r.chrom: r["count"] for r in sites.groupBy("chrom").count().collect()}
    names = [r.sample for r in own.select("sample").distinct().orderBy("sample").collect()]
    rows = own.filter("n <> 0").join(sites, "gene").select("chrom", "place", F.col("sample").alias("group"), "n")
    found = chromosomes.Profiles.of(rows, sizes, names, 1, window)
    me = found.light()

    def arrays(part: chromosomes.Part) -> Iterator[pa.RecordBatch]:
        known, v = me.smoothed(part, 0)
        v -= me.medians[0]
        for low in range(0, len(known), 10_000):
            x = pa.FixedSizeListArray.from_arrays(pa.array(v[low : low + 10_000].ravel()), v.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([part.chrom] * len(x), pa.string()), pa.array(known[low : low + 10_000].astype(np.int32)), x], ["chrom", "place", "x"])

    wide = sites.join(found.each(arrays, "chrom string, place int, x array<double>"), ["chrom", "place"], "left").select("gene", "x")
    number = F.create_map(*(F.lit(x) for pair in enumerate(names) for x in reversed(pair)))
    return own.select("sample", "gene").join(wide, "gene", "left").select("sample", "gene", F.get("x", number[F.col("sample")]).alias("x"))

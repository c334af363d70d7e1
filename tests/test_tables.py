"""DataFrame operators against NumPy or hand-made sums."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from countaxis import schema
from countaxis.operators import aggregate, axis, permutations, regions, smoothing


@pytest.fixture(scope="module")
def small(spark):
    counts = spark.createDataFrame([("g1", "c1", 3), ("g1", "c2", 1), ("g2", "c2", 4), ("g1", "c3", 7)], "gene string, cell string, n long")
    cells = spark.createDataFrame([("c1", 1, 10.0), ("c2", 1, 20.0), ("c3", 0, 30.0), ("c4", 2, 5.0)], "cell string, group int, library double")
    genes = spark.createDataFrame([("g1", 0.5), ("g2", 0.25), ("g3", 0.1)], "gene string, fraction double")
    return counts, cells, genes


def test_pseudobulk_keeps_zeros_and_leaves_out_the_unresolved(small):
    got = {(r.group, r.gene): (r.n, r.exposure, r.expected) for r in aggregate.pseudobulk(*small, exclude_unresolved=True).collect()}
    assert got == {(1, "g1"): (4, 30.0, 15.0), (1, "g2"): (4, 30.0, 7.5), (1, "g3"): (0, 30.0, 3.0), (2, "g1"): (0, 5.0, 2.5), (2, "g2"): (0, 5.0, 1.25), (2, "g3"): (0, 5.0, 0.5)}
    assert {r.group for r in aggregate.pseudobulk(*small).collect()} == {0, 1, 2}


def test_alleles_stay_sparse_and_libraries_cover_all(spark, small):
    alleles = spark.createDataFrame([(0, "c1", 2, 1), (0, "c2", 1, 0), (1, "c4", 0, 0)], "locus int, cell string, h1 long, h2 long")
    assert [tuple(r) for r in aggregate.pooled_alleles(alleles, small[1]).collect()] == [(1, 0, 3, 1)]
    assert {r.cell: r.library for r in aggregate.library_totals(small[0]).collect()} == {"c1": 3, "c2": 5, "c3": 7}
    assert aggregate.summed(spark.createDataFrame([("a", 1), ("a", 2), ("b", 0)], "gene string, n long"), "gene").collect() == [("a", 3)]


def test_dispersion_and_bias(spark):
    r = np.random.default_rng(1)
    n, e = r.poisson(30, 200), r.uniform(10, 50, 200)
    row = aggregate.dispersion(spark.createDataFrame(pd.DataFrame({"n": n, "expected": e}))).head()
    ratio = np.log(n / e)
    sigma = max(0.05, 1.4826 * np.median(abs(ratio - np.median(ratio))))
    assert row.sigma == pytest.approx(sigma) and row.alpha == pytest.approx(np.expm1(sigma**2))
    assert aggregate.dispersion(spark.createDataFrame([(0, 1.0)], "n long, expected double")).head().sigma == 0.5
    bias = lambda h: aggregate.allele_bias(spark.createDataFrame(h, "h1 long, h2 long")).head().bias
    assert bias([(90, 10)]) == pytest.approx(np.log(0.55 / 0.45)) and bias([]) == 0


def test_consensus_and_conflict_by_hand(spark):
    p = spark.createDataFrame([("a", 0, [0.97, 0.01, 0.01, 0.01]), ("b", 0, [0.01, 0.97, 0.01, 0.01]), ("c", 0, [0.4, 0.3, 0.2, 0.1])], "member string, marker int, p array<double>")
    cells = spark.createDataFrame([("a", 1, 6), ("b", 1, 2), ("c", 1, 2), ("d", 0, 9)], "member string, group int, cells int")
    pooled = spark.createDataFrame([(1, 0, [0.0, 1.0, 0.0, 0.0])], "group int, marker int, p array<double>")
    r = aggregate.consensus(p, cells, pooled).head()
    assert r.label == 0 and r.consensus[0] == pytest.approx((0.97 * 6 + 0.01 * 2 + 0.4 * 2) / 10) and r.uncertain == pytest.approx(0.2)
    assert r.conflict == pytest.approx(0.2) and r.pooled_conflict == pytest.approx(0.6)


def test_refinement_drops_singletons_and_zero(spark):
    frame = lambda x: spark.createDataFrame(list(enumerate(x)), "member int, label int")
    got = dict(aggregate.common_refinement(frame([1, 1, 1, 2, 2, 0, 2]), frame([1, 1, 2, 1, 1, 1, 0])).collect())
    assert got == {0: 1, 1: 1, 2: 0, 3: 2, 4: 2, 5: 0, 6: 0}


def smooth_by_hand(x, chrom, radius):
    out = np.empty(len(x))
    for i in range(len(x)):
        js = [j for j in range(len(x)) if chrom[j] == chrom[i] and abs(i - j) <= radius]
        w = np.array([radius + 1 - abs(i - j) for j in js])
        out[i] = w @ x[js] / w.sum()
    return out


@pytest.mark.parametrize("window", [1, 3, 7, 101])
@pytest.mark.parametrize("mode", ["external", "self", "none"])
def test_profiles_against_numpy(spark, window, mode):
    r = np.random.default_rng(3)
    counts = r.poisson(20, (12, 4)).astype(float)
    counts[11], counts[2, 1] = 0, 5000
    chrom = np.array([0] + [1] * 3 + [2] * 7 + [3])
    reference = {"external": r.uniform(1, 30, 12) * (np.arange(12) < 11), "none": None}.get(mode)
    frame = spark.createDataFrame(pd.DataFrame([(f"s{s}", f"g{g:02d}", float(counts[g, s])) for g in range(12) for s in range(4)], columns=["sample", "gene", "n"]))
    genes = spark.createDataFrame([(f"g{g:02d}", str(chrom[g]), g) for g in range(12)], "gene string, chrom string, idx int")
    given = None
    if mode == "self":
        given = smoothing.cohort_reference(frame)
        shares = np.median(counts / counts.sum(0), axis=1)
        reference = shares * np.median(counts.sum(0))
    elif mode == "external":
        given = spark.createDataFrame([(f"g{g:02d}", float(reference[g])) for g in range(12)], "gene string, reference double")
    all_ = counts if reference is None else np.column_stack([counts, reference])
    keep = (all_ > 0).any(1)
    x = all_[keep]
    lib = x.sum(0)
    v = np.log2(1 + x * np.median(lib) / lib)
    ref = slice(None) if reference is None else slice(4, None)
    v = np.clip(v - v[:, ref].mean(1, keepdims=True), -3, 3)
    v = np.column_stack([smooth_by_hand(c, chrom[keep], window // 2) for c in v.T])
    v = v - np.median(v, axis=0)
    v = (v - v[:, ref].mean(1, keepdims=True))[:, :4]
    got = smoothing.expression_profiles(frame, genes, given, window).toPandas().pivot(index="gene", columns="sample", values="x").to_numpy()
    assert np.isnan(got[11]).all() and np.allclose(got[:11], v, rtol=1e-11, atol=1e-11)


def test_blocks_count_unknown_genes_in_their_size(spark):
    rows = spark.createDataFrame([("g0", 1.0), ("g1", None), ("g2", float("nan")), ("g3", None)], "gene string, x double")
    genes = spark.createDataFrame([(f"g{i}", "1", i) for i in range(4)], "gene string, chrom string, idx int")
    assert [tuple(r) for r in smoothing.block_means(rows, genes, [], 2).collect()] == [("1", 0, pytest.approx(np.sqrt(2)))]


def test_signal_scores_by_hand_and_limits(spark):
    region = spark.createDataFrame([("1", 0, "a", 8.0, 3.0, 1.0), ("1", 0, "b", 2.0, 0.0, 0.0), ("1", 1, "b", 5.0, 1.0, 1.0)], "chrom string, bin long, cell string, depth double, h1 double, h2 double")
    cells = spark.createDataFrame([("a", "x", 10.0), ("b", "y", 30.0)], "cell string, group string, library double")
    rates = regions.region_rates(region, cells)
    s = regions.chi_square(region, rates, cells.withColumn("perm", F.lit(0))).head()
    e = np.outer([10, 30], [10 / 40, 5 / 40])
    d = np.array([[8, 0], [2, 5]])
    assert s.depth == pytest.approx(((d - e) ** 2 / e).sum()) and s.allele == pytest.approx((3 - 4 * 0.75) ** 2) and s.joint == pytest.approx(s.depth + s.allele)
    assert regions.signal_test(region, cells.withColumn("group", F.lit("x")), 5)[0].head().p_value is None
    same = region.filter("cell = 'a'").select("chrom", "bin", "depth", "h1", "h2").crossJoin(spark.createDataFrame([("a",), ("b",)], "cell string"))
    assert regions.signal_test(same, cells.withColumn("library", F.lit(10.0)), 19)[0].head().p_value == 1.0


def test_haplotype_windows_keep_gaps(spark):
    bins = spark.createDataFrame([(g, "1", b, float(3 + g), 1.0) for g in (0, 1) for b in (0, 1, 5)], "group int, chrom string, bin long, a double, b double")
    got = {(r.group, r.bin): r for r in regions.haplotype_windows(bins).collect()}
    raw = lambda g, n: 2 * (n * (3 + g + 0.5)) / (n * (3 + g + 2)) - 1
    assert got[1, 0].x == pytest.approx((raw(1, 2) - raw(0, 2)) / 2) and got[0, 5].coverage == 4 and got[0, 0].coverage == 8


def test_interpolation_clamps_and_asks_for_a_map(spark):
    steps = spark.createDataFrame([("1", 100, 1.0), ("1", 200, 3.0), ("2", 50, 7.0)], "chrom string, bp long, cm double")
    sites = spark.createDataFrame([("1", 50), ("1", 100), ("1", 150), ("1", 999), ("2", 1)], "chrom string, position long")
    assert {(r.chrom, r.position): r.cm for r in axis.interpolated(sites, steps).collect()} == {("1", 50): 1.0, ("1", 100): 1.0, ("1", 150): 2.0, ("1", 999): 3.0, ("2", 1): 7.0}
    with pytest.raises(ValueError, match="map"):
        axis.interpolated(sites.withColumn("chrom", F.lit("9")), steps)


def test_orders_segments_and_layout(spark):
    genes = spark.createDataFrame([("a", "chr10", 5), ("b", "chr2", 9), ("c", "chrX", 1), ("d", "chr2", 9)], "gene string, chrom string, position long")
    assert [r.gene for r in axis.gene_order(genes).orderBy("idx").collect()] == ["b", "d", "a", "c"] and [r.gene for r in axis.lexical_order(genes).orderBy("idx").collect()] == ["a", "b", "d", "c"]
    rows = spark.createDataFrame([(1, i, s, c) for i, (s, c) in enumerate([("x", 1), ("x", 1), ("x", 2), ("y", 2), ("x", 2)])], "member int, marker int, state string, chrom int")
    assert [r.segment for r in axis.segments(rows, ["member"], ["marker"], "state", ["chrom"]).orderBy("marker").collect()] == [0, 0, 1, 2, 3]
    lengths = spark.createDataFrame([("chr10", 7), ("chr2", 5)], "chrom string, length long")
    places = axis.layout(lengths)
    assert {r.chrom: r.offset for r in places.collect()} == {"chr2": 0, "chr10": 5}
    points = spark.createDataFrame([("chr10", 2, 1.0), ("chr10", 2, 3.0), ("chr10", 6, float("nan"))], "chrom string, position long, value double")
    got = axis.plot_intervals(points, places).orderBy("position").collect()
    assert [(r.left, r.right, r.value) for r in got] == [(5.0, 9.0, 2.0), (9.0, 12.0, None)]
    gaps = axis.disjoint(spark.createDataFrame([("1", 0, 2, 1.0), ("1", 5, 6, 2.0)], "chrom string, start long, end long, value double")).orderBy("start").collect()
    assert [(r.start, r.end) for r in gaps] == [(0, 2), (2, 5), (5, 6)]
    with pytest.raises(ValueError, match="overlap"):
        axis.disjoint(spark.createDataFrame([("1", 0, 4, 1.0), ("1", 2, 6, 2.0)], "chrom string, start long, end long, value double"))
    table = spark.createDataFrame([("gain", 4.0), ("gain", 6.0), ("diploid", 0.0)], "state string, log_bf double")
    assert [r.state for r in axis.filtered_segments(table).collect()] == ["diploid", "gain", "diploid"]


BROKEN = {
    "check_cells": [("cell string, barcode string, library double", [("a", "x", 1.0), ("a", "y", 1.0)]), ("cell string, barcode string, library double", [("", "x", 1.0)]), ("cell string, barcode string, library double", [("a", "", 1.0)]), ("cell string, barcode string, library double", [("a", "x", 0.0)])],
    "check_genes": [("gene string, fraction double", [("g", 0.1), ("g", 0.1)]), ("gene string, fraction double", [("g", 0.7), ("h", 0.7)]), ("gene string, fraction double", [("g", -0.1)])],
    "check_grid": [("marker int, chrom string, start long, end long", [(0, "1", 0, 1)]), ("marker int, chrom string, start long, end long", [(0, "1", 5, 4)]), ("marker int, chrom string, start long, end long", [(0, "1", 1, 5), (1, "1", 5, 6)]), ("marker int, chrom string, start long, end long", [(0, "1", 1, 1), (1, "2", 1, 1), (2, "1", 9, 9)])],
    "check_panel": [("gene string, profile string, fraction double", [("g", "p", 0.6), ("h", "p", 0.3)])],
}


@pytest.mark.parametrize("name,case", [(n, c) for n, cases in BROKEN.items() for c in cases])
def test_checks_refuse(spark, name, case):
    with pytest.raises(ValueError):
        getattr(schema, name)(spark.createDataFrame(case[1], case[0]))


def test_checks_of_counts_and_loci(spark):
    for n in (-1.0, 0.5, float("nan"), float("inf"), None):
        with pytest.raises(ValueError):
            schema.check_counts(spark.createDataFrame([(n,)], "n double"), "n")
    grid = spark.createDataFrame([(0, "1", 5, 5), (1, "1", 9, 9)], "marker int, chrom string, start long, end long")
    loci = lambda *rows: spark.createDataFrame(rows, "locus int, marker int, position long, population_phase double, genetic_cm double, het double")
    schema.check_loci(loci((0, 0, 5, 0.9, 0.0, 1.0), (1, 1, 9, 0.9, 0.1, 1.0)), grid)
    for bad in ([(0, 0, 6, 0.9, 0.0, 1.0)], [(0, 0, 5, 1.9, 0.0, 1.0)], [(0, 0, 5, 0.9, 0.2, 1.0), (1, 1, 9, 0.9, 0.1, 1.0)], [(0, 0, 5, 0.9, 0.0, 2.0)]):
        with pytest.raises(ValueError):
            schema.check_loci(loci(*bad), grid)
    with pytest.raises(ValueError):
        schema.check_library(spark.createDataFrame([("a", 5)], "cell string, n long"), spark.createDataFrame([("a", 4.0)], "cell string, library double"))


def test_catalogues(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    assert axis.same_catalogue(a, a.select("v", "k").orderBy("v")) and not axis.same_catalogue(a, a.distinct()) and not axis.same_catalogue(a, a.drop("v"))


@pytest.mark.parametrize("values", [[], [1.0], [2.0, 1.0], [3.0, 1.0, 2.0], [5.0] * 40 + [1.0, 9.0], [float("nan"), None, 4.0, -4.0, 1e308, -1e308], "many", "ties", "tails"])
def test_exact_median(spark, monkeypatch, values):
    monkeypatch.setattr(aggregate, "SORTED", 20)
    monkeypatch.setattr(aggregate, "BUCKETS", 8)
    r = np.random.default_rng(3)
    made = {"many": lambda: r.normal(size=5001), "ties": lambda: r.integers(0, 4, 2000).astype(float), "tails": lambda: np.exp(r.normal(size=4000) * 20)}
    values = made[values]().tolist() if isinstance(values, str) else values
    got = aggregate.exact_median(spark.createDataFrame([(v,) for v in values], "v double"), "v")
    fine = [v for v in values if v is not None and not np.isnan(v)]
    assert got == (np.median(fine) if fine else None)


def test_dispersions_agree(spark, monkeypatch):
    monkeypatch.setattr(aggregate, "SORTED", 20)
    r = np.random.default_rng(5)
    rows = spark.createDataFrame([(int(n), float(e)) for n, e in zip(r.poisson(5, 900), r.random(900) * 10, strict=True)], "n long, expected double")
    for some in (rows, rows.limit(1), rows.limit(0)):
        assert [round(x, 12) for x in aggregate.dispersion_of_many(some).head()] == [round(x, 12) for x in aggregate.dispersion(some).head()]


def test_permuted_scores_are_those_of_permuted_labels(spark, monkeypatch):
    """Cubes in slabs against a row for each cell and permutation."""
    r = np.random.default_rng(8)
    cells = spark.createDataFrame([(i, "xyyz"[i % 4] + "pq"[i % 7 == 0], float(r.integers(1, 50))) for i in range(700)], "cell long, group string, library double")
    rows = [("12"[b % 2], b // 2, i, float(r.poisson(3)), float(r.poisson(1)), float(r.poisson(2))) for i in range(0, 720, 3) for b in range(5) if r.random() < 0.6]
    region = spark.createDataFrame(rows, "chrom string, bin long, cell long, depth double, h1 double, h2 double")
    rates = regions.region_rates(region, cells)
    want = {x.perm: x for x in regions.chi_square(region, rates, regions.permuted_labels(cells, 9, 5)).collect()}
    for cube in (permutations.CUBE_BYTES, 1000):
        monkeypatch.setattr(permutations, "CUBE_BYTES", cube)
        got = {x.perm: x for x in permutations.permuted_scores(region, rates, cells, 9, 5).collect()}
        assert got.keys() == want.keys() and len(got) == 10
        assert all(got[p][k] == pytest.approx(want[p][k], rel=1e-10) for p in want for k in ("joint", "depth", "allele"))
    assert permutations.permuted_scores(region, rates, cells.filter("group = 'xq'"), 2, 5).count() == 3
    assert permutations.permuted_scores(region, rates, cells.limit(0), 2, 5).count() == 0


def test_region_sums_are_the_sums_of_cells_without_their_rows(spark):
    """Repeated rows, cells without a group and cells that no table has count as in region_counts(), but no aggregation is by cell."""
    r = np.random.default_rng(4)
    counts = spark.createDataFrame([(int(r.integers(30)), int(r.integers(40)), int(r.integers(1, 9))) for _ in range(400)], "gene int, cell int, n long")
    alleles = spark.createDataFrame([(int(r.integers(9)), int(r.integers(40)), int(r.integers(5)), int(r.integers(5))) for _ in range(200)], "locus int, cell int, h1 long, h2 long")
    genes = spark.createDataFrame([(g, str(g % 2), 100 * g + 1) for g in range(28)], "gene int, chrom string, position long")
    loci = spark.createDataFrame([(k, str(k % 3), 300 * k + 1, 0.9 if k % 2 else 0.2) for k in range(9)], "locus int, chrom string, position long, population_phase double")
    cells = spark.createDataFrame([(i, i % 3 or None, 5.0) for i in range(36)], "cell int, group int, library double")
    whole = regions.region_counts(counts, alleles, genes, loci, 500)
    total = lambda rows, *keys: sorted((tuple(x) for x in rows.groupBy(*keys, "chrom", "bin").agg(F.sum("depth"), F.sum("h1"), F.sum("h2")).collect()), key=repr)
    assert total(regions.region_sums(counts, alleles, genes, loci, 500)) == total(whole)
    sums = regions.region_sums(counts, alleles, genes, loci, 500, cells)
    assert total(sums, "group") == total(whole.join(cells, "cell", "left"), "group") and sums.count() == sums.select("group", "chrom", "bin").distinct().count()
    for frame in (sums, regions.region_rates(sums, cells)):
        aggregates = [x for x in frame._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in x]
        assert aggregates and not any("cell#" in x for x in aggregates)


def test_labels_at_the_borders():
    data = permutations.digests(1, 42, [b"%d" % i for i in range(50)])
    keys = [data[16 * i : 16 * i + 16] for i in range(50)]
    order = sorted(keys)
    border = [order[10], order[10], order[37]]
    got = permutations.labelled(data, border, permutations.leading(b"".join(border)))
    assert got.tolist() == [0 if k < order[10] else 2 if k < order[37] else 3 for k in keys]


def test_permuted_scores_shuffle_no_cubes(spark, monkeypatch):
    """What is shuffled is the counts with their labels; a region that only cells without a label have still adds its expectation."""
    cells = spark.createDataFrame([(i, i % 3, 2.0) for i in range(60)], "cell long, group int, library double")
    region = spark.createDataFrame([("1", i % 5, i, 3.0, 1.0, 2.0) for i in range(60)] + [("2", 0, 99, 6.0, 1.0, 0.0)], "chrom string, bin long, cell long, depth double, h1 double, h2 double")
    rates = regions.region_rates(region, cells)
    monkeypatch.setattr(permutations, "CUBE_BYTES", 1)
    want = {x.perm: x for x in regions.chi_square(region, rates, regions.permuted_labels(cells, 5, 2)).collect()}
    got = permutations._scores(region.withColumn("cell", region.cell.cast("string")), rates, cells.withColumn("cell", cells.cell.cast("string")), 5, 2)
    assert [x[0] for x in got] == sorted(want) and all(x[1:] == pytest.approx(tuple(want[x[0]])[1:]) for x in got)


def test_permuted_scores_in_slabs_shuffle_blocks(spark, monkeypatch):
    """Counts and labels travel in compressed blocks, some permutations at a time; rows for a cell and region may be several."""
    cells = spark.createDataFrame([(i, i % 3, 2.0 + i % 2) for i in range(300)], "cell long, group int, library double")
    region = spark.createDataFrame([("1", i % 5, i, 3.0 + i % 4, 1.0, 2.0) for i in range(300) for _ in range(2)] + [("2", 0, 999, 6.0, 1.0, 0.0)], "chrom string, bin long, cell long, depth double, h1 double, h2 double")
    rates = regions.region_rates(region, cells)
    want = {x.perm: x for x in regions.chi_square(region, rates, regions.permuted_labels(cells, 8, 2)).collect()}
    seen, whole = [], permutations._slab
    monkeypatch.setattr(permutations, "_slab", lambda packed, rows, some, *a: seen.append((rows, list(some))) or whole(packed, rows, some, *a))
    monkeypatch.setattr(permutations, "SLAB_BYTES", 1)
    monkeypatch.setattr(permutations, "LEAST_SLAB", 4)
    monkeypatch.setattr(permutations, "PART_BYTES", 2000)
    got = {x.perm: x for x in permutations.permuted_scores(region, rates, cells, 8, 2).collect()}
    assert seen == [(600, [0, 1, 2, 3]), (600, [4, 5, 6, 7]), (600, [8])]
    assert got.keys() == want.keys() and all(got[p][k] == pytest.approx(want[p][k], rel=1e-10) for p in want for k in ("joint", "depth", "allele"))


def test_interpolation_takes_no_frame_to_the_end(spark):
    """Frames that grow backwards are taken anew for each row: work would grow with the square of a chromosome's sites."""
    steps = spark.createDataFrame([("1", 10, 1.0), ("1", 20, 3.0), ("1", 40, 4.0)], "chrom string, bp long, cm double")
    sites = spark.createDataFrame([("1", p) for p in (5, 10, 15, 20, 30, 40, 50)], "chrom string, position long")
    out = axis.interpolated(sites, steps)
    assert {x.position: x.cm for x in out.collect()} == {5: 1.0, 10: 1.0, 15: 2.0, 20: 3.0, 30: 3.5, 40: 4.0, 50: 4.0}
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()

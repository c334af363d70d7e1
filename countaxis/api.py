"""The verbs: prepare, signal, infer, fit_reference and run. Each takes tables or a bundle and returns tables."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countaxis.operators import aggregate, axis, clones, fitting, grouping, membership, mixture, paths, regions, resample, segments
from countaxis.operators.states import CLASSES, STATES, Model, Parameters
from countaxis.sources import bundle as bundles
from countaxis.sources import matrices, sinks, tables


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    bootstraps: int = 64
    draws: int = 256
    permutations: int = 199
    region_width: int = 10_000_000
    window: int = 101
    method: str = clones.DEFAULT
    cn_refinement: bool = True
    hf_refinement: bool = True
    threshold: float = 0.95
    least_evidence: float = 5.0
    model: Model = Model()
    options: fitting.Options = fitting.Options()

    def __post_init__(self):
        whole = {"seed": 0, "bootstraps": 20, "draws": 1, "permutations": 1, "region_width": 1, "window": 1}
        for name, least in whole.items():
            value = getattr(self, name)
            if not isinstance(value, int) or isinstance(value, bool) or value < least:
                raise ValueError(f"{name} must be a whole number from {least} on")
        if self.method not in clones.METHODS:
            raise ValueError(f"method must be one of {clones.METHODS}")


@dataclass
class Result:
    """Tables of an inference, and what its run was like."""

    groups: DataFrame
    membership: list[dict]
    nodes: dict[str, list[dict]]
    posterior: DataFrame
    group_cn: DataFrame
    group_segments: DataFrame
    signal: DataFrame
    null: DataFrame
    markers: DataFrame
    barcode_evidence: DataFrame
    group_evidence: DataFrame
    about: dict = field(default_factory=dict)

    def barcode_cn(self, barcodes: list[str] | None = None, threshold: float = 0.95) -> DataFrame:
        """barcode, marker, class probabilities, label and whether it is sure; unknown barcodes are an error."""
        rows = self.posterior
        if barcodes is not None:
            known = {r.member for r in rows.select("member").distinct().collect()}
            if unknown := sorted(set(barcodes) - known):
                raise ValueError(f"unknown barcodes: {unknown}")
            rows = rows.filter(F.col("member").isin(barcodes))
        label = F.array_position("classes", F.array_max("classes")) - 1
        names = F.array(*map(F.lit, CLASSES))
        return rows.select(F.col("member").alias("barcode"), "marker", *(F.col("classes")[k].alias(c) for k, c in enumerate(CLASSES)), names[label].alias("label"), (F.array_max("classes") >= threshold).alias("sure"))

    def save(self, folder: str) -> None:
        """A new folder of tables and run.json; if something fails, run.json says so."""
        root = Path(folder)
        root.mkdir(parents=True)
        try:
            for name in ("groups", "posterior", "group_cn", "group_segments", "signal", "null", "markers", "barcode_evidence", "group_evidence"):
                sinks.parquet(getattr(self, name), str(root / name))
            sinks.described(root / "membership.json", self.membership)
            sinks.described(root / "nodes.json", self.nodes)
        except Exception as e:
            sinks.described(root / "run.json", self.about | {"status": "failed", "error": str(e)})
            raise
        sinks.described(root / "run.json", self.about | {"status": "complete"})


def prepare(spark: SparkSession, matrix, cells, genes, reference=None, alleles=None, genetic_map: str | None = None, out: str | None = None) -> bundles.Bundle:
    made = bundles.load(spark, matrix, cells, genes, reference, alleles, genetic_map)
    if out is not None:
        bundles.write(made, out)
        made = bundles.read(spark, out)
    return made


def preprocess(spark: SparkSession, matrix, cells, genes, allele_folder: str, phased: str, genetic_map: str, reference=None, out: str | None = None) -> bundles.Bundle:
    """prepare() from a per-cell allele count folder and a phased file: pile-up and phasing themselves are other programs' work."""
    pairs = matrices.allele_folder(spark, allele_folder, phased, tables.cells(spark, cells))
    return prepare(spark, matrix, cells, genes, reference, pairs, genetic_map, out)


def fit_reference(spark: SparkSession, matrix, cells, genes, panel: DataFrame, out: str | None = None, **settings) -> mixture.Fit:
    """A reference out of a panel (gene, profile, fraction) for the pooled counts of the annotated cells."""
    counts, _ = matrices.feature_folder(spark, matrix) if isinstance(matrix, str) else matrix
    pooled = aggregate.gene_totals(counts.join(tables.cells(spark, cells), "cell", "left_semi"))
    fit = mixture.fit_reference(pooled, panel, tables.genes(spark, genes), **settings)
    if out is not None:
        fit.audit |= {"input_digests": {"counts": sinks.digest(pooled), "panel": sinks.digest(panel)}}
        sinks.fit(fit, out)
    return fit


def signal(bundle: bundles.Bundle, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(scores with p_value, null table): whether barcodes differ at all. Needs no reference."""
    cells = bundle.grouped()
    region = regions.region_counts(bundle.expression, bundle.alleles, bundle.genes, bundle.loci, settings.region_width).persist()
    return regions.signal_test(region, cells, settings.permutations, settings.seed)


def infer(bundle: bundles.Bundle, settings: Settings = Settings(), progress=lambda what: None) -> Result:
    """Groups of barcodes and their copy numbers. The reference's fractions must be positive somewhere."""
    began, spark, model = time.perf_counter(), bundle.cells.sparkSession, settings.model
    if not bundle.genes.filter("fraction > 0").limit(1).count():
        raise ValueError("inference needs a reference")
    progress("signal")
    tested, null = signal(bundle, settings)
    cells = bundle.grouped().persist()
    sizes = {r.group: r["count"] for r in cells.groupBy("group").count().collect()}
    barcodes = sorted(sizes)
    counts = np.array([sizes[b] for b in barcodes], float)

    progress("profiles")
    blocks = resample.bootstrap_profiles(bundle.expression, cells, bundle.genes, settings.bootstraps, settings.seed, settings.window)
    x, boot, _ = resample.feature_arrays(blocks.persist(), barcodes)
    pools = grouping.phase_pools(x)
    expression, weighted, core = grouping.both_rules(x, boot)
    nodes = {"weighted": weighted.nodes, "core": core.nodes}

    progress("pooled fit")
    markers, loci = bundle.grid.orderBy("marker").toPandas(), bundle.loci.orderBy("locus").toPandas()
    ax = fitting.Axis.of(markers, loci, model)
    labels = spark.createDataFrame([(b, int(p)) for b, p in zip(barcodes, pools, strict=True)], "barcode string, group int")
    depth = bundle.pseudobulk(labels).orderBy("group", "marker", "gene").toPandas()
    pairs = bundle.pooled_alleles(labels).orderBy("group", "locus").toPandas()
    pooled = fitting.Counts(ax, int(pools.max()), depth.assign(group=depth["group"] - 1, weight=1.0), pairs.assign(group=pairs["group"] - 1))
    fit = fitting.fit_pooled(pooled, model, settings.options)
    if not fit.final.converged:
        raise RuntimeError("the pooled fit didn't converge")

    progress("barcodes")
    own_pairs = bundle.pooled_alleles()
    rows = fitting.member_rows(bundle.pseudobulk().withColumnRenamed("group", "member"), own_pairs.withColumnRenamed("group", "member"), bundle.grid, bundle.loci).persist()
    start = pooled.start()
    noise = fitting.fit_member_dispersion(rows, ax, model, start, settings.options)
    if not noise.converged:
        raise RuntimeError("the barcodes' dispersion search didn't converge")
    seeds = {b: int(s.generate_state(1)[0]) for b, s in zip(barcodes, np.random.SeedSequence(settings.seed).spawn(len(barcodes)), strict=True)}
    posterior = fitting.infer_members(rows, ax, model, noise.parameters, settings.draws, seeds, fixed=start).persist()

    progress("groups")
    gene_markers = bundle.genes.select("marker").distinct()
    usable = bool(own_pairs.filter("het * (h1 + h2) > 0").limit(1).count())
    haplotypes = _haplotypes(bundle, fit.final.phase, cells, settings) if usable and (settings.hf_refinement or "hf" in settings.method) else None
    if settings.method in clones.SELF_METHODS:
        calls = clones.call_self(x, boot, counts, settings.method, haplotypes)
    else:
        shared = posterior.join(gene_markers, "marker", "left_semi")
        apart = clones.path_distance_rows(shared.select("member", "marker", "path")).persist()
        profiles = shared.select("member", "marker", F.col("classes").alias("p"))
        expected = paths.profile_distance_rows(profiles).persist()
        calls = clones.call_pairs(apart, barcodes, counts, membership.impurities(profiles), settings.method, expected, initial=expression)
        if settings.cn_refinement and settings.method != "expression":
            calls.labels, nodes["cn"] = clones.subdivide(apart, barcodes, counts, calls.labels)
        apart.unpersist()
        expected.unpersist()
    final, hf_status = calls.labels, "fitted_phase" if usable else "no_usable_allele_counts"
    if settings.hf_refinement and haplotypes is not None:
        final, stable, nodes["hf"] = grouping.local_refinement(haplotypes["x"], haplotypes["boot"], calls.labels)
    nodes["calls"] = calls.nodes
    groups = spark.createDataFrame(
        [(b, int(g), int(c), int(e), int(q), int(sizes[b]), None if np.isnan(s) else float(s)) for b, g, c, e, q, s in zip(barcodes, final, calls.labels, expression, pools, calls.stability, strict=True)],
        "barcode string, group int, called int, expression_group int, pool int, cells long, stability double",
    )
    progress("report")
    group_cn, table, group_evidence = report_groups(bundle, groups, posterior, ax, model, settings)
    barcode_evidence = segments.placed(segments.member_segments(rows, ax, model, noise.parameters, start), bundle.grid, settings.least_evidence)
    about = {
        "seconds": time.perf_counter() - began, "settings": repr(settings), "alpha_pooled": fit.dispersion.parameters.alpha, "alpha_barcodes": noise.parameters.alpha, "phase_iterations": [fit.first.iterations, fit.final.iterations],
        "input_digests": {name: sinks.digest(getattr(bundle, name)) for name in ("cells", "genes", "grid", "loci", "expression", "alleles")},
        "bound": fit.final.bound, "hf_status": hf_status, "evidence": calls.evidence, "features": calls.features, "method": calls.method,
    }
    return Result(groups, calls.membership, nodes, posterior, group_cn, table, tested, null, bundle.grid, barcode_evidence, group_evidence, about)


def _haplotypes(bundle: bundles.Bundle, phase: np.ndarray, cells: DataFrame, settings: Settings) -> dict:
    spark = cells.sparkSession
    fitted = spark.createDataFrame([(i, float(q)) for i, q in enumerate(phase)], "locus int, phase double")
    loci = bundle.loci.join(fitted, "locus")
    own = cells.select("cell", F.col("cell").alias("group"))
    by_cell = regions.haplotype_bins(bundle.alleles, loci, own).withColumnRenamed("group", "cell")
    bins = regions.haplotype_bins(bundle.alleles, loci, cells)
    return resample.haplotype_features(bins, by_cell, cells.select("cell", "group"), settings.bootstraps, settings.seed, settings.seed)


def report_groups(bundle: bundles.Bundle, groups: DataFrame, posterior: DataFrame, ax: fitting.Axis, model: Model, settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(group_cn, segments, evidence): pooled joint fits of resolved groups beside the consensus of their barcodes, and the evidence of
    the segments of the pooled counts' most probable paths; empty without any group."""
    labels = groups.select("barcode", "group")
    number = groups.agg(F.max("group")).head()[0] or 0
    spark = groups.sparkSession
    if not number:
        empty = spark.createDataFrame([], "group int, marker int, consensus array<double>, label int, uncertain double, conflict double, pooled_conflict double, p array<double>")
        nothing = spark.createDataFrame([], "member int, chrom string, segment int, first int, last int, state string, log_bf double, genes long, best string")
        return empty, axis.segment_table(empty.drop("p", "pooled_conflict"), bundle.grid), segments.placed(nothing, bundle.grid, settings.least_evidence)
    depth, pairs = bundle.pseudobulk(labels).orderBy("group", "marker", "gene").toPandas(), bundle.pooled_alleles(labels).orderBy("group", "locus").toPandas()
    counts = fitting.Counts(ax, int(number), depth.assign(group=depth["group"] - 1, weight=1.0), pairs.assign(group=pairs["group"] - 1))
    noise = fitting.fit_joint_dispersion(counts, model, settings.options)
    if not noise.converged:
        raise RuntimeError("the groups' dispersion search didn't converge")
    p = STATES.classes(fitting.infer_joint(counts, model, noise.parameters)[0])
    rows = [(g + 1, m, p[g, m].tolist()) for g in range(number) for m in range(p.shape[1])]
    pooled = spark.createDataFrame(rows, "group int, marker int, p array<double>")
    members = groups.select(F.col("barcode").alias("member"), "group", "cells")
    made = aggregate.consensus(posterior.select("member", "marker", F.col("classes").alias("p")), members, pooled, settings.threshold)
    pool = lambda frame: frame.withColumnRenamed("group", "member")
    rows = fitting.member_rows(pool(bundle.pseudobulk(labels)), pool(bundle.pooled_alleles(labels)), bundle.grid, bundle.loci)
    evidence = segments.placed(segments.member_segments(rows, ax, model, noise.parameters, counts.start()), bundle.grid, settings.least_evidence)
    return made.join(pooled, ["group", "marker"]), axis.segment_table(made, bundle.grid), evidence


def run(spark: SparkSession, matrix, cells, genes, reference, alleles=None, genetic_map: str | None = None, settings: Settings = Settings(), out: str | None = None) -> Result:
    """prepare() and infer() in one."""
    result = infer(prepare(spark, matrix, cells, genes, reference, alleles, genetic_map), settings)
    if out is not None:
        result.save(out)
    return result


__all__ = ["Parameters", "Result", "Settings", "fit_reference", "infer", "prepare", "preprocess", "run", "signal"]

"""The bundle: all count tables of one study as a folder of Parquet tables with a versioned description, and how it is loaded."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countaxis import schema
from countaxis.operators import aggregate, axis
from countaxis.sources import matrices, tables

TABLES = ("cells", "genes", "grid", "loci", "expression", "alleles")


@dataclass(frozen=True)
class Bundle:
    """cells: cell, barcode, library; genes: gene, chrom, position, idx, marker, fraction; grid: marker, chrom, chrom_rank, start, end;
    loci: locus, chrom, position, marker, population_phase, genetic_cm, het; expression: gene, cell, n; alleles: locus, cell, h1, h2."""

    cells: DataFrame
    genes: DataFrame
    grid: DataFrame
    loci: DataFrame
    expression: DataFrame
    alleles: DataFrame

    def validated(self) -> Bundle:
        schema.check_cells(self.cells)
        schema.check_genes(self.genes)
        schema.check_grid(self.grid)
        schema.check_loci(self.loci, self.grid)
        schema.check_counts(self.expression, "n")
        schema.check_counts(self.alleles, "h1", "h2")
        schema.check_library(self.expression, self.cells)
        return self

    def grouped(self, labels: DataFrame | None = None) -> DataFrame:
        """cell, group, library: groups are barcodes, or labels (barcode, group), unlabelled barcodes unresolved (0)."""
        if labels is None:
            return self.cells.select("cell", F.col("barcode").alias("group"), "library")
        return self.cells.join(F.broadcast(labels.select("barcode", "group")) if labels.isLocal() else labels.select("barcode", "group"), "barcode", "left").select("cell", F.coalesce("group", F.lit(0)).alias("group"), "library")

    def pseudobulk(self, labels: DataFrame | None = None) -> DataFrame:
        """group, gene, n, exposure, expected, marker; group 0 left out where labels are given."""
        return aggregate.pseudobulk(self.expression, self.grouped(labels), self.genes.select("gene", "fraction"), labels is not None).join(self.genes.select("gene", "marker"), "gene")

    def pooled_alleles(self, labels: DataFrame | None = None) -> DataFrame:
        return aggregate.pooled_alleles(self.alleles, self.grouped(labels), labels is not None).join(self.loci.select("locus", "het"), "locus")


def write(bundle: Bundle, path: str) -> None:
    """A new folder; an existing one is never written over."""
    spark = bundle.cells.sparkSession
    for name in TABLES:
        getattr(bundle, name).write.mode("errorifexists").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps({"version": schema.VERSION, "tables": TABLES}),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/_about")


def read(spark: SparkSession, path: str) -> Bundle:
    about = json.loads(spark.read.text(f"{path}/_about").head().value)
    if about.get("version") != schema.VERSION:
        raise ValueError(f"unknown version: {about.get('version')}")
    return Bundle(**{name: spark.read.parquet(f"{path}/{name}") for name in TABLES})


def load(spark: SparkSession, matrix: str | tuple[DataFrame, DataFrame], cells, genes, reference=None, alleles=None, genetic_map: str | None = None) -> Bundle:
    """A bundle out of its parts. matrix: a folder, an HDF5 file, or (counts, features) of an adapter.

    Libraries are all expression counts of a cell before genes are chosen. Genes are those of annotation and assay, and with
    a reference those with a positive fraction. Sites take their map position from a map, or from their own column.
    """
    if isinstance(matrix, str):
        counts, features = (matrices.feature_file if matrix.endswith((".h5", ".hdf5")) else matrices.feature_folder)(spark, matrix)
    else:
        counts, features = matrix
    annotated = tables.cells(spark, cells)
    schema.check(annotated.join(counts.select("cell").distinct(), "cell", "left_anti"), "true", "an annotated cell isn't in the matrix")
    counts = counts.join(annotated.select("cell"), "cell", "left_semi")
    libraries = annotated.join(aggregate.library_totals(counts), "cell", "left").select("cell", "barcode", F.coalesce(F.col("library").cast("double"), F.lit(0.0)).alias("library"))
    chosen = tables.genes(spark, genes).join(features, "gene", "left_semi").withColumn("fraction", F.lit(0.0))
    if reference is not None:
        chosen = chosen.drop("fraction").join(tables.reference(spark, reference).filter("fraction > 0"), "gene")
    if not chosen.limit(1).count():
        raise ValueError("no shared gene has a usable reference")
    chosen = axis.gene_order(chosen)
    sites = spark.createDataFrame([], "chrom string, position long, het double, phase_prob double, genetic_cm double")
    rows = spark.createDataFrame([], "cell string, chrom string, position long, h1 long, h2 long")
    if alleles is not None:
        rows = tables.alleles(spark, alleles, annotated)
        sites = tables.site_table(rows)
        if genetic_map is not None:
            sites = axis.interpolated(sites.drop("genetic_cm"), tables.genetic_map(spark, genetic_map)).withColumnRenamed("cm", "genetic_cm")
        elif "genetic_cm" not in sites.columns:
            raise ValueError("a genetic map or genetic_cm values are needed")
    grid = axis.grid(chosen, sites)
    at = grid.select("marker", "chrom", F.col("start").alias("position"))
    chosen = chosen.join(at, ["chrom", "position"]).select("gene", "chrom", "position", "idx", "marker", "fraction")
    from pyspark.sql import Window as W

    loci = sites.join(at, ["chrom", "position"]).withColumn("locus", (F.row_number().over(W.orderBy("marker")) - 1).cast("int"))
    loci = loci.select("locus", "chrom", "position", "marker", F.col("phase_prob").alias("population_phase"), "genetic_cm", "het")
    pairs = rows.join(loci.select("locus", "chrom", "position"), ["chrom", "position"]).groupBy("locus", "cell").agg(F.sum("h1").cast("long").alias("h1"), F.sum("h2").cast("long").alias("h2")).filter("h1 + h2 > 0")
    expression = counts.join(chosen.select("gene"), "gene", "left_semi")
    return Bundle(libraries, chosen, grid, loci, expression, pairs).validated()


def with_fractions(bundle: Bundle, fractions: DataFrame) -> Bundle:
    """The bundle with another reference (gene, fraction)."""
    genes = bundle.genes.drop("fraction").join(fractions.select("gene", "fraction"), "gene", "left").fillna(0.0, ["fraction"])
    return replace(bundle, genes=genes)

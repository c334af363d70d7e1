"""Sparse matrix sources: coordinate text, feature-barcode folders, optional HDF5 and annotated-matrix adapters, allele counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countaxis.functions.columns import canonical_gene, chromosome_name, haplotype_counts
from countaxis.operators.aggregate import library_totals, summed
from countaxis.schema import check, check_counts, check_unique
from countaxis.sources.tables import numbered_lines, phased_sites


def find(spark: SparkSession, folder: str, *names: str) -> str:
    """The first of ``names``, plain or .gz, that is in the folder, by Spark's own file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in [n + s for n in names for s in ("", ".gz")]:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        if path.getFileSystem(conf).exists(path):
            return f"{folder.rstrip('/')}/{name}"
    raise FileNotFoundError(f"none of {names} in {folder}")


def coordinates(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int]]:
    """row, col (from 0), n with repeats summed and zeros dropped; and the shape."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    first = lines.orderBy("line").limit(1).head()
    shape = tuple(map(int, first.value.split()[:2]))
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.col("line") != first.line).select((f[0].cast("int") - 1).alias("row"), (f[1].cast("int") - 1).alias("col"), F.coalesce(F.try_element_at(f, F.lit(3)), F.lit("1")).cast("double").alias("n"))
    check_counts(rows, "n")
    check(rows, f"row < 0 or col < 0 or row >= {shape[0]} or col >= {shape[1]}", "an entry outside the matrix")
    return summed(rows, "row", "col"), shape


def feature_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(counts: gene, cell, n; features: gene) of a feature-barcode folder, gene expression features only: others are left out
    before anything is summed."""
    entries, shape = coordinates(spark, find(spark, folder, "matrix.mtx"))
    f = F.split("value", "\t")
    features = numbered_lines(spark, find(spark, folder, "features.tsv", "genes.tsv")).select("idx", canonical_gene(f[0]).alias("gene"), F.coalesce(F.try_element_at(f, F.lit(3)), F.lit("Gene Expression")).alias("type"))
    barcodes = numbered_lines(spark, find(spark, folder, "barcodes.tsv")).select("idx", F.col("value").alias("cell"))
    if (features.count(), barcodes.count()) != shape:
        raise ValueError("the matrix's shape disagrees with its ids")
    kept = features.filter(F.col("type") == "Gene Expression").select("idx", "gene")
    check_unique(kept, ["gene"], "gene ids are ambiguous without their versions")
    check_unique(barcodes, ["cell"], "repeated cell")
    counts = entries.join(kept.select(F.col("idx").alias("row"), "gene"), "row").join(barcodes.select(F.col("idx").alias("col"), "cell"), "col")
    return counts.select("gene", "cell", "n"), kept.select("gene")


def _triples(spark: SparkSession, data, indices, indptr, genes: list[str], cells: list[str]) -> DataFrame:
    """A compressed matrix by cells as gene, cell, n rows, by Arrow."""
    import pandas as pd

    cell = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    frame = pd.DataFrame({"gene": np.asarray(genes, object)[indices], "cell": np.asarray(cells, object)[cell], "n": np.asarray(data, float)})
    rows = spark.createDataFrame(frame, "gene string, cell string, n double") if len(frame) else spark.createDataFrame([], "gene string, cell string, n double")
    check_counts(rows, "n")
    return summed(rows, "gene", "cell")


def feature_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """feature_folder() of an HDF5 file; needs h5py."""
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading HDF5 needs h5py") from e
    text = lambda x: [v.decode() for v in x[:]]
    with h5py.File(path, "r") as f:
        m = f["matrix"]
        genes, kinds, cells = text(m["features/id"]), text(m["features/feature_type"]), text(m["barcodes"])
        rows = _triples(spark, m["data"][:], m["indices"][:], m["indptr"][:], genes, cells)
    kept = spark.createDataFrame([(g,) for g, k in zip(genes, kinds, strict=True) if k == "Gene Expression"], "gene string").select(F.col("gene").alias("raw"), canonical_gene("gene").alias("gene"))
    check_unique(kept, ["gene"], "gene ids are ambiguous without their versions")
    return rows.join(kept.withColumnRenamed("gene", "g"), F.col("gene") == F.col("raw")).select(F.col("g").alias("gene"), "cell", "n"), kept.select("gene")


def annotated(spark: SparkSession, adata, cells: DataFrame, layer: str | None = None, raw: bool = False, gene_column: str | None = None, library_column: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, features, cells with library) of an annotated matrix object (X, layers, raw, obs, var). Cells are those in both, in
    the object's order (idx); libraries come from a column, or all counts of a cell."""
    if layer is not None and raw:
        raise ValueError("a layer and raw counts exclude each other")
    source = adata.raw if raw else adata
    matrix, var = (source.X if layer is None else adata.layers[layer]), source.var
    genes = [str(g) for g in (var.index if gene_column is None else var[gene_column])]
    names = [str(c) for c in adata.obs.index]
    dense = np.asarray(matrix.todense() if hasattr(matrix, "todense") else matrix)
    rows_, cols = np.nonzero(dense)
    indptr = np.concatenate(([0], np.cumsum(np.bincount(rows_, minlength=len(names)))))
    counts = _triples(spark, dense[rows_, cols], cols, indptr, genes, names)
    order = [(c, i, float(adata.obs[library_column].iloc[i]) if library_column else None) for i, c in enumerate(names)]
    both = spark.createDataFrame(order, "cell string, idx int, given double").join(cells, "cell").join(library_totals(counts), "cell", "left")
    out = both.select("cell", "barcode", "idx", F.coalesce("given", F.col("library").cast("double")).alias("library"))
    features = spark.createDataFrame([(g,) for g in genes], "gene string").select(canonical_gene("gene").alias("gene"))
    check_unique(features, ["gene"], "gene ids are ambiguous without their versions")
    return counts.join(both.select("cell"), "cell", "left_semi").withColumn("gene", canonical_gene("gene")), features, out


def allele_folder(spark: SparkSession, folder: str, phased_path: str, cells: DataFrame, chromosomes: list[str] | None = None) -> DataFrame:
    """cell, chrom, position, h1, h2, het, phase_prob out of a per-cell allele count folder (base sites, samples, AD and DP matrices)
    and a phased file: sites must match in both alleles, samples must be the selected cells exactly, cells without depth drop out."""
    samples = numbered_lines(spark, find(spark, folder, "cellSNP.samples.tsv")).select(F.col("idx").alias("col"), F.col("value").alias("cell"))
    check_unique(samples, ["cell"], "repeated sample")
    check(samples.join(cells, "cell", "left_anti").unionByName(cells.select(F.lit(0).alias("col"), "cell").join(samples, "cell", "left_anti").select("col", "cell")), "true", "samples are not the selected cells")
    base_path = find(spark, folder, "cellSNP.base.vcf")
    ad, shape = coordinates(spark, find(spark, folder, "cellSNP.tag.AD.mtx"))
    dp, shape_dp = coordinates(spark, find(spark, folder, "cellSNP.tag.DP.mtx"))
    base = numbered_sites(spark, base_path)
    if shape != shape_dp or shape != (base.count(), samples.count()):
        raise ValueError("sites, samples and matrices disagree")
    both = dp.withColumnRenamed("n", "dp").join(ad.withColumnRenamed("n", "ad"), ["row", "col"], "full").fillna(0, ["ad", "dp"])
    check(both, "ad > dp", "more alternative than all reads")
    sites = base.join(phased_sites(spark, phased_path), ["chrom", "position", "ref", "alt"])
    if chromosomes is not None:
        sites = sites.filter(F.col("chrom").isin(chromosomes))
    check_unique(sites, ["chrom", "position"], "repeated count site")
    h1, h2 = haplotype_counts("gt", "ad", "dp")
    out = both.filter("dp > 0").join(sites, "row").join(samples, "col").select("cell", "chrom", "position", h1.alias("h1"), h2.alias("h2"), "het", F.col("phase").alias("phase_prob"))
    if not out.limit(1).count():
        raise ValueError("no phased alleles match the counts")
    return out


def numbered_sites(spark: SparkSession, path: str) -> DataFrame:
    """row, chrom, position, ref, alt: sites with their numbers from 0, as matrices count them."""
    lines = numbered_lines(spark, path).filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    first = lines.agg(F.min("idx").alias("first"))
    f = F.split("value", "\t")
    return lines.crossJoin(F.broadcast(first)).select((F.col("idx") - F.col("first")).alias("row"), chromosome_name(f[0]).alias("chrom"), f[1].cast("long").alias("position"), f[3].alias("ref"), f[4].alias("alt"))



"""Window smoothing along the axis: normalised log counts, triangular windows by rank, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countaxis.functions.columns import clipped, log_normalised


def triangular(value: str, order: str, keys: list[str], radius: int) -> Column:
    """Mean of ``value`` by rank within ``keys``, with weights radius + 1 - distance, renormalised at the ends.

    Four windowed sums: on each side the weights are linear in the rank, so sums of the values and of rank times value are
    all that is needed; no row holds its window. ``order`` must be the rank 0, 1, ... within the keys.
    """
    w = W.partitionBy(*keys).orderBy(order)
    v, i = F.col(value), F.col(order)
    left, right = w.rowsBetween(-radius, 0), w.rowsBetween(1, radius)
    one = F.lit(1.0)

    def sides(x: Column) -> Column:
        before = (radius + 1 - i) * F.sum(x).over(left) + F.sum(i * x).over(left)
        after = (radius + 1 + i) * F.coalesce(F.sum(x).over(right), F.lit(0.0)) - F.coalesce(F.sum(i * x).over(right), F.lit(0.0))
        return before + after

    return sides(v) / sides(one)


def cohort_reference(values: DataFrame) -> DataFrame:
    """gene, reference: the median over samples of count / library, scaled to the median library of the selected genes. values:
    sample, gene, n."""
    library = values.groupBy("sample").agg(F.sum("n").alias("library"))
    middle = library.agg(F.median("library").alias("middle"))
    shares = values.join(library, "sample").groupBy("gene").agg(F.median(F.col("n") / F.col("library")).alias("share"))
    return shares.crossJoin(F.broadcast(middle)).select("gene", (F.col("share") * F.col("middle")).alias("reference"))


def centred_profiles(rows: DataFrame, genes: DataFrame, keys: list[str], window: int, limit: float, referenced: bool) -> DataFrame:
    """keys, sample, gene, x of the samples (rows that are not ``ref``), for genes with any count; rows: keys, sample, ref, gene, n.

    Libraries are sums over all genes, as genes without counts add nothing, so they are a small table joined first. Then one
    shuffle by gene serves the filter and the first centring, one by sample the ranks, the smoothing and the median (the
    windows within chromosomes are already dealt), and one by gene the last centring.
    """
    by_gene, by_sample = W.partitionBy(*keys, "gene"), W.partitionBy(*keys, "sample", "ref")
    library = rows.groupBy(*keys, "sample", "ref").agg(F.sum("n").alias("library"))
    middle = library.groupBy(*keys).agg(F.median("library").alias("middle"))
    library = library.join(middle, keys) if keys else library.crossJoin(F.broadcast(middle))
    centre = F.avg(F.when(F.col("ref"), F.col("v"))).over(by_gene) if referenced else F.avg("v").over(by_gene)
    kept = rows.join(library, [*keys, "sample", "ref"]).withColumn("top", F.max("n").over(by_gene)).filter("top > 0")
    kept = kept.withColumn("v", log_normalised("n", "library", "middle")).withColumn("v", clipped(F.col("v") - centre, limit))
    kept = kept.join(genes.select("gene", "chrom", "idx"), "gene").select(*keys, "sample", "ref", "gene", "chrom", "idx", "v").repartition(*keys, "sample", "ref")
    along = W.partitionBy(*keys, "sample", "ref", "chrom").orderBy("idx")
    kept = kept.withColumn("rank", F.row_number().over(along) - 1).withColumn("v", triangular("v", "rank", [*keys, "sample", "ref", "chrom"], window // 2))
    kept = kept.withColumn("v", F.col("v") - F.median("v").over(by_sample))
    return kept.withColumn("x", F.col("v") - centre).filter("not ref").select(*keys, "sample", "gene", "x")


def expression_profiles(values: DataFrame, genes: DataFrame, reference: DataFrame | None = None, window: int = 101, limit: float = 3.0) -> DataFrame:
    """sample, gene, x for every sample and gene; null for genes without any count in samples and reference.

    values: sample, gene, n, dense; genes: gene, chrom, idx (order along the axis); reference: gene, reference, or none.
    Library normalised log2, centred on the reference (or the mean), clipped, smoothed by chromosome, centred on each
    sample's median, and on the reference once more.
    """
    own = values.select(F.col("sample").cast("string").alias("sample"), F.lit(False).alias("ref"), "gene", F.col("n").cast("double").alias("n"))
    rows = own
    if reference is not None:
        rows = own.unionByName(reference.select(F.lit("").alias("sample"), F.lit(True).alias("ref"), "gene", F.col("reference").cast("double").alias("n")))
    profiles = centred_profiles(rows, genes, [], window, limit, reference is not None)
    return own.select("sample", "gene").join(profiles, ["sample", "gene"], "left")


def block_means(profiles: DataFrame, genes: DataFrame, keys: list[str], size: int = 25) -> DataFrame:
    """keys, chrom, block, y: means of the known values in blocks of ``size`` genes of a chromosome, times the root of the block's
    number of genes, unknown ones included; only blocks known for every key."""
    ranked = genes.withColumn("block", F.floor((F.row_number().over(W.partitionBy("chrom").orderBy("idx")) - 1) / size).cast("int"))
    rows = profiles.join(ranked.select("gene", "chrom", "block"), "gene")
    known = F.when(F.isnan("x"), None).otherwise(F.col("x"))
    means = rows.groupBy(*keys, "chrom", "block").agg((F.avg(known) * F.sqrt(F.count("*"))).alias("y"))
    whole = means.groupBy("chrom", "block").agg(F.min(F.when(F.col("y").isNull() | F.isnan("y"), 0).otherwise(1)).alias("whole")).filter("whole = 1")
    return means.join(whole.select("chrom", "block"), ["chrom", "block"], "left_semi")

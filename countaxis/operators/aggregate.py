"""Aggregations of counts: libraries, pseudobulk with dense zeros, resampled sums, dispersion, consensus."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countaxis.functions.columns import logit
from countaxis.schema import check


def summed(counts: DataFrame, *keys: str, value: str = "n") -> DataFrame:
    """Repeated coordinates summed, zeros dropped."""
    return counts.groupBy(*keys).agg(F.sum(value).cast("long").alias(value)).filter(F.col(value) > 0)


def library_totals(counts: DataFrame) -> DataFrame:
    """cell, library: all counts of a cell, so to be taken before any selection of genes."""
    return counts.groupBy("cell").agg(F.sum("n").cast("long").alias("library"))


def gene_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("gene").agg(F.sum("n").cast("long").alias("n"))


def members(cells: DataFrame, exclude_unresolved: bool = False) -> DataFrame:
    """cell, group rows; group 0 is the unresolved and never a group when it is excluded."""
    return cells.filter(F.col("group") != 0) if exclude_unresolved else cells


def pseudobulk(counts: DataFrame, cells: DataFrame, genes: DataFrame, exclude_unresolved: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """group, gene, n, exposure, expected for every group and gene: a gene without counts where some are expected is evidence, so
    zeros are rows too.

    counts: gene, cell, n (sparse); cells: cell, group, library; genes: gene, fraction. Genes on one marker stay apart. The
    shuffle carries sums per group and gene, never cells; the grid is the size of the result. keep: further columns of the genes.
    """
    cells = members(cells, exclude_unresolved)
    exposures = cells.groupBy("group").agg(F.sum("library").alias("exposure"))
    sums = counts.join(cells.select("cell", "group"), "cell").groupBy("group", "gene").agg(F.sum("n").cast("long").alias("n"))
    grid = exposures.crossJoin(genes.select("gene", "fraction", *keep))
    return grid.join(sums, ["group", "gene"], "left").select(
        "group", "gene", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "exposure", (F.col("exposure") * F.col("fraction")).alias("expected"), *keep
    )


def pooled_alleles(alleles: DataFrame, cells: DataFrame, exclude_unresolved: bool = False) -> DataFrame:
    """group, locus, h1, h2 where there is any count: alleles stay sparse."""
    cells = members(cells, exclude_unresolved)
    sums = alleles.join(cells.select("cell", "group"), "cell").groupBy("group", "locus").agg(F.sum("h1").cast("long").alias("h1"), F.sum("h2").cast("long").alias("h2"))
    return sums.filter("h1 + h2 > 0")


def resampled(counts: DataFrame, draws: DataFrame, *keys: str, value: str = "n") -> DataFrame:
    """draw, group and keys with counts weighted by how often each cell was drawn. draws: draw, group, cell, mult. All draws are
    one aggregation: the draw is a key as any other."""
    return counts.join(draws, "cell").groupBy("draw", "group", *keys).agg(F.sum(F.col(value) * F.col("mult")).cast("long").alias(value))


def dispersion(rows: DataFrame) -> DataFrame:
    """One row of starting values: sigma, alpha (from the median absolute deviation of log(n / expected) where both are positive),
    rows used."""
    ratio = rows.filter("n > 0 and expected > 0").select(F.log(F.col("n") / F.col("expected")).alias("r"))
    centre = ratio.agg(F.median("r").alias("centre"))
    spread = ratio.crossJoin(F.broadcast(centre)).agg(F.median(F.abs(F.col("r") - F.col("centre"))).alias("mad"), F.count("*").alias("used"))
    sigma = F.when(F.col("used") < 2, F.lit(0.5)).otherwise(F.greatest(F.lit(0.05), 1.4826 * F.col("mad")))
    return spread.select(sigma.alias("sigma"), F.expm1(sigma * sigma).alias("alpha"), "used")


#: Buckets that a pass of exact_median() counts, and values that it sorts in one task at most.
BUCKETS, SORTED = 4096, 1_000_000


def exact_median(rows: DataFrame, column: str) -> float | None:
    """The median of the column's values that are neither null nor NaN; None without any. For columns of any length: passes over
    ``rows`` count values by bucket, each within the buckets that hold the middle ranks, until few values are left to be sorted."""
    x = F.col(column)
    rows = rows.filter(x.isNotNull() & ~F.isnan(x)).select(x.cast("double").alias("x"))
    low, high, n = rows.agg(F.min("x"), F.max("x"), F.count("*")).head()
    if not n:
        return None
    ranks = [(n - 1) // 2, n // 2]
    while low < high:
        inside = rows.filter(F.col("x").between(low, high))
        if n <= SORTED:
            values = inside.agg(F.sort_array(F.collect_list("x")).alias("x")).select(*(F.get("x", F.lit(r)) for r in ranks)).head()
            return (values[0] + values[1]) / 2
        # Both ends are scaled before they are subtracted, so a range as wide as doubles go has a width.
        place = (F.col("x") / 2 - low / 2) / (high / 2 - low / 2) * BUCKETS
        counted = inside.groupBy(F.least(F.floor(place), F.lit(BUCKETS - 1)).alias("bucket")).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).orderBy("bucket").collect()
        ends = list(accumulate(b["n"] for b in counted))
        first, last = (next(i for i, end in enumerate(ends) if r < end) for r in ranks)
        if first != last:  # the middle lies between two buckets
            return (counted[first]["high"] + counted[last]["low"]) / 2
        before = ends[first] - counted[first]["n"]
        low, high, n, ranks = counted[first]["low"], counted[first]["high"], counted[first]["n"], [r - before for r in ranks]
    return low


def dispersion_of_many(rows: DataFrame) -> DataFrame:
    """dispersion() for rows of any number, such as words: the medians are exact_median()'s."""
    ratio = rows.filter("n > 0 and expected > 0").select(F.log(F.col("n") / F.col("expected")).alias("r"))
    centre = exact_median(ratio, "r")
    used = ratio.count()
    spread = exact_median(ratio.select(F.abs(F.col("r") - centre).alias("r")), "r") if used > 1 else 0.0
    sigma = max(0.05, 1.4826 * spread) if used > 1 else 0.5
    return rows.sparkSession.createDataFrame([(sigma, math.expm1(sigma * sigma), used)], "sigma double, alpha double, used long")


def allele_bias(alleles: DataFrame) -> DataFrame:
    """bias: logit of the first haplotype's share over all, held to .45 ... .55; 0 without counts."""
    share = F.coalesce(F.sum("h1") / F.nullif(F.sum("h1") + F.sum("h2"), F.lit(0)), F.lit(0.5))
    held = F.greatest(F.lit(0.45), F.least(F.lit(0.55), share))
    return alleles.agg(logit(held).alias("bias"))


def class_names() -> list[str]:
    return ["diploid", "gain", "loss", "cnloh"]


def weighted_mean(x, weight) -> Column:
    return F.sum(F.col(x) * F.col(weight)) / F.sum(weight)


def consensus(posterior: DataFrame, cells: DataFrame, pooled: DataFrame | None = None, threshold: float = 0.95) -> DataFrame:
    """group, marker, consensus (mean class probabilities weighted by cells), label, uncertain, conflict, pooled_conflict.

    posterior: member, marker, p (array of class probabilities); cells: member, group, cells; pooled: group, marker, p of the
    pooled fit. Uncertain is the share of cells in members whose largest probability is below the threshold; conflict that in
    sure members whose label differs from the consensus', pooled_conflict from the pooled fit's.
    """
    rows = posterior.join(cells.filter(F.col("group") != 0), "member")
    wide = rows.groupBy("group", "marker").agg(F.sum("cells").alias("cells"), *(F.sum(F.col("p")[k] * F.col("cells")).alias(f"s{k}") for k in range(len(class_names()))))
    mean = wide.select("group", "marker", F.transform(F.array(*(f"s{k}" for k in range(len(class_names())))), lambda s: s / F.col("cells")).alias("consensus"))
    mean = mean.withColumn("label", (F.array_position("consensus", F.array_max("consensus")) - 1).cast("int"))
    keyed = rows.join(mean, ["group", "marker"])
    if pooled is not None:
        best = pooled.select("group", "marker", (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("pooled_label"))
        keyed = keyed.join(best, ["group", "marker"])
    else:
        keyed = keyed.withColumn("pooled_label", F.col("label"))
    sure, own = F.array_max("p") >= threshold, (F.array_position("p", F.array_max("p")) - 1).cast("int")
    share = lambda what: F.sum(F.when(what, F.col("cells")).otherwise(0)) / F.sum("cells")
    parts = keyed.groupBy("group", "marker").agg(share(~sure).alias("uncertain"), share(sure & (own != F.col("label"))).alias("conflict"), share(sure & (own != F.col("pooled_label"))).alias("pooled_conflict"))
    return mean.join(parts, ["group", "marker"])


def common_refinement(left: DataFrame, right: DataFrame) -> DataFrame:
    """member, label: distinct pairs of two partitions' labels (member, label), numbered in their order; 0 where either is 0 or the
    pair has one member only."""
    from pyspark.sql import Window as W

    pairs = left.select("member", F.col("label").alias("a")).join(right.select("member", F.col("label").alias("b")), "member")
    kept = pairs.filter("a <> 0 and b <> 0").groupBy("a", "b").agg(F.count("*").alias("n")).filter("n >= 2")
    numbered = kept.select("a", "b", F.row_number().over(W.orderBy("a", "b")).alias("label"))  # one row a pair of labels
    return pairs.join(numbered, ["a", "b"], "left").select("member", F.coalesce("label", F.lit(0)).alias("label"))


def constant_per_key(rows: DataFrame, keys: list[str], values: list[str], what: str) -> DataFrame:
    """One row a key; an error if any of ``values`` differs within one."""
    sums = rows.groupBy(*keys).agg(*(F.min(v).alias(v) for v in values), *(F.max(v).alias(f"_max_{v}") for v in values))
    check(sums, " or ".join(f"not ({v} <=> _max_{v})" for v in values), what)
    return sums.select(*keys, *values)

"""Canonical tables and the checks of their invariants; each check is one aggregate over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VERSION = "count-tables-1"


#: DDL of the canonical tables, as readers take it.
CELLS = "cell string, barcode string, library double"
GENES = "gene string, marker int, fraction double"
GRID = "marker int, chrom string, chrom_rank int, start bigint, end bigint"
LOCI = "locus int, marker int, position bigint, population_phase double, genetic_cm double, het double"
EXPRESSION = "gene string, cell string, n bigint"
ALLELES = "locus int, cell string, h1 bigint, h2 bigint"


def check(rows: DataFrame, bad: str, what: str) -> None:
    """ValueError if any row fulfils the SQL condition ``bad``; stops at the first."""
    found = rows.filter(bad).limit(1).collect()
    if found:
        raise ValueError(f"{what}: {found[0].asDict()}")


def check_unique(rows: DataFrame, keys: list[str], what: str) -> None:
    check(rows.groupBy(*keys).count(), "count > 1", what)


def check_cells(cells: DataFrame) -> None:
    check(cells, "cell is null or cell = ''", "cell ids must not be empty")
    check(cells, "barcode is null or barcode = ''", "barcodes must not be empty")
    check_unique(cells, ["cell"], "repeated cell")
    if "library" in cells.columns:
        check(cells, "library is null or not library > 0 or isnan(library)", "libraries must be positive")


def check_counts(counts: DataFrame, *values: str) -> None:
    """Finite, whole and not negative."""
    for v in values:
        check(counts, f"{v} is null or isnan({v}) or {v} < 0 or {v} <> floor({v}) or abs({v}) = double('infinity')", f"{v} must be whole and not negative")


def check_genes(genes: DataFrame) -> None:
    check_unique(genes, ["gene"], "repeated gene")
    check(genes, "gene is null or gene = ''", "gene ids must not be empty")
    if "fraction" in genes.columns:
        check(genes, "fraction < 0 or isnan(fraction)", "fractions must not be negative")
        check(genes.agg(F.sum("fraction").alias("total")), "total > 1 + 1e-8", "fractions sum to more than one")


def check_library(counts: DataFrame, cells: DataFrame) -> None:
    """Selected counts of a cell must not be above its library."""
    sums = counts.groupBy("cell").agg(F.sum("n").alias("selected")).join(cells.select("cell", "library"), "cell")
    check(sums, "selected > library", "counts above the library")


def check_grid(grid: DataFrame) -> None:
    check(grid, "start < 1 or end < start", "intervals start at 1 and end at their start or later")
    chain = grid.withColumn("before", F.lag("end").over(W.partitionBy("chrom").orderBy("start", "end")))
    check(chain, "start <= before", "intervals overlap")
    runs = grid.groupBy("chrom").agg(F.min("marker").alias("low"), F.max("marker").alias("high"), F.count("*").alias("n"))
    check(runs, "high - low + 1 <> n", "markers of a chromosome must follow one another")


def check_loci(loci: DataFrame, grid: DataFrame) -> None:
    check(loci, "population_phase < 0 or population_phase > 1 or position < 1", "phases lie in 0 ... 1 and positions from 1 on")
    check(loci, "het < 0 or het > 1", "het lies in 0 ... 1")
    placed = loci.drop("chrom").join(grid.select("marker", "chrom", "start", "end"), "marker", "left")
    check(placed, "chrom is null or position < start or position > end", "a locus lies outside its interval")
    w = W.partitionBy("chrom").orderBy("locus")
    chain = placed.withColumn("before", F.lag("position").over(w)).withColumn("cm_before", F.lag("genetic_cm").over(w))
    check(chain, "position <= before or genetic_cm < cm_before", "loci must follow the grid")


def check_panel(panel: DataFrame) -> None:
    sums = panel.groupBy("profile").agg(F.sum("fraction").alias("total"))
    check(sums, "abs(total - 1) > 1e-8 + 1e-6", "profiles must each sum to one")

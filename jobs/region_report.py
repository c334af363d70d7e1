"""A report of every group's depth along the chromosomes: regions with their state, and segments of one state with their evidence.

Counts of cells are summed in bins of a chromosome, beside what the group's exposure and the bin's rate over all groups let expect.
Log ratios are smoothed by neighbouring bins; bins above or below the thresholds are gains or losses; runs of one state are
segments, and an altered segment that Poisson counts don't bear out (the log likelihood ratio of its ratio against none is below
``least``) is neutral, its raw state kept.

    python -m jobs.region_report --tables IN --out OUT [--config FILE]

OUT/regions and OUT/segments, both by chrom. Only the chromosomes of a run are replaced, so chromosomes can be run one by one, and a
run can be repeated.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countaxis.operators import axis, regions
from countaxis.operators.smoothing import triangular
from countaxis.plans.binding import Bound
from jobs.settings import settings

LOG = logging.getLogger("region_report")
REGIONS = "group long, bin long, depth double, expected double, share double, ratio double, smooth double, raw_state string, segment long, chrom string"
SEGMENTS = "group long, segment long, raw_state string, state string, first_bin long, last_bin long, regions long, depth double, expected double, log_bf double, chrom string"
TABLES = {"regions": REGIONS, "segments": SEGMENTS}
KEYS = ["group", "chrom"]


def region_rows(tables: Bound, width: int, chromosomes: list[str], held: list[DataFrame]) -> DataFrame:
    """group, chrom, bin, depth, expected, share (of the first haplotype; null without counts), ratio: every group has every bin. What is
    persisted is added to ``held``."""
    genes, loci = tables.genes(), tables.loci()
    if chromosomes:
        genes, loci = (x.filter(F.col("chrom").isin(chromosomes)) for x in (genes, loci))
    exposures = tables.libraries().groupBy("group").agg(F.sum("library").alias("exposure")).persist()
    sums = regions.region_sums(tables.count_rows(), tables.allele_rows(), genes, loci, width, tables.cells(), tables.tasks()).persist()  # both are read twice
    held += [exposures, sums]
    rates = regions.region_rates(sums, exposures.withColumnRenamed("exposure", "library"))
    grid = exposures.crossJoin(rates)  # the size of the result
    dense = grid.join(sums, [*KEYS, "bin"], "left").fillna(0.0, ["depth", "h1", "h2"])
    expected = F.col("exposure") * F.col("rate")
    dense = dense.select(*KEYS, "bin", "depth", expected.alias("expected"), (F.col("h1") / F.nullif(F.col("h1") + F.col("h2"), F.lit(0.0))).alias("share"))
    return dense.withColumn("ratio", F.log2((F.col("depth") + 0.5) / (F.col("expected") + 0.5)))


def with_segments(rows: DataFrame, radius: int, gain: float, loss: float) -> DataFrame:
    """rows with smooth, raw_state and the number of their segment within group and chromosome."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*KEYS).orderBy("bin")) - 1)
    smooth = ranked.withColumn("smooth", triangular("ratio", "rank", KEYS, radius)).drop("rank")
    state = F.when(F.col("smooth") > gain, "gain").when(F.col("smooth") < loss, "loss").otherwise("neutral")
    return axis.segments(smooth.withColumn("raw_state", state), KEYS, ["bin"], "raw_state")


def segment_rows(rows: DataFrame, least: float) -> DataFrame:
    sums = rows.groupBy(*KEYS, "segment", "raw_state").agg(
        F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.count("*").alias("regions"), F.sum("depth").alias("depth"), F.sum("expected").alias("expected")
    )
    d, e = F.col("depth"), F.col("expected")
    fit = F.when(e <= 0, F.lit(0.0)).otherwise(F.when(d > 0, d * F.log(d / e)).otherwise(0.0) - (d - e))
    return axis.filtered_segments(sums.withColumn("log_bf", fit).withColumnRenamed("raw_state", "state"), least, "neutral")


def run(spark: SparkSession, tables: str, out: str, width: int = 100_000, radius: int = 3, gain: float = 0.05, loss: float = -0.05, least: float = 5.0, chromosomes: list[str] | None = None) -> dict[str, int]:
    """Write the report of the count tables in ``tables``. A chromosome without any count or site has no rows. Returns the numbers of
    rows written (of all that ``out`` holds)."""
    bound = Bound(spark, tables)
    LOG.info("read %s line items of %s orders from %s", bound.table("lineitem").count(), bound.table("orders").count(), tables)
    held: list[DataFrame] = []
    try:
        _write(with_segments(region_rows(bound, width, chromosomes or [], held), radius, gain, loss), out, "regions")
    finally:
        for frame in held:
            frame.unpersist()
    # Segments are summed from the regions as they were written, so both agree whatever becomes of the inputs.
    written = read(spark, out, "regions")
    if chromosomes:
        written = written.filter(F.col("chrom").isin(chromosomes))
    _write(segment_rows(written, least), out, "segments")
    numbers = {name: read(spark, out, name).count() for name in TABLES}
    LOG.info("%s holds %s", out, ", ".join(f"{n} {name}" for name, n in numbers.items()))
    return numbers


def _write(frame: DataFrame, out: str, name: str) -> None:
    """Replace the chromosomes that ``frame`` has rows of."""
    typed = frame.select(*(F.col(c).cast(t).alias(c) for c, t in (x.split() for x in TABLES[name].split(", "))))
    typed.repartition("chrom", "group").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chrom").parquet(f"{out}/{name}")


def read(spark: SparkSession, out: str, name: str) -> DataFrame:
    """One of the report's tables: regions or segments."""
    return spark.read.schema(TABLES[name]).parquet(f"{out}/{name}")


def main(argv: list[str] | None = None) -> None:
    chosen = settings(__doc__, "region_report.json", ["tables", "out"], argv)
    spark = SparkSession.builder.appName("region_report").getOrCreate()
    try:
        run(spark, **chosen)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

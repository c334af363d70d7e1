"""The ordered axis: gene order, the grid, interpolation, distances, segments, plot data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countaxis.functions.columns import bare_chromosome, chromosome_rank
from countaxis.schema import check


def gene_order(genes: DataFrame) -> DataFrame:
    """genes with idx: 0, 1, ... by chromosome in natural order, position and id."""
    order = W.orderBy(chromosome_rank("chrom"), bare_chromosome("chrom"), "position", "gene")
    return genes.withColumn("idx", F.row_number().over(order) - 1)


def lexical_order(genes: DataFrame) -> DataFrame:
    """genes with idx by chromosome as text, position and id: the order of regional reference fits."""
    return genes.withColumn("idx", F.row_number().over(W.orderBy("chrom", "position", "gene")) - 1)


def grid(*sites: DataFrame) -> DataFrame:
    """marker, chrom, chrom_rank, start, end: distinct sites (chrom, position) of all tables in natural order."""
    union = sites[0].select("chrom", "position")
    for s in sites[1:]:
        union = union.unionByName(s.select("chrom", "position"))
    union = union.distinct().withColumn("chrom_rank", chromosome_rank("chrom")).withColumn("bare", bare_chromosome("chrom"))
    marker = (F.row_number().over(W.orderBy("chrom_rank", "bare", "position")) - 1).cast("int")
    return union.select(marker.alias("marker"), "chrom", "chrom_rank", F.col("position").alias("start"), F.col("position").alias("end"))


def interpolated(sites: DataFrame, steps: DataFrame) -> DataFrame:
    """sites (chrom, position, ...) with cm: linear between the nearest map rows (chrom, bp, cm) on both sides, the end's value
    beyond them; an error for a chromosome without a map. Sites and map are one sorted pass for each chromosome."""
    missing = sites.select("chrom").distinct().join(steps.select("chrom").distinct(), "chrom", "left_anti")
    check(missing, "true", "no genetic map for the chromosome")
    s = F.struct(F.col("bp").alias("bp"), F.col("cm").alias("cm"))
    rows = steps.select("chrom", F.col("bp").alias("at"), s.alias("step"), F.lit(None).cast("struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in sites.schema) + ">").alias("site"))
    rows = rows.unionByName(sites.select("chrom", F.col("position").alias("at"), F.lit(None).cast(rows.schema["step"].dataType).alias("step"), F.struct(*sites.columns).alias("site")))
    w = W.partitionBy("chrom").orderBy("at", F.col("step").isNull())
    before = F.last("step", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    # The same order backwards: a frame that reaches to the end is taken anew for each row.
    back = W.partitionBy("chrom").orderBy(F.col("at").desc(), F.col("step").isNull().desc())
    after = F.last("step", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0))
    both = rows.withColumn("b", before).withColumn("a", after).filter("site is not null")
    share = (F.col("at") - F.col("b.bp")) / (F.col("a.bp") - F.col("b.bp"))
    inner = F.when(F.col("b.bp") == F.col("at"), F.col("b.cm")).otherwise(F.col("b.cm") + share * (F.col("a.cm") - F.col("b.cm")))
    return both.select("site.*", F.coalesce(F.when(F.col("a").isNull(), F.col("b.cm")).when(F.col("b").isNull(), F.col("a.cm")).otherwise(inner)).alias("cm"))


def marker_distances(markers: DataFrame, length: float = 30e6) -> DataFrame:
    """markers with distance to the one before (of interval midpoints; infinite at a chromosome's first) and rho = exp(-distance /
    length), the chance to stay in a copy-number state."""
    w = W.partitionBy("chrom").orderBy("marker")
    middle = (F.col("start") + F.col("end")) / 2
    gap = F.coalesce(middle - F.lag(middle).over(w), F.lit(float("inf")))
    return markers.withColumn("distance", gap).withColumn("rho", F.exp(-F.col("distance") / length))


def phase_switches(loci: DataFrame, rate: float = 1.0) -> DataFrame:
    """loci (chrom, locus, genetic_cm) with switch: the chance of a phase switch since the one before; .5 at a chromosome's first."""
    before = F.lag("genetic_cm").over(W.partitionBy("chrom").orderBy("locus"))
    switch = (1 - F.exp(-2 * rate * (F.col("genetic_cm") - before))) / 2
    return loci.withColumn("switch", F.coalesce(switch, F.lit(0.5)))


def segments(rows: DataFrame, keys: list[str], order: list[str], state: str, breaks: list[str] | None = None) -> DataFrame:
    """rows with segment: 0, 1, ... within ``keys``; a new one where the state, or any of ``breaks`` (say, the chromosome), changes."""
    w = W.partitionBy(*keys).orderBy(*order)
    same = F.lit(True)
    for c in (state, *(breaks or ())):
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    first = F.row_number().over(w) == 1
    flagged = rows.withColumn("_new", F.when(first | ~same, 1).otherwise(0))
    running = F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1
    return flagged.withColumn("segment", running.cast("long")).drop("_new")


def segment_table(consensus: DataFrame, markers: DataFrame) -> DataFrame:
    """group, chrom, segment, label, markers, start, end, mean_p, min_p, uncertain, conflict of runs of one label along the axis."""
    rows = consensus.join(markers.select("marker", "chrom", "start", "end"), "marker").withColumn("p", F.col("consensus")[F.col("label")])
    runs = segments(rows, ["group"], ["marker"], "label", ["chrom"])
    return runs.groupBy("group", "chrom", "segment", "label").agg(
        F.count("*").alias("markers"), F.min("start").alias("start"), F.max("end").alias("end"), F.avg("p").alias("mean_p"), F.min("p").alias("min_p"),
        F.avg("uncertain").alias("uncertain"), F.avg("conflict").alias("conflict"),
    )


def filtered_segments(table: DataFrame, least: float = 5.0, neutral: str = "diploid") -> DataFrame:
    """segments with state: the neutral one where an altered state's log Bayes factor (log_bf) is below ``least``; raw_state stays."""
    return table.withColumn("raw_state", F.col("state")).withColumn("state", F.when((F.col("state") != neutral) & (F.col("log_bf") < least), neutral).otherwise(F.col("state")))


def layout(lengths: DataFrame) -> DataFrame:
    """chrom, length, offset: where each chromosome starts when they stand side by side in natural order."""
    order = W.orderBy(chromosome_rank("chrom"), bare_chromosome("chrom"))
    return lengths.withColumn("offset", F.sum("length").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("length"))


def plot_intervals(values: DataFrame, places: DataFrame) -> DataFrame:
    """chrom, position, left, right, value: markers' intervals with edges halfway to their neighbours of the same chromosome;
    values of coincident markers averaged, unknown ones left out. values: chrom, position, value; places: layout()."""
    known = F.when(F.isnan("value"), None).otherwise(F.col("value"))
    sites = values.groupBy("chrom", "position").agg(F.avg(known).alias("value")).join(F.broadcast(places), "chrom")
    check(sites, "position > length", "a marker lies beyond its chromosome")
    w = W.partitionBy("chrom").orderBy("position")
    left = F.coalesce((F.lag("position").over(w) + F.col("position")) / 2, F.lit(0.0))
    right = F.coalesce((F.lead("position").over(w) + F.col("position")) / 2, F.col("length").cast("double"))
    return sites.select("chrom", "position", (F.col("offset") + left).alias("left"), (F.col("offset") + right).alias("right"), "value")


def disjoint(intervals: DataFrame) -> DataFrame:
    """intervals (chrom, start, end, value) with gaps filled by rows of unknown value; an error where two overlap."""
    w = W.partitionBy("chrom").orderBy("start")
    chain = intervals.withColumn("_next", F.lead("start").over(w))
    check(chain, "_next < end", "intervals overlap")
    gaps = chain.filter("_next > end").select("chrom", F.col("end").alias("start"), F.col("_next").alias("end"), F.lit(float("nan")).alias("value"))
    return intervals.select("chrom", "start", "end", "value").unionByName(gaps)


def same_catalogue(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, each as often, whatever their order; columns are taken by name."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    b = b.select(*a.columns)
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()

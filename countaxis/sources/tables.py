"""Text sources as DataFrames: delimited tables, annotations, maps, variant files. Types are never inferred: ids may look like
numbers, so all columns are strings until they are cast by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countaxis.functions.columns import canonical_gene, chromosome_name, haplotype_counts, info_number, midpoint, pooled_genotype
from countaxis.operators.aggregate import constant_per_key
from countaxis.schema import check, check_unique


def delimited(spark: SparkSession, path: str | DataFrame, sep: str | None = None) -> DataFrame:
    """A table with a header; .tsv is split by tabs, .csv by commas, others by what their first line has most of. Blanks stay
    empty strings. A DataFrame passes with its columns as strings."""
    if isinstance(path, DataFrame):
        return path.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in path.columns))
    name = path.lower().removesuffix(".gz")
    if sep is None:
        sep = "\t" if name.endswith(".tsv") else "," if name.endswith(".csv") else sniffed(spark.read.text(path).head().value)
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", False).option("nullValue", "\u0000").option("emptyValue", "").csv(path).fillna("")


def sniffed(line: str) -> str:
    return max("\t,;| ", key=line.count)


def renamed(frame: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns by their canonical names; a canonical name that is there already stays."""
    for old, new in names.items():
        if old in frame.columns and new not in frame.columns:
            frame = frame.withColumnRenamed(old, new)
    return frame


def need(frame: DataFrame, columns: list[str], what: str) -> None:
    if missing := [c for c in columns if c not in frame.columns]:
        raise ValueError(f"{what} needs {', '.join(missing)}")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """idx, value: the lines of one small file (ids of a matrix's axis) with their numbers from 0."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("idx", "value"))
    return rows


def cells(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """cell, barcode."""
    frame = renamed(delimited(spark, path), {"cell_barcode": "cell", "lineage_barcode": "barcode"})
    need(frame, ["cell", "barcode"], "the cell table")
    check_unique(frame, ["cell"], "repeated cell")
    return frame.select("cell", "barcode")


def gtf_genes(spark: SparkSession, path: str) -> DataFrame:
    """gene, chrom, position of the gene rows of an annotation."""
    fields = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#")).select(fields.alias("f")).filter((F.size("f") == 9) & (F.col("f")[2] == "gene"))
    return _genes(rows.select(F.regexp_extract(F.col("f")[8], 'gene_id "([^"]+)"', 1).alias("gene"), F.col("f")[0].alias("chrom"), midpoint(F.col("f")[3].cast("long"), F.col("f")[4].cast("long")).alias("position")))


def genes(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """gene, chrom, position of a coordinate table (position, or start and end) or an annotation."""
    if isinstance(path, str) and path.lower().removesuffix(".gz").endswith(".gtf"):
        return gtf_genes(spark, path)
    frame = renamed(delimited(spark, path), {"gene_id": "gene", "chromosome": "chrom"})
    need(frame, ["gene", "chrom"], "the gene table")
    position = F.col("position").cast("long") if "position" in frame.columns else midpoint(F.col("start").cast("long"), F.col("end").cast("long"))
    return _genes(frame.select("gene", "chrom", position.alias("position")))


def _genes(frame: DataFrame) -> DataFrame:
    out = frame.select(canonical_gene("gene").alias("gene"), chromosome_name("chrom").alias("chrom"), "position")
    check(out, "position is null or position < 1", "gene positions start at 1")
    check_unique(out, ["gene"], "gene ids are ambiguous without their versions")
    return out


def reference(spark: SparkSession, source: str | DataFrame | dict[str, float]) -> DataFrame:
    """gene, fraction: as given, or expression over the whole profile's sum."""
    if isinstance(source, dict):
        frame = spark.createDataFrame([(k, float(v)) for k, v in source.items()], "gene string, fraction double")
    else:
        frame = delimited(spark, source)
    need(frame, ["gene"], "the reference")
    key = "fraction" if "fraction" in frame.columns else "expression"
    need(frame, [key], "the reference")
    rows = frame.select(canonical_gene("gene").alias("gene"), F.col(key).try_cast("double").alias("v"))
    check_unique(rows, ["gene"], "gene ids are ambiguous without their versions")
    check(rows, "v is null or isnan(v) or v < 0 or v = double('infinity')", "invalid reference value")
    total = rows.agg(F.sum("v").alias("total"))
    check(total, "total is null or not total > 0", "an empty reference")
    if key == "expression":
        return rows.crossJoin(F.broadcast(total)).select("gene", (F.col("v") / F.col("total")).alias("fraction"))
    check(total, "total > 1 + 1e-8", "fractions sum to more than one")
    return rows.withColumnRenamed("v", "fraction")


def genetic_map(spark: SparkSession, path: str) -> DataFrame:
    """chrom, bp, cm of four-column maps (chromosome, id, cM, bp), a file or all .map files below a folder."""
    reader = spark.read if path.endswith(".map") or path.endswith(".map.gz") else spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.map")
    f = F.split(F.trim("value"), r"\s+")
    rows = reader.text(path).filter(F.trim("value") != "").select(f.alias("f"))
    check(rows, "size(f) <> 4", "a map has four columns")
    out = rows.select(chromosome_name(F.col("f")[0]).alias("chrom"), F.col("f")[3].cast("long").alias("bp"), F.col("f")[2].cast("double").alias("cm")).distinct()
    chain = out.withColumn("before", F.lag("cm").over(W.partitionBy("chrom").orderBy("bp", "cm"))).withColumn("at", F.lag("bp").over(W.partitionBy("chrom").orderBy("bp", "cm")))
    check(chain, "at = bp or cm < before", "a map must go up")
    return out


def alleles(spark: SparkSession, path: str | DataFrame, cells_: DataFrame) -> DataFrame:
    """cell, chrom, position, h1, h2, het, phase_prob, and genetic_cm if there; of annotated cells only."""
    frame = renamed(delimited(spark, path), {"chromosome": "chrom", "CHROM": "chrom", "POS": "position", "cM": "genetic_cm"})
    need(frame, ["cell", "chrom", "position"], "the allele table")
    frame = frame.join(cells_.select("cell"), "cell", "left_semi")
    if {"h1", "h2"} <= set(frame.columns):
        h1, h2 = F.col("h1").cast("long"), F.col("h2").cast("long")
    else:
        need(frame, ["AD", "DP", "GT"], "alleles without h1 and h2")
        check(frame, "GT not in ('0|1', '1|0')", "genotypes must be phased")
        h1, h2 = haplotype_counts("GT", F.col("AD").cast("long"), F.col("DP").cast("long"))
    given = lambda name, default: F.col(name).cast("double") if name in frame.columns else F.lit(default)
    columns: list[Column] = [F.col("cell"), chromosome_name("chrom").alias("chrom"), F.col("position").cast("long").alias("position"), h1.alias("h1"), h2.alias("h2"), given("het", 1.0).alias("het"), given("phase_prob", 0.99).alias("phase_prob")]
    if "genetic_cm" in frame.columns:
        columns.append(F.col("genetic_cm").cast("double").alias("genetic_cm"))
    out = frame.select(*columns)
    check(out, "h1 < 0 or h2 < 0 or h1 is null or h2 is null", "haplotype counts must not be negative")
    return out


def site_table(alleles_: DataFrame) -> DataFrame:
    """chrom, position, het, phase_prob (and genetic_cm): one row a site; they must not differ between cells."""
    values = [c for c in ("het", "phase_prob", "genetic_cm") if c in alleles_.columns]
    return constant_per_key(alleles_, ["chrom", "position"], values, "site values differ between cells")


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, position, ref, alt, info, format, samples (array) of records with eight fields or more."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.col("value") != "")).select(f.alias("f")).filter(F.size("f") >= 8)
    return rows.select(
        chromosome_name(F.col("f")[0]).alias("chrom"), F.col("f")[1].cast("long").alias("position"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alt"),
        F.col("f")[7].alias("info"), F.try_element_at("f", F.lit(9)).alias("format"), F.when(F.size("f") > 9, F.slice("f", 10, 1_000_000)).otherwise(F.array().cast("array<string>")).alias("samples"),
    )


def phased_sites(spark: SparkSession, path: str, default_phase: float = 0.99) -> DataFrame:
    """chrom, position, ref, alt, gt, het, phase of one donor's phased heterozygous two-allele sites. het is GP's middle value, else 1;
    phase is 1 - 10^(-PQ/10), else the default. Genotype quality is no phase quality and isn't used."""
    rows = vcf(spark, path)
    check(rows, "size(samples) <> 1", "a phased file holds one donor")
    known = rows.filter("length(ref) = 1 and length(alt) = 1").withColumn("v", F.map_from_arrays(F.split("format", ":"), F.split(F.col("samples")[0], ":")))
    gp, pq = F.col("v")["GP"], F.col("v")["PQ"]
    het = F.when(gp.isNull() | (gp == "."), 1.0).otherwise(F.split(gp, ",")[1].cast("double"))
    phase = F.when(pq.isNull() | (pq == "."), default_phase).otherwise(1 - F.pow(F.lit(10.0), -pq.cast("double") / 10))
    out = known.select("chrom", "position", "ref", "alt", F.col("v")["GT"].alias("gt"), het.alias("het"), phase.alias("phase")).filter("gt in ('0|1', '1|0')")
    check_unique(out, ["chrom", "position"], "repeated site")
    check(out, "not het between 0 and 1 or not phase between 0 and 1 or het is null or phase is null", "invalid site probabilities")
    if not out.limit(1).count():
        raise ValueError("no phased heterozygous sites")
    return out


def pooled_genotypes(spark: SparkSession, path: str) -> DataFrame:
    """chrom, position, ref, alt, gt from a pooled count file's AD, DP and OTH, in axis order by its caller."""
    rows = vcf(spark, path).select("chrom", "position", "ref", "alt", *(info_number("info", k).alias(k.lower()) for k in ("AD", "DP", "OTH")))
    check(rows, "ad < 0 or dp < ad or oth < 0", "impossible allele counts")
    out = rows.filter("length(ref) = 1 and length(alt) = 1").withColumn("gt", pooled_genotype("ad", "dp", "oth")).filter("gt is not null")
    check_unique(out, ["chrom", "position"], "repeated site")
    return out.select("chrom", "position", "ref", "alt", "gt")

"""Sinks: new folders only, tables with a header even when empty, run descriptions that appear at once."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countaxis.functions.columns import bare_chromosome, chromosome_rank


def table(frame: DataFrame, path: str, sep: str = ",") -> None:
    """A compressed text table in a new folder, written by the executors; an empty one is its header."""
    writer = frame.write.mode("errorifexists").option("header", True).option("sep", sep).option("compression", "gzip")
    writer.csv(path)
    if frame.isEmpty():
        spark = frame.sparkSession
        spark.createDataFrame([(sep.join(frame.columns),)], "value string").coalesce(1).write.mode("append").option("compression", "gzip").text(path)


def small_table(frame: DataFrame, path: str, sep: str = ",") -> None:
    """One local text file of a table known to be small (groups, audits); never written over."""
    rows = frame.toPandas()
    opener = gzip.open if path.endswith(".gz") else open
    with opener(path, "xt", newline="") as f:
        rows.to_csv(f, sep=sep, index=False)


def parquet(frame: DataFrame, path: str, about: dict | None = None) -> None:
    frame.write.mode("errorifexists").parquet(path)
    if about is not None:
        described(Path(path) / "_about.json", about)


def described(path: str | Path, about: dict) -> None:
    """A JSON file that is there whole or not at all."""
    path = Path(path)
    fd, draft = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(fd, "w") as f:
        json.dump(about, f, indent=2, sort_keys=True, default=str)
    os.replace(draft, path)


def alleles(rows: DataFrame, path: str) -> None:
    """cell, chromosome, position, h1, h2, het, phase_prob by tabs."""
    table(rows.select("cell", F.col("chrom").alias("chromosome"), "position", "h1", "h2", "het", "phase_prob"), path, "\t")


def genotypes(rows: DataFrame, path: str, sample: str = "donor") -> None:
    """Variant lines of pooled genotypes in natural order, headers first."""
    heads = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]
    spark = rows.sparkSession
    top = spark.createDataFrame([(i, "", 0, h) for i, h in enumerate(heads)], "rank int, bare string, position long, value string")
    line = F.concat_ws("\t", "chrom", "position", F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), "gt")
    body = rows.select((chromosome_rank("chrom") + len(heads)).alias("rank"), bare_chromosome("chrom").alias("bare"), "position", line.alias("value"))
    top.unionByName(body).orderBy("rank", "bare", "position", "value").select("value").write.mode("errorifexists").text(path)


def fit(result, folder: str) -> None:
    """A reference fit: its profile, weights, the part that each gene had, and what it was fitted to."""
    root = Path(folder)
    root.mkdir(parents=True)
    small_table(result.profile, str(root / "reference.tsv"), "\t")
    small_table(result.genes.orderBy("gene"), str(root / "genes.tsv"), "\t")
    with (root / "weights.tsv").open("x") as f:
        f.write("profile\tweight\n" + "".join(f"{k}\t{v!r}\n" for k, v in result.weights.items()))
    described(root / "fit.json", result.audit | {"profile_digest": digest(result.profile)})


def digest(frame: DataFrame) -> str:
    """32 hex digits of a table's columns and rows, whatever the rows' order: the first 128 bits of every row's SHA-256 are summed
    modulo 2**128 and put together with the number of rows and the columns' names and types. Rows that come twice count twice.

    A row is its JSON, nulls kept, so values can't run into each other. One aggregation with partial sums; the driver gets one row.
    """
    names = sorted(frame.columns)
    row = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in names)), {"ignoreNullFields": "false"}), 256)
    limbs = [F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")) for k in range(4)]
    found = frame.select(row.alias("h")).agg(F.count("*"), *limbs).head()
    total = sum(int(limb or 0) << 32 * (3 - k) for k, limb in enumerate(found[1:])) % (1 << 128)
    kinds = dict(frame.dtypes)
    about = json.dumps([[c, kinds[c]] for c in names] + [found[0], total])
    return hashlib.sha256(about.encode()).hexdigest()[:32]

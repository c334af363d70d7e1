"""The jobs as queries: each runs twice into a new folder and returns all that it wrote, with SQL for DuckDB."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countaxis.plans.binding import CTES
from jobs import count_ingest, region_report


def new_folder(spark: SparkSession, what: str) -> str:
    """A folder that no other call uses, in the one that driver and executors share; where none is named (tests), a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="jobs-")
    return f"{shared.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def job1_count_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooled counts of all documents by language, the documents' libraries and the dispersion; the second run finds nothing new."""
    folder = new_folder(spark, "count-ingest")
    for _ in range(2):  # a pattern, as a stream's path must be a folder's or a pattern
        count_ingest.run(spark, f"{sf_dir}/documents.parque[t]", f"{folder}/out", f"{folder}/mark")
    table = lambda name: count_ingest.read(spark, f"{folder}/out", name).withColumn("kind", F.lit(name))
    rows = table("profiles").withColumn("expected", F.round("expected", 4)).withColumn("score", F.round("score", 6))
    fit = table("dispersion").select("kind", "used", *(F.round(x, 6).alias(x) for x in ("sigma", "alpha")))
    # Sums of batches are in the profiles; which batch a document came with depends on the files.
    return rows.unionByName(table("cells").drop("batch"), allowMissingColumns=True).unionByName(fit, allowMissingColumns=True)


def job2_region_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with their segments."""
    folder = new_folder(spark, "region-report")
    for _ in range(2):
        region_report.run(spark, sf_dir, folder)
    regions, segments = (region_report.read(spark, folder, x) for x in ("regions", "segments"))
    runs = segments.select("group", "chrom", "segment", "state", "first_bin", "last_bin", "regions", F.round("log_bf", 6).alias("log_bf"))
    rounded = [F.round(x, 6).alias(x) for x in ("expected", "share", "ratio", "smooth")]
    rows = regions.select("group", "chrom", "bin", "depth", *rounded, "raw_state", "segment")
    return rows.join(runs, ["group", "chrom", "segment"])


JOB1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'unknown') AS "group", regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc_id, "group", unnest(w) AS gene FROM d),
s AS (SELECT "group", gene, count(*) AS n, count(DISTINCT doc_id) AS cells FROM t GROUP BY 1, 2),
e AS (SELECT "group", CAST(sum(len(w)) AS BIGINT) AS exposure FROM d GROUP BY 1),
a AS (SELECT gene, sum(n) AS all_n FROM s GROUP BY 1),
r AS (SELECT s."group", s.gene, s.n, s.cells, e.exposure, CAST(e.exposure AS DOUBLE) * a.all_n / (SELECT sum(exposure) FROM e) AS expected FROM s JOIN e ON e."group" = s."group" JOIN a ON a.gene = s.gene),
x AS (SELECT ln(n / expected) AS x FROM r), m AS (SELECT median(x) AS m FROM x),
g AS (SELECT CASE WHEN count(*) < 2 THEN 0.5 ELSE greatest(0.05, 1.4826 * median(abs(x - m))) END AS sigma, count(*) AS used FROM x, m)
SELECT 'profiles' AS kind, "group", gene, n, cells, exposure, round(expected, 4) AS expected, round(log2((n + 0.5e0) / (expected + 0.5e0)), 6) AS score, NULL AS cell, NULL AS library, NULL AS genes, NULL AS used, NULL AS sigma, NULL AS alpha FROM r
UNION ALL SELECT 'cells', "group", NULL, NULL, NULL, NULL, NULL, NULL, doc_id, CAST(len(w) AS BIGINT), CAST(len(list_distinct(w)) AS BIGINT), NULL, NULL, NULL FROM d
UNION ALL SELECT 'dispersion', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, used, round(sigma, 6), round(exp(sigma * sigma) - 1, 6) FROM g
"""
NAMES = ("counts", "cells", "libraries", "genes", "loci", "alleles")
JOB2_SQL = f"""
WITH {", ".join(f"{n} AS ({CTES[n]})" for n in NAMES)},
depths AS (SELECT g.chrom, (g.position - 1) // 100000 AS bin, c.cell, sum(n) AS depth FROM counts c JOIN genes g ON c.gene = g.gene GROUP BY 1, 2, 3),
pairs AS (SELECT l.chrom, (l.position - 1) // 100000 AS bin, a.cell, sum(CASE WHEN phase >= 0.5 THEN h1 ELSE h2 END) AS h1, sum(CASE WHEN phase >= 0.5 THEN h2 ELSE h1 END) AS h2 FROM alleles a JOIN loci l ON a.locus = l.locus GROUP BY 1, 2, 3),
region AS (SELECT chrom, bin, cell, depth, 0 AS h1, 0 AS h2 FROM depths UNION ALL SELECT chrom, bin, cell, 0, h1, h2 FROM pairs),
rates AS (SELECT chrom, bin, CAST(sum(depth) AS DOUBLE) / (SELECT sum(library) FROM libraries WHERE TRUE) AS rate FROM region GROUP BY 1, 2),
sums AS (SELECT "group", chrom, bin, CAST(sum(depth) AS DOUBLE) AS depth, CAST(sum(h1) AS DOUBLE) AS h1, CAST(sum(h2) AS DOUBLE) AS h2 FROM region r JOIN libraries l ON r.cell = l.cell GROUP BY 1, 2, 3),
exposures AS (SELECT "group", sum(library) AS exposure FROM libraries GROUP BY 1),
dense AS (SELECT e."group", r.chrom, r.bin, coalesce(s.depth, 0) AS depth, e.exposure * r.rate AS expected, s.h1 / nullif(s.h1 + s.h2, 0) AS share FROM exposures e CROSS JOIN rates r LEFT JOIN sums s ON s."group" = e."group" AND s.chrom = r.chrom AND s.bin = r.bin),
ranked AS (SELECT *, log2((depth + 0.5e0) / (expected + 0.5e0)) AS ratio, row_number() OVER (PARTITION BY "group", chrom ORDER BY bin) - 1 AS rank FROM dense),
smoothed AS (SELECT a."group", a.chrom, a.bin, sum((4 - abs(a.rank - b.rank)) * b.ratio) / sum(4 - abs(a.rank - b.rank)) AS smooth FROM ranked a JOIN ranked b ON a."group" = b."group" AND a.chrom = b.chrom AND abs(a.rank - b.rank) <= 3 GROUP BY 1, 2, 3),
states AS (SELECT r.*, s.smooth, CASE WHEN s.smooth > 0.05 THEN 'gain' WHEN s.smooth < -0.05 THEN 'loss' ELSE 'neutral' END AS raw_state FROM ranked r JOIN smoothed s ON s."group" = r."group" AND s.chrom = r.chrom AND s.bin = r.bin),
flagged AS (SELECT *, CASE WHEN raw_state IS DISTINCT FROM lag(raw_state) OVER (PARTITION BY "group", chrom ORDER BY bin) THEN 1 ELSE 0 END AS new FROM states),
runs AS (SELECT *, CAST(sum(new) OVER (PARTITION BY "group", chrom ORDER BY bin ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS segment FROM flagged),
fits AS (SELECT "group", chrom, segment, raw_state, min(bin) AS first_bin, max(bin) AS last_bin, count(*) AS regions, sum(depth) AS d, sum(expected) AS e FROM runs GROUP BY 1, 2, 3, 4),
kept AS (SELECT *, CASE WHEN e <= 0 THEN 0 ELSE CASE WHEN d > 0 THEN d * ln(d / e) ELSE 0 END - (d - e) END AS log_bf FROM fits)
SELECT CAST(r."group" AS BIGINT) AS "group", r.chrom, r.bin, r.depth, round(r.expected, 6) AS expected, round(r.share, 6) AS share, round(r.ratio, 6) AS ratio, round(r.smooth, 6) AS smooth, r.raw_state, r.segment,
  CASE WHEN k.raw_state <> 'neutral' AND k.log_bf < 5 THEN 'neutral' ELSE k.raw_state END AS state, k.first_bin, k.last_bin, k.regions, round(k.log_bf, 6) AS log_bf
FROM runs r JOIN kept k ON k."group" = r."group" AND k.chrom = r.chrom AND k.segment = r.segment
"""
QUERIES = {"job1_count_ingest": job1_count_ingest, "job2_region_report": job2_region_report}
SQL = {"job1_count_ingest": JOB1_SQL, "job2_region_report": JOB2_SQL}

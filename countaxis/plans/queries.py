"""Queries over the bound tables, one or more for each operator, with their SQL where SQL can express them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countaxis.functions import columns as C
from countaxis.functions.likelihood import with_pln
from countaxis.operators import aggregate, axis, clones, grouping, hmm, membership, regions, resample, smoothing, states
from countaxis.operators import paths as planes
from countaxis.operators import segments as evidence
from countaxis.operators.shared import cut
from countaxis.plans.binding import Bound, with_ctes

QUERIES, SQL = {}, {}
WIDTH = 500_000


def query(ctes: str | None = None, sql: str | None = None):
    """Register a query by its function's name; ``sql`` goes after the named common table expressions."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Bound(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_ctes(ctes or "", sql)
        return f

    return add


def r9(x, name: str):
    return F.round(C.column(x), 9).alias(name)


def r6(x, name: str):
    return F.round(C.column(x), 6).alias(name)


DENSE = """, exposures AS (SELECT "group", sum(library) AS exposure FROM libraries GROUP BY 1),
sums AS (SELECT l."group", c.gene, sum(c.n) AS n FROM counts c JOIN libraries l ON c.cell = l.cell GROUP BY 1, 2),
dense AS (SELECT e."group", f.gene, CAST(coalesce(s.n, 0) AS BIGINT) AS n, e.exposure, e.exposure * f.fraction AS expected
  FROM exposures e CROSS JOIN fractions f LEFT JOIN sums s ON s."group" = e."group" AND s.gene = f.gene)"""


@query("counts cells libraries genes fractions", DENSE + ' SELECT "group", gene, n, exposure, round(expected, 6) AS expected FROM dense')
def pseudobulk_dense(b: Bound) -> DataFrame:
    out = aggregate.pseudobulk(b.counts(), b.libraries(), b.fractions())
    return out.select("group", "gene", "n", "exposure", r6("expected", "expected"))


@query("cells alleles", 'SELECT "group", locus, CAST(sum(h1) AS BIGINT) AS h1, CAST(sum(h2) AS BIGINT) AS h2 FROM alleles a JOIN cells c ON a.cell = c.cell WHERE "group" <> 0 GROUP BY 1, 2 HAVING sum(h1) + sum(h2) > 0')
def pooled_alleles(b: Bound) -> DataFrame:
    return aggregate.pooled_alleles(b.alleles(), b.cells(), exclude_unresolved=True)


@query("counts", "SELECT c.cell, CAST(sum(n) AS BIGINT) AS library, CAST(coalesce(sum(n) FILTER (WHERE p_size <= 25), 0) AS BIGINT) AS selected FROM counts c JOIN part p ON c.gene = p.p_partkey GROUP BY 1")
def library_before_filter(b: Bound) -> DataFrame:
    counts = b.counts()
    library = aggregate.library_totals(counts)
    chosen = b.table("part").filter("p_size <= 25").select(F.col("p_partkey").alias("gene"))
    selected = aggregate.library_totals(counts.join(chosen, "gene", "left_semi")).withColumnRenamed("library", "selected")
    return library.join(selected, "cell", "left").select("cell", "library", F.coalesce("selected", F.lit(0)).cast("long").alias("selected"))


RANK = "coalesce(try_cast(chrom AS INTEGER), CASE chrom WHEN 'X' THEN 23 WHEN 'Y' THEN 24 WHEN 'MT' THEN 25 ELSE 26 END)"


@query("genes", f"SELECT gene, chrom, position, row_number() OVER (ORDER BY {RANK}, chrom, position, gene) - 1 AS idx FROM genes")
def gene_sort(b: Bound) -> DataFrame:
    return axis.gene_order(b.genes()).select("gene", "chrom", "position", F.col("idx").cast("long").alias("idx"))


@query("genes loci", f""", sites AS (SELECT chrom, position FROM genes UNION SELECT chrom, position FROM loci)
SELECT CAST(row_number() OVER (ORDER BY {RANK}, chrom, position) - 1 AS INTEGER) AS marker, chrom, {RANK} AS chrom_rank, position AS "start", position AS "end" FROM sites""")
def grid_union(b: Bound) -> DataFrame:
    return axis.grid(b.genes(), b.loci())


REGIONS = f""", depths AS (SELECT g.chrom, (g.position - 1) // {WIDTH} AS bin, c.cell, CAST(sum(n) AS DOUBLE) AS depth FROM counts c JOIN genes g ON c.gene = g.gene GROUP BY 1, 2, 3),
pairs AS (SELECT l.chrom, (l.position - 1) // {WIDTH} AS bin, a.cell, CAST(sum(CASE WHEN phase >= 0.5 THEN h1 ELSE h2 END) AS DOUBLE) AS h1, CAST(sum(CASE WHEN phase >= 0.5 THEN h2 ELSE h1 END) AS DOUBLE) AS h2 FROM alleles a JOIN loci l ON a.locus = l.locus GROUP BY 1, 2, 3),
region AS (SELECT chrom, bin, cell, sum(depth) AS depth, sum(h1) AS h1, sum(h2) AS h2 FROM (SELECT chrom, bin, cell, depth, 0.0 AS h1, 0.0 AS h2 FROM depths UNION ALL SELECT chrom, bin, cell, 0.0, h1, h2 FROM pairs) GROUP BY 1, 2, 3),
rates AS (SELECT chrom, bin, sum(depth) / (SELECT sum(library) FROM libraries) AS rate, coalesce(sum(h1) / nullif(sum(h1) + sum(h2), 0), 0.5) AS fraction FROM region GROUP BY 1, 2)"""


@query("counts cells libraries genes loci alleles", REGIONS + " SELECT chrom, bin, round(rate, 9) AS rate, round(fraction, 9) AS fraction FROM rates")
def region_rate(b: Bound) -> DataFrame:
    out = regions.region_rates(regions.region_sums(b.count_rows(), b.allele_rows(), b.genes(), b.loci(), WIDTH), b.libraries())
    return out.select("chrom", "bin", F.round("rate", 9).alias("rate"), F.round("fraction", 9).alias("fraction"))


@query("counts cells libraries genes loci alleles", REGIONS + """, grp AS (SELECT "group", chrom, bin, sum(depth) AS depth, sum(h1) AS h1, sum(h2) AS h2 FROM region r JOIN libraries l ON r.cell = l.cell GROUP BY 1, 2, 3),
exposures AS (SELECT "group", sum(library) AS exposure FROM libraries GROUP BY 1),
full_grid AS (SELECT e."group", r.chrom, r.bin, e.exposure * r.rate AS expected, r.fraction AS p, coalesce(g.depth, 0) AS d, coalesce(g.h1, 0) AS h1, coalesce(g.h1, 0) + coalesce(g.h2, 0) AS n
  FROM exposures e CROSS JOIN rates r LEFT JOIN grp g ON g."group" = e."group" AND g.chrom = r.chrom AND g.bin = r.bin),
terms AS (SELECT CASE WHEN expected > 0 THEN (d - expected) ** 2 / expected ELSE 0 END AS depth, CASE WHEN n * p * (1 - p) > 0 THEN (h1 - n * p) ** 2 / (n * p * (1 - p)) ELSE 0 END AS allele FROM full_grid)
SELECT round(sum(depth + allele), 4) AS joint, round(sum(depth), 4) AS depth, round(sum(allele), 4) AS allele FROM terms""")
def chi_square_score(b: Bound) -> DataFrame:
    exposure = cut(b.libraries().groupBy("group").agg(F.sum("library").alias("exposure")))
    sums = cut(regions.region_sums(b.count_rows(), b.allele_rows(), b.genes(), b.loci(), WIDTH, b.cells(), b.tasks()))
    rates = regions.region_rates(sums, exposure.withColumnRenamed("exposure", "library"))
    perm = F.lit(0).alias("perm")
    out = regions.chi_square_of_sums(sums.select(perm, *sums.columns), rates, exposure.select(perm, "group", "exposure"))
    return out.select(*(F.round(c, 4).alias(c) for c in ("joint", "depth", "allele")))


SHUFFLED = REGIONS + """, sizes AS (SELECT "group", sum(count(*)) OVER (ORDER BY "group") AS edge FROM libraries GROUP BY 1),
ranked AS (SELECT k.perm, cell, library, row_number() OVER (PARTITION BY k.perm ORDER BY md5(k.perm || ':42:' || cell), cell) AS rank FROM libraries, (SELECT unnest(range(1, 200)) AS perm) k),
labels AS (SELECT 0 AS perm, cell, "group", library FROM libraries UNION ALL
  SELECT r.perm, r.cell, (SELECT min("group") FROM sizes s WHERE s.edge >= r.rank) AS "group", r.library FROM ranked r),
grp AS (SELECT perm, "group", chrom, bin, sum(depth) AS depth, sum(h1) AS h1, sum(h2) AS h2 FROM region r JOIN labels l ON r.cell = l.cell GROUP BY 1, 2, 3, 4),
exposures AS (SELECT perm, "group", sum(library) AS exposure FROM labels GROUP BY 1, 2),
full_grid AS (SELECT e.perm, e.exposure * r.rate AS expected, r.fraction AS p, coalesce(g.depth, 0) AS d, coalesce(g.h1, 0) AS h1, coalesce(g.h1, 0) + coalesce(g.h2, 0) AS n
  FROM exposures e CROSS JOIN rates r LEFT JOIN grp g ON g.perm = e.perm AND g."group" = e."group" AND g.chrom = r.chrom AND g.bin = r.bin),
terms AS (SELECT perm, CASE WHEN expected > 0 THEN (d - expected) ** 2 / expected ELSE 0 END AS depth, CASE WHEN n * p * (1 - p) > 0 THEN (h1 - n * p) ** 2 / (n * p * (1 - p)) ELSE 0 END AS allele FROM full_grid),
scores AS (SELECT perm, sum(depth + allele) AS joint, sum(depth) AS depth, sum(allele) AS allele FROM terms GROUP BY 1)
SELECT round(s.joint, 4) AS joint, round(s.depth, 4) AS depth, round(s.allele, 4) AS allele,
  round((1 + (SELECT count(*) FROM scores n WHERE n.perm > 0 AND n.joint >= s.joint - 1e-9 * greatest(1, abs(s.joint)))) / 200.0e0, 6) AS p_value,
  round(s.joint - (SELECT median(joint) FROM scores WHERE perm > 0), 4) AS excess FROM scores s WHERE perm = 0"""


@query("counts cells libraries genes loci alleles", SHUFFLED)
def permutation_signal(b: Bound) -> DataFrame:
    sites = b.count_rows(), b.allele_rows(), b.genes(), b.loci(), WIDTH
    libraries = b.libraries()
    row = regions.signal_test(regions.region_rows(*sites), libraries, seed=42, rates=regions.region_rates(regions.region_sums(*sites), libraries))[0]
    return row.select(*(F.round(c, 4).alias(c) for c in ("joint", "depth", "allele")), F.round("p_value", 6).alias("p_value"), F.round("excess", 4).alias("excess"))


@query("cells libraries", """, own AS (SELECT "group", cell, row_number() OVER (PARTITION BY "group" ORDER BY cell) - 1 AS place, count(*) OVER (PARTITION BY "group") AS n FROM libraries),
taken AS (SELECT draw, "group", CAST(floor(CAST('0x' || substr(md5(draw || ':1:' || "group" || ':' || place), 1, 12) AS BIGINT) / 281474976710656.0e0 * n) AS BIGINT) AS place, count(*) AS mult
  FROM own, (SELECT unnest(range(0, 64)) AS draw) k GROUP BY ALL)
SELECT CAST(-1 AS INTEGER) AS draw, "group", cell, CAST(1 AS BIGINT) AS mult FROM libraries UNION ALL
SELECT CAST(t.draw AS INTEGER), t."group", o.cell, t.mult FROM taken t JOIN own o ON o."group" = t."group" AND o.place = t.place""")
def cell_draws(b: Bound) -> DataFrame:
    return resample.cell_draws(b.libraries().select("group", "cell"), 64, 1)


NORMALISED = DENSE + """, kept AS (SELECT *, max(n) OVER (PARTITION BY gene) AS top FROM dense),
lib AS (SELECT "group", CAST(sum(n) AS DOUBLE) AS library FROM kept WHERE top > 0 GROUP BY 1),
logs AS (SELECT k."group", k.gene, log2(1 + k.n * (SELECT median(library) FROM lib) / l.library) AS v FROM kept k JOIN lib l ON k."group" = l."group" WHERE top > 0),
clip AS (SELECT "group", gene, greatest(least(v - avg(v) OVER (PARTITION BY gene), 3), -3) AS v FROM logs)"""


@query("counts cells libraries genes fractions", NORMALISED + ' SELECT "group", gene, round(v, 6) AS x FROM clip')
def library_norm_log2_clip(b: Bound) -> DataFrame:
    dense = aggregate.pseudobulk(b.counts(), b.libraries(), b.fractions())
    by_gene = W.partitionBy("gene")
    kept = dense.withColumn("top", F.max("n").over(by_gene)).filter("top > 0")
    library = kept.groupBy("group").agg(F.sum("n").cast("double").alias("library"))
    middle = library.agg(F.median("library").alias("middle"))
    logs = kept.join(library, "group").crossJoin(F.broadcast(middle)).withColumn("v", C.log_normalised("n", "library", "middle"))
    return logs.select("group", "gene", r6(C.clipped(F.col("v") - F.avg("v").over(by_gene), 3.0), "x"))


GENE_SUMS = f", v AS (SELECT g.gene, g.chrom, row_number() OVER (PARTITION BY g.chrom ORDER BY g.position, g.gene) - 1 AS rank, coalesce(CAST(s.n AS DOUBLE), 0) AS n FROM genes g LEFT JOIN (SELECT gene, sum(n) AS n FROM counts GROUP BY 1) s ON g.gene = s.gene)"


def _gene_sums(b: Bound) -> DataFrame:
    sums = aggregate.gene_totals(b.counts())
    rank = F.row_number().over(W.partitionBy("chrom").orderBy("position", "gene")) - 1
    return b.genes().withColumn("rank", rank).join(sums, "gene", "left").select("gene", "chrom", "rank", F.coalesce(F.col("n").cast("double"), F.lit(0.0)).alias("n"))


@query("counts genes", GENE_SUMS + " SELECT a.gene, round(sum((6 - abs(a.rank - b.rank)) * b.n) / sum(6 - abs(a.rank - b.rank)), 6) AS x FROM v a JOIN v b ON a.chrom = b.chrom AND abs(a.rank - b.rank) <= 5 GROUP BY a.gene")
def triangular_smooth(b: Bound) -> DataFrame:
    return _gene_sums(b).select("gene", r6(smoothing.triangular("n", "rank", ["chrom"], 5), "x"))


@query("counts genes", GENE_SUMS + ", y AS (SELECT chrom, rank // 25 AS block, avg(n) * sqrt(count(*)) AS y FROM v GROUP BY 1, 2) SELECT chrom, CAST(block AS INTEGER) AS block, round(y, 6) AS y FROM y")
def block_mean_sqrt(b: Bound) -> DataFrame:
    v = _gene_sums(b)
    out = smoothing.block_means(v.select("gene", F.col("n").alias("x")), v.select("gene", "chrom", F.col("rank").alias("idx")), [])
    return out.select("chrom", "block", r6("y", "y"))


@query("cells alleles loci", """, bins AS (SELECT "group", chrom, (position - 1) // 2000000 AS bin, sum(CASE WHEN phase >= 0.5 THEN h1 ELSE h2 END * het) AS a, sum(CASE WHEN phase >= 0.5 THEN h2 ELSE h1 END * het) AS b FROM alleles x JOIN loci l ON x.locus = l.locus JOIN cells c ON x.cell = c.cell GROUP BY 1, 2, 3),
dense AS (SELECT g."group", r.chrom, r.bin, coalesce(b.a, 0) AS a, coalesce(b.b, 0) AS b FROM (SELECT DISTINCT "group" FROM bins) g CROSS JOIN (SELECT DISTINCT chrom, bin FROM bins) r LEFT JOIN bins b ON b."group" = g."group" AND b.chrom = r.chrom AND b.bin = r.bin),
win AS (SELECT "group", chrom, bin, sum(a + 0.5) OVER w AS t, sum(a + b + 1) OVER w AS s, sum(a + b) OVER w AS coverage FROM dense WINDOW w AS (PARTITION BY "group", chrom ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
raw AS (SELECT *, CAST(2 * t / s - 1 AS DOUBLE) AS x FROM win)
SELECT r."group", r.chrom, r.bin, round(r.x - m.m, 6) AS x, round(CAST(r.coverage AS DOUBLE), 6) AS coverage FROM raw r JOIN (SELECT chrom, bin, median(x) AS m FROM raw GROUP BY 1, 2) m ON r.chrom = m.chrom AND r.bin = m.bin""")
def hf_signed_fraction_window(b: Bound) -> DataFrame:
    out = regions.haplotype_windows(regions.haplotype_bins(b.alleles(), b.loci(), b.cells()))
    return out.select("group", "chrom", "bin", r6("x", "x"), r6("coverage", "coverage"))


MAP = ", steps AS (SELECT chrom, position + 20000 AS bp, genetic_cm AS cm FROM loci)"


@query("genes loci", MAP + """, sites AS (SELECT gene, chrom, position FROM genes WHERE chrom IN (SELECT chrom FROM steps)),
lo AS (SELECT s.*, t.bp AS b0, t.cm AS c0 FROM sites s ASOF LEFT JOIN steps t ON s.chrom = t.chrom AND s.position >= t.bp),
hi AS (SELECT s.gene, t.bp AS b1, t.cm AS c1 FROM sites s ASOF LEFT JOIN steps t ON s.chrom = t.chrom AND s.position <= t.bp)
SELECT l.gene, round(CASE WHEN c0 IS NULL THEN c1 WHEN c1 IS NULL THEN c0 WHEN b1 = b0 THEN c0 ELSE c0 + (position - b0) * (c1 - c0) / (b1 - b0) END, 6) AS cm FROM lo l JOIN hi h ON l.gene = h.gene""")
def map_interpolation(b: Bound) -> DataFrame:
    steps = b.loci().select("chrom", (F.col("position") + 20_000).alias("bp"), F.col("genetic_cm").alias("cm"))
    sites = b.genes().join(steps.select("chrom").distinct(), "chrom", "left_semi")
    return axis.interpolated(sites, steps).select("gene", r6("cm", "cm"))


@query("counts cells libraries genes fractions", DENSE + ", r AS (SELECT ln(n / expected) AS r FROM dense WHERE n > 0 AND expected > 0), m AS (SELECT median(r) AS m FROM r), s AS (SELECT CASE WHEN count(*) < 2 THEN 0.5 ELSE greatest(0.05, 1.4826 * median(abs(r - m))) END AS sigma, count(*) AS used FROM r, m) SELECT round(sigma, 6) AS sigma, round(exp(sigma * sigma) - 1, 6) AS alpha, used FROM s")
def mad_dispersion(b: Bound) -> DataFrame:
    out = aggregate.dispersion(aggregate.pseudobulk(b.counts(), b.libraries(), b.fractions()))
    return out.select(r6("sigma", "sigma"), r6("alpha", "alpha"), "used")


ISLANDS = ", flagged AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY member ORDER BY marker) OR marker = 0 THEN 1 ELSE 0 END AS new FROM states), runs AS (SELECT *, CAST(sum(new) OVER (PARTITION BY member ORDER BY marker ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS segment FROM flagged)"


@query("states", ISLANDS + " SELECT member, CAST(marker AS INTEGER) AS marker, state, segment FROM runs")
def segments(b: Bound) -> DataFrame:
    return axis.segments(b.states(), ["member"], ["marker"], "state").select("member", "marker", "state", "segment")


@query("states", ISLANDS + " SELECT member, segment, state, count(*) AS markers, CAST(min(marker) AS INTEGER) AS first, CAST(max(marker) AS INTEGER) AS last, round(avg(value), 6) AS mean_value, round(min(value), 6) AS min_value FROM runs GROUP BY 1, 2, 3")
def segment_summary(b: Bound) -> DataFrame:
    runs = axis.segments(b.states(), ["member"], ["marker"], "state")
    return runs.groupBy("member", "segment", "state").agg(F.count("*").alias("markers"), F.min("marker").alias("first"), F.max("marker").alias("last"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.min("value"), 6).alias("min_value"))


POSTERIOR = """, w AS (SELECT vec_id AS member, i AS marker, list_transform([1, 2, 3, 4], lambda k: abs(CAST(embedding[i * 4 + k] AS DOUBLE)) + 1e-3) AS u FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS i)),
posterior AS (SELECT member, marker, list_transform(u, lambda x: x / list_sum(u)) AS p FROM w),
own AS (SELECT p.member, p.marker, p.p, e.label + 1 AS "group", 1 + p.member % 7 AS cells FROM posterior p JOIN embeddings e ON e.vec_id = p.member)"""


def _posterior(b: Bound) -> tuple[DataFrame, DataFrame]:
    vectors = b.table("embeddings")
    pick = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.abs(F.element_at("embedding", (F.col("marker") * 4 + k).cast("int")).cast("double")) + 1e-3)
    rows = vectors.select(F.col("vec_id").alias("member"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("marker")).withColumn("u", pick)
    total = F.aggregate("u", F.lit(0.0), lambda a, x: a + x)
    posterior = rows.select("member", "marker", F.transform("u", lambda x: x / total).alias("p"))
    return posterior, vectors.select(F.col("vec_id").alias("member"), (F.col("label") + 1).alias("group"), (1 + F.col("vec_id") % 7).alias("cells"))


@query("", "WITH " + POSTERIOR[2:] + """, mean AS (SELECT "group", marker, [sum(p[1] * cells) / sum(cells), sum(p[2] * cells) / sum(cells), sum(p[3] * cells) / sum(cells), sum(p[4] * cells) / sum(cells)] AS c FROM own GROUP BY 1, 2),
l AS (SELECT *, list_position(c, list_max(c)) - 1 AS label FROM mean)
SELECT o."group", o.marker, CAST(any_value(l.label) AS INTEGER) AS label, round(any_value(l.c[1]), 6) AS p0, round(any_value(l.c[2]), 6) AS p1, round(any_value(l.c[3]), 6) AS p2, round(any_value(l.c[4]), 6) AS p3,
round(sum(CASE WHEN list_max(p) < 0.5 THEN cells ELSE 0 END) / sum(cells), 6) AS uncertain, round(sum(CASE WHEN list_max(p) >= 0.5 AND list_position(p, list_max(p)) - 1 <> l.label THEN cells ELSE 0 END) / sum(cells), 6) AS conflict
FROM own o JOIN l ON o."group" = l."group" AND o.marker = l.marker GROUP BY 1, 2""")
def consensus_conflict(b: Bound) -> DataFrame:
    out = aggregate.consensus(*_posterior(b), threshold=0.5)
    return out.select("group", "marker", "label", *(r6(F.col("consensus")[k], f"p{k}") for k in range(4)), r6("uncertain", "uncertain"), r6("conflict", "conflict"))


@query("", "WITH " + POSTERIOR[2:] + " SELECT member, marker, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS label, list_max(p) >= 0.5 AS sure FROM own")
def argmax_class(b: Bound) -> DataFrame:
    return _posterior(b)[0].select("member", "marker", C.first_argmax("p").alias("label"), C.confident("p", 0.5).alias("sure"))


@query("states", ', s AS (SELECT member, marker, state FROM states), t AS (SELECT a.member AS a, b.member AS b, avg(CASE WHEN a.state <> b.state THEN 1.0e0 ELSE 0.0e0 END) AS d FROM s a JOIN s b ON a.marker = b.marker AND a.member < b.member GROUP BY 1, 2) SELECT a, b, 0 AS draw, round(d, 6) AS distance FROM t')
def path_distance_pairs(b: Bound) -> DataFrame:
    paths = b.states().select("member", "marker", F.array("state").alias("path"))
    return clones.path_distance_rows(paths).select("a", "b", F.col("draw").cast("int").alias("draw"), r6("distance", "distance"))


@query("", """WITH c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2)
SELECT a.label AS a, b.label AS b, round(sum((a.x - b.x) ** 2) / 2 / count(*), 6) AS distance FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2""")
def profile_distance_pairs(b: Bound) -> DataFrame:
    rows = b.table("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = rows.groupBy("label", "i").agg(F.array(F.avg(F.col("x").cast("double"))).alias("p"))
    return planes.profile_distance_rows(mean.select(F.col("label").alias("member"), F.col("i").alias("marker"), "p")).select("a", "b", r6("distance", "distance"))


JOINED = """, p AS (SELECT member, marker, unnest([0, 1, 2]) AS draw, unnest([state, CAST(event_id % 3 AS VARCHAR), CAST(CAST(floor(value) AS BIGINT) % 4 AS VARCHAR)]) AS state FROM states WHERE member IS NOT NULL),
m AS (SELECT member, 1 + member % 7 AS cells, CAST((member * 7) % 5 AS INTEGER) AS "group", (member % 10) / 100.0e0 AS u FROM (SELECT DISTINCT member FROM p)),
d AS (SELECT a.member AS member, b.member AS other, a.draw, avg(CASE WHEN a.state <> b.state THEN 1.0e0 ELSE 0.0e0 END) AS d FROM p a JOIN p b ON a.marker = b.marker AND a.draw = b.draw AND a.member <> b.member GROUP BY 1, 2, 3)"""
ANCHORED = JOINED + """, c AS (SELECT d.member, o."group", d.draw, sum(o.cells * d) / sum(o.cells) AS cost FROM d JOIN m o ON o.member = d.other WHERE o."group" > 0 GROUP BY 1, 2, 3),
n AS (SELECT c.member, c.draw, max(CASE WHEN c."group" = m."group" THEN cost END) AS near, min(CASE WHEN c."group" <> m."group" THEN cost END) AS far FROM c JOIN m ON m.member = c.member WHERE m."group" > 0 GROUP BY 1, 2),
s AS (SELECT member, CASE WHEN count(far) > 0 THEN avg(CASE WHEN far - near > 1e-12 THEN 1.0e0 ELSE 0.0e0 END) END AS stability FROM n GROUP BY 1),
f AS (SELECT m.member, m.cells, m."group", m.u, s.stability, CASE WHEN m."group" > 0 AND coalesce(stability >= 0.6e0, true) THEN m."group" ELSE 0 END AS first FROM m LEFT JOIN s ON s.member = m.member),
h AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY first) < 2 THEN 0 ELSE first END AS anchor FROM f)"""


def _users(b: Bound) -> tuple[planes.Paths, DataFrame]:
    """Paths of users' events by type, number and value, and users with groups, cells and impurities."""
    states = b.states().filter("member is not null")
    own = F.array("state", (F.col("event_id") % 3).cast("string"), (F.floor("value") % 4).cast("string"))
    member = F.col("member")
    users = states.select("member").distinct().select("member", (1 + member % 7).alias("cells"), ((member * 7) % 5).cast("int").alias("group"), ((member % 10) / 100).alias("impurity"))
    return planes.Paths.of(states.select("member", "marker", own.alias("path"))), users


@query("states", ANCHORED + ' SELECT member, "group", anchor, round(stability, 6) AS stability FROM h')
def group_anchors(b: Bound) -> DataFrame:
    """Users that are nearest to their own group's other users in 60 % of the draws."""
    rows = membership.anchors(*_users(b), support=0.6)
    return rows.select("member", "group", "anchor", r6("stability", "stability"))


@query("states", ANCHORED + """, e AS (SELECT d.member, d.other, d.draw, d.d AS raw, d.d - (x.u + y.u) / 2 AS d, y.cells, y.anchor AS "group" FROM d JOIN h x ON x.member = d.member JOIN h y ON y.member = d.other WHERE y.anchor > 0),
g AS (SELECT member, "group", draw, count(*) AS peers, sum(cells * raw) / sum(cells) AS cost, sum(cells * d) / sum(cells) AS seen FROM e GROUP BY 1, 2, 3),
t AS (SELECT g.member, CASE WHEN any_value(h.anchor) > 0 THEN any_value(h.anchor) ELSE arg_min(g."group", (mean, g."group")) END AS target FROM (SELECT member, "group", round(avg(cost), 12) AS mean FROM g GROUP BY 1, 2) g JOIN h ON h.member = g.member GROUP BY 1),
o AS (SELECT t.member, g.draw, max(CASE WHEN g."group" = target THEN cost END) AS near, min(CASE WHEN g."group" <> target THEN cost END) AS far, max(CASE WHEN g."group" = target THEN seen END) AS seen FROM t JOIN g ON g.member = t.member GROUP BY 1, 2),
r AS (SELECT h.member, x."group", count(*) AS fellows FROM h JOIN (SELECT member, anchor AS "group" FROM h WHERE anchor > 0) x ON x.member <> h.member GROUP BY 1, 2),
y AS (SELECT t.member, x."group" FROM t JOIN r o ON o.member = t.member AND o."group" = t.target JOIN r x ON x.member = t.member AND CASE WHEN o.fellows >= 3 THEN x."group" = t.target ELSE x.fellows >= 3 END),
k AS (SELECT y.member, e.member AS fellow, e.draw, sum(e.cells * e.d) / sum(e.cells) AS score FROM y JOIN h x ON x.anchor = y."group" AND x.member <> y.member JOIN e ON e.member = x.member AND e."group" = y."group" AND e.other <> y.member GROUP BY 1, 2, 3),
w AS (SELECT member, draw, quantile_cont(score, 0.95e0) AS within FROM k GROUP BY 1, 2),
z AS (SELECT o.member, CASE WHEN count(far) > 0 THEN avg(CASE WHEN far - near > 1e-12 THEN 1.0e0 ELSE 0.0e0 END) END AS support, avg(seen - within) AS excess, quantile_cont(seen - within, 0.05e0) AS low FROM o LEFT JOIN w ON w.member = o.member AND w.draw = o.draw GROUP BY 1),
j AS (SELECT z.*, t.target, CASE WHEN support < 0.6e0 THEN 'ambiguous_preference' WHEN excess IS NULL THEN 'insufficient_calibration' WHEN low > 1e-12 THEN 'excess_disagreement' ELSE 'assigned' END AS first FROM z JOIN t ON t.member = z.member)
SELECT member, target AS proposed_group, round(support, 6) AS support, round(excess, 6) AS excess_mean, round(low, 6) AS excess_lower05, CASE WHEN first = 'assigned' AND count(*) FILTER (WHERE first = 'assigned') OVER (PARTITION BY target) < 2 THEN 'unreplicated_group' ELSE first END AS reason FROM j""")
def group_membership(b: Bound) -> DataFrame:
    """Which group each user joins: its excess over the 95th percentile of the group's anchors, itself left out everywhere."""
    pairs, users = _users(b)
    anchored = membership.anchors(pairs, users, support=0.6).join(users.select("member", "impurity"), "member")
    rows = membership.assess(pairs, anchored, "member_q95", support=0.6)
    return rows.select("member", "proposed_group", r6("preference_support", "support"), r6("excess_mean", "excess_mean"), r6("excess_lower05", "excess_lower05"), "reason")


@query("", """WITH t AS (SELECT c_custkey AS member, c_nationkey % 5 AS a, CAST(abs(c_custkey * 7) % 4 AS INTEGER) AS b FROM customer),
k AS (SELECT a, b, row_number() OVER (ORDER BY a, b) AS label FROM (SELECT a, b FROM t WHERE a <> 0 AND b <> 0 GROUP BY 1, 2 HAVING count(*) >= 2))
SELECT t.member, CAST(coalesce(k.label, 0) AS INTEGER) AS label FROM t LEFT JOIN k ON t.a = k.a AND t.b = k.b""")
def common_refinement(b: Bound) -> DataFrame:
    customers = b.table("customer")
    left = customers.select(F.col("c_custkey").alias("member"), (F.col("c_nationkey") % 5).alias("label"))
    right = customers.select(F.col("c_custkey").alias("member"), (F.abs(F.col("c_custkey") * 7) % 4).cast("int").alias("label"))
    return aggregate.common_refinement(left, right).select("member", F.col("label").cast("int").alias("label"))


SITES = "WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS dp, CAST(floor(l_quantity * l_discount * 10) AS BIGINT) AS ad, CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END AS oth, CASE WHEN l_returnflag = 'A' THEN '1|0' WHEN l_returnflag = 'R' THEN '0|1' ELSE '0|0' END AS gt FROM lineitem)"


def _sites(b: Bound) -> DataFrame:
    gt = F.when(F.col("l_returnflag") == "A", "1|0").when(F.col("l_returnflag") == "R", "0|1").otherwise("0|0")
    return b.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("dp"), F.floor(F.col("l_quantity") * F.col("l_discount") * 10).cast("long").alias("ad"), F.when(F.col("l_tax") > 0.07, 1).otherwise(0).alias("oth"), gt.alias("gt"))


@query("", SITES + " SELECT l_orderkey, l_linenumber, CASE WHEN dp > 0 AND oth = 0 THEN CASE WHEN ad / dp BETWEEN 0.1e0 AND 0.9e0 THEN '0/1' WHEN ad = dp AND dp >= 10 THEN '1/1' END END AS gt FROM t")
def genotype_rule(b: Bound) -> DataFrame:
    return _sites(b).select("l_orderkey", "l_linenumber", C.pooled_genotype("ad", "dp", "oth").alias("gt"))


@query("", SITES + ", h AS (SELECT l_orderkey, l_linenumber, dp, CASE gt WHEN '1|0' THEN ad WHEN '0|1' THEN dp - ad END AS h1 FROM t) SELECT l_orderkey, l_linenumber, h1, dp - h1 AS h2 FROM h")
def oriented_counts(b: Bound) -> DataFrame:
    h1, h2 = C.haplotype_counts("gt", "ad", "dp")
    return _sites(b).select("l_orderkey", "l_linenumber", h1.alias("h1"), h2.alias("h2"))


LINES = "SELECT l_orderkey, l_linenumber, "


@query("", LINES + "round(lgamma(l_quantity + 4) - lgamma(l_quantity + 1) - lgamma(4.0) - 4 * ln(1 + 0.25e0 * m) + l_quantity * (ln(0.25e0 * m) - ln(1 + 0.25e0 * m)), 6) AS logp FROM (SELECT *, l_extendedprice / 1000 AS m FROM lineitem) WHERE m > 0")
def nb_logpmf(b: Bound) -> DataFrame:
    rows = b.table("lineitem").withColumn("m", F.col("l_extendedprice") / 1000).filter("m > 0")
    return rows.select("l_orderkey", "l_linenumber", r6(C.nb_logpmf("l_quantity", "m", 0.25), "logp"))


@query("", LINES + "round(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + lgamma(k + 8.0) + lgamma(n - k + 12.0) - lgamma(n + 20.0) - lgamma(8.0) - lgamma(12.0) + lgamma(20.0), 6) AS logp FROM (SELECT *, l_quantity AS n, floor(l_quantity * l_discount * 10) AS k FROM lineitem)")
def betabinom_logpmf(b: Bound) -> DataFrame:
    rows = b.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("n"), F.floor(F.col("l_quantity") * F.col("l_discount") * 10).cast("double").alias("k"))
    return rows.select("l_orderkey", "l_linenumber", r6(C.betabinom_logpmf("k", "n", F.lit(8.0), F.lit(12.0)), "logp"))


@query("", LINES + "round(l_quantity * ln(m) - m - lgamma(l_quantity + 1), 6) AS logp FROM (SELECT *, l_extendedprice / 1000 AS m FROM lineitem) WHERE m > 0")
def poisson_logpmf(b: Bound) -> DataFrame:
    rows = b.table("lineitem").withColumn("m", F.col("l_extendedprice") / 1000).filter("m > 0")
    return rows.select("l_orderkey", "l_linenumber", r6(C.poisson_logpmf("l_quantity", "m"), "logp"))


@query()
def pln_logpmf(b: Bound) -> DataFrame:
    rows = b.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("n"), (F.col("l_extendedprice") / 1000).alias("expected"))
    return with_pln(rows, 0.4)


EMIT = """, obs AS (SELECT member, marker, CASE WHEN state IN ('click', 'view') THEN -0.4e0 ELSE -1.6e0 END AS e0, CASE WHEN state IN ('click', 'view') THEN -1.2e0 ELSE -0.5e0 END AS e1 FROM states)"""


def _two_state(b: Bound) -> tuple[DataFrame, dict]:
    first = F.col("state").isin("click", "view")
    return b.states().select("member", "marker", F.when(first, -0.4).otherwise(-1.6).alias("e0"), F.when(first, -1.2).otherwise(-0.5).alias("e1")), {}


def _chains(rows: DataFrame, what, schema: str) -> DataFrame:
    initial, steps = np.log([0.5, 0.5]), np.log([[0.9, 0.1], [0.2, 0.8]])

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("marker")
        emission = pdf[["e0", "e1"]].to_numpy(float)[None]
        dense = hmm.Dense(np.broadcast_to(steps, (emission.shape[1] - 1, 2, 2)))
        return pd.DataFrame(what(pdf, initial, dense, emission))

    return rows.groupBy("member").applyInPandas(run, schema)


@query("states", EMIT + """, f AS (SELECT member, marker, ln(0.5e0) + e0 AS a0, ln(0.5e0) + e1 AS a1 FROM obs WHERE marker = 0
UNION ALL SELECT o.member, o.marker, o.e0 + greatest(f.a0 + ln(0.9e0), f.a1 + ln(0.2e0)) + ln(1 + exp(-abs(f.a0 + ln(0.9e0) - f.a1 - ln(0.2e0)))), o.e1 + greatest(f.a0 + ln(0.1e0), f.a1 + ln(0.8e0)) + ln(1 + exp(-abs(f.a0 + ln(0.1e0) - f.a1 - ln(0.8e0)))) FROM f JOIN obs o ON o.member = f.member AND o.marker = f.marker + 1)
SELECT member, round(greatest(a0, a1) + ln(1 + exp(-abs(a0 - a1))), 6) AS evidence FROM f WHERE (member, marker) IN (SELECT member, max(marker) FROM obs GROUP BY 1)""")
def forward_evidence_2state(b: Bound) -> DataFrame:
    rows, _ = _two_state(b)
    out = _chains(rows, lambda pdf, i, s, e: {"member": [pdf["member"].iloc[0]], "evidence": hmm.evidence(i, s, e)}, "member long, evidence double")
    return out.select("member", r6("evidence", "evidence"))


@query("states", EMIT + """, f AS (SELECT member, marker, ln(0.5e0) + e0 AS a0, ln(0.5e0) + e1 AS a1 FROM obs WHERE marker = 0
UNION ALL SELECT o.member, o.marker, o.e0 + greatest(f.a0 + ln(0.9e0), f.a1 + ln(0.2e0)), o.e1 + greatest(f.a0 + ln(0.1e0), f.a1 + ln(0.8e0)) FROM f JOIN obs o ON o.member = f.member AND o.marker = f.marker + 1)
SELECT member, round(greatest(a0, a1), 6) AS score FROM f WHERE (member, marker) IN (SELECT member, max(marker) FROM obs GROUP BY 1)""")
def viterbi_2state(b: Bound) -> DataFrame:
    rows, _ = _two_state(b)

    def best(pdf, initial, steps, emission):
        path = hmm.viterbi(initial, steps, emission)[0]
        score = initial[path[0]] + emission[0, np.arange(len(path)), path].sum() + sum(steps.logs[t, path[t], path[t + 1]] for t in range(len(path) - 1))
        return {"member": [pdf["member"].iloc[0]], "score": [score]}

    return _chains(rows, best, "member long, score double").select("member", r6("score", "score"))


@query()
def ffbs_paths(b: Bound) -> DataFrame:
    rows, _ = _two_state(b)

    def draw(pdf, initial, steps, emission):
        ahead, _score = hmm.filtered(initial, steps, emission)
        uniforms = np.random.default_rng(int(pdf["member"].iloc[0])).random((256, emission.shape[1]))
        return {"member": pdf["member"].to_numpy(), "marker": pdf["marker"].to_numpy(), "path": list(hmm.sampled(ahead[0], steps, uniforms).T)}

    return _chains(rows, draw, "member long, marker int, path array<int>")


@query("", """WITH d AS (SELECT o_custkey % 25 AS draw, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') - avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS delta FROM orders GROUP BY 1)
SELECT round(quantile_cont(delta, CAST(0.05 AS DOUBLE)), 4) AS q05, round(quantile_cont(delta, CAST(0.95 AS DOUBLE)), 4) AS q95, round(avg(delta), 4) AS mean FROM d""")
def quantile_contrast(b: Bound) -> DataFrame:
    side = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    d = b.table("orders").groupBy((F.col("o_custkey") % 25).alias("draw")).agg((side("F") - side("O")).alias("delta"))
    q = d.agg(F.percentile("delta", F.array(F.lit(0.05), F.lit(0.95))).alias("q"), F.avg("delta").alias("mean"))
    return q.select(F.round(F.col("q")[0], 4).alias("q05"), F.round(F.col("q")[1], 4).alias("q95"), F.round("mean", 4).alias("mean"))


@query("counts", """, s AS (SELECT c.gene, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(n) FILTER (WHERE c.cell % 2 = 0) AS DOUBLE) AS a, CAST(sum(n) FILTER (WHERE c.cell % 3 = 0) AS DOUBLE) AS b FROM counts c GROUP BY 1),
p AS (SELECT n, a / sum(a) OVER () AS a, b / sum(b) OVER () AS b FROM s WHERE n > 0 AND a > 0 AND b > 0), m AS (SELECT n, 0.6e0 * a + 0.4e0 * b AS x FROM p)
SELECT round(avg((ln(x / (SELECT sum(x) FROM m)) - ln(n / (SELECT sum(n) FROM m))) ** 2), 6) AS loss, count(*) AS genes FROM m""")
def pooled_reference_loss(b: Bound) -> DataFrame:
    of = lambda k: F.sum(F.when(F.col("cell") % k == 0, F.col("n"))).cast("double")
    sums = b.counts().groupBy("gene").agg(F.sum("n").cast("double").alias("n"), of(2).alias("a"), of(3).alias("b")).filter("n > 0 and a > 0 and b > 0")
    totals = sums.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    mix = sums.crossJoin(F.broadcast(totals)).select("n", (0.6 * F.col("a") / F.col("ta") + 0.4 * F.col("b") / F.col("tb")).alias("x"))
    all_ = mix.agg(F.sum("n").alias("tn"), F.sum("x").alias("tx"))
    error = F.log(F.col("x") / F.col("tx")) - F.log(F.col("n") / F.col("tn"))
    return mix.crossJoin(F.broadcast(all_)).agg(F.round(F.avg(error * error), 6).alias("loss"), F.count("*").alias("genes"))


@query("genes", """, m AS (SELECT gene, chrom, position, row_number() OVER (PARTITION BY chrom ORDER BY position) AS k FROM genes), d AS (SELECT gene, position - lag(position) OVER (PARTITION BY chrom ORDER BY k) AS distance FROM m)
SELECT gene, round(coalesce(exp(-distance / 30000000.0e0), 0), 9) AS rho FROM d""")
def marker_distance(b: Bound) -> DataFrame:
    markers = b.genes().select("gene", "chrom", F.col("position").alias("start"), F.col("position").alias("end"), F.col("gene").alias("marker"))
    return axis.marker_distances(markers).select("gene", F.round("rho", 9).alias("rho"))


@query("loci", """, s AS (SELECT locus, genetic_cm - lag(genetic_cm) OVER (PARTITION BY chrom ORDER BY locus) AS gap FROM loci) SELECT locus, round(coalesce((1 - exp(-2 * gap)) / 2, 0.5), 9) AS switch FROM s""")
def phase_switch(b: Bound) -> DataFrame:
    return axis.phase_switches(b.loci()).select("locus", F.round("switch", 9).alias("switch"))


@query("genes", f""", l AS (SELECT chrom, max(position) AS length FROM genes GROUP BY 1) SELECT chrom, length, CAST(sum(length) OVER (ORDER BY {RANK}, chrom ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS "offset" FROM l""")
def genome_layout(b: Bound) -> DataFrame:
    return axis.layout(b.genes().groupBy("chrom").agg(F.max("position").alias("length")))


@query("counts cells", """, draws AS (SELECT 0 AS draw, "group", cell, 1 + cell % 3 AS mult FROM cells) SELECT draw, "group", gene, CAST(sum(n * mult) AS BIGINT) AS n FROM counts c JOIN draws d ON c.cell = d.cell GROUP BY 1, 2, 3""")
def weighted_resample(b: Bound) -> DataFrame:
    draws = b.cells().select(F.lit(0).alias("draw"), "group", "cell", (1 + F.col("cell") % 3).alias("mult"))
    return aggregate.resampled(b.counts(), draws, "gene")


def _small(b: Bound) -> tuple[DataFrame, DataFrame, DataFrame]:
    genes = axis.gene_order(b.genes()).select("gene", "chrom", "idx")
    return b.counts(), b.cells(), genes


@query()
def expression_profiles(b: Bound) -> DataFrame:
    values = aggregate.pseudobulk(b.counts(), b.libraries(), b.fractions()).select(F.col("group").cast("string").alias("sample"), "gene", "n")
    return resample.profiles(values, _small(b)[2])


@query()
def bootstrap_blocks(b: Bound) -> DataFrame:
    counts, cells, genes = _small(b)
    return resample.bootstrap_profiles(counts, cells, genes, seed=1)


@query()
def clone_calls(b: Bound) -> DataFrame:
    counts, cells, genes = _small(b)
    blocks = resample.bootstrap_profiles(counts, cells, genes, seed=1, wide=True)
    groups = [r.group for r in cells.select("group").filter("group is not null").distinct().orderBy("group").collect()]
    features = grouping.Features(blocks, len(groups))
    result, moments = clones.call_expression(features), features.moments
    pools = grouping.pools_of(moments.raw.products, moments.low == moments.high)
    return b.spark.createDataFrame([(int(g), int(k), int(q), float(s)) for g, k, q, s in zip(groups, result.labels, pools, result.stability, strict=True)], "member int, label int, pool int, stability double")


def _joint_chain(b: Bound, genes: DataFrame, loci: DataFrame, draws: int = 256) -> DataFrame:
    from countaxis.operators import fitting

    loci = loci.select("locus", "chrom", (F.col("position") + 500).alias("position"), "population_phase", "genetic_cm", "het")
    markers = cut(axis.grid(genes, loci).drop("chrom_rank"))
    at = markers.select("marker", "chrom", F.col("start").alias("position"))
    placed = loci.join(at, ["chrom", "position"])
    libraries = cut(b.libraries())
    sites = b.fractions().join(genes.join(at, ["chrom", "position"]).select("gene", "chrom", "marker"), "gene")
    depth = aggregate.pseudobulk(b.count_rows(), libraries, sites, keep=("chrom", "marker")).withColumnRenamed("group", "member")
    alleles = aggregate.pooled_alleles(b.allele_rows(), libraries).join(placed.select("locus", "het"), "locus").withColumnRenamed("group", "member")
    rows = fitting.member_rows(depth, alleles, markers, placed)
    model = states.Model(family="nb", outlier=0.0)
    return fitting.infer_members(rows, fitting.axis_rows(markers, placed), model, states.Parameters(0.2), draws=draws, seeds={k: k for k in range(25)})


@query()
def joint_chain(b: Bound) -> DataFrame:
    """The joint chain of every nation over all parts and all loci."""
    return _joint_chain(b, b.genes(), b.loci())


@query(None, "SELECT l_partkey AS gene, l_suppkey AS locus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) > 0")
def duplicate_sum(b: Bound) -> DataFrame:
    rows = b.table("lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("locus"), F.col("l_quantity").cast("long").alias("n"))
    return aggregate.summed(rows, "gene", "locus")


@query("genes", " SELECT gene, chrom, position, row_number() OVER (ORDER BY chrom, position, gene) - 1 AS idx FROM genes")
def lexical_order(b: Bound) -> DataFrame:
    return axis.lexical_order(b.genes()).withColumn("idx", F.col("idx").cast("long"))


@query(None, "SELECT c_nationkey AS nation, any_value(n_name) AS name, any_value(n_regionkey) AS region FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def constant_per_key(b: Bound) -> DataFrame:
    rows = b.table("customer").join(b.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("c_nationkey").alias("nation"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return aggregate.constant_per_key(rows, ["nation"], ["name", "region"], "a nation has two names or regions")


NAMES = """SELECT p_partkey AS gene, 'chr' || CASE WHEN b IN ('M', 'MT') THEN 'MT' ELSE b END AS chrom FROM
(SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'X' WHEN 1 THEN 'M' WHEN 2 THEN 'MT' WHEN 3 THEN regexp_extract(p_brand, '([0-9]+)', 1) ELSE CAST(p_size AS VARCHAR) END AS b FROM part)"""


@query(None, NAMES)
def chromosome_name(b: Bound) -> DataFrame:
    """Names with and without a leading chr, and both names of MT, become one."""
    key = F.col("p_partkey") % 7
    bare = F.when(key == 0, "X").when(key == 1, "M").when(key == 2, "MT").when(key == 3, F.regexp_extract("p_brand", "([0-9]+)", 1)).otherwise(F.col("p_size").cast("string"))
    written = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("chr"), bare)).otherwise(bare)
    return b.table("part").select(F.col("p_partkey").alias("gene"), C.chromosome_name(written).alias("chrom"))


@query(None, "SELECT p_partkey AS part, CASE WHEN p_partkey % 3 = 2 THEN 'X' || p_partkey || '.' || p_size ELSE 'ENSG' || p_partkey || CASE WHEN p_partkey % 3 = 1 THEN '_PAR_Y' ELSE '' END END AS gene FROM part")
def canonical_gene(b: Bound) -> DataFrame:
    """Ids lose their version, but not a PAR_Y suffix; ids of another kind stay."""
    key = F.col("p_partkey")
    written = F.when(key % 3 == 2, F.concat(F.lit("X"), key, F.lit("."), "p_size")).otherwise(F.concat(F.lit("ENSG"), key, F.lit("."), "p_size", F.when(key % 3 == 1, "_PAR_Y").otherwise("")))
    return b.table("part").select(key.alias("part"), C.canonical_gene(written).alias("gene"))


@query(None, "SELECT l_orderkey AS cell, l_linenumber AS line, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS ad, l_suppkey AS dp FROM lineitem")
def info_number(b: Bound) -> DataFrame:
    """Numbers out of k=v fields; 0 where the key isn't there."""
    q = F.col("l_quantity").cast("long")
    info = F.concat(F.lit("DP="), "l_suppkey", F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(";AD="), q)).otherwise(";OTH=3"))
    return b.table("lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_linenumber").alias("line"), C.info_number(info, "AD").alias("ad"), C.info_number(info, "DP").alias("dp"))


@query("alleles", ' SELECT round(ln(h / (1 - h)), 9) AS bias FROM (SELECT greatest(0.45, least(0.55, sum(h1) / CAST(sum(h1 + h2) AS DOUBLE))) AS h FROM alleles)')
def allele_bias(b: Bound) -> DataFrame:
    return aggregate.allele_bias(b.alleles()).select(r9("bias", "bias"))


PLACES = """, lengths AS (SELECT chrom, max(position) + 500 AS length FROM genes GROUP BY 1),
places AS (SELECT chrom, length, sum(length) OVER (ORDER BY CAST(chrom AS INTEGER), chrom) - length AS "offset" FROM lengths),
sites AS (SELECT g.chrom, g.position, avg(n) AS value FROM genes g LEFT JOIN (SELECT gene, sum(n) AS n FROM counts GROUP BY 1) s ON s.gene = g.gene GROUP BY 1, 2)
SELECT s.chrom, s.position, p."offset" + coalesce((lag(s.position) OVER w + s.position) / 2.0e0, 0) AS "left", p."offset" + coalesce((lead(s.position) OVER w + s.position) / 2.0e0, p.length) AS "right", round(value, 6) AS value
FROM sites s JOIN places p ON p.chrom = s.chrom WINDOW w AS (PARTITION BY s.chrom ORDER BY s.position)"""


@query("counts genes", PLACES)
def marker_intervals(b: Bound) -> DataFrame:
    """Every gene's interval side by side, with its summed counts."""
    genes = b.genes()
    values = genes.join(aggregate.gene_totals(b.counts()), "gene", "left").select("chrom", "position", F.col("n").cast("double").alias("value"))
    places = axis.layout(genes.groupBy("chrom").agg((F.max("position") + 500).alias("length")))
    out = axis.plot_intervals(values, places)
    return out.select("chrom", "position", "left", "right", r6("value", "value"))


@query(None, """WITH s AS (SELECT CAST(p_size AS VARCHAR) AS chrom, p_partkey * 1000 AS start, p_partkey * 1000 + 400 AS "end", p_retailprice AS value FROM part),
n AS (SELECT *, lead(start) OVER (PARTITION BY chrom ORDER BY start) AS later FROM s)
SELECT chrom, start, "end", round(value, 6) AS value FROM s UNION ALL SELECT chrom, "end", later, NULL FROM n WHERE later > "end" """)
def gap_rows(b: Bound) -> DataFrame:
    """Disjoint intervals with rows for the gaps between them; their value is unknown."""
    rows = b.table("part").select(F.col("p_size").cast("string").alias("chrom"), (F.col("p_partkey") * 1000).alias("start"), (F.col("p_partkey") * 1000 + 400).alias("end"), F.col("p_retailprice").cast("double").alias("value"))
    return axis.disjoint(rows).withColumn("value", F.when(~F.isnan("value"), F.round("value", 6)))


@query("states", """, p AS (SELECT event_id, value, CASE state WHEN 'click' THEN 0 WHEN 'view' THEN 5 WHEN 'purchase' THEN 3 ELSE 1 END AS own FROM states),
c AS (SELECT event_id, 0.01e0 + CASE WHEN own = 0 THEN 0.9e0 ELSE 0 END AS diploid, 0.04e0 + CASE WHEN own = 5 THEN 0.9e0 ELSE 0 END AS gain, 0.03e0 + CASE WHEN own = 1 THEN 0.9e0 ELSE 0 END AS loss, 0.02e0 + CASE WHEN own = 3 THEN 0.9e0 ELSE 0 END AS cnloh FROM p)
SELECT event_id, round(diploid, 6) AS diploid, round(gain, 6) AS gain, round(loss, 6) AS loss, round(cnloh, 6) AS cnloh, greatest(diploid, gain, loss, cnloh) >= 0.92e0 AS confident FROM c""")
def broad_classes(b: Bound) -> DataFrame:
    """Ten states' probabilities collapsed to four classes, and whether the best is sure."""
    own = F.when(F.col("state") == "click", 0).when(F.col("state") == "view", 5).when(F.col("state") == "purchase", 3).otherwise(1)
    ten = F.array(*(F.lit(0.01) + F.when(own == k, 0.9).otherwise(0.0) for k in range(10)))
    rows = b.states().select("event_id", C.broad_classes(ten).alias("p"))
    return rows.select("event_id", *(F.round(F.col("p")[k], 6).alias(n) for k, n in enumerate(aggregate.class_names())), C.confident("p", 0.92).alias("confident"))


@query("counts", " SELECT cell, CAST(count(*) AS BIGINT) AS genes, round(var_samp(n), 6) AS variance FROM counts GROUP BY 1")
def variance_ddof1(b: Bound) -> DataFrame:
    """Variances over a cell's genes; null where there is one."""
    return b.counts().groupBy("cell").agg(F.count("*").alias("genes"), F.round(F.when(F.count("*") > 1, F.var_samp("n")), 6).alias("variance"))


@query("counts cells libraries", """, best AS (SELECT l."group", c.gene, sum(n) AS log_bf FROM counts c JOIN libraries l ON l.cell = c.cell GROUP BY 1, 2)
SELECT "group", gene, CASE WHEN gene % 4 <> 0 AND log_bf / 100.0e0 < 5 THEN 'diploid' ELSE CASE WHEN gene % 4 = 0 THEN 'diploid' ELSE 'gain' END END AS state, CASE WHEN gene % 4 = 0 THEN 'diploid' ELSE 'gain' END AS raw_state FROM best""")
def segment_filter(b: Bound) -> DataFrame:
    """Altered states with too little evidence become neutral; the raw state stays."""
    best = aggregate.pseudobulk(b.counts(), b.libraries(), b.fractions()).filter("n > 0").select("group", "gene", (F.col("n") / 100).alias("log_bf"), F.when(F.col("gene") % 4 == 0, "diploid").otherwise("gain").alias("state"))
    return axis.filtered_segments(best).select("group", "gene", "state", "raw_state")


HELD = ISLANDS + """, e AS (SELECT member, marker, segment, new, -0.2e0 - value / 1000 AS e00, -0.5e0 - (event_id % 7) / 10.0e0 AS e01, -0.4e0 - (event_id % 3) / 5.0e0 AS e10, -0.3e0 - value / 500 AS e11, 0.05e0 + (event_id % 5) / 20.0e0 AS s FROM runs),
f AS (SELECT member, marker, segment, ln(0.5e0) + e00 AS a, ln(0.5e0) + e01 AS b, ln(0.5e0) + e10 AS c, ln(0.5e0) + e11 AS d FROM e WHERE marker = 0
UNION ALL SELECT o.member, o.marker, o.segment, o.e00 + CASE o.new WHEN 1 THEN ln(0.5e0) ELSE ln(exp(a - greatest(a, b)) * (1 - s) + exp(b - greatest(a, b)) * s) + greatest(a, b) END,
  o.e01 + CASE o.new WHEN 1 THEN ln(0.5e0) ELSE ln(exp(a - greatest(a, b)) * s + exp(b - greatest(a, b)) * (1 - s)) + greatest(a, b) END,
  o.e10 + CASE o.new WHEN 1 THEN ln(0.5e0) ELSE ln(exp(c - greatest(c, d)) * (1 - s) + exp(d - greatest(c, d)) * s) + greatest(c, d) END,
  o.e11 + CASE o.new WHEN 1 THEN ln(0.5e0) ELSE ln(exp(c - greatest(c, d)) * s + exp(d - greatest(c, d)) * (1 - s)) + greatest(c, d) END
  FROM f JOIN e o ON o.member = f.member AND o.marker = f.marker + 1),
ends AS (SELECT member, segment, min(marker) AS first, max(marker) AS last FROM e GROUP BY 1, 2)
SELECT f.member, f.segment, CAST(n.first AS INTEGER) AS first, CAST(n.last AS INTEGER) AS last, round(ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) + greatest(a, b), 6) AS first_state, round(ln(exp(c - greatest(c, d)) + exp(d - greatest(c, d))) + greatest(c, d), 6) AS second_state
FROM f JOIN ends n ON n.member = f.member AND n.segment = f.segment AND n.last = f.marker"""


@query("states", HELD)
def segment_evidence(b: Bound) -> DataFrame:
    """How likely each run of one state is under two states held throughout it, phases summed over."""
    runs = axis.segments(b.states(), ["member"], ["marker"], "state")
    number, value = F.col("event_id"), F.col("value")
    logs = F.array(-0.2 - value / 1000, -0.5 - (number % 7) / 10, -0.4 - (number % 3) / 5, -0.3 - value / 500)
    rows = runs.select("member", "marker", "segment", logs.alias("e"), (0.05 + (number % 5) / 20).alias("switch"))
    out = evidence.state_evidence(rows, ["member"], "marker", "segment", "e", "switch")
    held = [r6(F.col("evidence")[k], name) for k, name in enumerate(("first_state", "second_state"))]
    return out.select("member", F.col("run").alias("segment"), "first", "last", *held)


def _haplotypes(b: Bound) -> DataFrame:
    cells = b.cells()
    own = cells.select("cell", F.col("cell").alias("group"))
    by_cell = regions.haplotype_bins(b.alleles(), b.loci(), own).withColumnRenamed("group", "cell")
    return resample.haplotype_profiles(regions.haplotype_bins(b.alleles(), b.loci(), cells), by_cell, cells, seed=1)


@query()
def haplotype_profiles(b: Bound) -> DataFrame:
    """Haplotype windows of the data and of 64 draws of cells and shares."""
    return _haplotypes(b)


@query("cells alleles loci", """, own AS (SELECT "group", cell, row_number() OVER (PARTITION BY "group" ORDER BY cell) - 1 AS place, count(*) OVER (PARTITION BY "group") AS n FROM cells),
taken AS (SELECT draw, "group", CAST(floor(CAST('0x' || substr(md5(draw || ':1:' || "group" || ':' || place), 1, 12) AS BIGINT) / 281474976710656.0e0 * n) AS BIGINT) AS place, count(*) AS mult
  FROM own, (SELECT unnest(range(0, 64)) AS draw) k GROUP BY ALL),
draws AS (SELECT -1 AS draw, "group", cell, 1 AS mult FROM cells UNION ALL SELECT t.draw, t."group", o.cell, t.mult FROM taken t JOIN own o ON o."group" = t."group" AND o.place = t.place),
bins AS (SELECT x.cell, chrom, (position - 1) // 2000000 AS bin, sum((h1 + h2) * het) AS n FROM alleles x JOIN loci l ON x.locus = l.locus GROUP BY 1, 2, 3),
weighed AS (SELECT draw, "group", chrom, bin, sum(n * mult) AS n FROM bins b JOIN draws d ON b.cell = d.cell GROUP BY 1, 2, 3, 4),
grid AS (SELECT d.draw, d."group", r.chrom, r.bin FROM (SELECT DISTINCT draw FROM draws) d0 JOIN (SELECT DISTINCT draw, "group" FROM draws) d ON d.draw = d0.draw, (SELECT DISTINCT chrom, bin FROM bins b JOIN cells c ON b.cell = c.cell) r)
SELECT CAST(g.draw AS INTEGER) AS draw, g."group", g.chrom, g.bin, round(CAST(coalesce(sum(w.n), 0) AS DOUBLE), 6) AS coverage
FROM grid g LEFT JOIN weighed w ON w.draw = g.draw AND w."group" = g."group" AND w.chrom = g.chrom AND abs(w.bin - g.bin) <= 2 GROUP BY g.draw, g."group", g.chrom, g.bin""")
def haplotype_coverage(b: Bound) -> DataFrame:
    """Counts in the windows of the data and of every draw of cells."""
    return _haplotypes(b).select("draw", "group", "chrom", "bin", r6("coverage", "coverage"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: the permutation test of the chi-square score."""
    return QUERIES["permutation_signal"](spark, sf_dir)

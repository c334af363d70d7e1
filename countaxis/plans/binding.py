"""How the domain's tables are bound to the star-schema tables: orders are cells, the customers' nations their barcodes, parts
genes on the chromosome of their brand, suppliers loci, quantities counts, line statuses haplotypes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Bound:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def counts(self) -> DataFrame:
        """gene, cell, n."""
        return self.count_rows().groupBy("gene", "cell").agg(F.sum("n").cast("long").alias("n"))

    def tasks(self) -> int:
        """A number of tasks that grows with the lines' files."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 4 * self.table("lineitem").rdd.getNumPartitions())

    def count_rows(self) -> DataFrame:
        """gene, cell, n, a row for each line: for sums, which need no row for each gene and cell."""
        return self.table("lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_orderkey").alias("cell"), F.col("l_quantity").cast("long").alias("n"))

    def allele_rows(self) -> DataFrame:
        """locus, cell, h1, h2, a row for each line."""
        side = lambda s: F.when(F.col("l_linestatus") == s, F.col("l_quantity").cast("long")).otherwise(0)
        return self.table("lineitem").select(F.col("l_suppkey").alias("locus"), F.col("l_orderkey").alias("cell"), side("F").alias("h1"), side("O").alias("h2"))

    def cells(self) -> DataFrame:
        """cell, group."""
        customers = self.table("customer").select("c_custkey", F.col("c_nationkey").alias("group"))
        return self.table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("cell"), "group")

    def libraries(self) -> DataFrame:
        """cell, group, library of cells with counts."""
        sums = self.table("lineitem").groupBy(F.col("l_orderkey").alias("cell")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("library"))
        return self.cells().join(sums, "cell")

    def genes(self) -> DataFrame:
        """gene, chrom, position."""
        return self.table("part").select(F.col("p_partkey").alias("gene"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("chrom"), (F.col("p_partkey") * 1000 + 1).alias("position"))

    def fractions(self) -> DataFrame:
        """gene, fraction: parts' shares of all quantity; parts never sold have 0."""
        sums = self.count_rows().groupBy("gene").agg(F.sum("n").alias("n"))
        total = sums.agg(F.sum("n").alias("total"))
        return self.genes().select("gene").join(sums, "gene", "left").crossJoin(F.broadcast(total)).select("gene", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("fraction"))

    def loci(self) -> DataFrame:
        """locus, chrom, position, population_phase, phase, het, genetic_cm."""
        key = F.col("s_suppkey")
        phase = F.when(key % 3 == 0, 0.2).otherwise(0.9)
        return self.table("supplier").select(
            key.alias("locus"), (F.col("s_nationkey") + 1).cast("string").alias("chrom"), (key * 40_000 + 1).alias("position"),
            phase.alias("population_phase"), phase.alias("phase"), (1 - (key % 5) / 10).alias("het"), (key / 100).alias("genetic_cm"),
        )

    def alleles(self) -> DataFrame:
        """locus, cell, h1, h2."""
        side = lambda s: F.sum(F.when(F.col("l_linestatus") == s, F.col("l_quantity").cast("long")).otherwise(0)).cast("long")
        return self.table("lineitem").groupBy(F.col("l_suppkey").alias("locus"), F.col("l_orderkey").alias("cell")).agg(side("F").alias("h1"), side("O").alias("h2"))

    def states(self) -> DataFrame:
        """member, marker, state: each user's events in order, states by type."""
        from pyspark.sql import Window as W

        events = self.table("events")
        marker = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
        return events.select(F.col("user_id").alias("member"), marker.alias("marker"), F.col("event_type").alias("state"), F.col("value"), F.col("event_id"))


#: The same tables in SQL, as common table expressions.
CTES = {
    "counts": "SELECT l_partkey AS gene, l_orderkey AS cell, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2",
    "cells": 'SELECT o_orderkey AS cell, c_nationkey AS "group" FROM orders JOIN customer ON o_custkey = c_custkey',
    "libraries": 'SELECT c.cell, c."group", l.library FROM cells c JOIN (SELECT l_orderkey AS cell, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS library FROM lineitem GROUP BY 1) l ON c.cell = l.cell',
    "genes": "SELECT p_partkey AS gene, regexp_extract(p_brand, '([0-9]+)', 1) AS chrom, p_partkey * 1000 + 1 AS position FROM part",
    "fractions": "SELECT g.gene, coalesce(s.n, 0) / (SELECT CAST(sum(n) AS DOUBLE) FROM counts) AS fraction FROM genes g LEFT JOIN (SELECT gene, CAST(sum(n) AS DOUBLE) AS n FROM counts GROUP BY 1) s ON g.gene = s.gene",
    "loci": "SELECT s_suppkey AS locus, CAST(s_nationkey + 1 AS VARCHAR) AS chrom, s_suppkey * 40000 + 1 AS position, CASE WHEN s_suppkey % 3 = 0 THEN 0.2e0 ELSE 0.9e0 END AS phase, 1 - (s_suppkey % 5) / 10.0e0 AS het, s_suppkey / 100.0e0 AS genetic_cm FROM supplier",
    "alleles": "SELECT l_suppkey AS locus, l_orderkey AS cell, CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS h1, CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS h2 FROM lineitem GROUP BY 1, 2",
    "states": "SELECT user_id AS member, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS marker, event_type AS state, value, event_id FROM events",
}


def with_ctes(names: str, body: str) -> str:
    parts = [f"{n} AS ({CTES[n]})" for n in names.split()]
    return f"WITH RECURSIVE {', '.join(parts)}{body if body.lstrip().startswith(',') else ' ' + body}" if parts else body

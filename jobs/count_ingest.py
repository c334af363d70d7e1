"""Keep pooled counts of a growing corpus up to date: documents are cells, their words genes, a column of theirs the group.

Each run takes only the files that have come since the last one (a file stream with a checkpoint, until nothing is left) and
adds their libraries and their sums by group and word as a partition of its own for each batch; a batch that is written again after
a failure replaces itself. Then the profiles of all groups are made anew from the sums, not from the texts:
a word's count in a group beside what the group's exposure and the word's share of all counts let expect.

    python -m jobs.count_ingest --documents IN --out OUT --checkpoint MARK [--config FILE]

OUT/cells (by batch, group): cell, library, genes. OUT/sums (by batch, group): gene, n, cells. OUT/profiles (by group): gene, n, cells,
exposure, expected, score. OUT/dispersion: sigma, alpha, used. A document without words has a library of 0; one without a group belongs to "unknown". A document that
comes twice counts twice.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countaxis.operators import aggregate
from countaxis.streaming.counts import word_counts
from jobs.settings import settings

LOG = logging.getLogger("count_ingest")
PROFILES = "gene string, n long, cells long, exposure long, expected double, score double, group string"
CELLS = "cell long, library long, genes long, batch long, group string"
SUMS = "gene string, n long, cells long, batch long, group string"
TABLES = {"cells": CELLS, "sums": SUMS, "profiles": PROFILES, "dispersion": "sigma double, alpha double, used long"}


def add_batch(batch: DataFrame, number: int, out: str, group: str) -> None:
    """Libraries and sums of one batch, in place of what an earlier try of the same batch has written."""
    _empty(batch.sparkSession, out, "dispersion", "overwrite")  # profiles are out of date until it has its row again
    held = F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("unknown"))
    docs = batch.select(F.col("doc_id").cast("long").alias("cell"), held.alias("group"), F.col("text").cast("string").alias("text"))
    # Texts of a file may be one task's to read; words are split by as many as there are.
    tasks = max(3 * batch.sparkSession.sparkContext.defaultParallelism, batch.rdd.getNumPartitions())
    made = word_counts(docs.repartition(tasks, F.xxhash64("cell", "text"))).withColumn("batch", F.lit(number).cast("long")).persist()
    try:
        _replace(made.filter("library is not null").select("cell", "library", "genes", "batch", "group"), f"{out}/cells", ["batch", "group"])
        sums = made.filter("gene is not null").groupBy("gene", "batch", "group").agg(F.sum("n").alias("n"), F.sum("cells").alias("cells"))
        _replace(sums.select("gene", "n", "cells", "batch", "group"), f"{out}/sums", ["batch", "group"])
    finally:
        made.unpersist()


def _empty(spark: SparkSession, out: str, name: str, mode: str, *keys: str) -> None:
    """A table without rows, or (append) only the folder where there is none."""
    spark.createDataFrame([], TABLES[name]).write.mode(mode).partitionBy(*keys).parquet(f"{out}/{name}")


def _replace(frame: DataFrame, path: str, keys: list[str]) -> None:
    """Write ``frame`` in place of the partitions that it has rows of; other partitions stay."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def profiles(spark: SparkSession, out: str) -> DataFrame:
    """gene, n, cells, exposure, expected, score (log2 of count over expectation, half a count added to both), group; from all batches."""
    sums = read(spark, out, "sums").groupBy("group", "gene").agg(F.sum("n").alias("n"), F.sum("cells").alias("cells"))
    exposure = read(spark, out, "cells").groupBy("group").agg(F.sum("library").alias("exposure"))
    share = aggregate.gene_totals(sums).withColumnRenamed("n", "all_n")
    total = exposure.agg(F.sum("exposure").alias("total"))
    rows = sums.join(exposure, "group").join(share, "gene").crossJoin(F.broadcast(total))  # one row
    rows = rows.withColumn("expected", F.col("exposure") * F.col("all_n") / F.col("total"))
    return rows.select("gene", "n", "cells", "exposure", "expected", F.log2((F.col("n") + 0.5) / (F.col("expected") + 0.5)).alias("score"), "group")


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, group: str = "lang", files_per_batch: int = 16) -> dict[str, int]:
    """Take the files under ``documents`` (a folder, or a pattern of Spark's) that ``checkpoint`` doesn't have yet, and renew ``out``.

    The mark is the stream's checkpoint alone: a run that breaks off is made good by the next, with the same result. Without new
    files nothing is added and the profiles stay as they are. Returns how many documents were taken, in how many batches.
    """
    for name in ("cells", "sums"):  # tables without rows, where nothing has come yet
        _empty(spark, out, name, "append", "batch", "group")
    _empty(spark, out, "dispersion", "append")
    schema = ", ".join(dict.fromkeys(["doc_id long", "text string", f"`{group}` string"]))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(documents)
    query = stream.writeStream.foreachBatch(lambda batch, number: add_batch(batch, number, out, group)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    made = [p.batchId for p in query.recentProgress if p.numInputRows]
    taken = read(spark, out, "cells").filter(F.col("batch").isin(made)).groupBy("batch").count().collect()  # a row a batch
    for batch in sorted(taken):
        LOG.info("batch %s: read %s documents of %s", batch["batch"], batch["count"], documents)
    done = {"documents": sum(x["count"] for x in taken), "batches": len(taken)}
    LOG.info("read %s documents in %s batches", done["documents"], done["batches"])
    # The dispersion is emptied before a batch and written last, so its row says that the profiles are those of all batches.
    if not made and read(spark, out, "dispersion").head():
        LOG.info("nothing new: profiles in %s stay as they are", out)
        return done
    frame = profiles(spark, out)
    # Dealt by ranges, so that a group of a third of all words is written by several tasks.
    frame.repartitionByRange("group", "gene").write.mode("overwrite").partitionBy("group").parquet(f"{out}/profiles")
    written = read(spark, out, "profiles")
    # How far counts stray from what is expected, over all groups and words: where a model of these counts starts.
    aggregate.dispersion_of_many(written).write.mode("overwrite").parquet(f"{out}/dispersion")
    LOG.info("wrote %s profile rows of %s groups to %s", written.count(), written.select("group").distinct().count(), out)
    return done


def read(spark: SparkSession, out: str, name: str) -> DataFrame:
    """One of the tables: cells, sums, profiles, dispersion."""
    return spark.read.schema(TABLES[name]).parquet(f"{out}/{name}")


def main(argv: list[str] | None = None) -> None:
    chosen = settings(__doc__, "count_ingest.json", ["documents", "out", "checkpoint"], argv)
    spark = SparkSession.builder.appName("count_ingest").getOrCreate()
    try:
        run(spark, **chosen)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

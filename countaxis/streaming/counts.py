"""Incremental ingestion of counts: an extension beside the batch tables; event time isn't part of the model."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of UTF-8 between words become blanks, A-Z lower case; those of letters and digits beyond ASCII stay.
BYTES = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else 32 for b in range(256))
#: Different words whose sums a task holds before it puts them out.
HELD = 1 << 18
#: A document's row: cell, library, genes; or a row of sums: gene, n, cells, of some of the group's documents.
COUNTED = "group string, cell long, library long, genes long, gene string, n long, cells long"


def word_counts(texts: DataFrame) -> DataFrame:
    """COUNTED of texts (cell, group, text), read once: words are runs of letters and digits. Rows of sums are to be added up."""
    rows = texts.select(F.col("cell").cast("long"), F.col("group").cast("string"), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(_counted, COUNTED)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str | None, tuple[Counter, Counter]] = {}
    held = 0
    for batch in batches:
        cell, group, text = batch.columns
        libraries, genes = [], []
        for name, data in zip(group.to_pylist(), text.to_pylist(), strict=True):
            words = data.translate(BYTES).split() if data else []
            n, cells = sums.get(name) or sums.setdefault(name, (Counter(), Counter()))
            own, before = set(words), len(n)
            n.update(words)
            cells.update(own)
            libraries.append(len(words))
            genes.append(len(own))
            held += len(n) - before
            if held > HELD:
                yield from _summed(sums)
                sums.clear()
                held = 0
        none = pa.nulls(len(cell))
        yield pa.RecordBatch.from_arrays([group, cell, pa.array(libraries, pa.int64()), pa.array(genes, pa.int64()), none.cast(pa.string()), none.cast(pa.int64()), none.cast(pa.int64())], ["group", "cell", "library", "genes", "gene", "n", "cells"])
    yield from _summed(sums)


def _summed(sums: dict[str | None, tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for name, (n, cells) in sums.items():
        words, size = list(n), 10_000
        for low in range(0, len(words), size):
            some = words[low : low + size]
            none = pa.nulls(len(some), pa.int64())
            gene = pa.array(some, pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), none, none, none, gene, pa.array([n[w] for w in some], pa.int64()), pa.array([cells[w] for w in some], pa.int64())], ["group", "cell", "library", "genes", "gene", "n", "cells"])


def running_counts(stream: DataFrame) -> DataFrame:
    """gene, cell, n of a stream of gene, cell, n rows, for output modes update and complete."""
    return stream.groupBy("gene", "cell").agg(F.sum("n").cast("long").alias("n"))


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """Write each micro-batch, summed by gene and cell, as Parquet under its number, so that a batch written twice after a
    failure replaces itself; counts are the sums over all batches."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("gene", "cell").agg(F.sum("n").cast("long").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()

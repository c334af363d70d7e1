"""The corpus pipeline: toxic documents go, one document of each group of near duplicates stays, repeated passages are cut,
documents with benchmark passages go, and the rest is packed into sequences.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and returns a DataFrame; all but the last return
the columns of documents. Rows that a stage rejects go, with everything in them; all others go on whole. Each stage's
result is written as Parquet and read again before the next, so lost executors never make an earlier stage run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from countaxis.llm import decontaminate, jaccard_join, packing, suffix_dedup, toxicity
from countaxis.llm.queries import op9_columns, tokenizer_path
from countaxis.llm.shared import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3; the lexicon is learnt from the labels that aren't held out."""
    lexicon = toxicity.learn(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return toxicity.kept(docs, lexicon)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group linked by five-word shingles at a similarity of 0.75."""
    return jaccard_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 100-byte strings that also start earlier; rows stay even if no text is left."""
    return suffix_dedup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths, in the columns of op9."""
    return op9_columns(packing.pack(docs, tokenizer_path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: SQL can't express the stages (a learnt lexicon, a tokenizer); they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

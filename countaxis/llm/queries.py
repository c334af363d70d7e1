"""The queries of this subpackage, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countaxis.llm import alignment, class_lm, decontaminate, jaccard_join, kn_quality, neighbours, packing, sql, suffix_dedup, token_counts, topk, toxicity, url_filter
from countaxis.llm.shared import held_out, stored, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted", "n_hits")


def op2_kn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = toxicity.training_labels(table(spark, sf_dir, "labels"))
    return kn_quality.judge_quality(table(spark, sf_dir, "documents"), labels).withColumn("held_out", held_out("doc_id", 4, 2))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return kept.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.size("_spans").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.col("longest").alias("longest_match"),
    )


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_texts(table(spark, sf_dir, "documents"), held_out("doc_id", 7, 2))


#: The rules that op8 is given.
URL_RULES = [url_filter.Rule(*x.split()) for x in ("allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_columns(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op9_columns(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = stored(aligned.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    counted = alignment.with_pair_counts(aligned)
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_kn_quality": op2_kn_quality,
    "op3_neighbours": op3_neighbours,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_class_lm": op7_class_lm,
    "op8_url_filter": op8_url_filter,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
    "op11_alignment": op11_alignment,
    "op12_topk": op12_topk,
}
ORACLE_SQL: dict[str, str] = {"op3_neighbours": sql.OP3_SQL, "op4_jaccard_join": sql.OP4_SQL, "op5_suffix_dedup": sql.OP5_SQL, "op6_decontaminate": sql.OP6_SQL, "op12_topk": sql.OP12_SQL}

"""Token counts through a digest cache.

The content digest is SHA-256 of the text's UTF-8 bytes with null as the empty text (the one normalisation that can't
change a count); the tokenizer's version digest is SHA-256 of its file. Both together key the stored counts.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countaxis.llm.shared import HOT_KEYS, HOT_ROWS, as_text, removed, scratch, skew_join, stored

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
#: Bytes of text given to the tokenizer at once.
ENCODE_BYTES = 1 << 20
_loaded: dict[str, object] = {}


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def encoder(path: str):
    """A function from texts to token counts with the library that the file's suffix names; loaded once a worker."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _loaded[path] = lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
    return _loaded[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = encoder(path), set()
        for batch in batches:
            digests, texts, some, size = batch.column(0).to_pylist(), batch.column(1), [], 0
            out_digests: list[bytes] = []
            out_counts: list[int] = []
            for i, digest in enumerate(digests):
                if digest not in seen:
                    seen.add(digest)
                    some.append(texts[i].as_py())
                    out_digests.append(digest)
                    size += len(some[-1])
                if some and (size >= ENCODE_BYTES or i == len(digests) - 1):
                    out_counts += count(some)
                    some, size = [], 0
            if some:
                out_counts += count(some)
            yield pa.RecordBatch.from_arrays([pa.array(out_digests, pa.binary()), pa.array(out_counts, pa.int64())], ["content_digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of ``docs`` (doc_id, text; others ignored).

    Counts already stored under ``cache_path`` for this tokenizer's digest are joined; of the rest each distinct content
    is encoded once, in the row of the smallest doc_id that has it, and appended to the cache before it is read again.
    Without a path a fresh cache in the shared folder is used. Null and empty texts count 0 bytes and 0 tokens; a null
    doc_id stays null; repeated rows give repeated results; an empty table gives an empty result. Texts are whole: the
    tokenizer neither truncates nor pads, adds no special tokens and treats special strings as its default does. Other
    columns don't matter, whatever their names. Rows of a content with very many copies aren't gathered in one task.
    """
    spark = docs.sparkSession
    fresh = cache_path is None
    cache_path = cache_path or scratch(spark, "token-cache")
    version = tokenizer_digest(tokenizer_path)
    keyed = docs.select("doc_id", as_text().alias("text")).select(
        "doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("content_digest")
    )

    def cached() -> DataFrame:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer_digest") == version)
        return rows.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))  # two writers may have stored the same

    if fresh:
        spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # The smallest doc_id stands for its content: small rows, summed before the shuffle, however many copies there are.
    first = stored(keyed.groupBy("content_digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "token-digests")
    rows = first.agg(F.sum("copies")).head()[0] or 0
    hot = first.filter(F.col("copies") > max(HOT_ROWS, rows // HOT_KEYS)).select("content_digest")
    misses = first if fresh else first.join(cached(), "content_digest", "left_anti")
    misses = misses.select(F.col("content_digest").alias("_digest"), F.col("first_id").alias("_id"))
    todo = keyed.join(misses, (keyed.content_digest == misses._digest) & keyed.doc_id.eqNullSafe(misses._id), "left_semi")
    counted = todo.select("content_digest", "text").mapInArrow(_encode(tokenizer_path), "content_digest binary, n_tokens long")
    counted = counted.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))  # rows that repeat id and text: one entry
    counted.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache_path)
    counts = skew_join(keyed.drop("text"), cached(), ["content_digest"], rows, hot=hot)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def drop_cache(spark, cache_path: str) -> None:
    removed(spark, cache_path)

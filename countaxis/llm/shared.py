"""Helpers that the operators of this subpackage share: tables, the shared folder, and byte-level text arrays."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import hashlib
import secrets
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy kernel handles at once in a Python worker; bounds its memory, not what is processed.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh local one where it is unset and Spark is
    local (tests); a cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="countaxis-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


_folders: dict[tuple[str, str], str] = {}


def scratch(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses. All paths of an application lie in one folder of it, which goes when
    the application ends; results that are still to be computed may read them until then."""
    key = shared_dir(spark), spark.sparkContext.applicationId
    if key not in _folders:
        _folders[key] = f"{key[0]}/countaxis-{uuid.uuid4().hex}"
        at, system = _on_store(spark, _folders[key])
        system.mkdirs(at)
        system.deleteOnExit(at)
    return f"{_folders[key]}/{what}-{uuid.uuid4().hex}"


def _on_store(spark: SparkSession, path: str):
    """A path and its file system as Spark's own objects, so it works on any store."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so lost executors never make it run again.

    What its shuffles left on the executors' disks is of no use then. Spark removes it once the driver has collected the
    objects of the finished plan, which is asked for here, for a driver with little garbage may not do so for long.
    """
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    freed(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def freed(spark: SparkSession) -> None:
    """Have the driver collect finished plans, so that Spark removes their shuffles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(*frames: DataFrame) -> None:
    """Delete what stored() wrote for ``frames``, once all that reads it is stored itself."""
    for frame in frames:
        path = getattr(frame, "_stored_path", None)
        if path:
            removed(frame.sparkSession, path)


#: Rows of keys (ids and hashes, some dozen bytes each) that may be broadcast; their number is counted first.
BROADCAST_ROWS = 1_000_000


def small(frame: DataFrame) -> DataFrame:
    """A stored table of keys, marked for broadcast if it is counted to be small; else it is joined by a shuffle."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


#: Rows of one key that make it hot, and how many hot keys there may be at most: a key is hot from the greater of HOT_ROWS and
#: rows / HOT_KEYS rows on, so that hot keys can be broadcast at any size.
HOT_ROWS, HOT_KEYS = 1000, 100_000


def hot_keys(left: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The keys that very many of the ``rows`` rows of ``left`` share, HOT_KEYS at most; summed before they are shuffled."""
    return stored(left.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > max(HOT_ROWS, rows // HOT_KEYS)).select(*keys), "hot-keys")


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], rows: int, right_rows: int | None = None, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``left`` (at most ``rows`` rows) joined with ``right``, in which each key is once; keys aren't null. A right side that is
    known to be small (``right_rows``) is broadcast. Else rows of hot keys stay where they are and meet the few rows of right
    by broadcast; the others meet by a shuffle."""
    if right_rows is not None and right_rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    hot = hot_keys(left, keys, rows) if hot is None else hot
    few = F.broadcast(hot)
    apart = left.join(few, keys, "left_semi").join(F.broadcast(right.join(few, keys, "left_semi")), keys, how)
    return apart.unionByName(left.join(few, keys, "left_anti").join(right, keys, how))


def removed(spark: SparkSession, path: str) -> None:
    """Delete a scratch path."""
    at, system = _on_store(spark, path)
    system.delete(at, True)


def released() -> None:
    """Hand memory that is free back to the system: Python workers outlive their tasks, and what one kernel needed at its
    peak would stay with them beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A group's function that hands its memory back when it is done."""

    def tidied(table: pa.Table) -> pa.Table:
        out = run(table)
        released()
        return out

    return tidied


def as_text(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def free_names(names: list[str], taken: list[str]) -> list[str]:
    """``names``, with underscores behind those that ``taken`` columns have, whatever their case."""
    have = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def remainder(column: str, n: int) -> Column:
    """crc32 of an id written as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def held_out(column: str, n: int, value: int) -> Column:
    """True where the id's remainder is ``value``; a null id is never held out."""
    return F.coalesce(remainder(column, n) == value, F.lit(False))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and the offsets of its rows in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about ``most`` bytes of text (a longer text comes alone): batch, bytes, offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
            yield batch.slice(row, last - row), data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
            row = last
        del data, offsets
        released()


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes inside each row, and the row of each run."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = is_word[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (an invertible map)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Spans of more bytes are hashed one by one; and spans hashed side by side.
LONG_SPAN, SPANS = 512, 1 << 16
#: The key of hashes that are compared within one process only.
PROCESS_KEY = secrets.randbits(63)


def new_key() -> int:
    """A key for hashes that several tasks compare; the driver draws it for each run and sends it with the tasks."""
    return secrets.randbits(63)


@functools.lru_cache(8)
def hash_weights(key: int, seed: int) -> np.ndarray:
    """Odd 64-bit weights of a span's 32-bit parts, and of its size, that nobody can tell without the key."""
    drawn = np.random.Generator(np.random.Philox(key=[key, seed])).integers(0, 1 << 64, LONG_SPAN // 4 + 3, np.uint64)
    return drawn | np.uint64(1)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, key: int | None = None) -> np.ndarray:
    """64-bit hashes of spans' bytes that depend on nothing else but ``seed`` (two seeds give 128 bits) and ``key`` (by default the
    process's own, so hashes that tasks compare need one).

    A span is a row of 32-bit parts, and its hash their sum weighed by secret numbers (multilinear hashing), spans side by side. Any two
    spans that are chosen without knowing the key agree with a chance of 2 to the -31 at most, and of about 2 to the -64 unless they
    differ in the high bits of few parts only; whatever the key, no span is alike to another by construction.
    """
    starts, size = np.asarray(starts, np.int64), np.asarray(ends, np.int64) - np.asarray(starts, np.int64)
    key = PROCESS_KEY if key is None else key
    weights = hash_weights(key, seed)
    out = size.astype(np.uint64) * weights[-1] + weights[-2]
    if not len(starts):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    for low in range(0, len(starts), SPANS):
        part = slice(low, low + SPANS)
        _weigh(eight, starts[part], size[part], weights, out[part])
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        found = hashlib.blake2b(data[starts[i] : starts[i] + size[i]].tobytes(), digest_size=8, key=key.to_bytes(8, "little"), salt=seed.to_bytes(8, "little"))
        out[i] = int.from_bytes(found.digest(), "little")
    return mixed(out)


def _weigh(eight: np.ndarray, starts: np.ndarray, size: np.ndarray, weights: np.ndarray, out: np.ndarray) -> None:
    """Add the weighed parts of spans that aren't long to ``out``. ``eight``: the eight bytes from each place on, as numbers."""
    at = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    h, place, left, part = out[at], starts[at], size[at], 0
    while len(at):
        block = eight[place]
        short = np.flatnonzero(left < 8)
        if len(short):
            block[short] &= (np.uint64(1) << (left[short].astype(np.uint64) << np.uint64(3))) - np.uint64(1)
        block *= np.uint64(0x9E3779B97F4A7C15)  # a map of blocks to blocks, after which letters differ in more than a few bits
        high = block >> np.uint64(32)
        block &= np.uint64(0xFFFFFFFF)
        block *= weights[part]
        high *= weights[part + 1]
        h += block
        h += high
        more = left > 8
        if not more.all():
            done = ~more
            out[at[done]] = h[done]
            at, h, place, left = at[more], h[more], place[more], left[more]
        place, left, part = place + 8, left - 8, part + 2


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of the 256 bytes that is True inside the ranges (both ends count)."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Bytes with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes: all but white space 20 and 09-0D; and all but ASCII that is no digit or lower-case letter.
NOT_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the spans, one span after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return at + np.arange(total)


def mark(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A mask of n places that is True inside any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0

"""Benchmark decontamination: word suffix arrays of the training texts, searched for every benchmark suffix.

Each shard (some MB of documents) gets a suffix array over its words, with the common prefixes of neighbours. Every suffix of
every benchmark item is placed in it by binary search; what it has in common with its neighbours there is its longest
verbatim match in the shard, and the suffixes around that share its window are the window's occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countaxis.llm.shared import ALNUM, LOWER, as_text, chunks, mark, new_key, ragged, span_hash, word_spans

#: Bytes of benchmark text broadcast at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 8 << 20
#: Bytes of documents in a shard, and (suffix, occurrence) pairs handled at once.
SHARD_BYTES, PAIRS = 4 << 20, 1 << 20
HITS = "doc_id long, n_words long, spans array<struct<start:long,length:long>>, items array<string>, longest long, longest_item string"
MATCHES = "item string, start long, length long, doc_id long, doc_start long"


class Tests:
    """A block of the benchmark as flat arrays: its distinct words (two hashes each, sorted), and the items' words as numbers
    from 1, with a 0 after each item. Twelve bytes a word and sixteen a distinct word."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.items = [i for i, _ in rows]
        self.key = new_key()
        texts = [(t or "").encode() for _, t in rows]
        data = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        starts, ends, item = word_spans(data, offsets, ALNUM)
        self.vocabulary, first, numbers = np.unique(span_hash(data, starts, ends, 0, self.key), return_index=True, return_inverse=True)
        self.check = span_hash(data, starts[first], ends[first], 1, self.key)
        self.words = np.zeros(len(starts) + len(rows), np.int32)
        at = np.arange(len(starts)) + item
        self.words[at] = numbers + 1
        counts = np.bincount(item, minlength=len(rows)) if len(rows) else np.zeros(0, np.int64)
        self.first = np.cumsum(counts + 1) - counts - 1
        self.at, self.item = at.astype(np.int32), item.astype(np.int32)
        self.room = (self.first + counts)[item] - at if len(at) else at

    @property
    def bits(self) -> int:
        return max(1, len(self.vocabulary).bit_length())


@dataclass
class Shard:
    """Documents' words as numbers of the block's words (0: a word that no item has, or a document's end)."""

    words: np.ndarray
    doc: np.ndarray
    n_words: np.ndarray
    first: np.ndarray


def shard_of(tests: Tests, data: np.ndarray, offsets: np.ndarray) -> Shard:
    data = LOWER[data]
    starts, ends, doc = word_spans(data, offsets, ALNUM)
    rows = len(offsets) - 1
    n_words = np.bincount(doc, minlength=rows) if len(starts) else np.zeros(rows, np.int64)
    first = np.cumsum(n_words + 1) - n_words - 1
    words = np.zeros(len(starts) + rows, np.int64)
    if len(starts) and len(tests.vocabulary):
        hashes = span_hash(data, starts, ends, 0, tests.key)
        at = np.minimum(np.searchsorted(tests.vocabulary, hashes), len(tests.vocabulary) - 1)
        known = np.flatnonzero(tests.vocabulary[at] == hashes)
        known = known[span_hash(data, starts[known], ends[known], 1, tests.key) == tests.check[at[known]]]
        words[known + doc[known]] = at[known] + 1
    return Shard(words, np.repeat(np.arange(rows), n_words + 1), n_words, first)


def keys_at(words: np.ndarray, at: np.ndarray, per: int, bits: int) -> np.ndarray:
    """The next ``per`` words from each place as a number that sorts as they do; what follows a 0 counts as 0."""
    key, alive, last = np.zeros(len(at), np.int64), np.ones(len(at), bool), len(words) - 1
    for j in range(per):
        word = np.where(alive & (at + j <= last), words[np.minimum(at + j, last)], 0)
        alive &= word > 0
        key = (key << bits) | word
    return key


def suffix_array(words: np.ndarray, per: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all words but 0 in the order of what follows them up to the next 0, and the keys of all places. Places told
    apart by their first ``per`` words need no more; the order of the others is doubled in depth each round."""
    keys = keys_at(words, np.arange(len(words)), per, bits)
    places = np.flatnonzero(words > 0)
    array = places[np.argsort(keys[places], kind="stable")]
    rank = np.zeros(len(words) + 1, np.int64)
    if not len(array):
        return array, keys
    key = keys[array]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    rank[array] = np.maximum.accumulate(np.where(head, np.arange(len(array)), 0)) + 1
    tied = ~head | np.append(~head[1:], False)
    open_ = np.flatnonzero(tied & ((key & ((1 << bits) - 1)) > 0))
    depth = per
    while len(open_):
        place = array[open_]
        group, after = rank[place], rank[np.minimum(place + depth, len(words))]
        order = np.lexsort((after, group))
        place, group, after = place[order], group[order], after[order]
        array[open_] = place
        head = np.concatenate(([True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])))
        rank[place] = open_[np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))] + 1
        open_ = open_[(~head | np.append(~head[1:], False)) & (after > 0)]
        depth *= 2
    return array, keys


def common(words: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """Words that places ``a`` of one array and ``b`` of another have in common from there on, up to ``most``."""
    out, left, j = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    while len(left) and (most is None or j < most):
        x, y = a[left] + j, b[left] + j
        fine = (x < len(words)) & (y < len(others))
        left, x, y = left[fine], x[fine], y[fine]
        word = words[x]
        left = left[(word > 0) & (word == others[y])]
        out[left] += 1
        j += 1
    return out


def bounds(keys: np.ndarray, array: np.ndarray, low: np.ndarray, high: np.ndarray, shift: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each test the part of its stretch of the array in which the key ``shift`` words on equals the test's."""
    ends = []
    for right in (False, True):
        a, b = low.copy(), high.copy()
        while (open_ := np.flatnonzero(a < b)).size:
            middle = (a[open_] + b[open_]) // 2
            there = array[middle] + shift
            found = np.where(there < len(keys), keys[np.minimum(there, len(keys) - 1)], 0)
            up = found <= key[open_] if right else found < key[open_]
            a[open_] = np.where(up, middle + 1, a[open_])
            b[open_] = np.where(up, b[open_], middle)
        ends.append(a)
    return ends[0], ends[1]


@dataclass
class Found:
    """Of each test suffix (by its number): where it stands in the array, and what it has in common with its neighbours."""

    array: np.ndarray
    at: np.ndarray
    before: np.ndarray
    after: np.ndarray


def search(shard: Shard, tests: Tests) -> Found:
    """Binary search of every test suffix in the shard's suffix array: by its first key, then within the suffixes that have
    this key by its next, and so on."""
    bits = tests.bits
    per = max(1, 63 // bits)
    array, keys = suffix_array(shard.words, per, bits)
    place = tests.at.astype(np.int64)
    none = np.zeros(len(place), np.int64)
    if not len(array) or not len(place):
        return Found(array, none, none, none)
    ordered, key = keys[array], keys_at(tests.words, place, per, bits)
    low, high = np.searchsorted(ordered, key, "left"), np.searchsorted(ordered, key, "right")
    at = low.copy()
    live = np.flatnonzero((high > low) & ((key & ((1 << bits) - 1)) > 0))
    low, high, shift = low[live], high[live], per
    while len(live):
        key = keys_at(tests.words, place[live] + shift, per, bits)
        low, high = bounds(keys, array, low, high, shift, key)
        at[live] = low
        more = (high > low) & ((key & ((1 << bits) - 1)) > 0)
        live, low, high, shift = live[more], low[more], high[more], shift + per
    before = np.where(at > 0, common(shard.words, array[np.maximum(at, 1) - 1], tests.words, place), 0)
    after = np.where(at < len(array), common(shard.words, array[np.minimum(at, len(array) - 1)], tests.words, place), 0)
    return Found(array, at, before, after)


def occurrences(shard: Shard, tests: Tests, found: Found, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each window length the test suffixes whose window occurs, and the stretch of the array that holds its occurrences."""
    count = np.bincount(tests.item, minlength=len(tests.items))[tests.item] if len(tests.item) else np.zeros(0, np.int64)
    window = np.minimum(count, width)
    best = np.maximum(found.before, found.after)
    hits = np.flatnonzero((best >= window) & (tests.room >= window))
    if not len(hits):
        return
    neighbours = common(shard.words, found.array[:-1], shard.words, found.array[1:], int(window[hits].max()))
    for m in np.unique(window[hits]).tolist():
        own = hits[window[hits] == m]
        edges = np.concatenate(([0], np.flatnonzero(neighbours < m) + 1, [len(found.array)]))
        at = found.at[own] - (found.before[own] >= m)
        part = np.searchsorted(edges, at, "right") - 1
        yield own, np.stack((edges[part], edges[part + 1])), m


def in_parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of about ``most`` in all (a larger one alone)."""
    low, total = 0, np.cumsum(sizes)
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + most, "right")))
        yield slice(low, high)
        low = high


class Findings:
    """What is found in a shard's documents over all blocks of the benchmark."""

    def __init__(self, rows: int):
        self.hit: np.ndarray | None = None
        self.items: list[set[str]] = [set() for _ in range(rows)]
        self.longest: list[tuple[int, str]] = [(0, "")] * rows
        self.shard: Shard | None = None

    def add(self, shard: Shard, tests: Tests, width: int) -> None:
        self.shard = shard
        if self.hit is None:
            self.hit = np.zeros(len(shard.words), bool)
        found = search(shard, tests)
        array = found.array
        for own, (low, high), m in occurrences(shard, tests, found, width):
            stretches = np.unique(np.stack((low, high), 1), axis=0)
            for part in in_parts(stretches[:, 1] - stretches[:, 0], PAIRS):
                places = array[ragged(stretches[part, 0], stretches[part, 1] - stretches[part, 0])]
                self.hit |= mark(len(self.hit), places, np.full(len(places), m))
            sizes = high - low
            for part in in_parts(sizes, PAIRS):
                test = np.repeat(own[part], sizes[part])
                place = array[ragged(low[part], sizes[part])]
                doc, item = shard.doc[place], tests.item[test].astype(np.int64)
                for d, i in np.unique(np.stack((doc, item), 1), axis=0).tolist():
                    self.items[d].add(tests.items[i])
                # Matches that can't be begun a word earlier are the longest ones.
                one, other = tests.at[test].astype(np.int64) - 1, place - 1
                longer = (one >= 0) & (other >= 0)
                longer &= (tests.words[np.maximum(one, 0)] == shard.words[np.maximum(other, 0)]) & (shard.words[np.maximum(other, 0)] > 0)
                test, place, doc, item = test[~longer], place[~longer], doc[~longer], item[~longer]
                length = common(shard.words, place, tests.words, tests.at[test].astype(np.int64))
                for d, k, i in np.unique(np.stack((doc, length, item), 1), axis=0).tolist():
                    self.longest[d] = max(self.longest[d], (k, tests.items[i]))

    def batch(self, ids: pa.Array) -> pa.RecordBatch:
        shard, hit = self.shard, self.hit
        edge = np.flatnonzero(hit & np.concatenate(([True], ~hit[:-1]))[: len(hit)])
        stop = np.flatnonzero(hit & np.concatenate((~hit[1:], [True]))[: len(hit)]) + 1
        spans: list[list[dict]] = [[] for _ in self.items]
        for a, b in zip(edge.tolist(), stop.tolist(), strict=True):  # a 0 stands between documents, so no run crosses them
            d = int(shard.doc[a])
            spans[d].append({"start": a - int(shard.first[d]), "length": b - a})
        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(shard.n_words, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                pa.array([sorted(x) for x in self.items], pa.list_(pa.string())),
                pa.array([n for n, _ in self.longest], pa.int64()),
                pa.array([i if n else None for n, i in self.longest], pa.string()),
            ],
            ["doc_id", "n_words", "spans", "items", "longest", "longest_item"],
        )


def loaded(blocks: list) -> Iterator[Tests]:
    """The blocks one after another; with several, each is let go before the next is read from the worker's disk."""
    for block in blocks:
        yield block.value
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)


def blocks(benchmark: DataFrame, block_bytes: int) -> list:
    """Broadcasts of the benchmark, each of about ``block_bytes`` of text (an item is never cut). The driver reads one block after
    another and holds its arrays only until they are written out."""
    tests = benchmark.select(F.col("item_id").cast("string").alias("item"), as_text().alias("text")).filter("item is not null")
    size = tests.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = max(1, -(-size // block_bytes))
    out = []
    for b in range(n):
        own = tests if n == 1 else tests.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        out.append(benchmark.sparkSession.sparkContext.broadcast(Tests([(r.item, r.text) for r in own.collect()])))
    return out


def _scan(blocks: list, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "text", SHARD_BYTES):
            findings = Findings(batch.num_rows)
            for tests in loaded(blocks):
                findings.add(shard_of(tests, data, offsets), tests, width)
            yield findings.batch(batch.column(0))

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_words, spans (maximal runs of hit words: first word, length), n_hit,
    items (ids of items with a window in it, sorted), longest (words of its longest verbatim match with an item of which
    a window is in it), longest_item (of several the last in order).

    Words are runs of bytes other than ASCII non-alphanumerics, A-Z lower-cased. An item's windows are its ``width``
    successive words, or all its words if it has fewer; matches never cross documents. Null and empty texts have no words
    and no windows; items with a null id take no part; items that share an id count once. A null doc_id stays null,
    repeated rows are judged each on its own, other columns don't matter whatever their names, empty tables give no rows (no
    documents) or no hits (no items).

    The benchmark's size is summed first: up to ``block_bytes`` it is one broadcast, above that several, which a task reads
    from its disk one after another, so that memory is bounded by one block. Documents aren't shuffled.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text"))
    found = source.mapInArrow(_scan(blocks(benchmark, block_bytes), width), HITS)
    return found.select("doc_id", "n_words", "spans", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"]).alias("n_hit"), "items", "longest", "longest_item")


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each suffix of each benchmark item its longest verbatim match over all documents, of any length from ``least`` words:
    item, start (its first word in the item), length (words), doc_id, doc_start (of several longest ones the smallest doc_id,
    then place). Suffixes of which no word is in any document have no row; the awkward cases are those of
    find_contamination(). Each task keeps the best of its shards, so what is shuffled follows the benchmark."""
    held = blocks(benchmark, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "text", SHARD_BYTES):
            ids = np.asarray(batch.column(0).fill_null(-(1 << 63)))
            for tests in loaded(held):
                shard = shard_of(tests, data, offsets)
                found = search(shard, tests)
                best = np.maximum(found.before, found.after)
                some = np.flatnonzero(best >= max(least, 1))
                if not len(some):
                    continue
                # All suffixes that share the longest match stand around the place found: take the first of them.
                near = np.where(found.after[some] >= found.before[some], found.at[some], found.at[some] - 1)
                neighbours = common(shard.words, found.array[:-1], shard.words, found.array[1:], int(best[some].max()))
                order = np.lexsort((found.array, ids[shard.doc[found.array]]))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                first = np.empty(len(some), np.int64)
                for m in np.unique(best[some]).tolist():
                    own = best[some] == m
                    edges = np.concatenate(([0], np.flatnonzero(neighbours < m) + 1))
                    least_rank = np.minimum.reduceat(rank, edges)
                    first[own] = found.array[order[least_rank[np.searchsorted(edges, near[own], "right") - 1]]]
                doc, item = shard.doc[first], tests.item[some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tests.items[i] for i in item.tolist()], pa.string()), pa.array(tests.at[some] - tests.first[item], pa.int64()), pa.array(best[some], pa.int64()), batch.column(0).take(pa.array(doc)), pa.array(first - shard.first[doc], pa.int64())],
                    ["item", "start", "length", "doc_id", "doc_start"],
                )

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text")).mapInArrow(run, MATCHES)
    best = found.groupBy("item", "start").agg(F.min(F.struct((-F.col("length")).alias("less"), "doc_id", "doc_start")).alias("best"))
    return best.select("item", "start", (-F.col("best.less")).alias("length"), "best.doc_id", "best.doc_start")


def _keep(blocks: list, width: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "text", SHARD_BYTES):
            clean = np.ones(batch.num_rows, bool)
            for tests in loaded(blocks):
                shard = shard_of(tests, data, offsets)
                found = search(shard, tests)
                for _, (low, high), _ in occurrences(shard, tests, found, width):
                    touched = np.zeros(len(found.array) + 1, np.int64)
                    np.add.at(touched, low, 1)
                    np.add.at(touched, high, -1)
                    clean[shard.doc[found.array[np.cumsum(touched[:-1]) > 0]]] = False
            yield batch.filter(pa.array(clean)).select(columns)

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in whose text no window of an item occurs, with docs' columns, whatever their names; the awkward
    cases are those of find_contamination()."""
    return docs.mapInArrow(_keep(blocks(benchmark, block_bytes), width, docs.columns), docs.schema)

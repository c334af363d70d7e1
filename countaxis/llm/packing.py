"""Packing by power-of-two decomposition: pieces of binary lengths, so no sequence crosses documents and none is padded."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countaxis.llm.shared import as_text, chunks, column_bytes, ragged, span_hash, word_spans

PIECES = "doc_id long, start long, length long, doc_tokens long, token_bytes binary"
#: Units in a worker's cache of encoded units (some 40 bytes each); once full it takes no more, which changes speed only.
CACHE_UNITS = 1_000_000
#: Bytes of text encoded at once, and words encoded in one call.
ENCODE_BYTES, JOINED = 4 << 20, 256
#: Signs cut off after words.
SIGNS = ".,!?;:&-'\")"
IS_SIGN = np.isin(np.arange(256), list(SIGNS.encode()))
NOT_BLANK = ~np.isin(np.arange(256), [0x20, 0x0A])
#: Lead byte of U+00C0 ... U+00FF, and the first one of characters beyond.
LATIN_LEAD, BEYOND = 0xC3, 0xC4


class Encoder:
    """A tokenizer's ids of whole texts, put together from units between blanks that are encoded once and then looked up.

    Nothing is taken for granted of Unicode. A unit is cut before the signs at its end only if the character before them is a
    letter below U+0100 that was seen to be parted from signs by this tokenizer; case is dropped ahead only in texts of
    such characters; words are encoded many in a call only if they are such letters, and only if the call gives as many
    word ends as words. All other units go to the tokenizer as they are, and so do whole texts if the tokenizer doesn't
    drop blanks. Units are told apart by 64-bit hashes in some MB of text, and by two of them against the cache.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        special = [x.content for x in self.model.get_added_tokens_decoder().values()]
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.blanks = not any(" " in x or "\n" in x for x in special) and self._drops_blanks()
        self.lower = all(self.ids(chr(c)) == self.ids(chr(c).lower()) for c in range(256))
        #: By last byte of a unit's core, whether signs after it form tokens of their own: of ASCII, and after LATIN_LEAD.
        self.parted = np.array([self._parts(chr(c)) if c < 128 else False for c in range(256)])
        self.parted_latin = np.array([self._parts(chr(c + 64)) if 128 <= c < 192 else False for c in range(256)])
        self.hashes = np.zeros(0, np.uint64)
        self.checks = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _parts(self, last: str) -> bool:
        return last.isalpha() and all(self.ids(last + x) == self.ids(last) + self.ids(x) for x in (*SIGNS, "...", "'&-"))

    def _drops_blanks(self) -> bool:
        both = (("a", "b"), ("x'", "s"), ("1", "2"), ("e", "\u0301"), ("?", "!"), (".", "..."), ("\u00e9", "\u0301a"), ("\u1100", "\u1161"))
        return not self.ids(" \n ") and all(self.ids(f"{a}{blank}{b}") == self.ids(a) + self.ids(b) for a, b in both for blank in (" ", "\n"))

    def encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units one after another, and how many are each unit's."""
        found: list[np.ndarray | None] = [None] * len(units)
        words = [i for i, x in enumerate(units) if len(x) < 64 and x.isalpha() and max(x) < "\u0100"]
        parts = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for part, out in zip(parts, self.model.encode_batch_fast([" ".join([units[i] for i in x]) for x in parts], add_special_tokens=False), strict=True):
            ids = np.array(out.ids, np.uint32)
            edge = np.flatnonzero(self.ends[ids]) + 1
            if len(edge) == len(part) and edge[-1] == len(ids):
                for i, x in zip(part, np.split(ids, edge[:-1]), strict=True):
                    found[i] = x
        others = [i for i, x in enumerate(found) if x is None]
        for i, out in zip(others, self.model.encode_batch_fast([units[i] for i in others], add_special_tokens=False), strict=True):
            found[i] = np.array(out.ids, np.uint32)
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes with case dropped where that is sure; starts, ends and texts of their units."""
        rows = len(offsets) - 1
        beyond = np.zeros(rows, bool)
        beyond[np.searchsorted(offsets, np.flatnonzero(data >= BEYOND), "right") - 1] = True
        latin = np.repeat(~beyond, np.diff(offsets))
        after_lead = np.concatenate(([False], data[:-1] == LATIN_LEAD))[: len(data)]
        if self.lower:
            big = (data >= 0x41) & (data <= 0x5A) | after_lead & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
            data = data + ((big & latin).astype(np.uint8) << 5)
        starts, ends, text = word_spans(data, offsets, NOT_BLANK)
        if not len(starts):
            return data, starts, ends, text
        place = np.where(IS_SIGN[data], -1, np.arange(len(data)))
        core = np.maximum(np.maximum.accumulate(place)[ends - 1] + 1, starts)  # after the last byte that is no sign
        last = np.maximum(core - 1, 0)
        cut = (core > starts) & (core < ends) & latin[last] & np.where(after_lead[last] & (core - starts > 1), self.parted_latin[data[last]], self.parted[data[last]])
        n = 1 + cut
        first = np.cumsum(n) - n
        begin, end = np.repeat(starts, n), np.repeat(ends, n)
        begin[first[cut] + 1] = core[cut]
        end[first[cut]] = core[cut]
        return data, begin, end, np.repeat(text, n)

    def flat(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8 bytes and offsets) one after another, each with ``end_id`` behind it if given; how many each has."""
        rows = len(offsets) - 1
        ends_ = np.zeros(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)
        if not self.blanks:
            ids = [np.concatenate((np.array(self.ids(data[a:b].tobytes().decode()), np.uint32), ends_)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)
        data, starts, ends, text = self.units(data, offsets)
        hashes = span_hash(data, starts, ends)
        distinct, first, unit = np.unique(hashes, return_index=True, return_inverse=True)
        checks = span_hash(data, starts[first], ends[first], 1)
        have = np.searchsorted(self.hashes, distinct)
        near = np.minimum(have, max(len(self.hashes) - 1, 0))
        known = (self.hashes[near] == distinct) & (self.checks[near] == checks) if len(self.hashes) else np.zeros(len(distinct), bool)
        missing = np.flatnonzero(~known)
        raw = data.tobytes()
        ids, sizes = self.encoded([raw[a:b].decode() for a, b in zip(starts[first[missing]].tolist(), ends[first[missing]].tolist(), strict=True)])
        at, size = np.empty(len(distinct) + 1, np.int64), np.empty(len(distinct) + 1, np.int64)
        pool = np.concatenate((self.pool, ids, ends_))
        at[:-1][known], size[:-1][known] = (self.at[near[known]], self.size[near[known]]) if len(self.hashes) else (0, 0)
        at[missing], size[missing] = len(self.pool) + np.cumsum(sizes) - sizes, sizes
        at[-1], size[-1] = len(pool) - len(ends_), len(ends_)
        if len(self.hashes) < CACHE_UNITS:
            free = missing[(self.hashes[near[missing]] != distinct[missing])] if len(self.hashes) else missing
            where = have[free]
            self.hashes, self.checks = np.insert(self.hashes, where, distinct[free]), np.insert(self.checks, where, checks[free])
            self.at, self.size = np.insert(self.at, where, at[free]), np.insert(self.size, where, size[free])
            self.pool = pool[: len(pool) - len(ends_)]
        counts = np.bincount(text, minlength=rows) if len(text) else np.zeros(rows, np.int64)
        order = np.full(len(unit) + rows, len(distinct), np.int64)  # the end id is one more unit behind each text
        order[np.arange(len(unit)) + text] = unit
        lengths = size[order]
        edges = np.cumsum(counts + 1) - counts - 1
        return pool[ragged(at[order], lengths)], np.add.reduceat(lengths, edges) if rows else np.zeros(0, np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The tokenizer of a file, kept for the worker's life."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian 32-bit values."""
    ids, counts = encoder(path).flat(*column_bytes(pa.array(texts, pa.string())))
    return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


def binary_lengths(n: int, most: int) -> list[int]:
    """n as a sum of powers of two, largest first, none above ``most`` (itself a power of two)."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def decomposed(totals: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """binary_lengths() of many numbers: for each piece whose it is and its length, largest first."""
    owner, length = [np.repeat(np.arange(len(totals)), totals // most)], [np.full(int((totals // most).sum()), most, np.int64)]
    for bit in range(most.bit_length() - 2, -1, -1):
        some = np.flatnonzero(totals % most >> bit & 1)
        owner.append(some)
        length.append(np.full(len(some), 1 << bit, np.int64))
    owner, length = np.concatenate(owner), np.concatenate(length)
    order = np.argsort(owner, kind="stable")
    return owner[order], length[order]


def _pieces(path: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "text", ENCODE_BYTES):
            ids, totals = encoder(path).flat(data, offsets, end_id)
            owner, length = decomposed(totals, most)
            at = np.cumsum(length) - length
            first = np.cumsum(totals) - totals
            edges = 4 * np.append(at, len(ids))
            raw = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
            for bucket in np.unique(length).tolist():  # equal lengths together
                some = np.flatnonzero(length == bucket)
                whose = owner[some]
                columns = [batch.column(0).take(pa.array(whose)), at[some] - first[whose], length[some], totals[whose]]
                yield pa.RecordBatch.from_arrays([columns[0], *(pa.array(x, pa.int64()) for x in columns[1:]), raw.take(pa.array(some)).cast(pa.binary())], ["doc_id", "start", "length", "doc_tokens", "token_bytes"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, most: int = 2048) -> DataFrame:
    """Sequences of ``docs`` (doc_id, text; others ignored), one row for each: doc_id, start, length, doc_tokens, token_bytes
    (the ids, little-endian 32 bits), sequence_id, offset (0), bucket (the binary logarithm of length).

    A document is its ids and ``end_id``; it is cut, largest piece first, into powers of two of at most ``most`` ids.
    Each piece is a sequence: its bucket is its length, all sequences of a bucket have equal lengths, and none needs
    padding or crosses documents. A task puts out the sequences of some MB of text bucket by bucket; write_buckets() makes
    a folder of each bucket. Null and empty texts are the end id alone. A null doc_id stays null, repeated rows are
    packed each on its own, columns beside doc_id and text don't matter, an empty table gives no rows. No row leaves its
    task: there is no shuffle to be skewed.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text")).mapInArrow(_pieces(tokenizer_path, end_id, most), PIECES)
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.log2("length").cast("int").alias("bucket"))


def write_buckets(sequences: DataFrame, path: str) -> None:
    """Write sequences bucket by bucket: one folder for each length, so a reader gets batches of equal shape."""
    sequences.write.partitionBy("bucket").parquet(path)

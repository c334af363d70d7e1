"""Removal of repeated passages by suffix arrays, sharded so that all places of a passage meet in one shard.

Every 100-byte window picks an anchor, its 20-byte gram with the smallest hash, from its own bytes alone; so all places
of equal windows pick the same gram, and shards are sets of grams. A segment is a run of windows with one anchor, with
the bytes they cover. Equal segments are one (the earliest stands for them), first in the task that reads the texts, so
a passage that is in a third of all documents leaves a task once; equal are segments of one gram and one hash of all
bytes, 64 bits each. In each shard, segments whose gram is in some other segment are concatenated, and a suffix array over them is built by two-stage sorting: suffixes smaller than their
successors are sorted directly, the others are induced by scanning the buckets of first bytes. Runs of neighbours with
a common prefix of 100 bytes are the equal windows; all but the earliest of a run are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countaxis.llm.shared import CHUNK_BYTES, as_text, column_bytes, free_names, mark, mixed, new_key, ragged, released, span_hash, stored, tidy

#: Bytes of the gram that anchors a window.
GRAM = 20
POSITION_BITS = 23
_POWER = {k: np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2, 4, 8, 16)}
#: A place in a document: its id and row tag, and windows from start on. row: a hash of the text, which tells rows of one id apart.
PLACE = [("id", "<i8"), ("row", "<i8"), ("start", "<u4"), ("count", "<u4")]
REPEAT = np.dtype(PLACE)
SEGMENT = np.dtype([*PLACE, ("anchor", "<u2")])
HASHED = np.dtype([*SEGMENT.descr, ("gram", "<u8"), ("content", "<u8")])
ROWS = "grp long, kind int, blob binary"
ROW_SCHEMA = pa.schema([("grp", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
TEXTS, HASHES, REPEATS, CANDIDATES, SEGMENTS = range(5)
NO_ID = -(1 << 63)
#: The columns that remove_repeats() adds.
FOUND = ["_n_bytes", "_n_removed", "_spans", "_kept"]


def gram_keys(data: np.ndarray) -> np.ndarray:
    """For each place a key whose high bits are the hash of the gram there and whose low bits prefer later places."""
    n = len(data) - GRAM + 1
    h = data.astype(np.uint64) + np.uint64(1)
    width, fourth = 1, None
    while width < 16:
        h = h[:-width] * _POWER[width] + h[width:]
        width *= 2
        if width == 4:
            fourth = h
    key = mixed(h[:n] * _POWER[4] + fourth[16 : 16 + n])
    return (key >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange((1 << POSITION_BITS) - 1, (1 << POSITION_BITS) - 1 - n, -1, dtype=np.uint64)


def segments_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor inside the texts: first window, number of windows, anchor's place, text."""
    none = (np.zeros(0, np.int64),) * 4
    if len(data) < length:
        return none
    low = gram_keys(data)
    width = 1
    wanted = length - GRAM + 1
    while width * 2 <= wanted:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if wanted > width:
        low = np.minimum(low[: len(low) - (wanted - width)], low[wanted - width :])
    anchor = (1 << POSITION_BITS) - 1 - (low & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    windows = np.maximum(np.diff(offsets) - length + 1, 0)
    starts = ragged(offsets[:-1], windows)
    if not len(starts):
        return none
    text = np.repeat(np.arange(len(windows)), windows)
    anchor = anchor[starts]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
    return starts[first], np.diff(np.concatenate((first, [len(starts)]))), anchor[first], text[first]


# Blobs: a structured array column by column (so that like bytes stand together), compressed.
def packed(array: np.ndarray, tail: bytes = b"") -> bytes:
    parts = [np.array([len(array)], "<u4").tobytes(), *(np.ascontiguousarray(array[name]).view(np.uint8).reshape(len(array), array.dtype[name].itemsize).T.tobytes() for name in array.dtype.names), tail]
    return zstandard.ZstdCompressor(1).compress(b"".join(parts))


def unpacked(blob: bytes, dtype: np.dtype) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at = int(np.frombuffer(raw, "<u4", 1)[0]), 4
    out = np.empty(n, dtype)
    for name in dtype.names:
        size = dtype[name].itemsize
        out[name] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(dtype[name])
        at += n * size
    return out, raw[at:]


def all_of(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype), *(unpacked(b, dtype)[0] for b in blobs)])


def rows_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(ROW_SCHEMA.types)], schema=ROW_SCHEMA)


def split_by(groups: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each group and the positions of its members."""
    if len(groups):
        order = np.argsort(groups, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], np.diff(groups[order]) != 0)))
        for members in np.split(order, edges[1:]):
            yield int(groups[members[0]]), members


def group_of(ids: np.ndarray, tags: np.ndarray, groups: int) -> np.ndarray:
    """The group of documents that a row is dealt to: by its id, or without one by the hash of its text."""
    keys = np.where(ids == NO_ID, tags, ids).astype(np.int64)
    return (mixed(keys.view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def repeat_rows(repeats: np.ndarray, groups: int) -> Iterator[tuple[int, int, bytes]]:
    for g, members in split_by(group_of(repeats["id"], repeats["row"], groups)):
        yield g, REPEATS, packed(repeats[members])


def earliest_first(array: np.ndarray, *leading: str) -> np.ndarray:
    return np.lexsort((array["start"], array["row"], array["id"], *(array[x] for x in reversed(leading))))


def same_place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a["id"] == b["id"]) & (a["row"] == b["row"]) & (a["start"] == b["start"])


def collapsed(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of each class of equal segments, and the others. Segments of one place (of repeated rows) are one."""
    segments = segments[earliest_first(segments, "gram", "content")]
    if not len(segments):
        return segments, segments
    new = np.concatenate(([True], (segments["gram"][1:] != segments["gram"][:-1]) | (segments["content"][1:] != segments["content"][:-1])))
    once = new | np.concatenate(([True], ~same_place(segments[1:], segments[:-1])))
    segments, new = segments[once], new[once]
    return segments[new], segments[~new]


def pieces(column: pa.Array, most: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in chunks of about ``most`` bytes: bytes, offsets, row of each piece, where it starts in its text. A longer text
    is cut so that each of its windows is in exactly one piece."""
    data, offsets = column_bytes(column)
    cut = [(row, base, min(size, base + most + length - 1)) for row, size in enumerate(np.diff(offsets).tolist()) for base in range(0, max(size - length + 1, 1), most)]
    low = 0
    while low < len(cut):
        high, size = low, 0
        while high < len(cut) and (high == low or size + cut[high][2] - cut[high][1] <= most):
            size += cut[high][2] - cut[high][1]
            high += 1
        part = cut[low:high]
        spans = [data[offsets[r] + a : offsets[r] + b] for r, a, b in part]
        yield np.concatenate(spans), np.concatenate(([0], np.cumsum([len(x) for x in spans]))), np.array([r for r, _, _ in part]), np.array([a for _, a, _ in part])
        low = high


def _hash_segments(length: int, shards: int, groups: int, key: int):
    """Each chunk's segments as hashes, for the shards of their grams; repeats inside the chunk are told at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for data, offsets, row, base in pieces(batch.column(2), CHUNK_BYTES, length) if batch.num_rows else ():
                first, count, anchor, text = segments_of(data, offsets, length)
                if not len(first):
                    continue
                found = np.empty(len(first), HASHED)
                found["id"], found["row"], found["start"] = ids[row[text]], tags[row[text]], first - offsets[text] + base[text]
                found["count"], found["anchor"] = count, anchor - first
                found["gram"] = span_hash(data, anchor, anchor + GRAM, 0, key)
                found["content"] = span_hash(data, first, first + count + length - 1, 1, key)
                kept, repeats = collapsed(found)
                rows = [(s, HASHES, packed(kept[members])) for s, members in split_by((kept["gram"] % np.uint64(shards)).astype(np.int64))]
                # Repeats go with the same shuffle, dealt by their documents, to the shards' tasks, which pass them on.
                rows += [(g % shards, REPEATS, packed(repeats[members])) for g, members in split_by(group_of(repeats["id"], repeats["row"], groups))]
                yield rows_of(rows)
            released()

    return run


def _compare_hashes(shards: int, groups: int):
    """Of a shard: repeats (equal segments but the earliest), and candidates (a gram with unequal segments), by document."""

    def run(table: pa.Table) -> pa.Table:
        blobs: dict[int, list[bytes]] = {HASHES: [], REPEATS: []}
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
            blobs[kind].append(blob)
        kept, repeats = collapsed(all_of(blobs[HASHES], HASHED))
        repeats = np.concatenate([repeats[list(REPEAT.names)].astype(REPEAT), all_of(blobs[REPEATS], HASHED)[list(REPEAT.names)].astype(REPEAT)])
        rows = list(repeat_rows(repeats, groups))
        if len(kept):
            new = np.concatenate(([True], kept["gram"][1:] != kept["gram"][:-1]))
            sizes = np.diff(np.append(np.flatnonzero(new), len(kept)))
            several = kept[np.repeat(sizes > 1, sizes)]
            rows += [(g, CANDIDATES, packed(several[members])) for g, members in split_by(group_of(several["id"], several["row"], groups))]
        return pa.Table.from_batches([rows_of(rows)])

    return tidy(run)


def _extract(shards: int, length: int, schema: pa.Schema, keys: tuple[str, str, str]):
    """The candidates' bytes out of their documents, for the shards again."""

    def run(table: pa.Table) -> pa.Table:
        wanted, found, texts = all_of([b for k, b in _kinds(table) if k == CANDIDATES], HASHED), [], []
        if len(wanted):
            order = np.lexsort((wanted["row"], wanted["id"]))
            wanted = wanted[order]
            key = np.array(list(zip(wanted["id"].tolist(), wanted["row"].tolist(), strict=True)), "<i8")
            edges = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]))
            spans = {tuple(key[a].tolist()): (int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)}
            for batch in documents(table, schema):
                for doc_id, tag, text in zip(*(batch.column(schema.get_field_index(x)) for x in keys), strict=True):
                    a, b = spans.pop((doc_id.as_py(), tag.as_py()), (0, 0))
                    if b > a:
                        data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                        found.append(wanted[a:b])
                        texts.append(data[ragged(wanted["start"][a:b].astype(np.int64), wanted["count"][a:b].astype(np.int64) + length - 1)])
        rows = []
        if found:
            segments, text = np.concatenate(found), np.concatenate(texts)
            sizes = segments["count"].astype(np.int64) + length - 1
            starts = np.cumsum(sizes) - sizes
            for s, members in split_by((segments["gram"] % np.uint64(shards)).astype(np.int64)):
                rows.append((s, SEGMENTS, packed(segments[members], text[ragged(starts[members], sizes[members])].tobytes())))
        return pa.Table.from_batches([rows_of(rows)])

    return tidy(run)


def _kinds(table: pa.Table) -> Iterator[tuple[int, bytes]]:
    return zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True)


def documents(table: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for kind, blob in _kinds(table):
        if kind == TEXTS:
            yield pa.ipc.read_record_batch(pa.py_buffer(zstandard.ZstdDecompressor().decompress(blob)), schema)


def words_at(text: np.ndarray) -> np.ndarray:
    """For each place the eight bytes from there on as a number that sorts as they do (past the end: zeros)."""
    out = np.zeros(len(text), np.uint64)
    for j in range(min(8, len(text))):
        out[: len(text) - j] |= text[j:].astype(np.uint64) << np.uint64(56 - 8 * j)
    return out


#: Bytes by which suffixes are sorted before it is asked which of them agree in all bytes that matter.
TOLD_APART = 24


def _sorted_ties(words: np.ndarray, places: np.ndarray, order: np.ndarray, tied: np.ndarray, at: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``order`` of ``places``, sorted by ``at`` bytes (tied: equal in them to the one before), sorted by ``depth`` bytes: eight more
    a round for those not told apart yet."""
    order, tied, n = order.copy(), tied.copy(), len(words)
    group = np.cumsum(~tied) - 1
    open_ = np.flatnonzero(tied | np.append(tied[1:], False))
    while at < depth and len(open_):
        place = places[order[open_]] + at
        key = np.where(place < n, words[np.minimum(place, n - 1)], np.uint64(0))
        own = group[open_]
        inner = np.lexsort((key, own))
        order[open_], key = order[open_[inner]], key[inner]
        again = np.concatenate(([False], (own[1:] == own[:-1]) & (key[1:] == key[:-1])))
        tied[open_] = again
        group[open_] = open_[np.maximum.accumulate(np.where(again, 0, np.arange(len(open_))))]
        open_ = open_[again | np.append(again[1:], False)]
        at += 8
    return order, tied


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (bytes, ending in a 0 that is its smallest) in the order of at least their first ``depth`` bytes.

    Two-stage sorting: the suffixes smaller than their successors are sorted directly, eight bytes a round for those not
    told apart yet; then the buckets of first bytes are scanned in order, and each suffix found puts its predecessor,
    if that is larger than it, at the end of the larger part of its bucket.
    """
    n = len(text)
    step = np.append(text[:-1].astype(np.int16) - text[1:], 1)
    decides = np.where(step != 0, np.arange(n), n - 1)
    decides = np.minimum.accumulate(decides[::-1])[::-1]
    smaller = np.flatnonzero(step[decides] < 0)
    words = words_at(text)
    order = np.argsort(words[smaller], kind="stable")
    key = words[smaller][order]
    tied = np.concatenate(([False], key[1:] == key[:-1]))
    order, tied = _sorted_ties(words, smaller, order, tied, 8, min(TOLD_APART, depth))
    open_ = np.flatnonzero(tied | np.append(tied[1:], False))
    if len(open_) and depth > TOLD_APART:
        # Of those that agree in all ``depth`` bytes one is sorted on, for all of them.
        place, group = smaller[order[open_]], (np.cumsum(~tied) - 1)[open_]
        same = span_hash(text, place, np.minimum(place + depth, n))
        inner = np.lexsort((same, group))
        first = np.concatenate(([True], (same[inner][1:] != same[inner][:-1]) | (group[inner][1:] != group[inner][:-1])))
        class_ = np.empty(len(open_), np.int64)
        class_[inner] = np.cumsum(first) - 1
        one, own = place[inner[first]], group[inner[first]]
        turn, _ = _sorted_ties(words, one, np.arange(len(one)), np.concatenate(([False], own[1:] == own[:-1])), TOLD_APART, depth)
        rank = np.empty(len(one), np.int64)
        rank[turn] = np.arange(len(one))
        order[open_] = order[open_][np.argsort(rank[class_], kind="stable")]
    sorted_smaller = smaller[order]

    edges = np.searchsorted(text[sorted_smaller], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[0].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        parts = []
        while len(wave):
            parts.append(wave)
            before = wave[wave > 0] - 1
            wave = before[text[before] == c]
        waiting[c] = []
        bucket = np.concatenate([*parts, sorted_smaller[edges[c] : edges[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        byte = text[before]
        before, byte = before[byte > c], byte[byte > c]
        for b, members in split_by(byte.astype(np.int16)):
            waiting[b].append(before[members])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, suffixes: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that neighbours in the array have in common, told exactly up to ``depth`` or cut down to a multiple of eight."""
    words, n = words_at(text), len(text)
    out = np.zeros(max(len(suffixes) - 1, 0), np.int64)
    left = np.arange(len(out))
    for at in [*range(0, depth - 7, 8), depth - 8] if depth >= 8 else []:
        a, b = suffixes[left] + at, suffixes[left + 1] + at
        left = left[(a < n) & (b < n) & (words[np.minimum(a, n - 1)] == words[np.minimum(b, n - 1)])]
        out[left] = at + 8
    return out


def repeats_in(segments: np.ndarray, texts: np.ndarray, length: int) -> np.ndarray:
    """Repeats among segments (their bytes one after another in ``texts``): all windows equal to an earlier one's."""
    sizes = segments["count"].astype(np.int64) + length - 1
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), np.uint8)
    text[ragged(starts, sizes)] = texts + 1  # 0 divides segments; no UTF-8 byte is 255
    array = suffix_array(text, length)
    equal = common_prefixes(text, array, length) >= length
    segment = np.repeat(np.arange(len(segments)), sizes + 1)
    offset = np.arange(len(text)) - starts[segment]
    window = offset < segments["count"][segment]
    equal &= window[array[:-1]] & window[array[1:]]
    _, document = np.unique(segments[["id", "row"]], return_inverse=True)
    place = document.astype(np.int64)[segment] << 32 | (segments["start"].astype(np.int64)[segment] + offset)
    heads = np.concatenate(([True], ~equal))
    run = np.cumsum(heads) - 1
    earliest = np.minimum.reduceat(place[array], np.flatnonzero(heads))[run]
    later = array[(place[array] > earliest) & window[array]]
    flags = np.zeros(len(text) + 1, bool)
    flags[later] = True
    begin = np.flatnonzero(flags & ~np.concatenate(([False], flags[:-1])))
    end = np.flatnonzero(~flags & np.concatenate(([False], flags[:-1])))
    out = np.empty(len(begin), REPEAT)
    own = segment[begin]
    out["id"], out["row"] = segments["id"][own], segments["row"][own]
    out["start"], out["count"] = segments["start"][own] + offset[begin], end - begin
    return out


def _sort_suffixes(length: int, groups: int):
    def run(table: pa.Table) -> pa.Table:
        segments, texts = [], []
        for _, blob in _kinds(table):
            s, t = unpacked(blob, HASHED)
            segments.append(s)
            texts.append(np.frombuffer(t, np.uint8))
        repeats = repeats_in(np.concatenate(segments), np.concatenate(texts), length)
        return pa.Table.from_batches([rows_of(list(repeat_rows(repeats, groups)))])

    return tidy(run)


def _remove(length: int, schema: pa.Schema, keys: tuple[str, str, str], columns: list[str], names: list[str], as_string: bool):
    """Documents with the bytes of repeated windows taken out."""
    types = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.string() if as_string else pa.binary())
    out = pa.schema([schema.field(c) for c in columns] + list(zip(names, types, strict=True)))

    def run(table: pa.Table) -> pa.Table:
        repeats = all_of([b for k, b in _kinds(table) if k == REPEATS], REPEAT)
        repeats = repeats[np.lexsort((repeats["row"], repeats["id"]))]
        own: dict[tuple[int, int], np.ndarray] = {}
        if len(repeats):
            edge = np.flatnonzero((repeats["id"][1:] != repeats["id"][:-1]) | (repeats["row"][1:] != repeats["row"][:-1])) + 1
            own = {(int(x["id"][0]), int(x["row"][0])): x for x in np.split(repeats, edge)}
        batches = []
        for batch in documents(table, schema):
            n_bytes, n_removed, spans, kept = [], [], [], []
            for doc_id, tag, text in zip(*(batch.column(schema.get_field_index(x)) for x in keys), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                places = own.get((doc_id.as_py(), tag.as_py()))
                runs = []
                if places is not None:
                    gone = mark(len(data), places["start"].astype(np.int64), places["count"].astype(np.int64) + length - 1)
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                    runs = [{"start": int(a), "length": int(b - a)} for a, b in edges.reshape(-1, 2)]
                    kept.append(data[~gone].tobytes())
                else:
                    kept.append(data.tobytes())
                n_bytes.append(len(data))
                n_removed.append(sum(r["length"] for r in runs))
                spans.append(runs)
                if as_string:
                    kept[-1] = kept[-1].decode("utf-8", "ignore")
            batches.append(pa.RecordBatch.from_arrays([batch.column(schema.get_field_index(c)) for c in columns] + [pa.array(x, t) for x, t in zip((n_bytes, n_removed, spans, kept), out.types[-4:], strict=True)], schema=out))
        return pa.Table.from_batches(batches, out)

    return tidy(run)


def _deal(keys: tuple[str, str, str], groups: int):
    """Documents to their groups, compressed, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, tags = (np.asarray(batch.column(batch.schema.get_field_index(x))) for x in keys[:2])
            yield rows_of([(g, TEXTS, zstandard.ZstdCompressor(1).compress(batch.take(pa.array(members)).serialize())) for g, members in split_by(group_of(ids, tags, groups))])

    return run


def remove_repeats(docs: DataFrame, columns: list[str] | None = None, length: int = 100, shards: int | None = None, as_string: bool = False) -> DataFrame:
    """``columns`` of ``docs`` (needs doc_id, text), and _n_bytes, _n_removed, _spans (maximal removed runs: start, length in
    bytes), _kept (the remaining bytes; ``as_string``: as a string, without what is left of
    characters of which bytes were removed), one row for each row of ``docs``.

    A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a row of smaller doc_id, or in
    the same row further left. All is judged on the input. Null texts count as empty; texts shorter than ``length`` stay
    whole. A null doc_id is smaller than all others. Rows that share a doc_id but not the text are ordered by a hash of
    the text; rows equal in both are one document: none is an earlier copy of the other, and each gets the same result.
    An empty table gives no rows. If ``columns`` have one of the names above, ours get underscores behind. ``shards``: tasks that the grams, and the documents, are dealt to; by default eight for each
    partition of the input, so that a shard's size depends on the partitions' and not on the input's.
    """
    spark = docs.sparkSession
    columns = docs.columns if columns is None else columns
    keys = tuple(free_names(["_id", "_row", "_bytes"], docs.columns))
    names = free_names(FOUND, [c for c in columns if c != "text"])
    keyed = docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(keys[0]), F.xxhash64(as_text()).alias(keys[1]), as_text().alias(keys[2]))
    if "text" in columns:  # once is enough
        keyed = keyed.drop("text")
        columns = [c for c in columns if c != "text"]
    shards = shards or 8 * max(8, docs.rdd.getNumPartitions())
    groups = shards

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(keyed.schema)
    hashed = keyed.select(*keys).mapInArrow(_hash_segments(length, shards, groups, new_key()), ROWS)
    compared = stored(hashed.groupBy("grp").applyInArrow(_compare_hashes(shards, groups), ROWS), "repeats")
    texts = keyed.mapInArrow(_deal(keys, groups), ROWS)
    wanted = compared.filter(F.col("kind") == CANDIDATES)
    bytes_only = keyed.select(*keys)
    found = bytes_only.mapInArrow(_deal(keys, groups), ROWS).unionByName(wanted).groupBy("grp").applyInArrow(_extract(shards, length, to_arrow_schema(bytes_only.schema), keys), ROWS)
    sorted_ = stored(found.groupBy("grp").applyInArrow(_sort_suffixes(length, groups), ROWS), "suffix-repeats")
    repeats = compared.filter(F.col("kind") == REPEATS).unionByName(sorted_)
    result = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema if f.name in columns), *(f"`{n}` {t}" for n, t in zip(names, ("long", "long", "array<struct<start:long,length:long>>", "string" if as_string else "binary"), strict=True))])
    return texts.unionByName(repeats).groupBy("grp").applyInArrow(_remove(length, schema, keys, columns, names, as_string), result)


def deduplicated(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with repeated bytes taken out of text, and with docs' columns, whatever their names. A character of which bytes
    were removed goes as a whole; n_chars, if there, is counted anew; rows stay even if no text is left; null texts become
    empty ones. For ties, repeated rows and the other awkward cases see remove_repeats()."""
    _, removed, _, kept = free_names(FOUND, [c for c in docs.columns if c != "text"])
    out = remove_repeats(docs, length=length, as_string=True).withColumn("text", F.col(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*(f"`{c}`" for c in docs.columns))

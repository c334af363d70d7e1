"""Alignment of two tokenizers' tokens over the bytes of each text.

Every byte has an owner among A's tokens and one among B's: token numbers repeated by the tokens' lengths in bytes. Where
either owner changes, a new pair of overlapping tokens begins (a link); where both change at once, a cut, which ends a group
of tokens that cover the same bytes. Words whose tokens don't depend on what is beside them are aligned once a chunk. How often a pair of ids is linked in the whole corpus is summed by pair; documents get
the sums of their pairs back by the chunk of documents that they were read in, so no pair's documents are gathered.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countaxis.llm.shared import as_text, chunks, forget, ragged, released, stored

#: Bytes of text in a chunk of documents (a longer text is one alone), and bytes given to a tokenizer at once.
ALIGN_BYTES, ENCODE_BYTES = 5 << 20, 128 << 10
#: Units of text that are encoded as one text.
JOINED = 4096
#: A pair of ids is one long: A's id above these bits, B's in them.
ID_BITS = 31
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, chunk long, pairs array<long>, times array<long>"


#: Where both tokenizers' tokens end if apart() holds for both: before a space that a letter or digit follows and no space precedes.
SEAM = re.compile(r"(?<=[^ ])(?= \w)")
JOINABLE = re.compile(r" \w(?:.*[^ ])?", re.DOTALL)


class Tokenizer:
    """A tokenizer's ids of texts, and the bytes that each id stands for.

    The library is the one that the file's suffix names: tokenizers (a byte-level vocabulary) for .json, sentencepiece for
    .model. Texts have no special tokens: their strings are plain text. Both are given texts that begin with a space; the second
    puts it there itself. ``apart``: what stands on both sides of a SEAM is encoded as if it stood alone.
    """

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ids: Callable[[list[str]], list[list[int]]] = lambda texts: model.encode([t[1:] for t in texts], num_threads=1)
            piece = lambda i: bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
            self.bytes_of = [piece(i) for i in range(model.get_piece_size())]
            # Merges make pieces of the vocabulary only, so none crosses a seam if no piece has a space after something else; a text that
            # is normalised (as these letters would be) may have other seams.
            probe = " ﬁ Ａ e\u0301"
            crossing = any(re.search("[^▁]▁", model.id_to_piece(i)) for i in range(model.get_piece_size()))
            self.apart = not crossing and b"".join(self.bytes_of[i] for i in self.ids([probe])[0]) == probe.encode()
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer as Model

            model = Model.from_file(path)
            model.no_truncation()
            model.no_padding()
            model.encode_special_tokens = True
            self.ids = lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            letters = byte_letters()
            vocabulary = model.get_vocab()
            self.bytes_of = [b""] * (max(vocabulary.values(), default=-1) + 1)
            for token, i in vocabulary.items():
                self.bytes_of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
            # The usual pattern of byte-level vocabularies begins a new part at a seam, and merges stay within parts.
            about = json.loads(model.to_str())
            split = about.get("pre_tokenizer") or {}
            self.apart = about.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.lengths = np.array([len(x) for x in self.bytes_of], np.int64)
        #: Each id's decimal with what may follow it in the list of groups: nothing, a comma, a bar, a semicolon.
        self.written = [f"{i}{mark}" for i in range(len(self.bytes_of)) for mark in ("", ",", "|", ";")]


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as itself, the others from U+0100 on, in turn."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    """The file's tokenizer, loaded once a worker."""
    return Tokenizer(path)


def encoded_parts(parts: list[list[str]], a: Tokenizer, b: Tokenizer) -> Iterator[tuple[list[int], list[int], list[int]]]:
    """Of each part (units side by side) A's ids, B's ids and its units' bytes; unit by unit where either's tokens are other bytes."""
    whole = ["".join(x) for x in parts]
    for part, text, own_a, own_b in zip(parts, whole, a.ids(whole), b.ids(whole), strict=True):
        want = text.encode()
        if b"".join([a.bytes_of[i] for i in own_a]) == want and b"".join([b.bytes_of[i] for i in own_b]) == want:
            yield own_a, own_b, [len(x.encode()) for x in part]
        elif len(part) == 1:
            yield [], [], [0]
        else:
            yield from encoded_parts([[x] for x in part], a, b)


def encoded(units: list[str], a: Tokenizer, b: Tokenizer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A's ids and B's ids of units of text (each begins with a space), one unit after another, and the bytes of each unit that have
    tokens: all, or none where either's tokens are other bytes than the unit. Units that can stand side by side without
    a change of their tokens are encoded together."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
    parts: list[list[str]] = []
    size, side_by_side = 0, False
    for number, unit in enumerate(units, 1):
        joinable = JOINABLE.fullmatch(unit) is not None
        if not (joinable and side_by_side and len(parts[-1]) < JOINED):
            parts.append([])
        parts[-1].append(unit)
        side_by_side = joinable
        size += len(unit)
        if size >= ENCODE_BYTES or number == len(units):
            for found in encoded_parts(parts, a, b):
                for x, y in zip(out, found, strict=True):
                    x.append(np.array(y, np.int64))
            parts, size, side_by_side = [], 0, False
    return tuple(np.concatenate(x) for x in out)


def owners(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two sequences of tokens over the same bytes (their lengths): each link's first byte, its token numbers in A and in B, and
    whether a cut comes before it."""
    owner_a, owner_b = (np.repeat(np.arange(len(n), dtype=np.int32), n) for n in (lengths_a, lengths_b))
    changed_a, changed_b = np.diff(owner_a, prepend=-1) != 0, np.diff(owner_b, prepend=-1) != 0
    at = np.flatnonzero(changed_a | changed_b)
    return at, owner_a[at], owner_b[at], changed_a[at] & changed_b[at]


def aligned_units(units: list[str], a: Tokenizer, b: Tokenizer) -> dict[str, np.ndarray | list[str]]:
    """Of each unit: whether it has tokens (fine), n_a, n_b, n_groups, n_links, its groups as a text; and all links' pairs of ids in
    the units' order."""
    ids_a, ids_b, sizes = encoded(units, a, b)
    rows = len(units)
    # All units side by side: both tokenizers' tokens end where a unit ends, so a cut parts them.
    ends = np.cumsum(sizes)
    of = lambda byte: np.searchsorted(ends, byte, "right")
    at, token_a, token_b, cut = owners(a.lengths[ids_a], b.lengths[ids_b])
    row, group = of(at), np.cumsum(cut) - 1
    group_a, group_b = (group[np.flatnonzero(np.diff(token, prepend=-1))] for token in (token_a, token_b))
    groups = np.arange(group[-1] + 2 if len(group) else 1)
    row_of_group = row[cut]
    n_a, n_b = np.bincount(row_of_group[group_a], minlength=rows), np.bincount(row_of_group[group_b], minlength=rows)
    # Tokens in the order that groups are written in: by group, A's before B's; the last of each kind has its own sign, the unit's none.
    last = lambda g: np.diff(g, append=-1) != 0
    code_a, code_b = 4 * ids_a + np.where(last(group_a), 2, 1), 4 * ids_b + np.where(last(group_b), 3, 1)
    end_b = np.cumsum(n_b)[n_b > 0] - 1
    code_b[end_b] = 4 * ids_b[end_b]
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    codes[np.arange(len(ids_a)) + np.searchsorted(group_b, groups)[group_a]] = code_a
    codes[np.arange(len(ids_b)) + np.searchsorted(group_a, groups)[group_b + 1]] = code_b + len(a.written)
    both = a.written + b.written
    words = [both[i] for i in codes.tolist()]
    edges = np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
    written = ["".join(words[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
    pairs = ids_a[token_a] << ID_BITS | ids_b[token_b]
    return {"fine": sizes > 0, "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(row_of_group, minlength=rows), "n_links": np.bincount(row, minlength=rows), "groups": written, "pairs": pairs}


def aligned_texts(texts: list[str], a: Tokenizer, b: Tokenizer) -> dict[str, pa.Array]:
    """Of each text: n_a, n_b, n_groups, n_links, groups (A's ids | B's ids; ...), and its distinct pairs with their numbers. A unit
    that several texts (or one text) repeat is aligned once: a cut parts it from what is beside it."""
    number: dict[str, int] = {}
    own: list[int] = []
    counts: list[int] = []
    for text in texts:
        units = [] if not text else SEAM.split(" " + text) if a.apart and b.apart else [" " + text]
        own += [number.setdefault(x, len(number)) for x in units]
        counts.append(len(units))
    found = aligned_units(list(number), a, b)
    at, rows = np.array(own, np.int64), len(texts)
    row = np.repeat(np.arange(rows), counts)
    fine = np.ones(rows, bool)
    fine[row[~found["fine"][at]]] = False
    summed = lambda x: np.bincount(row, x[at], rows).astype(np.int64) * fine
    edges = np.concatenate(([0], np.cumsum(counts))).tolist()
    groups = found["groups"]
    written = [";".join([groups[i] for i in own[x:y]]) if ok else "" for x, y, ok in zip(edges[:-1], edges[1:], fine.tolist(), strict=True)]
    keep = fine[row]
    at, row = at[keep], row[keep]
    n_links = found["n_links"]
    ids, local = np.unique(found["pairs"], return_inverse=True)
    links = ragged((np.cumsum(n_links) - n_links)[at], n_links[at])
    keys = np.sort(np.repeat(row, n_links[at]) * max(1, len(ids)) + local[links])
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    owner, which = np.divmod(keys[new], max(1, len(ids)))
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows)))).astype(np.int32))
    lists = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64()))
    numbers = {x: pa.array(summed(found[x])) for x in ("n_a", "n_b", "n_groups", "n_links")}
    return numbers | {"groups": pa.array(written, pa.string()), "pairs": lists(ids[which]), "times": lists(np.diff(new, append=len(keys)))}


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; others ignored, whatever their names): doc_id, n_a, n_b, n_groups, n_links,
    groups (`a1,a2|b1;a3|b2,b3`: decimal ids of A and B in order, group by group), the chunk of documents that it was read in, and its
    distinct linked pairs of ids (A's above ID_BITS bits) with the times that each is linked.

    ``path_a`` is a byte-level vocabulary for tokenizers (.json), which is given space + text; ``path_b`` a sentencepiece model,
    which puts its own space. Null and empty texts, and texts whose joined token bytes are not space + text, have no tokens: counts
    are 0, groups the empty string. A null doc_id stays null, repeated rows give repeated results, an empty table gives no rows.
    Texts are whole; a text longer than ALIGN_BYTES is a chunk of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizer(path_a), tokenizer(path_b)
        task, number = TaskContext.get().partitionId(), 0
        names = [x.split()[0] for x in ALIGNED.split(", ")]
        for batch, _, _ in chunks(batches, "text", ALIGN_BYTES):
            chunk = pa.array(np.full(batch.num_rows, task << 32 | number))
            columns = {"doc_id": batch.column(0), "chunk": chunk, **aligned_texts(batch.column(1).to_pylist(), a, b)}
            yield pa.RecordBatch.from_arrays([columns[x] for x in names], names)
            number += 1
            released()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text"))
    return rows.mapInArrow(run, ALIGNED)


def with_pair_counts(aligned: DataFrame) -> DataFrame:
    """``aligned`` (of align(), stored, so that chunks are fixed) with n_best and count_sum instead of pairs and times.

    A pair's count is the number of links of the whole corpus that hold it. count_sum adds the counts of a document's links up,
    n_best is the number of its links whose count is the highest that their B id has in the corpus, ties included. Each chunk asks
    once for each of its pairs, so a pair that is everywhere has as many rows as there are chunks.
    """
    asked = aligned.select("chunk", F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy("chunk", F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    asked = stored(asked, "pairs-of-chunks")
    counts = asked.groupBy("pair").agg(F.sum("n").alias("count"))
    owner = F.col("pair").bitwiseAND((1 << ID_BITS) - 1)
    # One row for each id of B's vocabulary at most, so its size is bounded by the tokenizer.
    best = counts.groupBy(owner.alias("b")).agg(F.max("count").alias("highest"))
    counts = counts.withColumn("b", owner).join(F.broadcast(best), "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    told = stored(asked.select("chunk", "pair").join(counts, "pair").select("chunk", "pair", "count", "best"), "counts-of-chunks")
    forget(asked)
    kept = [x for x in aligned.columns if x not in ("pairs", "times", "chunk")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema if f.name in kept) + ", n_best long, count_sum long"

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        pair = told.column("pair").to_numpy()
        order = np.argsort(pair)
        pair, count, best = pair[order], told.column("count").to_numpy()[order], told.column("best").to_numpy(zero_copy_only=False)[order]
        lists = rows.column("pairs").combine_chunks()
        sizes = np.asarray(lists.value_lengths(), np.int64)
        own, times = np.asarray(lists.flatten()), np.asarray(rows.column("times").combine_chunks().flatten())
        at = np.searchsorted(pair, own)
        edges = np.concatenate(([0], np.cumsum(sizes)))
        summed = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[edges])
        found = rows.select(kept)
        found = found.append_column("n_best", pa.array(summed(times * best[at])))
        return found.append_column("count_sum", pa.array(summed(times * count[at])))

    return aligned.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, schema)

"""Word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from countaxis.llm.shared import LOWER, NOT_SPACE, mixed, span_hash, word_spans

_STEP = np.uint64(0xA0761D6478BD642F)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5, key: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, sorted by hash, one text after another; and the offsets of the texts in them.

    Words are runs of bytes other than white space (20, 09-0D), A-Z lower-cased; a shingle is ``width`` successive words,
    or all words of a text that has fewer; a text without words has none.
    """
    rows = len(offsets) - 1
    data = LOWER[data]
    starts, ends, row = word_spans(data, offsets, NOT_SPACE)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    words = span_hash(data, starts, ends, 0, key)
    counts = np.bincount(row, minlength=rows)
    out, owner = [], []
    if len(words) >= width:
        shingle = np.zeros(len(words) - width + 1, np.uint64)
        for j in range(width):
            shingle = shingle * _STEP + words[j : len(words) - width + 1 + j]
        inside = row[: len(shingle)] == row[width - 1 :]
        out.append(mixed(shingle[inside]))
        owner.append(row[: len(shingle)][inside])
    for short in range(1, width):
        texts = np.flatnonzero(counts == short)
        if len(texts):
            first = np.searchsorted(row, texts)
            shingle = np.zeros(len(texts), np.uint64)
            for j in range(short):
                shingle = shingle * _STEP + words[first + j]
            out.append(mixed(shingle + np.uint64(short)))
            owner.append(texts)
    shingles, owner = np.concatenate(out), np.concatenate(owner)
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.concatenate(([True], (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])))
    return shingles[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=rows))))

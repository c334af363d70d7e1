"""Toxicity by a weighted lexicon that Aho-Corasick matches in folded text, with exception phrases and length normalisation."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countaxis.llm.shared import as_text, held_out

#: Labelled rows of each class that the lexicon is learnt from at most: those whose ids' hashes are smallest.
TRAIN_ROWS = 10_000
#: Keys that a map task sums before it hands them on.
SUMMED_KEYS = 300_000
#: Letters of other scripts and signs that look like Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԝ": "w", "ɡ": "g", "ո": "n", "ս": "u",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
#: Digits and signs written for letters. i, l and 1 fold to one letter, since 1 stands for both.
SUBSTITUTES = {"0": "o", "1": "i", "l": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Zero-width characters, which are dropped.
INVISIBLE = "­​‌‍⁠﻿"


def _folding() -> dict[int, str | None]:
    out: dict[int, str | None] = {i: " " for i in range(128) if not chr(i).isalnum()}
    for c in range(0xFF21, 0xFF5B):  # full-width letters
        if chr(c).isalpha():
            out[c] = chr(c - 0xFEE0).lower()
    for c in range(0x2000, 0x2070):  # general punctuation
        out[c] = " "
    out |= {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(k): v for k, v in SUBSTITUTES.items()} | {ord(c): None for c in INVISIBLE}
    for k, v in list(out.items()):
        if v and v in SUBSTITUTES:
            out[k] = SUBSTITUTES[v]
    return out


FOLDING = _folding()


def fold(text: str) -> str:
    """Lower case, look-alikes and substitutes as letters, other ASCII signs as blanks, blanks around."""
    return f" {text.lower().translate(FOLDING)} "


@dataclass
class Lexicon:
    """weights: folded phrase -> weight, a leading blank anchors it at a word's start, a trailing one at its end.
    exceptions: folded phrases in which a match doesn't count. slope, bias: of the logistic over normalised weight."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.0
    bias: float = -3.0

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for phrase in {*self.weights, *self.exceptions}:
            out.add_word(phrase, (len(phrase), self.weights.get(phrase, 0.0), phrase in self._excepted))
        if len(out):
            out.make_automaton()
        return out

    @property
    def _excepted(self) -> frozenset[str]:
        return frozenset(self.exceptions)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.machine = lexicon, lexicon.automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """Matches (start, end, weight) that lie in no exception phrase."""
        if not len(self.machine):
            return []
        found, safe = [], []
        for end, (n, weight, exception) in self.machine.iter(folded):
            if exception:
                safe.append((end - n + 1, end))
            if weight:
                found.append((end - n + 1, end, weight))
        if safe and found:
            found = [x for x in found if not any(a <= x[0] and x[1] <= b for a, b in safe)]
        return found

    def strength(self, text: str) -> float:
        """Summed weight of the matches over the logarithm of the length in words."""
        folded = fold(text)
        hits = self.hits(folded)
        return sum(w for _, _, w in hits) / math.log2(2 + len(folded.split())) if hits else 0.0


def grams(text: str, lengths: range) -> set[str]:
    """Word beginnings and whole words of a text, folded."""
    out = set()
    for word in set(fold(text).split()):
        out.update(f" {word[:k]}" for k in lengths if len(word) > k)
        out.add(f" {word} ")
    return out


def _count(make):
    """A map task that sums what ``make(text, toxic)`` yields, key -> (toxic, clean) documents, before anything is shuffled."""

    def rows(sums: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        keys = list(sums[0].keys() | sums[1].keys())
        for low in range(0, len(keys), 50_000):
            part = keys[low : low + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[k] for k in part], pa.int64()) for c in sums)], ["key", "toxic", "clean"])
        for c in sums:
            c.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                sums[0 if toxic else 1].update(make(text.as_py(), toxic))
                if len(sums[0]) + len(sums[1]) > SUMMED_KEYS:
                    yield from rows(sums)
        yield from rows(sums)

    return run


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, lengths: range = range(3, 9), least: int = 3, odds: float = 3.0, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from ``labels`` (doc_id, toxic 0/1; null labels are ignored) and their texts in ``docs``.

    Up to ``train_rows`` rows of each class are taken, those with the smallest hashes of doc_id. Word beginnings of
    ``lengths`` and whole words get the logarithm of their odds, less its standard error, as weights; kept are those in ``least`` or more toxic
    texts whose weight is ``odds`` or more, however many they are, and a longer one only if it says more than
    its beginning. Words that match but stand mostly in clean texts become exception phrases, beside those given.
    With no labels the lexicon is empty.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).filter("_id is not null and _toxic in (0, 1)")
    order = F.xxhash64(F.col("_id"))
    taken = [r for k in (0, 1) for r in known.filter(F.col("_toxic") == k).groupBy("_id", "_toxic").count().orderBy(order, "_id").limit(train_rows).collect()]
    if not taken:
        return Lexicon({}, [fold(x) for x in exceptions])
    sample = F.broadcast(spark.createDataFrame([(r._id, r._toxic) for r in taken], "_id long, _toxic int"))  # at most 2 * train_rows rows
    train = docs.select("doc_id", as_text().alias("text")).join(sample, F.col("doc_id") == F.col("_id")).select("text", "_toxic")

    def counted(frame: DataFrame, make) -> DataFrame:
        return frame.mapInArrow(_count(make), "key string, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))

    n_toxic, n_clean = sum(r._toxic for r in taken), train.filter("_toxic = 0").count()
    gram_counts = lambda k: counted(train.filter(F.col("_toxic") == k), lambda text, _: grams(text, lengths))
    common = gram_counts(1).filter(F.col("toxic") >= least).select("key", "toxic")
    both = common.join(gram_counts(0).select("key", "clean"), "key", "left").fillna(0, ["clean"])
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    strong = both.filter(F.log(t / (n_toxic + 1)) - F.log(c / (n_clean + 1)) - F.sqrt(1 / t + 1 / c) >= odds - 1e-9).collect()
    weights: dict[str, float] = {}
    for r in sorted(strong, key=lambda r: (len(r.key), r.key)):
        t, c = r.toxic + 0.5, r.clean + 0.5
        weight = math.log(t / (n_toxic + 1)) - math.log(c / (n_clean + 1)) - math.sqrt(1 / t + 1 / c)
        beginning = max((weights[r.key[:k]] for k in range(2, len(r.key)) if r.key[:k] in weights), default=0.0)
        if weight >= odds and weight > beginning + 0.5:
            weights[r.key] = weight
    lexicon = Lexicon(weights, [fold(x) for x in exceptions])

    draft = spark.sparkContext.broadcast(lexicon)

    def matched_words(text: str, _: int) -> set[str]:
        machine, folded = _matcher(draft), fold(text)
        return {f" {folded[a + 1 : folded.find(' ', b)]} " for a, b, _ in machine.hits(folded) if folded[a] == " "}

    words = counted(train, matched_words).filter(F.col("clean") >= 2).collect()
    lexicon.exceptions += [r.key.rstrip() + " " for r in words if r.clean / (n_clean + 1) > r.toxic / (n_toxic + 1)]
    final = spark.sparkContext.broadcast(lexicon)
    bins = counted(train, lambda text, _: [f"{_matcher(final).strength(text):.2f}"]).collect()
    lexicon.slope, lexicon.bias = logistic(np.array([float(r.key) for r in bins]), np.array([r.toxic for r in bins], float), np.array([r.clean for r in bins], float))
    return lexicon


def logistic(x: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a one-variable logistic over binned counts; both classes weigh alike, with a weak ridge."""
    if not ones.sum() or not zeros.sum():
        return 1.0, 3.0 if ones.sum() > zeros.sum() else -3.0
    ones, zeros = ones / ones.sum(), zeros / zeros.sum()
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = (ones + zeros) * p * (1 - p) + 1e-12
        error = ones - (ones + zeros) * p
        g = np.array([(error * x).sum() - 1e-6 * a, error.sum() - 1e-6 * b])
        h = np.array([[(w * x * x).sum() + 1e-6, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return max(a, 1e-3), b


_matchers: dict[int, Matcher] = {}


def _matcher(broadcast) -> Matcher:
    key = id(broadcast.value)
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(broadcast.value)
    return _matchers[key]


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1, higher: likelier toxic), predicted (1 if score >= threshold), n_hits for each row of ``docs``.

    Null and empty texts have no match and get the score of that; a null doc_id stays null; repeated rows are scored
    each on its own; an empty table gives no rows. Whole texts are matched, in the task that reads them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            strengths, counts = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(1)):
                folded = fold(text.as_py())
                hits = matcher.hits(folded)
                if hits:
                    strengths[i], counts[i] = sum(w for _, _, w in hits) / math.log2(2 + len(folded.split())), len(hits)
            scores = 1 / (1 + np.exp(-np.clip(matcher.lexicon.slope * strengths + matcher.lexicon.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(counts)], ["doc_id", "score", "n_hits"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text")).mapInArrow(run, "doc_id long, score double, n_hits long")
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")


def kept(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with docs' columns, whatever their names; a score equal to it goes.
    Null and empty texts have the score of no match; repeated rows are judged each on its own; an empty table gives no
    rows. At a threshold of 0 no row stays, above 1 all do."""
    shared, columns = docs.sparkSession.sparkContext.broadcast(lexicon), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        odds = math.log(threshold / (1 - threshold)) if 0 < threshold < 1 else math.copysign(math.inf, threshold - 0.5)
        least = (odds - matcher.lexicon.bias) / matcher.lexicon.slope
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([matcher.strength(t.as_py() or "") < least for t in texts], pa.bool_())).select(columns)

    return docs.mapInArrow(run, docs.schema)


def training_labels(labels: DataFrame, folds: int = 4, fold_out: int = 2) -> DataFrame:
    """The labels that may be learnt from: those of rows that aren't held out."""
    return labels.filter(~held_out("doc_id", folds, fold_out))

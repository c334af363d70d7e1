"""Class-based n-gram scoring: exchange clustering assigns words to classes; class transitions times word emissions give the
probability of a text.

Texts are cut into chunks, which keep their words as numbers into the chunk's own word list, and tell the shards of words
(by hash) their lists and training counts; shards answer with what is known of each word over all chunks. So every count
is a join by shards, however many words there are. Exchange clustering starts on the driver with the commonest words (a
bounded number that only seeds the classes), from their bigram counts over all training text. Then all words make exchange
steps, round by round: chunks tell the shards next to which classes each word stands, and in its shard a word moves to the
class that raises the likelihood most, given all words' classes before the round.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countaxis.llm.shared import LOWER, NOT_SPACE, as_text, chunks, forget, freed, mixed, span_hash, stored, word_spans, tidy
from countaxis.llm.suffix_dedup import ROWS, _kinds, packed, rows_of, split_by, unpacked

SEQUENCES, WORDS, COUNTS, TOP, VOCABULARY, ONCE, TWICE, TOKENS, BIGRAMS, VOTES, CLASSES = range(11)
#: kind of the rows with a class's number of words: this and the class.
SIZES = 100
DOCUMENT = np.dtype([("id", "<i8"), ("null", "<u1"), ("held", "<u1"), ("n", "<u4")])
SHARD = np.dtype([("shard", "<i8"), ("n", "<u4")])
TOKEN = np.dtype([("token", "<u4")])
TOLD = np.dtype([("gap", "<u8"), ("count", "<u4")])
TOTAL = np.dtype([("count", "<u8")])
FREQUENT = np.dtype([("place", "<u4"), ("word", "<u8")])
PAIR = np.dtype([("pair", "<u4"), ("count", "<u8")])
VOTE = np.dtype([("place", "<u4"), ("code", "<u2"), ("count", "<u4")])
CLASS = np.dtype([("cls", "<u1")])
UNKNOWN = 255
#: Bytes of text in a chunk: larger ones repeat fewer words of other chunks in what they tell.
LM_CHUNK = 4 << 20
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


@dataclass(frozen=True)
class Settings:
    """classes: that words are clustered into; clustered: commonest words that the driver exchanges first, each at least a
    ``share`` of all tokens; rounds: of that; spread: rounds of exchange of all words after they have a first class; smooth:
    tokens' worth of the class unigram in each class's transitions."""

    classes: int = 64
    clustered: int = 1000
    share: float = 1e-4
    rounds: int = 8
    spread: int = 1
    smooth: float = 20.0

    @property
    def alone(self) -> int:
        """The class of words next to no clustered word."""
        return self.classes

    @property
    def end(self) -> int:
        """The class of the end token, which is the context of a text's first word too."""
        return self.classes + 1

    @property
    def all(self) -> int:
        return self.classes + 2


def _number(x: int) -> bytes:
    return int(x).to_bytes(8, "little", signed=True)


def _cut(shards: int, key: int):
    """Chunks: their documents and token sequences (0 the end, then the chunk's words in the order of shards and hashes), and
    their words for the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "text", LM_CHUNK):
            data = LOWER[data]
            starts, ends, row = word_spans(data, offsets, NOT_SPACE)
            n = np.bincount(row, minlength=batch.num_rows) if len(starts) else np.zeros(batch.num_rows, np.int64)
            words, place = np.unique(span_hash(data, starts, ends, 0, key), return_inverse=True)
            shard = (mixed(words) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            docs = np.empty(batch.num_rows, DOCUMENT)
            docs["id"], docs["null"], docs["held"], docs["n"] = np.asarray(batch.column(0).fill_null(0)), np.asarray(batch.column(0).is_null()), np.asarray(batch.column(1)), n + 1
            sequence = np.zeros(int(docs["n"].sum()), TOKEN)
            inside = np.ones(len(sequence), bool)
            inside[np.cumsum(n + 1) - 1] = False
            sequence["token"][inside] = number[place] + 1
            train = np.bincount(number[place], weights=docs["held"][row] == 0, minlength=len(words)).astype(np.int64) if len(words) else np.zeros(0, np.int64)
            words, shard = words[order], shard[order]
            grp, rows, table = secrets.randbits(62), [], []
            for s, members in split_by(shard):
                told = np.empty(len(members), TOLD)
                told["gap"], told["count"] = np.diff(words[members], prepend=np.uint64(0)), train[members]
                table.append((s, len(members)))
                rows.append((s, WORDS, packed(told, _number(grp))))
            shape = packed(np.array(table, SHARD).reshape(-1) if table else np.empty(0, SHARD))
            rows.append((grp, SEQUENCES, packed(docs, _number(len(shape)) + shape + packed(sequence))))
            rows.append((int(docs["n"][docs["held"] == 0].sum()), TOKENS, b""))
            yield rows_of(rows)

    return run


class Chunk:
    def __init__(self, table: pa.Table):
        self.totals = self.classes = None
        self.frequent: list[tuple[np.ndarray, np.ndarray]] = []
        answers: dict[int, list[bytes]] = {COUNTS: [], CLASSES: []}
        for kind, blob in _kinds(table):
            if kind == SEQUENCES:
                self.docs, tail = unpacked(blob, DOCUMENT)
                size = int.from_bytes(tail[:8], "little")
                self.shards = unpacked(tail[8 : 8 + size], SHARD)[0]
                self.sequence = unpacked(tail[8 + size :], TOKEN)[0]["token"].astype(np.int64)
            else:
                answers[kind].append(blob)
        first = np.concatenate(([0], np.cumsum(self.shards["n"].astype(np.int64))))
        at = dict(zip(self.shards["shard"].tolist(), first.tolist(), strict=False))
        self.words = int(first[-1])
        if answers[COUNTS]:
            self.totals = np.zeros(self.words + 1, np.int64)
            for blob in answers[COUNTS]:
                totals, tail = unpacked(blob, TOTAL)
                low = at[int.from_bytes(tail[:8], "little", signed=True)]
                self.totals[low + 1 : low + 1 + len(totals)] = totals["count"]
                frequent = unpacked(tail[8:], FREQUENT)[0]
                self.frequent.append((frequent["place"].astype(np.int64) + low + 1, frequent["word"]))
        if answers[CLASSES]:
            self.classes = np.zeros(self.words + 1, np.uint8)
            for blob in answers[CLASSES]:
                classes, tail = unpacked(blob, CLASS)
                low = at[int.from_bytes(tail[:8], "little", signed=True)]
                self.classes[low + 1 : low + 1 + len(classes)] = classes["cls"]
        self.held = np.repeat(self.docs["held"], self.docs["n"]).astype(bool)

    def numbered(self, top: np.ndarray, numbers: np.ndarray, end: int) -> np.ndarray:
        """For the end and each word its number, if it is one of ``top`` (sorted hashes), else -1."""
        out = np.full(self.words + 1, -1, np.int64)
        out[0] = end
        for places, words in self.frequent:
            at = np.minimum(np.searchsorted(top, words), max(len(top) - 1, 0))
            hit = top[at] == words if len(top) else np.zeros(len(words), bool)
            out[places[hit]] = numbers[at[hit]]
        return out

    def before(self, of: np.ndarray, end: int) -> np.ndarray:
        """What stands before each token (before a text's first token: the end)."""
        out = np.empty_like(of)
        if len(of):
            out[1:], out[0] = of[:-1], end
            out[np.concatenate(([0], np.cumsum(self.docs["n"].astype(np.int64))[:-1]))] = end
        return out


def _joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Of a shard: its words, the training count of each, and for each chunk its number and its words' places."""
    told, groups = [], []
    for kind, blob in _kinds(table):
        if kind == WORDS:
            x, tail = unpacked(blob, TOLD)
            told.append((np.cumsum(x["gap"]), x["count"].astype(np.int64)))
            groups.append(int.from_bytes(tail[:8], "little", signed=True))
    words, place = np.unique(np.concatenate([w for w, _ in told]), return_inverse=True)
    totals = np.bincount(place, weights=np.concatenate([c for _, c in told])).astype(np.int64)
    edges = np.cumsum([0, *(len(w) for w, _ in told)]).tolist()
    return words, totals, [(g, place[a:b]) for g, a, b in zip(groups, edges[:-1], edges[1:], strict=True)]


def _count(least: float):
    def run(table: pa.Table) -> pa.Table:
        shard = _number(table.column("grp")[0].as_py())
        words, totals, parts = _joined(table)
        often = totals >= least
        rows = []
        for grp, place in parts:
            counts = np.empty(len(place), TOTAL)
            counts["count"] = totals[place]
            at = np.flatnonzero(often[place])
            frequent = np.empty(len(at), FREQUENT)
            frequent["place"], frequent["word"] = at, words[place[at]]
            rows.append((grp, COUNTS, packed(counts, shard + packed(frequent))))
        rows += [(int(w), TOP, int(n).to_bytes(8, "big")) for w, n in zip(words[often].view(np.int64), totals[often], strict=True)]
        rows += [(int((totals > 0).sum()), VOCABULARY, b""), (int((totals == 1).sum()), ONCE, b""), (int((totals == 2).sum()), TWICE, b"")]
        return pa.Table.from_batches([rows_of(rows)])

    return tidy(run)


def _bigrams(top: np.ndarray, settings: Settings):
    """Counts of pairs of clustered words (and the end) next to each other in training texts."""
    m = len(top)

    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        now = chunk.numbered(top, np.arange(m), m)[chunk.sequence]
        last = chunk.before(now, m)
        use = (now >= 0) & (last >= 0) & ~chunk.held
        pairs, counts = np.unique(last[use] * (m + 1) + now[use], return_counts=True)
        out = np.empty(len(pairs), PAIR)
        out["pair"], out["count"] = pairs, counts
        return pa.Table.from_batches([rows_of([(g, BIGRAMS, packed(out[members])) for g, members in split_by(pairs // (16 * (m + 1)))])])

    return tidy(run)


def _sum_bigrams(table: pa.Table) -> pa.Table:
    x = np.concatenate([unpacked(b, PAIR)[0] for _, b in _kinds(table)])
    pairs, place = np.unique(x["pair"], return_inverse=True)
    out = np.empty(len(pairs), PAIR)
    out["pair"], out["count"] = pairs, np.bincount(place, weights=x["count"].astype(float))
    return pa.Table.from_batches([rows_of([(table.column("grp")[0].as_py(), BIGRAMS, packed(out))])])


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Classes of words 0 ... m-1 by exchange clustering, from a matrix of bigram counts whose last row and column are the
    end's, which has a class of its own (``classes``). Words start in turn over the classes; each word moves to the
    class that raises the likelihood of the class bigrams most, until a round moves none or ``rounds`` are over."""
    m = len(bigrams) - 1
    where = np.append(np.arange(m) % classes, classes)
    k = classes + 1
    one = np.eye(k)[where]
    right, left = bigrams @ one, bigrams.T @ one  # class counts after and before each word
    n = one.T @ right
    for _ in range(rounds):
        moved = 0
        for w in range(m):
            a, self_ = where[w], bigrams[w, w]
            r, l = right[w].copy(), left[w].copy()  # noqa: E741
            r[a] -= self_
            l[a] -= self_
            n[a] -= r
            n[:, a] -= l
            n[a, a] -= self_
            rows, columns = n.sum(1), n.sum(0)
            gain = (xlogx(n + l[:, None]) - xlogx(n)).sum(0) + (xlogx(n + r[None, :]) - xlogx(n)).sum(1)
            own = np.diag(n)
            gain += xlogx(own + l + r + self_) - xlogx(own + l) - xlogx(own + r) + xlogx(own)
            gain -= xlogx(rows + r.sum() + self_) - xlogx(rows) + xlogx(columns + l.sum() + self_) - xlogx(columns)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            n[b] += r
            n[:, b] += l
            n[b, b] += self_
            if b != a:
                moved += 1
                where[w] = b
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w]
                left[:, b] += bigrams[w]
        if not moved:
            break
    return where[:m]


def _vote(top: np.ndarray, classes: np.ndarray, settings: Settings):
    """For each other word of a chunk, the classes of clustered words before and after it in training texts."""

    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        known = chunk.numbered(top, classes, settings.end)
        now = known[chunk.sequence]
        return _told_votes(chunk, table.column("grp")[0].as_py(), now, (now < 0) & ~chunk.held, settings)

    return tidy(run)


def _vote_all(settings: Settings):
    """For each word of a chunk, the classes of what stands before and after it in training texts."""

    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        return _told_votes(chunk, table.column("grp")[0].as_py(), _classes(chunk, settings), (chunk.sequence > 0) & ~chunk.held, settings)

    return tidy(run)


def _told_votes(chunk: Chunk, grp: int, now: np.ndarray, open_: np.ndarray, settings: Settings) -> pa.Table:
    """For the words of the places ``open_`` the classes beside them (``now``; below 0 there is none), for their shards."""
    votes = []
    for side, other in ((0, chunk.before(now, settings.end)), (1, np.append(now[1:], settings.end))):
        use = open_ & (other >= 0)
        votes.append(chunk.sequence[use] * (2 * settings.all) + side * settings.all + other[use])
    codes, counts = np.unique(np.concatenate(votes), return_counts=True)
    place, code = codes // (2 * settings.all) - 1, codes % (2 * settings.all)
    first = np.concatenate(([0], np.cumsum(chunk.shards["n"].astype(np.int64))))
    home = np.searchsorted(first, place, "right") - 1
    rows = []
    for s, members in split_by(home):
        out = np.empty(len(members), VOTE)
        out["place"], out["code"], out["count"] = place[members] - first[s], code[members], counts[members]
        rows.append((int(chunk.shards["shard"][s]), VOTES, packed(out, _number(grp))))
    return pa.Table.from_batches([rows_of(rows)])


def _choose(top: np.ndarray, classes: np.ndarray, transitions: np.ndarray, settings: Settings):
    """The exchange step of a shard's words against the classes so far (``top`` stay in theirs): the class that raises the
    likelihood most. Gains are summed as integers, so that they don't depend on the order in which chunks tell."""
    k = settings.classes
    size = np.log(transitions.sum(0)[:k] + 1.0)
    into = np.log(transitions[:, :k] + 0.1)  # from the class before, to each class
    out_of = np.log(transitions[:k] + 0.1).T  # to the class after, from each class
    weight = np.rint((np.concatenate((into, out_of)) - size) * (1 << 20)).astype(np.int64)

    def run(table: pa.Table) -> pa.Table:
        shard = _number(table.column("grp")[0].as_py())
        words, totals, parts = _joined(table)
        places = dict(parts)
        likelihood, voted = np.zeros((len(words), k), np.int64), np.zeros(len(words), bool)
        for kind, blob in _kinds(table):
            if kind == VOTES:
                votes, tail = unpacked(blob, VOTE)
                word = places[int.from_bytes(tail[:8], "little", signed=True)][votes["place"]]
                voted[word] = True
                for low in range(0, len(votes), 1 << 16):
                    part = slice(low, low + (1 << 16))
                    w, edge = np.unique(word[part], return_index=True)  # words come in order within a chunk
                    likelihood[w] += np.add.reduceat(weight[votes["code"][part]] * votes["count"][part][:, None].astype(np.int64), edge)
        chosen = np.where(voted, np.argmax(likelihood, 1), settings.alone).astype(np.uint8)
        if len(top):
            at = np.minimum(np.searchsorted(top, words), len(top) - 1)
            chosen = np.where(top[at] == words, classes[at], chosen).astype(np.uint8)
        chosen[totals == 0] = UNKNOWN
        rows = [(int(n), SIZES + c, b"") for c, n in enumerate(np.bincount(chosen[totals > 0], minlength=settings.all))]
        for grp, place in parts:
            rows.append((grp, CLASSES, packed(chosen[place].view(CLASS), shard)))
        return pa.Table.from_batches([rows_of(rows)])

    return tidy(run)


def _transitions(settings: Settings):
    """Counts of class pairs in training texts, cell by cell."""

    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        classes = _classes(chunk, settings)
        last = chunk.before(classes, settings.end)
        cells = np.bincount((last * settings.all + classes)[~chunk.held], minlength=settings.all**2)
        at = np.flatnonzero(cells)
        return pa.table({"cell": pa.array(at, pa.int64()), "n": pa.array(cells[at], pa.int64())})

    return tidy(run)


def _classes(chunk: Chunk, settings: Settings) -> np.ndarray:
    of = np.zeros(1, np.int64) if chunk.classes is None else chunk.classes.astype(np.int64)
    of[0] = settings.end
    return of[chunk.sequence]


@dataclass(frozen=True)
class Model:
    """log10 of P(class | class before), rows also for an unknown word before (last); of the discounted class sizes; of an
    unknown word after each class; and the figures of the base."""

    steps: np.ndarray
    unseen: np.ndarray
    sizes: np.ndarray
    discount: float
    tokens: int
    words: int


def model_of(transitions: np.ndarray, sizes: np.ndarray, discount: float, tokens: int, words: int, smooth: float) -> Model:
    """P(w | v) = P(class w | class v) * (count w - discount) / count of class w. What the discount leaves of each class is the
    unknown word's, so all words and one unknown word have a sum of one after any context; after an unknown word the class
    unigram is used."""
    total = transitions.sum(0).astype(float)
    k = len(total)
    unigram = (total + 1e-9) / (total + 1e-9).sum()
    step = np.vstack([(transitions + smooth * unigram) / (transitions.sum(1)[:, None] + smooth), unigram])
    left = np.where(total > 0, discount * sizes / np.maximum(total, 1), 1.0)
    return Model(np.log10(np.maximum(step, 1e-300)), np.log10(np.maximum(step @ left, 1e-300)), np.maximum(total, 1), discount, tokens, words) if k else None


def _score(model: Model, settings: Settings):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        totals = np.zeros(1, np.int64) if chunk.totals is None else chunk.totals
        totals[0] = model.sizes[settings.end] if model.tokens else 0
        counts = totals[chunk.sequence].astype(float)
        classes = _classes(chunk, settings)
        unknown = counts == 0
        state = np.where(unknown, settings.all, classes)
        last = chunk.before(state, settings.end)
        known_class = np.where(unknown, 0, classes)
        logs = np.where(unknown, model.unseen[last], model.steps[last, known_class] + np.log10(np.maximum(counts - np.where(classes == settings.end, 0, model.discount), 1e-9)) - np.log10(model.sizes[known_class]))
        base = np.log10((counts + 1) / (model.tokens + model.words + 1))
        edges = np.concatenate(([0], np.cumsum(chunk.docs["n"].astype(np.int64))[:-1]))
        sums = [np.add.reduceat(x, edges) if len(x) else np.zeros(0) for x in (~unknown * 1, base, logs)]
        return pa.table([pa.array(chunk.docs["id"], pa.int64(), mask=chunk.docs["null"].astype(bool)), pa.array(chunk.docs["held"].astype(bool)), pa.array(chunk.docs["n"].astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], schema=schema)

    return tidy(run)


def score_texts(docs: DataFrame, held_out, settings: Settings = Settings(), shards: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs`` (doc_id, text).

    ``held_out``: a column over docs, true for rows that are not learnt from. Tokens are words (bytes other than white space
    20, 09-0D; A-Z lower-cased), then one end. base_score: the sum of log10((c + 1) / (N + V + 1)) over tokens, c the token's
    count, N all and V distinct tokens in training texts; score: log10 of the text's probability by the class model.
    Null and empty texts are one end; a null doc_id stays null; repeated rows are scored, and learnt from, each on its own;
    an empty table gives no rows; with no training rows all tokens are unknown; other columns don't matter, whatever their
    names; of equally good classes the first is taken. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    shards = shards or 3 * max(8, docs.rdd.getNumPartitions())
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), as_text().alias("text"))
    # The key of the words' hashes is the corpus's own: as hard to foresee as all its texts, and the same in each run over them.
    own = source.agg(F.bit_xor(F.xxhash64("text")), F.sum(F.xxhash64("text", "doc_id") % (1 << 40))).head()
    cut = stored(source.mapInArrow(_cut(shards, ((own[0] or 0) ^ (own[1] or 0)) & (1 << 63) - 1), ROWS), "lm-chunks")
    of = lambda frame, *kinds: frame.filter(F.col("kind").isin(*kinds))
    tokens = of(cut, TOKENS).agg(F.sum("grp")).head()[0] or 0
    counted = stored(of(cut, WORDS).groupBy("grp").applyInArrow(_count(max(2, settings.share * tokens)), ROWS), "lm-counts")
    figures = {r.kind: r.n for r in of(counted, VOCABULARY, ONCE, TWICE).groupBy("kind").agg(F.sum("grp").alias("n")).collect()}
    words, once, twice = (figures.get(k, 0) for k in (VOCABULARY, ONCE, TWICE))
    top = np.array([r.grp for r in of(counted, TOP).orderBy(F.desc("blob"), "grp").limit(settings.clustered).collect()], np.int64).view(np.uint64)
    by_count, top = top, np.sort(top)

    sequences, totals = of(cut, SEQUENCES), of(counted, COUNTS)
    pairs = sequences.unionByName(totals).groupBy("grp").applyInArrow(_bigrams(top, settings), ROWS)
    bigrams = np.zeros((len(top) + 1, len(top) + 1))
    for r in pairs.groupBy("grp").applyInArrow(_sum_bigrams, ROWS).collect():  # (clustered + 1) ** 2 cells at most
        x, _ = unpacked(r.blob, PAIR)
        bigrams.flat[x["pair"]] = x["count"]
    freed(spark)
    order = np.searchsorted(top, by_count)  # commonest first, so that words start in classes by their counts
    full = np.append(order, len(top))
    classes = np.empty(len(top), np.int64)
    classes[order] = exchange(bigrams[np.ix_(full, full)], settings.classes, settings.rounds)

    one = np.zeros((len(top) + 1, settings.all))
    one[np.arange(len(top) + 1), np.append(classes, settings.end).astype(int)] = 1
    votes = sequences.unionByName(totals).groupBy("grp").applyInArrow(_vote(top, classes, settings), ROWS)
    chosen = of(cut, WORDS).unionByName(votes).groupBy("grp").applyInArrow(_choose(top, classes, one.T @ bigrams @ one, settings), ROWS)
    chosen = stored(chosen, "lm-classes")
    def transitions(classes: DataFrame) -> np.ndarray:
        cells = sequences.unionByName(of(classes, CLASSES)).groupBy("grp").applyInArrow(_transitions(settings), "cell long, n long")
        out = np.zeros(settings.all**2)
        for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # all ** 2 cells at most
            out[r.cell] = r.n
        freed(spark)
        return out.reshape(settings.all, -1)

    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for _ in range(settings.spread):
        before, step = chosen, transitions(chosen)
        votes = sequences.unionByName(of(chosen, CLASSES)).groupBy("grp").applyInArrow(_vote_all(settings), ROWS)
        chosen = stored(of(cut, WORDS).unionByName(votes).groupBy("grp").applyInArrow(_choose(*none, step, settings), ROWS), "lm-classes")
        forget(before)
    sizes = np.zeros(settings.all)
    for r in chosen.filter(F.col("kind") >= SIZES).groupBy("kind").agg(F.sum("grp").alias("n")).collect():
        sizes[r.kind - SIZES] = r.n
    steps = transitions(chosen)
    named = sequences.unionByName(of(chosen, CLASSES))
    freed(spark)
    ends = bool(tokens)
    model = model_of(steps, sizes, once / (once + 2 * twice) if once else 0.5, tokens, words + ends, settings.smooth)
    scored = named.unionByName(totals).groupBy("grp").applyInArrow(_score(model, settings), SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


"""N-gram Jaccard join: documents linked by the similarity of their shingle sets, by prefix filter and T-occurrence search.

1. Documents are dealt to groups; each group tells the shards of shingles which it has, and learns for each shingle whether
   it is in one document only, in several, or in very many (over a share of all documents).
2. Under the order rare, shared, very common, then by hash, two sets of similarity t have a shingle in common among the first
   n - ceil(t * n) + 1 of each. Most documents have rare shingles only there and can be linked with nothing. The others send
   the shared shingles of that prefix to the shards, where those of one shingle form an inverted list.
3. Equal sets are one set throughout. Sets on a list are searched by T-occurrence (DivideSkip): lists of shingles of a group
   of sets are split into long and short ones, the short ones are merged, and sets that the long ones can still lift to the
   required overlap are probed for there. First each list is searched around its smallest member only, then, of lists that
   still hold unconnected sets, all; before full sets are sent, bitmaps of the sets rule out what differs too much. Groups of more sets than fit a task are cut into blocks, and pairs of blocks searched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from countaxis.llm.components import components
from countaxis.llm.shared import BROADCAST_ROWS, HOT_KEYS, HOT_ROWS, as_text, column_bytes, forget, free_names, mixed, new_key, skew_join, small, stored, tidy
from countaxis.llm.shingles import shingle_sets
from countaxis.llm.suffix_dedup import NO_ID, ROWS, _deal, _kinds, documents, packed, rows_of, split_by, unpacked

TEXTS, SHINGLES, CODES, DOCUMENTS, SETS, ENTRIES = range(6)
KEYS = ("_id", "_row", "_bytes")
COUNTED = np.dtype([("gap", "<u8"), ("count", "<u4")])
CODE = np.dtype([("code", "<u1")])
DOCUMENT = np.dtype([("id", "<i8"), ("row", "<i8"), ("set", "<i8"), ("n", "<i8")])
ENTRY = np.dtype([("shingle", "<u8"), ("set", "<i8"), ("n", "<i8")])
#: Sets searched together at most; a list of more is cut into blocks, and all pairs of blocks are searched.
BLOCK = 2048
#: A shingle in more documents than this share of all (and than MANY) is very common.
COMMON_SHARE, MANY = 0.001, 256
RARE, SHARED, COMMON = range(3)


def count_bits(documents: int) -> int:
    """Bits of a shingle's hash that are counted, by the number of documents; shingles that agree in them count as one, which
    only makes more candidates."""
    return min(64, max(40, documents.bit_length() + 24))


class Sets:
    """The distinct shingle sets of a group of documents, and each document's set."""

    def __init__(self, table: pa.Table, schema: pa.Schema, width: int, shards: int, bits: int, key: int):
        ids, tags, sets, sizes, shingles = [], [], [], [], []
        self.known: dict[int, int] = {}
        for batch in documents(table, schema):
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                all_, offsets = shingle_sets(*column_bytes(part.column(2)), width, key)
                ids += part.column(0).to_pylist()
                tags += part.column(1).to_pylist()
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = all_[a:b]
                    name = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)
                    if name not in self.known:
                        self.known[name] = len(shingles)
                        shingles.append(own)
                    sets.append(name)
                    sizes.append(b - a)
        self.documents = np.empty(len(ids), DOCUMENT)
        for name, x in (("id", ids), ("row", tags), ("set", sets), ("n", sizes)):
            self.documents[name] = x
        self.names = np.array(list(self.known), np.int64)
        self.sizes = np.array([len(x) for x in shingles], np.int64)
        self.shingles = np.concatenate([np.zeros(0, np.uint64), *shingles])
        self.distinct, self.place, self.counts = np.unique(self.shingles >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
        self.shard = (mixed(self.distinct) % np.uint64(shards)).astype(np.int64)


def _tell_shingles(schema: pa.Schema, width: int, shards: int, bits: int, key: int):
    def run(table: pa.Table) -> pa.Table:
        sets, rows = Sets(table, schema, width, shards, bits, key), []
        for s, members in split_by(sets.shard):
            out = np.empty(len(members), COUNTED)
            out["gap"], out["count"] = np.diff(sets.distinct[members], prepend=np.uint64(0)), sets.counts[members]
            rows.append((s, SHINGLES, packed(out, int(table.column("grp")[0].as_py()).to_bytes(8, "little"))))
        return pa.Table.from_batches([rows_of(rows)])

    return tidy(run)


def _count_shingles(common: int):
    """Of a shard: for each group that told its shingles, whether they are rare, shared or common."""

    def run(table: pa.Table) -> pa.Table:
        told, groups = [], []
        for _, blob in _kinds(table):
            counted, tail = unpacked(blob, COUNTED)
            told.append((np.cumsum(counted["gap"]), counted["count"]))
            groups.append(int.from_bytes(tail, "little"))
        _, place = np.unique(np.concatenate([s for s, _ in told]), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([c for _, c in told]))[place]
        code = np.full(len(place), RARE, np.uint8)
        code[total > 1] = SHARED
        code[total > common] = COMMON
        parts = np.split(code, np.cumsum([len(s) for s, _ in told])[:-1])
        shard = int(table.column("grp")[0].as_py()).to_bytes(8, "little")
        return pa.Table.from_batches([rows_of([(g, CODES, packed(p.view(CODE), shard)) for g, p in zip(groups, parts, strict=True)])])

    return tidy(run)


def least_overlap(n: np.ndarray | int, percent: int):
    """The overlap that a set of n needs at least with any set of that similarity: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def _prefixes(schema: pa.Schema, width: int, shards: int, bits: int, percent: int, key: int):
    """All documents' sets; of sets that can be linked, their shared shingles, and the shared ones of their prefixes."""

    def run(table: pa.Table) -> pa.Table:
        codes = {}
        for kind, blob in _kinds(table):
            if kind == CODES:
                code, tail = unpacked(blob, CODE)
                codes[int.from_bytes(tail, "little")] = code["code"]
        sets = Sets(table, schema, width, shards, bits, key)
        rows = [(0, DOCUMENTS, packed(sets.documents))] if len(sets.documents) else []
        code = np.zeros(len(sets.distinct), np.uint8)
        for s, members in split_by(sets.shard):
            code[members] = codes[s]
        code = code[sets.place]
        owner = np.repeat(np.arange(len(sets.sizes)), sets.sizes)
        shared = np.bincount(owner, weights=code > RARE, minlength=len(sets.sizes)).astype(np.int64)
        need = least_overlap(sets.sizes, percent)
        linkable = (sets.sizes > 0) & (shared >= need)
        keep = linkable[owner] & (code > RARE)
        owner, code, shingles = owner[keep], code[keep], sets.shingles[keep]
        if len(owner):
            order = np.lexsort((shingles, code, owner))
            owner, shingles = owner[order], shingles[order]
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner, "left")
            first = rank < (sets.sizes - need + 1 - (sets.sizes - shared))[owner]
            out = np.empty(int(first.sum()), ENTRY)
            out["shingle"], out["set"], out["n"] = shingles[first], sets.names[owner[first]], sets.sizes[owner[first]]
            rows += [(s, ENTRIES, packed(out[members])) for s, members in split_by((out["shingle"] % np.uint64(shards)).astype(np.int64))]
            edges = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                k = owner[a]
                head = np.array([sets.names[k], sets.sizes[k]], "<i8").tobytes()
                rows.append((0, SETS, head + np.sort(shingles[a:b]).tobytes()))
        return pa.Table.from_batches([rows_of(rows)])

    return tidy(run)


LIST_SCHEMA = pa.schema([("list", pa.int64()), ("sets", pa.list_(pa.int64()))])


def _lists(percent: int):
    """The inverted lists of a shard, cut where sizes are too far apart for a link, each distinct list once."""

    def run(table: pa.Table) -> pa.Table:
        entries = np.concatenate([np.empty(0, ENTRY), *(unpacked(b, ENTRY)[0] for _, b in _kinds(table))])
        entries = entries[np.lexsort((entries["set"], entries["n"], entries["shingle"]))]
        if len(entries):
            new = np.concatenate(([True], (entries["set"][1:] != entries["set"][:-1]) | (entries["shingle"][1:] != entries["shingle"][:-1])))
            entries = entries[new]
        found: dict[int, list[int]] = {}
        if len(entries):
            n = entries["n"]
            cut = np.flatnonzero((entries["shingle"][1:] != entries["shingle"][:-1]) | (percent * n[1:] > 100 * n[:-1])) + 1
            edges = np.concatenate(([0], cut, [len(entries)]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > 1:
                    sets = np.sort(entries["set"][a:b])
                    found.setdefault(int.from_bytes(hashlib.blake2b(sets.tobytes(), digest_size=8).digest(), "little", signed=True), sets.tolist())
        return pa.table([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], schema=LIST_SCHEMA)

    return tidy(run)


class Forest:
    """Union-find over 0 ... n-1 with least roots."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def t_occurrence(lists: list[np.ndarray], required: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements that are on at least ``required`` of the sorted lists, and on how many (DivideSkip).

    The longest lists are set apart, as many as the method's rule says; the short ones are merged (a stable merge of sorted
    runs, which takes the heap's part); elements that the long lists can still lift to the required number are looked up
    in these by binary search.
    """
    lists = sorted(lists, key=len)
    longest = len(lists[-1]) if lists else 0
    n_long = min(max(required - 1, 0), int(required / (0.0085 * np.log2(max(longest, 2)) + 1)), len(lists))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    merged = np.sort(np.concatenate(short), kind="stable") if short else np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1]))) if len(merged) else np.zeros(0, np.int64)
    who, counts = merged[first], np.diff(np.append(first, len(merged)))
    left = n_long
    keep = counts >= required - left
    who, counts = who[keep], counts[keep]
    for probe in reversed(long):
        if not len(who):
            break
        at = np.searchsorted(probe, who)
        counts = counts + ((at < len(probe)) & (probe[np.minimum(at, len(probe) - 1)] == who))
        left -= 1
        keep = counts >= required - left
        who, counts = who[keep], counts[keep]
    return who, counts


def linked(names: np.ndarray, sizes: np.ndarray, roots: np.ndarray, shingles: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect a group's sets (roots: what is connected already): pairs of names, a spanning forest of them."""
    order = np.lexsort((names, sizes))
    names, sizes, roots, shingles = names[order], sizes[order], roots[order], [shingles[i] for i in order]
    forest, start = Forest(len(names)), {}
    for i, r in enumerate(roots.tolist()):
        forest.join(i, start.setdefault(r, i))
    owner = np.repeat(np.arange(len(names)), [len(x) for x in shingles])
    tokens = np.concatenate(shingles)
    by = np.lexsort((owner, tokens))
    tokens, owner = tokens[by], owner[by]
    edges = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1], [True])))
    place = np.empty(len(by), np.int64)
    place[by] = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    starts = np.concatenate(([0], np.cumsum([len(x) for x in shingles])))
    links = []
    total = percent + 100
    for q in range(len(names) - 1):
        if all(forest.root(x) == forest.root(q) for x in range(q + 1, len(names))) if len(names) <= 64 else False:
            continue
        required = int(-(-percent * 2 * int(sizes[q]) // total))  # with any set that is not smaller
        mine = place[starts[q] : starts[q + 1]]
        lists = [x for x in (owner[edges[t] : edges[t + 1]] for t in mine) if len(x) > 1]
        if len(lists) < required:
            continue
        who, counts = t_occurrence(lists, required)
        later = who > q
        for x, overlap in zip(who[later].tolist(), counts[later].tolist(), strict=True):
            if forest.root(x) != forest.root(q) and 100 * overlap >= percent * (int(sizes[q]) + int(sizes[x]) - overlap):
                forest.join(x, q)
                links.append((int(names[q]), int(names[x])))
    return links


def _search(percent: int):
    """Rows sorted by group: links of each group's sets. Groups follow one another, so one is held at a time."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def finish() -> pa.RecordBatch:
            sets = {r[0]: r for r in rows}  # a set may be in both blocks of a pair
            rows_ = list(sets.values())
            found = linked(np.array([r[0] for r in rows_]), np.array([r[1] for r in rows_]), np.array([r[2] for r in rows_]), [np.frombuffer(r[3], "<u8") for r in rows_], percent) if len(rows_) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=schema)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for group, *row in zip(*columns, strict=True):
                if group != now:
                    if rows:
                        yield finish()
                    now, rows = group, []
                rows.append(row)
        if rows:
            yield finish()

    return run


def signature(shingles: np.ndarray) -> bytes:
    """A bitmap of at least two bits a shingle (a power of two, 64 or more) in which each shingle turns one bit over. Two sets
    differ in at least as many shingles as their bitmaps differ in bits; halves laid over each other give the shorter bitmap."""
    bits = max(64, 1 << int(2 * len(shingles) - 1).bit_length())
    places = (mixed(shingles) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def near_in(names: np.ndarray, sizes: np.ndarray, unshared: np.ndarray, roots: np.ndarray, signatures: list[bytes], percent: int) -> np.ndarray:
    """Sets that their signatures let be linked with a set of the group that they aren't connected with yet."""
    level = np.array([len(x) // 8 for x in signatures])
    keep = np.zeros(len(names), bool)
    for words in np.unique(level):
        some = np.flatnonzero(level >= words)
        folded = np.array([np.bitwise_xor.reduce(np.frombuffer(signatures[i], "<u8").reshape(-1, words), axis=0) for i in some])
        exact = level[some] == words
        n, u, r = sizes[some], unshared[some], roots[some]
        for i in range(len(some) - 1):
            rest = slice(i + 1, None)
            differ = np.bitwise_count(folded[rest] ^ folded[i]).sum(1, dtype=np.int64) + u[rest] + u[i]
            both = n[rest] + n[i]
            may = (differ <= both - 2 * -(-percent * both // (100 + percent))) & (r[rest] != r[i]) & (exact[rest] | exact[i])
            if may.any():
                keep[some[i]] = True
                keep[some[i + 1 :][may]] = True
    return keep


def _near(percent: int):
    """Rows sorted by group: the members of each group that near_in() keeps."""
    schema = pa.schema([("grp", pa.int64()), ("set", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def finish() -> pa.RecordBatch:
            names, sizes, unshared, roots, signatures = (list(x) for x in zip(*rows, strict=True))
            keep = near_in(np.array(names), np.array(sizes), np.array(unshared), np.array(roots), signatures, percent)
            names = np.array(names)[keep]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(names), now)), pa.array(names)], schema=schema)

        for batch in batches:
            for group, *row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if group != now:
                    if len(rows) > 1:
                        yield finish()
                    now, rows = group, []
                rows.append(row)
        if len(rows) > 1:
            yield finish()

    return run


def _blocks(lists: DataFrame, block: int) -> DataFrame:
    """grp, set: lists as groups of at most two blocks of sets; a list of one block is a group itself."""
    n = F.ceil(F.size("sets") / block).cast("int")
    one = lists.filter(F.size("sets") <= block).select(F.xxhash64("list").alias("grp"), F.explode("sets").alias("set"))
    many = lists.filter(F.size("sets") > block).withColumn("n", n)
    pairs = many.select("list", "sets", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select("list", "sets", "n", "i", F.explode(F.sequence(F.col("i"), F.col("n") - 1)).alias("j"))
    part = lambda k: F.slice("sets", k * block + 1, block)
    return one.unionByName(pairs.select(F.xxhash64("list", "i", "j").alias("grp"), F.explode(F.array_distinct(F.concat(part(F.col("i")), part(F.col("j"))))).alias("set")))


def _links(groups: DataFrame, sets: DataFrame, roots: DataFrame | None, percent: int) -> DataFrame:
    """Links within groups (grp, set). What the signatures rule out isn't sent: full sets go where a link is possible."""
    groups = groups.join(roots.select(F.col("node").alias("set"), "root"), "set", "left") if roots is not None else groups.withColumn("root", F.col("set"))
    signed = groups.join(sets.select("set", "n", "unshared", "signature"), "set").select("grp", "set", "n", "unshared", F.coalesce("root", "set").alias("root"), "signature")
    near = stored(signed.repartition("grp").sortWithinPartitions("grp").mapInArrow(_near(percent), "grp long, set long"), "near")
    rooted = near.join(roots.select(F.col("node").alias("set"), "root"), "set", "left") if roots is not None else near.withColumn("root", F.col("set"))
    rows = sets.select("set", "n", "shingles").join(small(stored(rooted, "near")), "set").select("grp", "set", "n", F.coalesce("root", "set").alias("root"), "shingles")
    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(_search(percent), "a long, b long")


def shingle_documents(docs: DataFrame, width: int = 5, percent: int = 75, block: int = BLOCK) -> DataFrame:
    """_id, _row, root, n_shingles, component_id, copies: one row for each distinct (doc_id, text) of ``docs``; _id is doc_id with
    the smallest long for null, _row a hash of the text, copies the number of rows that share both.

    Two documents are linked when 100 * |intersection| >= ``percent`` * |union| of their sets of shingles of ``width`` words; a
    text with fewer words is one shingle, one without words (null, empty) has none and is linked with nothing. component_id
    is the smallest doc_id that links lead to (null for a component of null ids only), root the same number for all of a
    component and no other. An empty table gives no rows.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(as_text()).alias("_row"), as_text().alias("_bytes"))
    groups = 8 * max(8, docs.rdd.getNumPartitions())
    shards = groups // 4  # fewer, so that a group's hashes for a shard lie close and take few bits
    schema = to_arrow_schema(keyed.schema)
    total = docs.count()
    common, bits = max(MANY, int(COMMON_SHARE * total)), count_bits(total)
    texts, key = keyed.mapInArrow(_deal(KEYS, groups), ROWS), new_key()
    told = texts.groupBy("grp").applyInArrow(_tell_shingles(schema, width, shards, bits, key), ROWS)
    codes = stored(told.groupBy("grp").applyInArrow(_count_shingles(common), ROWS), "shingle-codes")
    found = stored(texts.unionByName(codes).groupBy("grp").applyInArrow(_prefixes(schema, width, shards, bits, percent, key), ROWS), "shingle-sets")

    forget(codes)
    documents_ = stored(found.filter(F.col("kind") == DOCUMENTS).select("blob").mapInArrow(_document_rows, "_id long, _row long, set long, n_shingles long"), "documents")
    sets = found.filter(F.col("kind") == SETS).select("blob").mapInArrow(_set_rows, "set long, n long, unshared long, signature binary, shingles binary").dropDuplicates(["set"])
    sets = stored(sets, "linkable-sets")
    lists = found.filter(F.col("kind") == ENTRIES).groupBy("grp").applyInArrow(_lists(percent), "list long, sets array<long>")
    lists = stored(lists.dropDuplicates(["list"]), "lists")
    forget(found)

    # Around each list's smallest set first: what is copied often is connected by few comparisons.
    stars = stored(lists.select(F.element_at("sets", 1).alias("hub"), F.explode("sets").alias("set")).distinct(), "stars")
    sizes = stars.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("int").alias("n")).filter("n > 1")  # few, and mostly none
    dealt = stars.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, "hub", "left")
    blocks = F.coalesce("n", F.lit(1))
    dealt = dealt.withColumn("part", F.when(F.col("hub") == F.col("set"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("set"), blocks).cast("int"))))
    dealt = dealt.select("hub", "set", F.explode("part").alias("part")).select(F.xxhash64("hub", "part").alias("grp"), "set")
    near = stored(_links(dealt, sets, None, percent), "links")
    roots = components(near)

    # Then all lists that hold sets not connected yet.
    members = lists.select("list", F.explode("sets").alias("set")).join(roots.select(F.col("node").alias("set"), "root"), "set", "left")
    open_ = members.groupBy("list").agg(F.min(F.coalesce("root", "set")).alias("low"), F.max(F.coalesce("root", "set")).alias("high")).filter("low <> high").select("list")
    more = stored(_links(_blocks(lists.join(open_, "list"), block), sets, roots, percent), "links")
    roots = components(near.unionByName(more))

    classed = documents_.join(roots.select(F.col("node").alias("set"), "root"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    classed = stored(classed.groupBy("_id", "_row", "root", "n_shingles").agg(F.count("*").alias("copies")), "classes")
    forget(documents_, sets, lists, stars, near, more)
    some = classed.filter("n_shingles > 0")
    least = stored(some.groupBy("root").agg(F.min(F.when(F.col("_id") > NO_ID, F.col("_id"))).alias("least"), F.count("*").alias("n")), "least")
    rows = classed.count()
    hot = least.filter(F.col("n") > max(HOT_ROWS, rows // HOT_KEYS)).select("root")
    named = skew_join(classed, least.drop("n"), ["root"], rows, how="left", hot=hot)
    return named.select("_id", "_row", "root", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.when(F.col("_id") > NO_ID, F.col("_id"))).alias("component_id"), "copies")


def _document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            x, _ = unpacked(blob, DOCUMENT)
            yield pa.RecordBatch.from_arrays([pa.array(x[name]) for name in DOCUMENT.names], ["_id", "_row", "set", "n_shingles"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = batch.column(0).to_pylist()
        if not blobs:
            continue
        heads = np.frombuffer(b"".join(b[:16] for b in blobs), "<i8").reshape(-1, 2)
        unshared = heads[:, 1] - np.array([len(b) // 8 - 2 for b in blobs])
        signatures = [signature(np.frombuffer(b, "<u8", offset=16)) for b in blobs]
        yield pa.RecordBatch.from_arrays([pa.array(heads[:, 0]), pa.array(heads[:, 1]), pa.array(unshared), pa.array(signatures, pa.binary()), pa.array([b[16:] for b in blobs], pa.binary())], ["set", "n", "unshared", "signature", "shingles"])


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``; see shingle_documents()."""
    found = shingle_documents(docs, width, percent)
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(F.when(F.col("_id") > NO_ID, F.col("_id")).alias("doc_id"), "n_shingles", "component_id")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """One row of ``docs`` for each component, with docs' columns: that with the smallest doc_id (null only if all are), then the
    smallest hash of its text. So texts that share an id or have none stay if nothing links them. Texts without words are no
    one's duplicates and all stay, but for rows that repeat doc_id and text."""
    found = shingle_documents(docs, width, percent)
    first = F.min(F.struct((F.col("_id") == NO_ID).alias("none"), "_id", "_row", "copies")).alias("first")
    stays = found.filter("n_shingles > 0").groupBy("root").agg(first).select("first._id", "first._row", "first.copies")
    stays = stored(stays.unionByName(found.filter("n_shingles = 0").select("_id", "_row", "copies")), "stays")
    single = not stays.filter("copies > 1").limit(1).count()
    go_id, go_row, hashed = free_names(["_go_id", "_go_row", "_text_hash"], docs.columns)
    goes = stored(found.join(stays, ["_id", "_row"], "left_anti").select(F.col("_id").alias(go_id), F.col("_row").alias(go_row)), "goes")
    id_, row = F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), F.xxhash64(as_text())
    kept = docs.join(small(goes), (id_ == F.col(go_id)) & (row == F.col(go_row)), "left_anti")
    return kept if single else kept.withColumn(hashed, F.xxhash64(as_text())).dropDuplicates(["doc_id", hashed]).drop(hashed)

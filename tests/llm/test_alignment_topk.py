"""Alignment of tokenizers and exact top-k search against brute force, on the awkward rows too."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest

from countaxis.llm import alignment, queries, topk
from countaxis.llm.shared import stored

PATHS = [queries.tokenizer_path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
SCHEMA = "text string, pairs int, doc_id long, chunk string, groups string"


def texts():
    r = random.Random(2)
    words = "the of Größe naïve 日本語 tokenization é \U0001f600 don't  x=1; 12345 ﬁ ABC <0x41> <s> </s> <unk> <|endoftext|>".split(" ")
    rows = [" ".join(r.choice(words) for _ in range(r.choice([1, 2, 5, 40, 300]))) for _ in range(60)]
    rows += [None, "", " ", "\n", "\t\x00\x01", "a▁b", "▁", "x" * 5000, "same text", "same text", " lead", "trail  ", "\r\n\r\n", " ".join(r.choice(words) for _ in range(60_000))]
    return [(i if i % 17 else None, t) for i, t in enumerate(rows)] + [(1, "another text of one id"), (2, "same text")]


def brute(rows):
    a, b = (alignment.tokenizer(p) for p in PATHS)
    found, count = [], collections.Counter()
    for i, text in rows:
        text = text or ""
        ids_a, ids_b = a.ids([" " + text])[0], b.ids([" " + text])[0]
        want = (" " + text).encode()
        links, groups = [], []
        if text and b"".join(a.bytes_of[x] for x in ids_a) == want == b"".join(b.bytes_of[x] for x in ids_b):
            ends = lambda ids, t: np.cumsum([len(t.bytes_of[x]) for x in ids]).tolist()
            ends_a, ends_b = ends(ids_a, a), ends(ids_b, b)
            x = y = 0
            group = ([], [])
            seen = set()
            while x < len(ids_a) and y < len(ids_b):
                links.append((ids_a[x], ids_b[y]))
                for side, key, token in ((0, ("a", x), ids_a[x]), (1, ("b", y), ids_b[y])):
                    if key not in seen:
                        seen.add(key)
                        group[side].append(str(token))
                end = min(ends_a[x], ends_b[y])
                if ends_a[x] == ends_b[y]:
                    groups.append(",".join(group[0]) + "|" + ",".join(group[1]))
                    group = ([], [])
                x, y = x + (ends_a[x] == end), y + (ends_b[y] == end)
        else:
            ids_a = ids_b = []
        count.update(links)
        found.append((i, len(ids_a), len(ids_b), groups, links))
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    return [
        (i, n_a, n_b, len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for i, n_a, n_b, groups, links in found
    ]


def test_alignment(spark, tmp_path, monkeypatch):
    rows = texts()
    want = sorted(brute(rows), key=repr)
    frame = spark.createDataFrame([(t, 1, i, "c", "g") for i, t in rows], SCHEMA).repartition(3)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sum(w[1] == 0 for w in want) >= 4 and any(w[3] > 1000 for w in want)
    # The same from chunks of few documents, with the groups as texts.
    monkeypatch.setattr(alignment, "ALIGN_BYTES", 3000)
    whole = alignment.with_pair_counts(stored(alignment.align(frame, *PATHS), "aligned")).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest() if x else ""
    assert sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, sha(r.groups)) for r in whole), key=repr) == want


def test_alignment_of_nothing(spark):
    none = alignment.align(spark.createDataFrame([], SCHEMA), *PATHS)
    assert alignment.with_pair_counts(stored(none, "aligned")).count() == 0
    nulls = alignment.align(spark.createDataFrame([("", 1, None, "c", "g"), (None, 1, 5, "c", "g")], SCHEMA), *PATHS)
    assert {tuple(r) for r in alignment.with_pair_counts(stored(nulls, "aligned")).select("doc_id", "n_links", "n_best", "count_sum", "groups").collect()} == {(None, 0, 0, 0, ""), (5, 0, 0, 0, "")}


def test_owners_by_hand():
    at, a, b, cut = alignment.owners(np.array([2, 1, 2]), np.array([3, 2]))
    assert (at.tolist(), a.tolist(), b.tolist(), cut.tolist()) == ([0, 2, 3], [0, 1, 2], [0, 0, 1], [True, False, True])


def test_units_have_the_tokens_that_they_have_in_their_text():
    a, b = (alignment.tokenizer(p) for p in PATHS)
    assert a.apart and b.apart
    r = random.Random(7)
    letters = list("ab Zé'’\u0301\u00a0\u3000\u2009\u0085\u200b\t\n  __09.,!▁ﬁ日\U0001f600<|>s") + [" the", " a1", "'s ", "n't", "\r\n", "  ", " x", "<s>", "<0x0A>", "<|endoftext|>"]
    for _ in range(4000):
        text = " " + "".join(r.choice(letters) for _ in range(r.randrange(1, 40)))
        units = alignment.SEAM.split(text)
        assert "".join(units) == text
        for t in (a, b):
            want = t.ids([text])[0]
            if b"".join(t.bytes_of[i] for i in want) == text.encode():
                assert [i for x in t.ids(units) for i in x] == want, repr(text)


def brute_top(rows, k, by):
    fine = [(i, [int(np.floor(256 * np.float64(v))) for v in x]) for i, x in rows if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    out = []
    for q in sorted({i for i, _ in fine if i % by == 0}):
        own = min(x for i, x in fine if i == q)
        held = lambda v: min(max(v, -topk.MOST), topk.MOST)
        scores = sorted((-held(sum(a * b for a, b in zip(own, x, strict=True))), i) for i, x in fine if i != q and len(x) == len(own))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return out


def vectors(seed, n, d, kind):
    r = np.random.default_rng(seed)
    if kind == "ties":
        x = r.integers(-1, 2, (n, d)) / 256.0
    elif kind == "clusters":
        x = np.repeat(r.normal(size=(8, d)), -(-n // 8), 0)[:n] + r.normal(size=(n, d)) * 0.1
    else:
        x = r.normal(size=(n, d))
    return [(int(i), [float(v) for v in row]) for i, row in zip(r.permutation(n), x.astype(np.float32), strict=True)]


def run(spark, rows, k=5, by=50):
    frame = spark.createDataFrame([(x, "e", i, 3) for i, x in rows], "embedding array<double>, weights string, vec_id long, dims int").repartition(3)
    got = topk.top_k(frame, frame.filter(f"vec_id % {by} = 0"), k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and dict(got.dtypes)["rank"] == "int"
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("kind", ["ties", "clusters", "plain"])
def test_top_k(spark, kind, monkeypatch):
    rows = vectors(4, 700, 6, kind)
    rows += [(701, None), (None, [0.1] * 6), (702, [0.1] * 5 + [None]), (703, [float("nan")] * 6), (704, [float("inf")] + [0.0] * 5), (705, [0.0] * 6), (650, [0.0] * 6), (706, [1.0] * 3), (750, [1.0] * 3), (707, []), (800, [])]
    rows += [(7, [0.5] * 6), (7, [0.5] * 6), (100, [9.0] * 6)] + [(1000 + i, [0.25] * 6) for i in range(300)]
    assert run(spark, rows) == brute_top(rows, 5, 50)
    monkeypatch.setattr(topk, "SHARD_WEIGHTS", 6 * 150)
    monkeypatch.setattr(topk, "QUERY_WEIGHTS", 6 * 7)
    monkeypatch.setattr(topk, "SHARDS", 2)
    monkeypatch.setattr(topk, "HELD", 1)
    assert run(spark, rows, 3, 10) == brute_top(rows, 3, 10)


def test_top_k_of_vast_weights_and_of_nothing(spark):
    rows = [(0, [1e30, 2.0]), (50, [3e6, -5e7]), (1, [1e7, 1e7 + 1 / 256]), (2, [1e7, 1e7]), (3, [-1e30, 4.0]), (4, [2.0, 3.0]), (5, [1e12, 1e12])]
    assert run(spark, rows) == brute_top(rows, 5, 50)
    assert run(spark, []) == [] and run(spark, [(50, [1.0])]) == [] and run(spark, [(51, [1.0]), (52, [1.0])]) == []


def test_blocks_below_the_kth_best_are_left_out():
    r = np.random.default_rng(1)
    x = np.floor((np.repeat(r.normal(size=(32, 16)), 128, 0) + r.normal(size=(4096, 16)) * 0.05) * 256)
    order = topk.alike(x, topk.RANGE)
    x = x[order]
    edges = np.arange(0, len(x), topk.RANGE)
    shard = topk.Shard(16, np.arange(4096).astype("<i8").tobytes(), topk._small(x), np.maximum.reduceat(x, edges).tobytes(), np.minimum.reduceat(x, edges).tobytes())
    state = topk.Queries(16, np.arange(0, 4096, 50).astype("<i8").tobytes(), topk._small(x[::50]), 5)
    state.take(shard)
    assert state.scored < 0.25 * 4096 * len(state.ids)


def test_top_k_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(queries.ORACLE_SQL["op12_topk"]).fetchall()
    assert sorted(tuple(r) for r in queries.op12_topk(spark, sf).collect()) == sorted(want) and want

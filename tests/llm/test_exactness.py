"""Cases that hashes, Unicode, skew and unlabelled data once got wrong, against brute force."""

import itertools
import re
import unicodedata

import numpy as np
import pytest

from countaxis.llm import class_lm, components, decontaminate, jaccard_join, neighbours, packing, queries, shared, suffix_dedup, toxicity, url_filter


def morse(bits):
    """Two words that polynomial hashes modulo a power of two can't tell apart."""
    word = "ab"
    for _ in range(bits):
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


# Hashes
def test_words_that_polynomials_confuse(spark):
    pairs = [morse(b) for b in (9, 10, 11)]
    rows = [(i, w) for i, w in enumerate(itertools.chain(*pairs))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(x.doc_id, x.component_id) for x in jaccard_join.jaccard_join(docs).collect()} == {(i, i) for i, _ in rows}
    items = spark.createDataFrame([("i", pairs[1][0])], "item_id string, text string")
    assert {x.doc_id for x in decontaminate.find_contamination(docs, items).collect() if x.n_hit} == {2}
    known = class_lm.score_texts(docs, docs["doc_id"] % 2 == 1, class_lm.Settings(classes=4, clustered=10)).collect()
    assert {(x.doc_id, x.n_known) for x in known} == {(i, 2 if i % 2 == 0 else 1) for i, _ in rows}


def test_span_hashes_depend_on_bytes_alone():
    r = np.random.default_rng(1)
    data = r.integers(0, 4, 5000).astype(np.uint8)
    starts = r.integers(0, 4000, 3000)
    ends = starts + np.concatenate((r.integers(0, 30, 2900), r.integers(400, 1000, 100)))
    for seed in (0, 1):
        got = shared.span_hash(data, starts, ends, seed)
        texts = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        seen = {}
        assert all(seen.setdefault(t, h) == h for t, h in zip(texts, got.tolist(), strict=True)) and len(set(seen.values())) == len(seen)


# Packing
def test_letters_before_signs_give_the_tokenizers_ids():
    path = queries.tokenizer_path("word_bpe_49k.json")
    odd = [chr(c) for c in range(0x20, 0x3000)] + [chr(c) for c in range(0x3000, 0x20000) if not 0xD800 <= c < 0xE000 and (unicodedata.normalize("NFC", chr(c)) != chr(c) or chr(c).lower() != chr(c))]
    texts = [f"{x}? a{x}. y" for x in odd] + ["DİYARBAKİ İ? x", "É! é, <|endoftext|>. don't' ...", "", " \n", "word " * 3000]
    want = packing.encoder(path).model.encode_batch_fast(texts, add_special_tokens=False)
    for text, got, x in zip(texts, packing.encode(texts, path), want, strict=True):
        assert got == np.array(x.ids, "<u4").tobytes(), repr(text[:20])


@pytest.mark.parametrize("most", [1, 8, 2048])
def test_decompositions_agree(most):
    totals = np.array([0, 1, 5, 8, 9, 2047, 2048, 6001])
    owner, length = packing.decomposed(totals, most)
    assert [length[owner == i].tolist() for i in range(len(totals))] == [packing.binary_lengths(int(n), most) for n in totals]


# Decontamination
def test_longest_matches_of_any_length(spark):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(r.choice(words, n))
    docs = [(i, text(int(r.integers(0, 60)))) for i in range(40)] + [(None, text(30)), (50, None), (51, "w1 w2 zz w3")]
    items = [(f"i{k}", text(int(r.integers(1, 25)))) for k in range(8)] + [("none", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = decontaminate.longest_matches(frame, spark.createDataFrame(items, "item_id string, text string"), block_bytes=200)
    got = {(x.item, x.start): (x.length, x.doc_id, x.doc_start) for x in found.collect()}
    split = lambda t: re.findall(r"\w+", t or "")
    want = {}
    for item, t in items:
        w = split(t)
        for s in range(len(w)):
            best = (0, None, None)
            for d, x in sorted(docs, key=lambda y: (y[0] is not None, y[0] or 0)):
                v = split(x)
                for p in range(len(v)):
                    n = 0
                    while s + n < len(w) and p + n < len(v) and w[s + n] == v[p + n]:
                        n += 1
                    if n > best[0]:
                        best = (n, d, p)
            if best[0]:
                want[item, s] = best
    assert got == want


def test_word_suffix_arrays_are_sorted():
    r = np.random.default_rng(5)
    words = r.integers(0, 4, 400)
    words[100:200] = words[200:300]
    array, _ = decontaminate.suffix_array(np.append(words, 0), 3, 2)
    run = lambda p: list(itertools.takewhile(bool, words[p:].tolist()))
    assert [run(p) for p in array] == sorted(run(p) for p in np.flatnonzero(words).tolist())


# Neighbours
def test_codes_are_one_bit_a_dimension_and_prune():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    state = neighbours.Nearest(np.arange(20), x[:20], x.mean(0), 10)
    centre = x.mean(0)
    residual = x - centre
    norms = np.linalg.norm(residual, axis=1)
    rotated = (residual / norms[:, None]) @ neighbours.rotations(64).transpose(0, 2, 1)
    codes = np.packbits(rotated > 0, axis=2, bitorder="little").view("<u8")
    assert neighbours.code_bits(64) == 64 and codes.shape == (neighbours.ROTATIONS, 4000, 1)
    away = np.linalg.norm(x - centre, axis=1)
    state.block(np.arange(4000), codes, norms, np.abs(rotated).sum(2) / 8, x, centre, away.min(), away.max())
    assert state.reranked < 0.5 * 20 * 4000 < state.estimates  # one block, so nothing is known before it
    for q in range(20):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        assert set(np.argsort(d)[:10].tolist()) == set(state.who[q].tolist())


# Urls
def test_hosts_without_labels_borrow_from_their_like(spark):
    rules = [url_filter.Rule("block", "com/ads/"), url_filter.Rule("allow", "com/news/")]
    urls = [f"http://h{i % 5}.com/{'ads' if i % 2 else 'news'}/{i}" for i in range(200)]
    urls += [f"http://other.org/{'ads' if i % 2 else 'news'}/{i}" for i in range(40)]
    got = {x.page_id: x for x in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    free = [got[i] for i in range(200, 240)]
    assert all(x.rule is None for x in free) and len({x.block_rate for x in free}) > 1
    assert all(x.verdict == ("block" if x.page_id % 2 else "allow") for x in free)


# Skew, names, thresholds
def test_skew_join_gives_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 4 + [3, 4, 5])], "k long, i long")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (9, "z")], "k long, v string")
    for how in ("inner", "left"):
        want = sorted(map(repr, left.join(right, ["k"], how).collect()))
        for small in (None, 4):
            assert sorted(map(repr, shared.skew_join(left, right, ["k"], 57, small, how).collect())) == want


def test_components_of_a_large_hub(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    monkeypatch.setattr(components, "BROADCAST_ROWS", 0)
    edges = [(5, x) for x in range(6, 40)] + [(60, 61), (61, 62), (1, 62), (None, 7), (8, 8)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{x: 5 for x in range(5, 40)}, 60: 1, 61: 1, 62: 1, 1: 1}


def test_columns_may_have_any_name(spark):
    names = ["_kept", "_n_removed", "_n_bytes", "_spans", "_id", "_row", "_bytes", "_go_id", "_go_row", "_text_hash", "grp", "kind", "blob"]
    text = "some passage of words that goes on for a good while and is over a hundred bytes long, as it has to be here"
    rows = [(1, text, *names), (2, text + " end", *names), (None, text, *names), (None, "x", *names), (None, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{x}` string" for x in names))
    for out in (suffix_dedup.deduplicated(docs), jaccard_join.one_of_each(docs)):
        assert out.columns == docs.columns and all(tuple(x)[2:] == tuple(names) for x in out.collect())
    assert suffix_dedup.deduplicated(docs).count() == 5 and jaccard_join.one_of_each(docs).count() < 5
    lexicon = toxicity.Lexicon({}, [])
    assert [toxicity.kept(docs, lexicon, t).count() for t in (0, 0.999, 1)] == [0, 5, 5]


# Pairs of one hash when blocks of a word were mixed one after another by a map that everyone knows
COLLIDING = [("abcdefghijklmnop", "f9,-i7?\\x=9?ql|'")]


def built(seed):
    """Sixteen bytes, and those that such a hash takes for them whatever it starts from: the top bits of both blocks' halves differ."""
    r = np.random.default_rng(seed)
    a = r.integers(0, 256, 16).astype(np.uint8)
    b = a.copy()
    b[[3, 7, 11, 15]] ^= 0x80
    return a, b


def test_built_pairs_are_told_apart():
    for seed in range(50):
        a, b = built(seed)
        data = np.concatenate((a, b))
        for key in (0, 1, shared.new_key()):
            x, y = shared.span_hash(data, np.array([0, 16]), np.array([16, 32]), 0, key)
            assert x != y
    same = np.frombuffer(b"one two one", np.uint8)
    x, y, z = shared.span_hash(same, np.array([0, 4, 8]), np.array([3, 7, 11]), 0, 5)
    assert x == z != y and shared.span_hash(same, np.array([0]), np.array([3]), 0, 6)[0] != x != shared.span_hash(same, np.array([0]), np.array([3]), 1, 5)[0]


def test_hashes_of_many_words_differ():
    """Words that differ in one place only, in few bits, or in their lengths."""
    words = [bytes([x]) * n for x in range(1, 256) for n in range(1, 40)] + [bytes([97] * i + [x] + [97] * (20 - i)) for i in range(21) for x in range(98, 256)] + [b"\0" * n for n in range(1, 30)]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    got = shared.span_hash(data, ends - [len(w) for w in words], ends, 0, shared.new_key())
    assert len(set(got.tolist())) == len(set(words))


@pytest.mark.parametrize("pair", COLLIDING)
def test_operators_tell_built_words_apart(spark, pair):
    a, b = pair
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert {(x.doc_id, x.component_id) for x in jaccard_join.jaccard_join(docs).collect()} == {(1, 1), (2, 2)}
    assert jaccard_join.one_of_each(docs).count() == 2
    known = class_lm.score_texts(docs, docs["doc_id"] == 2, class_lm.Settings(classes=4, clustered=10)).collect()
    assert {x.doc_id: x.n_known for x in known} == {1: 2, 2: 1}
    tail = "".join(chr(98 + i * 7 % 24) for i in range(84))
    texts = spark.createDataFrame([(1, a + tail), (2, b + tail)], "doc_id long, text string")
    assert {x.doc_id: x._n_removed for x in suffix_dedup.remove_repeats(texts, ["doc_id"]).collect()} == {1: 0, 2: 0}
    items = spark.createDataFrame([("i", a)], "item_id string, text string")
    assert {x.doc_id for x in decontaminate.find_contamination(docs, items).collect() if x.n_hit} == {1}
    path = queries.tokenizer_path("word_bpe_49k.json")
    want = packing.encoder(path).model.encode_batch_fast([f"{a} {b}"], add_special_tokens=False)[0].ids
    assert np.frombuffer(packing.encode([f"{a} {b}"], path)[0], "<u4").tolist() == want

"""The training-data operators against brute force, on random small texts and on the awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from countaxis.llm import class_lm, components, decontaminate, jaccard_join, kn_quality, neighbours, packing, queries, suffix_dedup, token_counts, toxicity, url_filter

WORDS = [a + b for a in "ba de fi go lu mé ná".split() for b in "r st n th ß".split()]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _row long, grp string, score double"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(seed=1, n=60):
    r = random.Random(seed)
    sentence = lambda k: " ".join(r.choice(WORDS) + r.choice(["", "", ".", ",", "!!"]) for _ in range(k))
    passage = sentence(40)
    rows = []
    for i in range(n):
        text = sentence(r.choice([0, 1, 3, 8, 30, 120]))
        if i % 5 == 0 and rows:
            words = rows[r.randrange(len(rows))].split(" ")
            for _ in range(r.choice([0, 1, 2])):
                words[r.randrange(len(words))] = r.choice(WORDS)
            text = " ".join(words)
        if i % 7 == 0:
            text += " " + passage
        rows.append(text.title() if i % 11 == 0 else text)
    return rows


def awkward():
    """Null and empty texts, a null id, repeated rows, one id with two texts, a very long text, signs, special strings."""
    r = random.Random(5)
    long = " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(60_000))
    return [(900, None), (901, ""), (902, " \n\t "), (None, "a text of no number at all that is long enough"), (903, "twice " * 40), (903, "twice " * 40), (904, "one id " * 30), (904, "two texts " * 30), (905, long), (906, "|||| ~~ !!"), (907, "<|endoftext|> x <|startoftext|>"), (908, "Ünïcode ﬁ e\u0301 \U0001f600 日本語 " * 10), (909, "x" * 500), (910, "x" * 300), (911, "gost " * 20_000)]


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(corpus())) + awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "clash", 7, "g", 0.5) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sorted_rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


# Toxicity
def test_folding_matches_substitutes_and_lookalikes():
    lexicon = toxicity.Lexicon({" idiot": 5.0, " scum ": 4.0}, [toxicity.fold("scum lake")])
    m = toxicity.Matcher(lexicon)
    hits = lambda t: len(m.hits(toxicity.fold(t)))
    lexicon = toxicity.Lexicon({toxicity.fold("idiot").rstrip(): 5.0, toxicity.fold("scum"): 4.0}, [toxicity.fold("scum lake")])
    m = toxicity.Matcher(lexicon)
    assert hits("an idiot") == hits("an 1D10T!") == hits("an іdiоt") == hits("ＩＤＩＯＴ") == hits("i\u200bdiot") == 1
    assert hits("scum") == 1 and hits("scummy") == 0 and hits("a scum lake") == 0 and hits("") == 0
    assert m.strength("idiot") > m.strength("idiot " + "word " * 300) > 0


def test_toxicity_learns_and_holds_out(spark):
    r = random.Random(3)
    texts, marks = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = [r.choice(WORDS) for _ in range(40)]
        if toxic:
            words[r.randrange(40)] = r.choice(["zonkhead", "z0nkhead", "flimgut"])
        texts.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([*marks, (None, 1), (9999, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, toxicity.training_labels(labels))
    assert all(zlib.crc32(str(i).encode()) % 4 != 2 for i, in [(x.doc_id,) for x in toxicity.training_labels(labels).collect()] if i is not None)
    got = {x.doc_id: x for x in toxicity.score(docs, lexicon).collect()}
    assert sum(got[i].predicted == t for i, t in marks) >= 396 and all(0 <= x.score <= 1 for x in got.values())
    kept = {x.doc_id for x in toxicity.kept(docs, lexicon).collect()}
    assert kept == {i for i, x in got.items() if not x.predicted}


def test_toxicity_awkward(spark, docs, empty, rows):
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, none).count() == len(rows) and toxicity.score(empty, none).count() == 0
    assert toxicity.kept(docs, none).columns == docs.columns and toxicity.kept(docs, none).count() == len(rows)


# Quality
def test_kneser_ney_probabilities_sum_to_one(spark):
    text = b"abracadabra abracadabra banana bandana cadabra"
    grams, counts = np.unique(kn_quality.grams_of(np.frombuffer(text, np.uint8), np.array([0, len(text)])), return_counts=True)
    tables = kn_quality.model_tables(spark.createDataFrame(list(zip(grams.tolist(), counts.tolist(), strict=True)), "gram long, c long"))
    for context in (b"abr", b"zzz", b"ana", b"\0\0\0"):
        base = int.from_bytes(context, "big") << 8
        asked = spark.createDataFrame([(0, base + w) for w in range(256)], "shard long, gram long")
        total = sum(10 ** r.log for r in kn_quality.probabilities(asked, tables).collect())
        assert total == pytest.approx(1, abs=1e-5)


def test_quality_keeps_clean_and_drops_junk(spark, docs, empty, rows):
    r = random.Random(8)
    clean = [(i, " ".join(r.choice(WORDS) for _ in range(60)), "en") for i in range(120)]
    junk = [(1000 + i, "".join(chr(r.randrange(33, 127)) for _ in range(300)), "en") for i in range(20)]
    frame = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 120, 2)] + [(1000, 0)], "doc_id long, quality int")
    got = {x.doc_id: x.keep for x in kn_quality.judge_quality(frame, labels).collect()}
    assert all(got[i] for i in range(120)) and not any(got[1000 + i] for i in range(20))
    out = kn_quality.judge_quality(docs, labels).collect()
    assert len(out) == len(rows) and all(not x.keep and x.perplexity is None for x in out if x.doc_id in (900, 901))
    assert kn_quality.judge_quality(empty, labels).count() == 0


# Neighbours
def brute_neighbours(rows, queries_, k):
    good = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    out = []
    for q, v in queries_:
        if not good(v):
            continue
        d = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True))), i) for i, w in rows if i != q and good(w) and len(w) == len(v))
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(d[:k])]
    return sorted(out)


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(2)
    vectors = [(i, r.normal(size=16).astype(np.float32).tolist()) for i in range(400)]
    vectors += [(400 + i, vectors[7][1]) for i in range(30)] + [(500, None), (501, [0.0] * 16), (502, [1.0] + [None] * 15), (503, [float("nan")] * 16), (504, [1.0, 2.0]), (505, []), (600, [3.0, 1.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4)
    asked = [v for v in vectors if v[0] % 100 == 0]
    got = sorted(tuple(x) for x in neighbours.nearest(frame, frame.filter("vec_id % 100 = 0")).select("query_id", "rank", "vec_id", "score").collect())
    want = brute_neighbours(vectors, asked, 10)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-12)
    few = neighbours.search(neighbours.build_index(neighbours.usable(frame), c := neighbours.centroids(neighbours.usable(frame)), block=32), neighbours.usable(frame.filter("vec_id % 100 = 0")), c, query_bytes=200)
    assert sorted(tuple(x)[:3] for x in few.select("query_id", "rank", "vec_id").collect()) == [x[:3] for x in want]
    assert neighbours.nearest(frame.limit(0), frame.limit(0)).count() == 0


# Jaccard join
def brute_components(rows, width=5, percent=75):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                up[root(a)] = root(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return [(k, len(sets[i]), least.get(root(i))) for i, (k, _) in enumerate(rows)]


@pytest.mark.parametrize("block", [2048, 3])
def test_jaccard_components_against_brute_force(spark, docs, rows, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MANY", 4)
    found = jaccard_join.shingle_documents(docs, block=block)
    want = brute_components(rows)
    got = collections.Counter()
    for x in found.collect():
        got[(x._id if x._id != suffix_dedup.NO_ID else None, x.n_shingles, x.component_id)] += x.copies
    assert got == collections.Counter(want)


def test_jaccard_rows_and_one_of_each(docs, empty, rows):
    want = brute_components(rows)
    assert sorted_rows(jaccard_join.jaccard_join(docs), "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [x.doc_id for x in kept.collect()]
    assert sorted(ids, key=repr) == sorted({k for k, _, c in want if k == c or c is None}, key=repr)
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_t_occurrence_against_counts():
    r = random.Random(4)
    for _ in range(50):
        lists = [np.array(sorted(r.sample(range(60), r.randrange(1, 50)))) for _ in range(r.randrange(1, 30))]
        need = r.randrange(1, len(lists) + 1)
        counts = collections.Counter(x for a in lists for x in a.tolist())
        who, n = jaccard_join.t_occurrence(lists, need)
        assert dict(zip(who.tolist(), n.tolist(), strict=True)) == {k: v for k, v in counts.items() if v >= need}


def test_signatures_never_lose_a_link():
    r = np.random.default_rng(3)
    for _ in range(30):
        base = r.integers(1, 1 << 62, size=r.integers(2, 400)).astype(np.uint64)
        other = np.concatenate([base[r.random(len(base)) < 0.9], r.integers(1, 1 << 62, size=r.integers(0, 20)).astype(np.uint64)])
        o, n = len(np.intersect1d(base, other)), [len(base), len(other)]
        keep = jaccard_join.near_in(np.array([1, 2]), np.array(n), np.array([0, 0]), np.array([1, 2]), [jaccard_join.signature(base), jaccard_join.signature(other)], 75)
        if len(other) and 100 * o >= 75 * (sum(n) - o):
            assert keep.all()


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (100, 101), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


# Suffix arrays
def brute_removed(rows, length=100):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = {}, []
    for i in order:
        b = (rows[i][1] or "").encode()
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], (rows[i][0], rows[i][1], p))
    for k, t in rows:
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] != (k, t, p):
                gone[p : p + length] = b"\1" * length
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((k, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_removed_bytes_against_brute_force(docs, empty, rows):
    from pyspark.sql import functions as F

    # One id with two unlike texts has no order that the contract names, so these two share no window here.
    got = suffix_dedup.remove_repeats(docs, ["doc_id"]).select("doc_id", "_n_bytes", "_n_removed", F.size("_spans").alias("n"), F.sha2("_kept", 256).alias("h"))
    assert sorted_rows(got, "doc_id", "_n_bytes", "_n_removed", "n", "h") == sorted(brute_removed(rows), key=repr)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_deduplicated_keeps_rows_and_columns(docs, rows):
    out = suffix_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert {x.text for x in out.filter("doc_id = 905").collect()} == {dict(rows)[905]}


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_sorts_and_finds_prefixes(seed):
    r = random.Random(seed)
    text = np.array([r.choice([0, 1, 2, 2, 3]) if seed % 2 else r.randrange(1, 3) for _ in range(300)] + [0], np.uint8)
    array = suffix_dedup.suffix_array(text, 400)
    data = text.tobytes()
    assert array.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    common = suffix_dedup.common_prefixes(text, array, 16)
    for k, (a, b) in enumerate(zip(array[:-1], array[1:], strict=True)):
        n = next((i for i, (x, y) in enumerate(zip(data[a:], data[b:], strict=False)) if x != y), min(len(data) - a, len(data) - b))
        assert (common[k] >= 16) == (n >= 16) and common[k] <= n


def test_long_texts_are_cut_without_losing_a_window(monkeypatch):
    import pyarrow as pa

    text = "".join(random.Random(1).choice("ab ") for _ in range(5000))
    starts = []
    for _, offsets, _, base in suffix_dedup.pieces(pa.array([text, None, "ab"]), 700, 100):
        starts += [b + p for b, n in zip(base.tolist(), np.diff(offsets).tolist(), strict=True) for p in range(n - 99)]
    assert sorted(starts) == list(range(5000 - 99))


# Decontamination
def brute_hits(rows, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word.findall(low(t))
        m = min(width, len(w))
        for j in range(len(w) - m + 1 if m and i is not None else 0):
            windows[tuple(w[j : j + m])].add(str(i))
    out = []
    for k, t in rows:
        w, hit, found = word.findall(low(t)), set(), set()
        for m in {len(x) for x in windows}:
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in windows:
                    hit |= set(range(j, j + m))
                    found |= windows[tuple(w[j : j + m])]
        out.append((k, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination_against_brute_force(spark, docs, empty, rows, block_bytes):
    texts = dict(rows)
    items = [(i, " ".join((texts[i] or "").split()[3:30])) for i in (6, 12, 18, 24)] + [(50, "bar"), (51, "twice twice"), (52, None), (53, ""), (None, "x"), (54, texts[905][2000:2200]), (50, "den fin")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs, benchmark, block_bytes=block_bytes)
    assert sorted_rows(got, "doc_id", "n_words", "n_hit", "items") == sorted(brute_hits(rows, items), key=repr)
    for x in got.collect():
        assert sum(s.length for s in x.spans) == x.n_hit and (x.longest > 0) == (x.n_hit > 0)
    kept = decontaminate.decontaminated(docs, benchmark, block_bytes=block_bytes)
    assert kept.columns == docs.columns and sorted((x.doc_id for x in kept.collect()), key=repr) == sorted((k for k, _, n, _ in brute_hits(rows, items) if not n), key=repr)
    assert decontaminate.find_contamination(empty, benchmark).count() == 0 and decontaminate.find_contamination(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0


# Class language model
def test_class_model_base_and_gain(docs, empty, rows):
    from countaxis.llm.shared import held_out

    word = re.compile(r"[^\x20\x09-\x0D]+")
    tokens = [(k, [*word.findall(low(t)), None]) for k, t in rows]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    c = collections.Counter(x for k, w in tokens if not held(k) for x in w)
    n, v = sum(c.values()), len(c)
    want = [(k, held(k), len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)) for k, w in tokens]
    out = class_lm.score_texts(docs, held_out("doc_id", 7, 2), class_lm.Settings(classes=6, clustered=40)).collect()
    assert sorted(((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in out), key=repr) == sorted(want, key=repr)
    assert all(math.isfinite(x.score) and x.score < 0 for x in out)
    assert class_lm.score_texts(empty, held_out("doc_id", 7, 2)).count() == 0


def test_exchange_finds_planted_classes_and_model_is_a_distribution():
    r = np.random.default_rng(1)
    of = np.arange(24) % 3
    step = np.array([[0.1, 0.8, 0.1], [0.1, 0.1, 0.8], [0.8, 0.1, 0.1]])
    state, counts, last = 0, np.zeros((25, 25)), 24
    for _ in range(20_000):
        state = r.choice(3, p=step[state])
        w = r.choice(np.flatnonzero(of == state))
        counts[last, w] += 1
        last = w
    found = class_lm.exchange(counts, 3, 10)
    assert all(len(set(found[of == k].tolist())) == 1 for k in range(3)) and len(set(found.tolist())) == 3
    transitions, sizes = r.integers(1, 50, size=(4, 4)).astype(float), np.array([5.0, 6.0, 7.0, 1.0])
    transitions = (transitions + transitions.T) / 2
    m = class_lm.model_of(transitions, sizes, 0.4, int(transitions.sum()), 19, 5.0)
    share = 1 - 0.4 * sizes / m.sizes
    assert np.allclose(10**m.steps @ share + 10**m.unseen, 1)


# Urls
def test_rules_and_hosts(spark):
    urls = ["http://A.Example.com/en/1", "https://www.example.com/en/x?y=/z", "http://example.com/en/", "http://x.net/es/a", "http://x.net/de/a#q", "http://notexample.com", "http://com/x", None, "no url", "http://q.org/en/1", "http://net.org/es/", "a://b://c/d", "http://x.net?/es/"]
    frame = spark.createDataFrame([(i, u, "html", "host") for i, u in enumerate([*urls, urls[0]])] + [(None, urls[3], "h", "r")], "page_id long, url string, html string, host string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.judge(frame, queries.URL_RULES).collect()}
    assert got[0] == got[len(urls)] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[2][2:] == ("example.com/en/", "block")
    assert got[3][2:] == got[None][2:] == ("net/es/", "block") and got[4][:3] == ("x.net", "/de/a", None) and got[5][:3] == ("notexample.com", "", None)
    assert got[6][2] == "com/" and got[7][:3] == got[8][:3] == ("", "", None) and got[9][2] is None and got[10][2] is None
    assert got[11][:2] == ("b:", "//c/d") and got[12][:3] == ("x.net", "", None) and {x[3] for x in got.values()} <= {"allow", "block"}
    assert url_filter.judge(frame.limit(0), queries.URL_RULES).count() == 0


def test_variable_segments_pool_their_labels(spark):
    rules = [url_filter.Rule("block", f"bad.org/shop/item{i}/") for i in range(60)] + [url_filter.Rule("allow", f"bad.org/blog/p{i}/") for i in range(60)]
    names = lambda k, n: f"{k}{chr(97 + n // 26)}{chr(97 + n % 26)}"
    rules = [url_filter.Rule("block", f"bad.org/shop/{names('item', i)}/") for i in range(60)] + [url_filter.Rule("allow", f"bad.org/blog/{names('post', i)}/") for i in range(60)]
    urls = [f"http://bad.org/shop/{names('item', i)}/x" for i in range(90)] + [f"http://bad.org/blog/{names('post', i)}/x" for i in range(90)]
    got = {x.page_id: x for x in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert all(got[i].rule is None and got[i].verdict == "block" for i in range(60, 90))
    assert all(got[i].rule is None and got[i].verdict == "allow" for i in range(150, 180))


# Packing and token counts
def test_packing_round_trip(docs, empty, rows):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    pieces = collections.defaultdict(list)
    out = packing.pack(docs, path).collect()
    for x in out:
        assert x.length & (x.length - 1) == 0 and 0 < x.length <= 2048 and x.offset == 0 and len(x.token_bytes) == 4 * x.length
        pieces[x.doc_id].append((x.start, x.doc_tokens, np.frombuffer(x.token_bytes, "<u4").tolist()))
    assert len({x.sequence_id for x in out}) == len(out)
    want = collections.defaultdict(list)
    for k, t in rows:
        want[k].append([*model.encode(t or "", add_special_tokens=False).ids, 1])
    for k, texts in want.items():
        assert sum(len(x[2]) for x in pieces[k]) == sum(map(len, texts))
        if len(texts) == 1:
            joined = [i for _, _, ids in sorted(pieces[k]) for i in ids]
            assert joined == texts[0] and {n for _, n, _ in pieces[k]} == {len(texts[0])}
    assert packing.pack(empty, path).count() == 0 and packing.binary_lengths(2048 * 2 + 5, 2048) == [2048, 2048, 4, 1]


def test_token_counts_and_cache(spark, docs, empty, rows, tmp_path):
    from tokenizers import Tokenizer

    path, cache = queries.tokenizer_path("byte_bpe_50k.json"), str(tmp_path / "cache")
    model = Tokenizer.from_file(path)
    want = sorted(((k, len((t or "").encode()), n := len(model.encode(t or "", add_special_tokens=False).ids), n > 512) for k, t in rows), key=repr)
    assert sorted_rows(token_counts.count_tokens(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    spark.createDataFrame([], token_counts.CACHE_SCHEMA).write.parquet(cache)
    token_counts.count_tokens(docs.filter("doc_id < 30"), path, cache).count()
    first = spark.read.parquet(cache).count()
    assert first == len({t for k, t in rows if k is not None and k < 30})
    assert sorted_rows(token_counts.count_tokens(docs, path, cache), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in rows})
    assert token_counts.count_tokens(empty, path).count() == 0


def test_piece_tokenizer_counts(spark):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    frame = spark.createDataFrame([(1, "a few words here"), (2, None)], "doc_id long, text string")
    assert {x.doc_id: x.n_tokens for x in token_counts.count_tokens(frame, path).collect()} == {1: len(model.encode("a few words here")), 2: 0}

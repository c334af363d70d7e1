"""The training-data operators do the whole job, where they once cut it."""

import random

import pytest
from pyspark.sql import functions as F

from countaxis.llm import jaccard_join, kn_quality, toxicity


# Toxicity
def test_rare_toxic_words_beside_many_common_ones(spark):
    r = random.Random(2)
    common = " ".join("".join(r.choice("abcdefghijklmnopqrstuvw") for _ in range(10)) for _ in range(9000))
    toxic = [(i, common + (" zzyqxz" if i < 3 else ""), 1) for i in range(4)]
    clean = [(100 + i, common if i < 4 else "ordinary words", 0) for i in range(100)]
    frame = spark.createDataFrame(toxic + clean, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    assert toxicity.Matcher(lexicon).strength("a zzyqxz text") > 0


def test_lexicon_keeps_all_that_passes(spark):
    words = [f"{a}{b}{c}{d}" for a in "qxzj" for b in "abcdefghkmn" for c in "abcdefghkmn" for d in "abcdefghkmnp"]
    toxic = [(i, " ".join(words), 1) for i in range(3)]
    clean = [(100 + i, " ".join(f"{w[:3]}zz" for w in words) if i < 50 else "ordinary words", 0) for i in range(150)]
    frame = spark.createDataFrame(toxic + clean, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    machine = toxicity.Matcher(lexicon)
    assert len(lexicon.weights) > 5000 and all(machine.strength(w) > 0 for w in words)


# Quality
def test_limits_rest_on_all_trusted_texts(spark):
    """Limits don't follow which texts the model was trained on: one language's texts are all outside the sample."""
    r = random.Random(4)
    ids = [x.i for x in spark.range(80).selectExpr("id as i").orderBy(F.xxhash64("i"), "i").collect()]
    first, last = ids[:60], ids[60:]
    rows = [(i, " ".join(r.choice(["ba", "de", "fi"]) for _ in range(60)), "a") for i in first] + [(i, "".join(r.choice("0123456789") for _ in range(200)), "b") for i in last]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = kn_quality.judge_quality(frame, frame.selectExpr("doc_id", "1 as quality"), margin=1.0, train_rows=60).collect()
    for lang in "ab":
        own = [x for x in got if x.lang == lang]
        assert {x.threshold for x in own} == {max(x.perplexity for x in own)} and all(x.keep for x in own)


def test_margin_is_chosen_by_both_classes(spark):
    rows = lambda junk: spark.createDataFrame([(1, x / 100) for x in range(50, 101)] + [(0, x) for x in junk], "_q int, x double")
    assert kn_quality.chosen_margin(rows([1.12, 1.3, 9.0])) == pytest.approx(1.1)  # 1.5 kept two of three
    assert kn_quality.chosen_margin(rows([])) == kn_quality.chosen_margin(rows([9.0])) == 1.5
    assert kn_quality.chosen_margin(rows([1.01])) == 1.0


# Jaccard join
def test_one_of_each_component_and_not_of_each_id(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (4, text(3)), (5, text(3)), (6, text(6)), (6, text(7)), (8, text(8)), (8, text(8)), (9, ""), (10, None), (10, None)]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((x.doc_id or 0, x.text or "") for x in kept.collect()) == sorted([(0, text(1)), (0, text(2)), (4, text(3)), (6, text(6)), (6, text(7)), (8, text(8)), (9, ""), (10, "")])


def test_quality_learns_from_every_trusted_text(spark):
    """The text whose id's hash is the greatest of more than 50,000 has a part in the counts."""
    n = 50_001
    last = spark.range(n).selectExpr("id as i").orderBy(F.xxhash64("i").desc(), F.col("i").desc()).first().i
    frame = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") == last, "zq" * 40).otherwise("ab").alias("text"), F.lit("a").alias("lang"))
    got = kn_quality.judge_quality(frame, frame.selectExpr("doc_id", "1 as quality"), margin=1.0).filter(F.col("doc_id") == last).first()
    assert got.perplexity < 10  # unseen bytes have about 256


@pytest.mark.parametrize("most", ["10m", "-1"])
def test_training_shuffles_no_text_for_its_labels(spark, monkeypatch, most):
    """Trusted ids go to the groups that texts are dealt to, so no join has texts on a side, however many labels there are; counts are
    those of all rows of trusted ids, the one that stands for null among them."""
    words = ["red", "green", "blue", "häuser", "x" * 90]
    r = random.Random(4)
    rows = [(i % 40 - 3, " ".join(r.choice(words) for _ in range(9)), "en") for i in range(60)] + [(None, "null null", "en"), (-(1 << 63), "least", "en"), (5, None, "en"), (6, "", None)]
    trusted = [*range(-3, 30, 2), -(1 << 63), 999]
    want = {}
    for i, text, _ in rows:
        if i in trusted:
            data = (text or "").encode()
            for k in range(len(data)):
                gram = int.from_bytes(data[max(0, k - 3) : k + 1])
                want[gram] = want.get(gram, 0) + 1
    got, real, texts = {}, kn_quality.model_tables, []
    monkeypatch.setattr(kn_quality, "model_tables", lambda counts: got.update({x.gram: x.c for x in counts.collect()}) or real(counts))
    kept = kn_quality.stored

    def stored(frame, what):
        plan = frame._jdf.queryExecution().optimizedPlan()
        if "_bytes" in plan.toString() and "Join" in plan.toString():
            texts.append(what)
        return kept(frame, what)

    monkeypatch.setattr(kn_quality, "stored", stored)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    try:
        frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
        out = kn_quality.judge_quality(frame, spark.createDataFrame([(i, 1) for i in trusted] + [(4, 0)], "doc_id long, quality int"))
        assert out.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == want and not texts

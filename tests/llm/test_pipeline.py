"""The pipeline's stages, each against brute force on its own input, and the queries' registration."""

import collections

import corpus_pipeline
import pytest
from test_operators import SCHEMA, brute_components, brute_hits, brute_removed, corpus

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    texts = corpus(9, 80)
    rows = [(i, t + (" zonkhead" if i % 10 == 3 else ""), "en", "s", len(t)) for i, t in enumerate(texts)] + [(500, None, None, None, None), (501, "", "en", "s", 0), (5, texts[5], "en", "s", len(texts[5]))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 3)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(texts[10].split()[:14])), (2, "never there at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(x) for x in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(x.doc_id, x.text) for x in docs.collect()]
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), docs.schema)
            after = [(x.doc_id, x.text) for x in out.collect()]
            ids = collections.Counter(k for k, _ in after)
        if name == "toxicity":
            assert ids == collections.Counter(k for k, t in before if "zonkhead" not in (t or ""))
        elif name == "jaccard_join":
            assert ids == collections.Counter({k for k, _, c in brute_components(before) if k == c})
        elif name == "suffix_dedup":
            assert {k: len((t or "").encode()) for k, t in after} == {k: n - gone for k, n, gone, _, _ in brute_removed(before)}
        elif name == "decontamination":
            assert ids == collections.Counter(k for k, _, n, _ in brute_hits(before, items) if not n)
        else:
            assert {x.doc_id for x in out.collect()} == {k for k, _ in before}
        docs = out


def test_run_and_empty_table(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0 and corpus_pipeline.ORACLE_SQL is None
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {x[: x.index("_") + 1] for x in names if x.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names and SCHEMA


def test_sql_agrees_on_the_awkward_rows(spark, tmp_path):
    """The SQL beside the queries, on rows with ids of their own (SQL has no place for a null or repeated id)."""
    import duckdb
    from test_operators import awkward

    from countaxis.llm import queries

    texts = corpus(4, 50)
    rows = [(i, t) for i, t in enumerate(texts)] + [(k, t) for k, t in awkward() if k not in (None, 903, 904, 905, 911)]
    spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, texts[10]), (2, "bar"), (3, None), (4, " ".join(texts[30].split()[:12]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("op4_jaccard_join", "op5_suffix_dedup", "op6_decontaminate"):
        out = entry.queries()[name](spark, str(tmp_path))
        columns = sorted(out.columns)
        want = con.sql(queries.ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        got = sorted(tuple(r[c] for c in columns) for r in out.collect())
        assert got == sorted(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())

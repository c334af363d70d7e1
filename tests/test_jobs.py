"""The jobs: growing input, repeated and broken runs, awkward rows, command lines; and their SQL."""

import collections
import logging
import math
import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from jobs import count_ingest, queries, region_report
from jobs.settings import settings

ROOT = Path(__file__).resolve().parent.parent
SCHEMA = "doc_id long, text string, source string, lang string, n long, batch string, gene string"


def documents(spark, folder, rows, number):
    frame = spark.createDataFrame([(i, t, "s", g, 1, "x", "y") for i, t, g in rows], SCHEMA)
    frame.coalesce(1).write.mode("append").parquet(str(folder / f"part{number}"))


def brute(rows):
    n, cells, exposure, all_n = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    for _, text, group in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        group = group or "unknown"
        exposure[group] += len(words)
        n.update((group, w) for w in words)
        all_n.update(words)
        cells.update({(group, w) for w in words})
    total = sum(exposure.values())
    expected = {k: exposure[k[0]] * all_n[k[1]] / total for k in n}
    return sorted((g, w, n[g, w], cells[g, w], exposure[g], round(expected[g, w], 6), round(math.log2((n[g, w] + 0.5) / (expected[g, w] + 0.5)), 6)) for g, w in n)


def found(spark, out):
    rows = count_ingest.read(spark, out, "profiles").collect()
    return sorted((r.group, r.gene, r.n, r.cells, r.exposure, round(r.expected, 6), round(r.score, 6)) for r in rows)


FIRST = [(1, "One two two, Größe x1", "en"), (2, None, "en"), (3, "", None), (4, "two 日本 two", None), (None, "TWO one", "01"), (5, "?!", "de")]
SECOND = [(6, "two three " * 500, "en"), (7, "drei", "a/b c"), (8, "zwei zwei", "de")]


def test_counts_grow_with_their_input(spark, tmp_path, caplog):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    (src / "part0").mkdir(parents=True)
    caplog.set_level(logging.INFO)
    run = lambda: count_ingest.run(spark, f"{src}/part*", out, mark, files_per_batch=1)
    assert run() == {"documents": 0, "batches": 0} and found(spark, out) == []
    documents(spark, src, FIRST, 1)
    assert run() == {"documents": len(FIRST), "batches": 1}
    assert found(spark, out) == brute(FIRST)
    assert run() == {"documents": 0, "batches": 0} and found(spark, out) == brute(FIRST)
    documents(spark, src, SECOND, 2)
    documents(spark, src, SECOND[:1], 3)
    assert run() == {"documents": len(SECOND) + 1, "batches": 2}
    assert found(spark, out) == brute(FIRST + SECOND + SECOND[:1])
    assert "read 6 documents in 1 batches" in caplog.text and "profile rows of" in caplog.text
    cells = count_ingest.read(spark, out, "cells").collect()
    assert {(r.cell, r.library, r.genes, r.group) for r in cells if r.cell in (1, 3, None)} == {(1, 5, 4, "en"), (3, 0, 0, "unknown"), (None, 2, 2, "01")}


def test_a_broken_run_is_made_good_by_the_next(spark, tmp_path, monkeypatch):
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    documents(spark, src, FIRST, 1)
    count_ingest.run(spark, f"{src}/part*", out, mark)
    documents(spark, src, SECOND, 2)
    whole = count_ingest._replace

    def broken(frame, path, keys):
        if path.endswith("sums"):
            raise RuntimeError("lost")
        whole(frame, path, keys)

    monkeypatch.setattr(count_ingest, "_replace", broken)
    with pytest.raises(Exception, match="lost"):
        count_ingest.run(spark, f"{src}/part*", out, mark)
    monkeypatch.setattr(count_ingest, "_replace", whole)
    assert count_ingest.run(spark, f"{src}/part*", out, mark)["documents"] == len(SECOND)
    assert found(spark, out) == brute(FIRST + SECOND)


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    batch = spark.createDataFrame([(i, t, "s", g, 1, "x", "y") for i, t, g in FIRST], SCHEMA)
    for _ in range(2):
        count_ingest.add_batch(batch, 3, str(tmp_path), "lang")
    rows = count_ingest.profiles(spark, str(tmp_path)).collect()
    assert sorted((r.group, r.gene, r.n) for r in rows) == [x[:3] for x in brute(FIRST)]


def test_texts_of_one_task_are_split_by_many(spark, tmp_path, monkeypatch):
    """A file of one row group is read by one task; its words are split by several, once, with bounded sums."""
    from countaxis.streaming import counts

    rows = [(i, f"w{i % 7} W{i % 5} é{i}", "en") for i in range(200)] + FIRST
    monkeypatch.setattr(counts, "HELD", 3)
    made, whole = [], count_ingest.word_counts
    monkeypatch.setattr(count_ingest, "word_counts", lambda docs: made.append(whole(docs)) or made[-1])
    batch = spark.createDataFrame([(i, t, "s", g, 1, "x", "y") for i, t, g in rows], SCHEMA).coalesce(1)
    count_ingest.add_batch(batch, 0, str(tmp_path), "lang")
    assert len(made) == 1 and made[0].rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    busy = made[0].selectExpr("spark_partition_id() as p").distinct().count()
    assert busy > spark.sparkContext.defaultParallelism
    got = count_ingest.profiles(spark, str(tmp_path)).collect()
    assert sorted((r.group, r.gene, r.n, r.cells, r.exposure) for r in got) == [x[:5] for x in brute(rows)]


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_jobs_agree_with_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    before = {x: spark.conf.get(x, None) for x in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr) and want
    assert before == {x: spark.conf.get(x, None) for x in before}


def test_report_replaces_only_its_chromosomes(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    out = str(tmp_path / "report")
    region_report.run(spark, SF, out, radius=1, chromosomes=["1", "2"])
    rows = lambda name: sorted((tuple(r) for r in region_report.read(spark, out, name).collect()), key=repr)
    first = {name: rows(name) for name in region_report.TABLES}
    assert {r[-1] for r in first["regions"]} == {r[-1] for r in first["segments"]} == {"1", "2"}
    region_report.run(spark, SF, out, radius=1, chromosomes=["2"])
    assert {name: rows(name) for name in region_report.TABLES} == first
    region_report.run(spark, SF, out, radius=1, least=1e9, chromosomes=["2", "3"])
    again = rows("segments")
    assert [r for r in again if r[-1] == "1"] == [r for r in first["segments"] if r[-1] == "1"]
    assert {r[-1] for r in again} == {"1", "2", "3"} and {r[3] for r in again if r[-1] != "1"} == {"neutral"}
    assert "line items" in caplog.text and "segments" in caplog.text


def test_segments_cover_all_regions(spark, tmp_path):
    out = str(tmp_path / "report")
    numbers = region_report.run(spark, SF, out, width=50_000)
    segments = region_report.read(spark, out, "segments").collect()
    assert sum(r.regions for r in segments) == numbers["regions"] and len(segments) == numbers["segments"]
    assert all((r.state == r.raw_state) or (r.state == "neutral" and r.log_bf < 5) for r in segments)


def test_settings(tmp_path):
    file = tmp_path / "c.json"
    file.write_text('{"documents": "a", "out": "b", "checkpoint": "", "group": "source"}')
    chosen = settings("about", "count_ingest.json", ["documents", "out", "checkpoint"], ["--config", str(file), "--out", "c", "--checkpoint", "d"])
    assert chosen == {"documents": "a", "out": "c", "checkpoint": "d", "group": "source"}
    with pytest.raises(SystemExit):
        settings("about", "count_ingest.json", ["documents", "out", "checkpoint"], ["--documents", "a"])


def test_command_line(spark, tmp_path):
    documents(spark, tmp_path / "in", FIRST, 1)
    args = ["--documents", f"{tmp_path}/in/part*", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark"]
    for _ in range(2):
        done = subprocess.run([sys.executable, "-m", "jobs.count_ingest", *args], cwd=ROOT, env=os.environ | {"SPARK_LOCAL_DIRS": str(tmp_path)}, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
    assert "read 0 documents" in done.stderr and found(spark, f"{tmp_path}/out") == brute(FIRST)


def test_profiles_are_renewed_only_for_what_is_new(spark, tmp_path, monkeypatch):
    """A run without new files leaves finished profiles alone; one after a run that broke off before they were written makes them."""
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    documents(spark, src, FIRST, 1)
    run = lambda: count_ingest.run(spark, f"{src}/part*", out, mark)
    made, real = [], count_ingest.profiles
    monkeypatch.setattr(count_ingest, "profiles", lambda *x: made.append(1) or real(*x))
    run(), run()
    assert made == [1] and found(spark, out) == brute(FIRST) and count_ingest.read(spark, out, "dispersion").count() == 1
    documents(spark, src, SECOND, 2)
    with monkeypatch.context() as m:
        m.setattr(count_ingest, "profiles", lambda *x: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run()
    assert run() == {"documents": 0, "batches": 0} and made == [1, 1]
    assert found(spark, out) == brute(FIRST + SECOND) and count_ingest.read(spark, out, "dispersion").count() == 1

"""Planted groups are found, one command equals its parts, and all queries agree with SQL."""

import json

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from countaxis import api
from countaxis.operators.states import Model
from countaxis.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def study(spark):
    """Eight barcodes of 20 cells, 60 genes on three chromosomes; gains on the first for half, on the second for the others."""
    r = np.random.default_rng(782)
    rate = np.full((60, 160), 20.0)
    rate[:20, :80], rate[20:40, 80:] = 30, 30
    n = r.poisson(rate)
    rows = [(f"g{g:02d}", f"c{c:03d}", int(n[g, c])) for g in range(60) for c in range(160)] + [("rest", f"c{c:03d}", int(10_000 - n[:, c].sum())) for c in range(160)]
    counts = spark.createDataFrame(rows, "gene string, cell string, n long").persist()
    features = spark.createDataFrame([(f"g{g:02d}",) for g in range(60)] + [("rest",)], "gene string")
    cells = spark.createDataFrame([(f"c{c:03d}", f"b{c // 20}") for c in range(160)], "cell string, barcode string")
    genes = spark.createDataFrame([(f"g{g:02d}", f"chr{g // 20 + 1}", g % 20 * 1_000_000 + 1) for g in range(60)], "gene string, chrom string, position long")
    alleles = [(f"c{c:03d}", "chr1", p * 1_000_000 + 500, 14 if (c // 20) in (0, 1) else 6, 6 if (c // 20) in (0, 1) else 14, 0.01 * p) for c in range(80) for p in range(19)]
    alleles = spark.createDataFrame(alleles, "cell string, chrom string, position long, h1 long, h2 long, genetic_cm double")
    return (counts, features), cells, genes, {f"g{g:02d}": 0.002 for g in range(60)}, alleles


SETTINGS = api.Settings(bootstraps=20, draws=16, permutations=19, window=11, model=Model(family="nb", outlier=0.0))


def test_planted_groups_are_found(spark, study, tmp_path):
    matrix, cells, genes, reference, _ = study
    result = api.infer(api.prepare(spark, matrix, cells, genes, reference), SETTINGS)
    label = {r.barcode: r.group for r in result.groups.collect()}
    assert len({label[f"b{i}"] for i in range(4)}) == len({label[f"b{i}"] for i in range(4, 8)}) == 1 and label["b0"] != label["b4"] and 0 not in label.values()
    assert result.signal.head().p_value == 1 / 20
    gain = {(r.barcode, r.marker): r.gain for r in result.barcode_cn().collect()}
    assert min(gain[f"b{b}", m] for b in range(4) for m in range(20)) > 0.9 and min(gain[f"b{b}", m] for b in range(4, 8) for m in range(20, 40)) > 0.9
    assert max(gain[f"b{b}", m] for b in range(8) for m in range(40, 60)) < 0.1
    states = {(r.group, r.chrom): r.label for r in result.group_segments.collect()}
    assert states[label["b0"], "chr1"] == 1 and states[label["b4"], "chr2"] == 1 and states[label["b0"], "chr3"] == 0
    evidence = {(r.member, r.chrom): r for r in result.barcode_evidence.collect()}
    assert evidence["b0", "chr1"].state == "gain" and evidence["b0", "chr1"].log_bf > 5 and evidence["b0", "chr3"].state == "diploid" and evidence["b0", "chr1"].genes == 20
    own = {(r.member, r.chrom): r for r in result.group_evidence.collect()}
    assert own[label["b4"], "chr2"].state == own[label["b4"], "chr2"].best == "gain" and own[label["b4"], "chr2"].log_bf > evidence["b4", "chr2"].log_bf
    with pytest.raises(ValueError):
        result.barcode_cn(["none"])
    result.save(str(tmp_path / "out"))
    assert json.loads((tmp_path / "out" / "run.json").read_text())["status"] == "complete" and result.about["hf_status"] == "no_usable_allele_counts"
    with pytest.raises(FileExistsError):
        result.save(str(tmp_path / "out"))


def test_haplotypes_split_groups(spark, study):
    matrix, cells, genes, reference, alleles = study
    result = api.run(spark, matrix, cells, genes, reference, alleles, settings=SETTINGS)
    label = {r.barcode: r.group for r in result.groups.collect()}
    assert result.about["hf_status"] == "fitted_phase" and label["b0"] == label["b1"] != label["b2"] == label["b3"]
    assert all(label[f"b{i}"] not in (label["b0"], label["b2"]) for i in range(4, 8))


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and a == pytest.approx(b, rel=1e-9, abs=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    key = lambda r: tuple("" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x) for x in r)
    want = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)
    out = entry.queries()[name](spark, SF)
    assert sorted(out.columns) == columns
    got = sorted((tuple(r[c] for c in columns) for r in out.collect()), key=key)
    assert len(got) == len(want) and all(same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", ["pln_logpmf", "ffbs_paths", "joint_chain", "expression_profiles"])
def test_queries_without_sql_run(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0

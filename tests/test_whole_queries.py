"""Registered queries do the whole job: no prefixes, no subsets of ids, the operators' own numbers of draws."""

import collections
import itertools

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from countaxis.plans import queries as plans

SF = "/root/testdata/sf0.001"
LENGTHS = {1: 75, 2: 62, 3: 90}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Events of three users, all longer than 60."""
    r = np.random.default_rng(7)
    rows = [(1000 * u + i, u, pd.Timestamp("2026-01-01") + pd.Timedelta(minutes=i), str(r.choice(["click", "view", "buy", "error"])), 1.0) for u, n in LENGTHS.items() for i in range(n)]
    out = tmp_path_factory.mktemp("events")
    pd.DataFrame(rows, columns=["event_id", "user_id", "ts", "event_type", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(out / "events.parquet")
    return str(out)


def paths_of(folder):
    events = pd.read_parquet(f"{folder}/events.parquet").sort_values(["user_id", "event_id"])
    return {u: g["event_type"].tolist() for u, g in events.groupby("user_id")}


def test_distances_take_whole_paths(spark, folder):
    paths = paths_of(folder)
    got = {(x.a, x.b): x.distance for x in entry.queries()["path_distance_pairs"](spark, folder).collect()}
    assert got == {(a, b): pytest.approx(np.mean([x != y for x, y in zip(paths[a], paths[b], strict=False)]), abs=1e-6) for a, b in itertools.combinations(sorted(paths), 2)}


def test_chains_take_whole_paths(spark, folder):
    evidence = {x.member: x.evidence for x in entry.queries()["forward_evidence_2state"](spark, folder).collect()}
    score = {x.member: x.score for x in entry.queries()["viterbi_2state"](spark, folder).collect()}
    steps = np.log([[0.9, 0.1], [0.2, 0.8]])
    for member, path in paths_of(folder).items():
        emission = np.array([[-0.4, -1.2] if x in ("click", "view") else [-1.6, -0.5] for x in path])
        total = best = np.log([0.5, 0.5]) + emission[0]
        for e in emission[1:]:
            total = np.logaddexp.reduce(total[:, None] + steps, 0) + e
            best = np.max(best[:, None] + steps, 0) + e
        assert evidence[member] == pytest.approx(np.logaddexp.reduce(total), abs=2e-6) and score[member] == pytest.approx(best.max(), abs=2e-6)
    drawn = collections.Counter(x.member for x in entry.queries()["ffbs_paths"](spark, folder).collect())
    assert drawn == LENGTHS


@pytest.mark.parametrize("name", ["path_distance_pairs", "forward_evidence_2state", "viterbi_2state"])
def test_whole_paths_agree_with_sql_without_its_cut(spark, folder, name):
    """The registered SQL still cuts paths (see REPLY_r01.md); without the cut it says what the query says."""
    sql = plans.SQL[name].replace(" WHERE marker < 40", "").replace(" WHERE marker < 60", "")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{folder}/events.parquet'")
    want = con.sql(sql)
    got = entry.queries()[name](spark, folder).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == [pytest.approx(x, abs=2e-6) for x in sorted(want.fetchall())]


def test_joint_chain_covers_all_chromosomes(spark):
    b = plans.Bound(spark, SF)
    whole = entry.queries()["joint_chain"](spark, SF).persist()
    genes, loci = (x.toPandas() for x in (b.genes(), b.loci()))
    assert {x.chrom for x in whole.select("chrom").distinct().collect()} == {*genes["chrom"], *loci["chrom"]}
    places = {*zip(genes["chrom"], genes["position"], strict=True), *zip(loci["chrom"], loci["position"] + 500, strict=True)}
    assert whole.select("marker").distinct().count() == len(places)
    two = "chrom in ('11', '12')"
    part = plans._joint_chain(b, b.genes().filter(two), b.loci().filter(two))
    key = ["member", "chrom", "marker"]
    want, got = (x.select("member", "chrom", "marker", "p", "evidence").toPandas().sort_values(key) for x in (whole.filter(two), part))
    assert len(got) == len(want) > 0
    assert np.allclose(np.stack(got["p"]), np.stack(want["p"]), atol=1e-9) and np.allclose(got["evidence"], want["evidence"])


@pytest.mark.parametrize("name, module, function, want", [
    ("permutation_signal", "regions", "signal_test", {"permutations": 199}),
    ("bootstrap_blocks", "resample", "bootstrap_profiles", {"replicates": 64, "window": 101}),
    ("clone_calls", "resample", "bootstrap_profiles", {"replicates": 64, "window": 101}),
])
def test_queries_take_the_operators_numbers(spark, monkeypatch, name, module, function, want):
    import inspect

    class Called(Exception):
        pass

    module = getattr(plans, module)
    signature, seen = inspect.signature(getattr(module, function)), {}

    def called(*a, **b):
        bound = signature.bind(*a, **b)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise Called

    monkeypatch.setattr(module, function, called)
    with pytest.raises(Called):
        entry.queries()[name](spark, SF)
    assert {k: seen[k] for k in want} == want


def test_signal_reaches_one_in_two_hundred(spark):
    p = entry.entry(spark).head().p_value
    assert p * 200 == pytest.approx(round(p * 200)) and p >= 1 / 200

"""Chains and fits against enumeration of all paths."""

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from countaxis.operators import fitting, hmm
from countaxis.operators.states import CLASSES, STATES, Model, Parameters, allele_logs, depth_logs


def paths_of(initial, logs, emission):
    """All paths with their log probabilities."""
    places, states = emission.shape
    paths = np.array(list(itertools.product(range(states), repeat=places)))
    score = initial[paths[:, 0]] + emission[np.arange(places), paths].sum(1)
    return paths, score + sum(logs[t][paths[:, t], paths[:, t + 1]] for t in range(places - 1))


def chain(seed, places=4, k=2, phases=True):
    r = np.random.default_rng(seed)
    prior = r.dirichlet(np.ones(k))
    switch = np.array([[0.0, 0.5, 0.3, 0.0][t % 4] for t in range(places - 1)]) if phases else None
    rho = np.append(r.random(places - 2), 0.0)
    steps = hmm.Structured(rho, prior, switch)
    initial = np.log(np.repeat(prior, 2) / 2) if phases else np.log(prior)
    return steps, initial, r.normal(size=(3, places, 2 * k if phases else k)) * 2


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("phases", [True, False])
def test_chains_against_enumeration(seed, phases):
    steps, initial, emission = chain(seed, phases=phases)
    dense = hmm.Dense(np.array([steps.matrix(t) for t in range(3)]))
    for s in (steps, dense):
        p, score = hmm.marginals(initial, s, emission)
        best = hmm.viterbi(initial, s, emission)
        for b in range(3):
            paths, logs = paths_of(initial, dense.logs, emission[b])
            total = np.logaddexp.reduce(logs)
            want = np.array([[np.exp(logs[paths[:, t] == k] - total).sum() for k in range(emission.shape[2])] for t in range(4)])
            assert score[b] == pytest.approx(total, abs=1e-12) and np.allclose(p[b], want, atol=1e-12)
            assert tuple(best[b]) == tuple(paths[np.argmax(logs)])
        assert np.allclose(hmm.evidence(initial, s, emission), score, atol=1e-12)


def test_sampled_paths_have_the_posterior_frequencies():
    steps, initial, emission = chain(5, places=3, phases=False)
    ahead, _ = hmm.filtered(initial, steps, emission[:1])
    drawn = hmm.sampled(ahead[0], steps, np.random.default_rng(1).random((40_000, 3)))
    paths, logs = paths_of(initial, [steps.matrix(t) for t in range(2)], emission[0])
    want = np.exp(logs - np.logaddexp.reduce(logs))
    got = np.array([(drawn == p).all(1).mean() for p in paths])
    assert np.abs(got - want).max() < 0.01


def test_far_behind_paths_recover_and_bad_input_is_refused():
    steps = hmm.Dense(np.log(np.array([[[1e-300, 1.0], [0.5, 0.5]]])))
    p, _ = hmm.marginals(np.log([0.5, 0.5]), steps, np.array([[[0.0, -1000.0], [-2000.0, 0.0]]]))
    assert np.isfinite(p).all() and p[0, 1, 1] == pytest.approx(1)
    with pytest.raises(ValueError):
        hmm.Dense(np.log(np.array([[[0.5, 0.4], [0.5, 0.5]]])))
    with pytest.raises(ValueError):
        hmm.marginals(np.log([0.5, 0.4]), steps, np.zeros((1, 2, 2)))
    with pytest.raises(ValueError):
        hmm.marginals(np.log([0.5, 0.5]), steps, np.full((1, 2, 2), np.nan))


def test_chromosomes_part():
    steps, initial, emission = chain(7, places=6)
    cut = 3
    steps.rho[cut - 1], steps.switch[cut - 1] = 0.0, 0.5
    p, score = hmm.marginals(initial, steps, emission)
    left = hmm.marginals(initial, hmm.Structured(steps.rho[: cut - 1], steps.prior, steps.switch[: cut - 1]), emission[:, :cut])
    right = hmm.marginals(initial, hmm.Structured(steps.rho[cut:], steps.prior, steps.switch[cut:]), emission[:, cut:])
    assert np.allclose(score, left[1] + right[1], atol=1e-12) and np.allclose(p, np.concatenate([left[0], right[0]], 1), atol=1e-12)


def test_constant_segments_against_enumeration():
    steps, _, emission = chain(3, places=4)
    got = hmm.constant_segments(emission[0], steps.switch, 1, 4)
    for c in range(2):
        total = []
        for z in itertools.product(range(2), repeat=3):
            logs = [np.log(0.5)] + [np.log(s if a != b else 1 - s) if (s if a != b else 1 - s) > 0 else -np.inf for a, b, s in zip(z, z[1:], steps.switch[1:], strict=False)]
            total.append(sum(logs) + sum(emission[0, 1 + t, 2 * c + z[t]] for t in range(3)))
        assert got[c] == pytest.approx(np.logaddexp.reduce(total), abs=1e-12)


@pytest.fixture
def counts():
    markers = pd.DataFrame({"marker": range(6), "chrom": ["1"] * 4 + ["2"] * 2, "start": [1, 1_000_001, 2_000_001, 3_000_001, 1, 1_000_001]})
    markers["end"] = markers["start"]
    loci = pd.DataFrame({"locus": range(4), "marker": [0, 2, 4, 5], "population_phase": [0.9, 0.8, 0.9, 0.7], "genetic_cm": [0, 0.2, 0, 0.1]})
    depth = pd.DataFrame({"group": np.repeat([0, 1], 6), "marker": np.tile(range(6), 2), "n": [18, 20, 23, 19, 10, 11, 10, 11, 9, 10, 19, 21], "expected": 10.0, "weight": 1.0})
    alleles = pd.DataFrame({"group": [0, 0, 0, 1, 1, 1], "locus": [0, 1, 2, 0, 1, 3], "h1": [14, 16, 5, 6, 5, 14], "h2": [6, 4, 5, 4, 5, 6], "het": 1.0})
    return markers, loci, depth, alleles


def build(parts, model):
    markers, loci, depth, alleles = parts
    return fitting.Counts(fitting.Axis.of(markers, loci, model), 2, depth, alleles)


def test_states_and_prior():
    assert STATES.labels == ("diploid", "del", "del", "loh", "loh", "gain", "gain", "amp", "amp", "bdel") and len(CLASSES) == 4
    assert Model().initial.sum() == pytest.approx(1) and Model().initial[0] == 0.8 and Model().initial[1] == pytest.approx(0.02)
    assert np.allclose(STATES.classes(np.eye(10)).argmax(1), STATES.broad)


def test_swapping_haplotypes_swaps_orientations():
    a = allele_logs(Model(), Parameters(0.1), np.array([9.0]), np.array([3.0]), np.array([0.8]))
    b = allele_logs(Model(), Parameters(0.1), np.array([3.0]), np.array([9.0]), np.array([0.8]))
    assert np.allclose(a[..., 0], b[..., 1]) and np.allclose(a[..., 1], b[..., 0])
    assert (depth_logs(Model(), Parameters(0.1), np.array([5.0]), np.array([0.0])) == 0).all()


def test_phase_fit_climbs_and_recovers(counts):
    fit = fitting.fit_phase(build(counts, Model(family="nb", outlier=0.0)), Model(family="nb", outlier=0.0), Parameters(0.15), fitting.Options(iterations=100))
    assert fit.converged and fit.iterations == 14 and fit.bound == pytest.approx(-54.70453284457997, abs=1e-9)
    gain = STATES.classes(fit.probabilities)[..., 1]
    assert gain[0, :4].min() > 0.5 and gain[1, 4:].min() > 2 * gain[1, :4].max() and gain[0, 4:].max() < 0.5


def test_sampled_paths_make_distributions_for_many_places_at_once():
    """The same paths as place by place, with one call for the transitions of all places of a stretch."""
    r = np.random.default_rng(3)
    places, k = hmm.PLACES + 70, 3
    rho, switch, prior = r.random(places - 1), r.random(places - 1), r.dirichlet(np.ones(k))
    rho[::50], switch[::9] = 0, 0
    steps, calls = hmm.Structured(rho, prior, switch), []
    ahead, _ = hmm.filtered(np.log(np.repeat(prior, 2) / 2), steps, r.normal(size=(1, places, 2 * k)) * 3)
    u = r.random((8, places))

    class Counted:
        def into(self, low, high):
            calls.append(high - low)
            return steps.into(low, high)

    got, want = hmm.sampled(ahead[0], Counted(), u), np.empty((8, places), int)
    for d in range(8):
        logs = ahead[0][-1]
        for t in range(places - 1, -1, -1):
            total = np.cumsum(np.exp(logs - logs.max()))
            want[d, t] = min((total <= u[d, t] * total[-1]).sum(), 2 * k - 1)
            logs = ahead[0][t - 1] + steps.matrix(t - 1)[:, want[d, t]] if t else logs
    assert (got == want).all() and calls == [hmm.PLACES, 69]


def test_joint_chain_against_enumeration():
    model = Model(family="nb", outlier=0.0, locus_weight=0.5)
    markers = pd.DataFrame({"marker": [0, 1], "chrom": ["1", "1"], "start": [1, 5_000_000], "end": [1, 5_000_000]})
    loci = pd.DataFrame({"locus": [0, 1], "marker": [0, 1], "population_phase": [0.9, 0.6], "genetic_cm": [0.0, 0.3]})
    depth = pd.DataFrame({"group": [0, 0], "marker": [0, 1], "n": [14, 9], "expected": [10.0, 10.0], "weight": 1.0})
    alleles = pd.DataFrame({"group": [0, 0], "locus": [0, 1], "h1": [7, 3], "h2": [2, 3], "het": [1.0, 0.7]})
    c = fitting.Counts(fitting.Axis.of(markers, loci, model), 1, depth, alleles)
    p, phase, score = fitting.infer_joint(c, model, Parameters(0.2))
    d, t = c.depth_sums(model, Parameters(0.2))[0], c.terms(model, Parameters(0.2))
    total, share, first = [], np.zeros((2, 10)), np.zeros(2)
    rho, s = np.exp(-4_999_999 / 30e6), (1 - np.exp(-2 * 0.3)) / 2
    for c0, z0, c1, z1 in itertools.product(range(10), range(2), range(10), range(2)):
        step = (rho * (c0 == c1) + (1 - rho) * model.initial[c1]) * (s if z0 != z1 else 1 - s)
        pop = 0.5 * (np.log([0.9, 0.1][z0]) + np.log([0.6, 0.4][z1]))
        v = np.log(model.initial[c0] / 2) + np.log(step) + d[0, c0] + d[1, c1] + t[0, c0, z0] + t[1, c1, z1] + pop
        total.append(v)
        share[0, c0] += np.exp(v)
        share[1, c1] += np.exp(v)
        first += np.exp(v) * np.array([z0 == 0, z1 == 0])
    z = np.logaddexp.reduce(total)
    assert score[0] == pytest.approx(z, abs=1e-12) and np.allclose(p[0], share / np.exp(z), atol=1e-12) and np.allclose(phase[0], first / np.exp(z), atol=1e-12)
    with pytest.raises(ValueError):
        fitting.check_distinct(fitting.Axis(np.array(["1"]), np.zeros(1), np.array([0, 0]), np.full(2, 0.5), np.full(2, 0.5)))


def test_searches():
    x, fx, done = fitting.bounded_minimum(lambda v: (v - 0.3) ** 2 + 1, -2, 2, 1e-4, 50)
    assert done and x == pytest.approx(0.3, abs=1e-4) and fx == pytest.approx(1)
    x, _, done = fitting.bounded_minimum(lambda v: v, 0, 1, 1e-3, 60)
    assert done and x < 2e-3


def test_members_on_executors_equal_the_driver(spark, counts):
    model, parameters = Model(family="nb", outlier=0.0), Parameters(0.15, 0.1)
    c = build(counts, model)
    p, phase, score = fitting.infer_joint(c, model, parameters)
    markers, loci, depth, alleles = counts
    rows = fitting.member_rows(spark.createDataFrame(depth.rename(columns={"group": "member"})), spark.createDataFrame(alleles.rename(columns={"group": "member"})), spark.createDataFrame(markers), spark.createDataFrame(loci))
    first = None
    for parts in (1, 3, 7):
        got = fitting.infer_members(rows.repartition(parts), c.axis, model, parameters, 5, {0: 11, 1: 12}).toPandas().sort_values(["member", "marker"])
        assert np.allclose(np.stack(got["p"].to_numpy()).reshape(2, 6, 10), p, atol=1e-12)
        assert np.allclose(got["first_phase"].to_numpy(float).reshape(2, 6)[:, c.axis.locus_marker], phase, atol=1e-12)
        by = got.drop_duplicates(["member", "chrom"]).groupby("member")["evidence"].sum()
        assert np.allclose(by.to_numpy(), score, atol=1e-10)
        paths = np.stack(got["path"].to_numpy())
        first = paths if first is None else first
        assert (paths == first).all() and paths.shape == (12, 5)
    fit = fitting.fit_member_dispersion(rows, c.axis, model, c.start(), points=5)
    assert fit.parameters.alpha == pytest.approx(fitting.fit_joint_dispersion(c, model).parameters.alpha, rel=0.05)


def test_segment_calls():
    model = Model(family="nb", outlier=0.0)
    markers = pd.DataFrame({"marker": range(12), "chrom": ["1"] * 12, "start": np.arange(12) * 10**6 + 1, "end": np.arange(12) * 10**6 + 1})
    loci = pd.DataFrame({"locus": [], "marker": [], "population_phase": [], "genetic_cm": []})
    n = np.array([20] * 4 + [60] * 4 + [20] * 4)
    depth = pd.DataFrame({"group": 0, "marker": range(12), "n": n, "expected": 20.0, "weight": 1.0})
    c = fitting.Counts(fitting.Axis.of(markers, loci, model), 1, depth, pd.DataFrame({"group": [], "locus": [], "h1": [], "h2": [], "het": []}))
    emission = fitting.joint_emissions(c.depth_sums(model, Parameters(0.01)), *c.places, c.terms(model, Parameters(0.01)), c.axis, model)[0]
    calls = fitting.segment_calls(emission, c.axis, model, np.ones(12, int))
    assert calls["state"].tolist() == ["diploid", "gain", "diploid"] and calls["first"].tolist() == [0, 4, 8] and calls["log_bf"][1] > 5 and calls["log_bf"][0] == 0 and calls["genes"].tolist() == [4, 4, 4]


def test_evidence_of_runs_anywhere():
    """Runs that overlap, of one place and of many, against the recursion of one run, and with certain phases."""
    from countaxis.operators import segments

    r = np.random.default_rng(4)
    emission, switch = r.normal(size=(75, 3, 2)), r.random(75) * 0.5
    switch[[3, 9]] = 0.0, 0.5
    emission[20, 1, 0] = -np.inf
    starts = np.concatenate((np.arange(75), r.integers(0, 75, 200)))
    stops = np.concatenate((np.arange(75) + 1, starts[75:] + 1 + r.integers(0, 75, 200))).clip(max=75)
    got = segments.run_evidence(emission, switch, starts, stops)
    want = [hmm.constant_segments(emission.reshape(75, -1), switch[1:], a, b) for a, b in zip(starts, stops, strict=True)]
    assert np.allclose(got, want, atol=1e-10) and segments.run_evidence(emission, switch, [], []).shape == (0, 3)
    assert np.allclose(segments.run_evidence(np.zeros((9, 2, 2)), switch[:9], [0, 2], [9, 5]), 0)
    for wrong in ([3], [3]), ([0], [76]), ([-1], [2]):
        with pytest.raises(ValueError):
            segments.run_evidence(emission, switch, *wrong)


def test_segments_of_members_agree_with_the_whole_chain(spark):
    """Chromosome by chromosome on the executors as in one chain over all of them."""
    from countaxis.operators import segments

    r = np.random.default_rng(6)
    markers = pd.DataFrame({"marker": range(40), "chrom": ["1"] * 25 + ["2"] * 15, "start": range(1, 40_000_001, 1_000_000), "end": range(1, 40_000_001, 1_000_000)})
    loci = pd.DataFrame({"locus": range(4), "marker": [3, 7, 12, 30], "population_phase": [0.2, 0.9, 0.5, 0.7], "genetic_cm": [0.1, 0.2, 0.4, 0.1]})
    model = Model(family="nb", outlier=0.0)
    ax, parameters = fitting.Axis.of(markers, loci, model), Parameters(0.1)
    rows = []
    for g in range(3):
        rows += [(f"m{g}", markers["chrom"][m], m, 0, float(r.poisson(60 if g == 1 and m < 15 else 30)), 30.0, 1.0) for m in range(40) for _ in range(2)]
        rows += [(f"m{g}", markers["chrom"][m], m, 1, float(r.poisson(9)), float(r.poisson(4)), 0.9) for m in loci["marker"]]
    frame = spark.createDataFrame(rows, "member string, chrom string, marker int, kind int, a double, b double, w double")
    got = {(x.member, x.first): x for x in segments.member_segments(frame, ax, model, parameters).collect()}
    for g in range(3):
        own = pd.DataFrame([x for x in rows if x[0] == f"m{g}"], columns=fitting.ROWS)
        emission = fitting._member_emission(own, ax, 0, model, parameters, parameters)[0]
        want = fitting.segment_calls(emission, ax, model, np.full(40, 2))
        assert len(want) == sum(k[0] == f"m{g}" for k in got)
        for x in want.itertuples():
            y = got[f"m{g}", x.first]
            assert (y.chrom, y.last, y.state, y.genes, y.best) == (x.chrom, x.last, x.state, x.genes, x.best) and y.log_bf == pytest.approx(x.log_bf, abs=1e-8)
    assert any(x.state == "gain" and x.log_bf > 5 for x in got.values())
    grid = spark.createDataFrame(markers)
    kept = segments.placed(spark.createDataFrame(list(got.values())), grid, 1e9).collect()
    assert {x.state for x in kept} == {"diploid"} and {x.raw_state for x in kept} == {x.state for x in got.values()} and all(x.end >= x.start for x in kept)


def test_many_members_in_stretches_equal_whole_chains(spark, counts, monkeypatch):
    """Members together, a stretch of places after another, with the axis as rows: bit for bit what each member's whole chain gives."""
    model, parameters = Model(family="nb", outlier=0.0), Parameters(0.15, 0.1)
    c = build(counts, model)
    markers, loci, depth, alleles = counts
    tables = [spark.createDataFrame(x) for x in (depth.rename(columns={"group": "member"}), alleles.rename(columns={"group": "member"}), markers, loci)]
    rows = fitting.member_rows(*tables)
    for axis, places, size in ((c.axis, 1024, 32 << 20), (fitting.axis_rows(*tables[2:]), 1024, 32 << 20), (fitting.axis_rows(*tables[2:]), 1, 1)):
        monkeypatch.setattr(hmm, "PLACES", places)
        monkeypatch.setattr(fitting, "CHAIN_BYTES", size)
        run = {r.member: [] for r in rows.select("member").distinct().collect()}
        tasks = [x for x in rows.toPandas().groupby("chrom")]
        for chrom, own in tasks:
            whole = fitting.axis_rows(*tables[2:]).filter(f"chrom = '{chrom}'").toPandas().assign(member=None, w=None)
            table = pa.Table.from_pandas(pd.concat([own, whole])[["member", "marker", "kind", "a", "b", "w"]], preserve_index=False)
            for batch in fitting._infer(chrom, table, axis if isinstance(axis, fitting.Axis) else None, model, parameters, parameters, 7, {0: 11, 1: 12}):
                for r in batch.to_pylist():
                    run[r["member"]].append(r)
        for member, got in run.items():
            got = sorted(got, key=lambda r: r["marker"])
            for chrom, own in tasks:
                at, cut = fitting._chromosome(c.axis, chrom)
                steps, initial = fitting.chain_steps(cut, model, True)
                ahead = hmm.filtered(initial, steps, fitting._member_emission(own[own["member"] == member], cut, int(at[0]), model, parameters, parameters))
                uniforms = np.random.default_rng([11 + member, int(at[0])]).random((7, len(at)))
                want = fitting.STATES.broad[hmm.sampled(ahead[0][0], steps, uniforms) // 2]
                some = [r for r in got if r["chrom"] == chrom]
                assert [r["marker"] for r in some] == at.tolist() and np.array([r["path"] for r in some]).T.tolist() == want.tolist()
                assert {r["evidence"] for r in some} == {ahead[1][0]}
                back = fitting._member_emission(own[own["member"] == member], cut, int(at[0]), model, parameters, parameters)
                assert np.array_equal([r["p"] for r in some], hmm.marginals(initial, steps, back, ahead)[0][0].reshape(len(at), -1, 2).sum(-1))


def test_joint_chain_keeps_the_axis_off_the_driver(spark, monkeypatch):
    from pyspark.sql import DataFrame

    import __spark_entry__ as entry

    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("markers in the driver"))
    assert entry.queries()["joint_chain"](spark, "/root/testdata/sf0.001").count() > 0

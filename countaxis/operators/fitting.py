"""Fitting loops on the driver over pooled groups (a few), and inference over many members by Arrow batches.

A pooled fit handles as many chains as there are pooled groups, so its tables are collected; the members' chains are grouped
by member and chromosome on the executors, since at a chromosome's start everything is drawn anew: log evidences add up
over chromosomes, and marginals and paths are each chromosome's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countaxis.operators import hmm
from countaxis.operators.states import CLASSES, STATES, Model, Parameters, allele_logs, depth_logs

#: Bounds of the dispersion search, as standard deviations of the log rate.
SIGMA_BOUNDS = (0.02, 2.0)


@dataclass(frozen=True)
class Options:
    start: str = "multistart"
    iterations: int = 60
    tolerance: float = 1e-4
    search_iterations: int = 35
    search_tolerance: float = 1e-3

    def __post_init__(self):
        if self.start not in ("multistart", "population", "pooled_imbalance") or min(self.iterations, self.search_iterations) < 1 or min(self.tolerance, self.search_tolerance) <= 0:
            raise ValueError("invalid fitting options")


@dataclass
class Axis:
    """Markers in order, with the chance to stay since the one before (0 at a chromosome's first), and loci on them."""

    chrom: np.ndarray
    rho: np.ndarray
    locus_marker: np.ndarray
    population: np.ndarray
    locus_switch: np.ndarray

    @classmethod
    def of(cls, markers: pd.DataFrame, loci: pd.DataFrame, model: Model) -> Axis:
        """markers: marker, chrom, start, end; loci: locus, marker, population_phase, genetic_cm; both in order."""
        chrom = markers["chrom"].to_numpy(str)
        middle = (markers["start"].to_numpy(float) + markers["end"].to_numpy(float)) / 2
        rho = np.exp(-np.append(np.inf, np.diff(middle)) / model.correlation_length)
        rho[np.append(True, chrom[1:] != chrom[:-1])] = 0
        at = loci["marker"].to_numpy(int)
        switch = np.full(len(at), 0.5)
        if len(at) > 1:
            same = chrom[at[1:]] == chrom[at[:-1]]
            gap = np.where(same, np.diff(loci["genetic_cm"].to_numpy(float)), 0.0)
            switch[1:] = np.where(same, -np.expm1(-2 * model.switch_rate * gap) / 2, 0.5)
        return cls(chrom, rho, at, np.clip(loci["population_phase"].to_numpy(float), 1e-6, 1 - 1e-6), switch)

    def switches(self) -> np.ndarray:
        """The chance of a phase switch on entry to each marker: none between loci, even at a chromosome's first."""
        out = np.zeros(len(self.rho))
        out[self.locus_marker] = self.locus_switch
        out[self.rho == 0] = 0.5
        return out


@dataclass
class Counts:
    """Long tables of a few groups: depth (group, marker, n, expected, weight) and alleles (group, locus, h1, h2, het)."""

    axis: Axis
    groups: int
    depth: pd.DataFrame
    alleles: pd.DataFrame
    cache: dict = field(default_factory=dict)

    def depth_sums(self, model: Model, parameters: Parameters) -> np.ndarray:
        d = self.depth
        logs = depth_logs(model, parameters, d["n"].to_numpy(float), d["expected"].to_numpy(float))
        out = np.zeros((self.groups, len(self.axis.rho), len(STATES)))
        np.add.at(out, (d["group"].to_numpy(int), d["marker"].to_numpy(int)), logs * d["weight"].to_numpy(float)[:, None])
        return out

    def terms(self, model: Model, parameters: Parameters) -> np.ndarray:
        a = self.alleles
        return allele_logs(model, parameters, a["h1"].to_numpy(float), a["h2"].to_numpy(float), a["het"].to_numpy(float))

    @property
    def places(self) -> tuple[np.ndarray, np.ndarray]:
        return self.alleles["group"].to_numpy(int), self.axis.locus_marker[self.alleles["locus"].to_numpy(int)] if len(self.alleles) else np.zeros(0, int)

    def start(self) -> Parameters:
        """Dispersion from the median absolute deviation of log ratios, bias from the first haplotype's share."""
        use = (self.depth["n"] > 0) & (self.depth["expected"] > 0)
        ratio = np.log(self.depth["n"][use].to_numpy(float) / self.depth["expected"][use].to_numpy(float))
        sigma = max(0.05, 1.4826 * float(np.median(np.abs(ratio - np.median(ratio))))) if len(ratio) >= 2 else 0.5
        h1, h2 = float(self.alleles["h1"].sum()), float(self.alleles["h2"].sum())
        share = min(max(h1 / (h1 + h2), 0.45), 0.55) if h1 + h2 else 0.5
        return Parameters(float(np.expm1(sigma**2)), float(np.log(share / (1 - share))))


def chain_steps(axis: Axis, model: Model, phases: bool) -> tuple[hmm.Structured, np.ndarray]:
    """Steps and initial distribution of the copy-number chain, with two phases or without."""
    switch = axis.switches()[1:] if phases else None
    initial = np.log(np.repeat(model.initial, 2) / 2) if phases else np.log(model.initial)
    return hmm.Structured(axis.rho[1:], model.initial, switch), initial


@dataclass
class PhaseFit:
    phase: np.ndarray
    probabilities: np.ndarray
    evidence: np.ndarray
    converged: bool
    iterations: int
    start: str
    bound: float
    changes: list[float]


def fit_phase(counts: Counts, model: Model, parameters: Parameters, options: Options = Options()) -> PhaseFit:
    """Alternates copy-number chains at fixed phase and a phase chain at fixed copy numbers, from each start; the best bound wins."""
    axis = counts.axis
    depth, terms = counts.depth_sums(model, parameters), counts.terms(model, parameters)
    group, marker = counts.places
    locus = counts.alleles["locus"].to_numpy(int)
    steps, initial = chain_steps(axis, model, False)

    def infer(phase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        emission = depth.copy()
        q = phase[locus][:, None]
        np.add.at(emission, (group, marker), q * terms[..., 0] + (1 - q) * terms[..., 1])
        return hmm.marginals(initial, steps, emission)

    if not len(axis.population):
        p, score = infer(axis.population)
        return PhaseFit(axis.population, p, score, True, 1, "population" if options.start == "multistart" else options.start, float(score.sum()), [])
    unary = model.locus_weight * np.stack([np.log(axis.population), np.log1p(-axis.population)], -1)
    turn = axis.locus_switch[1:]
    with np.errstate(divide="ignore"):
        phase_steps = hmm.Dense(np.log(np.stack([np.stack([1 - turn, turn], -1), np.stack([turn, 1 - turn], -1)], -2)))
    best = None
    for start in ("population", "pooled_imbalance") if options.start == "multistart" else (options.start,):
        phase, changes, converged = axis.population.copy(), [], False
        if start == "pooled_imbalance":
            lean = np.bincount(locus, weights=counts.alleles["het"] * (counts.alleles["h1"] - counts.alleles["h2"]), minlength=len(phase))
            phase = np.where(lean > 0, 0.99, np.where(lean < 0, 0.01, phase))
        for _ in range(options.iterations):
            p, _score = infer(phase)
            potential = unary.copy()
            np.add.at(potential, locus, np.einsum("rs,rso->ro", p[group, marker], terms))
            q, score = hmm.marginals(np.log([0.5, 0.5]), phase_steps, potential[None])
            changes.append(float(np.max(np.abs(q[0, :, 0] - phase))))
            phase = q[0, :, 0]
            entropy = float(score[0] - (q[0] * (potential - unary)).sum())
            if changes[-1] < options.tolerance:
                converged = True
                break
        p, score = infer(phase)
        fit = PhaseFit(phase, p, score, converged, len(changes), start, float(score.sum()) + entropy, changes)
        best = fit if best is None or fit.bound > best.bound else best
    return best


def bounded_minimum(f: Callable[[float], float], low: float, high: float, tolerance: float, iterations: int) -> tuple[float, float, bool]:
    """Brent's method on an interval: golden sections, and parabolas where they help. Place, value, whether it converged."""
    golden = (3 - 5**0.5) / 2
    x = w = v = low + golden * (high - low)
    fx = fw = fv = f(x)
    step = last = 0.0
    for _ in range(iterations - 1):
        middle, tiny = (low + high) / 2, 1.5e-8 * abs(x) + tolerance / 3
        if abs(x - middle) <= 2 * tiny - (high - low) / 2:
            return x, fx, True
        parabola = False
        if abs(last) > tiny:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
            before, last = last, step
            if abs(p) < abs(q * before / 2) and q * (low - x) < p < q * (high - x):
                step, parabola = p / q, True
                if min(x + step - low, high - x - step) < 2 * tiny:
                    step = tiny if x < middle else -tiny
        if not parabola:
            last = (low if x >= middle else high) - x
            step = golden * last
        u = x + (step if abs(step) >= tiny else (tiny if step > 0 else -tiny))
        fu = f(u)
        if fu <= fx:
            low, high = (x, high) if u >= x else (low, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            low, high = (u, high) if u < x else (low, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x, fx, False


@dataclass
class DispersionFit:
    parameters: Parameters
    start: Parameters
    converged: bool
    at_boundary: bool
    gain: float
    trace: list[tuple[float, float]]


def search_dispersion(start: Parameters, score: Callable[[Parameters], float], options: Options = Options()) -> DispersionFit:
    """The alpha with the largest score, searched over the logarithm of sigma; the start stays if nothing is better."""
    trace: list[tuple[float, float]] = []

    def loss(log_sigma: float) -> float:
        alpha = float(np.expm1(np.exp(2 * log_sigma)))
        trace.append((alpha, -score(replace(start, alpha=alpha))))
        return trace[-1][1]

    low, high = np.log(SIGMA_BOUNDS)
    base = loss(np.log(start.sigma))
    x, fx, done = bounded_minimum(loss, low, high, options.search_tolerance, options.search_iterations)
    alpha = float(np.expm1(np.exp(2 * x))) if fx <= base else start.alpha
    at = np.log(np.sqrt(np.log1p(alpha)))
    return DispersionFit(replace(start, alpha=alpha), start, done, bool(at <= low + 0.011 or at >= high - 0.011), float(base - min(base, fx)), trace)


def fit_dispersion(counts: Counts, model: Model, phase: np.ndarray, options: Options = Options()) -> DispersionFit:
    start = counts.start()
    steps, initial = chain_steps(counts.axis, model, False)
    terms, (group, marker) = counts.terms(model, start), counts.places
    q = phase[counts.alleles["locus"].to_numpy(int)][:, None]

    def score(parameters: Parameters) -> float:
        emission = counts.depth_sums(model, parameters)
        np.add.at(emission, (group, marker), q * terms[..., 0] + (1 - q) * terms[..., 1])
        return float(hmm.evidence(initial, steps, emission).sum())

    return search_dispersion(start, score, options)


@dataclass
class PooledFit:
    first: PhaseFit
    dispersion: DispersionFit
    final: PhaseFit


def fit_pooled(counts: Counts, model: Model = Model(), options: Options = Options()) -> PooledFit:
    """Phase, dispersion, phase again. What doesn't converge is an error."""
    first = fit_phase(counts, model, counts.start(), options)
    if not first.converged:
        raise RuntimeError("the first phase fit didn't converge")
    noise = fit_dispersion(counts, model, first.phase, options)
    if not noise.converged:
        raise RuntimeError("the dispersion search didn't converge")
    final = fit_phase(counts, model, noise.parameters, options)
    return PooledFit(first, noise, final)


def joint_emissions(depth: np.ndarray, group: np.ndarray, marker: np.ndarray, terms: np.ndarray, axis: Axis, model: Model) -> np.ndarray:
    """Groups x markers x (states x phases)."""
    out = np.repeat(depth[..., None], 2, -1)
    np.add.at(out, (group, marker), terms)
    if model.locus_weight and len(axis.locus_marker):
        out[:, axis.locus_marker] += model.locus_weight * np.stack([np.log(axis.population), np.log1p(-axis.population)], -1)[:, None, :]
    return out.reshape(*out.shape[:2], -1)


def check_distinct(axis: Axis) -> None:
    if (np.diff(axis.locus_marker) == 0).any():
        raise ValueError("each locus needs a marker of its own")


def infer_joint(counts: Counts, model: Model, parameters: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State probabilities (groups x markers x states), first-phase probabilities at loci, log evidences."""
    check_distinct(counts.axis)
    steps, initial = chain_steps(counts.axis, model, True)
    emission = joint_emissions(counts.depth_sums(model, parameters), *counts.places, counts.terms(model, parameters), counts.axis, model)
    p, score = hmm.marginals(initial, steps, emission)
    p = p.reshape(*p.shape[:2], len(STATES), 2)
    return p.sum(-1), p[:, counts.axis.locus_marker].sum(2)[..., 0], score


def fit_joint_dispersion(counts: Counts, model: Model, options: Options = Options()) -> DispersionFit:
    check_distinct(counts.axis)
    start = counts.start()
    steps, initial = chain_steps(counts.axis, model, True)
    terms = counts.terms(model, start)

    def score(parameters: Parameters) -> float:
        return float(hmm.evidence(initial, steps, joint_emissions(counts.depth_sums(model, parameters), *counts.places, terms, counts.axis, model)).sum())

    return search_dispersion(start, score, options)


# Members on the executors. rows: member, chrom, marker, kind (0 depth, 1 allele), a, b, w: n, expected, weight; or h1, h2, het.
ROWS = ["member", "chrom", "marker", "kind", "a", "b", "w"]


def member_rows(depth: DataFrame, alleles: DataFrame, markers: DataFrame, loci: DataFrame) -> DataFrame:
    """depth: member, marker, n, expected (chrom, if it is at hand); alleles: member, locus, h1, h2, het; both long, with their markers'
    chromosomes."""
    named = markers.select("marker", "chrom")
    d = (depth if "chrom" in depth.columns else depth.join(named, "marker")).select("member", "chrom", "marker", F.lit(0).alias("kind"), F.col("n").cast("double").alias("a"), F.col("expected").cast("double").alias("b"), F.lit(1.0).alias("w"))
    a = alleles.join(loci.select("locus", "marker"), "locus").join(named, "marker").select("member", "chrom", "marker", F.lit(1).alias("kind"), F.col("h1").cast("double").alias("a"), F.col("h2").cast("double").alias("b"), F.col("het").cast("double").alias("w"))
    return d.unionByName(a).select(*ROWS)


def axis_rows(markers: DataFrame, loci: DataFrame) -> DataFrame:
    """The axis as rows beside those of members, so that it needn't go through the driver. kind 2, markers: start, end; kind 3, loci:
    population phase, genetic_cm. markers, loci: as for Axis.of(), in any order."""
    m = markers.select("chrom", "marker", F.lit(2).alias("kind"), F.col("start").cast("double").alias("a"), F.col("end").cast("double").alias("b"))
    x = loci.join(markers.select("marker", "chrom"), "marker") if "chrom" not in loci.columns else loci
    return m.unionByName(x.select("chrom", "marker", F.lit(3).alias("kind"), F.col("population_phase").cast("double").alias("a"), F.col("genetic_cm").cast("double").alias("b")))


def _chromosome(axis: Axis, chrom: str) -> tuple[np.ndarray, Axis]:
    """The places of a chromosome on the axis, and the axis cut to it."""
    places = np.flatnonzero(axis.chrom == chrom)
    own = (axis.locus_marker >= places[0]) & (axis.locus_marker <= places[-1])
    switch = axis.locus_switch[own].copy()
    if len(switch):
        switch[0] = 0.5
    return places, Axis(axis.chrom[places], axis.rho[places], axis.locus_marker[own] - places[0], axis.population[own], switch)


def _member_emission(pdf: pd.DataFrame, cut: Axis, first: int, model: Model, parameters: Parameters, fixed: Parameters) -> np.ndarray:
    depth = np.zeros((1, len(cut.rho), len(STATES)))
    d = pdf[pdf["kind"] == 0].sort_values("marker", kind="stable")
    np.add.at(depth[0], d["marker"].to_numpy(int) - first, depth_logs(model, parameters, d["a"].to_numpy(), d["b"].to_numpy()) * d["w"].to_numpy()[:, None])
    a = pdf[pdf["kind"] == 1].sort_values("marker", kind="stable")
    terms = allele_logs(model, fixed, a["a"].to_numpy(), a["b"].to_numpy(), a["w"].to_numpy())
    return joint_emissions(depth, np.zeros(len(a), int), a["marker"].to_numpy(int) - first, terms, cut, model)


def member_evidence(rows: DataFrame, axis: Axis, model: Model, grid: list[Parameters], fixed: Parameters) -> DataFrame:
    """member, chrom, i, evidence: log evidence under each parameter set of ``grid``, several in one job."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        places, cut = _chromosome(axis, pdf["chrom"].iloc[0])
        steps, initial = chain_steps(cut, model, True)
        scores = [float(hmm.evidence(initial, steps, _member_emission(pdf, cut, int(places[0]), model, p, fixed))[0]) for p in grid]
        return pd.DataFrame({"member": pdf["member"].iloc[0], "chrom": pdf["chrom"].iloc[0], "i": range(len(grid)), "evidence": scores})

    kind = dict(rows.dtypes)["member"]
    return rows.groupBy("member", "chrom").applyInPandas(run, f"member {kind}, chrom string, i int, evidence double")


#: Members whose chains are one loop over places, and bytes of their states at the places that are held at once.
MEMBERS, CHAIN_BYTES = 8, 32 << 20


def infer_members(rows: DataFrame, axis: Axis | DataFrame, model: Model, parameters: Parameters, draws: int = 0, seeds: dict | None = None, fixed: Parameters | None = None) -> DataFrame:
    """member, chrom, marker, p (states), classes, first_phase (null off loci), path (draws of broad classes), evidence.

    Members without a row on a chromosome have no row here for it. seeds: member -> seed; the uniforms of a
    member's chromosome are a stream of their own, so that paths don't depend on how the work is dealt. axis: may be axis_rows(), and
    goes to the members' chromosomes then. Some members' chains of a chromosome are one loop, over a stretch of places after another;
    forward variables are kept at the stretches' starts and made again on the way back.
    """
    fixed, seeds = fixed or parameters, seeds or {}
    kind = dict(rows.dtypes)["member"]
    blocks = max(1, -(-(len(seeds) or rows.select("member").distinct().count()) // MEMBERS))
    dealt = rows.select(F.pmod(F.xxhash64("member"), F.lit(blocks)).cast("int").alias("block"), *ROWS)
    if isinstance(axis, DataFrame):
        places = axis.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(None).cast(kind).alias("member"), "chrom", "marker", "kind", "a", "b", F.lit(None).cast("double").alias("w"))
        dealt = dealt.unionByName(places)
    held = axis if isinstance(axis, Axis) else None
    tasks = max(16 * rows.sparkSession.sparkContext.defaultParallelism, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chrom, table in _runs(batches):
            yield from _infer(chrom, table, held, model, parameters, fixed, draws, seeds)

    schema = f"member {kind}, chrom string, marker int, p array<double>, classes array<double>, first_phase double, path array<int>, evidence double"
    return dealt.repartition(tasks, "chrom", "block").sortWithinPartitions("chrom", "block").mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
    """The rows of each chromosome and block of members, which stand together."""
    own, pieces = None, []
    for batch in batches:
        chrom, block = batch.column("chrom").dictionary_encode(), batch.column("block").to_numpy()
        codes = chrom.indices.to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(block) != 0)) + 1).tolist(), len(block)]
        for low, high in zip(edges, edges[1:], strict=False):
            if low == high:
                continue
            key = chrom[low].as_py(), int(block[low])
            if key != own and pieces:
                yield own[0], pa.Table.from_batches(pieces)
                pieces = []
            own = key
            pieces.append(batch.slice(low, high - low).drop_columns(["chrom", "block"]))
    if pieces:
        yield own[0], pa.Table.from_batches(pieces)


def _axis_of(chrom: str, table: pa.Table, model: Model) -> tuple[np.ndarray, Axis]:
    """_chromosome() out of axis_rows()."""
    kind, marker, a, b = (table.column(c).to_numpy() for c in ("kind", "marker", "a", "b"))
    at, locus = (np.flatnonzero(kind == k)[np.argsort(marker[kind == k], kind="stable")] for k in (2, 3))
    places = marker[at].astype(np.int64)
    markers = pd.DataFrame({"chrom": np.full(len(at), chrom), "start": a[at], "end": b[at]})
    loci = pd.DataFrame({"marker": marker[locus] - (places[0] if len(places) else 0), "population_phase": a[locus], "genetic_cm": b[locus]})
    return places, Axis.of(markers, loci, model)


def _infer(chrom: str, table: pa.Table, axis: Axis | None, model: Model, parameters: Parameters, fixed: Parameters, draws: int, seeds: dict) -> Iterator[pa.RecordBatch]:
    places, cut = _chromosome(axis, chrom) if axis else _axis_of(chrom, table, model)
    table = table.filter(pc.less(table.column("kind"), 2))
    if not table.num_rows:
        return
    coded = table.column("member").combine_chunks().dictionary_encode(null_encoding="encode")
    who, names, first, size = coded.indices.to_numpy(), coded.dictionary, int(places[0]), len(places)
    kind, a, b, w = (table.column(c).to_numpy() for c in ("kind", "a", "b", "w"))
    marker = table.column("marker").to_numpy().astype(np.int64) - first
    sides = []
    for k in (0, 1):  # depth, alleles: by marker
        order = (own := np.flatnonzero(kind == k))[np.argsort(marker[own], kind="stable")]
        sides.append((marker[order], who[order], a[order], b[order], w[order]))
    del table, coded, kind, a, b, w, marker, who
    members, states = len(names), 2 * len(STATES)
    steps, initial = chain_steps(cut, model, True)
    long = max(hmm.PLACES, CHAIN_BYTES // (8 * members * states))

    def emissions(low: int, high: int) -> np.ndarray:
        depth = np.zeros((members * (high - low), len(STATES)))
        ends = [slice(*np.searchsorted(side[0], (low, high))) for side in sides]
        (at, m, n, e, weight), (at_a, m_a, h1, h2, het) = ([x[own] for x in side] for side, own in zip(sides, ends, strict=True))
        np.add.at(depth, m * (high - low) + at - low, depth_logs(model, parameters, n, e) * weight[:, None])
        inside = (cut.locus_marker >= low) & (cut.locus_marker < high)
        part = Axis(cut.chrom[low:high], cut.rho[low:high], cut.locus_marker[inside] - low, cut.population[inside], cut.locus_switch[inside])
        return joint_emissions(depth.reshape(members, high - low, -1), m_a, at_a - low, allele_logs(model, fixed, h1, h2, het), part, model)

    def forward(low: int, high: int, now: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Emissions and forward variables of a stretch. now: those of its first place."""
        e = emissions(low, high)
        hmm._checked(initial, e)
        out = np.empty_like(e)
        out[:, 0] = initial + e[:, 0] if low == 0 else now if now is not None else steps.forward(low - 1, last) + e[:, 0]
        for t in range(1, high - low):
            out[:, t] = steps.forward(low + t - 1, out[:, t - 1]) + e[:, t]
        return e, out

    starts, last = {}, None
    for low in range(0, size, long):
        e, ahead = forward(low, min(low + long, size), None)
        starts[low], last = ahead[:, 0].copy(), ahead[:, -1].copy()
    score = hmm.log_sum(last, -1)
    streams = [np.random.default_rng([seeds.get(name, 0), first]).bit_generator for name in names.to_pylist()] if draws else []
    states0 = [x.state for x in streams]

    def uniforms(low: int, high: int) -> np.ndarray:
        """Places x members x draws of each member's stream, which has all places of a draw after those of another."""
        out = np.empty((members, draws, high - low))
        for m, (bits, state) in enumerate(zip(streams, states0, strict=True)):
            bits.state = state
            bits.advance(low)
            generator = np.random.Generator(bits)
            for d in range(draws):
                out[m, d] = generator.random(high - low)
                bits.advance(size - (high - low))
        return np.ascontiguousarray(out.transpose(2, 0, 1))

    whole = np.zeros(size, bool)
    whole[cut.locus_marker] = True
    back, after = np.zeros((members, states)), None
    for low in sorted(starts, reverse=True):
        high = min(low + long, size)
        if high < size:
            e, ahead = forward(low, high, starts[low])
        p = np.empty_like(ahead)
        for t in range(high - low - 1, -1, -1):
            joint = ahead[:, t] + back
            p[:, t] = np.exp(joint - hmm.log_sum(joint, -1)[:, None])
            if low + t:
                back = steps.backward(low + t - 1, back + e[:, t])
                back = back - back.max(-1, keepdims=True)
        p = (p / p.sum(-1, keepdims=True)).reshape(members, high - low, len(STATES), 2)
        for top in range(high, low, -hmm.PLACES):
            bottom = max(low, top - hmm.PLACES)
            at, n = slice(bottom - low, top - low), top - bottom
            path = np.zeros((n, members, 0), np.int32)
            if draws:
                path = hmm.sampled_back(ahead[:, at], steps, bottom, uniforms(bottom, top), after)
                after, path = path[0], STATES.broad.astype(np.int32)[path // 2]
            one = p[:, at].sum(-1)
            phase = p[:, at].sum(2)[..., 0].ravel()
            columns = names.take(pa.array(np.repeat(np.arange(members), n))), pa.array([chrom]).take(pa.array(np.zeros(members * n, int))), pa.array(np.tile(places[bottom:top], members).astype(np.int32)), _lists(one), _lists(STATES.classes(one))
            columns += pa.array(phase, mask=~np.tile(whole[bottom:top], members)), _lists(path.transpose(1, 0, 2)), pa.array(np.repeat(score, n))
            yield pa.RecordBatch.from_arrays(list(columns), ["member", "chrom", "marker", "p", "classes", "first_phase", "path", "evidence"])


def _lists(x: np.ndarray) -> pa.ListArray:
    """A list for each of the first two axes' cells."""
    offsets = np.arange(x.shape[0] * x.shape[1] + 1, dtype=np.int32) * x.shape[2]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x).reshape(-1)))


def fit_member_dispersion(rows: DataFrame, axis: Axis, model: Model, start: Parameters, options: Options = Options(), points: int = 8) -> DispersionFit:
    """The joint dispersion of all members: a grid of points in one job, then Brent's method between the best one's neighbours."""
    rows = rows.repartition("member", "chrom").persist()

    def total(grid: list[Parameters]) -> dict[int, float]:
        return {r.i: r.s for r in member_evidence(rows, axis, model, grid, start).groupBy("i").agg(F.sum("evidence").alias("s")).collect()}

    low, high = np.log(SIGMA_BOUNDS)
    grid = np.linspace(low, high, points)
    alphas = [start.alpha, *(float(np.expm1(np.exp(2 * x))) for x in grid)]
    scores = total([replace(start, alpha=a) for a in alphas])
    best = int(np.argmax([scores[i + 1] for i in range(points)]))
    trace = [(a, -scores[i]) for i, a in enumerate(alphas)]

    def loss(x: float) -> float:
        alpha = float(np.expm1(np.exp(2 * x)))
        trace.append((alpha, -total([replace(start, alpha=alpha)])[0]))
        return trace[-1][1]

    x, fx, done = bounded_minimum(loss, grid[max(best - 1, 0)], grid[min(best + 1, points - 1)], options.search_tolerance, options.search_iterations)
    candidates = [*trace]
    alpha, value = min(candidates, key=lambda c: c[1])
    rows.unpersist()
    at = np.log(np.sqrt(np.log1p(alpha)))
    return DispersionFit(replace(start, alpha=alpha), start, done, bool(at <= low + 0.011 or at >= high - 0.011), trace[0][1] - value, trace)


def segment_calls(emission: np.ndarray, axis: Axis, model: Model, expected_genes: np.ndarray) -> pd.DataFrame:
    """Runs of one broad class on the most probable path of a joint chain (markers x states-and-phases): chrom, first, last, state,
    log_bf against diploid (class evidence weighted by the states' prior within the class), genes, best constant class."""
    steps, initial = chain_steps(axis, model, True)
    broad = STATES.broad[hmm.viterbi(initial, steps, emission[None])[0] // 2]
    new = np.flatnonzero(np.concatenate(([True], (broad[1:] != broad[:-1]) | (axis.chrom[1:] != axis.chrom[:-1]))))
    rows = []
    for first, stop in zip(new, np.append(new[1:], len(broad)), strict=True):
        states = hmm.constant_segments(emission, axis.switches()[1:], int(first), int(stop))
        score = []
        for k in range(len(CLASSES)):
            own = np.flatnonzero(STATES.broad == k)
            weight = model.initial[own] / model.initial[own].sum()
            score.append(float(hmm.log_sum(states[own] + np.log(weight), 0)))
        k = int(broad[first])
        rows.append((axis.chrom[first], int(first), int(stop - 1), CLASSES[k], score[k] - score[0], int(expected_genes[first:stop].sum()), CLASSES[int(np.argmax(score))]))
    return pd.DataFrame(rows, columns=["chrom", "first", "last", "state", "log_bf", "genes", "best"])


def emission_batches(rows: DataFrame, model: Model, parameters: Parameters) -> DataFrame:
    """rows (n, expected, weight) with e: depth log likelihoods of the states, by Arrow batches; the outlier part included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            logs = depth_logs(model, parameters, pdf["n"].to_numpy(float), pdf["expected"].to_numpy(float))
            yield pdf.assign(e=list(logs * pdf["weight"].to_numpy(float)[:, None]))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", e array<double>"
    return rows.mapInPandas(run, schema)



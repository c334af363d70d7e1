"""Evidence of segments: how likely the observations of a run are under each state held throughout it, all phase paths summed.

With the state held, a place multiplies two phase sums by a 2 x 2 matrix (the phase switch, then the place's likelihoods). Products
over 2, 4, 8, ... places are made level by level, and a run of any length is a product of few of them; so runs may lie anywhere,
overlap, and are all taken side by side. The work is by member and chromosome, on the executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countaxis.operators import axis as axes
from countaxis.operators import hmm
from countaxis.operators.fitting import Axis, _chromosome, _member_emission, chain_steps
from countaxis.operators.states import CLASSES, STATES, Model, Parameters


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Products of matrices (or of row vectors and matrices) of logs, over the last two axes."""
    return hmm.log_sum(left[..., :, :, None] + right[..., None, :, :], -2)


def run_evidence(emission: np.ndarray, switch: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Log evidence (runs x states) of each state over places start ... stop - 1 of each run, given that the run starts in either phase
    alike. emission: places x states x 2 phases; switch: the chance of a phase switch on entry to each place. Runs aren't empty."""
    starts, left = np.asarray(starts, np.int64), np.asarray(stops, np.int64) - np.asarray(starts, np.int64) - 1
    if not len(starts):
        return np.zeros((0, emission.shape[1]))
    if (left < 0).any() or starts.min() < 0 or (starts + left).max() >= len(emission):
        raise ValueError("a run is empty or lies outside the places")
    stay, change = hmm.safe_log(1 - switch), hmm.safe_log(switch)
    steps = np.stack([np.stack([stay, change], -1), np.stack([change, stay], -1)], -2)  # place, from, to
    level = steps[:, None] + emission[:, :, None, :]
    now = emission[starts][:, :, None, :] + np.log(0.5)
    at, size = starts + 1, 1
    while left.any():
        odd = np.flatnonzero(left & size)
        now[odd] = product(now[odd], level[at[odd]])
        at[odd] += size
        left[odd] -= size
        if len(level) > size:
            level = product(level[:-size], level[size:])
        size *= 2
    return hmm.log_sum(now[:, :, 0], -1)


def class_evidence(states: np.ndarray, initial: np.ndarray) -> np.ndarray:
    """Runs x broad classes out of runs x states: a class's states weighted by their prior within it."""
    return np.stack([hmm.log_sum(states[:, own] + np.log(initial[own] / initial[own].sum()), -1) for own in (STATES.broad == k for k in range(len(CLASSES)))], -1)


def state_evidence(rows: DataFrame, keys: list[str], order: str, run: str, emission: str, switch: str) -> DataFrame:
    """keys, run, first, last, places, evidence (an array with each state's) of runs of successive rows within ``keys``.

    rows: keys, order (each once within the keys), run, emission (array of log likelihoods: state after state, two phases each), switch.
    A run that comes back after another is one run a time, numbered by its first place. Emissions may be minus infinity, but neither NaN nor null.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", run {kinds[run]}, first {kinds[order]}, last {kinds[order]}, places int, evidence array<double>"

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        e = np.stack(pdf[emission].to_numpy()).astype(float)
        if np.isnan(e).any():
            raise ValueError("an emission is unknown")
        runs = pdf[run].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1])))
        stop = np.append(first[1:], len(runs))
        found = run_evidence(e.reshape(len(e), -1, 2), pdf[switch].to_numpy(float), first, stop)
        places = pdf[order].to_numpy()
        about = {k: [pdf[k].iloc[0]] * len(first) for k in keys}
        return pd.DataFrame(about | {"run": runs[first], "first": places[first], "last": places[stop - 1], "places": stop - first, "evidence": list(found)})

    return rows.select(*dict.fromkeys([*keys, order, run, emission, switch])).groupBy(*keys).applyInPandas(kernel, schema)


def member_segments(rows: DataFrame, axis: Axis, model: Model, parameters: Parameters, fixed: Parameters | None = None) -> DataFrame:
    """member, chrom, segment, first, last (markers), state, log_bf (against diploid), genes, best (the class that is likeliest throughout) of
    the runs of one class on each member's most probable path. rows: fitting.member_rows(); genes are its rows of depth."""
    fixed = fixed or parameters
    kind = dict(rows.dtypes)["member"]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        chrom = pdf["chrom"].iloc[0]
        places, cut = _chromosome(axis, chrom)
        steps, initial = chain_steps(cut, model, True)
        emission = _member_emission(pdf, cut, int(places[0]), model, parameters, fixed)
        broad = STATES.broad[hmm.viterbi(initial, steps, emission)[0] // 2]
        first = np.flatnonzero(np.concatenate(([True], broad[1:] != broad[:-1])))
        stop = np.append(first[1:], len(broad))
        score = class_evidence(run_evidence(emission[0].reshape(len(broad), -1, 2), cut.switches(), first, stop), model.initial)
        own = broad[first]
        genes = np.bincount(pdf.loc[pdf["kind"] == 0, "marker"].to_numpy(int) - places[0], minlength=len(places))
        return pd.DataFrame(
            {
                "member": pdf["member"].iloc[0], "chrom": chrom, "segment": np.arange(len(first)), "first": places[first], "last": places[stop - 1], "state": [CLASSES[k] for k in own],
                "log_bf": score[np.arange(len(own)), own] - score[:, 0], "genes": np.add.reduceat(genes, first), "best": [CLASSES[k] for k in score.argmax(1)],
            }
        )

    return rows.groupBy("member", "chrom").applyInPandas(kernel, f"member {kind}, chrom string, segment int, first int, last int, state string, log_bf double, genes long, best string")


def placed(segments: DataFrame, grid: DataFrame, least: float) -> DataFrame:
    """member_segments() with start and end in bases, and altered segments of less evidence than ``least`` neutral (raw_state stays)."""
    at = lambda what, place: grid.select(F.col("marker").alias(place), F.col(what))
    rows = segments.join(at("start", "first"), "first").join(at("end", "last"), "last")
    return axes.filtered_segments(rows, least).select("member", "chrom", "segment", "start", "end", "first", "last", "state", "raw_state", "log_bf", "genes", "best")


def state_number(evidence: str) -> Column:
    """The first of the likeliest states of an evidence array."""
    return (F.array_position(evidence, F.array_max(evidence)) - 1).cast("int")

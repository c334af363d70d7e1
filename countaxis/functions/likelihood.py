"""Count likelihoods in NumPy for the kernels that Spark runs by Arrow batches, and as vectorised functions for columns."""



import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from countaxis.functions.columns import LANCZOS


def lgamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    small = x < 0.5
    z = np.where(small, x + 1, x) - 1
    series = LANCZOS[0] + sum(c / (z + i) for i, c in enumerate(LANCZOS) if i)
    t = z + 7.5
    value = 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(series)
    return np.where(small, value - np.log(np.where(small, x, 1.0)), value)


def poisson_logpmf(count: np.ndarray, rate: np.ndarray) -> np.ndarray:
    count, rate = np.broadcast_arrays(np.asarray(count, float), np.asarray(rate, float))
    safe = np.where(rate > 0, rate, 1.0)
    return np.where(rate > 0, count * np.log(safe) - rate - lgamma(count + 1), np.where(count == 0, 0.0, -np.inf))


def nb_logpmf(count: np.ndarray, mean: np.ndarray, alpha: float) -> np.ndarray:
    """Negative binomial with variance mean + alpha * mean**2."""
    if alpha == 0:
        return poisson_logpmf(count, mean)
    count, mean = np.broadcast_arrays(np.asarray(count, float), np.asarray(mean, float))
    r, safe = 1 / alpha, np.where(mean > 0, mean, 1.0)
    grown = np.log1p(alpha * safe)
    value = lgamma(count + r) - lgamma(count + 1) - math.lgamma(r) - r * grown + np.where(count > 0, count * (np.log(alpha * safe) - grown), 0.0)
    return np.where(mean > 0, value, np.where(count == 0, 0.0, -np.inf))


def betabinom_logpmf(k: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    beta = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + beta(k + a, n - k + b) - beta(a, b)


def pln_logpmf(count: np.ndarray, rate: np.ndarray, sigma: float, rows: int = 2048) -> np.ndarray:
    """Poisson with a log-normal rate whose median is ``rate`` and log standard deviation ``sigma``.

    The integrand is rescaled around its mode (found by Newton steps of at most 2) and summed by the trapezoid rule on a fixed
    grid, which converges geometrically for such integrands.
    """
    if sigma == 0:
        return poisson_logpmf(count, rate)
    count, rate = np.broadcast_arrays(np.asarray(count, float), np.asarray(rate, float))
    out = np.where(count == 0, 0.0, -np.inf) * np.ones(count.shape)
    flat, y_all, r_all = out.reshape(-1), count.reshape(-1), rate.reshape(-1)
    todo = np.flatnonzero(r_all > 0)
    half = min(14.0 + 8.0 * sigma, 40.0)
    z = np.linspace(-half, half, 2 * int(half / 0.1) + 1)
    for low in range(0, len(todo), rows):
        at = todo[low : low + rows]
        y, m = y_all[at], np.log(r_all[at])
        u = np.where(y > 0, (m + np.log(np.maximum(y, 1))) / 2, np.minimum(m, 0.0))
        for _ in range(100):
            step = np.clip((y - np.exp(u) - (u - m) / sigma**2) / (np.exp(u) + 1 / sigma**2), -2, 2)
            u = u + step
            if np.max(np.abs(step)) < 1e-13:
                break
        mode = np.exp(u)
        s = 1 / np.sqrt(mode + 1 / sigma**2)
        sz = s[:, None] * z
        with np.errstate(over="ignore"):
            integrand = np.exp(-mode[:, None] * (np.expm1(sz) - sz) - sz**2 / (2 * sigma**2))
        area = integrand.sum(1) * (z[1] - z[0])
        flat[at] = y * u - mode - lgamma(y + 1) - (u - m) ** 2 / (2 * sigma**2) + np.log(s / sigma) - 0.5 * math.log(2 * math.pi) + np.log(area)
    if np.isnan(flat).any():
        raise ValueError("a Poisson-lognormal integral failed")
    return flat.reshape(count.shape)


def with_pln(rows, sigma: float, count: str = "n", rate: str = "expected", out: str = "logp"):
    """rows with the Poisson-lognormal log probability of a count column: an Arrow-batched function over two columns."""

    @F.pandas_udf("double")
    def compute(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for y, r in batches:
            yield pd.Series(pln_logpmf(y.to_numpy(float), r.to_numpy(float), sigma))

    return rows.withColumn(out, compute(F.col(count).cast("double"), F.col(rate).cast("double")))

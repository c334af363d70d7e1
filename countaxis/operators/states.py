"""Copy-number states, priors, transitions and emissions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countaxis.functions.columns import betabinom_logpmf as betabinom_column
from countaxis.functions.likelihood import betabinom_logpmf, nb_logpmf, pln_logpmf

#: Configurations of label, larger and smaller haplotype copies, fold of expression, broad class. Unequal
#: copies make two oriented states.
CONFIGURATIONS = (("diploid", 1, 1, 1.0, 0), ("del", 1, 0, 0.5, 2), ("loh", 2, 0, 1.0, 3), ("gain", 2, 1, 1.5, 1), ("amp", 5, 1, 3.0, 1), ("bdel", 0, 0, 0.05, 2))
CLASSES = ("diploid", "gain", "loss", "cnloh")


@dataclass(frozen=True)
class Catalogue:
    """Oriented states as parallel arrays."""

    labels: tuple[str, ...]
    h1: np.ndarray
    h2: np.ndarray
    fold: np.ndarray
    broad: np.ndarray

    @classmethod
    def standard(cls) -> Catalogue:
        rows = [(n, *pair, fold, broad) for n, x, y, fold, broad in CONFIGURATIONS for pair in dict.fromkeys([(x, y), (y, x)])]
        n, a, b, fold, broad = zip(*rows, strict=True)
        return cls(n, np.array(a), np.array(b), np.array(fold), np.array(broad))

    def __len__(self) -> int:
        return len(self.labels)

    def classes(self, p: np.ndarray) -> np.ndarray:
        """Sums of states' probabilities (last axis) by broad class."""
        return np.stack([p[..., self.broad == k].sum(-1) for k in range(len(CLASSES))], -1)


STATES = Catalogue.standard()


@dataclass(frozen=True)
class Model:
    correlation_length: float = 30e6
    diploid: float = 0.8
    switch_rate: float = 1.0
    locus_weight: float = 0.0
    concentration: float = 20.0
    background: float = 0.1
    family: str = "pln"
    outlier: float = 0.05
    outlier_sigma: float = 3.0

    def __post_init__(self):
        if self.family not in ("nb", "pln"):
            raise ValueError("family must be nb or pln")
        if self.correlation_length <= 0 or not 0 < self.diploid < 1 or min(self.concentration, self.background, self.outlier_sigma) <= 0 or min(self.switch_rate, self.locus_weight) < 0 or not 0 <= self.outlier < 1:
            raise ValueError("invalid model settings")

    @property
    def initial(self) -> np.ndarray:
        """The diploid share, and the rest in equal parts over altered configurations, split over their orientations."""
        labels = list(STATES.labels)
        altered = len(set(labels)) - 1
        return np.array([self.diploid if x == "diploid" else (1 - self.diploid) / altered / labels.count(x) for x in labels])


@dataclass(frozen=True)
class Parameters:
    alpha: float
    bias: float = 0.0

    @property
    def sigma(self) -> float:
        return math.sqrt(math.log1p(self.alpha))


def allele_shares(model: Model, bias: float) -> np.ndarray:
    """First-haplotype shares of the states, shifted by the bias on the logit scale."""
    share = (STATES.h1 + model.background) / (STATES.h1 + STATES.h2 + 2 * model.background)
    share = np.where(STATES.h1 + STATES.h2 == 0, 0.5, share)
    shifted = 1 / (1 + np.exp(-(np.log(share) - np.log1p(-share) + bias)))
    return np.clip(shifted, 1e-6, 1 - 1e-6)


def depth_logs(model: Model, sigma_alpha: Parameters, count: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Rows x states: depth log likelihoods, for each distinct fold once; nothing expected is no evidence."""
    out = np.zeros((len(count), len(STATES)))
    use = expected > 0
    y, e = count[use], expected[use]
    spread = outlier_logs(model, y, e) if model.outlier else None
    for fold in np.unique(STATES.fold):
        inner = nb_logpmf(y, e * fold, sigma_alpha.alpha) if model.family == "nb" else pln_logpmf(y, e * fold, sigma_alpha.sigma)
        if spread is not None:
            inner = np.logaddexp(math.log1p(-model.outlier) + inner, math.log(model.outlier) + spread)
        out[np.ix_(np.flatnonzero(use), np.flatnonzero(STATES.fold == fold))] = inner[:, None]
    return out


def outlier_logs(model: Model, count: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """The outlier component, centred on the expectation; independent of the dispersion that is searched."""
    return pln_logpmf(count, expected, model.outlier_sigma)


def allele_logs(model: Model, parameters: Parameters, h1: np.ndarray, h2: np.ndarray, het: np.ndarray) -> np.ndarray:
    """Rows x states x orientations: allele log likelihoods weighted by heterozygosity."""
    share = allele_shares(model, parameters.bias)
    a, b, n = share * model.concentration, (1 - share) * model.concentration, (h1 + h2)[:, None].astype(float)
    sides = [betabinom_logpmf(h[:, None].astype(float), n, a[None, :], b[None, :]) for h in (h1, h2)]
    return het[:, None, None] * np.stack(sides, -1)


def allele_columns(alleles: DataFrame, model: Model, parameters: Parameters) -> DataFrame:
    """alleles with t1, t2: arrays over states of the same log likelihoods for both orientations, as plain columns."""
    share = allele_shares(model, parameters.bias)
    n = F.col("h1") + F.col("h2")
    side = lambda h: F.array(*(F.col("het") * betabinom_column(F.col(h), n, F.lit(float(s * model.concentration)), F.lit(float((1 - s) * model.concentration))) for s in share))
    return alleles.withColumn("t1", side("h1")).withColumn("t2", side("h2"))


def summed_emissions(rows: DataFrame, keys: list[str], array: str, size: int) -> DataFrame:
    """keys and ``array``: element-wise sums; partial sums are taken before the shuffle."""
    sums = rows.groupBy(*keys).agg(*(F.sum(F.col(array)[k]).alias(f"s{k}") for k in range(size)))
    return sums.select(*keys, F.array(*(f"s{k}" for k in range(size))).alias(array))

"""Scalar functions as Spark columns; all stay inside whole-stage code generation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the Lanczos approximation of the gamma function for g = 7, nine terms.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Ranks of the chromosomes that have no number; all others come after them.
NAMED_RANKS = {"X": 23, "Y": 24, "MT": 25}
OTHER_RANK = 26


def column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bare_chromosome(x) -> Column:
    """Without a leading chr; M and MT are MT."""
    bare = F.regexp_replace(column(x).cast("string"), "^chr", "")
    return F.when(bare.isin("M", "MT"), F.lit("MT")).otherwise(bare)


def chromosome_name(x) -> Column:
    return F.concat(F.lit("chr"), bare_chromosome(x))


def chromosome_rank(x) -> Column:
    """Natural order: numbers, X, Y, MT, others. Ties go by the bare name."""
    bare = bare_chromosome(x)
    named = reduce(lambda c, kv: c.when(bare == kv[0], kv[1]), list(NAMED_RANKS.items())[1:], F.when(bare == "X", NAMED_RANKS["X"]))
    return F.when(bare.rlike("^[0-9]+$"), bare.try_cast("int")).otherwise(named.otherwise(OTHER_RANK))


def canonical_gene(x) -> Column:
    """Gene ids without a version suffix; a PAR_Y suffix stays."""
    return F.regexp_replace(column(x), r"^(ENS[A-Z]*G[0-9]+)\.[0-9]+(_PAR_Y)?$", "$1$2")


def region_bin(position, width) -> Column:
    """Bin of a 1-based position."""
    return F.floor((column(position) - 1) / F.lit(width)).cast("long")


def midpoint(start, end) -> Column:
    return F.floor((column(start) + column(end)) / 2).cast("long")


def log_normalised(count, library, median_library) -> Column:
    return F.log2(1 + column(count) * column(median_library) / column(library))


def clipped(x, limit: float) -> Column:
    return F.greatest(F.least(column(x), F.lit(limit)), F.lit(-limit))


def signed_fraction(a, b) -> Column:
    """2 (a + 1/2) / (a + b + 1) - 1."""
    return 2 * (column(a) + 0.5) / (column(a) + column(b) + 1) - 1


def oriented(phase, h1, h2, het=None) -> tuple[Column, Column]:
    """Counts on the first and second haplotype by phase (the first as it is from .5 on), weighted by ``het``."""
    keep, weight = column(phase) >= 0.5, F.lit(1.0) if het is None else column(het)
    return F.when(keep, column(h1)).otherwise(column(h2)) * weight, F.when(keep, column(h2)).otherwise(column(h1)) * weight


def haplotype_counts(gt, ad, dp) -> tuple[Column, Column]:
    """h1, h2 of a phased genotype: the alternative allele is the first haplotype's for 1|0, the second's for 0|1; else null."""
    ad, dp = column(ad), column(dp)
    h1 = F.when(column(gt) == "1|0", ad).when(column(gt) == "0|1", dp - ad)
    return h1, dp - h1


def info_number(info, key: str) -> Column:
    """A number out of a k=v;k=v field; 0 if it isn't there."""
    return F.coalesce(F.element_at(F.str_to_map(column(info), F.lit(";"), F.lit("=")), key).try_cast("long"), F.lit(0))


def pooled_genotype(ad, dp, oth) -> Column:
    """0/1 for an allele fraction of .1 to .9, 1/1 if all of ten or more, else null; null too without depth or with others."""
    ad, dp, oth = column(ad), column(dp), column(oth)
    fraction = ad / F.nullif(dp, F.lit(0))
    call = F.when(fraction.between(0.1, 0.9), F.lit("0/1")).when((ad == dp) & (dp >= 10), F.lit("1/1"))
    return F.when((dp > 0) & (oth == 0), call)


def log_sum(*terms) -> Column:
    """log of the sum of exponentials of columns."""
    top = F.greatest(*map(column, terms))
    return top + F.log(reduce(lambda a, b: a + b, (F.exp(column(t) - top) for t in terms)))


def expit(x) -> Column:
    return 1 / (1 + F.exp(-column(x)))


def logit(p) -> Column:
    return F.log(column(p)) - F.log1p(-column(p))


def lgamma(x) -> Column:
    """Logarithm of the gamma function of a positive number."""
    x = column(x).cast("double")
    up = F.when(x < 0.5, x + 1).otherwise(x)  # gamma(x) = gamma(x + 1) / x
    z = up - 1
    series = reduce(lambda s, ic: s + ic[1] / (z + ic[0]), list(enumerate(LANCZOS))[1:], F.lit(LANCZOS[0]))
    t = z + 7.5
    value = F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(series)
    return F.when(x < 0.5, value - F.log(x)).otherwise(value)


def lbeta(a, b) -> Column:
    return lgamma(a) + lgamma(b) - lgamma(column(a) + column(b))


def poisson_logpmf(count, rate) -> Column:
    count, rate = column(count), column(rate)
    return F.when(rate > 0, count * F.log(rate) - rate - lgamma(count + 1)).when(count == 0, F.lit(0.0)).otherwise(F.lit(float("-inf")))


def nb_logpmf(count, mean, alpha: float) -> Column:
    """Negative binomial with variance mean + alpha * mean**2; Poisson for alpha 0."""
    if alpha == 0:
        return poisson_logpmf(count, mean)
    count, mean, r = column(count), column(mean), 1 / alpha
    value = lgamma(count + r) - lgamma(count + 1) - F.lit(math.lgamma(r)) - r * F.log1p(alpha * mean) + F.when(count > 0, count * (F.log(alpha * mean) - F.log1p(alpha * mean))).otherwise(0.0)
    return F.when(mean > 0, value).when(count == 0, F.lit(0.0)).otherwise(F.lit(float("-inf")))


def betabinom_logpmf(k, n, a, b) -> Column:
    k, n, a, b = map(column, (k, n, a, b))
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + lbeta(k + a, n - k + b) - lbeta(a, b)


def broad_classes(p) -> Column:
    """Probabilities of diploid, gain, loss and copy-neutral loss from those of the ten oriented states."""
    p = column(p)
    return F.array(p[0], p[5] + p[6] + p[7] + p[8], p[1] + p[2] + p[9], p[3] + p[4])


def first_argmax(p) -> Column:
    """Place of the largest element, from 0; of equal ones the first."""
    return (F.array_position(column(p), F.array_max(column(p))) - 1).cast("int")


def confident(p, threshold: float = 0.95) -> Column:
    return F.array_max(column(p)) >= threshold

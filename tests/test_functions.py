import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from countaxis.functions import columns as C
from countaxis.functions import likelihood as L


def values(spark, column, **given):
    frame = spark.createDataFrame([given])
    return frame.select(column.alias("x")).head().x


def test_gamma_and_beta(spark):
    xs = [1e-3, 0.05, 0.5, 1.0, 1.5, 2.0, 17.25, 1e3, 1e6]
    got = [r.y for r in spark.createDataFrame([(x,) for x in xs], "x double").select(C.lgamma("x").alias("y")).collect()]
    assert np.allclose(got, [math.lgamma(x) for x in xs], rtol=1e-13, atol=1e-13)
    assert np.allclose(L.lgamma(np.array(xs)), [math.lgamma(x) for x in xs], rtol=1e-13, atol=1e-13)


def test_distributions_sum_to_one_and_have_limits():
    k = np.arange(0, 400.0)
    for alpha in (0, 0.1, 1.0):
        assert np.exp(L.nb_logpmf(k, np.full(400, 12.0), alpha)).sum() == pytest.approx(1, abs=1e-9)
    assert np.allclose(L.nb_logpmf(k[:40], np.full(40, 12.0), 1e-9), L.poisson_logpmf(k[:40], np.full(40, 12.0)), atol=1e-5)
    n = np.full(21, 20.0)
    assert np.exp(L.betabinom_logpmf(np.arange(21.0), n, np.full(21, 2.5), np.full(21, 4.0))).sum() == pytest.approx(1, abs=1e-12)
    assert np.exp(L.pln_logpmf(np.arange(0, 3000.0), np.full(3000, 20.0), 0.5)).sum() == pytest.approx(1, abs=1e-9)
    assert np.allclose(L.pln_logpmf(k[:30], np.full(30, 9.0), 0.0), L.poisson_logpmf(k[:30], np.full(30, 9.0)))
    assert L.pln_logpmf(np.array([0.0, 2.0]), np.zeros(2), 0.7).tolist() == [0.0, -math.inf]


@pytest.mark.parametrize("sigma", [0.05, 0.4, 1.5, 3.0])
def test_poisson_lognormal_against_a_fine_sum(sigma):
    u = np.linspace(-14 * sigma, 14 * sigma, 400_001)
    for y, rate in ((0, 3.0), (1, 0.2), (7, 5.0), (300, 250.0)):
        logs = y * (u + math.log(rate)) - rate * np.exp(u) - math.lgamma(y + 1) - u**2 / (2 * sigma**2) - math.log(sigma * math.sqrt(2 * math.pi))
        want = logs.max() + math.log(np.exp(logs - logs.max()).sum() * (u[1] - u[0]))
        assert L.pln_logpmf(np.array([float(y)]), np.array([rate]), sigma)[0] == pytest.approx(want, abs=1e-8)


def test_columns_agree_with_kernels(spark):
    rows = [(float(k), float(m)) for k in (0, 1, 5, 40) for m in (0.0, 0.3, 7.0)]
    frame = spark.createDataFrame(rows, "k double, m double").select("k", "m", C.nb_logpmf("k", "m", 0.3).alias("nb"), C.poisson_logpmf("k", "m").alias("p"), C.betabinom_logpmf("k", F.col("k") + 3, F.lit(2.0), F.lit(5.0)).alias("bb"))
    for r in frame.collect():
        one = lambda f, *a: float(f(*(np.array([x]) for x in a[:2]), *a[2:])[0])
        assert r.nb == pytest.approx(one(L.nb_logpmf, r.k, r.m, 0.3), abs=1e-11) and r.p == pytest.approx(one(L.poisson_logpmf, r.k, r.m), abs=1e-11)
        assert r.bb == pytest.approx(float(L.betabinom_logpmf(np.array([r.k]), np.array([r.k + 3]), np.array([2.0]), np.array([5.0]))[0]), abs=1e-11)


def test_names_ranks_and_ids(spark):
    names = ["chr2", "10", "chrM", "MT", "chrX", "Y", "GL1", "1"]
    rows = spark.createDataFrame([(n,) for n in names], "c string").select(C.chromosome_name("c").alias("n"), C.chromosome_rank("c").alias("r")).collect()
    assert [r.n for r in rows] == ["chr2", "chr10", "chrMT", "chrMT", "chrX", "chrY", "chrGL1", "chr1"] and [r.r for r in rows] == [2, 10, 25, 25, 23, 24, 26, 1]
    ids = spark.createDataFrame([("ENSG01.7",), ("ENSG01.7_PAR_Y",), ("X.1",)], "g string").select(C.canonical_gene("g").alias("g")).collect()
    assert [r.g for r in ids] == ["ENSG01", "ENSG01_PAR_Y", "X.1"]


@pytest.mark.parametrize("ad,dp,oth,gt", [(1, 10, 0, "0/1"), (9, 10, 0, "0/1"), (10, 10, 0, "1/1"), (9, 9, 0, None), (0, 10, 0, None), (5, 10, 1, None), (0, 0, 0, None), (95, 100, 0, None)])
def test_pooled_genotype(spark, ad, dp, oth, gt):
    assert values(spark, C.pooled_genotype("ad", "dp", "oth"), ad=ad, dp=dp, oth=oth) == gt


def test_orientation_fields_and_arrays(spark):
    a, b = C.oriented("q", "h1", "h2", "het")
    assert (values(spark, a, q=0.5, h1=3, h2=9, het=0.5), values(spark, b, q=0.4, h1=3, h2=9, het=0.5)) == (1.5, 1.5)
    h1, h2 = C.haplotype_counts("gt", "ad", "dp")
    assert [values(spark, c, gt=g, ad=2, dp=7) for g in ("1|0", "0|1", "0/1") for c in (h1, h2)] == [2, 5, 5, 2, None, None]
    assert values(spark, C.info_number("i", "DP"), i="AD=3;DP=8") == 8 and values(spark, C.info_number("i", "OTH"), i="AD=3;DP=8") == 0
    assert values(spark, C.first_argmax("p"), p=[0.2, 0.4, 0.4]) == 1 and values(spark, C.confident("p"), p=[0.95, 0.05])
    assert values(spark, C.log_sum("a", "b"), a=1000.0, b=999.0) == pytest.approx(1000 + math.log1p(math.exp(-1)))
    assert values(spark, C.logit(C.expit("x")), x=-1.25) == pytest.approx(-1.25) and values(spark, C.signed_fraction("a", "b"), a=3, b=1) == pytest.approx(0.4)
    assert values(spark, C.region_bin("p", 10), p=10) == 0 and values(spark, C.region_bin("p", 10), p=11) == 1
    assert np.allclose(values(spark, C.broad_classes("p"), p=[float(i) for i in range(10)]), [0, 26, 12, 7])

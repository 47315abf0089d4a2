import math

import pytest

from tillstats.functions import dist

# Fixed values from published tables.
TAILS = [
    (dist.chi2_sf, (3.841458820694124, 1), 0.05),
    (dist.chi2_sf, (18.307038053275146, 10), 0.05),
    (dist.t_sf, (2.2281388519649385, 10), 0.025),
    (dist.t_sf, (-1.8124611228107335, 10), 0.95),
    (dist.f_sf, (4.964602743730711, 1, 10), 0.05),
    (dist.f_sf, (3.325834530413011, 5, 10), 0.05),
    (dist.normal_sf, (1.959963984540054,), 0.025),
]


@pytest.mark.parametrize("tail, at, expected", TAILS)
def test_tails(tail, at, expected):
    assert tail(*at) == pytest.approx(expected, rel=1e-9)


def test_tails_match_the_jvm(spark):
    there = spark._jvm.org.apache.commons.math3.distribution
    for x, d in ((0.5, 3), (12.0, 8), (60.0, 20)):
        assert dist.chi2_sf(x, d) == pytest.approx(1 - there.ChiSquaredDistribution(float(d)).cumulativeProbability(x), abs=1e-12)
    for x, a, b in ((0.3, 2, 59997), (2.5, 4, 30), (9.0, 1, 7)):
        assert dist.f_sf(x, a, b) == pytest.approx(1 - there.FDistribution(float(a), float(b)).cumulativeProbability(x), abs=1e-11)
    for x, d in ((0.2, 4), (-3.0, 17), (5.5, 900)):
        assert dist.t_sf(x, d) == pytest.approx(1 - there.TDistribution(float(d)).cumulativeProbability(x), abs=1e-11)


def test_small_tails_keep_their_digits():
    assert dist.chi2_sf(200, 8) == pytest.approx(math.exp(-100) * sum(100**i / math.factorial(i) for i in range(4)), rel=1e-10)
    assert dist.normal_sf(10) == pytest.approx(7.619853024160593e-24, rel=1e-9)


def test_shapiro_published_example():
    w, p = dist.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=2e-4)


def test_shapiro_edges():
    assert all(math.isnan(v) for v in dist.shapiro_wilk([1, 2]))
    assert dist.shapiro_wilk([4, 4, 4]) == (1.0, 1.0)
    assert dist.shapiro_wilk([1, 2, 3])[0] == pytest.approx(1.0)


def test_exact_rank_distribution():
    # 3 against 2 values: ten arrangements, U = 6 in one of them
    assert dist.mann_whitney_exact_sf(6, 3, 2) == pytest.approx(0.1)
    assert dist.mann_whitney_exact_sf(0, 3, 2) == pytest.approx(1.0)

"""Tail probabilities at sizes where differences of large logarithms lose digits."""

import math

import pytest

from cohortloom.functions.distributions import chi2_tail, incomplete_beta, t_tail


@pytest.mark.parametrize("n", [1e6, 1e8, 1e10, 1e12])
def test_the_t_tail_meets_the_normal_law(n):
    for t in (0.5, 2.0, 6.0):
        rho = t / math.sqrt(n + t * t)
        assert t_tail(rho, n) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=60 * (1 + t**4) / n + 1e-9)


def test_both_forms_of_the_tail_agree_where_they_meet():
    for t in (0.1, 1.0, 3.0, 8.0):
        low, high = (t_tail(t / math.sqrt(n + t * t), n) for n in (999_999.0, 1_000_001.0))
        assert low == pytest.approx(high, rel=1e-7)


def test_known_values():
    assert t_tail(0.6, 3) == pytest.approx(0.28475697986529, rel=1e-9)
    assert incomplete_beta(200.0, 0.5, 1.0) == 1.0 and chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)

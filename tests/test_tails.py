import math

import numpy as np
import pytest

from panelfx.functions.tails import chi2_p, f_p, normal_p, t_p, t_quantile


@pytest.mark.parametrize("t,df,p", [
    (2.0, 5, 0.10193947882), (1.0, 1, 0.5), (2.0638985616, 24, 0.05), (12.706204736, 1, 0.05)])
def test_t(t, df, p):
    assert t_p(t, df) == pytest.approx(p, rel=1e-6)


def test_t_against_numerical_integration():
    df, x = 30, np.linspace(0.5, 60, 2_000_001)
    c = math.gamma((df + 1) / 2) / (math.sqrt(df * math.pi) * math.gamma(df / 2))
    want = 2 * np.trapezoid(c * (1 + x * x / df) ** (-(df + 1) / 2), x)
    assert t_p(0.5, df) == pytest.approx(want, rel=1e-8)


def test_t_is_symmetric_and_tends_to_normal():
    assert t_p(-1.3, 7) == t_p(1.3, 7)
    assert t_p(1.96, 1e9) == pytest.approx(normal_p(1.96), rel=1e-9)


@pytest.mark.parametrize("df", [1.0, 2.5, 8.29, 24.0, 500.0])
@pytest.mark.parametrize("p", [0.6, 0.9, 0.975, 0.999])
def test_quantile_inverts(df, p):
    assert t_p(t_quantile(p, df), df) == pytest.approx(2 * (1 - p), rel=1e-8)
    assert t_quantile(1 - p, df) == pytest.approx(-t_quantile(p, df), rel=1e-9)


@pytest.mark.parametrize("x,k,p", [(3.841458821, 1, 0.05), (9.487729037, 4, 0.05), (2.0, 2, math.exp(-1)), (40.0, 4, 4.3284e-8)])
def test_chi2(x, k, p):
    assert chi2_p(x, k) == pytest.approx(p, rel=1e-4)


def test_f():
    assert f_p(2.776289289, 4, 24) == pytest.approx(0.05, rel=1e-6)
    assert f_p(2.3 ** 2, 1, 11) == pytest.approx(t_p(2.3, 11), rel=1e-10)
    assert f_p(0.0, 3, 9) == 1.0

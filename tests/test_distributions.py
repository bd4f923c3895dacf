"""Column expressions for p values and power against scalar versions by other formulas, and tabulated values."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import distributions
from larkspur.operators import experiment


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t: the regularised incomplete beta function at df / (df + t²)."""
    a, b, x = df / 2, 0.5, df / (df + t * t)
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(b, a, 1 - x) / b


def t_test_power(effect: float, n: float, alpha: float) -> float:
    """Power of the two-sided two-sample t-test with n observations in either arm, by the noncentral t distribution.

    The chance of T beyond the critical values is the normal one given the sample's deviation s, averaged over s.
    """
    df, shift = 2 * n - 2, abs(effect) * math.sqrt(n / 2)
    if df <= 0:
        return math.nan
    low, high = 0.0, 1e3
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if student_p(mid, df) > alpha else (low, mid)
    width = 10 / math.sqrt(2 * df)
    s = np.linspace(max(1 - width, 1e-9), 1 + width, 4001) if df > 60 else np.linspace(1e-9, 1 + 3 * width, 20001)
    log_density = (df - 1) * np.log(s) - df * s * s / 2
    weight = np.exp(log_density - log_density.max())
    normal = np.vectorize(NormalDist().cdf)
    beyond = normal(shift - high * s) + normal(-shift - high * s)
    return float((beyond * weight).sum() / weight.sum())


def test_p_values(spark):
    cases = [(t, d) for t in (0.0, 0.3, 2.228, 12.706, -3.0, 30.0) for d in (1.0, 1.5, 3.0, 10.0, 99.5, 1e5, 1e8)]
    df = spark.createDataFrame(cases, "t double, df double")
    for r in df.withColumns({"p": distributions.student_p(F.col("t"), F.col("df")), "z": distributions.normal_p(F.col("t"))}).collect():
        assert r.p == pytest.approx(student_p(r.t, r.df), rel=1e-6, abs=1e-12)
        assert r.z == pytest.approx(math.erfc(abs(r.t) / math.sqrt(2)), rel=1e-7, abs=1e-300)


@pytest.mark.parametrize(("t", "df", "p"), [(2.228, 10.0, 0.05), (0.0, 5.0, 1.0), (12.706, 1.0, 0.05), (2.576, 1e7, 0.01)])
def test_tabulated_p_values(spark, t, df, p):
    assert spark.range(1).select(distributions.student_p(F.lit(t), F.lit(df))).first()[0] == pytest.approx(p, abs=1e-4)


@pytest.mark.parametrize(("alpha", "df", "t"), [(0.05, 1, 12.7062), (0.05, 10, 2.22814), (0.01, 30, 2.74999), (0.05, 10**6, 1.95997), (0.001, 2, 31.5991)])
def test_tabulated_critical_values(spark, alpha, df, t):
    assert spark.range(1).select(distributions.student_critical(alpha, F.lit(df))).first()[0] == pytest.approx(t, abs=2e-4)


def test_power_by_quadrature(spark):
    cases = [(e, n) for e in (0.0, 0.02, 0.2, 0.5, -0.8, 3.0) for n in (2, 3, 26, 64, 10_000, 1_000_000)]
    df = spark.createDataFrame(cases, "effect double, n long")
    for r in df.withColumn("power", distributions.t_test_power(F.col("effect"), F.col("n"), 0.05)).collect():
        assert r.power == pytest.approx(t_test_power(r.effect, r.n, 0.05), abs=2e-6)


@pytest.mark.parametrize(("effect", "n", "power"), [(0.5, 64, 0.8015), (0.8, 26, 0.8075), (0.0, 50, 0.05), (0.2, 10_000, 1.0), (0.02, 20_000, 0.516)])
def test_power_of_the_t_test(spark, effect, n, power):
    found = spark.range(1).select(distributions.t_test_power(F.lit(effect), F.lit(n), 0.05)).first()[0]
    assert abs(found - power) < 1e-3 and abs(t_test_power(effect, n, 0.05) - power) < 1e-3


def test_undefined_cases_are_null(spark):
    df = spark.createDataFrame([(None, 3.0, None, 5), (2.0, None, 0.5, 1), (None, None, 0.5, None)], "t double, df double, effect double, n long")
    found = df.select(distributions.student_p(F.col("t"), F.col("df")), distributions.t_test_power(F.col("effect"), F.col("n"), 0.05)).collect()
    assert [tuple(r) for r in found] == [(None, None)] * 3


def test_readout_stays_in_the_jvm_and_takes_groups(spark):
    rows = [(g, v, int(i % 10 < k)) for g, k in (("a", 5), ("b", 2)) for v, k in (("control", 2), ("treatment", k)) for i in range(200)]
    out = experiment.ab_readout(spark.createDataFrame(rows, "segment string, variant string, converted int"), by=("segment",))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")
    assert {r.segment: r.decision for r in out.collect()} == {"a": "SHIP", "b": "HOLD"}
    assert experiment.ab_readout(spark.createDataFrame([], "variant string, converted int")).first().decision == "HOLD"

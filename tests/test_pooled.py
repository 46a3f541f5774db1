"""Pooled regressions, tail probabilities and as-of joins to both sides against plain versions."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from crossweave.functions.student import incomplete_beta, two_sided_p
from crossweave.operators import fundamentals as Q
from crossweave.operators import panel as P
from crossweave.operators import pooled as L


def test_tail_of_students_t(spark):
    # fixed values of closed forms: Cauchy for 1, t / sqrt(2 + t * t) for 2 degrees of freedom, and two others
    cases = [(t, 1, 1 - 2 * math.atan(abs(t)) / math.pi) for t in (0.0, 0.3, -1.0, 5.0, 80.0)]
    cases += [(t, 2, 1 - abs(t) / math.sqrt(2 + t * t)) for t in (0.0, 0.5, -2.0, 30.0)]
    cases += [(t, 3, 1 - 2 / math.pi * (math.atan(t / math.sqrt(3)) + t / math.sqrt(3) / (1 + t * t / 3))) for t in (0.7, 2.0, 9.0)]
    got = [r.p for r in spark.createDataFrame([(i, t, v) for i, (t, v, _) in enumerate(cases)], "i int, t double, v long").orderBy("i").select(two_sided_p(F.col("t"), F.col("v")).alias("p")).collect()]
    np.testing.assert_allclose(got, [p for _, _, p in cases], rtol=1e-10, atol=1e-13)
    odd = spark.createDataFrame([(None, 5), (1.0, 0), (1.0, None)], "t double, v long").select(two_sided_p(F.col("t"), F.col("v")).alias("p"))
    assert all(r.p is None for r in odd.collect())


def test_incomplete_beta(spark):
    # I_x(a, 1) = x ** a, I_x(1, b) = 1 - (1 - x) ** b, and the symmetry
    rows = spark.createDataFrame([(x, a) for x in (0.0, 1e-6, 0.2, 0.5, 0.9, 1.0) for a in (0.5, 1.0, 7.5, 400.0)], "x double, a double")
    one = F.lit(1.0)
    out = rows.select("x", "a", incomplete_beta(F.col("a"), one, F.col("x")).alias("p"), incomplete_beta(one, F.col("a"), F.col("x")).alias("q"), (incomplete_beta(F.col("a"), F.lit(2.5), F.col("x")) + incomplete_beta(F.lit(2.5), F.col("a"), 1 - F.col("x"))).alias("s"))
    for r in out.collect():
        np.testing.assert_allclose([r.p, r.q, r.s], [r.x**r.a, 1 - (1 - r.x) ** r.a, 1.0], rtol=1e-9, atol=1e-12)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for i in range(900):
        x = rng.normal(size=3)
        out.append((i % 3, f"t{i}", float(x @ [0.3, -0.1, 0.0] + 0.4 * x[0] * (1 - x[1]) * (i % 3) + rng.normal()), *map(float, x)))
    out += [(0, "n", None, 1.0, 1.0, 1.0), (0, "m", 1.0, None, 1.0, 1.0), (9, "few", 1.0, 2.0, 3.0, 4.0)]
    return spark.createDataFrame(out, "g int, ticker string, y double, a double, b double, c double")


def fitted(rows, xs):
    data = VectorAssembler(inputCols=xs, outputCol="x").transform(rows.dropna(subset=["y", *xs]))
    return LinearRegression(featuresCol="x", labelCol="y", solver="normal", standardization=False).fit(data)


def test_pooled_against_sparks_own_regression(rows):
    xs = ["a", "b", "c"]
    got = {(r.g, r.factor): r for r in L.pooled(rows, "y", xs, ("g",)).collect()}
    assert {g for g, _ in got} == {0, 1, 2}
    for g in range(3):
        m = fitted(rows.where(F.col("g") == g), xs)
        names = [*xs, "intercept"]
        np.testing.assert_allclose([got[g, n].coef for n in names], [*m.coefficients, m.intercept], rtol=1e-8)
        np.testing.assert_allclose([got[g, n].error for n in names], m.summary.coefficientStandardErrors, rtol=1e-8)
        np.testing.assert_allclose([got[g, n].t for n in names], m.summary.tValues, rtol=1e-7)
        np.testing.assert_allclose([got[g, n].p for n in names], m.summary.pValues, rtol=1e-6, atol=1e-12)
        assert abs(got[g, "a"].r2 - m.summary.r2) < 1e-10
    resid = L.pooled_residuals(rows, "y", xs, ("g",)).groupBy("g").agg(F.sum("resid").alias("s"), F.sum(F.col("resid") * F.col("a")).alias("sa"), F.count("*").alias("n")).collect()
    assert {r.g: r.n for r in resid} == {0: 300, 1: 300, 2: 300} and all(abs(r.s) < 1e-8 and abs(r.sa) < 1e-8 for r in resid)


def test_a_dependent_regressor_has_no_error(rows):
    got = {r.factor: r for r in L.pooled(rows.withColumn("d", 2 * F.col("a")), "y", ["a", "d"]).collect()}
    assert got["d"].coef == 0 and got["d"].error is None and got["d"].t is None and got["d"].p is None and got["a"].error > 0


def test_interaction_gain(rows):
    rows = rows.withColumn("ab", F.col("a") * (1 - F.col("b")))
    got = {r.g: r for r in L.interaction_gain(rows, "y", ["a", "b"], "ab", ("g",)).collect()}
    for g in range(3):
        part = rows.where(F.col("g") == g)
        base, full = fitted(part, ["a", "b"]), fitted(part, ["a", "b", "ab"])
        r = got[g]
        np.testing.assert_allclose([r.coef, r.t, r.p, r.gain], [full.coefficients[2], full.summary.tValues[2], full.summary.pValues[2], full.summary.r2 - base.summary.r2], rtol=1e-6, atol=1e-10)
        assert r.significant == (abs(r.t) > 2 and r.gain > 0.005)
    assert got[2].significant and not got[0].significant
    assert L.interaction_gain(rows, "y", ["a", "b"], "ab").first().n == 901  # the three groups and the row of `few`


def test_two_phases(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(d, f"t{t}", "PQR"[t % 3], float(x[0]), float(x[1]), float(x[0] + (t % 3) + 0.1 * rng.normal())) for d in range(5) for t in range(60) for x in [rng.normal(size=2)]], "date int, ticker string, sector string, u double, v double, ret double")
    ranked = L.ranked_factors(rows, ["u", "v"], across=["v"])
    assert ranked.agg(F.max("u"), F.min("v")).first()[0] == 1.0
    ics = L.factor_ics(ranked, "ret", ["u", "v"], least=0.5)
    assert L.selected_factors(ics) == ["u"] and {r.factor: r.n for r in ics.collect()} == {"u": 300, "v": 300}
    coefs, resid = L.second_phase(ranked, "ret", ["u"], ["P", "Q", "R"])
    got = {r.factor: r for r in coefs.collect()}
    assert set(got) == {"intercept", "u", "sector_Q", "sector_R"} and got["u"].p < 1e-10 and abs(got["sector_Q"].coef) < 0.1
    assert abs(resid.agg(F.sum("resid")).first()[0]) < 1e-8


def day(k):
    return dt.date(2020, 1, 1) + dt.timedelta(days=k)


def test_asof_both_against_a_loop(spark):
    rng = np.random.default_rng(6)
    source = [(f"t{t}", day(int(k))) for t in range(4) for k in rng.integers(0, 60, 12)] + [("only", day(5))]
    target = [(f"t{t}", day(int(k)), int(i)) for i, (t, k) in enumerate(zip(rng.integers(0, 5, 80), rng.integers(-3, 65, 80), strict=True))]
    got = P.asof_both(spark.createDataFrame(target, "ticker string, date date, id int"), spark.createDataFrame(source, "ticker string, date date")).collect()
    assert len(got) == len(target)
    for r in got:
        own = [d for t, d in source if t == r.ticker]
        assert r.before == max((d for d in own if d <= r.date), default=None) and r.after == min((d for d in own if d > r.date), default=None)


def test_no_plan_multiplies_dates_by_downloads(spark):
    facts = spark.createDataFrame([("A", p, day(30 * k), "revenue", 1.0 * p + (k if p > 8 else 0)) for p in range(4, 14) for k in range(20)], "ticker string, period int, download date, metric string, value double")
    wanted = spark.createDataFrame([("A", day(k), 9) for k in range(500)], "ticker string, date date, feq int")
    status = spark.createDataFrame([("A", 9, day(700))], "ticker string, feq int, checked date")
    for df in (Q.first_estimated(facts, status, wanted, "revenue"), Q.first_changed(facts, wanted, "revenue", 1.0, 1)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" in plan and df.count() > 0
        for line in plan.splitlines():
            assert not ("Join" in line and "<=" in line), line


def test_first_changed_quarter(spark):
    facts = [("A", 1, 0, 10.0), ("A", 2, 0, 20.0), ("A", 3, 0, 30.0), ("A", 1, 10, 10.01), ("A", 2, 10, 25.0), ("A", 3, 10, 30.0), ("A", 4, 10, 1.0), ("A", 1, 20, 10.0), ("A", 2, 20, 25.0), ("A", 3, 20, 30.0), ("A", 4, 20, 1.0), ("A", 5, 20, 1.0), ("B", 1, 0, None), ("B", 1, 10, 5.0)]
    df = spark.createDataFrame([(t, p, day(k), "m", v) for t, p, k, v in facts], "ticker string, period int, download date, metric string, value double")
    wanted = spark.createDataFrame([("A", day(k)) for k in (-1, 0, 5, 10, 15, 20, 30)] + [("B", day(5))], "ticker string, date date")
    got = {(r.ticker, r.date): r.feq for r in Q.first_changed(df, wanted, "m", 1.0, 1).collect()}
    assert got == {("A", day(0)): 2, ("A", day(5)): 2, ("A", day(10)): 5, ("A", day(15)): 5}

"""Many priors: products of matrices by date in place of one wide aggregate."""

import datetime as dt

import numpy as np

from crossweave.operators import gram as G


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_orthogonalised_by_sums_without_a_wide_aggregate(spark):
    rng = np.random.default_rng(5)
    priors, days = [f"p{k}" for k in range(12)], [dt.date(2020, 1, 6), dt.date(2020, 1, 13)]
    data = [(d, f"t{n}", float(rng.uniform(0, 1)) if d == days[0] else 0.0, *map(float, rng.normal(size=12)), None if n == 5 else float(rng.normal())) for d in days for n in range(40)]
    rows = spark.createDataFrame(data, "date date, ticker string, w0 double, " + ", ".join(f"{p} double" for p in priors) + ", x double")
    out = G.orthogonalised_by(rows, ["x"], priors, 5)
    assert "sum(" not in _plan(out)
    got = {(r["date"], r["ticker"]): r["x"] for r in out.collect()}
    for d in days:
        day = [r for r in data if r[0] == d and r[-1] is not None]
        a = np.array([[1.0, *r[3:-1]] for r in day])
        y, root = np.array([r[-1] for r in day]), np.sqrt([r[2] for r in day]) if d == days[0] else np.ones(len(day))
        b = np.linalg.lstsq(a * root[:, None], y * root, rcond=None)[0]
        np.testing.assert_allclose([got[d, r[1]] for r in day], y - a @ b, atol=1e-9)
    assert got[days[0], "t5"] is None

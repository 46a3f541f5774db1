"""The market from rows with prices alone, and reversion in one pass by ticker."""

import datetime as dt

import numpy as np

from crossweave.operators import panel as P
from crossweave.operators import timeseries as W


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_market_of_sparse_prices(spark):
    rng = np.random.default_rng(3)
    days = [dt.date(2020, 1, 6) + dt.timedelta(7 * k) for k in range(12)]
    rows = [(f"t{n}", d, float(np.exp(rng.normal()))) for n in range(9) for k, d in enumerate(days) if k >= n % 4 and (k * 7 + n) % 3]
    rows += [(None, days[2], 5.0), ("t1", days[0], None)]
    prices = spark.createDataFrame(rows, "ticker string, date date, close double")
    whole = {r["date"]: r["mkt"] for r in P.market_returns(P.clipped(P.simple_returns(P.densify(prices)))).collect()}
    sparse = {r["date"]: r["mkt"] for r in P.market_of_prices(prices).collect()}
    assert {k for k, v in whole.items() if v is not None} == {k for k, v in sparse.items() if v is not None}
    assert all(abs(whole[k] - v) < 1e-12 for k, v in sparse.items() if v is not None)


def test_reversion_in_one_pass(spark):
    rng = np.random.default_rng(4)
    days = [dt.date(2020, 1, 6) + dt.timedelta(7 * k) for k in range(60)]
    rows = [(f"t{n}", d, None if (k + n) % 7 == 0 else float(rng.normal(0, 0.05)) if k != 30 else -1.5) for n in range(3) for k, d in enumerate(days)]
    resid = spark.createDataFrame(rows, "ticker string, date date, resid double").repartition(4, "ticker")
    out = W.reversion_inputs(resid, 30, 15, 4)
    assert "Join" not in _plan(out)
    plain = W.ou_fit(resid, 30, 15, inclusive=True).select("ticker", "date", "half_life")
    last = {}
    for r in sorted(plain.collect(), key=lambda r: (r["ticker"], r["date"])):
        last.setdefault(r["ticker"], []).append((r["date"], r["half_life"]))
    got = out.collect()
    assert any(r["half_life"] is not None for r in got)
    for r in got:
        before = [h for d, h in last[r["ticker"]] if d < r["date"]]
        assert r["half_life"] == (before[-1] if before else None)

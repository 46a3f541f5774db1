"""Forward residuals, the last date's mean reversion, composites by regime and variants of portfolios against plain versions."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crossweave.operators import fundamentals as Q
from crossweave.operators import horizon as H
from crossweave.operators import panel as P
from crossweave.operators import portfolio as B
from crossweave.operators import regimes as Z
from crossweave.operators import signals as I
from crossweave.operators import timeseries as W


def day(k):
    return dt.date(2020, 1, 1) + dt.timedelta(days=int(k))


@pytest.fixture(scope="module")
def prices():
    """(date x ticker) with gaps, late starts and an early end."""
    rng = np.random.default_rng(2)
    px = pd.DataFrame(100 * np.exp(np.cumsum(0.02 * rng.normal(size=(90, 14)), axis=0)), index=[day(k) for k in range(90)], columns=[f"t{k:02d}" for k in range(14)])
    px = px.mask(rng.random(px.shape) < 0.02)
    px.iloc[:45, 3] = np.nan
    px.iloc[70:, 5] = np.nan
    return px


def panel(spark, px):
    rows = [(t, d, None if v != v else float(v)) for d, line in px.iterrows() for t, v in line.items()]
    return P.densify(spark.createDataFrame(rows, "ticker string, date date, close double"))


SECTOR = {f"t{k:02d}": "PQR"[k % 3] for k in range(13)}  # t13 has none


def plain_residuals(px, anchor, horizon, least, sizes=None):
    past, future = [d for d in px.index if d <= anchor], [d for d in px.index if d > anchor]
    if not past or len(future) < horizon:
        return {}
    fwd = (px.loc[future[horizon - 1]] / px.loc[past[-1]] - 1).dropna()
    mkt = fwd.mean()
    names = [t for t in fwd.index if t in SECTOR and (sizes is None or sizes.get(t, 0) > 0)]
    if len(names) < least:
        return {}
    betas = dict.fromkeys(names, 1.0)
    trail = past[-63:]
    if len(trail) >= 20:
        r = px.loc[trail, names].ffill().pct_change(fill_method=None).dropna()
        m = r.mean(axis=1)
        for t in names:
            if len(r) >= 10:
                c = np.cov(r[t], m)
                betas[t] = c[0, 1] / c[1, 1] if c[1, 1] > 0 else 1.0
    y = np.array([fwd[t] - betas[t] * mkt for t in names])
    x = [np.ones(len(names))] + [np.array([SECTOR[t] == s for t in names], float) for s in "PQ"]
    if sizes is not None:
        x.append(np.log([sizes[t] for t in names]))
    x = np.column_stack(x)
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return {t: (betas[t], v) for t, v in zip(names, e, strict=True)}


@pytest.mark.parametrize("sized", [False, True])
def test_price_residuals(spark, prices, sized):
    anchors = [day(k) for k in (-5, 8, 15, 30, 50, 60, 75, 84)]
    size = {t: 1.0 + k for k, t in enumerate(prices.columns)} | {"t01": -1.0}
    sizes = spark.createDataFrame([(t, a, v) for t, v in size.items() for a in anchors], "ticker string, date date, size double") if sized else None
    got = H.price_residuals(panel(spark, prices), spark.createDataFrame([(a,) for a in anchors], "date date"), spark.createDataFrame([*SECTOR.items(), ("t13", None)], "ticker string, sector string"), 6, sizes, least=8)
    got = {(r.date, r.ticker): (r.beta, r.resid) for r in got.collect()}
    want = {(a, t): v for a in anchors for t, v in plain_residuals(prices, a, 6, 8, size if sized else None).items()}
    assert got.keys() == want.keys() and len(want) > 40
    np.testing.assert_allclose([got[k] for k in want], [*want.values()], rtol=1e-8, atol=1e-10)


def test_stored_residuals_and_the_choice_of_source(spark, prices):
    r = prices.pct_change(fill_method=None)
    rows = spark.createDataFrame([(t, d, None if v != v else float(v)) for d, line in r.iterrows() for t, v in line.items()], "ticker string, date date, resid double")
    anchors = [day(k) for k in (-5, 20, 60, 86)]
    frame = spark.createDataFrame([(a,) for a in anchors], "date date")
    got = {(x.date, x.ticker): x.resid for x in H.residual_returns(H.Source.STORED, frame, 5, residuals=rows, least_days=3, least=4).collect()}
    want = {}
    for a in anchors:
        ahead = [d for d in r.index if d > a][:5]
        if len(ahead) == 5:
            part = r.loc[ahead]
            want |= {(a, t): float((1 + part[t].dropna()).prod() - 1) for t in r.columns if part[t].notna().sum() >= 3}
    assert got.keys() == want.keys() and {a for a, _ in want} == {day(-5), day(20), day(60)}
    np.testing.assert_allclose([got[k] for k in want], [*want.values()], rtol=1e-10)
    with pytest.raises(ValueError, match="stored"):
        H.residual_returns(H.Source.STORED, frame, 5)
    with pytest.raises(ValueError, match="prices"):
        H.residual_returns(H.Source.PRICES, frame, 5, residuals=rows)


def test_ou_diagnostic(spark, prices):
    rng = np.random.default_rng(5)
    e = pd.DataFrame(0.01 * rng.normal(size=prices.shape), index=prices.index, columns=prices.columns).mask(rng.random(prices.shape) < 0.05)
    e = e - 0.3 * e.shift(1).fillna(0)
    e.iloc[:-20, 2] = np.nan  # too few
    rows = spark.createDataFrame([(t, d, None if v != v else float(v)) for d, line in e.iterrows() for t, v in line.items()], "ticker string, date date, resid double")
    got = {r.ticker: r for r in W.ou_diagnostic(rows, panel(spark, prices).select("ticker", "date", "close")).collect()}
    assert got.keys() == set(prices.columns)
    dist, rev, weight = {}, {}, {}
    for t in prices.columns:
        r = e[t].dropna().iloc[-60:]
        own = prices[t].dropna()
        rev[t] = float(np.log1p(e[t].fillna(0).iloc[-21:]).sum())
        weight[t] = 0.0
        x = (1 + r).cumprod().to_numpy()
        if len(x) >= 30 and any(own.index >= r.index[0]):
            b, a = np.polyfit(x[:-1], x[1:], 1)
            if 0 < b < 1 and a / (1 - b) > 0:
                k, scale = -math.log(b), own.iloc[-1] / x[-1]
                sd = np.std(x[1:] - a - b * x[:-1]) * scale
                dist[t] = round((own.iloc[-1] - a / (1 - b) * scale) / (sd / math.sqrt(2 * k)), 4)
                weight[t] = min(30 / round(math.log(2) / k, 1), 10.0)
                np.testing.assert_allclose([got[t].ou_dist, got[t].lt_mean, got[t].mr_speed, got[t].resid_vol], [dist[t], a / (1 - b) * scale, k, sd], rtol=1e-6, atol=2e-4)
        assert got[t].ou_valid == (t in dist)
    rank = lambda d: (lambda s: (s.rank(ascending=False) - 1) / (len(s) - 1))(pd.Series(d))
    ou, back = rank(dist).reindex(prices.columns).fillna(0), rank(rev)
    final = pd.Series({t: (weight[t] * ou[t] + back[t]) / (weight[t] + 1) for t in prices.columns})
    np.testing.assert_allclose([got[t].final_score for t in prices.columns], final, rtol=1e-6)
    assert [got[t].final_rank for t in prices.columns] == final.round(9).rank(ascending=False, method="min").astype(int).tolist() and not got["t02"].ou_valid


def test_regimes(spark):
    rng = np.random.default_rng(7)
    metrics, rows, after = ["good", "calm", "noise", "rest"], [], []
    for k in range(16):
        date = dt.date(2019 + k // 8, 1 + k % 8, 1)
        for t in range(45):
            x = rng.normal(size=4)
            up = x[0] if date.year == 2019 else x[1]
            rows.append((f"t{t:02d}", date, "PQR"[t % 3], *map(float, x[:3]), None if t % 5 else float(x[3])))
            after += [(f"t{t:02d}", date, h, float(up + 0.3 * rng.normal())) for h in (4, 8)]
    rows = spark.createDataFrame(rows, "ticker string, date date, sector string, good double, calm double, noise double, rest double")
    after = spark.createDataFrame(after, "ticker string, date date, horizon int, resid double")
    ranks = Z.ranked_metrics(rows, metrics)
    assert {(r.lo, r.hi) for r in ranks.where("metric = 'good'").groupBy("date").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).collect()} == {(0.0, 1.0)}
    weights = {(r.conservative, r.metric): r.weight for r in Z.regime_weights(Z.metric_spreads(ranks, Z.deciles(after, 20)), [2020]).collect()}
    assert max((w, m) for (c, m), w in weights.items() if not c)[1] == "good" and max((w, m) for (c, m), w in weights.items() if c)[1] == "calm"
    assert abs(sum(w for (c, _), w in weights.items() if c) - 1) < 1e-12
    # a rate that falls in the first year and rises in the second picks the right composite in each
    rates = spark.createDataFrame([(day(k) - dt.timedelta(days=365), float(-abs(k - 365))) for k in range(0, 731)], "date date, value double")
    rates = rates.withColumn("value", F.when(F.year("date") == 2019, -F.dayofyear("date")).otherwise(-365 + 3 * F.dayofyear("date")).cast("double"))
    grid = Z.evaluated_grid(rows, metrics, after, rates, (20, 40), (1.0, 1e6), [2020]).collect()
    assert {(r.window, r.threshold, r.horizon) for r in grid} == {(w, t, h) for w in (20, 40) for t in (1.0, 1e6) for h in (4, 8)}
    by = {(r.window, r.threshold, r.horizon): r for r in grid}
    assert all(by[w, 1.0, h].mean_spread_z > by[w, 1e6, h].mean_spread_z > 0 and by[w, 1.0, h].n_dates == 16 for w in (20, 40) for h in (4, 8))
    assert Z.evaluated_grid(rows.limit(0), metrics, after, rates, (20,), (1.0,), [2020]).collect() == []


def test_daily_nav_and_comparison(spark, prices):
    starts = [day(k) for k in (10, 30, 55)]
    held = {starts[0]: ["t00", "t01", "t03"], starts[1]: [], starts[2]: ["t05", "t06"]}
    frame = spark.createDataFrame([(d, t) for d, names in held.items() for t in names], "date date, ticker string")
    close = panel(spark, prices).select("date", "ticker", "close")
    got = {r.date: r.nav for r in B.daily_nav(frame, close, spark.createDataFrame([(d,) for d in starts], "date date")).collect()}
    nav, want = 1.0, {}
    for k, d in enumerate(starts):
        period = [x for x in prices.index if x >= d and (k == 2 or x < starts[k + 1])]
        r = prices.loc[period, held[d]].ffill().pct_change(fill_method=None).fillna(0).mean(axis=1) if held[d] else pd.Series(0.0, index=period)
        for x in period:
            nav *= 1 + r[x]
            want[x] = nav
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[d] for d in want], [*want.values()], rtol=1e-12)
    path = lambda f: spark.createDataFrame([(day(k), float(f(k))) for k in range(400)], "date date, nav double")
    out = {r.portfolio: r for r in B.compared(path(lambda k: 1 + 0.001 * k), path(lambda k: 1 + 0.002 * k)).collect()}
    assert out["alternative"].final == pytest.approx(1.798) and out["baseline"].ahead == 0 and out["alternative"].ahead == pytest.approx(100 * 399 / 400)


def test_sizes_before_the_first_snapshot(spark):
    prices = spark.createDataFrame([("A", day(k), float(10 + k)) for k in range(5)] + [("B", day(0), 1.0)], "ticker string, date date, close double")
    snaps = spark.createDataFrame([("A", day(2), 24.0)], "ticker string, date date, size double")
    caps = lambda **o: [r.cap for r in P.dynamic_cap(prices, snaps, **o).orderBy("ticker", "date").collect()]
    assert caps() == [None, None, 24.0, 26.0, 28.0, None] and caps(backfill=True) == [20.0, 22.0, 24.0, 26.0, 28.0, None]


def test_scaled_momentum_needs_dates_with_scalars(spark):
    rows = [("A", day(k), 0.01, None if k < 30 else 1.0) for k in range(80)]
    out = {r.date: r.mom for r in W.scaled_idio_momentum(spark.createDataFrame(rows, "ticker string, date date, resid double, scalar double"), long=40, skip=5).collect()}
    # a window of 35 dates, 25 of them with a scalar at least
    assert [d for d, m in sorted(out.items()) if m is not None][0] == day(60)


def test_positive_signals_alone(spark):
    rows = spark.createDataFrame([(day(0), f"t{k}", "P", float(k - 3), float(k)) for k in range(12)], "date date, ticker string, sector string, x double, y double")
    assert I.sector_ic(rows, "x", "y", least=5, positive=True).first().n == 8 and I.sector_ic(rows, "x", "y", least=5).first().n == 12


def test_valuation_metrics(spark):
    facts = [("A", p, day(0), m, v) for p in range(92, 104) for m, v in (("s", 10.0 + p - 92), ("e", 2.0 if p % 2 else 0.0), ("g", 5.0), ("n", 3.0 if p < 99 else None))]
    wanted = spark.createDataFrame([("A", day(5), 100)], "ticker string, date date, feq int")
    r = Q.valuation_metrics(spark.createDataFrame(facts, "ticker string, period int, download date, metric string, value double"), wanted, spark.createDataFrame([("A", day(5), 50.0)], "ticker string, date date, close double"), "s", "e", "g", "n").first()
    back = [10.0 + k for k in range(8)]
    rates = [round(100 * (n - o) / ((n + o) / 2), 1) for n, o in zip([14.0, 15.0, 16.0, 17.0, 18.0, 19.0, 20.0, 21.0], [10.0, 11.0, 12.0, 13.0, 14.0, 15.0, 16.0, 17.0], strict=True)]
    vol = max(np.std(rates, ddof=1) / 10, 1.0)
    assert (r.cap, r.ps, r.pe, r.pgp) == (150.0, round(150 / (4 * np.median(back)), 2), round(150 / 8, 2), 7.5)
    assert r.gs_vol == round(vol, 3) and r.gs_adj == pytest.approx(round(r.gs / vol, 2))

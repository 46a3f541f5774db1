"""The whole backtest against a loop over dates, and the reversion score's timing."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from crossweave.operators import backtest, timeseries
from crossweave.plans import steps


def _made(spark, seed):
    rng = random.Random(seed)
    dates = pd.date_range("2020-01-01", periods=60, freq="D")
    prices = {t: np.cumprod([1 + rng.gauss(0, 0.02) for _ in dates]) * 10 for t in "abcdefghij"}
    rebalance = dates[::12]
    rows = []
    for k, day in enumerate(rebalance):
        if k == 2:
            continue  # no factors at all
        for i, t in enumerate("abcdefghijz"):  # z has no prices
            rows.append((day.date(), t, f"s{i % 3}", rng.random(), 5.0 if k == 3 and i > 1 else 100.0 + i, rng.random(), rng.random() if i != 4 else None))
    factors = spark.createDataFrame(rows, "date date, ticker string, sector string, factor double, cap double, rvol double, momentum double")
    px = spark.createDataFrame([(d.date(), t, float(v[i])) for t, v in prices.items() for i, d in enumerate(dates)], "date date, ticker string, close double")
    calendar = spark.createDataFrame([(d.date(),) for d in rebalance], "date date")
    return rows, prices, dates, rebalance, factors, px, calendar


def _plain(rows, prices, dates, rebalance, c):
    nav, out, held = 1.0, {}, {}
    for k, day in enumerate(rebalance):
        end = rebalance[k + 1] if k + 1 < len(rebalance) else dates[-1]
        now = [r for r in rows if r[0] == day.date()]
        if now:
            f = pd.DataFrame([r for r in now if r[1] in prices and r[4] >= (c.cap_floor or 0)], columns=["d", "t", "s", "f", "cap", "v", "m"]).set_index("t")
            if c.vol_quantile and len(f) > c.n:
                f = f[f.v <= f.v.quantile(c.vol_quantile)]
            if c.prefilter < 1 and len(f) > c.n:
                f = f.nlargest(max(c.n, math.ceil(len(f) * c.prefilter)), "f")
            z = lambda x: (x - x.mean()) / x.std()
            held = {}
            if len(f) >= c.n:
                f["score"] = f.f if c.momentum_weight is None else (z(f.f) + c.momentum_weight * z(f.m)) / (1 + c.momentum_weight)
                f = f.dropna(subset="score").sort_values("score", ascending=False)
                if len(f) >= c.n:
                    cap, top = c.sector_cap or c.n, []
                    while len(top) < c.n:
                        top, count = [], {}
                        for t, s in f.s.items():
                            if count.get(s, 0) < cap and len(top) < c.n:
                                count[s] = count.get(s, 0) + 1
                                top.append(t)
                        cap += 1
                    half, x = math.ceil(c.n / 2), c.concentration
                    held = {t: (x / (x + 1) / half if i < half else 1 / (x + 1) / (c.n - half)) if x != 1 else 1 / c.n for i, t in enumerate(top)}
        at = {d: i for i, d in enumerate(dates)}
        first = at[day]
        for d in dates[first : at[end] + 1]:
            out[d.date()] = nav * (1 + sum(w * (prices[t][at[d]] / prices[t][first] - 1) for t, w in held.items()))
        nav = out[end.date()]
    return out


@pytest.mark.parametrize(
    "config",
    [
        backtest.Config(4),
        backtest.Config(4, cap_floor=50.0),
        backtest.Config(4, cap_floor=50.0, vol_quantile=0.8, prefilter=0.7, momentum_weight=0.5, sector_cap=1, concentration=2.0),
        backtest.Config(20),
    ],
)
def test_backtest_is_the_loop_over_dates(spark, config):
    rows, prices, dates, rebalance, factors, px, calendar = _made(spark, 1)
    got = {r.date: r.nav for r in backtest.backtest(factors, calendar, px, config).collect()}
    assert got == pytest.approx(_plain(rows, prices, dates, rebalance, config))
    if config.cap_floor and config.momentum_weight is None:
        flat = [got[d.date()] for d in dates[36:48]]
        assert len(set(flat)) == 1  # the fourth date holds nothing


def test_a_start_before_the_first_date_has_value_one(spark):
    *_, factors, px, calendar = _made(spark, 2)
    got = {str(r.date): r.nav for r in backtest.backtest(factors, calendar, px, backtest.Config(4), "2019-12-31").collect()}
    assert got["2019-12-31"] == 1.0 and len(got) == 61
    same = backtest.backtest(factors, calendar, px, backtest.Config(4), "2020-01-01")
    assert same.count() == 60


def test_reversion_looks_at_earlier_dates_only(spark):
    rng = random.Random(4)
    rows = [(f"t{k}", pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=i), rng.gauss(0, 0.01)) for k in range(6) for i in range(80)]
    day = rows[70][1]
    changed = [(t, d, x if d < day else 0.3) for t, d, x in rows]
    score = lambda data: {(r.ticker, r.date): r.score for r in timeseries.ou_score(spark.createDataFrame(data, "ticker string, date date, resid double")).collect()}
    a, b = score(rows), score(changed)
    assert {k: v for k, v in a.items() if k[1] <= day} == pytest.approx({k: v for k, v in b.items() if k[1] <= day}) and len(a) == 6 * 58


@pytest.mark.parametrize("sectors", [4, 6])
def test_models_take_any_number_of_sectors(sectors):
    for version in (steps.version1, steps.version2):
        assert next(s for s in version(sectors) if s.name == "sectors").columns == tuple(f"sector{k}" for k in range(sectors))

"""Momentum at rebalance dates, volume against prior dates, look-ups by equality, complete dates and snapshots against plain versions."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crossweave.functions import scalar
from crossweave.operators import panel as P
from crossweave.operators import reports as N
from crossweave.operators import studies as S
from crossweave.operators import timeseries as W
from crossweave.sources import tables


def day(k):
    return dt.date(2020, 1, 1) + dt.timedelta(days=int(k))


@pytest.fixture(scope="module")
def made():
    """Residuals on even days, with gaps; scalars of all names but one, none at all in the first third."""
    rng = np.random.default_rng(5)
    index, names = [day(2 * k) for k in range(90)], [f"t{k}" for k in range(9)]
    resid = pd.DataFrame(rng.normal(size=(90, 9)), index, names).mask(rng.random((90, 9)) < 0.1)
    scalar_ = pd.DataFrame(rng.uniform(0.1, 9, size=(90, 9)), index, names)
    scalar_.iloc[:30] = np.nan
    scalar_["t4"] = np.nan
    return resid, scalar_


def long_rows(spark, resid, scalars):
    rows = [(t, d, *(None if math.isnan(x) else float(x) for x in (resid.at[d, t], scalars.at[d, t]))) for d in resid.index for t in resid.columns]
    return spark.createDataFrame(rows, "ticker string, date date, resid double, scalar double")


def plain(resid, scalars, when, names, long, skip, least):
    past = [d for d in resid.index if d < when]
    names = [t for t in names if t in resid.columns]
    if len(past) < long + 1:
        return {}
    window = past[-long:-skip]
    part = resid.loc[window, names]
    if scalars is not None and scalars.loc[window].notna().any(axis=1).sum() >= long - skip - 10:
        part = (part * scalars.loc[window])[[t for t in names if scalars[t].notna().any()]]
    total = part.sum(axis=0)
    return {} if len(total) < least else ((total - total.mean()) / total.std(ddof=1)).to_dict()


@pytest.mark.parametrize("scaled", [False, True])
def test_momentum_at_any_dates(spark, made, scaled):
    resid, scalars = made
    # residuals' own dates, dates between them, one too early, one after the last
    asked = {day(k): [t for i, t in enumerate([*resid.columns, "other"]) if (i + k) % 7] for k in (20, 84, 85, 100, 131, 178, 190)}
    wanted = spark.createDataFrame([(t, d) for d, ts in asked.items() for t in ts], "ticker string, date date")
    got = {(r.date, r.ticker): r.momentum for r in S.momentum_at(long_rows(spark, resid, scalars), wanted, 40, 5, 5, scaled).collect()}
    want = {(d, t): v for d, ts in asked.items() for t, v in plain(resid, scalars if scaled else None, d, ts, 40, 5, 5).items()}
    assert got.keys() == want.keys() and len(want) > 30
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_momentum_at_nothing(spark, made):
    rows = long_rows(spark, *made)
    wanted = spark.createDataFrame([("t1", day(150))], "ticker string, date date")
    assert S.momentum_at(rows.limit(0), wanted, 40, 5).count() == 0
    assert S.momentum_at(rows, wanted.limit(0), 40, 5).count() == 0
    assert S.momentum_at(rows, wanted, 40, 5, least=2).count() == 0  # one name alone


def test_volume_against_prior_dates(spark):
    volume = [5.0, 0.0, None, 7.0, 2.0, 900.0, 3.0, None, 1.0, 4.0]
    rows = spark.createDataFrame([("a", day(k), v) for k, v in enumerate(volume)] + [("b", day(k), None) for k in range(5)], "ticker string, date date, volume double")
    filled = pd.Series(volume, dtype=float).replace(0, np.nan).ffill()
    got = {(r.ticker, r.date): r.scalar for r in W.prior_volume_scalar(rows, rows=3).collect()}
    for k in range(len(volume)):
        want = None if k < 3 else min(3.0, max(0.5, filled[k] / filled[k - 3 : k].mean()))
        assert got["a", day(k)] == (want if want is None else pytest.approx(want))
    assert all(got["b", day(k)] is None for k in range(5))


def test_equality_against_as_of(spark):
    target = spark.createDataFrame([("a", day(k)) for k in (0, 2, 4, 6)], "ticker string, date date")
    source = spark.createDataFrame([("a", day(2), 1.0), ("a", day(3), 2.0), ("b", day(0), 9.0)], "ticker string, date date, size double")
    values = lambda df: [r["size"] for r in df.orderBy("date").collect()]
    assert values(P.equality_filled(target, source, ["size"])) == [None, 1.0, 1.0, 1.0]  # the third day's is lost
    assert values(P.equality_filled(target, source, ["size"], backfill=True)) == [1.0, 1.0, 1.0, 1.0]
    assert values(P.asof_backward(target, source, ["size"])) == [None, 1.0, 2.0, 2.0]


def test_complete_dates(spark):
    rows = spark.createDataFrame([("a", day(0), 1.0), ("b", day(0), 2.0), ("a", day(1), None), ("b", day(1), 2.0), ("a", day(2), None), ("b", day(2), None)], "ticker string, date date, x double")
    assert [r.date for r in P.complete_dates(rows, "x").collect()] == [day(0)]
    assert sorted(r.date for r in P.complete_dates(rows, "x", drop="all").collect()) == [day(0), day(1)]


def test_snapshot_of_normalised_rows(spark):
    rows = [(" aa us", "2020-01-01", "3.5", 2.0, 0.5), ("AA US", "2020-01-01", "4", 2.0, 0.5), ("bb us", "2020-01-01", "n/a", 4.0, 8.0), (None, "2020-01-01", "1", 1.0, 1.0), ("cc us", "2020-01-02", "1", 1.0, 1.0), ("dd", "soon", "1", 1.0, 1.0)]
    rows = tables.normalised(spark.createDataFrame(rows, "ticker string, date string, raw string, growth double, vol double").withColumn("own", F.col("ticker")), ticker="own", date="date")
    assert rows.where("own = 'DD' AND date IS NULL").count() == 1
    got = {r.ticker: (r.raw, r.stable) for r in N.snapshot(rows, "2020-01-01", ["raw"], {"stable": ("growth", "vol", "vol")}).collect()}
    assert got == {"AA": (3.5, 2.0), "BB": (None, 0.5)}


def test_suffixes(spark):
    rows = spark.createDataFrame([("AA",), ("A US B US",), (None,)], "t string")
    assert [r.x for r in rows.select(scalar.with_suffix(F.col("t")).alias("x")).collect()] == ["AA US", "A US B US US", None]
    assert [r.x for r in rows.select(scalar.without_suffix(F.col("t")).alias("x")).collect()] == ["AA", "A B", None]

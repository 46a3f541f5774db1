"""Panel operators: contract cases with known answers, properties, and NumPy versions."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crossweave.functions import scalar as S
from crossweave.operators import fundamentals as Q
from crossweave.operators import gram as G
from crossweave.operators import panel as P
from crossweave.operators import portfolio as B
from crossweave.operators import regress as R
from crossweave.operators import signals as I
from crossweave.operators import timeseries as W
from crossweave.operators import xsection as X
from crossweave.sources import tables
from crossweave.streaming import incremental

DAY = dt.date(2020, 1, 1)


def day(i):
    return DAY + dt.timedelta(days=i)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def column(df, c, *order):
    return [r[c] for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(1)
    rows = [(day(i), f"T{k:02d}", f"S{k % 3}", float(x), float(y), float(z), float(c)) for i in range(40) for k, (x, y, z, c) in enumerate(zip(rng.normal(size=24), rng.normal(size=24), rng.normal(size=24), rng.lognormal(3, 1, 24), strict=True))]
    return spark.createDataFrame(rows, "date date, ticker string, sector string, x double, y double, z double, cap double").cache()


def test_scalars(spark):
    row = spark.range(1).select(
        S.clean_ticker(F.lit(" aapl US ")).alias("t"), S.add_quarters(F.lit("2026Q1"), -2).alias("q"), S.log_return(F.lit(-1.0), F.lit(2.0)).alias("l"), S.safe_ratio(F.lit(1.0), F.lit(0.0)).alias("s"),
        S.clip(F.lit(None).cast("double"), 0.0, 1.0).alias("c"), S.nan_to_null(F.lit(float("nan"))).alias("n"), *(S.ou_weight(F.lit(h)).alias(f"w{int(h or 0)}") for h in (3.0, 30.0, 120.0, 0.0)),
    ).first()
    assert row["t"] == "AAPL" and row["q"] == "2025Q3" and row["l"] is row["s"] is row["c"] is row["n"] is None
    assert (row["w3"], row["w30"], row["w120"], row["w0"]) == (10.0, 1.0, 0.25, 0.0)


def test_returns_over_gaps(spark):
    rows = frame(spark, [(day(i), "A", p) for i, p in enumerate([None, 1.0, None, 2.0])], "date date, ticker string, close double")
    assert column(P.simple_returns(P.densify(rows)), "ret", "date") == [None, None, 0.0, 1.0]


def test_densify_and_fill(spark):
    rows = frame(spark, [(day(0), "A", 1.0), (day(1), "B", 2.0), (day(2), "A", 3.0)], "date date, ticker string, close double")
    dense = P.densify(rows)
    assert dense.count() == 6
    assert column(P.forward_fill(dense, "close"), "close", "ticker", "date") == [1.0, 1.0, 3.0, None, 2.0, 2.0]
    assert column(P.forward_fill(dense, "close", backfill=True), "close", "ticker", "date")[3] == 2.0


def test_spikes(spark):
    rows = frame(spark, [(day(i), "A", p) for i, p in enumerate([100.0, 400.0, 101.0, 102.0])], "date date, ticker string, close double")
    got = P.spike_filter(rows)
    assert column(got, "spike", "date") == [False, True, False, False] and column(got, "cleaned", "date") == [100.0, 100.0, 101.0, 102.0]


def test_rebalance_calendar(spark):
    cal = frame(spark, [(day(i),) for i in (0, 3, 4, 9, 11)], "date date")
    assert column(P.rebalance_calendar(cal, "2020-01-01", 3), "date", "date") == [day(0), day(3), day(9)]


def test_asof_and_versions(spark):
    target = frame(spark, [("A", day(i)) for i in (0, 2, 5)], "ticker string, date date")
    source = frame(spark, [("A", day(1), 1.0), ("A", day(5), 2.0), ("B", day(0), 9.0)], "ticker string, date date, v double")
    assert column(P.asof_backward(target, source, ["v"]), "v", "date") == [None, 1.0, 2.0]
    rows = frame(spark, [("A", 1, day(0), 1.0), ("A", 1, day(3), 2.0)], "ticker string, period int, download date, value double")
    assert P.latest_version(rows, ["ticker", "period"], "value", "download", F.lit(day(2))).first()["value"] == 1.0


def test_ranks_with_ties(spark):
    rows = frame(spark, [(day(0), t, v) for t, v in (("A", 0.8), ("B", 1.2), ("C", 0.3), ("D", 0.8), ("E", None))], "date date, ticker string, x double")
    assert column(X.percent_rank(rows, "x", "r"), "r", "ticker") == [0.625, 1.0, 0.25, 0.625, None]
    assert column(X.rank01(rows, "x", "r"), "r", "ticker") == pytest.approx([0.5, 1.0, 0.0, 0.5, None])
    one = rows.where("ticker = 'A'")
    assert X.rank01(one, "x", "r").first()["r"] == 0.5 and X.rank01(one, "x", "r", single=None).first()["r"] is None
    assert X.zscore(one, "x", "z").first()["z"] == 0.0 and X.zscore(one, "x", "z", flat=None).first()["z"] is None


@pytest.mark.parametrize("n", [5, 7, 23, 100])
def test_buckets_as_equal_quantiles(spark, n):
    rows = frame(spark, [(day(0), f"{k:03d}", float(k)) for k in range(n)], "date date, ticker string, x double")
    want = (pd.qcut(pd.Series(range(n)).rank(method="first"), 5, labels=False) + 1).tolist()
    assert column(X.quantile_bucket(rows, "x", "b"), "b", "ticker") == want


def test_quantiles_interpolate(spark):
    rows = frame(spark, [(day(0), str(k), v) for k, v in enumerate([1.0, 2.0, 5.0, 9.0])], "date date, ticker string, x double")
    assert min(column(X.winsorized(rows, "x", "w"), "w", "ticker")) == pytest.approx(1.03)


def test_sector_dummies(spark):
    rows = frame(spark, [("A", "s1"), ("B", "s3"), ("C", None)], "ticker string, sector string")
    assert column(X.sector_dummies(rows, ["s1", "s2", "s3"]), "x", "ticker") == [[1.0, -0.5, -0.5], [-0.5, -0.5, 1.0], [-0.5, -0.5, -0.5]]


def test_zscore_properties(panel):
    got = X.zscore(panel, "x", "z").groupBy("date").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s")).collect()
    assert all(abs(r.m) < 1e-12 and abs(r.s - 1) < 1e-12 for r in got)


def test_beta_of_past_rows_only(spark, panel):
    rows = panel.select("date", "ticker", F.col("x").alias("ret"), F.col("y").alias("mkt")).join(P.calendar(panel), "date")
    got = {(r.date, r.ticker): r.beta for r in W.ewma_beta(rows, 20, 10).collect()}
    pdf = rows.toPandas().sort_values(["ticker", "date"])
    for t, g in pdf.groupby("ticker"):
        for k in (9, 12, 25, 39):
            past = g.iloc[max(0, k - 20) : k]
            beta = got[g.iloc[k]["date"], t]
            if len(past) < 10:
                assert beta is None
                continue
            w = 2 ** (-(len(past) - 1 - np.arange(len(past))) / 10)
            m, y = past["mkt"].to_numpy(), past["ret"].to_numpy()
            mm, my = np.average(m, weights=w), np.average(y, weights=w)
            assert beta == pytest.approx(np.average((m - mm) * (y - my), weights=w) / np.average((m - mm) ** 2, weights=w))
    changed = rows.withColumn("ret", F.when(F.col("date") >= F.lit(day(30)), 99.0).otherwise(F.col("ret")))
    later = {(r.date, r.ticker): r.beta for r in W.ewma_beta(changed, 20, 10).collect()}
    assert all(later[k] == got[k] for k in got if k[0] <= day(30))


def test_ou_fit(spark):
    rng = np.random.default_rng(3)
    r = rng.normal(0, 0.01, 80)
    rows = frame(spark, [(day(i), "A", float(v)) for i, v in enumerate(r)], "date date, ticker string, resid double")
    got = {x.date: x for x in W.ou_fit(rows).collect()}
    for k in (29, 30, 65, 79):
        level = np.cumprod(1 + r[max(0, k - 60) : k])
        if len(level) < 30:
            assert got[day(k)].half_life is None
            continue
        b, a = np.polyfit(level[:-1], level[1:], 1)
        if 0 < b < 1:
            e = level[1:] - a - b * level[:-1]
            speed = -math.log(b)
            assert got[day(k)].half_life == pytest.approx(math.log(2) / speed, rel=1e-6)
            assert got[day(k)].distance == pytest.approx((level[-1] - a / (1 - b)) / (np.std(e) / math.sqrt(2 * speed)), rel=1e-6)


def test_one_regressor_step(panel):
    resid, lambdas = R.factor_step(R.weights(panel), "y", "x", 5)
    both = resid.join(R.weights(panel), ["date", "ticker"]).groupBy("date").agg(F.sum(F.col("w") * F.col("resid")).alias("a"), F.sum(F.col("w") * F.col("x") * F.col("resid")).alias("b")).collect()
    assert all(abs(r.a) < 1e-9 and abs(r.b) < 1e-9 for r in both)
    assert all(0 <= r.r2 <= 1 for r in lambdas.collect()) and R.factor_step(R.weights(panel), "y", "x", 25)[1].count() == 0


def test_one_and_many_priors_agree(panel):
    rows = panel.withColumn("w0", F.log("cap"))
    one = R.orthogonalised(rows, "y", "x", 5).select("date", "ticker", "perp")
    many = G.orthogonalised_by(rows, ["y"], ["x"], 5).withColumnRenamed("y", "p2")
    assert all(abs(r.perp - r.p2) < 1e-9 for r in one.join(many, ["date", "ticker"]).collect())


def test_rank_ic_needs_ten_names(panel):
    few = panel.where("ticker < 'T05'")
    assert {r.ic for r in I.rank_ic(few, "x", "y").collect()} == {None}


def test_sector_ic(panel):
    got = {r.date: r.ic for r in I.sector_ic(panel, "x", "y", least=5).collect()}
    pdf = panel.toPandas()
    for date, g in list(pdf.groupby("date"))[:5]:
        ics = []
        for _, s in g.groupby("sector"):
            clip = lambda v: v.clip(v.quantile(0.01), v.quantile(0.99)).rank()
            ics.append(np.corrcoef(clip(s["x"]), clip(s["y"]))[0, 1])
        assert got[date] == pytest.approx(np.mean(ics))


def test_compounding_counts_missing_as_zero(spark):
    rows = frame(spark, [(day(i), "A", v) for i, v in enumerate([0.0, 0.1, None, 0.1, None])], "date date, ticker string, ret double")
    assert column(I.compounded_forward(rows, 3), "fwd", "date")[:2] == pytest.approx([0.21, 0.1])
    assert column(I.compounded_forward(rows, 3), "fwd", "date")[2:] == [None, None, None]


def greedy(rows, n, cap):
    for c in range(cap, n + 1):
        taken, count = [], {}
        for t, s in rows:
            if count.get(s, 0) < c and len(taken) < n:
                taken.append(t)
                count[s] = count.get(s, 0) + 1
        if len(taken) == n:
            return taken
    return [t for t, _ in rows][:n]


def test_sector_cap_is_greedy(spark):
    rng = np.random.default_rng(7)
    rows = [(day(d), f"{k:02d}", f"S{rng.integers(0, 3)}", float(rng.integers(0, 9))) for d in range(12) for k in range(12)]
    got = B.sector_capped(frame(spark, rows, "date date, ticker string, sector string, score double"), 6, 1).collect()
    for d in range(12):
        own = sorted((r for r in rows if r[0] == day(d)), key=lambda r: (-r[3], r[1]))
        assert sorted((r.rank, r.ticker) for r in got if r.date == day(d)) == list(enumerate(greedy([(r[1], r[2]) for r in own], 6, 1), 1))


def test_concentration(spark):
    rows = B.concentrated(frame(spark, [(day(0), f"{k:02d}", k) for k in range(1, 21)], "date date, ticker string, rank int"), 2.0)
    w = column(rows, "weight", "rank")
    assert sum(w[:10]) == pytest.approx(2 / 3) and sum(w) == pytest.approx(1)


def test_nav_chains_periods(spark):
    prices = frame(spark, [(day(i), t, p) for t, ps in (("A", [1.0, 2.0, 2.0, 4.0]), ("B", [1.0, 1.0, 2.0, 2.0])) for i, p in enumerate(ps)], "date date, ticker string, close double")
    held = frame(spark, [(day(0), "A", 0.5), (day(0), "B", 0.5), (day(2), "A", 1.0)], "date date, ticker string, weight double")
    path = B.nav(held, prices)
    assert column(path, "nav", "date") == pytest.approx([1.0, 1.5, 2.0, 4.0])
    assert B.performance(path).first()["max_drawdown"] == 0.0


def test_growth_and_first_estimate(spark):
    facts = frame(spark, [("A", q, day(0), "revenue", 100.0 + q) for q in range(1, 13)] + [("A", 10, day(40), "revenue", 150.0)], "ticker string, period int, download date, metric string, value double")
    wanted = frame(spark, [("A", day(20), 10)], "ticker string, date date, feq int")
    assert [r.value for r in Q.four_forward(facts, wanted, "revenue").orderBy("k").collect()] == [110.0, 111.0, 112.0]
    got = Q.blended_growth(facts, wanted, "revenue").first()
    assert got.n_forward == 3 and got.actual == pytest.approx(np.median([4 / ((2 * (100 + q) - 4) / 2) for q in (6, 7, 8, 9)]))
    status = frame(spark, [("A", 10, day(30))], "ticker string, feq int, checked date")
    assert Q.first_estimated(facts, status, wanted, "revenue").first()["feq"] == 10


def test_upsert_and_cache(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda v, *days: frame(spark, [(day(i), "A", v) for i in days], "date date, ticker string, v double")
    tables.upsert_dates(rows(1.0, 0, 1), path)
    tables.upsert_dates(rows(2.0, 1, 2), path)
    assert column(spark.read.parquet(path), "v", "date") == [1.0, 2.0, 2.0]
    asked = []

    def compute(missing):
        asked.extend(column(missing, "date", "date"))
        return missing.select("date", F.lit("A").alias("ticker"), F.lit(3.0).alias("v"))

    dates = frame(spark, [(day(i),) for i in (2, 3)], "date date")
    assert column(tables.cache_or_compute(spark, path, dates, compute), "v", "date") == [2.0, 3.0] and asked == [day(3)]
    assert column(tables.cache_or_compute(spark, path, dates, compute), "v", "date") == [2.0, 3.0] and asked == [day(3)]


def test_wide_to_long(spark):
    wide = frame(spark, [(day(0), 1.0, float("nan"), 7.0)], "date date, `aapl US` double, `msft US` double, `AAPL` double")
    assert {(r.ticker, r.close) for r in tables.wide_to_long(wide, "date", "close").collect()} == {("AAPL", 1.0), ("MSFT", None)}


def test_stream_updates_each_date_once(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("source", "target", "state"))
    schema = "date date, ticker string, v double"
    compute = lambda history, dates: history.withColumn("total", F.sum("v").over(P.by_ticker()))
    for i in range(3):
        frame(spark, [(day(i), "A", 1.0)], schema).write.mode("append").parquet(source)
        incremental.update_dates(spark, source, spark.createDataFrame([], schema).schema, target, state, compute).awaitTermination()
        assert column(spark.read.parquet(target), "total", "date") == [float(k + 1) for k in range(i + 1)]


def test_registered_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_point_in_time_metrics(spark):
    rows = [("A", q, day(0), m, v(q)) for q in range(1, 10) for m, v in (("s", lambda q: 100.0 + q), ("e", lambda q: 10.0), ("n", lambda q: 2.0 if q < 9 else None))]
    facts = frame(spark, rows, "ticker string, period int, download date, metric string, value double")
    wanted = frame(spark, [("A", day(5), 10)], "ticker string, date date, feq int")
    got = Q.point_in_time_metrics(facts, wanted, frame(spark, [("A", day(5), 50.0)], "ticker string, date date, close double"), "s", "e", "n").first()
    assert got.cap == 100.0 and got.ps == round(100 / (4 * 107.5), 2) and got.pe == 2.5 and got.gs_vol == 1.0 and got.gs_adj == got.gs


def test_growth_value_factor(spark):
    rows = frame(spark, [(day(0), f"T{k}", "S", float(k), 1.0 + k, -1.0) for k in range(5)], "date date, ticker string, sector string, gs_adj double, ps double, pe double")
    assert column(Q.growth_value_factor(rows), "factor", "ticker") == pytest.approx([-2.0, -0.5, 0.0, 0.25, 0.4])


def test_repair(spark):
    rows = frame(spark, [("A", day(i), v) for i, v in enumerate([10.0, 10.0, 100.0, 12.0, 12.0, 30.0, 30.0])], "ticker string, date date, value double")
    assert column(W.repaired(rows), "value", "date") == [10.0, 10.0, 11.0, 12.0, 12.0, 30.0, 30.0]

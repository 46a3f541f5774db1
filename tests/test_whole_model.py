"""All ten steps of both versions of the sequential model against a loop over dates, and the reports made of them."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_gram import chosen, solve

from crossweave.operators import reports as N
from crossweave.plans import queries, steps
from crossweave.sources.tables import upsert_dates

FOLDER = "/root/testdata/sf0.001"
LEAST, SECTORS = 12, 3
CHARACTERS = ["beta", "size", "macro_price", "macro_orders", *steps.sector_columns(SECTORS), "quality", "si", "gk", "value"]
COLUMNS = ["date", "ticker", "ret", "w", "w0", *CHARACTERS]
SCHEMA = "date date, ticker string, " + ", ".join(f"{c} double" for c in COLUMNS[2:])


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    own = rng.normal(size=(24, 8))
    out = []
    for k in range(60):
        date = dt.date(2019, 1, 7) + dt.timedelta(weeks=k)
        for t in range(24):
            if rng.random() < 0.03:
                continue
            x = own[t] + 0.3 * rng.normal(size=8) + [0.9, *[0.0] * 7]
            ret = 0.02 * float(x @ [1, 0.3, 0, 0.2, 0.4, 0, 0, 0.1]) + 0.02 * rng.normal() + 0.005 * (t % SECTORS)
            sector = [1.0 if t % SECTORS == s else -0.5 for s in range(SECTORS)]
            row = [date, f"t{t:02d}", ret, float(rng.uniform(1, 9)), float(rng.uniform(0, 9)), *x[:4], *sector, *x[4:]]
            for c in (2, 5, 8, 12, 13, 15):
                if rng.random() < 0.03:
                    row[c] = None
            out.append([None if v is None else v if isinstance(v, (str, dt.date)) else float(v) for v in row])
    return out


def plain_momentum(resid):
    """{(date, ticker): z-score of the residuals 26 to 5 dates back}, missing ones as 0."""
    dates, names = sorted({d for d, _ in resid}), sorted({t for _, t in resid})
    out = {}
    for i, date in enumerate(dates):
        if i + 1 >= 28:
            x = np.array([sum(resid.get((d, t), 0.0) for d in dates[i - 26 : i - 4]) for t in names])
            sd = x.std(ddof=1)
            out |= {(date, t): v for t, v in zip(names, (x - x.mean()) / sd if sd > 0 else 0 * x, strict=True)}
    return out


def loop(spark, rows, version):
    """[(residuals {(date, ticker): x}, figures {date: (intercept, slopes, r2, ridge)})] by step."""
    pdf = pd.DataFrame(rows, columns=COLUMNS)
    resid = {(r.date, r.ticker): r.ret for r in pdf.itertuples() if r.ret == r.ret and r.ret is not None}
    out = []
    for step in version:
        if step.made is not None:
            if step.name == "momentum":
                made = plain_momentum(resid)
            else:
                frame = spark.createDataFrame([(d, t, float(e)) for (d, t), e in resid.items()], "date date, ticker string, resid double")
                made = {(r.date, r.ticker): r.reversion for r in step.made(frame).collect()}
            pdf[step.columns[0]] = [made.get(k, np.nan) for k in zip(pdf["date"], pdf["ticker"], strict=True)]
        if step.priors:
            fresh = {c: pdf[c].astype(float).copy() for c in step.columns}
            for _, part in pdf.groupby("date"):
                for c in step.columns:
                    own = part[part[c].notna()]
                    if len(own) >= LEAST:
                        w = own["w0"].to_numpy(float)
                        fresh[c].loc[own.index] = solve(own[list(step.priors)].astype(float).fillna(0).to_numpy(), own[c].to_numpy(float), w if w.sum() > 0 else np.ones(len(own)))[1]
            for c, x in fresh.items():
                pdf[c] = x
        xs, left, figures = list(step.columns), {}, {}
        for date, part in pdf.groupby("date"):
            part = part.assign(y=[resid.get((date, t), np.nan) for t in part["ticker"]]).dropna(subset=["y", *xs]).sort_values("ticker")
            if len(part) < LEAST:
                continue
            ridge = chosen(part, xs, step.grid, "folds", LEAST, step.default) if step.grid else 0.0
            b, e, r2, sound = solve(part[xs].to_numpy(float), part["y"].to_numpy(float), part["w"].to_numpy(float), ridge)
            if sound or step.grid:
                figures[date] = (b[0], list(b[1:]), r2, ridge)
                left |= {(date, t): v for t, v in zip(part["ticker"], e, strict=True)}
        out.append((left, figures))
        resid = left
    return out


FIGURES = "k int, step string, date date, intercept double, slopes array<double>, r2 double, ridge double"
RESIDUALS = "k int, step string, date date, ticker string, x double"


def by_date_equals(spark, rows, order, figures, residuals, folder):
    """The last two dates, in files that a stream finds one by one or, for the second version, at once, on what is stored of those before."""
    dates = sorted({r[0] for r in rows})
    paths = [str(folder / n) for n in ("figures", "residuals")]
    for path, stored, schema in zip(paths, (figures, residuals), (FIGURES, RESIDUALS), strict=True):
        upsert_dates(spark.createDataFrame([r for r in stored if r.date < dates[-2]], schema), path)
    source = str(folder / "rows")
    frame = spark.createDataFrame(rows, SCHEMA).where(F.col("date") >= F.lit(dates[-4]))
    assert sorted(r.date for r in steps.missing_dates(frame, paths[1]).collect()) == dates[-2:]
    for arrived in ([d] for d in dates[-2:]) if order[1].name == "size" else (dates[-2:],):
        upsert_dates(frame.where(F.col("date").isin(arrived)), source)
        query = steps.stream_model(spark, source, frame.schema, order, LEAST, *paths, str(folder / "checkpoint"))
        query.awaitTermination()
        assert query.exception() is None
    for path, whole, value in zip(paths, (figures, residuals), ("intercept", "x"), strict=True):
        got = {(r.k, r.date, r.asDict().get("ticker")): r[value] for r in spark.read.parquet(path).withColumn("date", F.to_date("date")).where(F.col("date") >= F.lit(dates[-2])).collect()}
        full = {(r.k, r.date, r.asDict().get("ticker")): r[value] for r in whole if r.date >= dates[-2]}
        assert got.keys() == full.keys() and len(full) > 0
        np.testing.assert_allclose([got[k] for k in full], [*full.values()], rtol=1e-8, atol=1e-10)
    assert steps.missing_dates(frame, paths[1]).count() == 0


def test_history_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "residuals")
    days = [dt.date(2015, 1, 1) + dt.timedelta(days=30 * k) for k in range(60)]
    upsert_dates(spark.createDataFrame([(1, "market", d, "A", 1.0) for d in days], RESIDUALS), path)
    held = steps.recent(spark, path, days[-1], days[-1], 100)
    assert sorted(r.date for r in held.collect()) == days[-4:]
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "numFiles" not in plan
    scan = held._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() <= 8


@pytest.mark.parametrize("version", [steps.version1, steps.version2])
def test_every_step_equals_the_loop(spark, rows, version, tmp_path):
    order = version(SECTORS)
    want = loop(spark, rows, order)
    figures, residuals = steps.run_steps(spark.createDataFrame(rows, SCHEMA), order, LEAST)
    figures, residuals = figures.collect(), residuals.collect()
    by_date_equals(spark, rows, order, figures, residuals, tmp_path)
    assert [s.name for s in order] == [r.step for r in sorted({(r.k, r.step): r for r in figures}.values(), key=lambda r: r.k)]
    for k, (step, (left, by_date)) in enumerate(zip(order, want, strict=True), 1):
        got = {(r.date, r.ticker): r.x for r in residuals if r.k == k}
        assert got.keys() == left.keys() and len(left) > 0, step.name
        np.testing.assert_allclose([got[key] for key in left], [*left.values()], rtol=1e-7, atol=1e-9, err_msg=step.name)
        own = {r.date: r for r in figures if r.k == k}
        assert own.keys() == by_date.keys(), step.name
        for date, (intercept, slopes, r2, ridge) in by_date.items():
            r = own[date]
            assert r.ridge == ridge, (step.name, date)
            np.testing.assert_allclose([r.intercept, *r.slopes, r.r2], [intercept, *slopes, r2], rtol=1e-6, atol=1e-8, err_msg=f"{step.name} {date}")
    # the reports of the model
    variance = {r.step: r for r in N.variance_table(spark.createDataFrame([r.asDict() for r in residuals], "k int, step string, date date, ticker string, x double")).collect()}
    assert set(variance) == {"raw", *(s.name for s in order)}
    alpha = N.consolidated_intercept(spark.createDataFrame([r.asDict() for r in figures], "k int, step string, date date, intercept double, slopes array<double>, r2 double, ridge double")).collect()
    sums = {}
    for _, by_date in want:
        for date, f in by_date.items():
            sums[date] = sums.get(date, 0.0) + f[0]
    for r in alpha:
        np.testing.assert_allclose(r.alpha, sums[r.date], rtol=1e-6, atol=1e-8)


def test_factor_chain_has_three_steps(spark):
    got = {r.factor: r["count"] for r in queries.QUERIES["factor_chain"](spark, FOLDER).groupBy("factor").count().collect()}
    assert set(got) == {"beta", "size", "momentum"} and min(got.values()) > 0


def test_registered_model_reports_cover_every_step(spark):
    table = queries.QUERIES["variance_table"](spark, FOLDER).orderBy("k").collect()
    assert [r.step for r in table] == ["raw", *(s.name for s in steps.version1(5))][: len(table)] and len(table) > 1

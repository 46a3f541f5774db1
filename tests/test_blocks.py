"""Steps fitted together: rows are written once and stay dealt by ticker; groups of known values, folds counted over batches, columns that priors explain."""

import datetime as dt
import glob
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crossweave.operators import blocks as K
from crossweave.operators import gram as G
from crossweave.operators import reports as N
from crossweave.plans import steps
from crossweave.sources import tables

DAYS = [dt.date(2020, 1, 6) + dt.timedelta(weeks=k) for k in range(40)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark, gaps=0.1, same=False):
    rng = np.random.default_rng(8)
    data = []
    for d in DAYS:
        for n in range(30):
            a, b, c, e = map(float, rng.normal(size=4))
            row = [d, f"t{n:02d}", 0.02 * a + 0.01 * e, 1.0 + n, float(n % 4), a, 2 * a - 1 if same else b + 0.5 * a, c + b]
            out = [None if k in (2, 5, 6, 7) and rng.random() < gaps else x for k, x in enumerate(row)]
            if same and out[5] is None:
                out[6] = None
            data.append(out)
    return spark.createDataFrame(data, "date date, ticker string, ret double, w double, w0 double, a double, b double, c double")


ORDER = (K.Step("one", ("a",)), K.Step("two", ("b",), ("a",), (0.0, 0.1, 1.0)), K.Step("three", ("c",), ("a", "b")), K.Step("momentum", ("momentum",), ("a", "b", "c"), made=steps.momentum))


def _one_by_one(rows):
    """[(fits {date: (intercept, slopes, ridge)}, residuals)] with the operators of gram.py, a step at a time."""
    rows, out = rows.withColumn("resid", F.col("ret")), []
    for step in ORDER:
        if step.made is not None:
            past = rows.where(F.col("resid").isNotNull()).select("date", "ticker", "resid")
            rows = rows.join(step.made(past), ["date", "ticker"], "left")
        if step.priors:
            rows = G.orthogonalised_by(rows, step.columns, step.priors, 5, keep=True)
        known = rows.select("date", "ticker", "w", "resid", *step.columns)
        resid, fits = G.ridge_path_step(known, "resid", step.columns, 5, step.grid, default=step.default) if step.grid else G.joint_step(known, "resid", step.columns, 10)
        fits = {r["date"]: (r["intercept"], *r["slopes"], r["ridge"] if step.grid else 0.0) for r in fits.collect()}
        rows = tables.checkpointed(rows.drop("resid").join(resid, ["date", "ticker"], "left"))
        out.append((fits, {(r["date"], r["ticker"]): r["resid"] for r in rows.where(F.col("resid").isNotNull()).collect()}))
    return out


def test_a_block_equals_its_steps_one_by_one(spark):
    rows = tables.checkpointed(_rows(spark))
    figures, left, moments = steps.run_with_moments(rows, ORDER, 5)
    want, got = (df.orderBy("k").collect() for df in (N.variance_table(left), N.variance_of_moments(moments)))
    assert [(r.k, r.step, r.n) for r in want] == [(r.k, r.step, r.n) for r in got] and len(want) == 1 + len(ORDER)
    for c in ("variance", "of_raw", "of_previous"):
        np.testing.assert_allclose(np.array([r[c] for r in got], float), np.array([r[c] for r in want], float), rtol=1e-9)
    figures, residuals = figures.collect(), left.collect()
    for k, (fits, left) in enumerate(_one_by_one(rows), 1):
        got = {r["date"]: (r["intercept"], *r["slopes"], r["ridge"]) for r in figures if r["k"] == k}
        assert got.keys() == fits.keys() and len(fits) > 5
        np.testing.assert_allclose([got[d] for d in fits], [*fits.values()], rtol=1e-9, atol=1e-12)
        of = {(r["date"], r["ticker"]): r["x"] for r in residuals if r["k"] == k}
        assert of.keys() == left.keys()
        np.testing.assert_allclose([of[x] for x in left], [*left.values()], rtol=1e-9, atol=1e-12)


def test_rows_are_written_once(spark):
    """Before, the rows were written anew after every third step and after each made one."""
    folder = tables.shared_folder(spark).removeprefix("file://")
    rows = tables.held_by(_rows(spark).repartition("ticker"), "ticker", "date")
    before = {*glob.glob(f"{folder}/*")}
    figures, residuals = steps.run_steps(rows, ORDER, 5, held=True)
    figures.collect(), residuals.collect()
    written = [{c.name for c in spark.read.parquet(f"file://{p}").schema} for p in {*glob.glob(f"{folder}/*")} - before]
    assert written and not any("ticker" in names for names in written)


def test_made_columns_are_not_shuffled(spark):
    rows = tables.held_by(_rows(spark).repartition("ticker"), "ticker", "date").withColumn("resid", F.col("ret"))
    dates = tables.checkpointed(rows.select("date").distinct())
    out = steps.momentum(rows, dates, tables.checkpointed)
    assert "hashpartitioning(ticker" not in _plan(out) and "avg(mom" not in _plan(out)  # means and deviations are read, the calendar's dates alone are shuffled
    assert "hashpartitioning(ticker" in _plan(steps.momentum(tables.checkpointed(rows).where(F.col("resid").isNotNull()).select("date", "ticker", "resid")))
    plain = steps.momentum(rows.where(F.col("resid").isNotNull()).select("date", "ticker", "resid"))
    want = {(r.date, r.ticker): r.momentum for r in plain.collect()}
    got = {(r.date, r.ticker): r.momentum for r in out.collect()}
    assert got.keys() == want.keys()
    for key, x in want.items():
        assert (x is None) == (got[key] is None)
        assert x is None or abs(x - got[key]) < 1e-9


def test_held_by_leaves_no_table_and_keeps_rows(spark):
    rows = _rows(spark)
    held = tables.held_by(rows.repartition("ticker"), "ticker", "date")
    assert sorted(map(tuple, held.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("held_")]
    assert not os.path.exists("spark-warehouse") or not glob.glob("spark-warehouse/held_*")


def test_columns_that_priors_explain_have_no_fit(spark):
    figures, residuals = steps.run_steps(_rows(spark, same=True), (K.Step("one", ("a",)), K.Step("two", ("b",), ("a",))), 5)
    assert {r["k"] for r in figures.select("k").distinct().collect()} == {1}
    assert {r["k"] for r in residuals.select("k").distinct().collect()} == {0, 1}


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_folds_do_not_depend_on_batches(size):
    rng = np.random.default_rng(2)
    n = 23
    day = np.repeat([100, 101], n).astype(np.int32)
    x = rng.normal(size=2 * n)
    x[[3, 30]] = np.nan
    columns = [pa.array(day, pa.int32()).cast(pa.date32()), pa.array([n - 1] * 2 * n, pa.int64()), pa.array(rng.uniform(1, 2, 2 * n)), pa.array(x, from_pandas=True), pa.array(rng.normal(size=2 * n))]
    whole = pa.RecordBatch.from_arrays(columns, ["date", "n", "w", "x", "y"])
    parts = {}
    for batch in K._fold_sums({0: 3})(iter(whole.slice(k, size) for k in range(0, 2 * n, size))):
        for r in batch.to_pylist():
            parts[r["date"], r["fold"]] = r["part"]
    cells = 6
    for k, date in enumerate(sorted({d for d, _ in parts})):
        own = np.flatnonzero(~np.isnan(x[k * n : (k + 1) * n])) + k * n
        for f in range(K.FOLDS):
            rows = own[G.folds(n - 1, K.FOLDS) == f]
            assert parts[date, f][cells] == len(rows)
            np.testing.assert_allclose(parts[date, f][cells + 1], x[rows].sum(), atol=1e-12)

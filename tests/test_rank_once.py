"""A rank takes one sort, ties and missing values included."""

import datetime as dt

from crossweave.operators import xsection as X


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_sorts_once(spark):
    values = [3.0, 1.0, 3.0, None, 2.0, 3.0]
    rows = spark.createDataFrame([(dt.date(2020, 1, 6), str(k), x) for k, x in enumerate(values)], "date date, ticker string, x double")
    up, down = X.rank01(rows, "x", "r"), X.rank01(rows, "x", "r", descending=True)
    assert {r["ticker"]: r["r"] for r in up.collect()} == {"0": 0.75, "1": 0.0, "2": 0.75, "3": None, "4": 0.25, "5": 0.75}
    assert {r["ticker"]: r["r"] for r in down.collect()} == {"0": 0.25, "1": 1.0, "2": 0.25, "3": None, "4": 0.75, "5": 0.25}
    for df in (up, down, X.percent_rank(rows, "x", "r")):
        assert _plan(df.select("*")).count("Sort [") == 1  # planned anew, not yet run

"""Named stores, loads and alignments, and the model updated by a date against a run over all dates."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossweave.operators import studies as T
from crossweave.plans import steps
from crossweave.sources import store as ST

DAY = dt.date(2020, 1, 1)


def day(i):
    return DAY + dt.timedelta(days=i)


def test_update_by_date_equals_a_full_run(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame(
        [(day(i), f"T{k}", float(r), 1.0 + k, 1.0, float(b)) for i in range(45) for k, (r, b) in enumerate(zip(rng.normal(0, 0.02, 12), rng.normal(1, 0.3, 12), strict=True))],
        "date date, ticker string, ret double, w double, w0 double, beta double",
    )
    made = (steps.Step("market", ("beta",)), steps.Step("momentum", ("momentum",), ("beta",), made=steps.momentum))
    whole = [x.where(F.col("date") >= F.lit(day(43))) for x in steps.run_steps(rows, made, 5)]
    paths = [str(tmp_path / n) for n in ("figures", "residuals")]
    steps.update_model(rows.where(F.col("date") < F.lit(day(43))), made, 5, *paths)
    for i in (43, 44, 44):  # a replay changes nothing
        steps.update_model(rows.where(F.col("date") == F.lit(day(i))), made, 5, *paths)
    keys = {0: ["k", "date"], 1: ["k", "date", "ticker"]}
    for n, value in ((0, "intercept"), (1, "x")):
        got = spark.read.parquet(paths[n]).withColumn("date", F.to_date("date")).where(F.col("date") >= F.lit(day(43)))
        a, b = ([tuple(r[c] for c in keys[n]) + (r[value],) for r in t.orderBy(*keys[n]).collect()] for t in (got, whole[n]))
        assert [x[:-1] for x in a] == [x[:-1] for x in b] and len(a) > 0
        assert np.allclose([x[-1] for x in a], [x[-1] for x in b], atol=1e-12)
    assert spark.read.parquet(paths[0]).where("k = 2").count() > 0


def test_store_namespaces_upserts_and_new_columns(spark, tmp_path):
    one = ST.Store(spark, str(tmp_path), "v1")
    two = ST.Store(spark, str(tmp_path), "v2", fallback="v1")
    schema = "ticker string, score double, date date"
    assert one.scan("s", schema).collect() == []
    rows = lambda i, *scores: spark.createDataFrame([(f"T{k}", x, day(i)) for k, x in enumerate(scores)], schema)
    one.replace("s", rows(0, 1.0, None))
    one.upsert("s", rows(1, 2.0, None), drop_null="score")
    one.upsert("s", rows(2, 3.0).withColumn("extra", F.lit(7)))
    assert sorted((r.score, r.extra) for r in one.scan("s", schema).collect()) == [(1.0, None), (2.0, None), (3.0, 7)]
    assert [r.score for r in two.scan("s", schema, start=str(day(2))).collect()] == [3.0]  # of the fallback
    assert sorted(r.score for r in one.scan("s", schema, last_days=1).collect()) == [2.0, 3.0]
    asked = []
    compute = lambda missing: (asked.append([r.date for r in missing.collect()]), missing.select(F.lit("T9").alias("ticker"), F.lit(9.0).alias("score"), "date"))[1]
    dates = spark.createDataFrame([(day(2),), (day(3),)], "date date")
    for _ in range(2):
        assert sorted(r.score for r in ST.scores_or_computed(one, "s", dates, compute, schema).collect()) == [3.0, 9.0]
    assert asked == [[day(3)]]


def test_load_ohlc_needs_all_three(spark):
    rows = spark.createDataFrame([(day(0), "aa us", "1.5"), (day(0), "bb", "x")], "date date, ticker string, value string")
    names = spark.createDataFrame([("AA",)], "ticker string")
    assert [tuple(r) for r in ST.load_ohlc(rows, rows, rows, names).collect()] == [("AA", day(0), 1.5, 1.5, 1.5)]
    assert ST.load_ohlc(rows, rows, rows.where("ticker = 'bb'"), names) is None


def test_picked_series_warns(spark):
    rows = spark.createDataFrame([(day(0), "a", 1.0)], "date date, series string, value double")
    with pytest.warns(UserWarning, match="b"):
        assert ST.picked_series(rows, ["a", "b"]).count() == 1
    with pytest.warns(UserWarning):
        assert ST.picked_series(rows, ["c"]).count() == 0


def test_value_composite_without_its_metrics(spark):
    rows = spark.createDataFrame([(day(0), "A", "S", 2.0), (day(0), "B", "S", -1.0), (day(0), "C", "S", 4.0), (day(0), "D", "S", None)], "date date, ticker string, sector string, pe double")
    assert T.value_composite(rows, {"ps": 1.0}).where("value IS NOT NULL").count() == 0
    # not positive counts as dearer than all; unknown has no score
    got = {r.ticker: r.value for r in T.value_composite(rows, {"pe": 2.0, "ps": 1.0}).collect()}
    assert got == {"A": 1.0, "C": 0.5, "B": 0.0, "D": None}


def test_next_price_and_empty_tables(spark):
    prices = spark.createDataFrame([("A", day(3), 5.0), ("A", day(1), None), ("B", day(0), 1.0)], "ticker string, date date, close double")
    anchors = spark.createDataFrame([(day(1),)], "date date")
    assert [tuple(r) for r in T.next_price(prices, anchors).collect()] == [("A", day(1), day(3), 5.0)]
    assert T.next_price(prices.limit(0), anchors).collect() == []
    assert T.described(prices.limit(0), "close").collect()[0].n == 0

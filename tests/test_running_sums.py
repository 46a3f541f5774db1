"""Windows cost the same whatever their width, gaps need no join, and groups are dealt over more tasks; results are those of plain frames."""

import contextlib
import datetime
import io
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from crossweave.operators import panel as P
from crossweave.operators import signals as I
from crossweave.operators import timeseries as W


def rows(spark, n=60):
    day = lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(i)
    data = [(t, day(i), i + 1, None if (i * 7 + k) % 5 == 0 else math.sin(i * (k + 1)) / 20, math.cos(i) / 30) for k, t in enumerate("ab") for i in range(n)]
    return spark.createDataFrame(data, "ticker string, date date, i long, ret double, mkt double")


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue()


def test_running_sums_equal_sliding_frames(spark):
    w = Window.partitionBy("ticker").orderBy("date")
    got = W.trailing(rows(spark), {"s": F.col("ret")}, 9, 2, counted=["s"]).withColumn("t", F.sum("ret").over(w.rowsBetween(-9, -2)))
    assert got.where("(s IS NULL) <> (t IS NULL) OR abs(s - t) > 1e-12").count() == 0
    level = rows(spark).where("ret IS NOT NULL").withColumn("x", F.exp(F.sum(F.log1p("ret")).over(w))).withColumn("before", F.lag("x").over(w))
    plain = level.select("ticker", "date", F.regr_slope("x", "before").over(w.rowsBetween(-8, 0)).alias("b2"), F.regr_intercept("x", "before").over(w.rowsBetween(-8, 0)).alias("a2"))
    both = W.ou_fit(rows(spark).withColumnRenamed("ret", "resid"), 10, 5, inclusive=True).join(plain, ["ticker", "date"])
    assert both.count() > 90 and both.where("(b IS NULL) <> (b2 IS NULL) OR abs(a - a2) > 1e-9 OR abs(b - b2) > 1e-9").count() == 0


def test_no_frame_slides(spark):
    for made in (W.ewma_beta(rows(spark)), W.idio_momentum(rows(spark), value="ret"), W.realised_vol(rows(spark)), W.ou_fit(rows(spark).withColumnRenamed("ret", "resid"))):
        assert not any(f"RowFrame, {frame}" in plan(made) for frame in ("-252, -1)", "-252, -22", "-124, currentrow", "-59, -1)"))


def test_densify_repeats_rows_over_gaps(spark):
    sparse = rows(spark, 6).where("ticker = 'a' AND i IN (2, 5) OR ticker = 'b' AND i IN (1, 3, 4, 6)").drop("i")
    got = {(r.ticker, r.i): r.mkt for r in P.densify(sparse).collect()}
    kept = {("a", 2), ("a", 4), ("b", 1), ("b", 2), ("b", 3), ("b", 5)} if len({k for _, k in got}) == 5 else {("a", 2), ("a", 5), ("b", 1), ("b", 3), ("b", 4), ("b", 6)}
    assert len(got) == 2 * len({k for _, k in got}) and {k for k, v in got.items() if v is not None} == kept
    assert "SortMergeJoin" not in plan(P.densify(sparse))


def test_coefficients_by_sector_are_dealt_by_their_groups(spark):
    made = I.sector_ic(rows(spark).withColumn("sector", F.lit("s")), "ret", "mkt")
    assert "REPARTITION_BY_NUM" in plan(made)

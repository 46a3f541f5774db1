"""What a forward return leaves after market, sector and size, at many anchor dates at once; from prices or from stored residuals."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossweave.operators.panel import asof_backward
from crossweave.operators.studies import anchored_forward


class Source(Enum):
    """Where residual returns come from."""

    STORED = "stored"
    PRICES = "prices"


def anchor_places(calendar: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor, i): the place in the calendar (date, i) of the last date up to each anchor (date)."""
    at = asof_backward(anchors.select(F.lit(0).alias("__k"), "date").distinct(), calendar.select(F.lit(0).alias("__k"), "date", "i"), ["i"], key="__k")
    return at.where(F.col("i").isNotNull()).select(F.col("date").alias("anchor"), "i")


def trailing_betas(panel: DataFrame, names: DataFrame, places: DataFrame, trail: int = 63, least_dates: int = 20, least: int = 10) -> DataFrame:
    """(anchor, ticker, beta) of names (anchor, ticker) on their mean return over the last `trail` dates up to the anchor.

    Only days on which all of an anchor's names have a return count: prices fill gaps inside the window, so these are the days after the last of the
    names' first prices in it. Fewer dates than `least_dates`, fewer returns than `least`, or a flat market give a beta of 1.
    """
    days = places.select("anchor", F.explode(F.sequence(F.greatest(F.col("i") - trail + 1, F.lit(1)), F.col("i"))).alias("i"))
    short = places.where(F.col("i") < least_dates).select("anchor", F.lit(True).alias("__short"))  # a row an anchor
    # trail rows for each anchor and name
    rows = days.join(panel.select("ticker", "i", "close"), "i").join(names.select("anchor", "ticker"), ["anchor", "ticker"])
    w = Window.partitionBy("anchor", "ticker").orderBy("i")
    rows = rows.withColumn("__p", F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__r", F.try_divide("__p", F.nullif(F.lag("__p").over(w), F.lit(0.0))) - 1)
    by_anchor = Window.partitionBy("anchor")
    first = F.min(F.when(F.col("close").isNotNull(), F.col("i"))).over(Window.partitionBy("anchor", "ticker"))
    full = rows.withColumn("__first", first).withColumn("__from", F.max("__first").over(by_anchor)).where(F.col("i") > F.col("__from"))
    full = full.withColumn("__m", F.avg("__r").over(Window.partitionBy("anchor", "i")))
    slope = F.try_divide(F.covar_samp("__r", "__m"), F.nullif(F.var_samp("__m"), F.lit(0.0)))
    betas = full.groupBy("anchor", "ticker").agg(F.when(F.count("__r") >= least, slope).alias("beta"))
    out = names.select("anchor", "ticker").join(betas, ["anchor", "ticker"], "left").join(short, "anchor", "left")
    return out.select("anchor", "ticker", F.when(F.col("__short"), 1.0).otherwise(F.coalesce("beta", F.lit(1.0))).alias("beta"))


def price_residuals(panel: DataFrame, anchors: DataFrame, sectors: DataFrame, horizon: int, sizes: DataFrame | None = None, trail: int = 63, least: int = 30) -> DataFrame:
    """(ticker, date, beta, resid) at each anchor: the forward return less beta times the market's, less its fit on sectors and, with `sizes`, log size.

    panel: dense (ticker, date, i, close). sectors: (ticker, sector). sizes: (ticker, date, size), the date being the anchor; names without a positive one are out.
    The market is the mean forward return of all names with prices. The fit takes sector means off return and log size, and one slope
    over what is left. Anchors with fewer than `least` names are left out.
    """
    fwd = anchored_forward(panel, anchors, horizon).withColumnRenamed("date", "anchor").withColumn("__mkt", F.avg("fwd").over(Window.partitionBy("anchor")))
    rows = fwd.join(sectors.select("ticker", "sector").where(F.col("sector").isNotNull()), "ticker")
    if sizes is not None:
        rows = rows.join(sizes.where(F.col("size") > 0).select("ticker", F.col("date").alias("anchor"), F.ln("size").alias("__z")), ["ticker", "anchor"])
    rows = rows.withColumn("__n", F.count("*").over(Window.partitionBy("anchor"))).where(F.col("__n") >= least)
    places = anchor_places(panel.select("date", "i").distinct(), anchors)
    rows = rows.join(trailing_betas(panel, rows, places, trail), ["anchor", "ticker"])
    inside = Window.partitionBy("anchor", "sector")
    y = F.col("fwd") - F.col("beta") * F.col("__mkt")
    rows = rows.withColumn("__y", y).withColumn("__y", F.col("__y") - F.avg("__y").over(inside))
    if sizes is not None:
        rows = rows.withColumn("__z", F.col("__z") - F.avg("__z").over(inside))
        by = Window.partitionBy("anchor")
        slope = F.try_divide(F.sum(F.col("__y") * F.col("__z")).over(by), F.nullif(F.sum(F.col("__z") * F.col("__z")).over(by), F.lit(0.0)))
        rows = rows.withColumn("__y", F.col("__y") - F.coalesce(slope, F.lit(0.0)) * F.col("__z"))
    return rows.select("ticker", F.col("anchor").alias("date"), "beta", F.col("__y").alias("resid"))


def stored_residuals(residuals: DataFrame, anchors: DataFrame, horizon: int, least_days: int = 1, least: int = 1) -> DataFrame:
    """(ticker, date, resid): residuals (ticker, date, resid) compounded over their first `horizon` dates after each anchor.

    Missing ones count as 0; names with fewer than `least_days` of them, anchors with fewer such names than `least` or fewer dates than the horizon are left out.
    """
    calendar = residuals.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")).cast("long"))
    last = calendar.agg(F.max("i").alias("__last"))
    # an anchor before the first date stands at place 0
    places = asof_backward(anchors.select(F.lit(0).alias("__k"), "date").distinct(), calendar.select(F.lit(0).alias("__k"), "date", "i"), ["i"], key="__k").select(F.col("date").alias("anchor"), F.coalesce("i", F.lit(0)).alias("__at"))
    days = places.join(F.broadcast(last), F.col("__at") + horizon <= F.col("__last")).select("anchor", F.explode(F.sequence(F.col("__at") + 1, F.col("__at") + horizon)).alias("i")).join(calendar, "i")
    known = residuals.where(F.col("resid").isNotNull()).join(days.select("anchor", "date"), "date")
    out = known.groupBy("anchor", "ticker").agg((F.product(1 + F.col("resid")) - 1).alias("resid"), F.count("*").alias("__d")).where(F.col("__d") >= least_days)
    out = out.withColumn("__n", F.count("*").over(Window.partitionBy("anchor"))).where(F.col("__n") >= least)
    return out.select("ticker", F.col("anchor").alias("date"), "resid")


def residual_returns(source: Source, anchors: DataFrame, horizon: int, *, residuals: DataFrame | None = None, panel: DataFrame | None = None, sectors: DataFrame | None = None, sizes: DataFrame | None = None, **options: int) -> DataFrame:
    """(ticker, date, resid) from the source named: stored residuals, or panel and sectors (and sizes)."""
    if source is Source.STORED:
        if residuals is None:
            raise ValueError("stored residuals are missing")
        return stored_residuals(residuals, anchors, horizon, **options)
    if panel is None or sectors is None:
        raise ValueError("prices and sectors are missing")
    return price_residuals(panel, anchors, sectors, horizon, sizes, **options).drop("beta")

"""Long panels out of the star-schema tables: suppliers stand for tickers, ship weeks for dates, regions for sectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.functions.scalar import clip
from crossweave.operators import panel as P
from crossweave.operators.timeseries import trailing
from crossweave.sources.tables import checkpointed, table


def weekly(spark: SparkSession, folder: str, deal: Callable[[DataFrame], DataFrame] = lambda rows: rows.repartition("ticker")) -> DataFrame:
    """(ticker, date, disc, volume, amount, tax, returned, raw_px) a supplier and week; dealt by ticker, or as `deal` does, for sums and windows alike."""
    rows = table(spark, folder, "lineitem").select(F.col("l_suppkey").cast("string").alias("ticker"), F.date_trunc("week", "l_shipdate").cast("date").alias("date"), "l_discount", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag")
    return deal(rows).groupBy("ticker", "date").agg(
        F.avg("l_discount").alias("disc"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"), F.avg("l_tax").alias("tax"),
        F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("returned"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("raw_px"),
    )


def sectors(spark: SparkSession, folder: str) -> DataFrame:
    s, n, r = (table(spark, folder, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("r_name").alias("sector"))


def prices(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    """weekly(), or `rows` of it that carry more, with close, a price-like path of the average discounts."""
    w = P.by_ticker().rowsBetween(P.Window.unboundedPreceding, 0)
    return (weekly(spark, folder) if rows is None else rows).withColumn("close", 100 * F.exp(F.sum(F.col("disc") - 0.05).over(w)))


def dense(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    dates = table(spark, folder, "lineitem").select(F.date_trunc("week", "l_shipdate").cast("date").alias("date"))
    return P.densify(prices(spark, folder, rows).withColumn("own", F.lit(True)), dates=dates)


def returns(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    """dense() with ret (clipped), mkt, and cap, the running amount of a year."""
    rows = P.clipped(P.simple_returns(dense(spark, folder, rows)))
    both = rows.where(F.col("date").isNotNull()).join(F.broadcast(P.market_of_prices(prices(spark, folder))), "date", "left")  # a row a date
    return trailing(both, {"cap": F.col("amount")}, 51, 0, counted=["cap"]).withColumn("cap", F.col("cap") / 1000)


def sectored(spark: SparkSession, folder: str) -> DataFrame:
    return returns(spark, folder).join(sectors(spark, folder), "ticker")


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """(ticker, period, download, metric, value): sums by quarter of shipping and month of ordering, as versions of fundamentals."""
    li, o = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_suppkey").cast("string").alias("ticker"), (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).alias("period"), F.date_trunc("month", "o_orderdate").cast("date").alias("download"),
        F.col("l_extendedprice").alias("revenue"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("profit"),
    )
    sums = rows.groupBy("ticker", "period", "download").agg(F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"))
    return sums.unpivot(["ticker", "period", "download"], ["revenue", "profit"], "metric", "value")


def statements(spark: SparkSession, folder: str) -> DataFrame:
    """facts() with two metrics more: gross (after tax) and shares (quantities)."""
    li, o = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_suppkey").cast("string").alias("ticker"), (F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1).alias("period"), F.date_trunc("month", "o_orderdate").cast("date").alias("download"),
        F.col("l_extendedprice").alias("revenue"), price.alias("profit"), (price * (1 + F.col("l_tax"))).alias("gross"), F.col("l_quantity").cast("double").alias("shares"),
    )
    metrics = ["revenue", "profit", "gross", "shares"]
    sums = rows.groupBy("ticker", "period", "download").agg(*(F.sum(m).alias(m) for m in metrics))
    # queries read it once for each metric and more
    return checkpointed(sums).unpivot(["ticker", "period", "download"], metrics, "metric", "value")


def short_interest(spark: SparkSession, folder: str) -> DataFrame:
    return weekly(spark, folder).select("ticker", "date", *interest())


def interest() -> list[Column]:
    return [F.when(F.col("returned") > 0, F.col("tax")).alias("si_pct"), (F.col("volume") * F.col("returned")).alias("si_shares"), F.col("volume").alias("si_available")]


def ohlc(spark: SparkSession, folder: str) -> DataFrame:
    """Open, high, low and close around the weekly close, dense."""
    return ranges(dense(spark, folder)).select("ticker", "date", "i", "open", "high", "low", "close")


def ranges(rows: DataFrame) -> DataFrame:
    """Dense rows with open, high and low, and close where all are known."""
    before = F.lag("close").over(P.by_ticker())
    hi, lo = F.greatest("close", before), F.least("close", before)
    both = F.col("close").isNotNull() & before.isNotNull()
    return rows.withColumns({"open": F.when(both, before), "high": F.when(both, hi * (1 + clip(F.col("tax"), 0.0, 0.1))), "low": F.when(both, lo * (1 - clip(F.col("tax"), 0.0, 0.1))), "close": F.when(both, F.col("close"))})

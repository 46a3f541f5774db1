"""A whole backtest as one lazy plan: filters, momentum blend, sector cap, weights and value, all rebalance dates at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossweave.operators.portfolio import concentrated, nav, ranked, sector_capped
from crossweave.operators.xsection import zscore


@dataclass(frozen=True)
class Config:
    """n: names held. cap_floor: least capitalisation. vol_quantile: of realised volatility, above which names go. prefilter: share of names by
    factor that stay. momentum_weight: against the factor's 1. sector_cap: names a sector, relaxed until n are found. concentration: of the
    better half's weight over the other's."""

    n: int = 20
    cap_floor: float | None = None
    vol_quantile: float | None = None
    prefilter: float = 1.0
    momentum_weight: float | None = None
    sector_cap: int | None = None
    concentration: float = 1.0


def selected(factors: DataFrame, config: Config) -> DataFrame:
    """(date, ticker, rank, weight) of factors (date, ticker, sector, factor, and cap, rvol, momentum as the configuration needs them).

    A date with fewer than n names after the filters, or after names without momentum are gone, has no rows.
    """
    of_date = Window.partitionBy("date")
    n, rows = config.n, factors.where(F.col("factor").isNotNull())
    if config.cap_floor is not None:
        rows = rows.where(F.coalesce("cap", F.lit(0.0)) >= config.cap_floor)
    if config.vol_quantile is not None:
        rows = rows.withColumns({"__n": F.count("*").over(of_date), "__q": F.percentile("rvol", F.lit(config.vol_quantile)).over(of_date)})
        rows = rows.where((F.col("__n") <= n) | F.col("__q").isNull() | (F.col("rvol") <= F.col("__q")))
    if config.prefilter < 1:
        rows = ranked(rows, "factor", "__r").withColumn("__n", F.count("*").over(of_date))
        rows = rows.where((F.col("__n") <= n) | (F.col("__r") <= F.greatest(F.lit(n), F.ceil(F.col("__n") * config.prefilter))))
    rows = rows.withColumn("__n", F.count("*").over(of_date)).where(F.col("__n") >= n).withColumn("score", F.col("factor"))
    if config.momentum_weight is not None:
        w = config.momentum_weight
        rows = zscore(zscore(rows, "factor", "__f"), "momentum", "__m").withColumn("score", (F.col("__f") + w * F.col("__m")) / (1 + w)).where(F.col("score").isNotNull())
        rows = rows.withColumn("__n", F.count("*").over(of_date)).where(F.col("__n") >= n)
    rows = rows.select("date", "ticker", "sector", "score")
    picked = sector_capped(rows, n, config.sector_cap) if config.sector_cap is not None else ranked(rows).where(F.col("rank") <= n)
    return concentrated(picked, config.concentration).select("date", "ticker", "rank", "weight")


def holdings(factors: DataFrame, rebalance: DataFrame, config: Config) -> DataFrame:
    """(date, ticker, weight) for each rebalance date: what the factors of that date select.

    A date whose factors leave too few names holds nothing; a date without any factor buys the names of the last date with factors again.
    """
    decided = factors.select("date").distinct().withColumn("decided", F.col("date"))
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # a row a rebalance date
    source = rebalance.select("date").distinct().join(decided, "date", "left").withColumn("source", F.last("decided", ignorenulls=True).over(before)).select("date", "source")
    return source.join(selected(factors, config).withColumnRenamed("date", "source"), "source").select("date", "ticker", "weight")


def backtest(factors: DataFrame, rebalance: DataFrame, prices: DataFrame, config: Config, start: str | None = None) -> DataFrame:
    """(date, nav) from the first rebalance date on; `start` adds a value of 1 at a date without one.

    Only tickers with prices (date, ticker, close) are candidates.
    """
    traded = factors.join(prices.where(F.col("close").isNotNull()).select("ticker").distinct(), "ticker", "left_semi")
    # dates whose factors have no traded ticker are decided too: they hold nothing
    dates = factors.select("date").distinct()
    known = dates.join(traded, "date", "left")
    path = nav(holdings(known, rebalance, config), prices, rebalance)
    if start is None:
        return path
    seed = path.sparkSession.range(1).select(F.lit(start).cast("date").alias("date"), F.lit(1.0).alias("nav"))
    return path.unionByName(seed.join(path.select("date"), "date", "left_anti"))

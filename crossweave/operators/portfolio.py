"""Selection, weights and value of long-only portfolios, all rebalance dates at once."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(scores: DataFrame, score: str = "score", out: str = "rank", keys: tuple[str, ...] = ("date",), tie: str = "ticker") -> DataFrame:
    return scores.where(F.col(score).isNotNull()).withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie)))


def prefiltered(scores: DataFrame, n: int, share: float, score: str = "score") -> DataFrame:
    """The best max(n, ceil(share of the names)) of each date."""
    rows = ranked(scores, score).withColumn("__all", F.count("*").over(Window.partitionBy("date")))
    return rows.where(F.col("rank") <= F.greatest(F.lit(n), F.ceil(F.col("__all") * share))).drop("__all")


def sector_capped(scores: DataFrame, n: int, cap: int, score: str = "score") -> DataFrame:
    """The best n of each date with at most c a sector, c the smallest from `cap` on that leaves n names; all rows if there are fewer.

    Taking greedily under a cap of c is the filter `rank in sector <= c` followed by the best n, so no loop is needed.
    """
    rows = ranked(ranked(scores, score, "in_sector", ("date", "sector")), score)
    counts = rows.groupBy("date").agg(*(F.count_if(F.col("in_sector") <= c).alias(f"c{c}") for c in range(cap, n + 1)))
    least = F.coalesce(*(F.when(F.col(f"c{c}") >= n, F.lit(c)) for c in range(cap, n + 1)), F.lit(n))
    kept = rows.join(counts.select("date", least.alias("__c")), "date").where(F.col("in_sector") <= F.col("__c")).drop("__c")
    return ranked(kept, score).where(F.col("rank") <= n)


def concentrated(picked: DataFrame, concentration: float = 1.0) -> DataFrame:
    """Adds weight: the better half shares c/(c+1), the other half 1/(c+1); equal for c = 1."""
    n = F.count("*").over(Window.partitionBy("date"))
    half = F.ceil(n / 2)
    top = concentration / (concentration + 1)
    share = F.when(F.col("rank") <= half, F.lit(top) / half).otherwise(F.lit(1 - top) / F.nullif(n - half, F.lit(0)))
    return picked.withColumn("weight", F.lit(1.0) / n if concentration == 1 else F.when(n == 1, 1.0).otherwise(share))


def nav(holdings: DataFrame, prices: DataFrame, rebalance: DataFrame | None = None) -> DataFrame:
    """(date, nav): buy and hold from (date, ticker, weight) to the next date, chained; missing prices earn nothing.

    rebalance: the dates (date) of decisions, if some of them hold nothing; the value then stands still until the next.
    A period joins its holdings with the prices of its dates; only the chain of period ends, a row a rebalance, is sequential.
    """
    starts = (holdings if rebalance is None else rebalance).select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date"))).withColumnRenamed("date", "start")
    begin = prices.select(F.col("date").alias("start"), "ticker", F.col("close").alias("p0"))
    held = holdings.withColumnRenamed("date", "start").join(begin, ["start", "ticker"], "left")
    dated = prices.select("date").distinct().join(starts, (F.col("date") >= F.col("start")) & (F.col("date") <= F.coalesce("next", F.lit("9999-12-31").cast("date"))))
    path = dated.join(held, "start", "left").join(prices.select("date", "ticker", "close"), ["date", "ticker"], "left")
    earned = F.sum(F.col("weight") * F.coalesce(F.try_divide("close", "p0") - 1, F.lit(0.0)))
    daily = path.groupBy("start", "next", "date").agg((1 + F.coalesce(earned, F.lit(0.0))).alias("growth"))
    ends = daily.where(F.col("date") == F.col("next")).select("start", F.col("growth").alias("end"))
    chain = ends.withColumn("base", F.product("end").over(Window.orderBy("start").rowsBetween(Window.unboundedPreceding, 0)))
    base = starts.select("start").join(chain, "start", "left").withColumn("base", F.coalesce(F.lag("base").over(Window.orderBy("start")), F.lit(1.0)))
    out = daily.join(base.select("start", "base"), "start").where(F.col("next").isNull() | (F.col("date") < F.col("next")))
    return out.select("date", (F.col("base") * F.col("growth")).alias("nav"))


def daily_nav(holdings: DataFrame, prices: DataFrame, rebalance: DataFrame | None = None) -> DataFrame:
    """(date, nav): equal weights again each day, from (date, ticker) up to the day before the next date, chained.

    A day earns the mean change of the held names' prices, filled within the period; names without a price count as unchanged, a period's first
    day earns nothing, and the value stands still where nothing is held. rebalance: as in nav().
    """
    starts = (holdings if rebalance is None else rebalance).select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date"))).withColumnRenamed("date", "start")
    dated = prices.select("date").distinct().join(starts, (F.col("date") >= F.col("start")) & (F.col("next").isNull() | (F.col("date") < F.col("next")))).select("date", "start")
    held = dated.join(holdings.select(F.col("date").alias("start"), "ticker"), "start").join(prices.select("date", "ticker", "close"), ["date", "ticker"], "left")
    w = Window.partitionBy("start", "ticker").orderBy("date")
    held = held.withColumn("__p", F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    change = F.coalesce(F.try_divide("__p", F.nullif(F.lag("__p").over(w), F.lit(0.0))) - 1, F.lit(0.0))
    daily = dated.join(held.withColumn("__r", change).groupBy("date").agg(F.avg("__r").alias("__r")), "date", "left")
    chain = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # a row a date
    return daily.select("date", F.product(1 + F.coalesce("__r", F.lit(0.0))).over(chain).alias("nav"))


def compared(baseline: DataFrame, alternative: DataFrame, periods: int = 252, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(portfolio, total, years, cagr, vol, sharpe, max_drawdown, final, ahead) of two paths (date, nav) over the dates of both; ahead: share of dates, in percent, with the higher value.

    hold: applied to the two paths, a row a date, which are read four times, e.g. a checkpoint.
    """
    both = hold(baseline.select("date", F.col("nav").alias("a")).join(alternative.select("date", F.col("nav").alias("b")), "date"))
    out = None
    for name, own, other in (("baseline", "a", "b"), ("alternative", "b", "a")):
        path = both.select("date", F.col(own).alias("nav"))
        lead = both.agg(F.max_by(own, "date").alias("final"), F.avg(F.when(F.col(own) > F.col(other), 100.0).otherwise(0.0)).alias("ahead"))
        figures = performance(path, periods).crossJoin(lead).select(F.lit(name).alias("portfolio"), "*")  # one row each
        out = figures if out is None else out.unionByName(figures)
    return out


def performance(path: DataFrame, periods: int = 252) -> DataFrame:
    """(total, years, cagr, vol, sharpe, max_drawdown) of (date, nav)."""
    w = Window.orderBy("date")  # a row a date
    rows = path.withColumns({"ret": F.col("nav") / F.lag("nav").over(w) - 1, "dd": F.col("nav") / F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1})
    figures = rows.agg(F.min_by("nav", "date").alias("first"), F.max_by("nav", "date").alias("last"), F.datediff(F.max("date"), F.min("date")).alias("days"), (F.stddev_samp("ret") * math.sqrt(periods)).alias("vol"), F.min("dd").alias("max_drawdown"))
    figures = figures.withColumns({"total": F.col("last") / F.col("first") - 1, "years": F.col("days") / 365.25})
    figures = figures.withColumn("cagr", F.pow(F.col("last") / F.col("first"), F.try_divide(F.lit(1.0), "years")) - 1)
    return figures.select("total", "years", "cagr", "vol", F.try_divide("cagr", "vol").alias("sharpe"), "max_drawdown")


def holdings_matrix(picked: DataFrame, n: int) -> DataFrame:
    """A row a date with the tickers of ranks 1 .. n as columns."""
    return picked.where(F.col("rank") <= n).groupBy("date").pivot("rank", list(range(1, n + 1))).agg(F.first("ticker")).withColumnsRenamed({str(k): f"stock{k}" for k in range(1, n + 1)})

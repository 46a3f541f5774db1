"""A composite of many metrics whose weights depend on a regime, evaluated for every setting of the regime at once.

Metrics are ranked once, within date and sector. Weights of both regimes come out of the spreads of these ranks between the names with the best and the
worst returns that followed, inside the plan. A setting of the regime only changes how two scores a name mix, so all settings share the ranks,
the weights, the scores and the deciles; what each of them adds is one median a decile.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossweave.operators.panel import asof_backward
from crossweave.operators.signals import t_statistic
from crossweave.operators.timeseries import rate_grid
from crossweave.operators.xsection import average_rank, winsorized

Hold = Callable[[DataFrame], DataFrame]


def ranked_metrics(rows: DataFrame, metrics: Sequence[str], least: int = 3) -> DataFrame:
    """(ticker, date, metric, r) of rows (ticker, date, sector, metrics): ranks from 0 to 1 of winsorised values within date and sector, of at least `least` values."""
    long = rows.select("ticker", "date", "sector", *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(["ticker", "date", "sector"], list(metrics), "metric", "v")
    group = ("date", "sector", "metric")
    long = long.where(F.col("v").isNotNull() & F.col("sector").isNotNull()).withColumn("__n", F.count("*").over(Window.partitionBy(*group))).where(F.col("__n") >= least)
    long = winsorized(long, "v", "__w", group)
    return long.select("ticker", "date", "metric", F.when(F.col("__n") > 1, (average_rank("__w", group) - 1) / (F.col("__n") - 1)).otherwise(0.5).alias("r"))


def deciles(returns: DataFrame, least: int, share: float = 0.1, keys: Sequence[str] = ("date", "horizon")) -> DataFrame:
    """(ticker, keys, side) of the names with the best (1) and the worst (-1) returns (ticker, keys, resid), of keys with at least `least` names; ties by ticker."""
    by = Window.partitionBy(*keys)
    rows = returns.where(F.col("resid").isNotNull()).withColumns({"__n": F.count("*").over(by), "__up": F.row_number().over(by.orderBy(F.desc("resid"), "ticker"))}).where(F.col("__n") >= least)
    k = F.greatest(F.lit(1), F.floor(F.col("__n") * share))
    sides = F.array_compact(F.array(F.when(F.col("__up") <= k, 1), F.when(F.col("__up") > F.col("__n") - k, -1)))
    return rows.select("ticker", *keys, F.explode(sides).alias("side"))


def _spread(rows: DataFrame, value: str, deviation: str, keys: Sequence[str]) -> DataFrame:
    """(keys, spread_z): the median of the best names less that of the worst, over the deviation of all."""
    median = lambda side: F.median(F.when(F.col("side") == side, F.col(value)))
    out = rows.groupBy(*keys).agg((median(1) - median(-1)).alias("__gap"), F.first(deviation).alias("__sd"))
    return out.where(F.col("__gap").isNotNull() & (F.col("__sd") > 0)).select(*keys, (F.col("__gap") / F.col("__sd")).alias("spread_z"))


def metric_spreads(ranks: DataFrame, sides: DataFrame) -> DataFrame:
    """(date, horizon, metric, spread_z) of ranked_metrics() and deciles()."""
    spread = ranks.groupBy("date", "metric").agg(F.stddev_samp("r").alias("sd"))
    rows = sides.join(ranks, ["ticker", "date"]).join(spread, ["date", "metric"])
    return _spread(rows, "r", "sd", ("date", "horizon", "metric"))


def regime_weights(spreads: DataFrame, conservative: Sequence[int], top: int = 10) -> DataFrame:
    """(conservative, metric, avg, t, weight): metrics above the medians of mean and t of their regime, the best `top` by t, weighted by t.

    The years given are the conservative regime, all others the growth regime. Mean and t are those of each horizon with two dates or more, averaged.
    """
    rows = spreads.withColumn("conservative", F.year("date").isin(*conservative))
    by = rows.groupBy("conservative", "metric", "horizon").agg(F.count("*").alias("__n"), F.avg("spread_z").alias("avg"), t_statistic("spread_z").alias("t")).where(F.col("__n") >= 2)
    by = by.groupBy("conservative", "metric").agg(F.avg("avg").alias("avg"), F.avg("t").alias("t"))
    w = Window.partitionBy("conservative")  # a row a metric
    good = by.withColumns({"__ma": F.median("avg").over(w), "__mt": F.median("t").over(w)}).where((F.col("avg") > 0) & (F.col("avg") > F.col("__ma")) & (F.col("t") > F.col("__mt")))
    best = good.withColumn("__k", F.row_number().over(w.orderBy(F.desc("t"), "metric"))).where(F.col("__k") <= top)
    up = F.greatest("t", F.lit(0.0))
    best = best.withColumn("__sum", F.sum(up).over(w)).where(F.col("__sum") > 0)
    return best.select("conservative", "metric", "avg", "t", (up / F.col("__sum")).alias("weight"))


def regime_scores(names: DataFrame, ranks: DataFrame, weights: DataFrame) -> DataFrame:
    """(ticker, date, growth, guarded) of all names (ticker, date): weighted ranks of the two regimes, missing ranks as 0; NULL for a regime without weights."""
    part = lambda regime: F.sum(F.when(F.col("conservative") == regime, F.col("weight") * F.col("r")))
    scored = ranks.join(weights.select("conservative", "metric", "weight"), "metric").groupBy("ticker", "date").agg(part(False).alias("growth"), part(True).alias("guarded"))
    has = weights.agg(F.coalesce(F.bool_or(~F.col("conservative")), F.lit(False)).alias("__g"), F.coalesce(F.bool_or("conservative"), F.lit(False)).alias("__c"))  # one row
    rows = names.select("ticker", "date").distinct().join(scored, ["ticker", "date"], "left").join(F.broadcast(has))
    zero = lambda c, some: F.when(F.col(some), F.coalesce(c, F.lit(0.0))).alias(c)
    return rows.select("ticker", "date", zero("growth", "__g"), zero("guarded", "__c"))


def mixed(growth: Column, guarded: Column, q: Column) -> Column:
    return (1 - q) * growth + q * guarded


def spread_summary(spreads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, mean_spread_z, t_stat, consistency, n_dates) of two dates or more; consistency: percent of positive spreads."""
    out = spreads.groupBy(*keys).agg(F.avg("spread_z").alias("mean_spread_z"), t_statistic("spread_z").alias("t_stat"), F.avg(F.when(F.col("spread_z") > 0, 100.0).otherwise(0.0)).alias("consistency"), F.count("*").alias("n_dates"))
    return out.where(F.col("n_dates") >= 2)


def evaluated_grid(
    rows: DataFrame, metrics: Sequence[str], returns: DataFrame, rates: DataFrame, windows: Sequence[int], thresholds: Sequence[float], conservative: Sequence[int], least: int = 20, hold: Hold = lambda df: df
) -> DataFrame:
    """(window, threshold, horizon, mean_spread_z, t_stat, consistency, n_dates) for every window and threshold of the regime.

    rows: (ticker, date, sector, metrics) at the dates to judge. returns: what followed, (ticker, date, horizon, resid). rates: (date, value); a date takes the last
    regime up to it, 0.5 before the first. hold: applied to the ranks, which three branches read, e.g. a checkpoint.
    """
    ranks = hold(ranked_metrics(rows, metrics))
    weights = regime_weights(metric_spreads(ranks, deciles(returns, least)), conservative)
    scores = hold(regime_scores(rows, ranks, weights))
    cells = rate_grid(rates, tuple(windows), tuple(thresholds)).withColumn("__cell", F.concat_ws(" ", "window", "threshold"))
    # as many rows as cells and dates
    grid = cells.select("__cell", "window", "threshold").distinct()
    asked = grid.crossJoin(F.broadcast(rows.select("date").distinct()))
    regime = asof_backward(asked, cells.select("__cell", "date", "q"), ["q"], key="__cell").withColumn("q", F.coalesce("q", F.lit(0.5)))
    common = returns.join(scores.where(mixed(F.col("growth"), F.col("guarded"), F.lit(0.5)).isNotNull()), ["ticker", "date"])
    sides = deciles(common.select("ticker", "date", "horizon", "resid"), least)
    value = F.round(mixed(F.col("growth"), F.col("guarded"), F.col("q")), 12).alias("value")
    keys = ("window", "threshold", "date")
    spread = scores.join(regime, "date").select(*keys, value).groupBy(*keys).agg(F.stddev_samp("value").alias("sd"))
    judged = sides.join(scores, ["ticker", "date"]).join(regime, "date").select(*keys, "horizon", "side", value).join(spread, list(keys))
    return spread_summary(_spread(judged, "value", "sd", (*keys, "horizon")), ("window", "threshold", "horizon"))

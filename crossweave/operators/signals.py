"""How well a signal orders what follows: information coefficients, decile spreads and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossweave.operators.xsection import average_rank, dealt, percent_rank, winsorized


def t_statistic(c: str) -> Column:
    return F.try_divide(F.avg(c), F.nullif(F.stddev_samp(c), F.lit(0.0)) / F.sqrt(F.count(c)))


def positive_share(c: str) -> Column:
    return F.avg(F.when(F.col(c) > 0, 100.0).when(F.col(c).isNotNull(), 0.0))


def sector_ic(rows: DataFrame, signal: str, target: str, least: int = 10, keys: tuple[str, ...] = ("date",), positive: bool = False) -> DataFrame:
    """(keys, ic, n): Spearman within sectors of at least `least` names, averaged by their numbers of names; positive: signals that are not are dropped."""
    inner = (*keys, "sector")
    known = rows.where(F.col(signal).isNotNull() & F.col(target).isNotNull())
    known = known.where(F.col(signal) > 0) if positive else known
    known = dealt(known.select(*inner, signal, target), inner)
    known = known.withColumn("__n", F.count("*").over(Window.partitionBy(*inner))).where(F.col("__n") >= least)
    known = winsorized(winsorized(known, signal, "__s", inner), target, "__t", inner)
    ranked = known.withColumns({"__rs": average_rank("__s", inner), "__rt": average_rank("__t", inner)})
    by = ranked.groupBy(*inner).agg(F.corr("__rs", "__rt").alias("ic"), F.count("*").alias("n")).where(F.col("ic").isNotNull() & ~F.isnan("ic"))
    return by.groupBy(*keys).agg((F.sum(F.col("n") * F.col("ic")) / F.sum("n")).alias("ic"), F.sum("n").alias("n"))


def rank_ic(rows: DataFrame, signal: str, target: str, least: int = 10) -> DataFrame:
    """(date, ic): correlation of the sector-neutral percent ranks of signal and target over all rows of a date."""
    known = rows.where(F.col(signal).isNotNull() & F.col(target).isNotNull())
    known = percent_rank(percent_rank(known, signal, "__s", ("date", "sector")), target, "__t", ("date", "sector"))
    return known.groupBy("date").agg(F.when(F.count("*") >= least, F.corr("__s", "__t")).alias("ic"))


def rolling_ic(ics: DataFrame, window: int = 252, horizon: int = 21) -> DataFrame:
    """Adds rolling: the mean of the known ICs of the last `window` dates, where the window is full and the horizon lies in the sample."""
    w = Window.orderBy("date")  # a row a date
    rows = ics.withColumns({"__i": F.row_number().over(w), "__n": F.count("*").over(Window.partitionBy())})
    inside = (F.col("__i") >= window) & (F.col("__i") <= F.col("__n") - horizon)
    return rows.withColumn("rolling", F.when(inside, F.avg("ic").over(w.rowsBetween(-(window - 1), 0)))).drop("__i", "__n")


def ic_summary(ics: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    rows = ics.groupBy(*keys).agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), t_statistic("ic").alias("t"), positive_share("ic").alias("positive"))
    return rows.where("n >= 2").withColumn("ir", F.try_divide("mean", F.nullif("std", F.lit(0.0))))


def decile_spread(rows: DataFrame, signal: str, target: str, share: float = 0.1, keys: tuple[str, ...] = ("date",), tie: str = "ticker") -> DataFrame:
    """(keys, top, bottom, spread_z, n): median signal of the names with the best and worst targets, against the deviation of all."""
    known = rows.where(F.col(signal).isNotNull() & F.col(target).isNotNull())
    w = Window.partitionBy(*keys)
    known = known.withColumns({"__n": F.count("*").over(w), "__up": F.row_number().over(w.orderBy(F.desc(target), tie)), "__down": F.row_number().over(w.orderBy(F.asc(target), tie))})
    k = F.greatest(F.lit(1), F.floor(F.col("__n") * share))
    best, worst = F.when(F.col("__up") <= k, F.col(signal)), F.when(F.col("__down") <= k, F.col(signal))
    out = known.groupBy(*keys).agg(F.median(best).alias("top"), F.median(worst).alias("bottom"), F.stddev_samp(signal).alias("__s"), F.count("*").alias("n"))
    return out.withColumn("spread_z", F.try_divide(F.col("top") - F.col("bottom"), F.nullif("__s", F.lit(0.0)))).drop("__s")


def compounded_forward(returns: DataFrame, horizon: int, least: int | None = None) -> DataFrame:
    """Adds fwd: compounded returns of the next `horizon` rows, missing ones as 0, if at least `least` are known and the horizon is full."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(1, horizon)
    grown = F.product(1 + F.coalesce(F.col("ret"), F.lit(0.0))).over(w) - 1
    enough = (F.count("*").over(w) == horizon) & (F.count("ret").over(w) >= (max(1, horizon // 2) if least is None else least))
    return returns.withColumn("fwd", F.when(enough, grown))


def sector_beta_residual(rows: DataFrame, window: int = 63, least: int = 20) -> DataFrame:
    """Adds resid: the forward return less beta times the date's mean forward return, less the sector's mean of that; beta over trailing rows."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(window - 1), 0)
    beta = F.try_divide(F.covar_samp("ret", "mkt").over(w), F.nullif(F.var_samp(F.when(F.col("ret").isNotNull(), F.col("mkt"))).over(w), F.lit(0.0)))
    rows = rows.withColumn("beta63", F.when(F.count(F.when(F.col("ret").isNotNull(), F.col("mkt"))).over(w) >= least, beta)).withColumn("beta63", F.coalesce("beta63", F.lit(1.0)))
    rows = rows.withColumn("__e", F.col("fwd") - F.col("beta63") * F.avg("fwd").over(Window.partitionBy("date")))
    return rows.withColumn("resid", F.col("__e") - F.avg("__e").over(Window.partitionBy("date", "sector"))).drop("__e")


def metric_weights(spreads: DataFrame, top: int = 10) -> DataFrame:
    """(metric, avg, t, weight) from (metric, horizon, date, spread_z): metrics above the medians, the best by t, weighted by t."""
    by = spreads.groupBy("metric", "horizon").agg(F.avg("spread_z").alias("avg"), t_statistic("spread_z").alias("t")).groupBy("metric").agg(F.avg("avg").alias("avg"), F.avg("t").alias("t"))
    everything = Window.partitionBy()  # a row a metric
    good = by.withColumns({"__ma": F.median("avg").over(everything), "__mt": F.median("t").over(everything)}).where("avg > 0 AND avg > __ma AND t > __mt").drop("__ma", "__mt")
    best = good.withColumn("__k", F.row_number().over(Window.orderBy(F.desc("t"), "metric"))).where(F.col("__k") <= top).drop("__k")
    return best.withColumn("weight", F.greatest("t", F.lit(0.0)) / F.sum(F.greatest("t", F.lit(0.0))).over(everything))


def pooled_variance(rows: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*keys).agg(F.var_pop(value).alias("variance"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def lambda_stats(lambdas: DataFrame, keys: tuple[str, ...] = ("factor",), value: str = "slope") -> DataFrame:
    q = lambda p: F.percentile(value, F.lit(p))
    return lambdas.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), t_statistic(value).alias("t"), positive_share(value).alias("positive"),
        F.min(value).alias("lo"), q(0.05).alias("p5"), F.median(value).alias("p50"), q(0.95).alias("p95"), F.max(value).alias("hi"),
    )


def daily_r2(raw: DataFrame, resid: DataFrame) -> DataFrame:
    """(date, r2): 1 - variance of residuals / variance of raw values, over the names of both."""
    both = raw.join(resid, ["date", "ticker"]).where(F.col("raw").isNotNull() & F.col("resid").isNotNull())
    return both.groupBy("date").agg((1 - F.try_divide(F.var_samp("resid"), F.nullif(F.var_samp("raw"), F.lit(0.0)))).alias("r2"))

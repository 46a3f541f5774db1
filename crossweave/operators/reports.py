"""Summaries of model runs, and universe and calendar selections."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossweave.operators.signals import t_statistic
from crossweave.sources.tables import first_of, normalised


def universe(prices: DataFrame, sectors: DataFrame, reporting: DataFrame, start, lookback: int = 252, least: int = 126, not_stocks: DataFrame | None = None) -> DataFrame:
    """(ticker): names with a sector and with reports, not among not_stocks, and with `least` prices in the `lookback` dates before `start`.

    The history is not asked for when fewer than `lookback` dates precede the start.
    """
    names = prices.select("ticker").distinct().join(sectors.select("ticker"), "ticker", "left_semi").join(reporting.select("ticker"), "ticker", "left_semi")
    if not_stocks is not None:
        names = names.join(not_stocks.select("ticker"), "ticker", "left_anti")
    back = prices.where(F.col("date") < F.lit(start)).select("date").distinct().withColumn("__k", F.row_number().over(Window.orderBy(F.desc("date")))).where(F.col("__k") <= lookback)
    long_enough = back.agg((F.count("*") >= lookback).alias("__full"))
    counts = prices.join(back.select("date"), "date", "left_semi").groupBy("ticker").agg(F.count("close").alias("__n"))
    return names.join(counts, "ticker", "left").crossJoin(F.broadcast(long_enough)).where(~F.col("__full") | (F.col("__n") >= least)).select("ticker")


def dates_before(cal: DataFrame, start, n: int) -> DataFrame:
    """(date): the date `n` rows of the calendar before the first one from `start` on, or the first date there is."""
    rows = cal.select("date").distinct().withColumn("__i", F.row_number().over(Window.orderBy("date")))
    first = rows.where(F.col("date") >= F.lit(start)).agg(F.min("__i").alias("__at"))
    return rows.join(F.broadcast(first), F.col("__i") == F.greatest(F.col("__at") - n, F.lit(1))).select("date")


def last_dates(rows: DataFrame, n: int) -> DataFrame:
    """The rows of the last n dates."""
    keep = rows.select("date").distinct().orderBy(F.desc("date")).limit(n)
    return rows.join(F.broadcast(keep), "date", "left_semi")


def last_days(rows: DataFrame, days: int) -> DataFrame:
    """The rows of the last so many calendar days."""
    return rows.join(F.broadcast(rows.agg(F.max("date").alias("__max"))), F.col("date") >= F.date_sub("__max", days)).drop("__max")


def common_dates(*tables: DataFrame) -> DataFrame:
    """(date): the dates that all tables have; tables without rows don't count."""
    sets = [t.select("date").distinct() for t in tables if not t.isEmpty()]
    out = sets[0]
    for s in sets[1:]:
        out = out.join(s, "date", "left_semi")
    return out


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has: must be empty before a strict pivot."""
    return rows.groupBy(*keys).count().where(F.col("count") > 1)


def to_wide(rows: DataFrame, value: str, names: list[str], order: str = "date") -> DataFrame:
    """A column a name, for display; of equal keys the last by `order` counts."""
    return rows.groupBy("date").pivot("ticker", names).agg(F.max_by(value, order))


def variance_table(steps: DataFrame) -> DataFrame:
    """(k, step, variance, of_raw, of_previous, n) from (k, step, x): pooled variances in percent of the first and of the one before."""
    return _of_first_and_previous(steps.groupBy("k", "step").agg(F.var_pop("x").alias("variance"), F.count("x").alias("n")))


def variance_of_moments(moments: DataFrame) -> DataFrame:
    """variance_table() from each date's moments (k, step, n, total, squares) in place of its residuals; steps without residuals have no row."""
    by = moments.groupBy("k", "step").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares"))).where(F.col("n") > 0)
    mean = F.col("total") / F.col("n")
    return _of_first_and_previous(by.select("k", "step", F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)).alias("variance"), F.col("n").cast("long").alias("n")))


def _of_first_and_previous(by: DataFrame) -> DataFrame:
    w = Window.orderBy("k")  # a row a step
    return by.withColumns({"of_raw": 100 * F.col("variance") / F.first("variance").over(w), "of_previous": 100 * F.col("variance") / F.lag("variance").over(w)})


def consolidated_intercept(lambdas: DataFrame) -> DataFrame:
    """(date, alpha): the sum of all steps' intercepts."""
    return lambdas.groupBy("date").agg(F.coalesce(F.sum("intercept"), F.lit(0.0)).alias("alpha"))


def intercept_summary(lambdas: DataFrame) -> DataFrame:
    return consolidated_intercept(lambdas).agg(F.avg("alpha").alias("mean"), F.stddev_samp("alpha").alias("std"), t_statistic("alpha").alias("t"))


def last_lambdas(lambdas: DataFrame, n: int = 5) -> DataFrame:
    """(date, factor, slope, intercept, r2) of the last n dates, in percent, two places."""
    return last_dates(lambdas, n).select("date", "factor", *(F.round(100 * F.col(c), 2).alias(c) for c in ("slope", "intercept", "r2")))


def ridge_counts(lambdas: DataFrame) -> DataFrame:
    """(ridge, n, percent)"""
    by = lambdas.select("date", "ridge").distinct().groupBy("ridge").agg(F.count("*").alias("n"))
    return by.withColumn("percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def sector_spread(lambdas: DataFrame) -> DataFrame:
    """(date, spread): best less worst cumulative return of the factors."""
    total = F.sum(F.coalesce("slope", F.lit(0.0))).over(Window.partitionBy("factor").orderBy("date"))
    return lambdas.withColumn("__c", total).groupBy("date").agg((F.max("__c") - F.min("__c")).alias("spread"))


def vol_comparison(vols: DataFrame) -> DataFrame:
    """Of (date, ticker, vol, gk) on the last date: means, medians, extremes, their ratio, and missing shares."""
    rows = last_dates(vols, 1).withColumn("ratio", F.try_divide("gk", "vol"))
    return rows.agg(*(f(c).alias(f"{c}_{n}") for c in ("vol", "gk", "ratio") for n, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))), F.avg((F.col("ratio") < 1).cast("int")).alias("below"), F.avg(F.col("gk").isNull().cast("int")).alias("missing"))


def derived_metrics(rows: DataFrame, pairs: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Adds name: (base, 'vol', v) as base / max(v, 1), or (base, 'r2', r) as base * r; missing inputs give NULL."""
    have = set(rows.columns)

    def one(base: str, kind: str, by: str):
        if base not in have or by not in have:
            return F.lit(None).cast("double")
        return F.col(base) / F.when(F.col(by).isNotNull(), F.greatest(F.col(by), F.lit(1.0))) if kind == "vol" else F.col(base) * F.col(by)

    return rows.withColumns({name: one(*spec) for name, spec in pairs.items()})


def snapshot(rows: DataFrame, on: str, numeric: list[str], pairs: dict[str, tuple[str, str, str]]) -> DataFrame:
    """One row a ticker of one date with its numbers read and its derived metrics; of tickers that read alike, the first as written."""
    rows = rows.where((F.col("date") == F.lit(on).cast("date")) & F.col("ticker").isNotNull()).withColumn("__raw", F.col("ticker"))
    rows = first_of(normalised(rows), ["ticker"], "__raw").drop("__raw")
    return derived_metrics(rows.withColumns({c: F.col(c).try_cast("double") for c in numeric if c in rows.columns}), pairs)


def regime_composite(rows: DataFrame, growth: str, conservative: str, regime: str, out: str = "score") -> DataFrame:
    """(1 - q) growth + q conservative."""
    return rows.withColumn(out, (1 - F.col(regime)) * F.col(growth) + F.col(regime) * F.col(conservative))


def ic_weighted(rows: DataFrame, ics: dict[str, float], out: str = "score") -> DataFrame:
    """Sum of raw scores by share of absolute IC; equal shares if all are 0."""
    total = sum(map(abs, ics.values()))
    weights = {k: abs(v) / total if total else 1 / len(ics) for k, v in ics.items()}
    return rows.withColumn(out, sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)))


def long_short(rows: DataFrame, rank: str, target: str, share: float = 0.2) -> DataFrame:
    """(date, spread): mean target of the names at or above the upper quantile less that at or below the lower one."""
    w = Window.partitionBy("date")
    q = rows.withColumns({"__hi": F.percentile(rank, F.lit(1 - share)).over(w), "__lo": F.percentile(rank, F.lit(share)).over(w)})
    return q.groupBy("date").agg((F.avg(F.when(F.col(rank) >= F.col("__hi"), F.col(target))) - F.avg(F.when(F.col(rank) <= F.col("__lo"), F.col(target)))).alias("spread"))


def cap_weighted(rows: DataFrame, value: str, keys: tuple[str, ...] = ("date", "sector"), least: int = 3) -> DataFrame:
    known = rows.where(F.col(value).isNotNull() & F.col("cap").isNotNull())
    return known.groupBy(*keys).agg((F.sum(F.col(value) * F.col("cap")) / F.sum("cap")).alias("mean"), F.count("*").alias("n")).where(F.col("n") >= least)


def harmonic_multiple(rows: DataFrame, multiple: str, keys: tuple[str, ...] = ("date", "sector")) -> DataFrame:
    """Sum of capitalisations over the sum of what they are multiples of; zero multiples are left out."""
    known = rows.where((F.col(multiple) != 0) & F.col("cap").isNotNull())
    return known.groupBy(*keys).agg((F.sum("cap") / F.nullif(F.sum(F.col("cap") / F.col(multiple)), F.lit(0.0))).alias("multiple"))


def portfolio_risk(exposures: DataFrame, lambdas: DataFrame, idio: DataFrame, periods: int = 252) -> DataFrame:
    """(factor_risk, idio_risk, total) of (ticker, weight, factor, x), factor returns (date, factor, slope) and variances (ticker, variance)."""
    load = exposures.groupBy("factor").agg(F.sum(F.col("weight") * F.col("x")).alias("b"))
    pairs = lambdas.select("date", F.col("factor").alias("f"), F.col("slope").alias("u")).join(lambdas.select("date", F.col("factor").alias("g"), F.col("slope").alias("v")), "date")
    cov = pairs.groupBy("f", "g").agg(F.covar_samp("u", "v").alias("c"))
    common = cov.join(load.withColumnsRenamed({"factor": "f", "b": "bf"}), "f").join(load.withColumnsRenamed({"factor": "g", "b": "bg"}), "g").agg((F.sum(F.col("c") * F.col("bf") * F.col("bg")) * periods).alias("factor_risk"))
    own = exposures.select("ticker", "weight").distinct().join(idio, "ticker").agg((F.sum(F.col("weight") * F.col("weight") * F.col("variance")) * periods).alias("idio_risk"))
    both = common.crossJoin(own)  # one row each
    return both.withColumn("total", F.sqrt(F.col("factor_risk") + F.col("idio_risk"))).select(F.sqrt("factor_risk").alias("factor_risk"), F.sqrt("idio_risk").alias("idio_risk"), "total")


def annualised(value: float, periods: int = 252) -> float:
    return value * math.sqrt(periods)

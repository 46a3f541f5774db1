"""Registered panel queries. Doubles are rounded to six places, small ones to ten, integers are long, on the Spark and on the SQL side alike."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossweave.functions import scalar as S
from crossweave.operators import backtest as T
from crossweave.operators import fundamentals as Q
from crossweave.operators import gram as G
from crossweave.operators import panel as P
from crossweave.operators import portfolio as B
from crossweave.operators import regress as R
from crossweave.operators import reports as N
from crossweave.operators import signals as I
from crossweave.operators import timeseries as W
from crossweave.operators import xsection as X
from crossweave.plans import panels, steps
from crossweave.plans.oracle import NUDGE, SMALL
from crossweave.sources import tables
from crossweave.streaming.incremental import windowed_events

Query = Callable[[SparkSession, str], DataFrame]
#: Names a date needs; the fixtures have 10 to 1000 suppliers.
MIN_NAMES = 5
HORIZON = 4

QUERIES: dict[str, Query] = {}


def rounded(df: DataFrame) -> DataFrame:
    kinds = {"double": lambda c: F.when(F.abs(c) < SMALL, F.round(F.col(c) * NUDGE, 10)).otherwise(F.round(F.col(c) * NUDGE, 6)) + F.lit(0.0), "int": lambda c: F.col(c).cast("long")}
    return df.select(*((kinds[k](c) if k in kinds else F.col(c)).alias(c) for c, k in df.dtypes))


def query(f: Query) -> Query:
    QUERIES[f.__name__] = lambda spark, folder: rounded(f(spark, folder))
    return f


# -- panels

@query
def panel_dense(spark, d):
    return panels.dense(spark, d).select("ticker", "date", "i", "close")


@query
def ticker_clean(spark, d):
    return tables.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), S.clean_ticker(F.concat(F.lit(" "), F.regexp_replace(F.lower("s_name"), "#", " us #"))).alias("ticker"))


@query
def returns_clipped(spark, d):
    return panels.returns(spark, d).where(F.col("ret").isNotNull()).select("ticker", "date", "ret", "mkt")


@query
def ffill_gap(spark, d):
    return P.forward_fill(panels.dense(spark, d), "close", "volume", backfill=True).select("ticker", "date", "close", "volume")


@query
def fwd_return(spark, d):
    return P.forward_returns(panels.dense(spark, d), HORIZON).where(F.col("fwd").isNotNull()).select("ticker", "date", "fwd")


@query
def valid_dates(spark, d):
    return P.valid_dates(panels.returns(spark, d), MIN_NAMES)


@query
def spike_filter(spark, d):
    rows = panels.weekly(spark, d).withColumn("close", F.col("raw_px"))
    return P.spike_filter(rows).select("ticker", "date", F.col("spike").cast("int").alias("spike"), "cleaned")


@query
def spike_report(spark, d):
    rows = P.spike_filter(panels.weekly(spark, d).withColumn("close", F.col("raw_px")))
    return rows.groupBy("ticker").agg(F.count_if("spike").alias("n")).where("n > 0").orderBy(F.desc("n"), "ticker").limit(10)


@query
def rebalance_calendar(spark, d):
    return P.rebalance_calendar(P.calendar(panels.weekly(spark, d)), "1993-01-10", 60)


@query
def asof_snapshot(spark, d):
    rows = panels.weekly(spark, d)
    monthly = rows.groupBy("ticker", F.date_trunc("quarter", "date").cast("date").alias("date")).agg(F.sum("amount").alias("size"))
    return P.asof_backward(rows.select("ticker", "date"), monthly, ["size"])


@query
def dynamic_size(spark, d):
    rows = panels.prices(spark, d).select("ticker", "date", "close", "amount")
    snaps = rows.withColumn("__m", F.date_trunc("quarter", "date")).groupBy("ticker", "__m").agg(F.max("date").alias("date"), F.sum("amount").alias("size")).drop("__m")
    return P.dynamic_cap(rows.drop("amount"), snaps).select("ticker", "date", (F.col("cap") / 1e6).alias("cap"))


# -- cross-section

def _disc(spark, d):
    return panels.weekly(spark, d).join(panels.sectors(spark, d), "ticker").withColumn("x", F.round("disc", 9)).select("ticker", "date", "sector", "x", "tax", "returned", "volume")


@query
def zscore_by_date(spark, d):
    return X.zscore(_disc(spark, d), "x", "z").select("ticker", "date", "z")


@query
def size_char(spark, d):
    rows = panels.weekly(spark, d).withColumn("s", S.log_cap(F.col("amount")))
    return X.zscore(rows, "s", "size").select("ticker", "date", "size")


@query
def rank01_sector(spark, d):
    return X.rank01(_disc(spark, d), "x", "r", ("date", "sector"), least=3).select("ticker", "date", "r")


@query
def pct_rank_sector(spark, d):
    return X.percent_rank(_disc(spark, d), "x", "r", ("date", "sector")).select("ticker", "date", "r")


@query
def winsorize_sector(spark, d):
    return X.winsorized(_disc(spark, d), "x", "w", ("date", "sector")).select("ticker", "date", "w")


@query
def qcut_buckets(spark, d):
    return X.quantile_bucket(_disc(spark, d), "x", "bucket").select("ticker", "date", "bucket")


@query
def sector_demean(spark, d):
    rows = X.demeaned(_disc(spark, d), "x", "by_mean")
    return X.demeaned(rows, "x", "by_median", by_median=True).select("ticker", "date", "by_mean", "by_median")


@query
def median_impute(spark, d):
    rows = _disc(spark, d).withColumn("x", F.when(F.col("returned") > 0, F.col("x")))
    return X.median_imputed(rows, "x", "filled").select("ticker", "date", "filled")


@query
def value_reflexivity(spark, d):
    rows = _disc(spark, d).withColumn("x", F.round(F.col("x") - 0.05, 9))
    return X.reflected_value(rows, "x", "v").select("ticker", "date", "v")


@query
def sector_dummies(spark, d):
    names = _sector_names(spark, d)
    rows = X.sector_dummies(panels.sectors(spark, d), names)
    return rows.select("ticker", F.posexplode("x").alias("k", "x"))


@query
def quality_composite(spark, d):
    rows = X.dealt(_disc(spark, d).select("ticker", "date", "sector", "x", "tax", "returned"), ("date", "sector"))
    for c in ("x", "tax", "returned"):
        rows = X.rank01(rows.withColumn(c, F.round(c, 9)), c, f"r_{c}", ("date", "sector"), least=3)
    return X.weighted_composite(rows, {"r_x": 0.5, "r_tax": 0.3, "r_returned": 0.2}, "score").select("ticker", "date", "score")


@query
def si_composite(spark, d):
    return X.si_composite(panels.short_interest(spark, d), MIN_NAMES).select("ticker", "date", "si")


# -- time series

@query
def ewma_beta(spark, d):
    return W.ewma_beta(panels.returns(spark, d)).where(F.col("beta").isNotNull()).select("ticker", "date", "beta")


@query
def macro_beta(spark, d):
    o = tables.table(spark, d, "orders").groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("date")).agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("orders"))
    series = o.unpivot(["date"], ["price", "orders"], "series", "level")
    w = Window.partitionBy("series").orderBy("date")
    series = series.withColumn("value", F.col("level") / F.lag("level").over(w) - 1).where(F.col("value").isNotNull()).select("date", "series", "value")
    return W.macro_betas(panels.returns(spark, d).select("ticker", "date", "i", "ret"), series).select("ticker", "date", "series", "beta")


@query
def cc_vol(spark, d):
    return W.close_vol(panels.returns(spark, d)).where(F.col("vol").isNotNull()).select("ticker", "date", "vol")


@query
def gk_vol(spark, d):
    return W.garman_klass(panels.ohlc(spark, d)).where(F.col("gk").isNotNull()).select("ticker", "date", "gk")


def _resid(spark, d):
    return panels.returns(spark, d).withColumn("resid", F.col("ret") - F.col("mkt"))


@query
def idio_momentum(spark, d):
    return W.idio_momentum(_resid(spark, d)).where(F.col("mom").isNotNull()).select("ticker", "date", "mom")


@query
def idio_momentum_volscaled(spark, d):
    return W.scaled_idio_momentum(W.volume_scalar(_resid(spark, d))).where(F.col("mom").isNotNull()).select("ticker", "date", "mom")


@query
def reversal_21(spark, d):
    return W.reversal(P.forward_fill(panels.dense(spark, d), "close")).where(F.col("reversal").isNotNull()).select("ticker", "date", "reversal")


@query
def momentum_12m1(spark, d):
    return W.price_momentum(P.forward_fill(panels.dense(spark, d), "close")).where(F.col("mom121").isNotNull()).select("ticker", "date", "mom121")


@query
def vol_filter(spark, d):
    return W.realised_vol_filter(panels.returns(spark, d)).groupBy("date").agg(F.count("*").alias("n"), F.max("rvol").alias("top"))


def _market_path(spark, d):
    rows = P.market_returns(panels.returns(spark, d)).where(F.col("mkt").isNotNull())
    return rows.select("date", F.exp(F.sum(F.log1p("mkt")).over(Window.orderBy("date"))).alias("nav"))


@query
def rate_regime(spark, d):
    return W.rate_regime(_market_path(spark, d).select("date", (F.col("nav") * 100).alias("value")), threshold=0.5).select("date", "mav", "q")


@query
def drawdown(spark, d):
    return P.drawdown(_market_path(spark, d)).select("date", "drawdown")


@query
def ou_fit(spark, d):
    rows = W.ou_fit(_resid(spark, d).select("ticker", "date", "resid"))
    return rows.where(F.col("half_life").isNotNull()).select("ticker", "date", S.ou_weight(F.col("half_life")).alias("weight"), "distance")


@query
def ou_score(spark, d):
    return W.ou_score(W.volume_normalised(_resid(spark, d)))


# -- regressions

def _beta_rows(spark, d):
    return R.weights(W.ewma_beta(panels.returns(spark, d)))


@query
def wls_step_lambda(spark, d):
    return R.factor_step(_beta_rows(spark, d), "ret", "beta", MIN_NAMES)[1]


@query
def wls_step_resid(spark, d):
    return R.factor_step(_beta_rows(spark, d), "ret", "beta", MIN_NAMES)[0]


@query
def variance_reduction(spark, d):
    rows = steps.checkpointed(_beta_rows(spark, d).select("date", "ticker", "ret", "beta", "w"))
    after = R.factor_step(rows, "ret", "beta", MIN_NAMES)[0]
    before = rows.join(after.select("date", "ticker"), ["date", "ticker"]).select(F.lit("raw").alias("step"), F.col("ret").alias("x"))
    return I.pooled_variance(before.unionByName(after.select(F.lit("beta").alias("step"), F.col("resid").alias("x"))), "x", ("step",))


@query
def daily_r2(spark, d):
    rows = _beta_rows(spark, d)
    return I.daily_r2(rows.select("date", "ticker", F.col("ret").alias("raw")), R.factor_step(rows, "ret", "beta", MIN_NAMES)[0])


def _sized(spark, d, without_beta=False):
    rows = _beta_rows(spark, d).withColumn("s", S.log_cap(F.col("cap"))).withColumn("w0", F.greatest(F.ln(F.greatest(F.coalesce("cap", F.lit(1.0)), F.lit(1.0))), F.lit(0.0)))
    rows = X.zscore(rows, "s", "size")
    return rows if without_beta else rows.where(F.col("beta").isNotNull())


@query
def orthogonalize_1(spark, d):
    return R.orthogonalised(_sized(spark, d), "size", "beta", MIN_NAMES).select("ticker", "date", "perp")


@query
def orthogonalize_k(spark, d):
    rows = W.price_momentum(P.forward_fill(panels.dense(spark, d), "close"), 4, 26).select("ticker", "date", "mom121")
    perp = G.orthogonalised_by(_sized(spark, d).join(rows, ["ticker", "date"], "left"), ["mom121"], ["beta", "size"], MIN_NAMES)
    return perp.select("ticker", "date", F.col("mom121").alias("perp")).where(F.col("perp").isNotNull())


@query
def ridge_cv_step(spark, d):
    rows = steps.checkpointed(R.weights(_sized(spark, d)).select("date", "ticker", "ret", "beta", "size", "w"))
    resid, fits = G.ridge_path_step(rows, "ret", ["beta", "size"], MIN_NAMES, grid=(0.0, 0.01, 0.1, 0.5, 1.0, 2.0), hold=steps.checkpointed)
    return resid.join(fits.select("date", "intercept", "r2", "ridge"), "date").select("ticker", "date", "resid", "intercept", "r2", "ridge")


def _lambdas(spark, d):
    return R.factor_step(_beta_rows(spark, d), "ret", "beta", MIN_NAMES)[1].withColumn("factor", F.lit("beta"))


@query
def factor_chain(spark, d):
    """Three steps: beta on returns, then size and the momentum of what is left, each orthogonal to those before, on what is left."""
    rows = steps.checkpointed(_sized(spark, d).select("date", "ticker", "ret", "beta", "size", "w", "w0"))
    one, l1 = R.factor_step(rows, "ret", "beta", MIN_NAMES)
    two_rows = R.orthogonalised(rows, "size", "beta", MIN_NAMES).select("date", "ticker", "perp", "w").join(one, ["date", "ticker"])
    two, l2 = R.factor_step(two_rows, "resid", "perp", MIN_NAMES)
    two = steps.checkpointed(two)
    perp = G.orthogonalised_by(rows.join(steps.momentum(two), ["date", "ticker"]), ["momentum"], ["beta", "size"], MIN_NAMES).withColumnRenamed("momentum", "perp")
    l3 = R.factor_step(perp.join(rows.select("date", "ticker", "w"), ["date", "ticker"]).join(two, ["date", "ticker"]), "resid", "perp", MIN_NAMES)[1]
    named = (part.withColumn("factor", F.lit(factor)) for part, factor in ((l1, "beta"), (l2, "size"), (l3, "momentum")))
    return functools.reduce(DataFrame.unionByName, named)


@query
def lambda_stats(spark, d):
    return I.lambda_stats(_lambdas(spark, d))


@query
def lambda_annual(spark, d):
    return _lambdas(spark, d).groupBy("factor", F.year("date").alias("year")).agg(F.avg("slope").alias("mean"), I.t_statistic("slope").alias("t"), I.positive_share("slope").alias("positive"))


@query
def cumulative_lambda(spark, d):
    return W.cumulative(_lambdas(spark, d)).select("date", "cumulative")


@query
def rolling_tstat(spark, d):
    return W.rolling_t(_lambdas(spark, d), 52).where(F.col("t").isNotNull()).select("date", "t")


# -- signals

def _signal(spark, d):
    fwd = I.compounded_forward(panels.returns(spark, d), HORIZON).select("ticker", "date", F.round("fwd", 9).alias("fwd"))
    return _disc(spark, d).join(fwd, ["ticker", "date"])


@query
def resid_fwd_compound(spark, d):
    return I.compounded_forward(panels.returns(spark, d), HORIZON).where(F.col("fwd").isNotNull()).select("ticker", "date", "fwd")


@query
def resid_beta_sector(spark, d):
    rows = P.forward_returns(panels.sectored(spark, d), HORIZON)
    return I.sector_beta_residual(rows).where(F.col("resid").isNotNull()).select("ticker", "date", "beta63", "resid")


@query
def ic_within_sector(spark, d):
    return I.sector_ic(_signal(spark, d), "x", "fwd", least=5)


@query
def ic_summary(spark, d):
    return I.ic_summary(I.sector_ic(_signal(spark, d), "x", "fwd", least=5).withColumn("metric", F.lit("x")), ("metric",))


@query
def ic_annual(spark, d):
    return I.ic_summary(I.sector_ic(_signal(spark, d), "x", "fwd", least=5).withColumn("year", F.year("date")), ("year",))


@query
def rank_ic(spark, d):
    return I.rank_ic(_signal(spark, d), "x", "fwd")


@query
def rolling_ic(spark, d):
    return I.rolling_ic(I.rank_ic(_signal(spark, d), "x", "fwd"), 52, HORIZON)


def _spreads(spark, d):
    rows = _signal(spark, d).withColumns({"tax": F.round("tax", 9), "ahead": F.round(F.col("fwd") + F.col("x"), 9)}).unpivot(["ticker", "date", "fwd"], ["x", "tax", "returned", "volume", "ahead"], "metric", "value")
    return I.decile_spread(rows, "value", "fwd", keys=("date", "metric"))


@query
def decile_spread(spark, d):
    return _spreads(spark, d)


@query
def metric_weights(spark, d):
    return I.metric_weights(_spreads(spark, d).withColumn("horizon", F.lit(HORIZON)))


# -- fundamentals

def _wanted(spark, d):
    dates = spark.sql("SELECT explode(sequence(date'1994-01-01', date'1997-01-01', interval 6 months)) AS date")
    return panels.sectors(spark, d).select("ticker").crossJoin(dates).withColumn("feq", F.year("date") * 4 + F.quarter("date") - 1)


@query
def latest_version(spark, d):
    return P.latest_version(panels.facts(spark, d), ["ticker", "period", "metric"], "value", "download", F.lit("1996-01-01").cast("date"))


@query
def quarters_8_back(spark, d):
    return Q.eight_back(panels.facts(spark, d), _wanted(spark, d), "revenue").select("ticker", "date", "k", "value")


@query
def quarters_4_forward(spark, d):
    return Q.four_forward(panels.facts(spark, d), _wanted(spark, d), "revenue").select("ticker", "date", "k", "value")


@query
def gs_blended(spark, d):
    return Q.blended_growth(panels.facts(spark, d), _wanted(spark, d), "revenue").select("ticker", "date", "actual", "forward", "n_forward", "gs")


@query
def feq_estimate(spark, d):
    status = panels.sectors(spark, d).select("ticker", F.lit(1997 * 4).alias("feq"), F.lit("1997-01-15").cast("date").alias("checked"))
    return Q.first_estimated(panels.facts(spark, d), status, _wanted(spark, d), "revenue")


# -- portfolios

def _rebalance(spark, d):
    dates = tables.table(spark, d, "lineitem").join(panels.sectors(spark, d), F.col("l_suppkey").cast("string") == F.col("ticker"), "left_semi")
    return P.rebalance_calendar(P.calendar(dates.select(F.date_trunc("week", "l_shipdate").cast("date").alias("date"))), "1993-01-10", 60)


def _scores(spark, d):
    rows = _disc(spark, d).withColumn("score", F.col("x"))
    return rows.join(F.broadcast(_rebalance(spark, d)), "date").select("ticker", "date", "sector", "score")


@query
def prefilter_topk(spark, d):
    return B.prefiltered(_scores(spark, d), 10, 0.4).select("ticker", "date", "rank")


@query
def sector_cap_select(spark, d):
    return B.sector_capped(_scores(spark, d), 20, 3).select("ticker", "date", "rank")


@query
def concentration_weights(spark, d):
    return B.concentrated(B.ranked(_scores(spark, d)).where("rank <= 20"), 2.0).select("ticker", "date", "weight")


def _nav(spark, d):
    held = B.concentrated(B.sector_capped(_scores(spark, d), 20, 3))
    return B.nav(held.select("date", "ticker", "weight"), P.forward_fill(panels.dense(spark, d), "close").select("date", "ticker", "close"))


@query
def backtest_nav(spark, d):
    return _nav(spark, d)


def _factors(spark, d):
    """Scores with capitalisation, volatility and momentum of the date."""
    filled = P.forward_fill(panels.returns(spark, d), "close")
    rows = W.price_momentum(W.realised_vol(filled), 4, 26).select("ticker", "date", "close", "cap", "rvol", F.col("mom121").alias("momentum"))
    rows = steps.checkpointed(rows)  # the prices are read once for each of the paths' steps
    decided = rows.drop("close").join(F.broadcast(_rebalance(spark, d)), "date")
    return _scores(spark, d).withColumnRenamed("score", "factor").join(decided, ["ticker", "date"], "left"), rows.select("date", "ticker", "close")


def _backtest(spark, d, config, only=None, start=None):
    factors, prices = _factors(spark, d)
    return T.backtest(factors if only is None else factors.where(only), _rebalance(spark, d), prices, config, start)


@query
def backtest_blended(spark, d):
    """All options: cap floor, volatility filter, prefilter, momentum, sector cap, concentration."""
    return _backtest(spark, d, T.Config(20, cap_floor=1500.0, vol_quantile=0.8, prefilter=0.6, momentum_weight=0.5, sector_cap=5, concentration=2.0))


@query
def backtest_skips(spark, d):
    """Dates with too few large names hold nothing; dates without factors buy the last names again."""
    return _backtest(spark, d, T.Config(20, cap_floor=3000.0), "month(date) NOT IN (3, 4)", "1992-12-31")


@query
def performance_stats(spark, d):
    return B.performance(_nav(spark, d), 52)


@query
def holdings_matrix(spark, d):
    return B.holdings_matrix(B.ranked(_scores(spark, d)), 5)


@query
def events_by_day(spark, d):
    return windowed_events(tables.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"))


# -- reports and the whole model

def _sector_names(spark, d):
    return sorted(r["sector"] for r in panels.sectors(spark, d).select("sector").distinct().collect())  # a handful


def _weekly_scores(spark, d):
    """Weekly rows with quality, value and si, which rank the names traded in a week among each other, dealt by date."""
    rows = panels.weekly(spark, d, lambda lines: X.dealt(lines, ("date",)))
    # a row a name, of two short columns; ranks of quality and value are those of names with a sector
    rows = rows.join(F.broadcast(panels.sectors(spark, d)), "ticker", "left").select("*", *panels.interest())
    own = F.col("date").isNotNull() & F.col("ticker").isNotNull()
    rows = rows.withColumns({"own": own, "placed": own & F.col("sector").isNotNull(), "x": F.round("disc", 9), "tax9": F.round("tax", 9), "returned": F.round("returned", 9)}).withColumn("__v", F.round(F.col("x") - 0.05, 9))
    of_sector = ("date", "placed", "sector")
    for c in ("x", "tax9", "returned"):
        rows = X.rank01(rows, c, f"r_{c}", of_sector, least=3)
    rows = X.weighted_composite(rows, {"r_x": 0.5, "r_tax9": 0.3, "r_returned": 0.2}, "quality")
    rows = X.rank01(X.reflected_value(rows, "__v", "__v", of_sector), "__v", "value", of_sector, least=3)
    rows = X.si_composite(rows, MIN_NAMES, ("date", "own"))
    flags = {"quality": "placed", "value": "placed", "si": "own"}
    return rows.select("ticker", "date", "disc", "amount", "tax", *(F.when(F.col(flag), F.col(c)).alias(c) for c, flag in flags.items()))


#: Names a task of the dense panel: its sorts hold all of a task's rows, and with more of them would spill.
NAMES_A_TASK = 2000


def _model_rows(spark, d):
    """All characteristics, from one pass by date over the weeks traded and one by ticker over the dense panel, where the rows stay; a gap counts in none of a week's ranks."""
    o = tables.table(spark, d, "orders").groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("date")).agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("orders"))
    series = o.unpivot(["date"], ["price", "orders"], "series", "level")
    series = series.withColumn("value", F.col("level") / F.lag("level").over(Window.partitionBy("series").orderBy("date")) - 1).where(F.col("value").isNotNull()).select("date", "series", "value")
    tasks = -(-tables.table(spark, d, "supplier").count() // NAMES_A_TASK)
    tasks = tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None
    scores = _weekly_scores(spark, d).repartition(*([tasks] if tasks else []), "ticker")
    rows = W.wide_macro_betas(W.ewma_beta(panels.returns(spark, d, scores)), series, {"price": "__price", "orders": "__orders"})
    rows = W.garman_klass(panels.ranges(rows)).join(F.broadcast(panels.sectors(spark, d)), "ticker", "left")
    # the dates with betas: with the dense panel, all names have one or none has
    rows = rows.where(F.col("beta").isNotNull()).select("ticker", "date", "ret", "cap", "beta", "__price", "__orders", F.col("gk").alias("__gk"), "quality", "value", "si", "sector")
    rows = R.weights(tables.held_by(rows, "ticker", "date", tasks=tasks)).withColumn("w0", S.log_cap(F.col("cap"))).withColumn("__s", F.col("w0"))
    rows = X.zscores_held(rows, {"__s": "size", "__price": "macro_price", "__orders": "macro_orders", "__gk": "gk"}, steps.checkpointed)
    names = _sector_names(spark, d)
    rows = X.sector_dummies(rows, names).withColumns({f"sector{k}": F.when(F.col("sector").isNotNull(), F.col("x")[k]) for k in range(len(names))})
    return rows.select("ticker", "date", "ret", "w", "w0", "beta", "size", *steps.sector_columns(len(names)), "macro_price", "macro_orders", "quality", "value", "si", "gk")


def _chain(spark, d, version):
    return steps.run_with_moments(_model_rows(spark, d), version(len(_sector_names(spark, d))), MIN_NAMES, held=True)


@query
def factor_chain_v1(spark, d):
    return _chain(spark, d, steps.version1)[0]


@query
def factor_chain_v2(spark, d):
    return _chain(spark, d, steps.version2)[0]


@query
def variance_table(spark, d):
    """Out of the moments that the fits give, without the residuals themselves."""
    return N.variance_of_moments(_chain(spark, d, steps.version1)[2])


@query
def consolidated_intercept(spark, d):
    return N.consolidated_intercept(_chain(spark, d, steps.version1)[0])


@query
def last_lambdas(spark, d):
    return N.last_lambdas(_lambdas(spark, d))


@query
def universe_filter(spark, d):
    rows = panels.prices(spark, d)
    return N.universe(rows, panels.sectors(spark, d), panels.facts(spark, d).select("ticker").distinct(), "1998-01-05", 252, 200)


@query
def vol_comparison(spark, d):
    return N.vol_comparison(W.close_vol(panels.returns(spark, d)).select("date", "ticker", "vol").join(W.garman_klass(panels.ohlc(spark, d)).select("date", "ticker", "gk"), ["date", "ticker"]))


@query
def capw_mean(spark, d):
    rows = _disc(spark, d).withColumn("cap", F.col("volume"))
    return N.cap_weighted(rows, "x")


@query
def harmonic_multiple(spark, d):
    return N.harmonic_multiple(_disc(spark, d).withColumn("cap", F.col("volume")), "x")


@query
def factor_return_ls(spark, d):
    return N.long_short(X.percent_rank(_signal(spark, d), "x", "r"), "r", "fwd")


@query
def residualized(spark, d):
    return R.residualised(_signal(spark, d).where(F.col("fwd").isNotNull()), "fwd", "x", "resid").where(F.col("resid").isNotNull()).select("ticker", "date", "resid")


@query
def common_dates(spark, d):
    return N.common_dates(panels.weekly(spark, d), tables.table(spark, d, "orders").select(F.date_trunc("week", "o_orderdate").cast("date").alias("date")))


@query
def sector_spread(spark, d):
    rows = panels.sectored(spark, d).groupBy("date", F.col("sector").alias("factor")).agg(F.avg("ret").alias("slope"))
    return N.sector_spread(rows)


@query
def grid_search(spark, d):
    return W.rate_grid(_market_path(spark, d).select("date", (F.col("nav") * 100).alias("value")), (26, 52, 104), (0.25, 0.5, 1.0)).groupBy("window", "threshold").agg(F.avg("q").alias("mean_q"), F.count_if(F.col("q") == 1).alias("high"), F.count_if(F.col("q") == 0).alias("low"))


@query
def outlier_repair(spark, d):
    return W.repaired(panels.weekly(spark, d).select("ticker", "date", F.col("amount").alias("value")))

"""Registered studies, summaries and look-ups beside those of plans/queries.py; importing this module registers them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from crossweave.functions import scalar as S
from crossweave.operators import fundamentals as Q
from crossweave.operators import panel as P
from crossweave.operators import regress as R
from crossweave.operators import reports as N
from crossweave.operators import signals as I
from crossweave.operators import studies as T
from crossweave.operators import timeseries as W
from crossweave.operators import xsection as X
from crossweave.plans import panels, steps
from crossweave.plans.queries import HORIZON, MIN_NAMES, _disc, _lambdas, _market_path, _scores, _sized, _wanted, query
from crossweave.sources import store, tables

FAR = 2 * HORIZON


def _filled(spark, d):
    return P.forward_fill(panels.dense(spark, d), "close")


def _anchors(spark, d):
    return spark.sql("SELECT explode(sequence(date'1993-01-15', date'1997-01-15', interval 3 months)) AS date")


# -- look-ups and joins

@query
def concat_outer(spark, d):
    rows = panels.weekly(spark, d)
    parts = {"disc": rows.where("disc > 0.0501234").withColumn("v", F.col("disc")), "tax": rows.where("tax > 0.0401234").withColumn("v", F.col("tax"))}
    return T.outer_joined(parts, ["ticker", "date"], "v")


@query
def dates_union(spark, d):
    orders = tables.table(spark, d, "orders").select(F.date_trunc("week", "o_orderdate").cast("date").alias("date"))
    return T.all_dates(panels.weekly(spark, d), orders)


@query
def anchor_price(spark, d):
    return T.next_price(panels.prices(spark, d), _anchors(spark, d))


@query
def fwd_anchor(spark, d):
    return T.anchored_forward(_filled(spark, d), _anchors(spark, d), HORIZON)


@query
def snapshot_first(spark, d):
    """Of each ticker and asked date, the row of the greatest amount."""
    rows = panels.weekly(spark, d).withColumn("quarter", F.date_trunc("quarter", "date").cast("date"))
    return tables.first_of(rows.where(F.col("ticker").isNotNull()), ["ticker", "quarter"], F.desc("amount"), "date").select("ticker", "quarter", "date", "amount")


@query
def align_tables(spark, d):
    rows = panels.weekly(spark, d)
    part = lambda column, kept: rows.where(kept).select("date", "ticker", F.col(column).alias("value"))
    out = store.aligned(part("raw_px", "disc > 0.0201234"), part("amount", "tax > 0.0101234"), part("volume", "true"), part("tax", "returned > 0"))
    return out.select("ticker", "date", "close", "high", "low")


@query
def macro_pick(spark, d):
    o = tables.table(spark, d, "orders").groupBy(F.date_trunc("week", "o_orderdate").cast("date").alias("date")).agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("orders"))
    return store.picked_series(o.unpivot(["date"], ["price", "orders"], "series", "value"), ["orders"])


@query
def lookback_start(spark, d):
    return N.dates_before(panels.weekly(spark, d), "1995-03-01", 60)


@query
def last_days_resid(spark, d):
    return N.last_days(panels.returns(spark, d).where(F.col("ret").isNotNull()), 100).select("ticker", "date", (F.col("ret") - F.col("mkt")).alias("resid"))


@query
def wide_view(spark, d):
    names = [str(k) for k in range(1, 6)]
    rows = panels.prices(spark, d).where(F.col("ticker").isin(*names))
    return N.to_wide(rows, "close", names).select("date", *(F.col(n).alias(f"t{n}") for n in names))


@query
def duplicate_keys(spark, d):
    rows = tables.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_shipdate").cast("date").alias("date"))
    return N.duplicate_keys(rows, "supplier", "date").withColumnRenamed("count", "n")


# -- summaries

@query
def r2_stats(spark, d):
    return T.described(_lambdas(spark, d), "r2")


@query
def intercept_summary(spark, d):
    return N.intercept_summary(_lambdas(spark, d))


@query
def sector_lambdas(spark, d):
    rows = panels.sectored(spark, d).groupBy("date", F.col("sector").alias("factor")).agg(F.avg("ret").alias("slope"))
    return I.lambda_stats(rows).select("factor", "n", "mean", "std", "t", "positive")


@query
def rolling_r2(spark, d):
    return T.rolling_mean(_lambdas(spark, d), "r2").where(F.col("rolling").isNotNull()).select("date", "rolling")


@query
def years_out(spark, d):
    return T.in_years(_lambdas(spark, d), [1993, 1995], inside=False).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"), F.avg("slope").alias("mean"))


@query
def names_held(spark, d):
    return _scores(spark, d).where(F.col("score") > 0.05).groupBy("date").agg(F.count_distinct("ticker").alias("names"), F.count_distinct("sector").alias("sectors"))


# -- scores

WEIGHTS = {"x": 2.5, "tax": 1.5, "not_there": 1.0}


def _values(spark, d):
    rows = _disc(spark, d).withColumns({"x": F.round(F.col("x") - 0.05, 9), "tax": F.round("tax", 9)})
    return T.value_composite(rows, WEIGHTS)


@query
def value_composite(spark, d):
    return _values(spark, d).where(F.col("value").isNotNull()).select("ticker", "date", "value")


@query
def scores_asof(spark, d):
    rows = panels.weekly(spark, d).where(F.month("date").isin(2, 8)).select("ticker", "date", F.round("disc", 9).alias("score"))
    wanted = panels.sectors(spark, d).select("ticker").crossJoin(F.broadcast(_anchors(spark, d)))
    return T.scores_at(rows, wanted, "score", backfill=True)


@query
def derived_metrics(spark, d):
    rows = _disc(spark, d).withColumn("r2", F.col("returned"))
    return N.derived_metrics(rows, {"by_vol": ("x", "vol", "volume"), "by_r2": ("x", "r2", "r2"), "absent": ("x", "vol", "nothing")}).select("ticker", "date", "by_vol", "by_r2", "absent")


@query
def regime_composite(spark, d):
    """Growth and conservative scores, blended by the regime of the market's path."""
    regime = W.rate_regime(_market_path(spark, d).select("date", (F.col("nav") * 100).alias("value")), threshold=0.5).select("date", "q")
    rows = X.rank01(X.rank01(_disc(spark, d).withColumn("tax", F.round("tax", 9)), "x", "growth", ("date", "sector"), least=3), "tax", "safe", ("date", "sector"), least=3)
    return N.regime_composite(rows.join(F.broadcast(regime), "date"), "growth", "safe", "q").where(F.col("score").isNotNull()).select("ticker", "date", "score")


@query
def ic_weighted(spark, d):
    return N.ic_weighted(_disc(spark, d), {"x": 0.06, "tax": -0.03, "returned": 0.01}).select("ticker", "date", "score")


@query
def momentum_rebalance(spark, d):
    """Price momentum at rebalance dates, as z-scores of dates with five names or more."""
    rows = W.price_momentum(_filled(spark, d), 4, 26).join(F.broadcast(P.rebalance_calendar(P.calendar(_disc(spark, d)), "1993-01-10", 60)), "date")
    return T.scored_momentum(rows, "mom121")


@query
def top_names(spark, d):
    rows = _scores(spark, d)
    return T.top_names(rows, "1995-06-30", 10, ["sector", "score"])


# -- studies over metrics and horizons

def _study(spark, d):
    rows = panels.returns(spark, d)
    ahead = I.compounded_forward(I.compounded_forward(rows, HORIZON).withColumnRenamed("fwd", "near"), FAR).select("ticker", "date", F.round("near", 9).alias("near"), F.round("fwd", 9).alias("far"))
    return _disc(spark, d).withColumn("tax", F.round("tax", 9)).join(ahead, ["ticker", "date"])


@query
def ic_study(spark, d):
    return T.study_summary(T.ic_study(_study(spark, d), ["x", "tax"], {HORIZON: "near", FAR: "far"}, 5))


@query
def ic_study_annual(spark, d):
    ics = T.ic_study(_study(spark, d), ["x", "tax"], {HORIZON: "near", FAR: "far"}, 5)
    return I.ic_summary(ics.withColumn("year", F.year("date")), ("metric", "horizon", "year"))


@query
def spread_study(spark, d):
    return T.spread_study(_study(spark, d), ["x", "tax", "returned"], {HORIZON: "near", FAR: "far"})


# -- fundamentals

@query
def growth_components(spark, d):
    """The pairs of quarters a year apart behind the blended growth."""
    facts, wanted = panels.facts(spark, d), _wanted(spark, d)
    back = Q.eight_back(facts, wanted, "revenue").select("ticker", "date", "k", "value")
    old = back.select("ticker", "date", (F.col("k") + 4).alias("k"), F.col("value").alias("before"))
    pairs = back.where("k >= -4").unionByName(Q.four_forward(facts, wanted, "revenue").select("ticker", "date", "k", "value")).join(old, ["ticker", "date", "k"])
    return pairs.select("ticker", "date", "k", (S.symmetric_growth(F.col("value"), F.col("before")) * 100).alias("growth")).where(F.col("growth").isNotNull())


@query
def pit_metrics(spark, d):
    wanted = _wanted(spark, d)
    at = P.asof_backward(wanted.select("ticker", "date"), _filled(spark, d).where(F.col("close").isNotNull()).select("ticker", "date", "close"), ["close"])
    out = Q.point_in_time_metrics(panels.facts(spark, d), wanted, at.where(F.col("close").isNotNull()), "revenue", "profit", "profit")
    return out.select("ticker", "date", (F.col("cap") / 1e6).alias("cap"), "gs", "gs_vol", (F.col("pe") / 100).alias("pe"))


@query
def ltm_ntm(spark, d):
    facts, wanted = panels.facts(spark, d), _wanted(spark, d)
    last = T.window_sums(facts, wanted, "revenue", -4, -1, False, 4).withColumnRenamed("total", "last")
    following = T.window_sums(facts, wanted, "revenue", 0, 3, True, 1).withColumnRenamed("total", "following")
    return last.join(following, ["ticker", "date"]).where(F.col("last").isNotNull()).select("ticker", "date", (F.col("last") / 1e6).alias("last"), (F.col("following") / 1e6).alias("following"))


@query
def feq_recent(spark, d):
    return T.last_changed_quarter(panels.facts(spark, d), _wanted(spark, d), "revenue")


@query
def capw_mean_clipped(spark, d):
    return T.capped_mean(_disc(spark, d), "x", "volume")


@query
def moved_caps(spark, d):
    sizes = panels.weekly(spark, d).where("date < date'1996-06-01'").select("ticker", "date", (F.col("amount") / 1000).alias("size"))
    return T.moved_caps(sizes, panels.prices(spark, d))


# -- risk

@query
def portfolio_risk(spark, d):
    """Factor and own risk of an equally weighted book of the last date's names, from the returns of the market and the size step."""
    everyone = steps.checkpointed(_sized(spark, d, without_beta=True).select("date", "ticker", "ret", "beta", "size", "w", "w0"))
    sized = everyone.where(F.col("beta").isNotNull())
    rows = N.last_dates(sized, 1)
    n = F.count("*").over(Window.partitionBy("date"))
    held = rows.select("ticker", (1 / n).alias("weight"), "beta", "size").unpivot(["ticker", "weight"], ["beta", "size"], "factor", "x")
    left, lambdas = R.factor_step(sized, "ret", "beta", MIN_NAMES)
    beta = lambdas.select("date", F.lit("beta").alias("factor"), "slope")
    size = R.factor_step(R.orthogonalised(sized, "size", "beta", MIN_NAMES).select("date", "ticker", "perp", "w").join(left, ["date", "ticker"]), "resid", "perp", MIN_NAMES)[1]
    other = size.select("date", F.lit("size").alias("factor"), "slope")
    own = everyone.groupBy("ticker").agg(F.var_samp("ret").alias("variance")).where(F.col("variance").isNotNull())
    return N.portfolio_risk(held, beta.unionByName(other), own, 52)

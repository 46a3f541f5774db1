"""Time-series characteristics over dense panels: weights decline by half-life, windows end strictly before the row's date."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossweave.functions.scalar import clip, log_return, zero_to_null

BETA_WINDOW, BETA_HALF_LIFE = 252, 126
VOL_WINDOW, VOL_HALF_LIFE = 84, 42
MOM_LONG, MOM_SKIP = 252, 21


def _rows(a: int, b: int, keys: tuple[str, ...] = ("ticker",)) -> Window:
    return Window.partitionBy(*keys).orderBy("date").rowsBetween(a, b)


def trailing(df: DataFrame, terms: dict[str, Column], far: int, near: int, keys: tuple[str, ...] = ("ticker",), counted: Sequence[str] = ()) -> DataFrame:
    """Adds each term's sum over the rows from `far` to `near` back, 0 where none of them is known, or NULL for the `counted` terms.

    Spark goes through a sliding frame anew for every row; the difference of two running sums costs the same whatever the window.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({f"__t_{k}": x for k, x in terms.items()})
    sums = [F.sum(F.coalesce(F.col(f"__t_{k}"), F.lit(0.0))).over(so_far).alias(k) for k in terms]
    rows = rows.withColumn("__upto", F.struct(*sums, *(F.count(f"__t_{k}").over(so_far).alias(f"n_{k}") for k in counted)))
    rows = rows.withColumns({"__late": F.lag("__upto", near).over(w) if near else F.col("__upto"), "__early": F.lag("__upto", far + 1).over(w)})
    between = lambda c, none: F.col(f"__late.{c}") - F.coalesce(F.col(f"__early.{c}"), F.lit(none))
    rows = rows.withColumns({k: F.when(between(f"n_{k}", 0) > 0, between(k, 0.0)) if k in counted else between(k, 0.0) for k in terms})
    return rows.drop("__upto", "__late", "__early", *(f"__t_{k}" for k in terms))


def _place(keys: tuple[str, ...] = ("ticker",)) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy("date"))


def _weight(half_life: float) -> Column:
    """exp(i * ln 2 / half-life): only ratios of weights count, so the position in the calendar stands for the age."""
    return F.exp(F.col("i") * (math.log(2) / half_life))


def ewma_beta(panel: DataFrame, window: int = BETA_WINDOW, half_life: float = BETA_HALF_LIFE, y: str = "ret", x: str = "mkt", keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Adds beta of y on x from weighted moments. A date without x is out; a missing y counts as 0; at least half a window of dates."""
    g = F.when(F.col(x).isNotNull(), _weight(half_life))
    yy = F.coalesce(F.col(y), F.lit(0.0))
    terms = {"__g": g, "__gx": g * F.col(x), "__gy": g * yy, "__gxy": g * F.col(x) * yy, "__gxx": g * F.col(x) * F.col(x)}
    sums = trailing(panel, terms, window, 1, keys, ["__g"]).withColumn("__n", F.least(_place(keys) - 1, F.lit(window)))
    mx, my = F.col("__gx") / F.col("__g"), F.col("__gy") / F.col("__g")
    var = F.col("__gxx") / F.col("__g") - mx * mx
    beta = (F.col("__gxy") / F.col("__g") - mx * my) / var
    return sums.withColumn("beta", F.when((F.col("__n") >= window // 2) & (var > 1e-18), beta)).drop(*terms, "__n")


def macro_betas(returns: DataFrame, series: DataFrame, window: int = BETA_WINDOW, half_life: float = BETA_HALF_LIFE) -> DataFrame:
    """(ticker, date, series, beta, z): ewma_beta on each series (date, series, value) alone; a missing value counts as 0.

    The series stand beside the calendar as columns, so that one window by ticker gives the moments of all of them.
    """
    from crossweave.operators.xsection import zscore

    names = sorted(r["series"] for r in series.select("series").distinct().collect())  # a handful, as wide as the result is long
    wide = wide_macro_betas(returns.select("ticker", "date", "i", "ret"), series, dict(zip(names, map("__b{}".format, range(len(names))), strict=True)), window, half_life)
    each = (F.struct(F.lit(name).alias("series"), F.col(f"__b{k}").alias("beta")) for k, name in enumerate(names))
    long = wide.select("ticker", "date", F.inline(F.array(*each))).where(F.col("beta").isNotNull())
    return zscore(long, "beta", "z", keys=("date", "series"))


def wide_macro_betas(returns: DataFrame, series: DataFrame, columns: dict[str, str], window: int = BETA_WINDOW, half_life: float = BETA_HALF_LIFE) -> DataFrame:
    """Adds to the returns a column of betas for each named series; columns: series to column."""
    names = list(columns)
    wide = series.groupBy("date").pivot("series", names).agg(F.first("value")).toDF("date", *(f"__x{k}" for k in range(len(names))))
    g, yy = _weight(half_life), F.coalesce(F.col("ret"), F.lit(0.0))
    terms = {"__g": g, "__gy": g * yy}
    for k in range(len(names)):
        x = F.coalesce(F.col(f"__x{k}"), F.lit(0.0))
        terms |= {f"__gx{k}": g * x, f"__gxy{k}": g * x * yy, f"__gxx{k}": g * x * x}
    # a row a date
    sums = trailing(returns.join(F.broadcast(wide), "date", "left"), terms, window, 1).withColumn("__n", F.least(_place() - 1, F.lit(window)))
    betas = {}
    for k, name in enumerate(names):
        mx, my = F.col(f"__gx{k}") / F.col("__g"), F.col("__gy") / F.col("__g")
        var = F.col(f"__gxx{k}") / F.col("__g") - mx * mx
        betas[columns[name]] = F.when((F.col("__n") >= window // 2) & (var > 1e-18), (F.col(f"__gxy{k}") / F.col("__g") - mx * my) / var)
    return sums.withColumns(betas).drop(*terms, "__n", *(f"__x{k}" for k in range(len(names))))


def close_vol(panel: DataFrame, window: int = VOL_WINDOW, half_life: float = VOL_HALF_LIFE, periods: int = 252) -> DataFrame:
    """Adds vol: root of the annualised weighted mean of squared returns inside the window, whose first price has no return."""
    g = F.when(F.col("ret").isNotNull(), _weight(half_life))
    rows = trailing(panel, {"__g": g, "__s": g * F.col("ret") * F.col("ret")}, window - 1, 1, counted=["__g"])
    return rows.withColumn("vol", F.when(F.col("__g").isNotNull(), F.sqrt(periods * F.greatest("__s", F.lit(0.0)) / F.col("__g")))).drop("__g", "__s")


def garman_klass(ohlc: DataFrame, window: int = VOL_WINDOW, half_life: float = VOL_HALF_LIFE, periods: int = 252) -> DataFrame:
    """Adds gk: from open, high, low and close; a day that is not valid counts with weight but without value."""
    valid = (F.col("open") > 0) & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0) & (F.col("high") >= F.col("low"))
    daily = 0.5 * F.pow(F.ln(F.col("high") / F.col("low")), F.lit(2.0)) - (2 * math.log(2) - 1) * F.pow(F.ln(F.col("close") / F.col("open")), F.lit(2.0))
    rows = trailing(ohlc, {"__w": _weight(half_life), "__s": F.when(valid, _weight(half_life) * F.greatest(daily, F.lit(0.0)))}, window, 1)
    var = F.col("__s") / F.col("__w")
    return rows.withColumn("gk", F.when((_place() > window // 2) & (var > 0), F.sqrt(periods * var))).drop("__w", "__s")


def idio_momentum(residuals: DataFrame, long: int = MOM_LONG, skip: int = MOM_SKIP, value: str = "resid") -> DataFrame:
    """Adds mom: the sum of residuals from `long` to `skip` + 1 rows back; missing ones as 0."""
    rows = trailing(residuals, {"__sum": F.col(value)}, long, skip + 1)
    return rows.withColumn("mom", F.when(_place() >= long + 2, F.coalesce("__sum", F.lit(0.0)))).drop("__sum")


def scaled_idio_momentum(residuals: DataFrame, low: float = 0.5, high: float = 3.0, long: int = MOM_LONG, skip: int = MOM_SKIP) -> DataFrame:
    """idio_momentum of residuals times the clipped volume scalar, where all but ten dates of the window, at least, have a scalar of any name."""
    days = residuals.groupBy("date").agg(F.max(F.col("scalar").isNotNull().cast("int")).alias("__has"))
    days = days.withColumn("__overlap", F.sum("__has").over(Window.orderBy("date").rowsBetween(-long, -skip - 1))).select("date", "__overlap")  # a row a date
    out = idio_momentum(residuals.withColumn("__r", F.col("resid") * clip(F.col("scalar"), low, high)), long, skip, "__r").drop("__r").join(days, "date")
    return out.withColumn("mom", F.when(F.col("__overlap") >= long - skip - 10, F.col("mom"))).drop("__overlap")


def volume_scalar(panel: DataFrame, rows: int = 10, low: float = 0.5, high: float = 3.0) -> DataFrame:
    return panel.withColumn("scalar", clip(F.try_divide("volume", F.nullif(F.avg("volume").over(_rows(-(rows - 1), 0)), F.lit(0.0))), low, high))


def prior_volume_scalar(panel: DataFrame, rows: int = 10, low: float = 0.5, high: float = 3.0) -> DataFrame:
    """Adds scalar: the volume over the mean of the `rows` rows before, clipped; zeros and gaps are filled from before. A name's first `rows` rows have none."""
    w = Window.partitionBy("ticker").orderBy("date")
    filled = panel.withColumn("__v", F.last(zero_to_null(F.col("volume")), ignorenulls=True).over(_rows(Window.unboundedPreceding, 0)))
    share = F.try_divide("__v", zero_to_null(F.avg("__v").over(_rows(-rows, -1))))
    return filled.withColumn("scalar", F.when(F.row_number().over(w) > rows, clip(share, low, high))).drop("__v")


def reversal(panel: DataFrame, rows: int = 21) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date")
    return panel.withColumn("reversal", log_return(F.lag("close", 1).over(w), F.lag("close", rows + 1).over(w)))


def price_momentum(panel: DataFrame, near: int = 21, far: int = 252) -> DataFrame:
    """Adds mom121: the price `near` rows back against that `far` rows back, the row itself included in the count."""
    w = Window.partitionBy("ticker").orderBy("date")
    return panel.withColumn("mom121", F.try_divide(F.lag("close", near).over(w), F.lag("close", far).over(w)) - 1)


def realised_vol(panel: DataFrame, rows: int = 126, periods: int = 252) -> DataFrame:
    """Adds rvol: the annualised deviation of the returns between the last `rows` prices."""
    out = trailing(panel, {"__one": F.when(F.col("ret").isNotNull(), 1.0), "__x": F.col("ret"), "__xx": F.col("ret") * F.col("ret")}, rows - 2, 0)
    square = F.greatest(F.col("__xx") - F.col("__x") * F.col("__x") / F.col("__one"), F.lit(0.0))
    return out.withColumn("rvol", F.when(F.col("__one") > 1, F.sqrt(square / (F.col("__one") - 1))) * math.sqrt(periods)).drop("__one", "__x", "__xx")


def realised_vol_filter(panel: DataFrame, rows: int = 126, quantile: float = 0.8, periods: int = 252) -> DataFrame:
    """Rows whose realised volatility is at most the date's quantile; dates with fewer than 20 rows of history pass."""
    out = realised_vol(panel, rows, periods).withColumn("__n", F.least(_place(), F.lit(rows - 1)))
    out = out.withColumn("__q", F.percentile("rvol", F.lit(quantile)).over(Window.partitionBy("date")))
    return out.where((F.col("__n") < 20) | (F.col("rvol") <= F.col("__q"))).drop("__q", "__n")


def rate_regime(series: DataFrame, window: int = 126, threshold: float = 50.0) -> DataFrame:
    """Adds q to (date, value): 1 above the moving average by more than the threshold, 0 below it by more, 0.5 otherwise."""
    w = Window.orderBy("date").rowsBetween(-(window - 1), 0)  # one series: as many rows as dates
    known = series.where(F.col("value").isNotNull())
    rows = known.withColumn("mav", F.when(F.count("value").over(w) >= window // 2, F.avg("value").over(w)))
    gap = F.col("value") - F.col("mav")
    return rows.withColumn("q", F.when(F.col("mav").isNull(), 0.5).when(gap > threshold, 1.0).when(gap < -threshold, 0.0).otherwise(0.5))


def rate_grid(series: DataFrame, windows: tuple[int, ...], thresholds: tuple[float, ...]) -> DataFrame:
    """(window, threshold, date, q): rate_regime for every pair of parameters, in one plan."""
    levels = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    out = None
    for n in windows:
        rows = rate_regime(series, n).select(F.lit(n).alias("window"), "date", "value", "mav", levels)
        gap = F.col("value") - F.col("mav")
        rows = rows.select("window", "threshold", "date", F.when(F.col("mav").isNull(), 0.5).when(gap > F.col("threshold"), 1.0).when(gap < -F.col("threshold"), 0.0).otherwise(0.5).alias("q"))
        out = rows if out is None else out.unionByName(rows)
    return out


def repaired(series: DataFrame, jump: float = 0.25, rounds: int = 20) -> DataFrame:
    """(ticker, date, value): a value that jumps by more than `jump` and whose successor is closer to the one before it becomes their mean; again until none does.

    One ticker's series is one group: as many rows as dates.
    """

    def run(pdf):
        pdf = pdf.sort_values("date")
        x = pdf["value"].to_numpy(float).copy()
        for _ in range(rounds):
            before, now, after = x[:-2], x[1:-1], x[2:]
            with np.errstate(divide="ignore", invalid="ignore"):
                odd = (np.abs(now / before - 1) > jump) & (np.abs(after - before) < np.abs(after - now))
            if not odd.any():
                break
            k = int(np.argmax(odd)) + 1  # the first; its repair changes what its neighbours see
            x[k] = (x[k - 1] + x[k + 1]) / 2
        return pdf.assign(value=x)

    return series.select("ticker", "date", "value").groupBy("ticker").applyInPandas(run, "ticker string, date date, value double")


def rolling_t(lambdas: DataFrame, window: int = 252, value: str = "slope", keys: tuple[str, ...] = ("factor",)) -> DataFrame:
    """Adds t: mean over standard error of full windows."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-(window - 1), 0)
    t = F.avg(value).over(w) / F.nullif(F.stddev_samp(value).over(w) / math.sqrt(window), F.lit(0.0))
    return lambdas.withColumn("t", F.when(F.count(value).over(w) == window, t))


def cumulative(lambdas: DataFrame, value: str = "slope", keys: tuple[str, ...] = ("factor",)) -> DataFrame:
    return lambdas.withColumn("cumulative", F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def _level_fits(level: DataFrame, pairs: int, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Adds a, b, __syy, __sxy and __m of x on the level before over the last `pairs` rows, from sums that start anew in blocks of so many rows.

    A window is the rest of one block and the start of the next. Sums are of levels less the first of their block, so that no places are lost.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    within = Window.partitionBy(*keys, "__block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = level.withColumn("__block", F.floor((F.col("__place") - 1) / pairs)).withColumn("__c", F.first("x").over(within))
    u, v = F.col("x") - F.col("__c"), F.col("__before") - F.col("__c")
    terms = {"m": F.lit(1.0), "u": u, "v": v, "uu": u * u, "vv": v * v, "uv": u * v}
    rows = rows.withColumn("__p", F.struct("__c", *(F.sum(F.when(v.isNotNull(), x).otherwise(0.0)).over(within).alias(k) for k, x in terms.items())))
    rows = rows.withColumns({"__full": F.last(F.when(F.col("__place") % pairs == 0, F.col("__p")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "__gone": F.lag("__p", pairs).over(w)})
    left = {k: F.col(f"__full.{k}") - F.col(f"__gone.{k}") for k in terms}
    d = F.col("__full.__c") - F.col("__c")
    moved = {"m": left["m"], "u": left["u"] + left["m"] * d, "v": left["v"] + left["m"] * d, "uu": left["uu"] + 2 * d * left["u"] + left["m"] * d * d, "vv": left["vv"] + 2 * d * left["v"] + left["m"] * d * d, "uv": left["uv"] + d * (left["u"] + left["v"]) + left["m"] * d * d}
    rows = rows.withColumns({f"__{k}": F.col(f"__p.{k}") + F.coalesce(x, F.lit(0.0)) for k, x in moved.items()})
    m = F.nullif("__m", F.lit(0.0))
    sxx = F.col("__vv") - F.col("__v") * F.col("__v") / m
    rows = rows.withColumns({"__sxx": F.when(sxx > 1e-13 * (F.col("__vv") + F.coalesce("__full.vv", F.lit(0.0))), sxx), "__syy": F.col("__uu") - F.col("__u") * F.col("__u") / m, "__sxy": F.col("__uv") - F.col("__u") * F.col("__v") / m})
    rows = rows.withColumn("b", F.col("__sxy") / F.nullif("__sxx", F.lit(0.0)))
    rows = rows.withColumn("a", F.col("__c") + F.col("__u") / m - F.col("b") * (F.col("__c") + F.col("__v") / m))
    return rows.drop("__block", "__c", "__p", "__full", "__gone", "__u", "__v", "__uu", "__vv", "__uv", "__sxx")


def ou_fit(residuals: DataFrame, window: int = 60, least: int = 30, inclusive: bool = False, keep: bool = False) -> DataFrame:
    """Adds a, b, half_life and distance of an Ornstein-Uhlenbeck process fitted to the last `window` residuals before each row, or with it if `inclusive`.

    The level is the compounded residual; its regression on the level before gives b between 0 and 1, the half-life, the mean it reverts to,
    and how many stationary deviations the level is from it. All are scale-free, so the level starts anew in no window.
    Rows without a residual above -1 don't count and are left out; keep: they stay, without a fit, and `fitted` tells the others.
    """
    known = F.col("resid").isNotNull() & (F.col("resid") > -1)
    rows, keys = (residuals.withColumn("fitted", known), ("ticker", "fitted")) if keep else (residuals.where(known), ("ticker",))
    w, to = Window.partitionBy(*keys).orderBy("date"), 0 if inclusive else -1
    level = rows.withColumn("x", F.exp(F.sum(F.log1p("resid")).over(w.rowsBetween(Window.unboundedPreceding, 0)))).withColumns({"__before": F.lag("x").over(w), "__place": _place(keys)})
    fit = _level_fits(level, window - 1, keys)
    if not inclusive:
        fit = fit.withColumns({c: F.lag(c).over(w) for c in ("a", "b", "__syy", "__sxy", "__m")})
    fit = fit.withColumns({"__n": F.least(F.col("__place") + to, F.lit(window)), "__last": F.col("x") if inclusive else F.lag("x").over(w)})
    ok = (F.col("__n") >= least) & (F.col("b") > 0) & (F.col("b") < 1)
    mean, k = F.col("a") / (1 - F.col("b")), -F.ln("b")
    sigma = F.sqrt(F.greatest(F.col("__syy") - F.col("b") * F.col("__sxy"), F.lit(0.0)) / F.col("__m"))
    fit = fit.withColumns({"half_life": F.when(ok & (mean > 0), math.log(2) / k), "distance": F.when(ok & (mean > 0), (F.col("__last") - mean) / F.nullif(sigma / F.sqrt(2 * k), F.lit(0.0)))})
    return fit.drop("__before", "__place", "__n", "__syy", "__sxy", "__m", "__last")


def volume_normalised(panel: DataFrame, rows: int = 10, low: float = 0.5, high: float = 3.0) -> DataFrame:
    """Divides resid by the last known volume over the last known mean of `rows` volumes, clipped; without either, resid is unknown."""
    w = _rows(Window.unboundedPreceding, 0)
    full = F.when(F.count("volume").over(_rows(-(rows - 1), 0)) == rows, F.avg("volume").over(_rows(-(rows - 1), 0)))
    out = panel.withColumns({"__mean": full, "__v": F.last("volume", ignorenulls=True).over(w)}).withColumn("__mean", F.last("__mean", ignorenulls=True).over(w))
    return out.withColumn("resid", F.col("resid") / clip(F.try_divide("__v", F.nullif("__mean", F.lit(0.0))), low, high)).drop("__mean", "__v")


def reversion_inputs(residuals: DataFrame, window: int = 60, least: int = 30, back: int = 21, keep: Sequence[str] = ()) -> DataFrame:
    """(ticker, date, half_life, distance, reversal) from residuals of dense dates, all strictly before the row's date.

    reversal: the log change of the compounded residual over the last `back` dates, missing residuals counting as 0. keep: columns that stay.
    """
    rows = residuals.select("ticker", "date", F.when(F.col("resid") > -1, F.col("resid")).alias("resid"), *keep)
    w = Window.partitionBy("ticker").orderBy("date")
    level = F.sum(F.log1p(F.coalesce("resid", F.lit(0.0)))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    fit = ou_fit(rows, window, least, inclusive=True, keep=True)
    out = fit.select("ticker", "date", "resid", F.when(F.col("fitted"), F.struct("half_life", "distance")).alias("__fit"), *keep).withColumn("__level", level)
    # the fit of the last residual before the date, whether it succeeded or not
    out = out.withColumns({"__fit": F.last("__fit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "reversal": F.lag("__level", 1).over(w) - F.lag("__level", back + 1).over(w)})
    return out.select("ticker", "date", "__fit.half_life", "__fit.distance", "reversal", *keep)


def ou_score(residuals: DataFrame, window: int = 60, least: int = 30, back: int = 21) -> DataFrame:
    """(ticker, date, score): z-score of the blend of two ranks, distance below the mean and reversal; fast reversion weighs the first more."""
    from crossweave.operators.xsection import zscore

    blend = reversion_blend(reversion_inputs(residuals, window, least, back)).where(F.col("__blend").isNotNull())
    return zscore(blend, "__blend", "score").select("ticker", "date", "score")


def reversion_blend(inputs: DataFrame) -> DataFrame:
    """Adds __blend of the date's ranks of distance and reversal."""
    from crossweave.functions.scalar import ou_blend
    from crossweave.operators.xsection import rank01

    rows = inputs.withColumns({"distance": F.round("distance", 9), "reversal": F.round("reversal", 9)})
    rows = rank01(rank01(rows, "distance", "__ou", single=None, descending=True), "reversal", "__rev", single=None, descending=True)
    return rows.withColumn("__blend", ou_blend(F.col("__ou"), F.col("__rev"), F.col("half_life")))


def ou_diagnostic(residuals: DataFrame, prices: DataFrame, window: int = 60, least: int = 30, back: int = 21, low: float = 0.5, high: float = 3.0, cap: float = 10.0) -> DataFrame:
    """A row a ticker of the last date's mean reversion, out of its last `window` residuals alone.

    residuals: (ticker, date, resid), with `scalar` if they are to be divided by it, the last known one clipped to low .. high; a ticker without any
    stays as it is. prices: (ticker, date, close). Level, mean and deviation are in units of the last price. half_life is rounded to one place before it weighs the
    rank of the distance; a fit without reversion, deviation or price weighs 0. Compounded residuals of the last `back` dates give the reversal.
    """
    from crossweave.functions.scalar import ou_weight
    from crossweave.operators.xsection import rank01

    path = Window.partitionBy("ticker").orderBy("date")
    if "scalar" in residuals.columns:
        held = F.last("scalar", ignorenulls=True).over(path.rowsBetween(Window.unboundedPreceding, 0))
        some = F.count("scalar").over(Window.partitionBy("ticker")) > 0
        residuals = residuals.withColumn("resid", F.when(some, F.try_divide("resid", clip(held, low, high))).otherwise(F.col("resid")))
    rows = residuals.select("ticker", "date", "resid")
    known = rows.where(F.col("resid").isNotNull())
    # the filter on the rank prunes each ticker's rows before they are shuffled
    last = known.withColumn("__k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where(F.col("__k") <= window)
    last = last.withColumn("x", F.product(1 + F.col("resid")).over(path.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__b", F.lag("x").over(path))
    fit = last.groupBy("ticker").agg(
        F.count("*").alias("n"), F.min("date").alias("__first"), F.max_by("x", "date").alias("__x"), F.regr_slope("x", "__b").alias("b"), F.regr_intercept("x", "__b").alias("a"),
        F.regr_syy("x", "__b").alias("__syy"), F.regr_sxy("x", "__b").alias("__sxy"), F.regr_count("x", "__b").alias("__m"),
    )
    priced = prices.where(F.col("close").isNotNull()).join(fit.select("ticker", "__first"), "ticker").groupBy("ticker").agg(
        F.min_by("close", F.when(F.col("date") >= F.col("__first"), F.col("date"))).alias("__anchor"), F.max_by("close", "date").alias("__price")
    )
    fit = fit.join(priced, "ticker", "left")
    dates = rows.select("date").distinct().orderBy(F.desc("date")).limit(back + 1)  # a few dates
    counted = dates.agg(F.count("*").alias("__dates"), F.min("date").alias("__oldest"))
    steps = rows.join(F.broadcast(counted), F.col("date") > F.col("__oldest")).where(F.col("__dates") > back)
    reversal = steps.groupBy("ticker").agg(F.when(F.min(F.coalesce("resid", F.lit(0.0))) > -1, F.sum(F.log1p(F.when(F.col("resid") > -1, F.col("resid")).otherwise(0.0)))).alias("st_reversal"))
    k = -F.ln(F.when((F.col("b") > 0) & (F.col("b") < 1), F.col("b")))
    scale = F.try_divide("__price", F.nullif("__x", F.lit(0.0)))
    deviation = F.sqrt(F.greatest(F.col("__syy") - F.col("b") * F.col("__sxy"), F.lit(0.0)) / F.col("__m"))
    mean = F.col("a") / (1 - F.col("b")) * scale
    fit = fit.withColumns({"__k": k, "__mean": mean, "__sd": F.nullif(deviation * scale, F.lit(0.0))})
    valid = (F.col("n") >= least) & (F.col("__anchor") > 0) & (F.col("__price") > 0) & F.col("__k").isNotNull() & F.col("__sd").isNotNull() & (F.col("__mean") > 0)
    fit = fit.withColumn("ou_valid", F.coalesce(valid, F.lit(False)))
    when = lambda c: F.when(F.col("ou_valid"), c)
    fit = fit.withColumns({"ou_dist": when(F.round((F.col("__price") - F.col("__mean")) / (F.col("__sd") / F.sqrt(2 * F.col("__k"))), 4)), "lt_mean": when(F.col("__mean")), "mr_speed": when(F.col("__k")), "mr_halflife": when(F.round(math.log(2) / F.col("__k"), 1)), "resid_vol": when(F.col("__sd"))})
    out = rows.select("ticker").distinct().join(fit, "ticker", "left").join(reversal, "ticker", "left").withColumns({"ou_valid": F.coalesce("ou_valid", F.lit(False)), "__all": F.lit(1)})
    out = rank01(rank01(out, "ou_dist", "ou_rank", ("__all",), descending=True), "st_reversal", "rev_rank", ("__all",), descending=True)  # a row a ticker
    out = out.withColumn("ou_weight", when(ou_weight(F.col("mr_halflife"), cap=cap)).otherwise(0.0))
    out = out.withColumn("final_score", (F.col("ou_weight") * F.coalesce("ou_rank", F.lit(0.0)) + F.col("rev_rank")) / (F.col("ou_weight") + 1))
    place = F.rank().over(Window.partitionBy("__all").orderBy(F.desc("final_score")))
    out = out.withColumn("final_rank", F.when(F.col("final_score").isNotNull(), place))
    return out.select("ticker", "ou_dist", "lt_mean", "mr_speed", "mr_halflife", "resid_vol", "st_reversal", "ou_valid", "ou_weight", "ou_rank", "rev_rank", "final_score", "final_rank")

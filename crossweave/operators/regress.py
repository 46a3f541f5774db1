"""Cross-sectional regressions by date: weighted least squares in closed form for one regressor; gram.py has those of several."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weights(panel: DataFrame, cap: str = "cap") -> DataFrame:
    """Adds w: ln of the capitalisation; missing or unit capitalisation counts as 1."""
    log = F.ln(F.greatest(F.coalesce(F.col(cap), F.lit(1.0)), F.lit(1.0)))
    return panel.withColumn("w", F.when(log > 0, log).otherwise(1.0))


def factor_step(rows: DataFrame, y: str, x: str, min_names: int, w: str = "w") -> tuple[DataFrame, DataFrame]:
    """(residuals (date, ticker, resid), lambdas (date, intercept, slope, r2)) of y on one regressor, from five weighted moments a date."""
    known = rows.dropna(subset=[y, x])
    W, X, Y = F.col(w), F.col(x), F.col(y)
    m = known.groupBy("date").agg(F.count("*").alias("n"), F.sum(W).alias("s"), F.sum(W * X).alias("sx"), F.sum(W * Y).alias("sy"), F.sum(W * X * X).alias("sxx"), F.sum(W * X * Y).alias("sxy"), F.sum(W * Y * Y).alias("syy")).where(F.col("n") >= min_names)
    mx, my = F.col("sx") / F.col("s"), F.col("sy") / F.col("s")
    m = m.withColumns({"vx": F.col("sxx") / F.col("s") - mx * mx, "cxy": F.col("sxy") / F.col("s") - mx * my, "vy": F.col("syy") / F.col("s") - my * my})
    m = m.where(F.col("vx") > 1e-14).withColumn("slope", F.col("cxy") / F.col("vx")).withColumn("intercept", my - F.col("slope") * mx)
    lambdas = m.select("date", "intercept", "slope", F.try_divide(F.col("slope") * F.col("cxy"), "vy").alias("r2"))
    # a row a date
    resid = known.join(F.broadcast(lambdas.select("date", "intercept", "slope")), "date").select("date", "ticker", (Y - F.col("intercept") - F.col("slope") * X).alias("resid"))
    return resid, lambdas


def orthogonalised(rows: DataFrame, x: str, prior: str, min_names: int, w: str = "w0") -> DataFrame:
    """Adds perp: x less its weighted fit on one prior, whose missing values count as 0; dates with too few names keep x."""
    P, X, W = F.coalesce(F.col(prior), F.lit(0.0)), F.col(x), F.col(w)
    terms = {"s": F.lit(1.0), "p": P, "x": X, "pp": P * P, "px": P * X}
    # both ways of weighing in one pass; which one a date takes follows from its total
    sums = [F.sum(F.when(X.isNotNull(), term if even else W * term)).alias(f"__{kind}{k}") for kind, even in (("w", False), ("e", True)) for k, term in terms.items()]
    m = rows.groupBy("date").agg(F.count(x).alias("__n"), *sums)
    s, p, mx, pp, px = (F.when(F.col("__ws") > 0, F.col(f"__w{k}")).otherwise(F.col(f"__e{k}")) for k in terms)
    m = m.select(F.col("date").alias("__date"), "__n", s.alias("__s"), (p / s).alias("__mp"), (mx / s).alias("__mx"), (pp / s).alias("__pp"), (px / s).alias("__px"))
    vp, c = F.col("__pp") - F.col("__mp") * F.col("__mp"), F.col("__px") - F.col("__mp") * F.col("__mx")
    m = m.select("__date", "__n", "__mp", "__mx", F.coalesce(c / F.when(vp > 1e-14, vp), F.lit(0.0)).alias("__slope"))
    known = rows.join(F.broadcast(m), F.col("date").eqNullSafe(F.col("__date")), "left")  # a row a date
    fit = F.col("__mx") + F.col("__slope") * (P - F.col("__mp"))
    return known.withColumn("perp", F.when(F.col("__n") >= min_names, X - fit).otherwise(X)).drop("__date", "__n", "__mp", "__mx", "__slope")


def residualised(rows: DataFrame, y: str, x: str, out: str = "resid", keys: tuple[str, ...] = ("date",)) -> DataFrame:
    by = Window.partitionBy(*keys)
    return rows.withColumn(out, F.col(y) - F.regr_intercept(y, x).over(by) - F.regr_slope(y, x).over(by) * F.col(x))

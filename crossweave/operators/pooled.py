"""Pooled regressions: all rows of a key at once, coefficients with their errors as rows, residuals as a DataFrame.

The Gram matrix is one aggregate, summed within tasks first; only a row a key goes on from there. With K regressors it has K * K / 2 sums, so these
are for tens of regressors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.functions.student import two_sided_p
from crossweave.operators.gram import _at, _matrix, _sums, swept
from crossweave.operators.xsection import demeaned, percent_rank


def _swept_rows(rows: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, n, __g, __s): the Gram matrix of (1, xs, y) over n, and it swept of all regressors; keys with too few rows for a deviation are left out."""
    known = rows.dropna(subset=[y, *xs])
    terms = [F.lit(1.0), *(F.col(c).cast("double") for c in (*xs, y))]
    sums = known.groupBy(*keys).agg(F.count("*").alias("n"), *_sums(terms, None, "__c")).where(F.col("n") > len(xs) + 1)
    return sums.select(*keys, "n", _matrix(len(xs) + 2, "__c", F.col("n")).alias("__g")).withColumn("__s", swept(F.col("__g"), F.lit(len(xs) + 1)))


def _r2(k: int, swept_matrix: str) -> Column:
    total = _at(F.col("__g"), k + 1, k + 1) - _at(F.col("__g"), 0, k + 1) * _at(F.col("__g"), 0, k + 1)
    return F.when(total > 0, 1 - _at(F.col(swept_matrix), k + 1, k + 1) / total)


def _error(k: int, j: int | Column) -> Column:
    """The standard error of coefficient j (0: the intercept); NULL for a regressor that others explain."""
    mse = F.greatest(_at(F.col("__s"), k + 1, k + 1), F.lit(0.0)) * F.col("n") / (F.col("n") - k - 1)
    inverse = _at(F.col("__s"), j, j) / F.col("n")
    return F.when(inverse > 0, F.sqrt(mse * inverse))


def pooled(rows: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, r2, factor, coef, error, t, p), a row a coefficient, of y on xs over all rows of a key that have them."""
    k = len(xs)
    fits = _swept_rows(rows, y, xs, keys)
    each = [F.struct(F.lit(name).alias("factor"), _at(F.col("__s"), j, k + 1).alias("coef"), _error(k, j).alias("error")) for j, name in enumerate(("intercept", *xs))]
    long = fits.select(*keys, "n", _r2(k, "__s").alias("r2"), F.inline(F.array(*each)))
    t = F.try_divide(F.col("coef"), F.nullif("error", F.lit(0.0)))
    return long.withColumn("t", t).withColumn("p", two_sided_p(F.col("t"), F.col("n") - k - 1))


def pooled_residuals(rows: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = (), out: str = "resid") -> DataFrame:
    """The rows that have y and xs, with `out`: y less its pooled fit."""
    k, keys = len(xs), list(keys)
    coefs = _swept_rows(rows, y, xs, keys).select(*keys, F.transform("__s", lambda line: F.get(line, F.lit(k + 1))).alias("__b"))
    known = rows.dropna(subset=[y, *xs])
    # without keys there is one row of coefficients
    both = known.join(coefs, keys) if keys else known.join(F.broadcast(coefs))
    fit = F.get(F.col("__b"), F.lit(0))
    for j, x in enumerate(xs, 1):
        fit = fit + F.get(F.col("__b"), F.lit(j)) * F.col(x)
    return both.withColumn(out, F.col(y) - fit).drop("__b")


def interaction_gain(rows: DataFrame, y: str, xs: Sequence[str], extra: str, keys: Sequence[str] = (), least_t: float = 2.0, least_gain: float = 0.005) -> DataFrame:
    """(keys, n, coef, t, p, gain, significant): what `extra` adds to xs, out of one Gram matrix swept with and without it."""
    k = len(xs) + 1
    fits = _swept_rows(rows, y, [*xs, extra], keys).withColumn("__base", swept(F.col("__g"), F.lit(k)))
    out = fits.select(*keys, "n", _at(F.col("__s"), k, k + 1).alias("coef"), _error(k, k).alias("__e"), (_r2(k, "__s") - _r2(k, "__base")).alias("gain"))
    out = out.withColumn("t", F.try_divide(F.col("coef"), F.nullif("__e", F.lit(0.0)))).withColumn("p", two_sided_p(F.col("t"), F.col("n") - k - 1))
    return out.select(*keys, "n", "coef", "t", "p", "gain", ((F.abs("t") > least_t) & (F.col("gain") > least_gain)).alias("significant"))


# -- two phases: select factors by their information coefficient, then fit what is left to returns


def ranked_factors(rows: DataFrame, factors: Sequence[str], across: Sequence[str] = ()) -> DataFrame:
    """Each factor as its percent rank within date and sector, those of `across` within the date."""
    for f in factors:
        rows = percent_rank(rows, f, f, ("date",) if f in across else ("date", "sector"))
    return rows


def factor_ics(ranked: DataFrame, y: str, factors: Sequence[str], least: float = 0.01) -> DataFrame:
    """(factor, ic, n, selected): the correlation over all rows of each ranked factor with y ranked within date and sector."""
    target = percent_rank(ranked, y, "__y", ("date", "sector"))
    long = target.select("__y", F.inline(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("x")) for f in factors)))).dropna()
    return long.groupBy("factor").agg(F.corr("x", "__y").alias("ic"), F.count("*").alias("n")).withColumn("selected", F.coalesce(F.abs("ic") > least, F.lit(False)))


def selected_factors(ics: DataFrame) -> list[str]:
    """Their names; a row a factor."""
    return sorted(r["factor"] for r in ics.where("selected").select("factor").collect())


def second_phase(ranked: DataFrame, y: str, factors: Sequence[str], sectors: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(coefficients, residuals) of y less its mean by date and sector on ranked factors and dummies of all `sectors` but the first."""
    rows = demeaned(ranked, y, "__y")
    dummies = [f"sector_{s}" for s in sectors[1:]]
    rows = rows.withColumns({c: (F.col("sector") == s).cast("double") for c, s in zip(dummies, sectors[1:], strict=True)})
    xs = [*factors, *dummies]
    return pooled(rows, "__y", xs), pooled_residuals(rows, "__y", xs)

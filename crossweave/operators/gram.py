"""Regressions of several regressors by date, from Gram matrices.

A date's Gram matrix of (1, regressors, target) is one aggregate over the panel, summed within tasks before the shuffle, whatever the number of names.
What follows works on a matrix a date: the sweep operator, as higher-order functions over arrays, gives the weighted fits of any
leading set of columns; ridge paths take one eigendecomposition a fold. The panel itself is read again only for residuals, joined by date.

A column that those before it explain (pivot below TOLERANCE of its square sum) gets slope 0; `rank` counts the others.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-12
Hold = Callable[[DataFrame], DataFrame]


def _pairs(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def _sums(terms: Sequence[Column], w: Column | None, prefix: str) -> list[Column]:
    products = (terms[i] * terms[j] if w is None else w * terms[i] * terms[j] for i, j in _pairs(len(terms)))
    return [F.sum(x).alias(f"{prefix}{k}") for k, x in enumerate(products)]


def _matrix(size: int, prefix: str, over: Column | None = None) -> Column:
    place = {p: k for k, p in enumerate(_pairs(size))}
    cell = lambda i, j: F.col(f"{prefix}{place[min(i, j), max(i, j)]}")
    return F.array(*(F.array(*(cell(i, j) if over is None else cell(i, j) / over for j in range(size))) for i in range(size)))


def _at(a: Column, i: Column | int, j: Column | int) -> Column:
    return F.get(F.get(a, F.lit(i) if isinstance(i, int) else i), F.lit(j) if isinstance(j, int) else j)


def swept(matrix: Column, pivots: Column) -> Column:
    """The symmetric `matrix` (array of rows) after sweeping its first `pivots` columns: slopes stand in the last column, the inverse in the swept block."""

    def sweep(a: Column, p: Column) -> Column:
        d = _at(a, p, p)
        sound = d > TOLERANCE * _at(matrix, p, p)
        row = F.get(a, p)

        def cell(x: Column, r: Column, c: Column) -> Column:
            on_row, on_column = r == p, c == p
            left_out = F.when(on_row | on_column, F.lit(0.0)).otherwise(x)
            used = F.when(on_row & on_column, 1 / d).when(on_row, x / d).when(on_column, -x / d).otherwise(x - _at(a, r, p) * F.get(row, c) / d)
            return F.when(sound, used).otherwise(left_out)

        return F.transform(a, lambda line, r: F.transform(line, lambda x, c: cell(x, r, c)))

    return F.aggregate(F.sequence(F.lit(0), pivots - 1), matrix, sweep)


def _figures(fits: DataFrame, size: int, k: Column, ridge: Column) -> DataFrame:
    """Adds intercept, slopes, r2 and rank of the first k regressors to rows with __g, the normalised Gram matrix of (1, regressors, target)."""
    y = size - 1
    penalised = F.transform("__g", lambda line, r: F.transform(line, lambda x, c: F.when((r == c) & (r > 0) & (r < y), x + ridge).otherwise(x)))
    fits = fits.withColumns({"__p": penalised, "__k": k, "__l": ridge})
    fits = fits.withColumn("__s", swept(F.col("__p"), F.col("__k") + 1))
    # size 1 keeps sequence() ascending without regressors
    slopes = F.transform(F.slice(F.col("__s"), 2, F.col("__k")), lambda line: F.get(line, F.lit(y)))
    fits = fits.withColumns({"intercept": _at(F.col("__s"), 0, y), "slopes": slopes})
    squares = F.aggregate("slopes", F.lit(0.0), lambda a, b: a + b * b)
    total = _at(F.col("__g"), y, y) - _at(F.col("__g"), 0, y) * _at(F.col("__g"), 0, y)
    ranks = F.size(F.filter(F.transform(F.slice(F.col("__s"), 2, F.col("__k")), lambda line, j: F.get(line, j + 1)), lambda x: x != 0)).cast("long")
    return fits.withColumns({"r2": F.when(total > 0, 1 - (_at(F.col("__s"), y, y) - F.col("__l") * squares) / total), "rank": ranks}).drop("__g", "__p", "__s", "__k", "__l")


def fitted(columns: Sequence[str]) -> Column:
    """intercept + slopes of rows that carry both."""
    out = F.col("intercept")
    for j, x in enumerate(columns):
        out = out + F.get(F.col("slopes"), F.lit(j)) * F.col(x)
    return out


def joint_step(rows: DataFrame, y: str, xs: Sequence[str], min_names: int, ridge: float = 0.0, w: str = "w", keys: Sequence[str] = ("date",), hold: Hold = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(residuals (keys, ticker, resid), figures (keys, n, intercept, slopes, r2)) of y on several regressors at once, by date.

    hold: applied to the figures, a row a date, before residuals use them; a checkpoint there spares a second aggregation.

    Rows need y and all of xs; dates with fewer than `min_names` such rows, and without a ridge those with dependent regressors, have no fit.
    """
    xs, keys = list(xs), list(keys)
    known = rows.dropna(subset=[y, *xs])
    size = len(xs) + 2
    sums = known.groupBy(*keys).agg(F.count("*").alias("n"), *_sums([F.lit(1.0), *(F.col(c).cast("double") for c in (*xs, y))], F.col(w), "__c"))
    fits = _figures(sums.where(F.col("n") >= min_names).select(*keys, "n", _matrix(size, "__c", F.col("__c0")).alias("__g")), size, F.lit(len(xs)), F.lit(float(ridge)))
    fits = hold(fits.where(F.col("rank") == len(xs)).drop("rank"))
    resid = known.join(F.broadcast(fits.select(*keys, "intercept", "slopes")), keys).select(*keys, "ticker", (F.col(y) - fitted(xs)).alias("resid"))
    return resid, fits


def nested_steps(rows: DataFrame, y: str, sets: Sequence[tuple[str, Sequence[str]]], min_names: int, w: str = "w", hold: Hold = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(residuals (k, step, date, ticker, resid), figures (k, step, date, n, intercept, slopes, r2)) of y on cumulative sets of regressors.

    Set k holds the columns of the first k entries of `sets` (name, columns), and its rows those that have y and all of these. Rows are aggregated once, by the
    number of sets that they are complete for; the Gram matrix of a set is the sum over rows complete for it or more, and sweeping its columns gives the fit.
    Without a fit, and hold: as in joint_step.
    """
    columns = [c for _, added in sets for c in added]
    ends = [sum(len(added) for _, added in sets[: k + 1]) for k in range(len(sets))]
    missing = F.least(*(F.when(F.col(c).isNull(), F.lit(k)).otherwise(F.lit(len(sets))) for k, (_, added) in enumerate(sets) for c in added), F.lit(len(sets)))
    known = rows.where(F.col(y).isNotNull()).withColumn("__sets", missing).where(F.col("__sets") > 0)
    size = len(columns) + 2
    filled = [F.lit(1.0), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in (*columns, y))]
    sums = known.groupBy("date", "__sets").agg(F.count("*").alias("n"), *_sums(filled, F.col(w), "__c"))
    cells = [f"__c{k}" for k in range(len(_pairs(size)))]
    by_set = sums.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("__sets")))).groupBy("date", "k").agg(*(F.sum(c).alias(c) for c in ("n", *cells)))
    used = F.element_at(F.array(*(F.lit(e) for e in ends)), F.col("k"))
    fits = _figures(by_set.where(F.col("n") >= min_names).select("date", "k", "n", _matrix(size, "__c", F.col("__c0")).alias("__g")), size, used, F.lit(0.0))
    fits = hold(fits.where(F.col("rank") == used).drop("rank"))
    name = F.element_at(F.array(*(F.lit(n) for n, _ in sets)), F.col("k"))
    each = known.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("__sets")))).join(F.broadcast(fits.select("date", "k", "intercept", "slopes")), ["date", "k"])
    fit = F.col("intercept")
    for j, c in enumerate(columns):
        fit = fit + F.coalesce(F.get(F.col("slopes"), F.lit(j)) * F.col(c), F.lit(0.0))
    resid = each.select("k", name.alias("step"), "date", "ticker", (F.col(y) - fit).alias("resid"))
    return resid, fits.select("k", name.alias("step"), "date", "n", "intercept", "slopes", "r2")


def _prior_sums(priors: int, columns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches (date, weight, priors, columns): for each date of a task, and each column, its count and the Gram matrices of (1, priors, column), weighted and plain.

    A product of matrices a date: with a dozen priors, as many sums in one aggregate no longer fit Spark's generated code. A task holds a few KB a date.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in it:
            if not batch.num_rows:
                continue
            days = batch.column(0).cast(pa.int32()).to_numpy(zero_copy_only=False)
            order = np.argsort(days, kind="stable")
            days = days[order]
            line = lambda k: batch.column(k).fill_null(0.0).to_numpy(zero_copy_only=False)[order]  # noqa: B023, E731
            fixed = np.column_stack([np.ones(len(days)), *(line(2 + j) for j in range(priors))])
            weight, own = line(1), [line(2 + priors + i) for i in range(columns)]
            has = [batch.column(2 + priors + i).is_valid().to_numpy(zero_copy_only=False)[order].astype(float) for i in range(columns)]
            starts = np.flatnonzero(np.r_[True, days[1:] != days[:-1]])
            for lo, hi in zip(starts, np.r_[starts[1:], len(days)], strict=True):
                found = []
                for x, h in zip(own, has, strict=True):
                    each = np.column_stack([fixed[lo:hi], x[lo:hi]])
                    found.append([h[lo:hi].sum()])
                    for v in (weight[lo:hi] * h[lo:hi], h[lo:hi]):
                        found.append((each.T @ (each * v[:, None])).ravel())
                part = np.concatenate(found)
                day = int(days[lo])
                parts[day] = parts[day] + part if day in parts else part
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()).cast(pa.date32()), pa.array([p.tolist() for p in parts.values()], pa.list_(pa.float64()))], ["date", "part"])

    return run


def _swept_first(g: np.ndarray, pivots: int) -> np.ndarray:
    """swept() of one matrix."""
    a = g.copy()
    for p in range(pivots):
        d, row, column = a[p, p], a[p].copy(), a[:, p].copy()
        if d > TOLERANCE * g[p, p]:
            a -= np.outer(column, row) / d
            a[p], a[:, p] = row / d, -column / d
            a[p, p] = 1 / d
        else:
            a[p], a[:, p] = 0.0, 0.0
    return a


def _prior_fits(priors: int, columns: int, min_names: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One date's parts of _prior_sums(), a row a task, to each column's coefficients; NULL with too few values."""
    size = priors + 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = np.sum([np.asarray(p) for p in pdf["part"]], axis=0).reshape(columns, 1 + 2 * size * size)
        out = {"date": [pdf["date"].iloc[0]]}
        for i, part in enumerate(whole):
            weighted, plain = part[1:].reshape(2, size, size)
            g = weighted if weighted[0, 0] > 0 else plain
            fit = part[0] >= min_names and g[0, 0] > 0
            out[f"__b{i}"] = [_swept_first(g / g[0, 0], size - 1)[:-1, -1].tolist() if fit else None]
        return pd.DataFrame(out)

    return run


def orthogonalised_by(rows: DataFrame, columns: Sequence[str], priors: Sequence[str], min_names: int, w: str | None = "w0", hold: Hold = lambda df: df, keep: bool = False) -> DataFrame:
    """(date, ticker, *columns): each column less its weighted fit on the priors, by date; keep: with all other columns of `rows` as they are.

    Missing priors count as 0, a column's missing values stay. Dates with fewer than `min_names` values keep them; without any positive weight, or with
    w = None, all names weigh the same. hold: applied to the coefficients, a row a date.
    """
    priors = list(priors)
    weight = F.lit(1.0) if w is None else F.coalesce(F.col(w), F.lit(0.0))
    filled = {f"__p{j}": F.coalesce(F.col(p).cast("double"), F.lit(0.0)) for j, p in enumerate(priors)}
    values = rows.where(F.col("date").isNotNull()).select("date", weight.cast("double").alias("__w"), *(x.alias(n) for n, x in filled.items()), *(F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns)))
    sums = values.mapInArrow(_prior_sums(len(priors), len(columns)), "date date, part array<double>")
    fits = ", ".join(f"__b{i} array<double>" for i in range(len(columns)))
    coefficients = sums.groupBy("date").applyInPandas(_prior_fits(len(priors), len(columns), min_names), f"date date, {fits}")
    names = rows.columns if keep else ["date", "ticker", *columns]
    rows = rows.select(*names, *(x.alias(n) for n, x in filled.items()))
    rows = rows.join(F.broadcast(hold(coefficients)), "date")
    out = {}
    for i, c in enumerate(columns):
        fit = F.get(F.col(f"__b{i}"), F.lit(0))
        for j, n in enumerate(filled):
            fit = fit + F.get(F.col(f"__b{i}"), F.lit(j + 1)) * F.col(n)
        out[c] = (F.col(c) - F.coalesce(fit, F.lit(0.0))).alias(c)
    return rows.select(*(out.get(c, F.col(c)) for c in names))


# -- ridge paths


@functools.lru_cache(maxsize=4096)
def folds(n: int, k: int) -> np.ndarray:
    """The fold of each of n names in their order; the same for every date with n names."""
    out = np.empty(n, np.int64)
    for f, members in enumerate(np.array_split(np.random.default_rng(42).permutation(n), k)):
        out[members] = f
    return out


def _centred(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(covariance of the regressors, with the target, variance of the target, means) out of a Gram matrix of (1, regressors, target)."""
    g = g / g[0, 0]
    m = g[0, 1:]
    c = g[1:, 1:] - np.outer(m, m)
    return c[:-1, :-1], c[:-1, -1], float(c[-1, -1]), m


class Path:
    """Slopes for every ridge out of one eigendecomposition."""

    def __init__(self, g: np.ndarray) -> None:
        self.cov, self.cross, self.spread, self.means = _centred(g)
        self.values, self.vectors = np.linalg.eigh(self.cov)
        self.turned = self.vectors.T @ self.cross
        top = max(float(self.values.max(initial=0.0)), 0.0)
        self.sound = self.values > top * np.finfo(float).eps * len(self.values)

    def slopes(self, ridge: float) -> np.ndarray:
        """Of least norm where the ridge is 0 and regressors depend on each other."""
        keep = self.sound if ridge <= 0 else np.ones(len(self.values), bool)
        scaled = np.zeros(len(self.values))
        scaled[keep] = self.turned[keep] / (self.values[keep] + ridge)
        return self.vectors @ scaled

    def error(self, b: np.ndarray) -> float:
        """Weighted mean square of the residuals."""
        return self.spread - 2 * float(b @ self.cross) + float(b @ self.cov @ b)


def best_ridge(parts: Sequence[tuple[np.ndarray, np.ndarray]], whole: Path, grid: Sequence[float], least: int, default: float, choice: str) -> float:
    """The grid's ridge of least error; the first wins ties, NaN never does. parts: (weighted, plain) Gram matrices of the folds.

    `folds`: unweighted variance on the fold left out, averaged over folds. `in_sample`: weighted error over all names.
    """
    scores = np.zeros(len(grid))
    if choice == "in_sample":
        scores = np.array([whole.error(whole.slopes(g)) for g in grid])
    else:
        total = sum(w for w, _ in parts)
        n = sum(p[0, 0] for _, p in parts)
        used = 0
        for w, p in parts:
            if p[0, 0] < 5 or n - p[0, 0] < least // 2:
                continue
            used += 1
            path = Path(total - w)
            cov, cross, spread, _ = _centred(p)
            for k, g in enumerate(grid):
                b = path.slopes(g)
                scores[k] += spread - 2 * b @ cross + b @ cov @ b
        if not used:
            return default
    best, ridge = np.inf, default
    for s, g in zip(scores, grid, strict=True):
        if s < best * (1 - 1e-12):
            best, ridge = s, float(g)
    return ridge


def ridge_path_step(
    rows: DataFrame, y: str, xs: Sequence[str], min_names: int, grid: Sequence[float], k_folds: int = 5, default: float = 0.5, w: str = "w", choice: str = "folds", hold: Hold = lambda df: df
) -> tuple[DataFrame, DataFrame]:
    """(residuals (date, ticker, resid), figures (date, n, intercept, slopes, r2, ridge)): y on several regressors with a ridge chosen for each date.

    choice: `folds` takes the ridge of least variance over held-out folds, which follow the tickers' order; `in_sample` that of least weighted error.
    hold: as in joint_step.
    """
    xs, grid = list(xs), [float(g) for g in grid]
    if choice not in ("folds", "in_sample") or not grid:
        raise ValueError("choice is folds or in_sample, and a grid has a value at least")
    by = Window.partitionBy("date")
    known = rows.dropna(subset=[y, *xs]).withColumn("__n", F.count("*").over(by)).where(F.col("__n") >= max(min_names, 10))
    size, cells = len(xs) + 2, len(_pairs(len(xs) + 2))
    upper = np.triu_indices(size)

    @F.pandas_udf("long")
    def fold_of(n: pd.Series, rank: pd.Series) -> pd.Series:
        return pd.Series([folds(a, k_folds)[b - 1] for a, b in zip(n, rank, strict=True)])

    fold = fold_of(F.col("__n"), F.row_number().over(by.orderBy("ticker")).cast("long")) if choice == "folds" and len(grid) > 1 else F.lit(0).cast("long")
    terms = [F.lit(1.0), *(F.col(c).cast("double") for c in (*xs, y))]
    sums = known.withColumn("__fold", fold).groupBy("date", "__fold").agg(*_sums(terms, F.col(w), "__w"), *_sums(terms, None, "__u"))
    both = sums.select("date", F.struct("__fold", F.array(*(F.col(f"__w{k}") for k in range(cells))).alias("w"), F.array(*(F.col(f"__u{k}") for k in range(cells))).alias("u")).alias("p"))
    by_date = both.groupBy("date").agg(F.sort_array(F.collect_list("p")).alias("parts"))  # as many parts as folds

    def square(flat: Sequence[float]) -> np.ndarray:
        g = np.zeros((size, size))
        g[upper] = flat
        return g + np.triu(g, 1).T

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for date, parts in zip(pdf["date"], pdf["parts"], strict=True):
                pairs = [(square(p["w"]), square(p["u"])) for p in parts]
                whole = Path(sum(a for a, _ in pairs))
                ridge = best_ridge(pairs, whole, grid, min_names, default, choice) if len(grid) > 1 else grid[0]
                b = whole.slopes(ridge)
                r2 = 1 - whole.error(b) / whole.spread if whole.spread > 0 else 0.0
                out.append((date, int(round(sum(u[0, 0] for _, u in pairs))), float(whole.means[-1] - b @ whole.means[:-1]), b.tolist(), r2, ridge))
            yield pd.DataFrame(out, columns=["date", "n", "intercept", "slopes", "r2", "ridge"])

    fits = hold(by_date.mapInPandas(run, "date date, n long, intercept double, slopes array<double>, r2 double, ridge double"))
    # dates without enough names have no fit
    resid = rows.dropna(subset=[y, *xs]).join(F.broadcast(fits.select("date", "intercept", "slopes")), "date").select("date", "ticker", (F.col(y) - fitted(xs)).alias("resid"))
    return resid, fits


def typed_ridge(ridge: float) -> float:
    """The ridge of a macro step for a given general one."""
    return min(2 * ridge, max(ridge, 0.5))

"""Regressions from Gram matrices against NumPy, date by date."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from crossweave.operators import gram as G

XS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(3)
    rows = []
    for k in range(14):
        date = dt.date(2020, 1, 1) + dt.timedelta(days=k)
        for t in range(9 if k == 3 else 25 + k):
            x = rng.normal(size=4) + [0.8, 0, 0, 3]
            if k == 5:
                x[1] = 2 * x[0]
            y = float(x @ [0.5, -0.2, 0.1, 0.0] + rng.normal())
            row = [date, f"t{t:02d}", y, *x, float(rng.uniform(0.5, 9)), float(rng.uniform(-1, 9))]
            for c in range(2, 7):
                if rng.random() < 0.08:
                    row[c] = None
            rows.append(row)
    pdf = pd.DataFrame(rows, columns=["date", "ticker", "y", *XS, "w", "w0"])
    pdf.loc[pdf["date"] == dt.date(2020, 1, 3), "w0"] = 0.0
    return pdf.assign(w0=pdf["w0"].clip(lower=0))


def frame(spark, pdf):
    return spark.createDataFrame([[None if v != v else v for v in r] for r in pdf.to_numpy(object).tolist()], "date date, ticker string, y double, a double, b double, c double, d double, w double, w0 double")


def solve(x, y, w, ridge=0.0):
    """(coefficients, residuals, r2, whether the regressors are independent)."""
    w = w / w.sum()
    m = np.column_stack([np.ones(len(y)), x])
    g = m.T @ (m * w[:, None]) + ridge * np.diag([0.0] + [1.0] * x.shape[1])
    b = np.linalg.lstsq(g, m.T @ (w * y), rcond=None)[0]
    e = y - m @ b
    return b, e, 1 - (w @ e**2) / (w @ (y - w @ y) ** 2), ridge > 0 or np.linalg.matrix_rank(m) == m.shape[1]


def close(got, want):
    np.testing.assert_allclose(got, want, rtol=1e-10, atol=1e-10)


@pytest.mark.parametrize("xs,ridge", [(["a"], 0.0), (["a", "b"], 0.0), (XS, 0.0), (XS, 0.5)])
def test_joint_step(spark, panel, xs, ridge):
    resid, fits = G.joint_step(frame(spark, panel), "y", xs, 12, ridge)
    fits = {r.date: r for r in fits.collect()}
    resid = {(r.date, r.ticker): r.resid for r in resid.collect()}
    seen = 0
    for date, part in panel.groupby("date"):
        part = part.dropna(subset=["y", *xs])
        b, e, r2, sound = solve(part[xs].to_numpy(float), part["y"].to_numpy(float), part["w"].to_numpy(float), ridge)
        assert (date in fits) == (len(part) >= 12 and sound), date
        if date in fits:
            close([fits[date].intercept, *fits[date].slopes, fits[date].r2], [*b, r2])
            close([resid[date, t] for t in part["ticker"]], e)
            seen += len(part)
    assert len(resid) == seen > 0


def test_nested_steps(spark, panel):
    sets = [("first", ["a"]), ("second", ["b", "c"]), ("third", ["d"])]
    resid, fits = G.nested_steps(frame(spark, panel), "y", sets, 12)
    fits = {(r.step, r.date): r for r in fits.collect()}
    resid = {(r.step, r.date, r.ticker): r.resid for r in resid.collect()}
    columns, seen = [], 0
    for k, (name, added) in enumerate(sets, 1):
        columns += added
        for date, part in panel.groupby("date"):
            part = part.dropna(subset=["y", *columns])
            b, e, r2, sound = solve(part[columns].to_numpy(float), part["y"].to_numpy(float), part["w"].to_numpy(float))
            assert ((name, date) in fits) == (len(part) >= 12 and sound)
            if (name, date) in fits:
                r = fits[name, date]
                assert (r.k, r.n) == (k, len(part))
                close([r.intercept, *r.slopes, r.r2], [*b, r2])
                close([resid[name, date, t] for t in part["ticker"]], e)
                seen += len(part)
    assert len(resid) == seen > 0


@pytest.mark.parametrize("w", ["w0", None])
def test_orthogonalised_by(spark, panel, w):
    got = {(r.date, r.ticker): r for r in G.orthogonalised_by(frame(spark, panel), ["c", "d"], ["a", "b"], 12, w).collect()}
    assert len(got) == len(panel)
    for date, part in panel.groupby("date"):
        for c in ("c", "d"):
            own = part[part[c].notna()]
            value = own[c].to_numpy(float)
            if len(own) >= 12:
                weight = own[w].to_numpy(float) if w else np.ones(len(own))
                value = solve(own[["a", "b"]].fillna(0).to_numpy(float), value, weight if weight.sum() > 0 else np.ones(len(own)))[1]
            close([got[date, t][c] for t in own["ticker"]], value)
            assert all(got[date, t][c] is None for t in part["ticker"][part[c].isna()])


def chosen(part, xs, grid, choice, least=12, default=0.7, k=5):
    """The ridge by solving again for every value and fold."""
    x, y, w = part[xs].to_numpy(float), part["y"].to_numpy(float), part["w"].to_numpy(float)
    n = len(y)
    parts = np.array_split(np.random.default_rng(42).permutation(n), k)
    best, ridge = np.inf, default
    for g in grid:
        scores = []
        if choice == "in_sample":
            b, e, _, _ = solve(x, y, w, g)
            scores.append((w @ e**2) / w.sum())
        else:
            for f in parts:
                rest = np.setdiff1d(np.arange(n), f)
                if len(f) >= 5 and len(rest) >= least // 2:
                    b = solve(x[rest], y[rest], w[rest], g)[0]
                    scores.append(np.var(y[f] - b[0] - x[f] @ b[1:]))
        if scores and np.mean(scores) < best * (1 - 1e-12):
            best, ridge = np.mean(scores), g
    return ridge


@pytest.mark.parametrize("choice", ["folds", "in_sample"])
def test_ridge_path(spark, panel, choice, monkeypatch):
    grid = (0.0, 0.01, 0.1, 0.5, 1.0, 2.0)
    resid, fits = G.ridge_path_step(frame(spark, panel), "y", XS, 12, grid, default=0.7, choice=choice)
    fits = {r.date: r for r in fits.collect()}
    resid = {(r.date, r.ticker): r.resid for r in resid.collect()}
    picked = set()
    for date, part in panel.groupby("date"):
        part = part.dropna(subset=["y", *XS]).sort_values("ticker")
        assert (date in fits) == (len(part) >= 12)
        if date in fits:
            ridge = chosen(part, XS, grid, choice)
            picked.add(ridge)
            b, e, r2, _ = solve(part[XS].to_numpy(float), part["y"].to_numpy(float), part["w"].to_numpy(float), ridge)
            assert (fits[date].ridge, fits[date].n) == (ridge, len(part)), date
            np.testing.assert_allclose([fits[date].intercept, *fits[date].slopes, fits[date].r2], [*b, r2], rtol=1e-8, atol=1e-8)
            np.testing.assert_allclose([resid[date, t] for t in part["ticker"]], e, rtol=1e-8, atol=1e-8)
    assert len(picked) > 1 if choice == "folds" else picked == {0.0}


def test_a_ridge_path_decomposes_each_fold_once(panel, monkeypatch):
    count = []
    real = np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda a: count.append(1) or real(a))
    x = np.column_stack([np.ones(40), np.random.default_rng(0).normal(size=(40, 4))])
    parts = [(x[f].T @ x[f], x[f].T @ x[f]) for f in np.array_split(np.arange(40), 5)]
    G.best_ridge(parts, G.Path(sum(w for w, _ in parts)), (0.0, 0.1, 0.5, 1.0, 2.0), 12, 0.5, "folds")
    assert len(count) == 6


def test_typed_ridge():
    assert [G.typed_ridge(x) for x in (0.1, 0.3, 0.6, 2.0)] == [0.2, 0.5, 0.6, 2.0]

"""SQL of the regressions of plans/models.py and of the sequential steps: elimination of normal equations, a layer a pivot."""

from __future__ import annotations

from crossweave.plans.oracle import CTE, _backtest, _sql

CTE |= {
    "sized": ("beta", """SELECT * REPLACE (coalesce((s - ms) / nullif(sds, 0), 0) AS s), coalesce((s - ms) / nullif(sds, 0), 0) AS size, greatest(s, 0) AS w0 FROM (
        SELECT *, avg(s) OVER (PARTITION BY date) AS ms, stddev_samp(s) OVER (PARTITION BY date) AS sds FROM (SELECT *, ln(greatest(coalesce(cap, 1), 1)) AS s FROM beta)) WHERE beta IS NOT NULL"""),
    "mom26": ("filled", "SELECT ticker, date, lag(close, 4) OVER w / lag(close, 26) OVER w - 1 AS mom FROM filled WINDOW w AS (PARTITION BY ticker ORDER BY date)"),
    "three": ("sized mom26", "SELECT s.*, m.mom FROM sized s LEFT JOIN mom26 m USING (ticker, date)"),
    "hot": ("sec", "SELECT ticker, CAST(r = 2 AS DOUBLE) AS s1, CAST(r = 3 AS DOUBLE) AS s2, CAST(r = 4 AS DOUBLE) AS s3, CAST(r = 5 AS DOUBLE) AS s4 FROM (SELECT ticker, dense_rank() OVER (ORDER BY sector) AS r FROM sec)"),
    "first": ("three hot", "SELECT t.*, h.s1, h.s2, h.s3, h.s4 FROM three t LEFT JOIN hot h USING (ticker)"),
}


def solved(src: str, y: str, xs: list[str], least: int, w: str = "w", ridge: float = 0.0) -> str:
    """(date, n, b0 .. bk, r2): y on 1 and xs by date, weighted by w; b0 is the intercept."""
    t, k = ["1.0", *xs, y], len(xs)
    last = k + 1
    cells = [(i, j) for i in range(last + 1) for j in range(i, last + 1)]
    known = " AND ".join(f"{c} IS NOT NULL" for c in (y, *xs))
    sql = f"SELECT date, count(*) AS n, {', '.join(f'sum({w} * {t[i]} * {t[j]}) / sum({w}) AS g{i}_{j}' for i, j in cells)} FROM {src} WHERE {known} GROUP BY date HAVING count(*) >= {least}"
    plus = lambda i, j: f"g{i}_{j}" + (f" + {ridge!r}" if i == j and 0 < i < last and ridge else "")
    sql = f"SELECT date, n, g{last}_{last} - g0_{last} * g0_{last} AS total, {', '.join(f'{plus(i, j)} AS g{i}_{j}' for i, j in cells)}, {', '.join(f'g{i}_{i} AS d{i}' for i in range(last))} FROM ({sql})"
    for p in range(k + 1):
        rest = ", ".join(f"g{i}_{j} - g{p}_{i} * g{p}_{j} / g{p}_{p} AS g{i}_{j}" for i, j in cells if i > p)
        kept = ", ".join(f"g{i}_{j}" for i, j in cells if i <= p)
        sql = f"SELECT date, n, total, {', '.join(f'd{i}' for i in range(last))}, {kept}, {rest} FROM ({sql}) WHERE g{p}_{p} > 1e-12 * d{p}"
    for p in range(k, -1, -1):
        sql = f"SELECT *, (g{p}_{last}{''.join(f' - g{p}_{j} * b{j}' for j in range(p + 1, k + 1))}) / g{p}_{p} AS b{p} FROM ({sql})"
    squares = " + ".join(f"b{j} * b{j}" for j in range(1, k + 1))
    return f"SELECT date, n, {', '.join(f'b{j}' for j in range(k + 1))}, 1 - (g{last}_{last} - {ridge!r} * ({squares})) / total AS r2 FROM ({sql})"


def left(src: str, y: str, xs: list[str], least: int, fit: str | None = None) -> str:
    """(date, ticker, resid) of solved(), or of the fit given."""
    known = " AND ".join(f"k.{c} IS NOT NULL" for c in (y, *xs))
    return f"SELECT k.date, k.ticker, k.{y} - f.b0{''.join(f' - f.b{j} * k.{x}' for j, x in enumerate(xs, 1))} AS resid FROM {src} k JOIN ({fit or solved(src, y, xs, least)}) f USING (date) WHERE {known}"


def perp(src: str, c: str, priors: list[str], least: int, w: str) -> str:
    """(date, ticker, perp): c less its fit on the priors, whose missing values are 0; short dates keep c."""
    filled = f"(SELECT date, ticker, {c}, {', '.join(f'coalesce({p}, 0) AS {p}' for p in priors)}, CASE WHEN sum(CASE WHEN {c} IS NOT NULL THEN {w} END) OVER (PARTITION BY date) > 0 THEN {w} ELSE 1.0 END AS v FROM {src})"
    fit = solved(filled, c, priors, least, "v")
    return f"SELECT k.date, k.ticker, k.{c} - coalesce(f.b0{''.join(f' + f.b{j} * coalesce(k.{p}, 0)' for j, p in enumerate(priors, 1))}, 0) AS perp FROM {src} k LEFT JOIN ({fit}) f USING (date)"


def _named(fit: str, xs: list[str]) -> str:
    return f"SELECT *, b0 AS intercept, {', '.join(f'b{j} AS b_{x}' for j, x in enumerate(xs, 1))} FROM ({fit})"


def _long(step: str, fit: str, k: int) -> str:
    """A row a slope."""
    return " UNION ALL ".join(f"SELECT '{step}' AS step, date, n, b0 AS intercept, r2, {j - 1} AS factor, b{j} AS slope FROM ({fit})" for j in range(1, k + 1))


_BS, _BSM = ["beta", "size"], ["beta", "size", "mom"]
_SETS = [("market", ["beta"]), ("size", _BS), ("sectors", [*_BS, "s1", "s2", "s3", "s4"]), ("momentum", [*_BS, "s1", "s2", "s3", "s4", "mom"])]


def _momentum(resid: str, long: int = 26, skip: int = 4) -> str:
    """(ticker, date, momentum): z-scores of summed residuals."""
    return f"""SELECT ticker, date, CASE WHEN mom IS NOT NULL THEN coalesce((mom - avg(mom) OVER (PARTITION BY date)) / nullif(stddev_samp(mom) OVER (PARTITION BY date), 0), 0) END AS momentum FROM (
        SELECT ticker, date, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY date) >= {long + 2} THEN coalesce(sum(resid) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {long} PRECEDING AND {skip + 1} PRECEDING), 0) END AS mom FROM ({resid}))"""


CTE |= {
    "left3": ("first", left("first", "ret", _SETS[2][1], 12)),
    "first4": ("left3", f"SELECT f.*, m.momentum FROM first f JOIN ({_momentum('SELECT * FROM left3')}) m USING (ticker, date)"),
    "perp1": ("sized", f"SELECT s.ticker, s.date, s.w, p.perp, r.resid FROM sized s JOIN ({perp('sized', 'size', ['beta'], 5, 'w0')}) p USING (date, ticker) JOIN ({left('sized', 'ret', ['beta'], 5)}) r USING (date, ticker)"),
    "chain2": ("perp1", left("perp1", "resid", ["perp"], 5)),
    "chain3": ("chain2", f"SELECT s.date, s.ticker, s.beta, s.size, s.w0, s.w, c.resid, m.momentum FROM sized s JOIN chain2 c USING (date, ticker) JOIN ({_momentum('SELECT * FROM chain2')}) m USING (date, ticker)"),
}
_CHAIN3 = f"(SELECT c.date, c.ticker, c.w, c.resid, p.perp FROM chain3 c JOIN ({perp('(SELECT s.date, s.ticker, s.beta, s.size, s.w0, m.momentum FROM sized s JOIN (' + _momentum('SELECT * FROM chain2') + ') m USING (date, ticker))', 'momentum', _BS, 5, 'w0')}) p USING (date, ticker))"
_LINE = "SELECT '{}' AS factor, date, b0 AS intercept, b1 AS slope, r2 FROM ({})"

_VOLS = "SELECT v.date, v.vol, g.gk, g.gk / nullif(v.vol, 0) AS ratio FROM ccv v JOIN gkv g USING (ticker, date) QUALIFY dense_rank() OVER (ORDER BY v.date DESC) = 1"
CTE |= {
    "ccv": ("ret", """SELECT ticker, date, sqrt(252 * sum(e * ret * ret) OVER w / sum(e) OVER w) AS vol FROM (SELECT *, CASE WHEN ret IS NOT NULL THEN exp(i * (ln(2) / 42)) END AS e FROM ret)
        WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 83 PRECEDING AND 1 PRECEDING)"""),
    "gkv": ("dense", """SELECT ticker, date, CASE WHEN n >= 42 AND v > 0 THEN sqrt(252 * v) END AS gk FROM (SELECT ticker, date, count(*) OVER w AS n, sum(e * greatest(0.5 * pow(ln(h / l), 2) - (2 * ln(2) - 1) * pow(ln(close / b), 2), 0)) OVER w / sum(e) OVER w AS v FROM (
        SELECT ticker, date, close, b, exp(i * (ln(2) / 42)) AS e, CASE WHEN close IS NOT NULL AND b IS NOT NULL THEN greatest(close, b) * (1 + greatest(0, least(0.1, tax))) END AS h, CASE WHEN close IS NOT NULL AND b IS NOT NULL THEN least(close, b) * (1 - greatest(0, least(0.1, tax))) END AS l FROM (
        SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS b FROM dense)) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 84 PRECEDING AND 1 PRECEDING))"""),
}
_VOL_FIGURES = [f"{c}_{n}" for c in ("vol", "gk", "ratio") for n in ("mean", "median", "min", "max")]

def last_coef(src: str, y: str, order: list[str], key: str) -> str:
    """(key, n, coef, error, t, freedom, r2) of the last term of `order`, which has the constant 1.0 too, out of a pooled regression of y."""
    t, m = [*order, y], len(order)
    cells = [(i, j) for i in range(m + 1) for j in range(i, m + 1)]
    known = " AND ".join(f"{c} IS NOT NULL" for c in t)
    sql = f"SELECT {key} AS key, count(*) AS n, {', '.join(f'avg({t[i]} * {t[j]}) AS g{i}_{j}' for i, j in cells)}, avg({y} * {y}) - avg({y}) * avg({y}) AS total FROM {src} WHERE {known} GROUP BY {key}"
    for p in range(m - 1):
        sql = f"SELECT key, n, total, {', '.join(f'g{i}_{j} - g{p}_{i} * g{p}_{j} / g{p}_{p} AS g{i}_{j}' for i, j in cells if i > p)} FROM ({sql})"
    a, b, c = f"g{m - 1}_{m - 1}", f"g{m - 1}_{m}", f"g{m}_{m}"
    sql = f"SELECT key, n, {b} / {a} AS coef, sqrt(({c} - {b} * {b} / {a}) / (n - {m}) / {a}) AS error, n - {m} AS freedom, 1 - ({c} - {b} * {b} / {a}) / total AS r2 FROM ({sql})"
    return f"SELECT *, coef / error AS t FROM ({sql})"


def _p(t: str, v: str, steps: int = 4000) -> str:
    """1 - twice the integral of Student's density from 0 to |t|, by Simpson's rule."""
    return f"""greatest(1 - 2 * exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) / sqrt({v} * pi()) * (least(abs({t}), 60.0) / {steps}) / 3
        * list_sum(list_transform(range(0, {steps + 1}), lambda i: CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(i * least(abs({t}), 60.0) / {steps}, 2) / {v}, -({v} + 1) / 2.0))), 0)"""


def _interaction(key: str, name: str) -> str:
    full, base = last_coef("rnk", "ry", ["1.0", "x", "tax", "mixed"], key), last_coef("rnk", "ry", ["1.0", "x", "tax"], key)
    return f"SELECT f.key AS {name}, f.n, f.coef, f.t, {_p('f.t', 'f.freedom')} AS p, f.r2 - b.r2 AS gain, CAST(abs(f.t) > 2 AND f.r2 - b.r2 > 0.005 AS INT) AS significant FROM ({full}) f JOIN ({base}) b USING (key)"


_AVG_RANK = "(rank() OVER (PARTITION BY date, sector ORDER BY {c}) + (count(*) OVER (PARTITION BY date, sector, {c}) - 1) / 2.0) / count(*) OVER (PARTITION BY date, sector)"
_XTR = ["x", "tax", "returned"]
_HOT = [f"sector_{s}" for s in ("america", "asia", "europe", "middle_east")]
CTE |= {
    "rnk0": ("sig", f"SELECT ticker, date, sector, fwd, fwd - avg(fwd) OVER (PARTITION BY date, sector) AS dem, {', '.join(f'{_AVG_RANK.format(c=c)} AS {n}' for c, n in (('x', 'x'), ('tax', 'tax'), ('returned', 'returned'), ('fwd', 'ry')))} FROM (SELECT * REPLACE (round(tax, 9) AS tax, round(returned, 9) AS returned) FROM sig WHERE fwd IS NOT NULL)"),
    "rnk": ("rnk0", "SELECT *, x * (1 - tax) AS mixed, year(date) AS year, 0 AS every, " + ", ".join(f"CAST(lower(replace(sector, ' ', '_')) = '{h[7:]}' AS DOUBLE) AS {h}" for h in _HOT) + " FROM rnk0"),
}
_TERMS = ["1.0", *_XTR, *_HOT]
_SECOND = [f"SELECT n, r2, '{name}' AS factor, coef, error, t, {_p('t', 'freedom')} AS p FROM ({last_coef('rnk', 'dem', [*(o for o in _TERMS if o != c), c], 'every')})" for c, name in zip(_TERMS, ["intercept", *_XTR, *_HOT], strict=True)]

CTE |= {
    "anc": ("cal", "SELECT a.d AS anchor, max(c.i) AS i FROM (SELECT CAST(unnest(generate_series(DATE '1992-03-15', DATE '1998-09-15', INTERVAL 3 MONTH)) AS DATE) AS d) a JOIN cal c ON c.date <= a.d GROUP BY a.d"),
    "afwd": ("anc dense sec", "SELECT a.anchor, a.i, s.ticker, c.sector, e.close / s.close - 1 AS fwd, avg(e.close / s.close - 1) OVER (PARTITION BY a.anchor) AS mkt FROM anc a JOIN dense s ON s.i = a.i JOIN dense e ON e.ticker = s.ticker AND e.i = a.i + 8 LEFT JOIN sec c ON c.ticker = s.ticker WHERE e.close / s.close IS NOT NULL"),
    "size0": ("ret anc", "SELECT anchor, ticker, arg_max(cap, date) AS size FROM anc JOIN ret ON ret.date <= anchor GROUP BY 1, 2"),
}


def _betas(names: str) -> str:
    """(anchor, ticker, beta) of names (anchor, i, ticker) from days on which all of them have a return."""
    return f"""SELECT n.anchor, n.ticker, CASE WHEN n.i < 20 THEN 1.0 ELSE coalesce(b.beta, 1.0) END AS beta FROM {names} n LEFT JOIN (
        SELECT anchor, ticker, CASE WHEN count(r) >= 10 THEN covar_samp(r, m) / nullif(var_samp(m), 0) END AS beta FROM (
          SELECT *, avg(r) OVER (PARTITION BY anchor, j) AS m FROM (SELECT *, max(f) OVER (PARTITION BY anchor) AS start FROM (
            SELECT *, p / lag(p) OVER (PARTITION BY anchor, ticker ORDER BY j) - 1 AS r, min(CASE WHEN close IS NOT NULL THEN j END) OVER (PARTITION BY anchor, ticker) AS f FROM (
              SELECT n.anchor, n.ticker, d.i AS j, d.close, last_value(d.close IGNORE NULLS) OVER (PARTITION BY n.anchor, n.ticker ORDER BY d.i) AS p FROM {names} n JOIN dense d ON d.ticker = n.ticker AND d.i > n.i - 63 AND d.i <= n.i))) WHERE j > start)
        GROUP BY anchor, ticker) b USING (anchor, ticker)"""


_PRICED = "(SELECT * FROM afwd WHERE sector IS NOT NULL QUALIFY count(*) OVER (PARTITION BY anchor) >= 10)"
_SIZED = "(SELECT a.*, ln(z.size) AS z FROM afwd a JOIN size0 z USING (anchor, ticker) WHERE a.sector IS NOT NULL AND z.size > 0 QUALIFY count(*) OVER (PARTITION BY a.anchor) >= 10)"
_OFF = "SELECT n.*, b.beta, n.fwd - b.beta * n.mkt - avg(n.fwd - b.beta * n.mkt) OVER (PARTITION BY n.anchor, n.sector) AS y FROM {0} n JOIN ({1}) b USING (anchor, ticker)"

_REGIMES = [(n, t) for n in (26, 52, 104) for t in (0.25, 0.5, 1.0)]
CTE |= {
    "at6": ("cal", "SELECT date, i FROM cal WHERE i % 6 = 0 AND i > 30"),
    "rank6": ("cs at6 mom26 ccv", """SELECT ticker, date, metric, CASE WHEN n > 1 THEN (rank() OVER (PARTITION BY date, sector, metric ORDER BY w) + (count(*) OVER (PARTITION BY date, sector, metric, w) - 1) / 2.0 - 1) / (n - 1) ELSE 0.5 END AS r FROM (
        SELECT *, greatest(quantile_cont(v, 0.01) OVER g, least(quantile_cont(v, 0.99) OVER g, v)) AS w, count(*) OVER g AS n FROM (
          SELECT ticker, date, sector, m.metric, CASE m.metric WHEN 'x' THEN x WHEN 'tax' THEN round(tax, 9) WHEN 'returned' THEN round(returned, 9) WHEN 'volume' THEN volume WHEN 'mom' THEN round(mom, 9) ELSE round(vol, 9) END AS v
          FROM cs JOIN at6 USING (date) LEFT JOIN mom26 USING (ticker, date) LEFT JOIN ccv USING (ticker, date) CROSS JOIN (SELECT unnest(['x', 'tax', 'returned', 'volume', 'mom', 'vol']) AS metric) m)
        WHERE v IS NOT NULL WINDOW g AS (PARTITION BY date, sector, metric)) WHERE n >= 3"""),
    "after": ("resid at6 cal", """SELECT date, ticker, horizon, round(y, 9) AS resid FROM (SELECT a.date, h.horizon, r.ticker, product(1 + r.resid) - 1 AS y, count(*) AS k FROM at6 a CROSS JOIN (SELECT unnest([4, 8]) AS horizon) h JOIN cal c ON c.i > a.i AND c.i <= a.i + h.horizon
        JOIN resid r ON r.date = c.date WHERE r.resid IS NOT NULL AND a.i + h.horizon <= (SELECT max(i) FROM cal) GROUP BY 1, 2, 3) WHERE k >= horizon // 2 QUALIFY count(*) OVER (PARTITION BY date, horizon) >= 10"""),
    "side6": ("after", "SELECT ticker, date, horizon, CASE WHEN up <= k THEN 1 ELSE -1 END AS side FROM (SELECT *, row_number() OVER (PARTITION BY date, horizon ORDER BY resid DESC, ticker) AS up, count(*) OVER (PARTITION BY date, horizon) AS n, greatest(1, floor(count(*) OVER (PARTITION BY date, horizon) * 0.1)) AS k FROM after) WHERE up <= k OR up > n - k"),
    "wgt": ("rank6 side6", """SELECT conservative, metric, avg, t, greatest(t, 0) / sum(greatest(t, 0)) OVER (PARTITION BY conservative) AS weight FROM (SELECT *, median(avg) OVER w AS ma, median(t) OVER w AS mt FROM (
        SELECT conservative, metric, avg(a) AS avg, avg(t) AS t FROM (SELECT year(date) IN (1996, 1997) AS conservative, metric, horizon, avg(z) AS a, avg(z) / nullif(stddev_samp(z) / sqrt(count(*)), 0) AS t FROM (
          SELECT s.date, s.horizon, r.metric, (median(r.r) FILTER (s.side = 1) - median(r.r) FILTER (s.side = -1)) / any_value(d.sd) AS z FROM side6 s JOIN rank6 r USING (ticker, date)
          JOIN (SELECT date, metric, stddev_samp(r) AS sd FROM rank6 GROUP BY 1, 2) d ON d.date = s.date AND d.metric = r.metric WHERE d.sd > 0 GROUP BY 1, 2, 3) WHERE z IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2) GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY conservative)) WHERE avg > 0 AND avg > ma AND t > mt"""),
    "mix6": ("cs at6 rank6 wgt", """SELECT n.ticker, n.date, CASE WHEN (SELECT bool_or(NOT conservative) FROM wgt) THEN coalesce(g, 0) END AS g, CASE WHEN (SELECT bool_or(conservative) FROM wgt) THEN coalesce(c, 0) END AS c
        FROM (SELECT DISTINCT ticker, date FROM cs JOIN at6 USING (date)) n LEFT JOIN (SELECT ticker, date, sum(weight * r) FILTER (NOT conservative) AS g, sum(weight * r) FILTER (conservative) AS c FROM rank6 JOIN wgt USING (metric) GROUP BY 1, 2) s USING (ticker, date)"""),
    "reg6": ("nav at6", " UNION ALL ".join(f"""SELECT {n} AS win, {t}::DOUBLE AS threshold, a.date, coalesce((SELECT arg_max(q, date) FROM (
        SELECT date, CASE WHEN m IS NULL THEN 0.5 WHEN v - m > {t} THEN 1.0 WHEN v - m < -{t} THEN 0.0 ELSE 0.5 END AS q FROM (SELECT date, nav * 100 AS v, CASE WHEN count(*) OVER w >= {n // 2} THEN avg(nav * 100) OVER w END AS m FROM nav WINDOW w AS (ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))) x WHERE x.date <= a.date), 0.5) AS q FROM at6 a""" for n, t in _REGIMES)),
    "side7": ("after mix6", "SELECT ticker, date, horizon, CASE WHEN up <= k THEN 1 ELSE -1 END AS side FROM (SELECT *, row_number() OVER (PARTITION BY date, horizon ORDER BY resid DESC, ticker) AS up, count(*) OVER (PARTITION BY date, horizon) AS n, greatest(1, floor(count(*) OVER (PARTITION BY date, horizon) * 0.1)) AS k FROM after JOIN (SELECT ticker, date FROM mix6 WHERE g IS NOT NULL AND c IS NOT NULL) USING (ticker, date)) WHERE n >= 10 AND (up <= k OR up > n - k)"),
}

def _eight(metric: str, table: str) -> str:
    return f"""SELECT ticker, date, k, last_value(v IGNORE NULLS) OVER (PARTITION BY ticker, date ORDER BY k) AS value FROM (
        SELECT w.ticker, w.date, t.k, arg_max(f.{metric}, f.download) AS v FROM want w CROSS JOIN (SELECT unnest(range(-8, 0)) AS k) t LEFT JOIN {table} f ON f.ticker = w.ticker AND f.period = w.feq + t.k GROUP BY 1, 2, 3)"""


_G = "(n.value - o.value) / nullif(abs((n.value + o.value) / 2), 0)"
CTE |= {
    "f1": ("", """SELECT CAST(l_suppkey AS VARCHAR) AS ticker, year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS period, CAST(date_trunc('month', o_orderdate) AS DATE) AS download,
        sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS gross, sum(l_quantity)::DOUBLE AS shares FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3"""),
    "q8e": ("want f0", _eight("profit", "f0")),
    "q8g": ("want f1", _eight("gross", "f1")),
    "q8s": ("want f1", _eight("shares", "f1")),
    "val": ("q8 q8e q8g q8s q4 filled", f"""SELECT *, round(gs / vol, 2) AS gs_adj FROM (SELECT s.ticker, s.date, s.shares * p.close AS cap, s.shares * p.close AS c0, m.m AS m_ps, e.m AS m_pe, h.m AS m_pgp, g.gs, coalesce(v.vol, 1.0) AS vol FROM (SELECT ticker, date, arg_max(value, k) FILTER (value IS NOT NULL) AS shares FROM q8s GROUP BY 1, 2) s
        JOIN (SELECT w.ticker, w.date, arg_max(f.close, f.date) AS close FROM want w JOIN filled f ON f.ticker = w.ticker AND f.date <= w.date WHERE f.close IS NOT NULL GROUP BY 1, 2) p USING (ticker, date)
        LEFT JOIN (SELECT ticker, date, median(nullif(value, 0)) AS m FROM q8 GROUP BY 1, 2) m USING (ticker, date) LEFT JOIN (SELECT ticker, date, median(nullif(value, 0)) AS m FROM q8e GROUP BY 1, 2) e USING (ticker, date) LEFT JOIN (SELECT ticker, date, median(nullif(value, 0)) AS m FROM q8g GROUP BY 1, 2) h USING (ticker, date)
        LEFT JOIN (SELECT ticker, date, CASE WHEN count(g) >= 2 THEN greatest(stddev_samp(g) / 10, 1) ELSE 1.0 END AS vol FROM (SELECT n.ticker, n.date, round(100 * {_G}, 1) AS g FROM (SELECT * FROM q8 WHERE k >= -4 UNION ALL SELECT * FROM q4 WHERE value IS NOT NULL) n JOIN q8 o ON o.ticker = n.ticker AND o.date = n.date AND o.k = n.k - 4) GROUP BY 1, 2) v USING (ticker, date)
        LEFT JOIN (SELECT a.ticker, a.date, round(100 * CASE WHEN f.n > 0 THEN (f.n / 2.0 * f.forward + a.actual) / (f.n / 2.0 + 1) ELSE a.actual END, 2) AS gs FROM (
          SELECT n.ticker, n.date, median({_G}) AS actual FROM q8 n JOIN q8 o ON o.ticker = n.ticker AND o.date = n.date AND o.k = n.k - 4 WHERE n.k >= -4 GROUP BY 1, 2) a LEFT JOIN (
          SELECT n.ticker, n.date, median({_G}) AS forward, count({_G}) AS n FROM q4 n JOIN q8 o ON o.ticker = n.ticker AND o.date = n.date AND o.k = n.k - 4 WHERE n.value IS NOT NULL GROUP BY 1, 2) f USING (ticker, date)) g USING (ticker, date))"""),
}
_MULTIPLES = ("ps", "pe", "pgp")
_QUINTILE = "CASE WHEN {c} > 0 AND count(CASE WHEN {c} > 0 THEN 1 END) OVER (PARTITION BY date) > 1 THEN greatest(1, ceil((row_number() OVER (PARTITION BY date ORDER BY CASE WHEN {c} > 0 THEN {c} END NULLS LAST, ticker) - 1) * 5 / (count(CASE WHEN {c} > 0 THEN 1 END) OVER (PARTITION BY date) - 1))) END"


def _compared(a: str, b: str) -> str:
    """The figures of two paths over the dates of both."""
    line = """SELECT '{name}' AS portfolio, total, years, cagr, vol, cagr / nullif(vol, 0) AS sharpe, max_drawdown, l AS final, ahead FROM (SELECT l / f - 1 AS total, days / 365.25 AS years, pow(l / f, 365.25 / days) - 1 AS cagr, vol, max_drawdown, l, ahead FROM (
        SELECT arg_min(nav, date) AS f, arg_max(nav, date) AS l, date_diff('day', min(date), max(date)) AS days, stddev_samp(r) * sqrt(52) AS vol, min(dd) AS max_drawdown, 100.0 * avg(CAST(nav > other AS INT)) AS ahead FROM (
          SELECT date, nav, other, nav / lag(nav) OVER (ORDER BY date) - 1 AS r, nav / max(nav) OVER (ORDER BY date) - 1 AS dd FROM (SELECT x.date, x.nav, y.nav AS other FROM ({own}) x JOIN ({other}) y USING (date)))))"""
    return line.format(name="baseline", own=a, other=b) + " UNION ALL " + line.format(name="alternative", own=b, other=a)


_PLAIN = "SELECT date, ticker, 0.05 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor DESC, ticker) AS rank FROM fac WHERE factor IS NOT NULL QUALIFY count(*) OVER (PARTITION BY date) >= 20) WHERE rank <= 20"
_CAPPED = """SELECT date, ticker, 0.05 AS weight FROM (SELECT r.date, r.ticker, row_number() OVER (PARTITION BY r.date ORDER BY r.factor DESC, r.ticker) AS rank FROM ranked r JOIN (
        SELECT date, min(c) AS c FROM (SELECT r.date, t.c FROM ranked r CROSS JOIN (SELECT unnest(range(5, 21)) AS c) t GROUP BY 1, 2 HAVING count(*) FILTER (r.s <= t.c) >= 20) GROUP BY date) m USING (date) WHERE r.s <= m.c) WHERE rank <= 20"""
CTE["sicp"] = (CTE["sic"][0], CTE["sic"][1].replace("FROM sig WHERE x IS NOT NULL", "FROM (SELECT * REPLACE (round(x - 0.04, 9) AS x) FROM sig) WHERE x > 0"))
CTE["ranked"] = ("fac", "SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY factor DESC, ticker) AS s FROM fac WHERE factor IS NOT NULL QUALIFY count(*) OVER (PARTITION BY date) >= 20")

_SCORED = "SELECT ticker, date, (m - avg(m) OVER d) / nullif(stddev_samp(m) OVER d, 0) AS momentum FROM ({}) WHERE m IS NOT NULL WINDOW d AS (PARTITION BY date) QUALIFY count(*) OVER (PARTITION BY date) >= 5"
_WINDOW = "PARTITION BY ticker ORDER BY date ROWS BETWEEN"

SQL: dict[str, str] = {
    "growth_value_first": _sql("val q8 sec", "ticker date", "factor", f"""SELECT ticker, date, g / nullif(list_median, 0) AS factor FROM (SELECT ticker, date, g, q_ps, q_pe, q_pgp, list_aggregate([{', '.join(f'q_{c}::DOUBLE' for c in _MULTIPLES)}], 'median') AS list_median FROM (
        SELECT ticker, date, gs - median(gs) OVER (PARTITION BY date, sector) AS g, {', '.join(_QUINTILE.format(c=c) + f' AS q_{c}' for c in _MULTIPLES)} FROM (
          SELECT v.ticker, v.date, s.sector, h.gs, {', '.join(f'round(1000 * c0 / nullif(4 * m_{c}, 0), 2) AS {c}' for c in _MULTIPLES)} FROM val v JOIN sec s USING (ticker)
          LEFT JOIN (SELECT n.ticker, n.date, round(100 * median({_G}), 2) AS gs FROM q8 n JOIN q8 o ON o.ticker = n.ticker AND o.date = n.date AND o.k = n.k - 4 GROUP BY 1, 2) h USING (ticker, date)))
        WHERE q_ps IS NOT NULL AND q_pe IS NOT NULL AND q_pgp IS NOT NULL) WHERE g / nullif(list_median, 0) IS NOT NULL"""),
    "momentum_raw_volume": _sql("resid", "ticker date", "momentum", _SCORED.format(f"""SELECT ticker, date, CASE WHEN i >= 254 THEN coalesce(sum(resid * q) OVER ({_WINDOW} 252 PRECEDING AND 22 PRECEDING), 0) END AS m FROM (
        SELECT *, CASE WHEN i > 10 AND v / prior IS NOT NULL THEN greatest(0.5, least(3.0, v / prior)) END AS q FROM (SELECT *, nullif(avg(v) OVER ({_WINDOW} 10 PRECEDING AND 1 PRECEDING), 0) AS prior FROM (
          SELECT *, last_value(nullif(volume, 0) IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date) AS v FROM resid)))""")),
    "momentum_at_rebalance": _sql("resid score", "ticker date", "momentum", _SCORED.format(f"""SELECT * FROM (SELECT ticker, date, CASE WHEN i >= 254 THEN coalesce(sum(resid * q) OVER ({_WINDOW} 252 PRECEDING AND 22 PRECEDING), 0) END AS m FROM (
        SELECT *, volume / nullif(avg(volume) OVER ({_WINDOW} 9 PRECEDING AND CURRENT ROW), 0) AS q FROM resid)) SEMI JOIN score USING (ticker, date)""")),
    "size_equality_filled": _sql("dense wk", "ticker date", "size", """SELECT ticker, date, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date), first_value(s IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS size FROM (
        SELECT d.ticker, d.date, q.s FROM dense d LEFT JOIN (SELECT ticker, CAST(date_trunc('quarter', date) AS DATE) AS date, sum(amount) AS s FROM wk GROUP BY 1, 2) q ON q.ticker = d.ticker AND q.date = d.date)"""),
    "complete_dates": _sql("ret", "date kept", "", "SELECT date, 'all' AS kept FROM ret GROUP BY date HAVING bool_and(ret IS NOT NULL) UNION ALL SELECT date, 'some' FROM ret GROUP BY date HAVING bool_or(ret IS NOT NULL)"),
    "quality_snapshot": _sql("cs", "ticker date sector", "x tax returned by_vol by_r2", """SELECT 'N' || ticker AS ticker, date, sector, x, tax, returned, x / greatest(volume, 1) AS by_vol, tax * returned AS by_r2 FROM (
        SELECT * REPLACE (round(tax, 9) AS tax, round(returned, 9) AS returned) FROM cs WHERE date = DATE '1995-01-02')"""),
    "ticker_suffix": "SELECT s_suppkey AS id, upper(s_name) || ' US' AS marked, upper(s_name) AS bare FROM supplier",
    "valuation_metrics": _sql("val", "ticker date", "cap ps pe pgp gs gs_vol gs_adj", "SELECT ticker, date, cap, " + ", ".join(f"round(c0 / nullif(4 * m_{c}, 0), 2) * 1000 AS {c}" for c in _MULTIPLES) + ", gs, round(vol, 3) AS gs_vol, gs_adj FROM val"),
    "growth_value": _sql("val sec", "ticker date", "factor", f"""SELECT ticker, date, g / nullif(list_median, 0) AS factor FROM (SELECT ticker, date, g, list_aggregate(list_filter([{', '.join(f'q_{c}::DOUBLE' for c in _MULTIPLES)}], lambda z: z IS NOT NULL), 'median') AS list_median FROM (
        SELECT ticker, date, gs_adj - median(gs_adj) OVER (PARTITION BY date, sector) AS g, {', '.join(_QUINTILE.format(c=c) + f' AS q_{c}' for c in _MULTIPLES)} FROM (
          SELECT v.ticker, v.date, s.sector, v.gs_adj, {', '.join(f'round(1000 * c0 / nullif(4 * m_{c}, 0), 2) AS {c}' for c in _MULTIPLES)} FROM val v JOIN sec s USING (ticker)))) WHERE g / nullif(list_median, 0) IS NOT NULL"""),
    "nav_daily": _sql("capped filled cal", "date", "nav", """SELECT date, product(1 + coalesce(r, 0)) OVER (ORDER BY date) AS nav FROM (SELECT d.date, avg(x.r) AS r FROM (
          SELECT c.date, s.start, s.next FROM cal c JOIN (SELECT date AS start, lead(date) OVER (ORDER BY date) AS next FROM (SELECT DISTINCT date FROM capped)) s ON c.date >= s.start AND (s.next IS NULL OR c.date < s.next)) d
        LEFT JOIN (SELECT start, date, coalesce(p / nullif(lag(p) OVER (PARTITION BY start, ticker ORDER BY date), 0) - 1, 0) AS r FROM (
          SELECT h.date AS start, h.ticker, c.date, last_value(f.close IGNORE NULLS) OVER (PARTITION BY h.date, h.ticker ORDER BY c.date) AS p FROM capped h JOIN (SELECT date AS start, lead(date) OVER (ORDER BY date) AS next FROM (SELECT DISTINCT date FROM capped)) s ON s.start = h.date
          JOIN cal c ON c.date >= s.start AND (s.next IS NULL OR c.date < s.next) LEFT JOIN filled f ON f.ticker = h.ticker AND f.date = c.date)) x ON x.date = d.date GROUP BY d.date)"""),
    "backtest_compared": _sql("cal filled reb fac ranked", "portfolio", "total years cagr vol sharpe max_drawdown final ahead", _compared(_backtest(_PLAIN), _backtest(_CAPPED))),
    "dynamic_size_backfilled": _sql("px", "ticker date", "cap", """SELECT p.ticker, p.date, coalesce(coalesce(s.size, b.size) / nullif(CASE WHEN s.size IS NULL THEN b.snap ELSE s.snap END, 0) * p.close, s.size, b.size) / 1e6 AS cap FROM px p ASOF LEFT JOIN snaps s ON p.ticker = s.ticker AND p.date >= s.date
        LEFT JOIN (SELECT ticker, arg_min(size, date) AS size, arg_min(snap, date) AS snap FROM snaps GROUP BY ticker) b ON b.ticker = p.ticker""").replace(" SELECT ticker, date, CASE", ", snaps AS (SELECT g.ticker, g.date, g.size, px.close AS snap FROM (SELECT ticker, max(date) AS date, sum(amount) AS size FROM px WHERE date >= DATE '1993-01-01' GROUP BY ticker, date_trunc('quarter', date)) g LEFT JOIN px USING (ticker, date)) SELECT ticker, date, CASE", 1),
    "ic_positive": _sql("sicp", "date n", "ic", "FROM sicp"),
    "portfolio_risk": _sql("beta lam perp1", "", "factor_risk idio_risk total", f"""SELECT sqrt(f) AS factor_risk, sqrt(o) AS idio_risk, sqrt(f + o) AS total FROM (SELECT 52 * (bb * bb * vb + bs * bs * vs + 2 * bb * bs * c) AS f FROM (
          SELECT sum(beta / n) AS bb, sum(z / n) AS bs FROM (SELECT *, CASE WHEN beta IS NOT NULL THEN count(*) FILTER (beta IS NOT NULL) OVER () END AS n FROM (
            SELECT date, beta, coalesce((s - avg(s) OVER ()) / nullif(stddev_samp(s) OVER (), 0), 0) AS z FROM (SELECT date, beta, ln(greatest(coalesce(cap, 1), 1)) AS s FROM beta WHERE date = (SELECT max(date) FROM beta WHERE beta IS NOT NULL)))) WHERE beta IS NOT NULL) CROSS JOIN (
          SELECT (SELECT var_samp(slope) FROM lam) AS vb, (SELECT var_samp(b1) FROM ({solved('perp1', 'resid', ['perp'], 5)})) AS vs, (SELECT covar_samp(l.slope, r.b1) FROM lam l JOIN ({solved('perp1', 'resid', ['perp'], 5)}) r USING (date)) AS c)) CROSS JOIN (
        SELECT 52 * sum(v / n / n) AS o FROM (SELECT ticker, count(*) OVER () AS n FROM beta WHERE date = (SELECT max(date) FROM beta WHERE beta IS NOT NULL) AND beta IS NOT NULL) JOIN (SELECT ticker, var_samp(ret) AS v FROM ret GROUP BY 1 HAVING v IS NOT NULL) USING (ticker))"""),
    "regime_weights": _sql("wgt", "conservative metric", "avg t weight", "SELECT CAST(conservative AS INT) AS conservative, metric, avg, t, weight FROM wgt"),
    "regime_grid": _sql("side7 reg6", '"window" horizon n_dates', "threshold mean_spread_z t_stat consistency", """SELECT win AS "window", threshold, horizon, avg(z) AS mean_spread_z, avg(z) / nullif(stddev_samp(z) / sqrt(count(*)), 0) AS t_stat, 100.0 * avg(CAST(z > 0 AS INT)) AS consistency, count(*) AS n_dates FROM (
        SELECT r.win, r.threshold, s.date, s.horizon, (median(round((1 - r.q) * m.g + r.q * m.c, 12)) FILTER (s.side = 1) - median(round((1 - r.q) * m.g + r.q * m.c, 12)) FILTER (s.side = -1)) / any_value(d.sd) AS z FROM side7 s JOIN mix6 m USING (ticker, date) JOIN reg6 r ON r.date = s.date
        JOIN (SELECT r.win, r.threshold, r.date, stddev_samp(round((1 - r.q) * m.g + r.q * m.c, 12)) AS sd FROM mix6 m JOIN reg6 r USING (date) GROUP BY 1, 2, 3) d ON d.win = r.win AND d.threshold = r.threshold AND d.date = s.date WHERE d.sd > 0 GROUP BY 1, 2, 3, 4) WHERE z IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2"""),
    "resid_prices": _sql("afwd", "ticker date", "beta resid", f"SELECT ticker, anchor AS date, beta, y AS resid FROM ({_OFF.format(_PRICED, _betas(_PRICED))})"),
    "resid_prices_size": _sql("afwd size0", "ticker date", "beta resid", f"""SELECT ticker, anchor AS date, beta, y - sum(y * q) OVER (PARTITION BY anchor) / nullif(sum(q * q) OVER (PARTITION BY anchor), 0) * q AS resid FROM (
        SELECT *, z - avg(z) OVER (PARTITION BY anchor, sector) AS q FROM ({_OFF.format(_SIZED, _betas(_SIZED))}))"""),
    "resid_stored": _sql("resid", "ticker date", "resid", """SELECT ticker, anchor AS date, product(1 + resid) - 1 AS resid FROM (SELECT a.anchor, a.i, r.ticker, r.resid FROM (
          SELECT d.anchor, coalesce(max(c.i), 0) AS i FROM (SELECT CAST(unnest(generate_series(DATE '1992-03-15', DATE '1998-09-15', INTERVAL 3 MONTH)) AS DATE) AS anchor) d LEFT JOIN cal c ON c.date <= d.anchor GROUP BY 1) a
        JOIN cal c ON c.i > a.i AND c.i <= a.i + 8 JOIN resid r ON r.date = c.date WHERE r.resid IS NOT NULL AND a.i + 8 <= (SELECT max(i) FROM cal)) GROUP BY 1, 2 HAVING count(*) >= 4 QUALIFY count(*) OVER (PARTITION BY anchor) >= 10"""),
    "ou_diagnostic": _sql("resid dense", "ticker ou_valid final_rank", "ou_dist lt_mean mr_speed mr_halflife resid_vol st_reversal ou_weight ou_rank rev_rank final_score", """SELECT *, CASE WHEN final_score IS NOT NULL THEN rank() OVER (ORDER BY final_score DESC NULLS LAST) END AS final_rank FROM (
        SELECT *, (ou_weight * coalesce(ou_rank, 0) + rev_rank) / (ou_weight + 1) AS final_score FROM (
          SELECT *, CASE WHEN ou_valid = 1 THEN least(30 / mr_halflife, 10) ELSE 0.0 END AS ou_weight, CASE WHEN ou_dist IS NOT NULL THEN CASE WHEN count(ou_dist) OVER () > 1 THEN (rank() OVER (ORDER BY ou_dist DESC NULLS LAST) + (count(*) OVER (PARTITION BY ou_dist) - 1) / 2.0 - 1) / (count(ou_dist) OVER () - 1) ELSE 0.5 END END AS ou_rank,
            CASE WHEN st_reversal IS NOT NULL THEN CASE WHEN count(st_reversal) OVER () > 1 THEN (rank() OVER (ORDER BY st_reversal DESC NULLS LAST) + (count(*) OVER (PARTITION BY st_reversal) - 1) / 2.0 - 1) / (count(st_reversal) OVER () - 1) ELSE 0.5 END END AS rev_rank FROM (
            SELECT u.ticker, CAST(coalesce(ok, false) AS INT) AS ou_valid, CASE WHEN ok THEN round((px - mu) / (sd / sqrt(2 * k)), 4) END AS ou_dist, CASE WHEN ok THEN mu END AS lt_mean, CASE WHEN ok THEN k END AS mr_speed, CASE WHEN ok THEN round(ln(2) / k, 1) END AS mr_halflife, CASE WHEN ok THEN sd END AS resid_vol, v.st_reversal
            FROM (SELECT DISTINCT ticker FROM resid) u LEFT JOIN (
              SELECT *, coalesce(n >= 30 AND p0 > 0 AND px > 0 AND k IS NOT NULL AND sd <> 0 AND mu > 0, false) AS ok FROM (
                SELECT f.ticker, n, px, (SELECT arg_min(close, date) FROM dense d WHERE d.ticker = f.ticker AND d.date >= f.d0 AND d.close IS NOT NULL) AS p0, CASE WHEN b > 0 AND b < 1 THEN -ln(b) END AS k, a / (1 - b) * px / xl AS mu, sqrt(greatest(syy - b * sxy, 0) / m) * px / xl AS sd FROM (
                  SELECT ticker, count(*) AS n, min(date) AS d0, arg_max(x, date) AS xl, regr_slope(x, q) AS b, regr_intercept(x, q) AS a, regr_syy(x, q) AS syy, regr_sxy(x, q) AS sxy, regr_count(x, q) AS m FROM (
                    SELECT *, lag(x) OVER (PARTITION BY ticker ORDER BY date) AS q FROM (SELECT ticker, date, product(1 + r) OVER (PARTITION BY ticker ORDER BY date) AS x FROM (
                      SELECT * FROM scaled WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 60))) GROUP BY ticker) f
                LEFT JOIN (SELECT ticker, arg_max(close, date) AS px FROM dense WHERE close IS NOT NULL GROUP BY ticker) z USING (ticker))) o USING (ticker)
            LEFT JOIN (SELECT ticker, sum(ln(1 + coalesce(r, 0))) AS st_reversal FROM scaled WHERE date IN (SELECT DISTINCT date FROM resid ORDER BY date DESC LIMIT 21) GROUP BY ticker) v USING (ticker))))""".replace("SELECT *, CASE WHEN final_score", """WITH scaled AS (SELECT ticker, date, CASE WHEN count(s) OVER (PARTITION BY ticker) > 0 THEN resid / CASE WHEN h IS NOT NULL THEN greatest(0.5, least(3.0, h)) END ELSE resid END AS r FROM (
          SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date) AS h FROM (SELECT ticker, date, resid, CASE WHEN c IS NOT NULL THEN greatest(0.5, least(3.0, c)) END AS s FROM (SELECT *, volume / nullif(avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0) AS c FROM resid))))
        SELECT *, CASE WHEN final_score""", 1)),
    "interaction_test": _sql("rnk", "n significant", "coef t p gain", _interaction("every", "every")),
    "interaction_by_year": _sql("rnk", "year n significant", "coef t p gain", _interaction("year", "year")),
    "two_phase_ics": _sql("rnk", "factor n selected", "ic", " UNION ALL ".join(f"SELECT '{c}' AS factor, count(*) AS n, corr({c}, ry) AS ic, CAST(abs(corr({c}, ry)) > 0.01 AS INT) AS selected FROM rnk" for c in _XTR)),
    "two_phase_model": _sql("rnk", "n factor", "r2 coef error t p", " UNION ALL ".join(_SECOND)),
    "two_phase_resid": _sql("rnk", "ticker date", "resid", f"SELECT r.ticker, r.date, r.dem - f.b0{''.join(f' - f.b{j} * r.{c}' for j, c in enumerate([*_XTR, *_HOT], 1))} AS resid FROM rnk r CROSS JOIN ({solved('(SELECT * REPLACE (0 AS date) FROM rnk)', 'dem', [*_XTR, *_HOT], 1, '1.0')}) f"),
    "feq_first_change": _sql("want f0", "ticker date feq", "", """SELECT * FROM (SELECT n.ticker, n.date, coalesce(min(c.period) FILTER (c.v0 <> c.v1), min(c.period) FILTER (c.v0 IS NULL AND c.v1 IS NOT NULL))::BIGINT AS feq FROM (
        SELECT w.ticker, w.date, max(f.download) FILTER (f.download <= w.date) AS before, min(f.download) FILTER (f.download > w.date) AS after FROM want w JOIN f0 f ON f.ticker = w.ticker GROUP BY 1, 2) n
        JOIN LATERAL (SELECT period, max(CASE WHEN f.download = n.before THEN round(revenue / 1e3, 1) END) AS v0, max(CASE WHEN f.download = n.after THEN round(revenue / 1e3, 1) END) AS v1 FROM f0 f WHERE f.ticker = n.ticker AND f.download IN (n.before, n.after) GROUP BY period) c ON true
        WHERE n.before IS NOT NULL AND n.after IS NOT NULL GROUP BY n.ticker, n.date HAVING count(c.v0) > 0) WHERE feq IS NOT NULL"""),
    "vol_comparison": _sql("ccv gkv", "", " ".join([*_VOL_FIGURES, "below", "missing"]), "SELECT " + ", ".join(f"{f}({c}) AS {c}_{n}" for c in ("vol", "gk", "ratio") for n, f in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max"))) + f", avg(CAST(ratio < 1 AS INT)) AS below, avg(CAST(gk IS NULL AS INT)) AS missing FROM ({_VOLS})"),
    "joint_2": _sql("sized", "date n", "intercept b_beta b_size r2", _named(solved("sized", "ret", _BS, 12), _BS)),
    "joint_3": _sql("three", "date n", "intercept b_beta b_size b_mom r2", _named(solved("three", "ret", _BSM, 12), _BSM)),
    "joint_3_resid": _sql("three", "date ticker", "resid", left("three", "ret", _BSM, 12)),
    "joint_3_ridge": _sql("three", "date n", "intercept b_beta b_size b_mom r2", _named(solved("three", "ret", _BSM, 12, ridge=0.4), _BSM)),
    "ridge_in_sample": _sql("sized", "date n", "intercept b_beta b_size r2 ridge", f"SELECT *, 0.05 AS ridge FROM ({_named(solved('sized', 'ret', _BS, 12, ridge=0.05), _BS)})"),
    "orthogonalize_plain": _sql("three", "ticker date", "perp", perp("three", "mom", _BS, 12, "1.0")),
    "orthogonalize_k": _sql("three", "ticker date", "perp", f"SELECT p.* FROM ({perp('three', 'mom', _BS, 5, 'w0')}) p WHERE perp IS NOT NULL"),
    "nested_sets": _sql("first", "step date n factor", "intercept r2 slope", " UNION ALL ".join(_long(s, solved("first", "ret", xs, 12), len(xs)) for s, xs in _SETS)),
    "nested_variance": _sql("first", "step n", "variance std", " UNION ALL ".join(f"SELECT '{s}' AS step, count(*) AS n, var_pop(resid) AS variance, stddev_pop(resid) AS std FROM ({left('first', 'ret', xs, 12)})" for s, xs in _SETS)),
    "first_model": _sql("first4", "step date n factor", "intercept r2 slope", " UNION ALL ".join([*(_long(s, solved("first", "ret", xs, 12), len(xs)) for s, xs in _SETS[:3]), _long("momentum", solved("first4", "ret", [*_SETS[2][1], "momentum"], 12), 7)])),
    "factor_chain": _sql("chain3", "factor date", "intercept slope r2", " UNION ALL ".join([_LINE.format("beta", solved("sized", "ret", ["beta"], 5)), _LINE.format("size", solved("perp1", "resid", ["perp"], 5)), _LINE.format("momentum", solved(_CHAIN3, "resid", ["perp"], 5))])),
}
SQL["model_by_date"] = SQL["factor_chain"]  # dates one by one give what all at once give

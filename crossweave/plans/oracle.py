"""SQL of the registered panel queries, for another engine over the same tables."""

from __future__ import annotations

#: Lifts exact halves off the rounding boundary, on both sides alike.
NUDGE = 1 + 3e-13
#: Doubles below this are compared to ten places, others to six.
SMALL = 0.01

#: Common table expressions; each query lists those it needs, after the ones they need.
CTE = {
    "wk": ("", """SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, avg(l_discount) AS disc, sum(l_quantity) AS volume,
        sum(l_extendedprice) AS amount, avg(l_tax) AS tax, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS returned, sum(l_extendedprice) / sum(l_quantity) AS raw_px FROM lineitem GROUP BY 1, 2"""),
    "sec": ("", "SELECT CAST(s_suppkey AS VARCHAR) AS ticker, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "cal": ("wk", "SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM wk)"),
    "px": ("wk", "SELECT *, 100 * exp(sum(disc - 0.05) OVER (PARTITION BY ticker ORDER BY date)) AS close FROM wk"),
    "dense": ("px cal", """SELECT u.ticker, c.date, c.i, p.disc, p.volume, p.amount, p.tax, p.returned, p.close FROM (SELECT DISTINCT ticker FROM px) u CROSS JOIN cal c LEFT JOIN px p ON p.ticker = u.ticker AND p.date = c.date"""),
    "filled": ("dense", "SELECT * REPLACE (last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date) AS close) FROM dense"),
    "r0": ("filled", "SELECT *, greatest(-0.5, least(0.5, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1)) AS r FROM filled"),
    "ret": ("r0", """SELECT *, CASE WHEN r IS NULL OR lc IS NULL THEN NULL ELSE r END AS ret, avg(CASE WHEN lc IS NULL THEN NULL ELSE r END) OVER (PARTITION BY date) AS mkt,
        sum(amount) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) / 1000 AS cap
        FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS lc FROM r0)"""),
    "cs": ("wk sec", "SELECT ticker, date, sector, round(disc, 9) AS x, tax, returned, volume FROM wk JOIN sec USING (ticker)"),
    "resid": ("ret", "SELECT *, ret - mkt AS resid FROM ret"),
    "beta": ("ret", """SELECT *, CASE WHEN n >= 126 AND gxx / g - (gx / g) * (gx / g) > 1e-18 THEN (gxy / g - gx / g * (gy / g)) / (gxx / g - (gx / g) * (gx / g)) END AS beta,
        CASE WHEN ln(greatest(coalesce(cap, 1), 1)) > 0 THEN ln(greatest(coalesce(cap, 1), 1)) ELSE 1.0 END AS w FROM (
        SELECT *, sum(e) OVER f AS g, sum(e * mkt) OVER f AS gx, sum(e * coalesce(ret, 0)) OVER f AS gy, sum(e * mkt * coalesce(ret, 0)) OVER f AS gxy, sum(e * mkt * mkt) OVER f AS gxx, count(*) OVER f AS n
        FROM (SELECT *, CASE WHEN mkt IS NOT NULL THEN exp(i * (ln(2) / 126)) END AS e FROM ret)
        WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING))"""),
    "known": ("beta", "SELECT * FROM beta WHERE ret IS NOT NULL AND beta IS NOT NULL QUALIFY count(*) OVER (PARTITION BY date) >= 5"),
    "lam": ("known", """SELECT date, sy / s - slope * (sx / s) AS intercept, slope, slope * (sxy / s - sx / s * (sy / s)) / (syy / s - (sy / s) * (sy / s)) AS r2 FROM (
        SELECT *, (sxy / s - sx / s * (sy / s)) / (sxx / s - (sx / s) * (sx / s)) AS slope FROM (
        SELECT date, sum(w) AS s, sum(w * beta) AS sx, sum(w * ret) AS sy, sum(w * beta * beta) AS sxx, sum(w * beta * ret) AS sxy, sum(w * ret * ret) AS syy FROM known GROUP BY date) WHERE sxx / s - (sx / s) * (sx / s) > 1e-14)"""),
    "res": ("known lam", "SELECT k.date, k.ticker, k.ret, k.ret - l.intercept - l.slope * k.beta AS resid FROM known k JOIN lam l USING (date)"),
    "vnorm": ("resid", """SELECT ticker, date, CASE WHEN y > -1 THEN y END AS r FROM (SELECT ticker, date, resid / CASE WHEN q IS NOT NULL THEN greatest(0.5, least(3.0, q)) END AS y FROM (SELECT *, vf / nullif(last_value(vm IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date), 0) AS q FROM (
        SELECT ticker, date, resid, last_value(volume IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date) AS vf, CASE WHEN count(volume) OVER t = 10 THEN avg(volume) OVER t END AS vm FROM resid WINDOW t AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))))"""),
    "nav": ("ret", "SELECT date, exp(sum(ln(1 + m)) OVER (ORDER BY date)) AS nav FROM (SELECT DISTINCT date, mkt AS m FROM ret WHERE mkt IS NOT NULL)"),
    "fwdc": ("ret", """SELECT ticker, date, CASE WHEN count(*) OVER f = 4 AND count(ret) OVER f >= 2 THEN product(1 + coalesce(ret, 0)) OVER f - 1 END AS fwd FROM ret
        WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)"""),
    "sig": ("cs fwdc", "SELECT c.*, round(f.fwd, 9) AS fwd FROM cs c JOIN fwdc f USING (ticker, date)"),
    "sic": ("sig", """SELECT date, sum(n * ic) / sum(n) AS ic, sum(n)::BIGINT AS n FROM (
        SELECT date, sector, corr(rs, rt) AS ic, count(*) AS n FROM (
          SELECT *, rank() OVER (PARTITION BY date, sector ORDER BY s) + (count(*) OVER (PARTITION BY date, sector, s) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY date, sector ORDER BY t) + (count(*) OVER (PARTITION BY date, sector, t) - 1) / 2.0 AS rt FROM (
            SELECT *, greatest(xl, least(xh, x)) AS s, greatest(fl, least(fh, fwd)) AS t FROM (
              SELECT *, quantile_cont(x, 0.01) OVER v AS xl, quantile_cont(x, 0.99) OVER v AS xh, quantile_cont(fwd, 0.01) OVER v AS fl, quantile_cont(fwd, 0.99) OVER v AS fh
              FROM (SELECT * FROM sig WHERE x IS NOT NULL AND fwd IS NOT NULL QUALIFY count(*) OVER (PARTITION BY date, sector) >= 5) WINDOW v AS (PARTITION BY date, sector)))) GROUP BY date, sector)
        WHERE ic IS NOT NULL AND NOT isnan(ic) GROUP BY date"""),
    "ric": ("sig", """SELECT date, CASE WHEN count(*) >= 10 THEN corr(s, t) END AS ic FROM (
        SELECT date, (rank() OVER (PARTITION BY date, sector ORDER BY x) + (count(*) OVER (PARTITION BY date, sector, x) - 1) / 2.0) / count(*) OVER (PARTITION BY date, sector) AS s,
               (rank() OVER (PARTITION BY date, sector ORDER BY fwd) + (count(*) OVER (PARTITION BY date, sector, fwd) - 1) / 2.0) / count(*) OVER (PARTITION BY date, sector) AS t
        FROM sig WHERE x IS NOT NULL AND fwd IS NOT NULL) GROUP BY date"""),
    "spread": ("sig", """SELECT date, metric, top, bottom, n, (top - bottom) / nullif(sd, 0) AS spread_z FROM (
        SELECT date, metric, median(value) FILTER (up <= k) AS top, median(value) FILTER (down <= k) AS bottom, stddev_samp(value) AS sd, count(*) AS n FROM (
          SELECT *, row_number() OVER (PARTITION BY date, metric ORDER BY fwd DESC, ticker) AS up, row_number() OVER (PARTITION BY date, metric ORDER BY fwd, ticker) AS down, greatest(1, floor(count(*) OVER (PARTITION BY date, metric) * 0.1)) AS k FROM (
            SELECT ticker, date, fwd, 'x' AS metric, x AS value FROM sig UNION ALL SELECT ticker, date, fwd, 'tax', round(tax, 9) FROM sig
            UNION ALL SELECT ticker, date, fwd, 'returned', returned FROM sig UNION ALL SELECT ticker, date, fwd, 'volume', volume FROM sig UNION ALL SELECT ticker, date, fwd, 'ahead', round(fwd + x, 9) FROM sig) WHERE value IS NOT NULL AND fwd IS NOT NULL) GROUP BY date, metric)"""),
    "f0": ("", """SELECT CAST(l_suppkey AS VARCHAR) AS ticker, year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS period, CAST(date_trunc('month', o_orderdate) AS DATE) AS download,
        sum(l_extendedprice) AS revenue, sum(l_extendedprice * (1 - l_discount)) AS profit FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3"""),
    "want": ("sec", "SELECT ticker, CAST(d AS DATE) AS date, year(d) * 4 + quarter(d) - 1 AS feq FROM sec CROSS JOIN (SELECT unnest(generate_series(DATE '1994-01-01', DATE '1997-01-01', INTERVAL 6 MONTH)) AS d)"),
    "q8": ("want f0", """SELECT ticker, date, k, last_value(v IGNORE NULLS) OVER (PARTITION BY ticker, date ORDER BY k) AS value FROM (
        SELECT w.ticker, w.date, t.k, arg_max(f.revenue, f.download) AS v FROM want w CROSS JOIN (SELECT unnest(range(-8, 0)) AS k) t LEFT JOIN f0 f ON f.ticker = w.ticker AND f.period = w.feq + t.k GROUP BY 1, 2, 3)"""),
    "q4": ("want f0", """SELECT w.ticker, w.date, t.k, arg_max(f.revenue, f.download) AS value FROM want w CROSS JOIN (SELECT unnest(range(0, 4)) AS k) t
        JOIN f0 f ON f.ticker = w.ticker AND f.period = w.feq + t.k AND f.download <= w.date GROUP BY 1, 2, 3"""),
    "reb": ("cal", "SELECT DISTINCT (SELECT min(date) FROM cal WHERE date >= t.d) AS date FROM (SELECT CAST(unnest(generate_series(DATE '1993-01-10', (SELECT max(date) FROM cal), INTERVAL 60 DAY)) AS DATE) AS d) t"),
    "score": ("cs reb", "SELECT ticker, date, sector, x AS score FROM cs SEMI JOIN reb USING (date)"),
    "fac": ("score ret filled", """SELECT s.ticker, s.date, s.sector, s.score AS factor, v.cap, v.rvol, v.momentum FROM score s LEFT JOIN (
        SELECT r.ticker, r.date, r.cap, stddev_samp(r.ret) OVER (PARTITION BY r.ticker ORDER BY r.date ROWS BETWEEN 124 PRECEDING AND CURRENT ROW) * sqrt(252) AS rvol, lag(f.close, 4) OVER w / lag(f.close, 26) OVER w - 1 AS momentum
        FROM ret r JOIN filled f ON f.ticker = r.ticker AND f.date = r.date WINDOW w AS (PARTITION BY r.ticker ORDER BY r.date)) v USING (ticker, date)"""),
    "facs": ("fac", "SELECT * FROM fac WHERE month(date) NOT IN (3, 4)"),
    "rk": ("score", "SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rank, row_number() OVER (PARTITION BY date, sector ORDER BY score DESC, ticker) AS s FROM score"),
    "capped": ("rk", """SELECT ticker, date, rank FROM (SELECT r.ticker, r.date, row_number() OVER (PARTITION BY r.date ORDER BY r.score DESC, r.ticker) AS rank FROM rk r JOIN (
        SELECT date, min(c) AS c FROM (SELECT r.date, t.c FROM rk r CROSS JOIN (SELECT unnest(range(3, 21)) AS c) t GROUP BY 1, 2 HAVING count(*) FILTER (r.s <= t.c) >= 20 UNION ALL SELECT DISTINCT date, 20 FROM rk) GROUP BY date) m USING (date) WHERE r.s <= m.c) WHERE rank <= 20"""),
    "bt": ("capped filled", """SELECT d.date, b.base * d.growth AS nav FROM (
          SELECT h.start, h.next, p.date, 1 + sum(h.weight * coalesce(p.close / p0.close - 1, 0)) AS growth FROM (
            SELECT date AS start, ticker, 1.0 / count(*) OVER (PARTITION BY date) AS weight, (SELECT min(c2.date) FROM capped c2 WHERE c2.date > capped.date) AS next FROM capped) h
          JOIN filled p0 ON p0.ticker = h.ticker AND p0.date = h.start JOIN filled p ON p.ticker = h.ticker AND p.date >= h.start AND p.date <= coalesce(h.next, DATE '9999-12-31') GROUP BY 1, 2, 3) d
        JOIN (SELECT start, coalesce(exp(sum(ln(growth)) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0) AS base FROM (
          SELECT h.start, 1 + sum(h.weight * coalesce(p.close / p0.close - 1, 0)) AS growth FROM (
            SELECT date AS start, ticker, 1.0 / count(*) OVER (PARTITION BY date) AS weight, coalesce((SELECT min(c2.date) FROM capped c2 WHERE c2.date > capped.date), date) AS next FROM capped) h
          JOIN filled p0 ON p0.ticker = h.ticker AND p0.date = h.start JOIN filled p ON p.ticker = h.ticker AND p.date = h.next GROUP BY 1)) b USING (start) WHERE d.next IS NULL OR d.date < d.next"""),
}


def _t(c: str) -> str:
    return f"avg({c}) / nullif(stddev_samp({c}) / sqrt(count({c})), 0)"


def _pos(c: str) -> str:
    return f"avg(CASE WHEN {c} > 0 THEN 100.0 WHEN {c} IS NOT NULL THEN 0.0 END)"


def _summary(key: str) -> str:
    return f"SELECT {key}, n, mean, std, t, positive, mean / nullif(std, 0) AS ir FROM (SELECT {key}, count(ic) AS n, avg(ic) AS mean, stddev_samp(ic) AS std, {_t('ic')} AS t, {_pos('ic')} AS positive FROM src GROUP BY {key}) WHERE n >= 2"


def _needs(name: str, seen: dict[str, str]) -> None:
    needs, body = CTE[name]
    for other in needs.split():
        if other not in seen:
            _needs(other, seen)
    seen[name] = body


def _sql(ctes: str, keys: str, doubles: str, body: str) -> str:
    """keys: columns as they are; doubles: rounded to six places, small ones to ten."""
    seen: dict[str, str] = {}
    for name in ctes.split():
        if name not in seen:
            _needs(name, seen)
    head = "WITH " + ", ".join(f"{k} AS ({v})" for k, v in seen.items()) + " " if seen else ""
    columns = [*keys.split(), *(f"CASE WHEN abs(CAST({c} AS DOUBLE)) < {SMALL} THEN round(CAST({c} AS DOUBLE) * {NUDGE!r}, 10) ELSE round(CAST({c} AS DOUBLE) * {NUDGE!r}, 6) END + 0.0 AS {c}" for c in doubles.split())]
    return f"{head}SELECT {', '.join(columns)} FROM ({body})"


_TD = "ticker date"
_R01 = "CASE WHEN n >= {least} AND {x} IS NOT NULL THEN CASE WHEN n > 1 THEN (rank() OVER (PARTITION BY {p} ORDER BY {x} {o}) + (count(*) OVER (PARTITION BY {p}, {x}) - 1) / 2.0 - 1) / (n - 1) ELSE {one} END END"

def _backtest(picked: str) -> str:
    """Value of the names picked (date, ticker, weight) for each date of `src`, from date to date."""
    return f"""WITH src AS (SELECT r.date AS start, lead(r.date) OVER (ORDER BY r.date) AS next, (SELECT max(f.date) FROM fac f WHERE f.date <= r.date) AS source FROM reb r WHERE r.date IS NOT NULL),
        held AS (SELECT s.start, p.ticker, p.weight, q.close AS p0 FROM src s JOIN ({picked}) p ON p.date = s.source LEFT JOIN filled q ON q.ticker = p.ticker AND q.date = s.start),
        path AS (SELECT s.start, s.next, c.date, 1 + coalesce(sum(h.weight * coalesce(q.close / h.p0 - 1, 0)), 0) AS growth FROM src s JOIN cal c ON c.date >= s.start AND c.date <= coalesce(s.next, DATE '9999-12-31')
          LEFT JOIN held h ON h.start = s.start LEFT JOIN filled q ON q.ticker = h.ticker AND q.date = c.date GROUP BY 1, 2, 3),
        base AS (SELECT start, coalesce(product(e) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS base FROM (SELECT start, max(growth) FILTER (date = next) AS e FROM path GROUP BY start))
        SELECT p.date, b.base * p.growth AS nav FROM path p JOIN base b USING (start) WHERE p.next IS NULL OR p.date < p.next"""


SQL: dict[str, str] = {
    "panel_dense": _sql("dense", "ticker date i", "close", "FROM dense"),
    "ticker_clean": "SELECT s_suppkey AS id, upper(string_split(trim(' ' || regexp_replace(lower(s_name), '#', ' us #', 'g')), ' ')[1]) AS ticker FROM supplier",
    "returns_clipped": _sql("ret", _TD, "ret mkt", "FROM ret WHERE ret IS NOT NULL"),
    "ffill_gap": _sql("dense", _TD, "close volume", """SELECT ticker, date, coalesce(last_value(close IGNORE NULLS) OVER a, first_value(close IGNORE NULLS) OVER b) AS close, coalesce(last_value(volume IGNORE NULLS) OVER a, first_value(volume IGNORE NULLS) OVER b) AS volume
        FROM dense WINDOW a AS (PARTITION BY ticker ORDER BY date), b AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""),
    "fwd_return": _sql("dense", _TD, "fwd", "SELECT * FROM (SELECT ticker, date, lead(close, 4) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS fwd FROM dense) WHERE fwd IS NOT NULL"),
    "valid_dates": _sql("ret", "date", "", "SELECT date FROM ret GROUP BY date HAVING count(ret) >= 5"),
    "spike_filter": _sql("wk", "ticker date spike", "cleaned", """SELECT ticker, date, spike::BIGINT AS spike, last_value(CASE WHEN NOT spike THEN p END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date) AS cleaned FROM (
        SELECT ticker, date, p, coalesce(p / b > 3.0 OR p / b < 0.2, false) AND (coalesce(abs(o / b - 1) <= 0.15, false) OR coalesce(abs(t / b - 1) <= 0.15, false)) AS spike FROM (
        SELECT ticker, date, raw_px AS p, lag(raw_px) OVER w AS b, lead(raw_px) OVER w AS o, lead(raw_px, 2) OVER w AS t FROM wk WINDOW w AS (PARTITION BY ticker ORDER BY date)))"""),
    "spike_report": _sql("wk", "ticker n", "", """SELECT ticker, count(*) FILTER (spike) AS n FROM (
        SELECT ticker, coalesce(p / b > 3.0 OR p / b < 0.2, false) AND (coalesce(abs(o / b - 1) <= 0.15, false) OR coalesce(abs(t / b - 1) <= 0.15, false)) AS spike FROM (
        SELECT ticker, raw_px AS p, lag(raw_px) OVER w AS b, lead(raw_px) OVER w AS o, lead(raw_px, 2) OVER w AS t FROM wk WINDOW w AS (PARTITION BY ticker ORDER BY date))) GROUP BY ticker HAVING count(*) FILTER (spike) > 0 ORDER BY n DESC, ticker LIMIT 10"""),
    "rebalance_calendar": _sql("reb", "date", "", "SELECT date FROM reb WHERE date IS NOT NULL"),
    "asof_snapshot": _sql("wk", _TD, "size", """SELECT w.ticker, w.date, s.size FROM wk w ASOF LEFT JOIN (SELECT ticker, CAST(date_trunc('quarter', date) AS DATE) AS date, sum(amount) AS size FROM wk GROUP BY 1, 2) s ON w.ticker = s.ticker AND w.date >= s.date"""),
    "dynamic_size": _sql("px", _TD, "cap", """SELECT p.ticker, p.date, coalesce(s.size / nullif(s.snap, 0) * p.close, s.size) / 1e6 AS cap FROM px p ASOF LEFT JOIN (
        SELECT g.ticker, g.date, g.size, px.close AS snap FROM (SELECT ticker, max(date) AS date, sum(amount) AS size FROM px GROUP BY ticker, date_trunc('quarter', date)) g LEFT JOIN px USING (ticker, date)) s ON p.ticker = s.ticker AND p.date >= s.date"""),
    "zscore_by_date": _sql("cs", _TD, "z", "SELECT ticker, date, coalesce((x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0), 0) AS z FROM cs WINDOW w AS (PARTITION BY date)"),
    "size_char": _sql("wk", _TD, "size", "SELECT ticker, date, coalesce((s - avg(s) OVER w) / nullif(stddev_samp(s) OVER w, 0), 0) AS size FROM (SELECT ticker, date, ln(greatest(amount, 1)) AS s FROM wk) WINDOW w AS (PARTITION BY date)"),
    "rank01_sector": _sql("cs", _TD, "r", f"SELECT ticker, date, {_R01.format(least=3, x='x', p='date, sector', o='', one=0.5)} AS r FROM (SELECT *, count(x) OVER (PARTITION BY date, sector) AS n FROM cs)"),
    "pct_rank_sector": _sql("cs", _TD, "r", "SELECT ticker, date, (rank() OVER (PARTITION BY date, sector ORDER BY x) + (count(*) OVER (PARTITION BY date, sector, x) - 1) / 2.0) / count(*) OVER (PARTITION BY date, sector) AS r FROM cs"),
    "winsorize_sector": _sql("cs", _TD, "w", "SELECT ticker, date, greatest(quantile_cont(x, 0.01) OVER v, least(quantile_cont(x, 0.99) OVER v, x)) AS w FROM cs WINDOW v AS (PARTITION BY date, sector)"),
    "qcut_buckets": _sql("cs", "ticker date bucket", "", "SELECT ticker, date, CASE WHEN n > 1 THEN greatest(1, ceil((r - 1) * 5 / (n - 1)))::BIGINT END AS bucket FROM (SELECT ticker, date, row_number() OVER (PARTITION BY date ORDER BY x, ticker) AS r, count(*) OVER (PARTITION BY date) AS n FROM cs)"),
    "sector_demean": _sql("cs", _TD, "by_mean by_median", "SELECT ticker, date, x - avg(x) OVER w AS by_mean, x - median(x) OVER w AS by_median FROM cs WINDOW w AS (PARTITION BY date, sector)"),
    "median_impute": _sql("cs", _TD, "filled", "SELECT ticker, date, coalesce(y, median(y) OVER (PARTITION BY date)) AS filled FROM (SELECT *, CASE WHEN returned > 0 THEN x END AS y FROM cs)"),
    "value_reflexivity": _sql("cs", _TD, "v", "SELECT ticker, date, CASE WHEN y > 0 THEN y WHEN max(y) FILTER (y > 0) OVER w IS NOT NULL THEN max(y) FILTER (y > 0) OVER w + abs(y) ELSE max(abs(y)) OVER w - y END AS v FROM (SELECT *, round(x - 0.05, 9) AS y FROM cs) WINDOW w AS (PARTITION BY date, sector)"),
    "sector_dummies": _sql("sec", "ticker k", "x", "SELECT s.ticker, (t.r - 1)::BIGINT AS k, CASE WHEN t.sector = s.sector THEN CASE WHEN t.n > 1 THEN 1.0 ELSE 0.0 END ELSE -1.0 / (t.n - 1) END AS x FROM sec s CROSS JOIN (SELECT sector, row_number() OVER (ORDER BY sector) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT sector FROM sec)) t"),
    "quality_composite": _sql("cs", _TD, "score", "SELECT ticker, date, 0.5 * coalesce(a, 0) + 0.3 * coalesce(b, 0) + 0.2 * coalesce(c, 0) AS score FROM (SELECT ticker, date, " + ", ".join(_R01.format(least=3, x=x, p="date, sector", o="", one=0.5) + f" AS {k}" for x, k in (("x", "a"), ("tx", "b"), ("re", "c"))) + " FROM (SELECT *, round(tax, 9) AS tx, round(returned, 9) AS re, count(*) OVER (PARTITION BY date, sector) AS n FROM cs))"),
    "si_composite": _sql("wk", _TD, "si", """SELECT ticker, date, CASE WHEN n >= 5 THEN (coalesce((p - avg(p) OVER w) / nullif(stddev_samp(p) OVER w, 0), 0) + coalesce((u - avg(u) OVER w) / nullif(stddev_samp(u) OVER w, 0), 0)) / 2 END AS si FROM (
        SELECT ticker, date, coalesce(p, median(p) OVER w) AS p, coalesce(u, median(u) OVER w) AS u, count(p) OVER w AS n FROM (SELECT ticker, date, CASE WHEN returned > 0 THEN tax END AS p, greatest(0, least(1, volume * returned / nullif(volume, 0))) AS u FROM wk) WINDOW w AS (PARTITION BY date)) WINDOW w AS (PARTITION BY date)"""),
    "ewma_beta": _sql("beta", _TD, "beta", "FROM beta WHERE beta IS NOT NULL"),
    "macro_beta": _sql("ret", "ticker date series", "beta", """SELECT ticker, date, series, beta FROM (SELECT *, CASE WHEN n >= 126 AND gxx / g - (gx / g) * (gx / g) > 1e-18 THEN (gxy / g - gx / g * (gy / g)) / (gxx / g - (gx / g) * (gx / g)) END AS beta FROM (
        SELECT ticker, date, series, sum(e) OVER f AS g, sum(e * v) OVER f AS gx, sum(e * y) OVER f AS gy, sum(e * v * y) OVER f AS gxy, sum(e * v * v) OVER f AS gxx, count(*) OVER f AS n FROM (
          SELECT r.ticker, r.date, n.series, exp(r.i * (ln(2) / 126)) AS e, coalesce(r.ret, 0) AS y, coalesce(s.value, 0) AS v FROM ret r CROSS JOIN (SELECT unnest(['price', 'orders']) AS series) n LEFT JOIN (
            SELECT date, series, level / lag(level) OVER (PARTITION BY series ORDER BY date) - 1 AS value FROM (
              SELECT date, 'price' AS series, p AS level FROM (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, avg(o_totalprice) AS p FROM orders GROUP BY 1) UNION ALL SELECT CAST(date_trunc('week', o_orderdate) AS DATE), 'orders', count(*)::DOUBLE FROM orders GROUP BY 1)) s
          ON s.date = r.date AND s.series = n.series) WINDOW f AS (PARTITION BY ticker, series ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING))) WHERE beta IS NOT NULL"""),
    "cc_vol": _sql("ret", _TD, "vol", """SELECT * FROM (SELECT ticker, date, sqrt(252 * sum(e * ret * ret) OVER w / sum(e) OVER w) AS vol FROM (SELECT *, CASE WHEN ret IS NOT NULL THEN exp(i * (ln(2) / 42)) END AS e FROM ret)
        WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 83 PRECEDING AND 1 PRECEDING)) WHERE vol IS NOT NULL"""),
    "gk_vol": _sql("dense", _TD, "gk", """SELECT ticker, date, CASE WHEN n >= 42 AND v > 0 THEN sqrt(252 * v) END AS gk FROM (SELECT ticker, date, count(*) OVER w AS n, sum(e * greatest(0.5 * pow(ln(h / l), 2) - (2 * ln(2) - 1) * pow(ln(close / b), 2), 0)) OVER w / sum(e) OVER w AS v FROM (
        SELECT ticker, date, close, b, exp(i * (ln(2) / 42)) AS e, CASE WHEN close IS NOT NULL AND b IS NOT NULL THEN greatest(close, b) * (1 + greatest(0, least(0.1, tax))) END AS h, CASE WHEN close IS NOT NULL AND b IS NOT NULL THEN least(close, b) * (1 - greatest(0, least(0.1, tax))) END AS l FROM (
        SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS b FROM dense)) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 84 PRECEDING AND 1 PRECEDING)) WHERE n >= 42 AND v > 0"""),
    "idio_momentum": _sql("resid", _TD, "mom", "SELECT * FROM (SELECT ticker, date, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY date) >= 254 THEN coalesce(sum(resid) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 252 PRECEDING AND 22 PRECEDING), 0) END AS mom FROM resid) WHERE mom IS NOT NULL"),
    "idio_momentum_volscaled": _sql("resid", _TD, "mom", """SELECT * FROM (SELECT ticker, date, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY date) >= 254 THEN coalesce(sum(z) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 252 PRECEDING AND 22 PRECEDING), 0) END AS mom FROM (
        SELECT ticker, date, resid * CASE WHEN s IS NOT NULL THEN greatest(0.5, least(3.0, s)) END AS z FROM (SELECT *, volume / nullif(avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0) AS s FROM resid))) WHERE mom IS NOT NULL"""),
    "reversal_21": _sql("filled", _TD, "reversal", "SELECT * FROM (SELECT ticker, date, ln(lag(close) OVER w / lag(close, 22) OVER w) AS reversal FROM filled WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE reversal IS NOT NULL"),
    "momentum_12m1": _sql("filled", _TD, "mom121", "SELECT * FROM (SELECT ticker, date, lag(close, 21) OVER w / lag(close, 252) OVER w - 1 AS mom121 FROM filled WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE mom121 IS NOT NULL"),
    "vol_filter": _sql("ret", "date n", "top", """SELECT date, count(*) AS n, max(v) AS top FROM (SELECT *, quantile_cont(v, 0.8) OVER (PARTITION BY date) AS q FROM (SELECT date, stddev_samp(ret) OVER w * sqrt(252) AS v, count(*) OVER w AS n FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 124 PRECEDING AND CURRENT ROW))) WHERE n < 20 OR v <= q GROUP BY date"""),
    "rate_regime": _sql("nav", "date", "mav q", "SELECT date, mav, CASE WHEN mav IS NULL THEN 0.5 WHEN v - mav > 0.5 THEN 1.0 WHEN v - mav < -0.5 THEN 0.0 ELSE 0.5 END AS q FROM (SELECT date, nav * 100 AS v, CASE WHEN count(*) OVER w >= 63 THEN avg(nav * 100) OVER w END AS mav FROM nav WINDOW w AS (ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW))"),
    "drawdown": _sql("nav", "date", "drawdown", "SELECT date, nav / max(nav) OVER (ORDER BY date) - 1 AS drawdown FROM nav"),
    "wls_step_lambda": _sql("lam", "date", "intercept slope r2", "FROM lam"),
    "wls_step_resid": _sql("res", "date ticker", "resid", "FROM res"),
    "variance_reduction": _sql("res", "step n", "variance std", "SELECT 'raw' AS step, var_pop(ret) AS variance, stddev_pop(ret) AS std, count(*) AS n FROM res UNION ALL SELECT 'beta', var_pop(resid), stddev_pop(resid), count(*) FROM res"),
    "daily_r2": _sql("res", "date", "r2", "SELECT date, 1 - var_samp(resid) / nullif(var_samp(ret), 0) AS r2 FROM res GROUP BY date"),
    "lambda_stats": _sql("lam", "factor n", "mean std t positive lo p5 p50 p95 hi", f"SELECT 'beta' AS factor, count(slope) AS n, avg(slope) AS mean, stddev_samp(slope) AS std, {_t('slope')} AS t, {_pos('slope')} AS positive, min(slope) AS lo, quantile_cont(slope, 0.05) AS p5, median(slope) AS p50, quantile_cont(slope, 0.95) AS p95, max(slope) AS hi FROM lam"),
    "lambda_annual": _sql("lam", "factor year", "mean t positive", f"SELECT 'beta' AS factor, year(date) AS year, avg(slope) AS mean, {_t('slope')} AS t, {_pos('slope')} AS positive FROM lam GROUP BY 2"),
    "cumulative_lambda": _sql("lam", "date", "cumulative", "SELECT date, sum(slope) OVER (ORDER BY date) AS cumulative FROM lam"),
    "rolling_tstat": _sql("lam", "date", "t", "SELECT * FROM (SELECT date, CASE WHEN count(*) OVER w = 52 THEN avg(slope) OVER w / nullif(stddev_samp(slope) OVER w / sqrt(52), 0) END AS t FROM lam WINDOW w AS (ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)) WHERE t IS NOT NULL"),
    "resid_fwd_compound": _sql("fwdc", _TD, "fwd", "FROM fwdc WHERE fwd IS NOT NULL"),
    "ic_within_sector": _sql("sic", "date n", "ic", "FROM sic"),
    "ic_summary": _sql("sic", "metric n", "mean std t positive ir", _summary("metric").replace("FROM src", "FROM (SELECT 'x' AS metric, ic FROM sic)")),
    "ic_annual": _sql("sic", "year n", "mean std t positive ir", _summary("year").replace("FROM src", "FROM (SELECT year(date) AS year, ic FROM sic)")),
    "rank_ic": _sql("ric", "date", "ic", "FROM ric"),
    "rolling_ic": _sql("ric", "date", "ic rolling", "SELECT date, ic, CASE WHEN k >= 52 AND k <= n - 4 THEN a END AS rolling FROM (SELECT date, ic, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n, avg(ic) OVER (ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) AS a FROM ric)"),
    "decile_spread": _sql("spread", "date metric n", "top bottom spread_z", "FROM spread"),
    "metric_weights": _sql("spread", "metric", "avg t weight", f"""SELECT metric, a AS avg, t, greatest(t, 0) / sum(greatest(t, 0)) OVER () AS weight FROM (SELECT *, median(a) OVER () AS ma, median(t) OVER () AS mt FROM (SELECT metric, avg(spread_z) AS a, {_t('spread_z')} AS t FROM spread GROUP BY metric)) WHERE a > 0 AND a > ma AND t > mt"""),
    "latest_version": _sql("f0", "ticker period metric download", "value", "SELECT ticker, period, metric, max(download) AS download, arg_max(value, download) AS value FROM (SELECT ticker, period, download, 'revenue' AS metric, revenue AS value FROM f0 UNION ALL SELECT ticker, period, download, 'profit', profit FROM f0) WHERE download <= DATE '1996-01-01' GROUP BY 1, 2, 3"),
    "quarters_8_back": _sql("q8", "ticker date k", "value", "FROM q8"),
    "quarters_4_forward": _sql("q4", "ticker date k", "value", "FROM q4"),
    "gs_blended": _sql("q8 q4", "ticker date n_forward", "actual forward gs", """SELECT a.ticker, a.date, coalesce(f.n, 0) AS n_forward, a.actual, f.forward,
        round(100 * CASE WHEN f.n > 0 THEN (f.n / 2.0 * f.forward + a.actual) / (f.n / 2.0 + 1) ELSE a.actual END, 2) AS gs FROM (
        SELECT n.ticker, n.date, median((n.value - o.value) / nullif(abs((n.value + o.value) / 2), 0)) AS actual FROM q8 n JOIN q8 o ON o.ticker = n.ticker AND o.date = n.date AND o.k = n.k - 4 WHERE n.k >= -4 GROUP BY 1, 2) a LEFT JOIN (
        SELECT n.ticker, n.date, median((n.value - o.value) / nullif(abs((n.value + o.value) / 2), 0)) AS forward, count((n.value - o.value) / nullif(abs((n.value + o.value) / 2), 0)) AS n FROM q4 n JOIN q8 o ON o.ticker = n.ticker AND o.date = n.date AND o.k = n.k - 4 WHERE n.value IS NOT NULL GROUP BY 1, 2) f USING (ticker, date)"""),
    "prefilter_topk": _sql("rk", "ticker date rank", "", "SELECT ticker, date, rank FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM rk) WHERE rank <= greatest(10, ceil(n * 0.4))"),
    "sector_cap_select": _sql("capped", "ticker date rank", "", "FROM capped"),
    "concentration_weights": _sql("rk", _TD, "weight", "SELECT ticker, date, CASE WHEN n = 1 THEN 1.0 WHEN rank <= ceil(n / 2.0) THEN 2.0 / 3 / ceil(n / 2.0) ELSE 1.0 / 3 / nullif(n - ceil(n / 2.0), 0) END AS weight FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM rk WHERE rank <= 20)"),
    "backtest_nav": _sql("bt", "date", "nav", "FROM bt"),
    "backtest_blended": _sql("cal filled reb fac", "date", "nav", _backtest("""SELECT date, ticker, CASE WHEN rank <= 10 THEN 2.0 / 3 / 10 ELSE 1.0 / 3 / 10 END AS weight FROM (
          SELECT r.date, r.ticker, row_number() OVER (PARTITION BY r.date ORDER BY r.score DESC, r.ticker) AS rank FROM blend r JOIN (
            SELECT date, min(c) AS c FROM (SELECT r.date, t.c FROM blend r CROSS JOIN (SELECT unnest(range(5, 21)) AS c) t GROUP BY 1, 2 HAVING count(*) FILTER (r.s <= t.c) >= 20) GROUP BY date) m USING (date) WHERE r.s <= m.c) WHERE rank <= 20""").replace("WITH src", """WITH capped0 AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, quantile_cont(rvol, 0.8) OVER (PARTITION BY date) AS q FROM fac WHERE cap >= 1500),
        calm AS (SELECT *, count(*) OVER (PARTITION BY date) AS m, row_number() OVER (PARTITION BY date ORDER BY factor DESC, ticker) AS r FROM capped0 WHERE n <= 20 OR q IS NULL OR rvol <= q),
        kept AS (SELECT *, count(*) OVER (PARTITION BY date) AS k FROM calm WHERE m <= 20 OR r <= greatest(20, ceil(m * 0.6))),
        mixed AS (SELECT date, ticker, sector, (coalesce((factor - avg(factor) OVER w) / nullif(stddev_samp(factor) OVER w, 0), 0) + 0.5 * CASE WHEN momentum IS NOT NULL THEN coalesce((momentum - avg(momentum) OVER w) / nullif(stddev_samp(momentum) OVER w, 0), 0) END) / 1.5 AS score FROM kept WHERE k >= 20 WINDOW w AS (PARTITION BY date)),
        blend AS (SELECT *, row_number() OVER (PARTITION BY date, sector ORDER BY score DESC, ticker) AS s FROM mixed WHERE score IS NOT NULL QUALIFY count(*) OVER (PARTITION BY date) >= 20),
        src""", 1)),
    "backtest_skips": _sql("cal filled reb facs", "date", "nav", _backtest("SELECT date, ticker, 0.05 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor DESC, ticker) AS rank FROM facs WHERE cap >= 3000 QUALIFY count(*) OVER (PARTITION BY date) >= 20) WHERE rank <= 20").replace("fac f", "facs f") + " UNION ALL SELECT DATE '1992-12-31', 1.0"),
    "performance_stats": _sql("bt", "", "total years cagr vol sharpe max_drawdown", """SELECT total, years, cagr, vol, cagr / nullif(vol, 0) AS sharpe, max_drawdown FROM (SELECT l / f - 1 AS total, days / 365.25 AS years, pow(l / f, 365.25 / days) - 1 AS cagr, vol, max_drawdown FROM (
        SELECT arg_min(nav, date) AS f, arg_max(nav, date) AS l, date_diff('day', min(date), max(date)) AS days, stddev_samp(r) * sqrt(52) AS vol, min(dd) AS max_drawdown FROM (SELECT date, nav, nav / lag(nav) OVER (ORDER BY date) - 1 AS r, nav / max(nav) OVER (ORDER BY date) - 1 AS dd FROM bt)))"""),
    "holdings_matrix": _sql("rk", "date stock1 stock2 stock3 stock4 stock5", "", "SELECT date, " + ", ".join(f"max(ticker) FILTER (rank = {k}) AS stock{k}" for k in range(1, 6)) + " FROM rk WHERE rank <= 5 GROUP BY date"),
    "events_by_day": _sql("", "day event_type n", "total", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2"),
    "last_lambdas": _sql("lam", "date factor slope intercept r2", "", "SELECT date, 'beta' AS factor, round(100 * slope, 2) AS slope, round(100 * intercept, 2) AS intercept, round(100 * r2, 2) AS r2 FROM lam QUALIFY row_number() OVER (ORDER BY date DESC) <= 5"),
    "universe_filter": _sql("px sec f0", "ticker", "", """SELECT ticker FROM (SELECT ticker, count(*) FILTER (date IN (SELECT date FROM (SELECT DISTINCT date FROM px WHERE date < DATE '1998-01-05') ORDER BY date DESC LIMIT 252)) AS n FROM px GROUP BY ticker)
        WHERE ((SELECT count(DISTINCT date) FROM px WHERE date < DATE '1998-01-05') < 252 OR n >= 200) AND ticker IN (SELECT ticker FROM sec) AND ticker IN (SELECT ticker FROM f0)"""),
    "capw_mean": _sql("cs", "date sector n", "mean", "SELECT date, sector, count(*) AS n, sum(x * volume) / sum(volume) AS mean FROM cs GROUP BY 1, 2 HAVING count(*) >= 3"),
    "harmonic_multiple": _sql("cs", "date sector", "multiple", "SELECT date, sector, sum(volume) / nullif(sum(volume / x), 0) AS multiple FROM cs WHERE x <> 0 GROUP BY 1, 2"),
    "factor_return_ls": _sql("sig", "date", "spread", """SELECT date, avg(fwd) FILTER (r >= hi) - avg(fwd) FILTER (r <= lo) AS spread FROM (SELECT *, quantile_cont(r, 0.8) OVER w AS hi, quantile_cont(r, 0.2) OVER w AS lo FROM (
        SELECT date, fwd, (rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS r FROM sig) WINDOW w AS (PARTITION BY date)) GROUP BY date"""),
    "residualized": _sql("sig", _TD, "resid", "SELECT * FROM (SELECT ticker, date, fwd - regr_intercept(fwd, x) OVER w - regr_slope(fwd, x) OVER w * x AS resid FROM sig WHERE fwd IS NOT NULL WINDOW w AS (PARTITION BY date)) WHERE resid IS NOT NULL"),
    "common_dates": _sql("wk", "date", "", "SELECT DISTINCT date FROM wk INTERSECT SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) FROM orders"),
    "sector_spread": _sql("ret sec", "date", "spread", "SELECT date, max(c) - min(c) AS spread FROM (SELECT date, sum(coalesce(m, 0)) OVER (PARTITION BY sector ORDER BY date) AS c FROM (SELECT date, sector, avg(ret) AS m FROM ret JOIN sec USING (ticker) GROUP BY 1, 2)) GROUP BY date"),
    "ou_fit": _sql("resid", _TD, "weight distance", """SELECT ticker, date, least(30.0 / (ln(2) / -ln(b)), 10.0) AS weight, (xl - a / (1 - b)) / nullif(sqrt(greatest(syy - b * sxy, 0) / m) / sqrt(2 * -ln(b)), 0) AS distance FROM (
        SELECT ticker, date, count(x) OVER f AS n, regr_slope(x, p) OVER g AS b, regr_intercept(x, p) OVER g AS a, regr_syy(x, p) OVER g AS syy, regr_sxy(x, p) OVER g AS sxy, regr_count(x, p) OVER g AS m, p AS xl FROM (
          SELECT *, lag(x) OVER (PARTITION BY ticker ORDER BY date) AS p FROM (SELECT ticker, date, exp(sum(ln(1 + resid)) OVER (PARTITION BY ticker ORDER BY date)) AS x FROM resid WHERE resid IS NOT NULL AND resid > -1))
        WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), g AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND 1 PRECEDING)) WHERE n >= 30 AND b > 0 AND b < 1 AND a / (1 - b) > 0"""),
    "ou_score": _sql("vnorm", _TD, "score", f"""SELECT ticker, date, coalesce((blend - avg(blend) OVER w) / nullif(stddev_samp(blend) OVER w, 0), 0) AS score FROM (
        SELECT ticker, date, (wt * coalesce(ou, 0) + rev) / (wt + 1) AS blend FROM (
          SELECT ticker, date, CASE WHEN h > 0 THEN least(30.0 / h, 10.0) ELSE 0.0 END AS wt, CASE WHEN d IS NOT NULL AND nd > 1 THEN (rank() OVER (PARTITION BY date ORDER BY d DESC NULLS LAST) + (count(*) OVER (PARTITION BY date, d) - 1) / 2.0 - 1) / (nd - 1) END AS ou,
            CASE WHEN v IS NOT NULL AND nv > 1 THEN (rank() OVER (PARTITION BY date ORDER BY v DESC NULLS LAST) + (count(*) OVER (PARTITION BY date, v) - 1) / 2.0 - 1) / (nv - 1) END AS rev FROM (
            SELECT *, count(d) OVER (PARTITION BY date) AS nd, count(v) OVER (PARTITION BY date) AS nv FROM (
              SELECT ticker, date, fit.h AS h, round(fit.d, 9) AS d, round(v, 9) AS v FROM (
                SELECT o.ticker, o.date, last_value(CASE WHEN f.ticker IS NOT NULL THEN {{'h': f.h, 'd': f.d}} END IGNORE NULLS) OVER (PARTITION BY o.ticker ORDER BY o.date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fit, lag(l, 1) OVER u - lag(l, 22) OVER u AS v FROM (
                  SELECT ticker, date, r, sum(ln(1 + coalesce(r, 0))) OVER (PARTITION BY ticker ORDER BY date) AS l FROM vnorm) o LEFT JOIN (
                  SELECT ticker, date, CASE WHEN ok THEN ln(2) / -ln(b) END AS h, CASE WHEN ok THEN (x - a / (1 - b)) / nullif(sqrt(greatest(syy - b * sxy, 0) / m) / sqrt(2 * -ln(b)), 0) END AS d FROM (SELECT *, n >= 30 AND b > 0 AND b < 1 AND a / (1 - b) > 0 AS ok FROM (
                    SELECT ticker, date, x, count(x) OVER f AS n, regr_slope(x, p) OVER g AS b, regr_intercept(x, p) OVER g AS a, regr_syy(x, p) OVER g AS syy, regr_sxy(x, p) OVER g AS sxy, regr_count(x, p) OVER g AS m FROM (
                      SELECT *, lag(x) OVER (PARTITION BY ticker ORDER BY date) AS p FROM (SELECT ticker, date, exp(sum(ln(1 + r)) OVER (PARTITION BY ticker ORDER BY date)) AS x FROM vnorm WHERE r IS NOT NULL))
                    WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), g AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 58 PRECEDING AND CURRENT ROW)))) f USING (ticker, date)
                WINDOW u AS (PARTITION BY o.ticker ORDER BY o.date)))))) WHERE blend IS NOT NULL WINDOW w AS (PARTITION BY date)"""),
    "resid_beta_sector": _sql("ret sec", _TD, "beta63 resid", """SELECT ticker, date, beta63, resid FROM (SELECT *, e - avg(e) OVER (PARTITION BY date, sector) AS resid FROM (SELECT *, fwd - beta63 * avg(fwd) OVER (PARTITION BY date) AS e FROM (
        SELECT *, coalesce(CASE WHEN count(mk) OVER f >= 20 THEN covar_samp(ret, mkt) OVER f / nullif(var_samp(mk) OVER f, 0) END, 1.0) AS beta63 FROM (
          SELECT r.ticker, r.date, s.sector, r.ret, r.mkt, CASE WHEN r.ret IS NOT NULL THEN r.mkt END AS mk, lead(d.close, 4) OVER (PARTITION BY r.ticker ORDER BY r.date) / d.close - 1 AS fwd FROM ret r JOIN dense d ON d.ticker = r.ticker AND d.date = r.date JOIN sec s ON s.ticker = r.ticker)
        WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)))) WHERE resid IS NOT NULL"""),
    "orthogonalize_1": _sql("beta", _TD, "perp", """SELECT ticker, date, CASE WHEN n >= 5 THEN x - (mx + coalesce((sxp - mp * mx) / CASE WHEN spp - mp * mp > 1e-14 THEN spp - mp * mp END, 0) * (p - mp)) ELSE x END AS perp FROM (
        SELECT *, count(x) OVER d AS n, sum(v * p) OVER d / sum(v) OVER d AS mp, sum(v * x) OVER d / sum(v) OVER d AS mx, sum(v * p * p) OVER d / sum(v) OVER d AS spp, sum(v * p * x) OVER d / sum(v) OVER d AS sxp FROM (
          SELECT ticker, date, beta AS p, z AS x, CASE WHEN sum(CASE WHEN z IS NOT NULL THEN w0 END) OVER (PARTITION BY date) > 0 THEN CASE WHEN z IS NOT NULL THEN w0 END ELSE CASE WHEN z IS NOT NULL THEN 1.0 END END AS v FROM (
            SELECT *, coalesce((s - avg(s) OVER (PARTITION BY date)) / nullif(stddev_samp(s) OVER (PARTITION BY date), 0), 0) AS z, greatest(s, 0) AS w0 FROM (SELECT ticker, date, beta, ln(greatest(coalesce(cap, 1), 1)) AS s FROM beta)) WHERE beta IS NOT NULL)
        WINDOW d AS (PARTITION BY date))"""),
    "feq_estimate": _sql("want f0", "ticker date feq", "", """SELECT n.ticker, n.date, coalesce(min(c.period) FILTER (abs(c.v1 - c.v0) / greatest(abs(c.v1), 1) > 0.01), any_value(n.guess))::BIGINT AS feq FROM (
        SELECT w.ticker, w.date, max(f.download) FILTER (f.download <= w.date) AS before, min(f.download) FILTER (f.download > w.date) AS after, 1997 * 4 - round_even(date_diff('day', w.date, DATE '1997-01-15') / 90.0, 0)::BIGINT AS guess FROM want w JOIN (SELECT DISTINCT ticker, download FROM f0) f ON f.ticker = w.ticker GROUP BY w.ticker, w.date) n
        LEFT JOIN LATERAL (SELECT t.k + n.guess AS period, (SELECT revenue FROM f0 a WHERE a.ticker = n.ticker AND a.period = t.k + n.guess AND a.download = n.before) AS v0, (SELECT revenue FROM f0 b WHERE b.ticker = n.ticker AND b.period = t.k + n.guess AND b.download = n.after) AS v1 FROM (SELECT unnest([-1, 0, 1]) AS k) t) c ON true
        WHERE n.before IS NOT NULL GROUP BY n.ticker, n.date"""),
    "grid_search": _sql("nav", "window threshold high low", "mean_q", """SELECT n AS "window", t AS threshold, avg(q) AS mean_q, count(*) FILTER (q = 1) AS high, count(*) FILTER (q = 0) AS low FROM (SELECT n, t, CASE WHEN m IS NULL THEN 0.5 WHEN v - m > t THEN 1.0 WHEN v - m < -t THEN 0.0 ELSE 0.5 END AS q FROM (
        SELECT 26 AS n, nav * 100 AS v, CASE WHEN count(*) OVER w >= 13 THEN avg(nav * 100) OVER w END AS m FROM nav WINDOW w AS (ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)
        UNION ALL SELECT 52, nav * 100, CASE WHEN count(*) OVER w >= 26 THEN avg(nav * 100) OVER w END FROM nav WINDOW w AS (ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)
        UNION ALL SELECT 104, nav * 100, CASE WHEN count(*) OVER w >= 52 THEN avg(nav * 100) OVER w END FROM nav WINDOW w AS (ORDER BY date ROWS BETWEEN 103 PRECEDING AND CURRENT ROW)) CROSS JOIN (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS t)) GROUP BY 1, 2""").replace("SELECT window,", 'SELECT CAST("window" AS BIGINT) AS "window",'),
}

"""SQL of the queries in plans/studies.py."""

from __future__ import annotations

from crossweave.plans.oracle import _R01, _TD, CTE, _pos, _sql, _summary, _t

CTE["anchor"] = ("", "SELECT CAST(unnest(generate_series(DATE '1993-01-15', DATE '1997-01-15', INTERVAL 3 MONTH)) AS DATE) AS date")
CTE["fwd8"] = ("ret", CTE["fwdc"][1].replace("= 4 AND", "= 8 AND").replace(">= 2", ">= 4").replace("4 FOLLOWING", "8 FOLLOWING"))
CTE["study"] = ("cs fwdc fwd8", """SELECT m.*, h.horizon, CASE WHEN h.horizon = 4 THEN round(a.fwd, 9) ELSE round(b.fwd, 9) END AS fwd FROM (
    SELECT ticker, date, sector, 'x' AS metric, x AS value FROM cs UNION ALL SELECT ticker, date, sector, 'tax', round(tax, 9) FROM cs UNION ALL SELECT ticker, date, sector, 'returned', returned FROM cs) m
    CROSS JOIN (SELECT unnest([4, 8]) AS horizon) h JOIN fwdc a USING (ticker, date) JOIN fwd8 b USING (ticker, date)""")  # fmt: skip
CTE["studyic"] = ("study", """SELECT metric, horizon, date, sum(n * ic) / sum(n) AS ic FROM (
    SELECT metric, horizon, date, sector, corr(rs, rt) AS ic, count(*) AS n FROM (
      SELECT *, rank() OVER (PARTITION BY metric, horizon, date, sector ORDER BY s) + (count(*) OVER (PARTITION BY metric, horizon, date, sector, s) - 1) / 2.0 AS rs,
             rank() OVER (PARTITION BY metric, horizon, date, sector ORDER BY t) + (count(*) OVER (PARTITION BY metric, horizon, date, sector, t) - 1) / 2.0 AS rt FROM (
        SELECT *, greatest(xl, least(xh, value)) AS s, greatest(fl, least(fh, fwd)) AS t FROM (
          SELECT *, quantile_cont(value, 0.01) OVER v AS xl, quantile_cont(value, 0.99) OVER v AS xh, quantile_cont(fwd, 0.01) OVER v AS fl, quantile_cont(fwd, 0.99) OVER v AS fh
          FROM (SELECT * FROM study WHERE metric <> 'returned' AND value IS NOT NULL AND fwd IS NOT NULL QUALIFY count(*) OVER (PARTITION BY metric, horizon, date, sector) >= 5) WINDOW v AS (PARTITION BY metric, horizon, date, sector))))
    GROUP BY metric, horizon, date, sector) WHERE ic IS NOT NULL AND NOT isnan(ic) GROUP BY 1, 2, 3""")  # fmt: skip
CTE["q8p"] = ("want f0", CTE["q8"][1].replace("f.revenue", "f.profit"))

_IC_KEYS = "metric horizon n"
_IC_DOUBLES = "mean std t positive ir"
_ONE_GROWTH = "(n.value - o.value) / nullif(abs((n.value + o.value) / 2), 0)"
_REFLECTED = "CASE WHEN {y} > 0 THEN {y} WHEN max({y}) FILTER ({y} > 0) OVER w IS NOT NULL THEN max({y}) FILTER ({y} > 0) OVER w + abs({y}) ELSE max(abs({y})) OVER w - {y} END"
_RANKED = ", ".join(_R01.format(least=3, x=x, p="date, sector", o=o, one=0.5) + f" AS {k}" for x, k, o in (("x", "a", ""), ("tx", "b", "")))

SQL: dict[str, str] = {
    "concat_outer": _sql("wk", _TD, "disc tax", "SELECT ticker, date, a.disc, b.tax FROM (FROM wk WHERE disc > 0.0501234) a FULL JOIN (FROM wk WHERE tax > 0.0401234) b USING (ticker, date)"),
    "dates_union": _sql("wk", "date", "", "SELECT date FROM wk UNION SELECT CAST(date_trunc('week', o_orderdate) AS DATE) FROM orders"),
    "anchor_price": _sql("px anchor", "ticker date start", "close", "SELECT p.ticker, a.date, min(p.date) AS start, arg_min(p.close, p.date) AS close FROM anchor a JOIN px p ON p.date >= a.date WHERE p.close IS NOT NULL GROUP BY 1, 2"),
    "fwd_anchor": _sql("filled anchor", _TD, "fwd", """SELECT ticker, date, fwd FROM (SELECT f.ticker, a.date, g.close / f.close - 1 AS fwd FROM (SELECT a.date, max(c.i) AS i FROM anchor a JOIN cal c ON c.date <= a.date GROUP BY 1) a
        JOIN filled f ON f.i = a.i JOIN filled g ON g.ticker = f.ticker AND g.i = f.i + 4) WHERE fwd IS NOT NULL"""),
    "snapshot_first": _sql("wk", "ticker quarter date", "amount", "SELECT ticker, CAST(date_trunc('quarter', date) AS DATE) AS quarter, date, amount FROM wk QUALIFY row_number() OVER (PARTITION BY ticker, date_trunc('quarter', date) ORDER BY amount DESC, date) = 1"),
    "align_tables": _sql("wk", _TD, "close high low", """SELECT ticker, date, CASE WHEN disc > 0.0201234 THEN raw_px END AS close, volume AS high, CASE WHEN returned > 0 THEN volume - tax END AS low FROM wk
        WHERE ticker IN (SELECT ticker FROM wk WHERE disc > 0.0201234) AND ticker IN (SELECT ticker FROM wk WHERE tax > 0.0101234) AND ticker IN (SELECT ticker FROM wk WHERE returned > 0)
        AND date IN (SELECT date FROM wk WHERE disc > 0.0201234) AND date IN (SELECT date FROM wk WHERE tax > 0.0101234)"""),
    "macro_pick": _sql("", "date series", "value", "SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, 'orders' AS series, count(*) AS value FROM orders GROUP BY 1"),
    "lookback_start": _sql("cal", "date", "", "SELECT date FROM cal WHERE i = greatest((SELECT min(i) FROM cal WHERE date >= DATE '1995-03-01') - 60, 1)"),
    "last_days_resid": _sql("resid", _TD, "resid", "SELECT * FROM resid WHERE ret IS NOT NULL AND date >= (SELECT max(date) FROM resid WHERE ret IS NOT NULL) - 100"),
    "wide_view": _sql("px", "date", "t1 t2 t3 t4 t5", "SELECT date, " + ", ".join(f"max(close) FILTER (ticker = '{k}') AS t{k}" for k in range(1, 6)) + " FROM px WHERE ticker IN ('1', '2', '3', '4', '5') GROUP BY date"),
    "duplicate_keys": _sql("", "supplier date n", "", "SELECT l_suppkey AS supplier, CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
    "r2_stats": _sql("lam", "n", "mean median std lo hi p10 p90 positive", f"SELECT count(r2) AS n, avg(r2) AS mean, median(r2) AS median, stddev_pop(r2) AS std, min(r2) AS lo, max(r2) AS hi, quantile_cont(r2, 0.1) AS p10, quantile_cont(r2, 0.9) AS p90, {_pos('r2')} AS positive FROM lam"),
    "intercept_summary": _sql("lam", "", "mean std t", f"SELECT avg(intercept) AS mean, stddev_samp(intercept) AS std, {_t('intercept')} AS t FROM lam"),
    "sector_lambdas": _sql("ret sec", "factor n", "mean std t positive", f"SELECT factor, count(s) AS n, avg(s) AS mean, stddev_samp(s) AS std, {_t('s')} AS t, {_pos('s')} AS positive FROM (SELECT date, sector AS factor, avg(ret) AS s FROM ret JOIN sec USING (ticker) GROUP BY 1, 2) GROUP BY factor"),
    "rolling_r2": _sql("lam", "date", "rolling", "SELECT date, r AS rolling FROM (SELECT date, avg(r2) OVER w AS r, count(r2) OVER w AS n FROM lam WINDOW w AS (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)) WHERE n = 63"),
    "years_out": _sql("lam", "year n", "mean", "SELECT year(date) AS year, count(*) AS n, avg(slope) AS mean FROM lam WHERE year(date) NOT IN (1993, 1995) GROUP BY 1"),
    "names_held": _sql("score", "date names sectors", "", "SELECT date, count(DISTINCT ticker) AS names, count(DISTINCT sector) AS sectors FROM score WHERE score > 0.05 GROUP BY 1"),
    "value_composite": _sql("cs", _TD, "value", f"""SELECT ticker, date, (2.5 * coalesce(a, 0) + 1.5 * coalesce(b, 0)) / 4 AS value FROM (SELECT ticker, date, {", ".join(_R01.format(least=3, x=v, p="date, sector", o="DESC", one=0.5) + f" AS {k}" for v, k in (("v", "a"), ("u", "b")))} FROM (
        SELECT *, {_REFLECTED.format(y="y")} AS v, {_REFLECTED.format(y="z")} AS u, count(*) OVER w AS n FROM (SELECT *, round(x - 0.05, 9) AS y, round(tax, 9) AS z FROM cs) WINDOW w AS (PARTITION BY date, sector))) WHERE coalesce(a, b) IS NOT NULL"""),
    "scores_asof": _sql("wk sec anchor", _TD, "score", """SELECT ticker, date, CASE WHEN v IS NOT NULL THEN coalesce((v - avg(v) OVER d) / nullif(stddev_samp(v) OVER d, 0), 0) END AS score FROM (
        SELECT s.ticker, a.date, coalesce((SELECT arg_max(round(w.disc, 9), w.date) FROM wk w WHERE month(w.date) IN (2, 8) AND w.ticker = s.ticker AND w.date <= a.date), f.v) AS v FROM sec s CROSS JOIN anchor a
        LEFT JOIN (SELECT ticker, arg_min(round(disc, 9), date) AS v FROM wk WHERE month(date) IN (2, 8) GROUP BY 1) f USING (ticker)) WINDOW d AS (PARTITION BY date)"""),
    "derived_metrics": _sql("cs", _TD, "by_vol by_r2 absent", "SELECT ticker, date, x / greatest(volume, 1) AS by_vol, x * returned AS by_r2, CAST(NULL AS DOUBLE) AS absent FROM cs"),
    "regime_composite": _sql("cs nav", _TD, "score", f"""SELECT ticker, date, (1 - q) * a + q * b AS score FROM (SELECT ticker, date, {_RANKED} FROM (SELECT *, round(tax, 9) AS tx, count(*) OVER (PARTITION BY date, sector) AS n FROM cs)) JOIN (
        SELECT date, CASE WHEN mav IS NULL THEN 0.5 WHEN v - mav > 0.5 THEN 1.0 WHEN v - mav < -0.5 THEN 0.0 ELSE 0.5 END AS q FROM (SELECT date, nav * 100 AS v, CASE WHEN count(*) OVER w >= 63 THEN avg(nav * 100) OVER w END AS mav FROM nav WINDOW w AS (ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW))) USING (date) WHERE a IS NOT NULL AND b IS NOT NULL"""),
    "ic_weighted": _sql("cs", _TD, "score", "SELECT ticker, date, x * 0.6 + tax * 0.3 + returned * 0.1 AS score FROM cs"),
    "momentum_rebalance": _sql("filled reb", _TD, "momentum", """SELECT ticker, date, (m - avg(m) OVER d) / nullif(stddev_samp(m) OVER d, 0) AS momentum FROM (SELECT ticker, date, lag(close, 4) OVER w / lag(close, 26) OVER w - 1 AS m FROM filled WINDOW w AS (PARTITION BY ticker ORDER BY date))
        WHERE m IS NOT NULL AND date IN (SELECT date FROM reb) WINDOW d AS (PARTITION BY date) QUALIFY count(*) OVER d >= 5"""),
    "top_names": _sql("score", "date ticker rank sector", "score", "SELECT *, row_number() OVER (ORDER BY score DESC, ticker) AS rank FROM score WHERE date = (SELECT max(date) FROM score WHERE date <= DATE '1995-06-30') QUALIFY rank <= 10"),
    "ic_study": _sql("studyic", _IC_KEYS, _IC_DOUBLES, _summary("metric, horizon").replace("FROM src", "FROM studyic")),
    "ic_study_annual": _sql("studyic", f"{_IC_KEYS} year", _IC_DOUBLES, _summary("metric, horizon, year").replace("FROM src", "FROM (SELECT *, year(date) AS year FROM studyic)")),
    "spread_study": _sql("study", "metric horizon n", "mean t consistency", f"""SELECT metric, horizon, count(z) AS n, avg(z) AS mean, {_t('z')} AS t, {_pos('z')} AS consistency FROM (SELECT metric, horizon, date, (top - bottom) / nullif(sd, 0) AS z FROM (
        SELECT metric, horizon, date, median(value) FILTER (up <= k) AS top, median(value) FILTER (down <= k) AS bottom, stddev_samp(value) AS sd FROM (
          SELECT *, row_number() OVER (PARTITION BY metric, horizon, date ORDER BY fwd DESC, ticker) AS up, row_number() OVER (PARTITION BY metric, horizon, date ORDER BY fwd, ticker) AS down, greatest(1, floor(count(*) OVER (PARTITION BY metric, horizon, date) * 0.1)) AS k
          FROM study WHERE value IS NOT NULL AND fwd IS NOT NULL) GROUP BY 1, 2, 3)) GROUP BY 1, 2"""),
    "growth_components": _sql("q8 q4", "ticker date k", "growth", f"SELECT n.ticker, n.date, n.k, 100 * {_ONE_GROWTH} AS growth FROM (SELECT * FROM q8 WHERE k >= -4 UNION ALL SELECT * FROM q4 WHERE value IS NOT NULL) n JOIN q8 o ON o.ticker = n.ticker AND o.date = n.date AND o.k = n.k - 4 WHERE {_ONE_GROWTH} IS NOT NULL"),
    "pit_metrics": _sql("q8 q8p q4 filled", _TD, "cap gs gs_vol pe", f"""SELECT s.ticker, s.date, s.shares * p.close / 1e6 AS cap, g.gs, v.gs_vol, round(s.shares * p.close / nullif(4 * e.e, 0), 2) / 100 AS pe FROM (SELECT ticker, date, arg_max(value, k) FILTER (value IS NOT NULL) AS shares FROM q8p GROUP BY 1, 2) s
        JOIN (SELECT w.ticker, w.date, arg_max(f.close, f.date) AS close FROM want w JOIN filled f ON f.ticker = w.ticker AND f.date <= w.date WHERE f.close IS NOT NULL GROUP BY 1, 2) p USING (ticker, date)
        LEFT JOIN (SELECT ticker, date, median(nullif(value, 0)) AS e FROM q8p WHERE k >= -4 GROUP BY 1, 2) e USING (ticker, date)
        LEFT JOIN (SELECT n.ticker, n.date, CASE WHEN count({_ONE_GROWTH}) >= 2 THEN greatest(stddev_samp(100 * {_ONE_GROWTH}) / 10, 1) ELSE 1.0 END AS gs_vol FROM q8 n JOIN q8 o ON o.ticker = n.ticker AND o.date = n.date AND o.k = n.k - 4 WHERE n.k >= -4 GROUP BY 1, 2) v USING (ticker, date)
        LEFT JOIN (SELECT a.ticker, a.date, round(100 * CASE WHEN f.n > 0 THEN (f.n / 2.0 * f.forward + a.actual) / (f.n / 2.0 + 1) ELSE a.actual END, 2) AS gs FROM (
          SELECT n.ticker, n.date, median({_ONE_GROWTH}) AS actual FROM q8 n JOIN q8 o ON o.ticker = n.ticker AND o.date = n.date AND o.k = n.k - 4 WHERE n.k >= -4 GROUP BY 1, 2) a LEFT JOIN (
          SELECT n.ticker, n.date, median({_ONE_GROWTH}) AS forward, count({_ONE_GROWTH}) AS n FROM q4 n JOIN q8 o ON o.ticker = n.ticker AND o.date = n.date AND o.k = n.k - 4 WHERE n.value IS NOT NULL GROUP BY 1, 2) f USING (ticker, date)) g USING (ticker, date)"""),
    "ltm_ntm": _sql("want f0 q4", _TD, "last following", """SELECT l.ticker, l.date, l.s / 1e6 AS last, n.s / 1e6 AS following FROM (SELECT ticker, date, sum(v) AS s, count(v) AS n FROM (
        SELECT w.ticker, w.date, t.k, arg_max(f.revenue, f.download) AS v FROM want w CROSS JOIN (SELECT unnest(range(-4, 0)) AS k) t LEFT JOIN f0 f ON f.ticker = w.ticker AND f.period = w.feq + t.k GROUP BY 1, 2, 3) GROUP BY 1, 2) l
        LEFT JOIN (SELECT ticker, date, sum(value) AS s FROM q4 GROUP BY 1, 2) n USING (ticker, date) WHERE l.n >= 4"""),
    "feq_recent": _sql("want f0", "ticker date feq", "", """SELECT a.ticker, a.date, coalesce(max(a.period) FILTER (abs(n.revenue - o.revenue) / greatest(abs(n.revenue), 1) > 0.01), a.feq) AS feq FROM (
        SELECT c.*, c.feq + t.k AS period FROM (SELECT w.ticker, w.date, w.feq, d.d1, max(f.download) AS d0 FROM want w JOIN (SELECT w.ticker, w.date, max(f.download) AS d1 FROM want w JOIN f0 f ON f.ticker = w.ticker AND f.download <= w.date GROUP BY 1, 2) d USING (ticker, date)
          JOIN f0 f ON f.ticker = w.ticker AND f.download < d.d1 GROUP BY 1, 2, 3, 4) c CROSS JOIN (SELECT unnest(range(-2, 2)) AS k) t) a
        LEFT JOIN f0 n ON n.ticker = a.ticker AND n.period = a.period AND n.download = a.d1 LEFT JOIN f0 o ON o.ticker = a.ticker AND o.period = a.period AND o.download = a.d0 GROUP BY a.ticker, a.date, a.feq"""),
    "capw_mean_clipped": _sql("cs", "date sector n", "mean", "SELECT date, sector, count(*) AS n, sum(greatest(lo, least(hi, x)) * volume) / sum(volume) AS mean FROM (SELECT *, quantile_cont(x, 0.02) OVER w AS lo, quantile_cont(x, 0.98) OVER w AS hi FROM cs WHERE x IS NOT NULL AND volume > 0 WINDOW w AS (PARTITION BY date, sector)) GROUP BY 1, 2"),
    "moved_caps": _sql("px", "ticker", "cap", "SELECT ticker, s.size * l.close / nullif(p.close, 0) AS cap FROM (SELECT ticker, max(date) AS date, arg_max(amount, date) / 1000 AS size FROM px WHERE date < DATE '1996-06-01' GROUP BY 1) s JOIN px p USING (ticker, date) JOIN (SELECT ticker, arg_max(close, date) AS close FROM px GROUP BY 1) l USING (ticker)"),
}

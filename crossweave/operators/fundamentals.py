"""Point-in-time fundamentals: versions of (ticker, period, metric) by download date, all tickers and dates at once.

Periods are quarter numbers (functions.scalar.quarter_index).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossweave.functions.scalar import safe_ratio, symmetric_growth, zero_to_null
from crossweave.operators.panel import asof_both
from crossweave.operators.xsection import demeaned, quantile_bucket

Hold = Callable[[DataFrame], DataFrame]


def quarters(facts: DataFrame, wanted: DataFrame, metric: str, first: int, last: int, known_by_date: bool) -> DataFrame:
    """(ticker, date, feq, k, value): the latest value of the quarters feq + first .. feq + last of each wanted (ticker, date, feq).

    known_by_date: only versions downloaded by the date; otherwise the latest of all, as restated later.
    """
    rows = wanted.select("ticker", "date", "feq", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("k")).withColumn("period", F.col("feq") + F.col("k"))
    facts = facts.where(F.col("metric") == metric).select("ticker", "period", "download", F.col("value").alias("__v"))
    hit = rows.join(facts, ["ticker", "period"], "left")
    version = F.when(F.col("download") <= F.col("date"), F.col("download")) if known_by_date else F.col("download")
    return hit.groupBy("ticker", "date", "feq", "k").agg(F.max_by("__v", version).alias("value"))


def eight_back(facts: DataFrame, wanted: DataFrame, metric: str) -> DataFrame:
    """The eight quarters before feq, each missing one filled from the one before."""
    rows = quarters(facts, wanted, metric, -8, -1, known_by_date=False)
    w = Window.partitionBy("ticker", "date").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("value", F.last("value", ignorenulls=True).over(w))


def four_forward(facts: DataFrame, wanted: DataFrame, metric: str) -> DataFrame:
    """The four quarters from feq as known by the date; missing ones are left out."""
    return quarters(facts, wanted, metric, 0, 3, known_by_date=True).where(F.col("value").isNotNull())


def blended_growth(facts: DataFrame, wanted: DataFrame, metric: str, back: DataFrame | None = None, ahead: DataFrame | None = None) -> DataFrame:
    """(ticker, date, actual, forward, n_forward, gs): median symmetric yearly growth of the last four quarters and of the forward ones.

    gs = (2 n/4 forward + actual) / (2 n/4 + 1), in percent, with n forward quarters; actual alone without any.
    back, ahead: eight_back() and four_forward(), where the caller has them.
    """
    back = eight_back(facts, wanted, metric) if back is None else back
    ahead = four_forward(facts, wanted, metric) if ahead is None else ahead
    old = back.select("ticker", "date", (F.col("k") + 4).alias("k"), F.col("value").alias("before"))
    actual = back.where("k >= -4").join(old, ["ticker", "date", "k"]).groupBy("ticker", "date").agg(F.median(symmetric_growth(F.col("value"), F.col("before"))).alias("actual"))
    forward = ahead.join(old, ["ticker", "date", "k"]).withColumn("g", symmetric_growth(F.col("value"), F.col("before"))).groupBy("ticker", "date").agg(F.median("g").alias("forward"), F.count("g").alias("n_forward"))
    out = actual.join(forward, ["ticker", "date"], "left").withColumn("n_forward", F.coalesce("n_forward", F.lit(0)))
    m = 2 * F.col("n_forward") / 4.0
    return out.withColumn("gs", F.round(100 * F.when(F.col("n_forward") > 0, (m * F.col("forward") + F.col("actual")) / (m + 1)).otherwise(F.col("actual")), 2))


def reported_growth(facts: DataFrame, wanted: DataFrame, metric: str) -> DataFrame:
    """(ticker, date, gs): the median symmetric yearly growth of the last four quarters alone, in percent with two places."""
    back = eight_back(facts, wanted, metric)
    pair = back.withColumn("__b", F.lag("value", 4).over(Window.partitionBy("ticker", "date").orderBy("k")))
    return pair.groupBy("ticker", "date").agg(F.round(100 * F.median(symmetric_growth(F.col("value"), F.col("__b"))), 2).alias("gs"))


def first_estimated(facts: DataFrame, status: DataFrame, dates: DataFrame, metric: str, tolerance: float = 0.01) -> DataFrame:
    """(ticker, date, feq): which quarter was the first estimate at each date.

    From the status (ticker, feq, checked) the quarter is taken back by a quarter for each 90 days; of that one and its neighbours, the first
    whose revenue changed by more than `tolerance` between the last download by the date and the next one is it, else that one itself.
    """
    downloads = facts.where(F.col("metric") == metric).select("ticker", F.col("download").alias("date"))
    near = asof_both(status.crossJoin(F.broadcast(dates.select("date").distinct())), downloads)
    near = near.where(F.col("before").isNotNull()).withColumn("steps", F.bround(F.datediff("checked", "date") / 90.0, 0).cast("int"))
    near = near.withColumn("guess", F.col("feq") - F.col("steps"))
    candidates = near.select("ticker", "date", "before", "after", "guess", F.explode(F.array(F.col("guess") - 1, F.col("guess"), F.col("guess") + 1)).alias("period"))
    values = facts.where(F.col("metric") == metric).select("ticker", "period", "download", "value")
    a = candidates.join(values.withColumnsRenamed({"download": "before", "value": "v0"}), ["ticker", "period", "before"], "left")
    b = a.join(values.withColumnsRenamed({"download": "after", "value": "v1"}), ["ticker", "period", "after"], "left")
    changed = F.abs(F.col("v1") - F.col("v0")) / F.greatest(F.abs("v1"), F.lit(1.0)) > tolerance
    return b.groupBy("ticker", "date", "guess").agg(F.min(F.when(changed, F.col("period"))).alias("hit")).select("ticker", "date", F.coalesce("hit", "guess").alias("feq"))


def first_changed(facts: DataFrame, wanted: DataFrame, metric: str, unit: float = 1e6, places: int = 1) -> DataFrame:
    """(ticker, date, feq) of wanted (ticker, date): the first quarter whose value, in units and rounded, differs between the downloads around the date.

    Without one: the first quarter that only the later download has. Rows without a later or an earlier download, or without any such quarter, are left out.
    """
    rows = facts.where((F.col("metric") == metric) & F.col("value").isNotNull())
    near = asof_both(wanted.select("ticker", "date").distinct(), facts.where(F.col("metric") == metric).select("ticker", F.col("download").alias("date"))).dropna(subset=["before", "after"])
    sides = near.select("ticker", "date", F.inline(F.array(F.struct(F.col("before").alias("download"), F.lit(0).alias("late")), F.struct(F.col("after").alias("download"), F.lit(1).alias("late")))))
    values = rows.select("ticker", "download", "period", F.round(F.col("value") / unit, places).alias("v"))
    both = sides.join(values, ["ticker", "download"]).groupBy("ticker", "date", "period").agg(F.max(F.when(F.col("late") == 0, F.col("v"))).alias("v0"), F.max(F.when(F.col("late") == 1, F.col("v"))).alias("v1"))
    found = both.groupBy("ticker", "date").agg(
        F.min(F.when(F.col("v0") != F.col("v1"), F.col("period"))).alias("changed"),
        F.min(F.when(F.col("v0").isNull(), F.col("period"))).alias("new"),
        F.count("v0").alias("olds"),
    )
    return found.where("olds > 0").select("ticker", "date", F.coalesce("changed", "new").alias("feq")).where(F.col("feq").isNotNull())


def valuation_metrics(facts: DataFrame, wanted: DataFrame, prices: DataFrame, sales: str, earnings: str, gross: str, shares: str, hold: Hold = lambda df: df) -> DataFrame:
    """(ticker, date, cap, ps, pe, pgp, gs, gs_vol, gs_adj) as reported, of wanted (ticker, date, feq) with a price (ticker, date, close).

    Multiples: capitalisation over four times the median of the eight quarters before feq, zeros left out. gs_vol: deviation of the four yearly growth rates back and
    those ahead, in percent with one place, over 10 and at least 1, 1 with fewer than two rates; shown with three places. gs_adj: gs over it, with two.
    hold: applied to the quarters of sales, which four branches read, e.g. a checkpoint.
    """
    back, ahead = hold(eight_back(facts, wanted, sales)), hold(four_forward(facts, wanted, sales))
    old = back.select("ticker", "date", (F.col("k") + 4).alias("k"), F.col("value").alias("before"))
    pairs = back.where("k >= -4").unionByName(ahead).join(old, ["ticker", "date", "k"]).withColumn("g", F.round(100 * symmetric_growth(F.col("value"), F.col("before")), 1))
    spread = pairs.groupBy("ticker", "date").agg(F.when(F.count("g") >= 2, F.greatest(F.stddev_samp("g") / 10, F.lit(1.0))).otherwise(1.0).alias("__vol"))
    medians = [(back if m == sales else eight_back(facts, wanted, m)).groupBy("ticker", "date").agg(F.median(zero_to_null(F.col("value"))).alias(f"__{n}")) for n, m in (("ps", sales), ("pe", earnings), ("pgp", gross))]
    count = eight_back(facts, wanted, shares).groupBy("ticker", "date").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("k"))).alias("shares"))
    out = count.join(prices.select("ticker", "date", "close"), ["ticker", "date"]).withColumn("cap", F.col("shares") * F.col("close"))
    for part in (*medians, blended_growth(facts, wanted, sales, back, ahead).select("ticker", "date", "gs"), spread):
        out = out.join(part, ["ticker", "date"], "left")
    multiples = (safe_ratio(F.col("cap"), F.col(f"__{n}")).alias(n) for n in ("ps", "pe", "pgp"))
    vol = F.coalesce("__vol", F.lit(1.0))
    return out.select("ticker", "date", "cap", *multiples, "gs", F.round(vol, 3).alias("gs_vol"), F.round(F.col("gs") / vol, 2).alias("gs_adj"))


def point_in_time_metrics(facts: DataFrame, wanted: DataFrame, prices: DataFrame, sales: str, earnings: str, shares: str) -> DataFrame:
    """(ticker, date, cap, ps, pe, gs, gs_vol, gs_adj) of wanted (ticker, date, feq), all tickers and dates in one plan; the shorter form of valuation_metrics().

    Capitalisation: the last known share count times the price of the date. Multiples: capitalisation over four times the median quarter of the
    last four. gs_vol: deviation of the four yearly growth rates in percent over 10, at least 1.
    """
    last4 = lambda metric, out: eight_back(facts, wanted, metric).where("k >= -4").groupBy("ticker", "date").agg(F.median(F.nullif("value", F.lit(0.0))).alias(out))
    count = eight_back(facts, wanted, shares).groupBy("ticker", "date").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("k"))).alias("shares"))
    back = eight_back(facts, wanted, sales)
    old = back.select("ticker", "date", (F.col("k") + 4).alias("k"), F.col("value").alias("before"))
    growth = back.where("k >= -4").join(old, ["ticker", "date", "k"]).withColumn("g", 100 * symmetric_growth(F.col("value"), F.col("before")))
    spread = growth.groupBy("ticker", "date").agg(F.when(F.count("g") >= 2, F.greatest(F.stddev_samp("g") / 10, F.lit(1.0))).otherwise(1.0).alias("gs_vol"))
    out = count.join(prices.select("ticker", "date", "close"), ["ticker", "date"]).withColumn("cap", F.col("shares") * F.col("close"))
    for part in (last4(sales, "__s"), last4(earnings, "__e"), blended_growth(facts, wanted, sales).select("ticker", "date", "gs"), spread):
        out = out.join(part, ["ticker", "date"], "left")
    return out.select("ticker", "date", "cap", safe_ratio(F.col("cap"), F.col("__s")).alias("ps"), safe_ratio(F.col("cap"), F.col("__e")).alias("pe"), "gs", "gs_vol", (F.col("gs") / F.col("gs_vol")).alias("gs_adj"))


def growth_value_factor(metrics: DataFrame, growth: str = "gs_adj", complete: bool = False) -> DataFrame:
    """Adds factor to (date, ticker, sector, growth, multiples): growth less its sector's median, over the median quintile of the positive multiples; complete: of all of them only."""
    rows = demeaned(metrics, growth, "__g", by_median=True)
    multiples = [c for c in ("ps", "pe", "pgp") if c in metrics.columns]
    for c in multiples:
        rows = quantile_bucket(rows.withColumn(f"__{c}", F.when(F.col(c) > 0, F.col(c))), f"__{c}", f"__q_{c}")
    known = F.array_sort(F.filter(F.array(*(F.col(f"__q_{c}").cast("double") for c in multiples)), lambda x: x.isNotNull()))
    n = F.size(known)
    middle = F.when(n > (len(multiples) - 1 if complete else 0), (F.get(known, F.floor((n - 1) / 2).cast("int")) + F.get(known, F.floor(n / 2).cast("int"))) / 2)
    out = rows.withColumn("factor", F.try_divide("__g", middle)).where(F.col("factor").isNotNull())
    return out.select(*metrics.columns, "factor")

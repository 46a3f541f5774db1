"""Studies over many metrics, horizons and dates at once, and the summaries they end in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossweave.operators.panel import asof_backward
from crossweave.operators.signals import decile_spread, ic_summary, sector_ic, t_statistic
from crossweave.operators.xsection import rank01, reflected_value, winsorized, zscore


def outer_joined(parts: dict[str, DataFrame], keys: list[str], value: str) -> DataFrame:
    """A column a part, side by side on `keys`; a key that any part has is kept."""
    long = None
    for name, part in parts.items():
        rows = part.select(*keys, F.lit(name).alias("__part"), F.col(value).alias("__v"))
        long = rows if long is None else long.unionByName(rows)
    # one aggregate in place of a chain of full joins
    return long.groupBy(*keys).agg(*(F.max(F.when(F.col("__part") == name, F.col("__v"))).alias(name) for name in parts))


def all_dates(*tables: DataFrame) -> DataFrame:
    """(date): the dates that any table has."""
    out = tables[0].select("date")
    for t in tables[1:]:
        out = out.unionByName(t.select("date"))
    return out.distinct()


def next_price(prices: DataFrame, anchors: DataFrame) -> DataFrame:
    """(ticker, date, start, close): the first known price from each anchor (date) on, of each ticker that has one."""
    # as-of forward: the next price date, found once over the calendar of the ticker
    known = prices.where(F.col("close").isNotNull()).select("ticker", F.col("date").alias("start"), "close")
    asked = known.select("ticker").distinct().crossJoin(F.broadcast(anchors.select("date").distinct()))  # a few anchors
    both = asked.select("ticker", "date", F.lit(0).alias("__side"), F.lit(None).cast("struct<start:date,close:double>").alias("__p")).unionByName(
        known.select("ticker", F.col("start").alias("date"), F.lit(1).alias("__side"), F.struct("start", F.col("close").cast("double").alias("close")).alias("__p"))
    )
    ahead = Window.partitionBy("ticker").orderBy("date", "__side").rowsBetween(0, Window.unboundedFollowing)
    hit = both.withColumn("__p", F.first("__p", ignorenulls=True).over(ahead)).where((F.col("__side") == 0) & F.col("__p").isNotNull())
    return hit.select("ticker", "date", F.col("__p.start").alias("start"), F.col("__p.close").alias("close"))


def anchored_forward(panel: DataFrame, anchors: DataFrame, horizon: int) -> DataFrame:
    """(ticker, date, fwd): from the last calendar date up to each anchor to the `horizon`-th date after it, where both prices are known.

    `panel` is dense: (ticker, date, i, close) with i the place in the calendar.
    """
    calendar = panel.select("date", "i").distinct()
    near = asof_backward(anchors.select(F.lit(0).alias("__k"), "date").distinct(), calendar.select(F.lit(0).alias("__k"), "date", "i"), ["i"], key="__k").where(F.col("i").isNotNull()).select(F.col("date").alias("anchor"), "i")
    later = F.lead("close", horizon).over(Window.partitionBy("ticker").orderBy("date"))
    rows = panel.withColumn("fwd", F.try_divide(later, F.nullif("close", F.lit(0.0))) - 1).select("ticker", "i", "fwd")
    return rows.join(F.broadcast(near), "i").where(F.col("fwd").isNotNull()).select("ticker", F.col("anchor").alias("date"), "fwd")


def described(rows: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, mean, median, std, lo, hi, p10, p90, positive) of known values; std is of the values as a whole population."""
    c = F.col(value)
    return rows.where(c.isNotNull()).groupBy(*keys).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.stddev_pop(c).alias("std"), F.min(c).alias("lo"), F.max(c).alias("hi"),
        F.percentile(c, F.lit(0.1)).alias("p10"), F.percentile(c, F.lit(0.9)).alias("p90"), F.avg(F.when(c > 0, 100.0).otherwise(0.0)).alias("positive"),
    )


def rolling_mean(rows: DataFrame, value: str, window: int = 63, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds rolling: the mean of full windows of rows by date."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-(window - 1), 0)
    return rows.withColumn("rolling", F.when(F.count(value).over(w) == window, F.avg(value).over(w)))


def in_years(rows: DataFrame, years: list[int], inside: bool = True) -> DataFrame:
    """The rows whose year is, or is not, among `years`."""
    hit = F.year("date").isin(*years)
    return rows.where(hit if inside else ~hit)


def value_composite(rows: DataFrame, weights: dict[str, float], least: int = 3) -> DataFrame:
    """Adds value: multiples reflected where not positive, ranked within date and sector so that cheap is 1, weighted by `weights` over those present.

    Weights are those of metrics that the table has as columns; a row's missing scores count as 0, and a row without any score has none.
    """
    have = {m: w for m, w in weights.items() if m in rows.columns}
    total = sum(have.values())
    if not have or not total:
        return rows.withColumn("value", F.lit(None).cast("double"))
    for m in have:
        rows = reflected_value(rows, m, f"__v_{m}")
        rows = rank01(rows, f"__v_{m}", f"__s_{m}", ("date", "sector"), least=least, descending=True)
    score = sum((F.coalesce(F.col(f"__s_{m}"), F.lit(0.0)) * w for m, w in have.items()), F.lit(0.0)) / total
    some = F.coalesce(*(F.col(f"__s_{m}") for m in have)).isNotNull()
    return rows.withColumn("value", F.when(some, score)).drop(*(f"__{k}_{m}" for m in have for k in "vs"))


def scores_at(scores: DataFrame, wanted: DataFrame, value: str, backfill: bool = False) -> DataFrame:
    """(ticker, date, value): the last score up to each wanted (ticker, date), as a z-score of the date; backfill: else the ticker's first one."""
    held = asof_backward(wanted.select("ticker", "date"), scores.where(F.col(value).isNotNull()).select("ticker", "date", value), [value])
    if backfill:
        first = scores.where(F.col(value).isNotNull()).groupBy("ticker").agg(F.min_by(value, "date").alias("__first"))
        held = held.join(first, "ticker", "left").withColumn(value, F.coalesce(value, "__first")).drop("__first")
    return zscore(held, value, "__z").select("ticker", "date", F.col("__z").alias(value))


def long_metrics(rows: DataFrame, metrics: list[str], targets: dict[int, str]) -> DataFrame:
    """(ticker, date, sector, metric, value, horizon, fwd): a row a metric and horizon."""
    by_metric = rows.unpivot(["ticker", "date", "sector", *targets.values()], metrics, "metric", "value")
    horizons = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(c).alias("fwd")) for h, c in targets.items()))).alias("__h")
    return by_metric.select("ticker", "date", "sector", "metric", "value", horizons).select("ticker", "date", "sector", "metric", "value", "__h.horizon", "__h.fwd")


def ic_study(rows: DataFrame, metrics: list[str], targets: dict[int, str], least: int = 10) -> DataFrame:
    """(metric, horizon, date, ic, n): information coefficients of all metrics and horizons in one plan, for ic_summary by any keys."""
    return sector_ic(_keyed(long_metrics(rows, metrics, targets)), "value", "fwd", least, ("metric", "horizon", "date"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("value").isNotNull() & F.col("fwd").isNotNull())


def study_summary(ics: DataFrame) -> DataFrame:
    return ic_summary(ics, ("metric", "horizon"))


def spread_study(rows: DataFrame, metrics: list[str], targets: dict[int, str], share: float = 0.1) -> DataFrame:
    """(metric, horizon, mean, t, consistency, n): decile spreads of all dates; consistency is the percentage of dates above 0."""
    by_date = decile_spread(long_metrics(rows, metrics, targets), "value", "fwd", share, ("metric", "horizon", "date"))
    return by_date.groupBy("metric", "horizon").agg(F.avg("spread_z").alias("mean"), t_statistic("spread_z").alias("t"), F.avg(F.when(F.col("spread_z") > 0, 100.0).when(F.col("spread_z").isNotNull(), 0.0)).alias("consistency"), F.count("spread_z").alias("n"))


def scored_momentum(rows: DataFrame, value: str, least: int = 5) -> DataFrame:
    """(ticker, date, momentum): z-scores of dates with at least `least` known values; a date without deviation has none."""
    n = F.count(value).over(Window.partitionBy("date"))
    known = rows.where(F.col(value).isNotNull()).withColumn("__n", n).where(F.col("__n") >= least)
    return zscore(known, value, "momentum", flat=None).select("ticker", "date", "momentum")


def momentum_at(residuals: DataFrame, wanted: DataFrame, long: int = 252, skip: int = 21, least: int = 5, scaled: bool = False) -> DataFrame:
    """(ticker, date, momentum) of wanted (ticker, date): z-scores of the sum of residuals from `long` to `skip` + 1 dates back, all strictly before the date.

    A date needs `long` + 1 dates of residuals before it and `least` names; a name without residuals in the window has a sum of 0, one without any has none.
    scaled: residuals times the column scalar, as it is, where all but ten dates of the window, at least, have a scalar of any name; a name that never has one has none then.
    """
    has = F.max(F.col("scalar").isNotNull().cast("int")) if scaled else F.max(F.lit(0))
    days = residuals.groupBy("date").agg(has.alias("__has")).withColumn("__asked", F.lit(0))
    both = days.unionByName(wanted.select("date").distinct().select("date", F.lit(0).alias("__has"), F.lit(1).alias("__asked")))
    upto = Window.orderBy("date", F.desc("__asked")).rowsBetween(Window.unboundedPreceding, 0)  # a row a date: an asked date stands before the residuals of its day
    both = both.withColumn("__i", F.sum(1 - F.col("__asked")).over(upto) + F.col("__asked"))
    both = both.withColumn("__overlap", F.sum("__has").over(Window.orderBy("__i").rangeBetween(-long, -skip - 1)))
    product = F.col("resid") * F.col("scalar") if scaled else F.lit(None).cast("double")
    rows = residuals.join(both.where("__asked = 0").select("date", "__i"), "date").select("ticker", "date", "__i", "resid", product.alias("__p"), F.lit(0).alias("__asked"), F.lit(0).cast("long").alias("__overlap"))
    names = residuals.groupBy("ticker").agg(has.alias("__has"))
    asked = wanted.select("ticker", "date").distinct().join(both.where((F.col("__asked") == 1) & (F.col("__i") >= long + 2)).select("date", "__i", "__overlap"), "date").join(names, "ticker")
    nothing = F.lit(None).cast("double")
    line = rows.withColumn("__has", F.lit(0)).unionByName(asked.withColumns({"resid": nothing, "__p": nothing, "__asked": F.lit(1)}))
    total = lambda c: F.coalesce(F.sum(c).over(Window.partitionBy("ticker").orderBy("__i").rangeBetween(-long, -skip - 1)), F.lit(0.0))
    use = F.lit(scaled) & (F.coalesce("__overlap", F.lit(0)) >= long - skip - 10)
    out = line.withColumn("__m", F.when(use, F.when(F.col("__has") == 1, total("__p"))).otherwise(total("resid"))).where("__asked = 1")
    return scored_momentum(out.select("ticker", "date", "__m"), "__m", least)


def top_names(scores: DataFrame, reference: str, n: int, columns: list[str]) -> DataFrame:
    """(date, ticker, rank, columns): the best n names by score of the last date up to the reference."""
    upto = scores.where(F.col("date") <= F.lit(reference))
    last = upto.agg(F.max("date").alias("date"))  # one row
    return upto.join(F.broadcast(last), "date").where(F.col("score").isNotNull()).orderBy(F.desc("score"), "ticker").limit(n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ticker"))).select("date", "ticker", "rank", *columns)


def capped_mean(rows: DataFrame, value: str, cap: str, low: float = 0.02, high: float = 0.98, keys: tuple[str, ...] = ("date", "sector")) -> DataFrame:
    """(keys, mean, n): mean weighted by capitalisation of values clipped to the group's quantiles."""
    known = rows.where(F.col(value).isNotNull() & (F.col(cap) > 0))
    clipped = winsorized(known, value, "__c", keys, low, high)
    return clipped.groupBy(*keys).agg((F.sum(F.col("__c") * F.col(cap)) / F.sum(cap)).alias("mean"), F.count("*").alias("n"))


def moved_caps(sizes: DataFrame, prices: DataFrame) -> DataFrame:
    """(ticker, cap): the last size snapshot of (ticker, date, size), times the last price over the price of that snapshot's date."""
    held = sizes.where(F.col("size").isNotNull()).groupBy("ticker").agg(F.max("date").alias("date"), F.max_by("size", "date").alias("size"))
    known = prices.where(F.col("close").isNotNull())
    last = known.groupBy("ticker").agg(F.max_by("close", "date").alias("__last"))
    moved = held.join(known.select("ticker", "date", "close"), ["ticker", "date"]).join(last, "ticker")
    return moved.select("ticker", (F.col("size") * F.try_divide("__last", F.nullif("close", F.lit(0.0)))).alias("cap"))


def window_sums(facts: DataFrame, wanted: DataFrame, metric: str, first: int, last: int, known_by_date: bool, least: int) -> DataFrame:
    """(ticker, date, total): the sum over quarters feq + first .. feq + last with at least `least` of them known."""
    from crossweave.operators.fundamentals import quarters

    rows = quarters(facts, wanted, metric, first, last, known_by_date)
    return rows.groupBy("ticker", "date").agg(F.when(F.count("value") >= least, F.sum("value")).alias("total"))


def last_changed_quarter(facts: DataFrame, wanted: DataFrame, metric: str, back: int = 2, ahead: int = 1, tolerance: float = 0.01) -> DataFrame:
    """(ticker, date, feq): of the candidates feq - back .. feq + ahead, the most recent that changed between the last two downloads by the date, else feq."""
    rows = facts.where(F.col("metric") == metric)
    downloads = rows.select("ticker", F.col("download").alias("date")).distinct().withColumns({"d1": F.col("date"), "d0": F.lag("date").over(Window.partitionBy("ticker").orderBy("date"))})
    older = asof_backward(wanted.select("ticker", "date", "feq"), downloads, ["d0", "d1"]).where(F.col("d0").isNotNull())
    asked = older.select("ticker", "date", "feq", "d0", "d1", F.explode(F.sequence(F.col("feq") - back, F.col("feq") + ahead)).alias("period"))
    values = rows.select("ticker", "period", "download", "value")
    a = asked.join(values.withColumnsRenamed({"download": "d0", "value": "v0"}), ["ticker", "period", "d0"], "left")
    b = a.join(values.withColumnsRenamed({"download": "d1", "value": "v1"}), ["ticker", "period", "d1"], "left")
    changed: Column = F.abs(F.col("v1") - F.col("v0")) / F.greatest(F.abs("v1"), F.lit(1.0)) > tolerance
    return b.groupBy("ticker", "date", "feq").agg(F.max(F.when(changed, F.col("period"))).alias("hit")).select("ticker", "date", F.coalesce("hit", "feq").alias("feq"))

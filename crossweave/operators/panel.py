"""Calendar, density, filling, returns and as-of joins of long panels (date, ticker, ...).

Row windows of the panel operators run over a dense calendar: densify() first, so that a row of a ticker stands for a row of the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossweave.functions.scalar import clip


def by_ticker() -> Window:
    return Window.partitionBy("ticker").orderBy("date")


def calendar(panel: DataFrame) -> DataFrame:
    """(date, i): the distinct dates and their position from 1. As many rows as dates, whatever the number of tickers."""
    return panel.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")).cast("long"))


def densify(panel: DataFrame, universe: DataFrame | None = None, dates: DataFrame | None = None) -> DataFrame:
    """A row for each ticker and date, with the date's position i; values are NULL where the panel has none.

    Without `universe`, each row is repeated over the gap that follows it, and a ticker's first one over the gap before: one shuffle by ticker, which later windows use too.
    dates: a cheaper table with the panel's dates (date).
    """
    cal = calendar(panel if dates is None else dates)
    if universe is not None:
        return universe.select("ticker").distinct().crossJoin(F.broadcast(cal)).join(panel, ["ticker", "date"], "left")
    values = [c for c in panel.columns if c not in ("ticker", "date")]
    placed = panel.withColumnRenamed("date", "__date").join(F.broadcast(cal.withColumnsRenamed({"date": "__day", "i": "__at"})), F.col("__date").eqNullSafe(F.col("__day")))
    stop = F.broadcast(cal.agg(F.max("i").alias("__stop")))
    order = Window.partitionBy("ticker").orderBy("__at")
    placed = placed.withColumns({"__next": F.lead("__at").over(order), "__first": F.row_number().over(order) == 1}).join(stop)
    start = F.when(F.col("__first"), F.lit(1).cast("long")).otherwise(F.col("__at"))
    gap = placed.withColumn("i", F.explode(F.sequence(start, F.greatest(F.col("__at"), F.coalesce(F.col("__next") - 1, F.col("__stop"))))))
    own = (F.col("i") == F.col("__at")) & F.col("__date").isNotNull() & F.col("ticker").isNotNull()
    return gap.join(F.broadcast(cal), "i").select("ticker", "date", "i", *(F.when(own, F.col(c)).alias(c) for c in values))


def forward_fill(panel: DataFrame, *columns: str, backfill: bool = False) -> DataFrame:
    w = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("ticker").orderBy("date").rowsBetween(0, Window.unboundedFollowing)
    filled = {c: F.last(c, ignorenulls=True).over(w) for c in columns}
    if backfill:
        filled = {c: F.coalesce(x, F.first(c, ignorenulls=True).over(back)) for c, x in filled.items()}
    return panel.withColumns(filled)


def simple_returns(dense: DataFrame, price: str = "close", out: str = "ret") -> DataFrame:
    """Change of the filled price: a gap gives 0, the time before a ticker's first price NULL."""
    filled = dense.withColumn("__p", F.last(price, ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)))
    return filled.withColumn(out, F.try_divide("__p", F.lag("__p").over(by_ticker())) - 1).drop("__p")


def clipped(panel: DataFrame, column: str = "ret", bound: float = 0.5) -> DataFrame:
    return panel.withColumn(column, clip(F.col(column), -bound, bound))


def market_returns(returns: DataFrame) -> DataFrame:
    """(date, mkt): the equal-weighted mean return."""
    return returns.groupBy("date").agg(F.avg("ret").alias("mkt"))


def market_of_prices(prices: DataFrame, price: str = "close", bound: float = 0.5) -> DataFrame:
    """market_returns() of the clipped simple returns of the densified panel, from its rows with positive prices alone: gaps add 0 and count from a name's second date on."""
    rows = prices.where(F.col("ticker").isNotNull() & F.col("date").isNotNull() & F.col(price).isNotNull())
    before = F.lag(price).over(by_ticker())
    moves = rows.select("date", before.isNull().alias("__first"), clip(F.try_divide(F.col(price), before) - 1, -bound, bound).alias("__r"))
    days = moves.groupBy("date").agg(F.sum("__r").alias("__s"), F.count_if("__first").alias("__new"))
    names = F.sum("__new").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1))  # a row a date
    return days.select("date", (F.coalesce("__s", F.lit(0.0)) / F.nullif(F.coalesce(names, F.lit(0)), F.lit(0))).alias("mkt"))


def forward_returns(dense: DataFrame, horizon: int, price: str = "close") -> DataFrame:
    return dense.withColumn("fwd", F.try_divide(F.lead(price, horizon).over(by_ticker()), F.col(price)) - 1)


def valid_dates(returns: DataFrame, min_names: int) -> DataFrame:
    return returns.groupBy("date").agg(F.count("ret").alias("n")).where(F.col("n") >= min_names).select("date")


def complete_dates(dense: DataFrame, column: str, drop: str = "any") -> DataFrame:
    """The dates of a dense panel less those on which any name, or with drop="all" every name, lacks the column."""
    known = F.col(column).isNotNull()
    return dense.groupBy("date").agg((F.every(known) if drop == "any" else F.some(known)).alias("__kept")).where("__kept").select("date")


def spike_filter(prices: DataFrame, up: float = 3.0, down: float = 0.2, band: float = 0.15, price: str = "close") -> DataFrame:
    """Adds spike and cleaned: a jump that comes back within two rows to `band` of where it started is dropped and filled forward."""
    w = by_ticker()
    p, before, one, two = F.col(price), F.lag(price).over(w), F.lead(price).over(w), F.lead(price, 2).over(w)
    back = lambda x: F.coalesce(F.abs(x / before - 1) <= band, F.lit(False))
    jump = F.coalesce((p / before > up) | (p / before < down), F.lit(False))
    flagged = prices.withColumn("spike", jump & (back(one) | back(two)))
    return flagged.withColumn("cleaned", F.last(F.when(~F.col("spike"), p), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def rebalance_calendar(cal: DataFrame, start: str, step_days: int) -> DataFrame:
    """Every `step_days` from `start`, moved to the first date of the calendar on or after it."""
    span = cal.agg(F.max("date").alias("stop"))
    wanted = span.select(F.explode(F.sequence(F.lit(start).cast("date"), F.col("stop"), F.expr(f"interval {step_days} days"))).alias("target"))
    dated = cal.select("date", F.lit(None).cast("date").alias("target")).unionByName(wanted.select(F.col("target").alias("date"), "target"))
    after = Window.orderBy("date", F.col("target").isNull()).rowsBetween(0, Window.unboundedFollowing)  # calendar rows only
    known = dated.withColumn("next", F.first(F.when(F.col("target").isNull(), F.col("date")), ignorenulls=True).over(after))
    return known.where(F.col("target").isNotNull() & F.col("next").isNotNull()).select(F.col("next").alias("date")).distinct()


def asof_backward(target: DataFrame, source: DataFrame, values: list[str], key: str = "ticker") -> DataFrame:
    """Adds to each row of `target` (key, date) the latest `values` of `source` (key, date, values) on or before its date; linear, one shuffle."""
    rows = target.withColumns({"__side": F.lit(1), "__v": F.lit(None).cast(source.select(F.struct(*values)).schema[0].dataType)})
    packed = source.select(key, "date", F.lit(0).alias("__side"), F.struct(*values).alias("__v"))
    both = rows.unionByName(packed, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("date", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return out.select(*target.columns, *(F.col("__v")[v].alias(v) for v in values))


def equality_filled(target: DataFrame, source: DataFrame, values: list[str], backfill: bool = False) -> DataFrame:
    """Adds the values of source rows of the same (ticker, date), then carries them forward; what source has on dates that target lacks is lost, unlike in asof_backward()."""
    return forward_fill(target.join(source.select("ticker", "date", *values), ["ticker", "date"], "left"), *values, backfill=backfill)


def asof_both(target: DataFrame, source: DataFrame, key: str = "ticker") -> DataFrame:
    """Adds before and after to each row of `target` (key, date): the last date of `source` (key, date) up to it and the first one later; linear, one shuffle."""
    rows = target.withColumns({"__side": F.lit(1), "__d": F.lit(None).cast("date")})
    both = rows.unionByName(source.select(key, "date", F.lit(0).alias("__side"), F.col("date").alias("__d")).distinct(), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("date", "__side")
    out = both.withColumns({"before": F.last("__d", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "after": F.first("__d", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    return out.where("__side = 1").drop("__side", "__d")


def latest_version(rows: DataFrame, keys: list[str], value: str, version: str, as_of: Column | None = None) -> DataFrame:
    """The value of each key's latest version, not after `as_of` if given."""
    seen = rows if as_of is None else rows.where(F.col(version) <= as_of)
    return seen.groupBy(*keys).agg(F.max_by(value, version).alias(value), F.max(version).alias(version))


def drawdown(path: DataFrame, value: str = "nav", keys: tuple[str, ...] = ()) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return path.withColumn("drawdown", F.col(value) / F.max(value).over(w) - 1)


def dynamic_cap(prices: DataFrame, snapshots: DataFrame, backfill: bool = False) -> DataFrame:
    """Adds cap to (ticker, date, close): the last size snapshot (ticker, date, size), moved by the price since; backfill: before a ticker's first one, that one."""
    at = snapshots.join(prices.select("ticker", "date", F.col("close").alias("snap_close")), ["ticker", "date"], "left")
    held = asof_backward(prices, at.select("ticker", "date", "size", "snap_close"), ["size", "snap_close"])
    if backfill:
        first = at.where(F.col("size").isNotNull()).groupBy("ticker").agg(F.min_by(F.struct("size", "snap_close"), "date").alias("__f"))
        held = held.join(first, "ticker", "left").withColumns({"snap_close": F.when(F.col("size").isNull(), F.col("__f.snap_close")).otherwise(F.col("snap_close")), "size": F.coalesce("size", "__f.size")}).drop("__f")
    moved = F.col("size") / F.nullif("snap_close", F.lit(0.0)) * F.col("close")
    return held.withColumn("cap", F.coalesce(moved, "size")).drop("size", "snap_close")

"""Cross-sectional scores: each function adds a column, computed within the rows of `keys` (a date, or a date and a sector)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossweave.functions.scalar import clip


def _w(keys: tuple[str, ...]) -> Window:
    return Window.partitionBy(*keys)


#: Tasks for each of Spark's shuffle partitions where many windows follow on small groups: their sorts add up in a task's memory.
TASKS_A_PARTITION = 8


def dealt(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows dealt by group over more tasks than other shuffles have; windows over `keys` and more need no other shuffle."""
    return df.repartition(TASKS_A_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def zscore(df: DataFrame, column: str, out: str, keys: tuple[str, ...] = ("date",), flat: float | None = 0.0) -> DataFrame:
    """(x - mean) / sample deviation; a group without deviation gets `flat`."""
    w = _w(keys)
    z = F.try_divide(F.col(column) - F.avg(column).over(w), F.nullif(F.stddev_samp(column).over(w), F.lit(0.0)))
    return df.withColumn(out, F.when(F.col(column).isNotNull(), F.coalesce(z, F.lit(flat).cast("double"))))


def zscores_held(df: DataFrame, columns: dict[str, str], hold, keys: tuple[str, ...] = ("date",), flat: float | None = 0.0) -> DataFrame:
    """zscore() of several columns, out of means and deviations that are held, a row a group: the rows are read twice and stay where they are."""
    sums = {c: (F.avg(c).alias(f"__mean{k}"), F.stddev_samp(c).alias(f"__sd{k}")) for k, c in enumerate(columns)}
    groups = hold(df.groupBy(*keys).agg(*(x for pair in sums.values() for x in pair)))
    rows = df.join(F.broadcast(groups), [*keys], "left")
    z = lambda k, c: F.try_divide(F.col(c) - F.col(f"__mean{k}"), F.nullif(F.col(f"__sd{k}"), F.lit(0.0)))
    rows = rows.withColumns({out: F.when(F.col(c).isNotNull(), F.coalesce(z(k, c), F.lit(flat).cast("double"))) for k, (c, out) in enumerate(columns.items())})
    return rows.drop(*(f"__{s}{k}" for k in range(len(columns)) for s in ("mean", "sd")))


def average_rank(column: str, keys: tuple[str, ...], descending: bool = False) -> Column:
    """Rank with ties at their mean; rows with NULL must be filtered by the caller's when(). One sort: rank, ties and number come from one window."""
    path = _w(keys).orderBy(F.col(column).asc_nulls_last())
    rank = (F.rank().over(path) + F.count("*").over(path.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2.0
    return known_in(column, keys) + 1 - rank if descending else rank


def known_in(column: str, keys: tuple[str, ...]) -> Column:
    """The group's number of values, in the order that average_rank() sorts by."""
    return F.count(column).over(_w(keys).orderBy(F.col(column).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def rank01(df: DataFrame, column: str, out: str, keys: tuple[str, ...] = ("date",), single: float | None = 0.5, least: int = 1, descending: bool = False) -> DataFrame:
    """(average rank - 1) / (n - 1); `single` where a group has one value, NULL below `least` values."""
    n = known_in(column, keys)
    r = F.when(n > 1, (average_rank(column, keys, descending) - 1) / (n - 1)).otherwise(F.lit(single).cast("double"))
    return df.withColumn(out, F.when(F.col(column).isNotNull() & (n >= least), r))


def percent_rank(df: DataFrame, column: str, out: str, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """Average rank / n."""
    return df.withColumn(out, F.when(F.col(column).isNotNull(), average_rank(column, keys) / known_in(column, keys)))


def winsorized(df: DataFrame, column: str, out: str, keys: tuple[str, ...] = ("date",), low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clipped to the group's interpolated quantiles."""
    w = _w(keys)
    bounds = df.withColumns({"__lo": F.percentile(column, F.lit(low)).over(w), "__hi": F.percentile(column, F.lit(high)).over(w)})
    return bounds.withColumn(out, clip(F.col(column), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def quantile_bucket(df: DataFrame, column: str, out: str, n: int = 5, keys: tuple[str, ...] = ("date",), tie: str = "ticker") -> DataFrame:
    """1 .. n by equal steps of the row number; ties by `tie`."""
    w = _w(keys)
    known = F.col(column).isNotNull()
    total = F.count(column).over(w)
    r = F.row_number().over(w.orderBy(F.col(column).asc_nulls_last(), tie))
    return df.withColumn(out, F.when(known & (total > 1), F.greatest(F.lit(1), F.ceil((r - 1) * n / (total - 1)))).cast("long"))


def demeaned(df: DataFrame, column: str, out: str, keys: tuple[str, ...] = ("date", "sector"), by_median: bool = False) -> DataFrame:
    centre = F.median(column).over(_w(keys)) if by_median else F.avg(column).over(_w(keys))
    return df.withColumn(out, F.col(column) - centre)


def median_imputed(df: DataFrame, column: str, out: str, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    return df.withColumn(out, F.coalesce(F.col(column), F.median(column).over(_w(keys))))


def reflected_value(df: DataFrame, column: str, out: str, keys: tuple[str, ...] = ("date", "sector")) -> DataFrame:
    """Multiples that are not positive count as dearer than any positive one: max positive + |x|, or max |x| - x without a positive one."""
    w = _w(keys)
    positive, largest = F.max(F.when(F.col(column) > 0, F.col(column))).over(w), F.max(F.abs(column)).over(w)
    return df.withColumn(out, F.when(F.col(column) > 0, F.col(column)).when(positive.isNotNull(), positive + F.abs(column)).otherwise(largest - F.col(column)))


def sector_dummies(tickers: DataFrame, sectors: list[str]) -> DataFrame:
    """Adds x: for each sector 1 if the ticker's own, -1/(K-1) otherwise, 0 if there is one sector."""
    k = len(sectors)
    other = -1.0 / (k - 1) if k > 1 else 0.0
    return tickers.withColumn("x", F.array(*(F.when(F.col("sector") == s, 1.0 if k > 1 else 0.0).otherwise(other) for s in sectors)))


def weighted_composite(df: DataFrame, weights: dict[str, float], out: str) -> DataFrame:
    """Sum of weight * score, missing scores as 0, over the sum of all weights."""
    total = sum(weights.values())
    return df.withColumn(out, sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0)) / (total or 1.0))


def si_composite(df: DataFrame, min_names: int, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """Adds si: mean of the z-scores of short interest and of utilisation (si / available, between 0 and 1), medians for missing values."""
    rows = df.withColumn("util", clip(F.try_divide("si_shares", F.nullif("si_available", F.lit(0.0))), 0.0, 1.0))
    for c in ("si_pct", "util"):
        rows = zscore(median_imputed(rows, c, c, keys), c, f"__z_{c}", keys)
    enough = F.count("si_pct").over(_w(keys)) >= min_names
    return rows.withColumn("si", F.when(enough, (F.col("__z_si_pct") + F.col("__z_util")) / 2)).drop("__z_si_pct", "__z_util")

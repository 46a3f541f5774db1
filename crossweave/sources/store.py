"""Named tables of a model under one folder: namespaces a version, replaced or upserted by date, read from a date on."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.functions.scalar import clean_ticker, nan_to_null
from crossweave.sources.tables import exists, upsert_dates


@dataclass(frozen=True)
class Store:
    """Tables `root/namespace/name`; fallback: the namespace read where a table is missing in the first one."""

    spark: SparkSession
    root: str
    namespace: str = "v1"
    fallback: str | None = None

    def path(self, name: str, namespace: str | None = None) -> str:
        return f"{self.root}/{namespace or self.namespace}/{name}"

    def replace(self, name: str, rows: DataFrame) -> None:
        """The whole table anew; rows without a value in any column beside date and ticker are left out."""
        values = [c for c in rows.columns if c not in ("date", "ticker", "factor")]
        rows.na.drop("all", subset=values or None).write.mode("overwrite").partitionBy("date").parquet(self.path(name))

    def upsert(self, name: str, rows: DataFrame, drop_null: str | None = None) -> None:
        """Replace the dates of `rows`; new columns are added, older dates have NULL there. drop_null: a column whose NULLs are left out."""
        upsert_dates(rows if drop_null is None else rows.where(F.col(drop_null).isNotNull()), self.path(name))

    def scan(self, name: str, schema: str, start: str | None = None, last_days: int | None = None) -> DataFrame:
        """The table from `start` on, or its last days, with the columns of all its files; empty with `schema` where there is none."""
        places = [n for n in (self.namespace, self.fallback) if n is not None and exists(self.spark, self.path(name, n))]
        if not places:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.option("mergeSchema", "true").parquet(self.path(name, places[0])).withColumn("date", F.to_date("date"))
        if start is not None:
            rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
        if last_days is not None:
            newest = rows.agg(F.max("date").alias("__max"))  # one row
            rows = rows.join(F.broadcast(newest), F.col("date") >= F.date_sub("__max", last_days)).drop("__max")
        return rows


def load_ohlc(opens: DataFrame, highs: DataFrame, lows: DataFrame, universe: DataFrame) -> DataFrame | None:
    """(ticker, date, open, high, low) of long tables (date, ticker, value) for the tickers of `universe`; None if any has no row for them.

    Callers without ranges take volatility from closes.
    """
    names = universe.select(clean_ticker(F.col("ticker")).alias("ticker")).distinct()
    parts = {}
    for name, rows in (("open", opens), ("high", highs), ("low", lows)):
        kept = rows.select(F.to_date("date").alias("date"), clean_ticker(F.col("ticker")).alias("ticker"), nan_to_null(F.col("value").try_cast("double")).alias(name)).join(names, "ticker", "left_semi")
        if kept.isEmpty():
            return None
        parts[name] = kept
    return parts["open"].join(parts["high"], ["date", "ticker"], "full").join(parts["low"], ["date", "ticker"], "full").select("ticker", "date", "open", "high", "low")


def aligned(closes: DataFrame, opens: DataFrame, highs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(ticker, date, close, open, high, low) of long tables (date, ticker, value): tickers of all four, dates of the first three; low = high - range."""
    tables = {"close": closes, "open": opens, "high": highs, "range": ranges}
    rows = {k: v.select("date", "ticker", F.col("value").alias(k)) for k, v in tables.items()}
    tickers = dates = None
    for k, v in rows.items():
        names, days = v.select("ticker").distinct(), v.select("date").distinct()
        tickers = names if tickers is None else tickers.join(names, "ticker", "left_semi")
        if k != "range":
            dates = days if dates is None else dates.join(days, "date", "left_semi")
    out = rows["close"]
    for k in ("open", "high", "range"):
        out = out.join(rows[k], ["date", "ticker"], "left" if k == "range" else "full")
    out = out.join(tickers, "ticker", "left_semi").join(dates, "date", "left_semi")
    return out.select("ticker", "date", "close", "open", "high", (F.col("high") - F.col("range")).alias("low"))


def picked_series(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted series of (date, series, value) that there are; the missing ones are named in a warning."""
    have = {r["series"] for r in rows.where(F.col("series").isin(*wanted)).select("series").distinct().collect()}  # at most len(wanted) rows
    if gone := [s for s in wanted if s not in have]:
        warnings.warn("series not found: " + ", ".join(gone), stacklevel=2)
    return rows.where(F.col("series").isin(*have)) if have else rows.limit(0)


def scores_or_computed(store: Store, name: str, dates: DataFrame, compute: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """The stored scores of `dates`; those of dates that the store lacks are computed and added first."""
    wanted = dates.select("date").distinct()
    missing = wanted.join(store.scan(name, schema).select("date").distinct(), "date", "left_anti")
    if not missing.isEmpty():
        store.upsert(name, compute(missing))
    return store.scan(name, schema).join(wanted, "date", "left_semi")

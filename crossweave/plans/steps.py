"""The sequential factor model as data: a list of steps, each stripping its characteristics from what the steps before left.

A step regresses the previous residual on its characteristics, made orthogonal to those of earlier steps first. Steps whose characteristic is
computed from the residual (momentum, mean reversion) name a function of it. The steps from one such to the next are fitted together (operators/blocks.py).
Their coefficients, a row a date, are stored; the rows are written once, before the first step.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from crossweave.operators import panel as P
from crossweave.operators import timeseries as W
from crossweave.operators import xsection as X
from crossweave.operators.blocks import Step, block_fits, stripped
from crossweave.sources.tables import checkpointed, exists, shared_folder, upsert_dates  # noqa: F401  callers take them from here

GRID_MACRO = (0.0, 0.01, 0.05, 0.1, 0.5, 1.0, 2.0)
GRID_SECTOR = (0.0, 0.1, 0.5, 1.0, 2.0, 5.0)


#: Calendar days of residuals that characteristics made from them see before a date; more than their windows span.
HISTORY_DAYS = 400


def _placed(rows: DataFrame, dates: DataFrame | None) -> DataFrame:
    """Rows on the dates with residuals, dense, with __named: the name has a residual on any date."""
    dates = rows.where(F.col("resid").isNotNull()).select("date").distinct() if dates is None else dates
    return P.densify(rows, dates=dates).withColumn("__named", F.count("resid").over(Window.partitionBy("ticker")) > 0)


def momentum(rows: DataFrame, dates: DataFrame | None = None, hold=None) -> DataFrame:
    """Adds momentum to rows (date, ticker, resid, ...). Windows count dates, whether a name has a residual on them or not."""
    kept = [c for c in rows.columns if c not in ("date", "ticker")]
    out = W.idio_momentum(_placed(rows, dates), 26, 4).withColumn("mom", F.when(F.col("__named"), F.col("mom"))).select("date", "ticker", *kept, "mom")
    out = X.zscore(out, "mom", "momentum", flat=0.0) if hold is None else X.zscores_held(out, {"mom": "momentum"}, hold)
    return out.select("date", "ticker", *(c for c in kept if c != "resid" or hold is not None), "momentum")


def _reversion(rows: DataFrame, dates: DataFrame | None = None, hold=None) -> DataFrame:
    kept = [c for c in rows.columns if c not in ("date", "ticker", "resid")]
    dense = _placed(rows, dates).withColumn("__resid", F.col("resid"))
    inputs = W.reversion_inputs(dense, 30, 15, 4, keep=("__resid", "__named", *kept)).withColumn("reversal", F.when(F.col("__named"), F.col("reversal")))
    out = X.zscore(W.reversion_blend(inputs), "__blend", "reversion")
    return out.select("date", "ticker", F.col("__resid").alias("resid"), *kept, "reversion")


_MACRO = ("macro_price", "macro_orders")


def sector_columns(sectors: int) -> tuple[str, ...]:
    return tuple(f"sector{k}" for k in range(sectors))


def version1(sectors: int) -> tuple[Step, ...]:
    """Market, size, macro and sectors first, then the names' own characteristics, each orthogonal to all before."""
    industry = sector_columns(sectors)
    base = ("beta", "size", *_MACRO, *industry)
    return (
        Step("market", ("beta",)),
        Step("size", ("size",), ("beta",)),
        Step("macro", _MACRO, ("beta", "size"), GRID_MACRO, 0.5),
        Step("sectors", industry, ("beta", "size", *_MACRO), GRID_SECTOR, 2.0),
        Step("quality", ("quality",), base),
        Step("short_interest", ("si",), (*base, "quality")),
        Step("vol", ("gk",), (*base, "quality", "si")),
        Step("momentum", ("momentum",), (*base, "quality", "si", "gk"), made=momentum),
        Step("value", ("value",), (*base, "quality", "si", "gk", "momentum")),
        Step("reversion", ("reversion",), made=_reversion),
    )


def version2(sectors: int) -> tuple[Step, ...]:
    """Characteristics first, macro and sectors on what they leave."""
    return (
        Step("market", ("beta",)),
        Step("quality", ("quality",), ("beta",)),
        Step("momentum", ("momentum",), ("beta", "quality"), made=momentum),
        Step("size", ("size",), ("beta", "quality", "momentum")),
        Step("value", ("value",), ("beta", "quality", "momentum", "size")),
        Step("short_interest", ("si",), ("beta", "quality", "momentum", "size", "value")),
        Step("vol", ("gk",), ("beta", "quality", "momentum", "size", "value", "si")),
        Step("macro", _MACRO, (), GRID_MACRO, 0.5),
        Step("sectors", sector_columns(sectors), (), GRID_SECTOR, 2.0),
        Step("reversion", ("reversion",), made=_reversion),
    )


def _blocks(steps: Sequence[Step]) -> list[tuple[int, list[Step]]]:
    """(place of the first, steps) of each run of steps up to the next one made from residuals."""
    out: list[tuple[int, list[Step]]] = []
    for k, step in enumerate(steps, 1):
        if step.made is not None or not out:
            out.append((k, []))
        out[-1][1].append(step)
    return out


def run_steps(rows: DataFrame, steps: Sequence[Step], min_names: int, history: DataFrame | None = None, held: bool = False) -> tuple[DataFrame, DataFrame]:
    """The first two of run_with_moments()."""
    return run_with_moments(rows, steps, min_names, history, held)[:2]


def run_with_moments(rows: DataFrame, steps: Sequence[Step], min_names: int, history: DataFrame | None = None, held: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(figures (k, step, date, intercept, slopes, r2, ridge), residuals (k, step, date, ticker, x), their moments (k, step, date, n, total, squares)) of rows (date, ticker, ret, w, w0, characteristics).

    Residuals of k = 0 are the returns themselves. history: residuals of earlier dates as returned here, of HISTORY_DAYS at least; characteristics
    made from residuals see them too, so that a run over new dates alone gives what a run over all dates gives for these. Dates of `rows` in it don't count.
    held: the rows are cheap to read again, as they are when tables.held_by() dealt them by ticker; rows without a date don't count.
    """
    rows = rows.where(F.col("date").isNotNull()).withColumn("resid", F.col("ret"))
    rows = rows if held else checkpointed(rows)
    if history is not None:
        history = history.join(F.broadcast(rows.select("date").distinct()), "date", "left_anti")
    figures, moments, earlier = [], [], []
    residuals = [rows.where(F.col("resid").isNotNull()).select(F.lit(0).alias("k"), F.lit("raw").alias("step"), "date", "ticker", F.col("resid").alias("x"))]
    for first, block in _blocks(steps):
        if block[0].made is not None:
            dates = None
            if history is not None:
                past = history.where(F.col("k") == first - 1).select("date", "ticker", F.col("x").alias("resid"))
                rows = rows.withColumn("__own", F.lit(True)).unionByName(past, allowMissingColumns=True)
            else:
                rows = rows.withColumn("__own", F.lit(True))
                if earlier:  # a date that has a fit has residuals
                    done, fits = earlier[-1]
                    dates = fits.where(F.get("steps", F.lit(len(done) - 1)).getField("intercept").isNotNull()).select("date")
            rows = block[0].made(rows, dates, checkpointed).where("__own").drop("__own")
        fits = block_fits(rows, block, min_names, checkpointed, earlier)
        name = F.element_at(F.array(*(F.lit(s.name) for s in block)), F.col("pos") + 1)
        each = fits.select("date", F.posexplode("steps")).where(F.col("col.intercept").isNotNull())
        figures.append(each.select((F.col("pos") + first).cast("int").alias("k"), name.alias("step"), "date", "col.intercept", "col.slopes", "col.r2", "col.ridge"))
        if not moments:
            moments.append(fits.select(F.lit(0).alias("k"), F.lit("raw").alias("step"), "date", "given.*"))
        moments.append(fits.select("date", F.posexplode("steps")).select((F.col("pos") + first).cast("int").alias("k"), name.alias("step"), "date", "col.left.*"))
        rows, left = stripped(rows, fits, block, [s for done, _ in earlier for s in done])
        residuals.append(left.withColumnRenamed("k", "pos").select((F.col("pos") + first).cast("int").alias("k"), name.alias("step"), "date", "ticker", "x"))
        earlier.append((block, fits))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(figures), union(residuals), union(moments)


def recent(spark: SparkSession, residuals: str, first: datetime.date, last: datetime.date, days: int = HISTORY_DAYS) -> DataFrame:
    """The stored residuals from `days` before the first date up to the last; other dates' partitions are not read."""
    held = spark.read.parquet(residuals)
    held = held.where((F.col("date") >= F.lit(first - datetime.timedelta(days=days))) & (F.col("date") <= F.lit(last)))
    return held.withColumn("date", F.to_date("date"))


def update_model(rows: DataFrame, steps: Sequence[Step], min_names: int, figures: str, residuals: str) -> None:
    """Run the steps over the dates of `rows` on the recent residuals stored at `residuals`, and replace these dates in both tables.

    Repeating it changes nothing. What is read and computed depends on the dates of `rows` and HISTORY_DAYS, not on how much is stored.
    """
    spark = rows.sparkSession
    span = rows.agg(F.min("date").alias("first"), F.max("date").alias("last")).first()
    if span["first"] is None:
        return
    history = recent(spark, residuals, span["first"], span["last"]) if exists(spark, residuals) else None
    new_figures, new_residuals = run_steps(rows, steps, min_names, history)
    upsert_dates(new_figures, figures)
    upsert_dates(new_residuals, residuals)


def missing_dates(rows: DataFrame, residuals: str, days: int = HISTORY_DAYS) -> DataFrame:
    """(date): dates of the last `days` of `rows` that the stored residuals lack, late ones among them."""
    spark = rows.sparkSession
    span = rows.agg(F.max("date").alias("last")).first()
    if span["last"] is None or not exists(spark, residuals):
        return rows.select("date").distinct()
    asked = rows.where(F.col("date") >= F.lit(span["last"] - datetime.timedelta(days=days))).select("date").distinct()
    return asked.join(recent(spark, residuals, span["last"], span["last"], days).select("date").distinct(), "date", "left_anti")


def stream_model(spark: SparkSession, source: str, schema: StructType | str, steps: Sequence[Step], min_names: int, figures: str, residuals: str, checkpoint: str) -> StreamingQuery:
    """Update the model by the dates of all files that are new under `source`, a table partitioned by date, and stop.

    Each batch reads the partitions of its dates whole, so that a date that comes in several files is computed from all of them; a replay replaces it.
    """

    def batch(arrived: DataFrame, _: int) -> None:
        dates = sorted(r["date"] for r in arrived.select("date").distinct().collect())  # those of the new files
        if dates:
            update_model(spark.read.schema(schema).parquet(source).where(F.col("date").isin(dates)), steps, min_names, figures, residuals)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

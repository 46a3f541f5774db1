"""New dates arrive as files; each is computed once, from a bounded history, and replaces its own partition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crossweave.sources.tables import upsert_dates


def update_dates(spark: SparkSession, source: str, schema, target: str, checkpoint: str, compute: Callable[[DataFrame, DataFrame], DataFrame], history_days: int = 400) -> StreamingQuery:
    """Run over all files that are new under `source` and stop. compute(history, dates) gives the rows of `dates`; a replay replaces them."""

    def batch(rows: DataFrame, _: int) -> None:
        dates = rows.select("date").distinct()
        span = dates.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
        history = spark.read.schema(schema).parquet(source).join(F.broadcast(span), (F.col("date") >= F.date_sub("lo", history_days)) & (F.col("date") <= F.col("hi"))).drop("lo", "hi")
        upsert_dates(compute(history, dates).join(dates, "date", "left_semi"), target)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_events(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """(day, event_type, n, total): counts and sums by tumbling window, late rows up to `late`. Works on streams and tables alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n", "total")

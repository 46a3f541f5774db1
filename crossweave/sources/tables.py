"""Sources and sinks: wide tables to long panels, upserts by date, and computing only what a cache lacks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossweave.functions.scalar import clean_ticker, nan_to_null


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; without that setting, on a local master, a folder made here."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="crossweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: lineage ends there, as at a reliable checkpoint, but compressed."""
    path = f"{shared_folder(df.sparkSession)}/held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_by(df: DataFrame, key: str, *order: str, tasks: int | None = None) -> DataFrame:
    """checkpointed() in buckets of `key`, for rows that are dealt by it over so many tasks (as other shuffles): windows and sums by the key need no other shuffle."""
    spark, name = df.sparkSession, f"held_{uuid.uuid4().hex}"
    buckets = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).sortBy(key, *order).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    held = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: its files are in the shared folder
    return held


def wide_to_long(wide: DataFrame, date: str, value: str) -> DataFrame:
    """(date, ticker, value) of a table with a column a ticker; names are cleaned, of equal ones the first column counts."""
    names = [c for c in wide.columns if c != date]
    long = wide.select(F.to_date(date).alias("date"), *(nan_to_null(F.col(f"`{c}`").try_cast("double")).alias(c) for c in names))
    long = long.unpivot(["date"], names, "__name", value)
    place = F.array_position(F.array(*map(F.lit, names)), F.col("__name"))
    rows = long.withColumns({"ticker": clean_ticker(F.col("__name")), "__k": place})
    return rows.groupBy("date", "ticker").agg(F.min_by(value, "__k").alias(value))


def normalised(rows: DataFrame, ticker: str = "ticker", date: str | None = None) -> DataFrame:
    """The key columns in one form: the ticker's first word upper-cased, the date as a date; what is no date becomes NULL."""
    out = rows.withColumn(ticker, clean_ticker(F.col(ticker)))
    return out if date is None else out.withColumn(date, F.col(date).try_cast("date"))


def first_of(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def upsert_dates(rows: DataFrame, path: str, date: str = "date") -> None:
    """Replace the partitions of the dates in `rows`; other dates stay. Repeating a write changes nothing."""
    rows.repartition(date).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def cache_or_compute(spark: SparkSession, path: str, dates: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of `dates` from the table at `path`; dates that it lacks are computed and added first."""
    missing = dates.select("date").distinct()
    if exists(spark, path):
        missing = missing.join(spark.read.parquet(path).select(F.to_date("date").alias("date")).distinct(), "date", "left_anti")
    if not missing.isEmpty():
        upsert_dates(compute(missing), path)
    held = spark.read.parquet(path)
    return held.withColumn("date", F.to_date("date")).join(dates.select("date").distinct(), "date", "left_semi")

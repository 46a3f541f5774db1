"""Shared Spark helpers: where intermediate tables go, and how columns of an input are addressed."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id wherever ids are compared or shuffled.
NULL_ID = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on local masters a folder made here."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="crossweave-")
    spark.conf.set("spark.checkpoint.dir", made)
    spark.sparkContext.setCheckpointDir(made)
    return made


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` as Parquet to a new place in the shared folder and read it back: lineage ends there, lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, for the small tables of iterations."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], within: Sequence[str], how: str = "inner") -> DataFrame:
    """`left` joined with `right`, which has a row or none for each key, without one task for a key that holds much of `left`.

    `left` is dealt by range of (keys, within), so that a frequent key covers several ranges, and written with the range's number; the rows of
    `right` are copied to the ranges of their key, and key and range together are what the join shuffles by. Adaptive execution merges
    ranges of few bytes before they are written.
    """
    dealt = materialise(left.repartitionByRange(*keys, *within).withColumn("__part", F.spark_partition_id()), "spread")
    cells = dealt.select(*keys, "__part").distinct().join(right, list(keys))
    return dealt.join(cells, [*keys, "__part"], how).drop("__part")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_id(column: str = "doc_id"):
    """The id as a long; a null id is NULL_ID."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def put(df: DataFrame, **columns) -> DataFrame:
    """Add columns; an input column of the same name gives way."""
    return df.withColumns(columns)


def keep_first_names(df: DataFrame, new: Sequence[str]) -> list[str]:
    """Names of df's columns other than `new`, for outputs in which operator columns replace input columns of the same name."""
    taken = {x.lower() for x in new}
    return [c for c in df.columns if c.lower() not in taken]

"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

A key's hash is its place on the ring, the next virtual node clockwise names its shard, and keys that find the shard full go on clockwise.
The ring is cut into a fixed number of cells. Spark counts the keys of each cell; these counts, as many as the ring has cells whatever the
input, are all that the driver sees. From them it fills the shards, each up to its quota: first every cell's own shard, then what is left
over, clockwise. The result is a list of stretches (cell, ranks, shard, first slot), of bounded size too, which the rows join by cell and
rank within the cell. Equal rows are counted before anything is shuffled, and take consecutive ranks. Rows are ranked within a cell; a cell that
holds much more than the mean (one doc_id, or no doc_id, of many texts) is cut into as many bins by text as it holds means, so that there
are at most twice as many bins as cells, and runs of equal rows are cut into stretches of at most RUN rows before they become rows again.

With slack 0 the quotas are exact: row counts of shards differ by one at most. A larger slack leaves more keys with their first shard, so
that fewer move when shards are added.

Defined results: a null doc_id is a key of its own; a null or empty text has size `overhead`, and very long texts count whole; equal rows get
different slots, and among rows that are equal in rank order which gets which makes no difference; shards without rows are possible only
with fewer rows than shards; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossweave.llm.common import materialise, shuffle_partitions

#: Bytes of a row beside its text.
OVERHEAD = 16
#: Equal rows that one row stands for at most when it becomes rows again.
RUN = 4096


@dataclass(frozen=True)
class Ring:
    """cells: at least four a virtual node, so that nodes rarely meet. slack: the share by which a shard may exceed the mean."""

    shards: int = 40
    nodes: int = 64
    cells: int = 1 << 14
    slack: float = 0.0

    def __post_init__(self) -> None:
        if self.shards < 1 or self.nodes < 1 or self.shards * self.nodes > self.cells or self.slack < 0:
            raise ValueError("a ring needs shards, nodes, a cell for each virtual node, and no negative slack")

    def owners(self) -> tuple[list[int], list[int]]:
        """Cells of the virtual nodes in order, and their shards. A node keeps its cell when shards are added, but for ties."""
        taken: dict[int, int] = {}
        for shard in range(self.shards):
            for node in range(self.nodes):
                cell = _mix(shard * 1_000_003 + node + 1) % self.cells
                while cell in taken:
                    cell = (cell + 1) % self.cells
                taken[cell] = shard
        places = sorted(taken)
        return places, [taken[p] for p in places]


def _mix(x: int) -> int:
    mask = (1 << 64) - 1
    x = (x * 0x9E3779B97F4A7C15) & mask
    x ^= x >> 32
    x = (x * 0xD6E8FEB86659FD93) & mask
    return x ^ (x >> 32)


def stretches(counts: dict[int, int], ring: Ring) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, last rank + 1, shard, slot of the first rank) that place all keys counted by cell."""
    total = sum(counts.values())
    low, extra = divmod(total, ring.shards)
    quota = [max(low + (s < extra), int((1 + ring.slack) * total / ring.shards)) for s in range(ring.shards)]
    used = [0] * ring.shards
    places, owner = ring.owners()
    out, over = [], []

    def put(cell: int, first: int, n: int, shard: int) -> int:
        take = min(n, quota[shard] - used[shard])
        if take:
            out.append((cell, first, first + take, shard, used[shard]))
            used[shard] += take
        return take

    for cell in sorted(counts):
        at = bisect.bisect_left(places, cell) % len(places)
        took = put(cell, 0, counts[cell], owner[at])
        if took < counts[cell]:
            over.append((cell, took, counts[cell] - took, at))
    following = list(range(1, len(places))) + [0]  # skips nodes of full shards
    for cell, first, n, at in over:
        while n:
            path = []
            at = following[at]
            while used[owner[at]] >= quota[owner[at]]:
                path.append(at)
                at = following[at]
            for p in path:
                following[p] = at
            took = put(cell, first, n, owner[at])
            first, n = first + took, n - took
    return out


def _place(ring: Ring) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(ring.cells)).cast("int")


def _inlined(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A table of rows that the driver made, as a literal."""
    names = [c.split()[0] for c in columns.split(", ")]
    text = json.dumps([dict(zip(names, x, strict=True)) for x in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{columns}>>")))


def ranked_runs(runs: DataFrame, counts: dict[int, int], ring: Ring) -> DataFrame:
    """`runs` (doc_id, size, text_crc32, count, cell) with first, the rank of a run's first row in its cell."""
    mean = max(1.0, sum(counts.values()) / ring.cells)
    hot = [(c, math.ceil(n / mean)) for c, n in counts.items() if n > max(RUN, 4 * mean)]  # as many bins in all as there are cells at most
    spark = runs.sparkSession
    binned = runs.join(F.broadcast(_inlined(spark, hot, "cell int, bins int")), "cell", "left") if hot else runs.withColumn("bins", F.lit(None).cast("int"))
    binned = binned.withColumn("bin", F.pmod(F.xxhash64("text_crc32", "size", "doc_id"), F.coalesce("bins", F.lit(1))).cast("int")).drop("bins")
    order = Window.partitionBy("cell", "bin").orderBy(F.xxhash64("doc_id", "text_crc32"), "doc_id", "text_crc32", "size")
    ranked = binned.withColumn("first", F.coalesce(F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if not hot:
        return ranked.drop("bin")
    sizes = binned.where(F.col("cell").isin([c for c, _ in hot])).groupBy("cell", "bin").agg(F.sum("count").alias("n")).collect()  # a row a bin
    before, starts = dict.fromkeys((c for c, _ in hot), 0), []
    for r in sorted(sizes):
        starts.append((r["cell"], r["bin"], before[r["cell"]]))
        before[r["cell"]] += r["n"]
    moved = ranked.join(F.broadcast(_inlined(spark, starts, "cell int, bin int, start long")), ["cell", "bin"], "left")
    return moved.withColumn("first", F.col("first") + F.coalesce("start", F.lit(0))).drop("bin", "start")


def sharded(docs: DataFrame, ring: Ring = Ring(), overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of `docs` (doc_id, text); slots of a shard are 0, 1, ..."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # texts are read once: what goes on are three numbers a row
    runs = materialise(rows.groupBy("doc_id", "size", "text_crc32").count().withColumn("cell", _place(ring)), "runs")
    counts = {r["cell"]: r["n"] for r in runs.groupBy("cell").agg(F.sum("count").alias("n")).collect()}  # a row a cell
    keys = ["doc_id", "size", "text_crc32", "cell"]
    parts = ranked_runs(runs, counts, ring).select(*keys, "first", "count", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / RUN))).alias("k"))
    parts = parts.repartition(shuffle_partitions(spark), "cell", "first", "k").withColumn("first", F.col("first") + F.col("k") * RUN)
    each = parts.select(*keys, F.explode(F.sequence("first", F.col("first") + F.least(F.col("count") - F.col("k") * RUN, F.lit(RUN)) - 1)).alias("rank"))
    plan = _inlined(spark, stretches(counts, ring), "c int, a long, b long, s int, t long")
    # at most two stretches a cell and one more a shard
    placed = each.join(F.broadcast(plan), (F.col("cell") == F.col("c")) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b")))
    return placed.select("doc_id", "size", "text_crc32", F.col("s").alias("shard"), (F.col("t") + F.col("rank") - F.col("a")).alias("slot"))

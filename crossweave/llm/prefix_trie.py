"""Trie of conversation prefixes by preorder intervals: members, leaves and saved tokens of every shared prefix.

A turn is a 128-bit digest of role and text, a conversation the array of its turns' digests. Equal conversations become one path, counted before
anything is shuffled by it. Paths are dealt by range and sorted, which ranks them lexicographically: all paths with a given prefix are neighbours.
A task walks its paths turn by turn and names each prefix by a chained digest; grouping by that name gives a node's members and the
interval (low, high) of its paths. Ordered by (low, depth), nodes are in preorder, and a subtree is the stretch from its top to the last node whose
`low` is at most the top's `high`. Nodes are dealt by range of this order; totals of the ranges, a row each, and running sums inside them give
prefix sums, and leaves and savings of a subtree are the difference of two of them. Nothing is gathered by subtree, depth or prefix.

Nodes with very many children or copies: the rows of a node are counted and summed before the shuffle, children look up their parent through
spread_join, and the ids that end at one node are sorted by range, joined to texts there, and hashed as a stream of these texts: SHA-256
has to read them in order, but no task holds them at once.

Defined results: a conversation's turns are in the order of `turn` (null first), equal ones by role, then by the digest of role and text; repeated rows
are turns each; a null role or text is empty; rows without conv_id belong to no conversation and are left out; a rebuilt conversation without turns
ends at the root; conv_ids are 64-bit numbers, and the remainder of negative ones is negative or 0; other columns are not read; an empty table has no
conversation and so no node. A conversation is one array of 16 bytes a turn, which has to fit in a task (some ten million turns).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossweave.llm.common import materialise, spread_join

#: Name of the root; digests of prefixes are as long.
ROOT = bytes(16)
#: Nodes that a task sends on at a time, and characters of ids that are joined into one text.
ROWS, TEXT = 1 << 15, 1 << 16


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes; the role's length in front tells role and text apart."""
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of rows (conv_id, turn, role, text); turns: array of (digest, bytes of the text)."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turn = F.struct(F.col("turn"), role.alias("role"), turn_digest(role, text).alias("h"), F.octet_length(text).cast("long").alias("n"))
    found = rows.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("x"))
    found = found.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return found.select("conv_id", F.transform("x", lambda x: F.struct(x["h"].alias("h"), x["n"].alias("n"))).alias("turns"))


def rebuilt(convs: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Conversations c whose first h turns are those of conversation c - c % family; h: crc32 of c in decimal, modulo `most`."""
    convs = materialise(convs, "conversations")
    heads = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("__first"), F.slice("turns", 1, most - 1).alias("__head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    both = convs.withColumns({"__first": F.col("conv_id") - F.col("conv_id") % family, "__h": h}).join(heads, "__first", "left")
    # F.when keeps slice() from length 0 and start 0
    head = F.when(F.col("__h") > 0, F.slice(F.coalesce("__head", F.slice("turns", 1, 0)), 1, F.greatest("__h", F.lit(1)))).otherwise(F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(head, F.slice("turns", F.col("__h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def path_name(turns: Column) -> Column:
    """The digest of a whole conversation."""
    return F.unhex(F.sha2(F.array_join(F.transform(turns, lambda x: F.hex(x["h"])), ""), 256))


def ranked_paths(convs: DataFrame) -> DataFrame:
    """(place, turns, whole, n, conv_id): distinct conversations in lexicographic order, how many are equal and the smallest of them."""
    paths = convs.groupBy("whole").agg(F.first("turns").alias("turns"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    key = F.transform("turns", lambda x: x["h"])
    return placed(paths.withColumn("__key", key), ["__key"], "place").drop("__key")


def placed(df: DataFrame, order: list[str], name: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """`df` with its 0-based place in `order`, and for each x of `sums` its running sum up to the row as x_upto. Only a row a range reaches the driver."""
    spark = df.sparkSession
    dealt = materialise(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("__part").agg(F.count("*").alias("__n"), *(F.sum(x).alias(f"__{x}") for x in sums)).orderBy("__part").collect()
    before, starts = [0] * (1 + len(sums)), []
    for r in totals:
        starts.append((r["__part"], *before))
        before = [a + b for a, b in zip(before, r[1:], strict=True)]
    names = ["__start", *(f"__start_{x}" for x in sums)]
    # as many rows as there are ranges
    table = spark.createDataFrame(starts, f"__part int, {', '.join(f'{n} long' for n in names)}")
    by = Window.partitionBy("__part").orderBy(*order)
    out = dealt.join(F.broadcast(table), "__part")
    out = out.withColumns({name: F.col("__start") + F.row_number().over(by) - 1} | {f"{x}_upto": F.col(f"__start_{x}") + F.sum(x).over(by.rowsBetween(Window.unboundedPreceding, 0)) for x in sums})
    return out.drop("__part", *names)


def _prefixes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each prefix of each path, the empty one included."""
    kinds = {"node": pa.binary(), "parent": pa.binary(), "depth": pa.int64(), "bytes": pa.int64(), "place": pa.int64(), "n": pa.int64(), "conv_id": pa.int64(), "whole": pa.binary()}
    out: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], [*kinds])

    for batch in it:
        turns = batch.column("turns")
        digests, sizes, at = turns.values.field("h"), turns.values.field("n"), turns.offsets.to_pylist()
        for k, (place, n, conv_id, whole) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("place", "n", "conv_id", "whole")), strict=True)):
            length = at[k + 1] - at[k]
            out.append((ROOT, None, 0, 0, place, n, conv_id, None if length else whole))
            node = ROOT
            for d in range(1, length + 1):
                i = at[k] + d - 1
                parent, node = node, hashlib.blake2b(node + digests[i].as_py(), digest_size=16).digest()
                out.append((node, parent, d, sizes[i].as_py(), place, n, conv_id, whole if d == length else None))
                if len(out) >= ROWS:
                    yield flushed()
                    out.clear()
    if out:
        yield flushed()


def nodes_of(paths: DataFrame) -> DataFrame:
    """(node, parent, depth, bytes, low, high, n_convs, conv_id, whole); whole: the conversation that ends at the node, or null."""
    schema = "node binary, parent binary, depth long, bytes long, place long, n long, conv_id long, whole binary"
    rows = paths.select("place", "turns", "n", "conv_id", "whole").mapInArrow(_prefixes, schema)
    return rows.groupBy("node", "parent", "depth", "bytes").agg(
        F.min("place").alias("low"), F.max("place").alias("high"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("whole").alias("whole")
    )


def _joined_ids(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (whole, conv_id) as (whole, first, text): comma-joined ids, up to TEXT characters a row."""
    out, whole, first, ids, size = [], None, 0, [], 0

    def row() -> tuple[bytes, int, str]:
        return whole, first, ",".join(ids)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], ["whole", "first", "text"])

    for batch in it:
        for w, c in zip(batch.column("whole").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (w != whole or size >= TEXT):
                out.append(row())
                ids, size = [], 0
            if not ids:
                whole, first = w, c
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if out:
            yield made(out)
            out = []
    if ids:
        yield made([row()])


def _hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (whole, first, text) as (whole, ends_sha256)."""
    whole, state, out = None, None, []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], ["whole", "ends_sha256"])

    for batch in it:
        for w, text in zip(batch.column("whole").to_pylist(), batch.column("text"), strict=True):
            if w == whole:
                state.update(b"," + text.as_py().encode())
                continue
            if state is not None:
                out.append((whole, state.hexdigest()))
            whole, state = w, hashlib.sha256(text.as_py().encode())
        if out:
            yield made()
            out = []
    if state is not None:
        out.append((whole, state.hexdigest()))
        yield made()


def ends(convs: DataFrame) -> DataFrame:
    """(whole, ends_sha256): the ids of equal conversations, ascending."""
    ids = convs.select("whole", "conv_id").repartitionByRange("whole", "conv_id").sortWithinPartitions("whole", "conv_id")
    texts = ids.mapInArrow(_joined_ids, "whole binary, first long, text string")
    return texts.repartition("whole").sortWithinPartitions("whole", "first").mapInArrow(_hashed, "whole binary, ends_sha256 string")


def trie(convs: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of the prefixes of (conv_id, turns)."""
    convs = materialise(convs.withColumn("whole", path_name(F.col("turns"))), "paths")
    nodes = nodes_of(ranked_paths(convs)).withColumns({"saved": (F.col("n_convs") - 1) * F.col("bytes"), "leaf": ((F.col("low") == F.col("high")) & F.col("whole").isNotNull()).cast("long")})
    # in preorder, with prefix sums
    nodes = materialise(placed(nodes, ["low", "depth"], "rank", ("saved", "leaf")), "nodes")
    last = nodes.groupBy("low").agg(F.max("saved_upto").alias("saved_end"), F.max("leaf_upto").alias("leaf_end")).withColumnRenamed("low", "high")
    out = spread_join(nodes, last, ["high"], ["rank"])
    children = nodes.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "node")
    hashed = ends(convs).join(nodes.where(F.col("whole").isNotNull()).select("whole", "node"), "whole").drop("whole")
    out = out.join(children, "node", "left").join(hashed, "node", "left")
    named = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = spread_join(out, named, ["parent"], ["rank"], "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        (F.col("leaf_end") - F.col("leaf_upto") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_end") - F.col("saved_upto") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )

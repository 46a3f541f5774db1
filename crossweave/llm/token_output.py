"""Training-order token shards: sequences of a fixed length, in a keyed random order, in files of a fixed stride.

The documents' tokens, each document closed by an end token, are one long stream in table order, cut into sequences of equal length (the last
is padded with end tokens). A keyed Feistel permutation with cycle-walking gives every sequence its slot in training order, so no shuffled
index is stored, and slot and sequence are found from each other in either direction. The pieces of sequences are dealt by range of shard,
sorted by slot, and each task appends its sequences to its shard files: record r of shard s is slot s * rows + r, at byte r * stride, so that
training reads forward and resumes at any slot with one seek.

Two passes read the documents: the first counts tokens by input partition, the second cuts the stream at the offsets that follow. Each task of
the second checks that it reads what was counted and fails otherwise, so an input whose partitions don't repeat is refused rather than
written wrongly. Shards are written under another name and renamed, and their bytes follow from the input alone: a task that runs again after
a lost executor leaves the same file.

Tokens are given as bytes, `width` a token: a tokenizer's ids in the width that its vocabulary needs, with the layout of id_layout(), or
byte_tokens(), of text, a byte a token, with 255, which UTF-8 never has, as end.
The folder has to be one that pyarrow opens: local or shared files, hdfs://, s3://, gs://. Another is refused before any work.
Defined results: null and empty texts are an end token alone; a very long text runs through as many sequences as it needs; equal rows are
documents of their own, in table order, and no two sequences tie for a slot; extra columns are not read; an empty table writes no shard and
gives an empty manifest.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.llm import textkit
from crossweave.llm.bpe import release
from crossweave.llm.common import shared_dir

END_BYTE = b"\xff"
SHARDS_A_TASK = 4


@dataclass(frozen=True)
class Layout:
    """length: tokens of a sequence. width: bytes of a token. rows: sequences of a shard. end: the end token's bytes."""

    length: int = 2048
    width: int = 1
    rows: int = 4096
    key: int = 20240229
    end: bytes = END_BYTE

    @property
    def stride(self) -> int:
        return self.length * self.width


class Permutation:
    """A keyed bijection of 0 .. n-1: four Feistel rounds over the next even number of bits, walked until the value is below n."""

    def __init__(self, n: int, key: int) -> None:
        self.n, bits = n, max(2, (max(n, 1) - 1).bit_length())
        self.half = np.uint64((bits + 1) // 2)
        self.low = np.uint64((1 << int(self.half)) - 1)
        self.keys = textkit.mix64(np.arange(1, 5, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 % (1 << 64)))

    def _rounds(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.low
        for k in keys:
            left, right = right, left ^ (textkit.mix64(right + k) & self.low)
        return (right << self.half) | left  # halves change places, so that the keys in reverse undo it

    def _walk(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = self._rounds(np.asarray(x, np.uint64), keys)
        while (far := out >= self.n).any():
            out[far] = self._rounds(out[far], keys)
        return out.astype(np.int64)

    def slots(self, sequences: np.ndarray) -> np.ndarray:
        return self._walk(sequences, self.keys)

    def sequences(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self.keys[::-1])


def byte_tokens(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def id_layout(path: str, **others: int) -> Layout:
    """The layout for ids of a tokenizer file: its end token (the one named as an end of text, else the first id beyond the vocabulary)."""
    spec = json.load(open(path, encoding="utf-8"))
    named = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
    end = next((named[x] for x in ("<|endoftext|>", "</s>", "<eos>") if x in named), max(named.values()) + 1)
    width = 2 if max(end, *named.values()) <= 0xFFFF else 4
    return Layout(width=width, end=end.to_bytes(width, "little"), **others)


def _pieces(offsets: dict[int, tuple[int, int]], total: int, layout: Layout):
    """Documents' tokens to pieces of sequences: (shard, slot, at, bytes)."""
    n = -(-total // layout.length)
    order, w, length, end = Permutation(n, layout.key), layout.width, layout.length, layout.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part, at, most = None, 0, 0
        held, begin, size = [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            stream = b"".join(held)
            tokens = len(stream) // w
            cuts = np.unique([begin, *range(-(-begin // length) * length, begin + tokens, length), begin + tokens])
            slots = order.slots(cuts[:-1] // length)
            data = [stream[(a - begin) * w : (b - begin) * w] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(slots // layout.rows), pa.array(slots), pa.array((cuts[:-1] % length).astype(np.int32)), pa.array(data, pa.binary())], names=["shard", "slot", "at", "data"])

        for got in batches:
            if part is None and got.num_rows:
                part = got.column("part")[0].as_py()
                at, most = offsets[part]
                begin = at
            for x in got.column("tokens"):
                x = x.as_buffer()
                held += [x.to_pybytes() if x is not None else b"", end]
                size += len(held[-2]) + w
                if size >= 4 << 20:
                    yield from out()
                    begin, held, size = begin + size // w, [], 0
        if part is not None and begin + size // w == total:
            held.append(end * (-total % length))  # the stream's last sequence
        if held:
            yield from out()
        if begin + size // w != at + most:
            raise RuntimeError(f"partition {part} had {most} tokens when they were counted and has {begin + size // w - at} now")

    return run


_SHARDS = "shard long, first_slot long, n_rows long, n_bytes long, sha256 string, path string"


def _writer(folder: str, layout: Layout):
    """Sorted pieces to shard files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        now = file = digest = name = None
        done: list[tuple] = []

        def close() -> None:
            file.close()
            final = f"{root}/shard-{now:08d}.bin"
            store.move(name, final)
            size = store.get_file_info(final).size
            done.append((now, now * layout.rows, size // layout.stride, size, digest.hexdigest(), final))

        for got in batches:
            for shard, data in zip(got.column("shard").to_pylist(), got.column("data"), strict=True):
                if shard != now:
                    if now is not None:
                        close()
                    now, name, digest = shard, f"{root}/.{shard:08d}-{uuid.uuid4().hex}", hashlib.sha256()
                    file = store.open_output_stream(name)
                digest.update(data.as_buffer())
                file.write(data.as_buffer())
        if now is not None:
            close()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate(kinds)], names=["shard", "first_slot", "n_rows", "n_bytes", "sha256", "path"])

    return run


def write_shards(docs: DataFrame, tokens: Column, folder: str, layout: Layout = Layout()) -> DataFrame:
    """Write the shards of a table scan to `folder`, a URI that all executors reach; returns its manifest, a row a shard, once they are written."""
    spark = docs.sparkSession
    if "://" not in folder:
        folder = "file://" + folder
    fs.FileSystem.from_uri(folder)  # fails here rather than in a task
    rows = docs.select(F.spark_partition_id().alias("part"), tokens.alias("tokens"))
    counted = rows.groupBy("part").agg(F.sum(F.octet_length("tokens") + layout.width).alias("size"))
    sizes = {r["part"]: r["size"] // layout.width for r in counted.collect()}  # a row an input partition
    total, offsets = 0, {}
    for part in sorted(sizes):
        offsets[part] = (total, sizes[part])
        total += sizes[part]
    if not total:
        return spark.createDataFrame([], _SHARDS)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    n_shards = -(-(-(-total // layout.length)) // layout.rows)
    pieces = rows.mapInArrow(_pieces(offsets, total, layout), "shard long, slot long, at int, data binary")
    dealt = pieces.repartitionByRange(-(-n_shards // SHARDS_A_TASK), "shard")
    manifest = dealt.sortWithinPartitions("shard", "slot", "at").mapInArrow(_writer(folder, layout), _SHARDS)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(_SHARDS).parquet(f"{folder}/manifest")


def shard_folder(docs: DataFrame, name: str = "token-shards") -> str:
    return f"{shared_dir(docs.sparkSession)}/{name}-{uuid.uuid4().hex}"


def read_slots(folder: str, first: int, n: int, layout: Layout = Layout()) -> Iterator[bytes]:
    """The records of slots first .. first + n - 1, in training order: a seek, then forward reads."""
    store, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
    slot = first
    while slot < first + n:
        shard, row = divmod(slot, layout.rows)
        with store.open_input_file(f"{root}/shard-{shard:08d}.bin") as file:
            file.seek(row * layout.stride)
            while slot < first + n and slot // layout.rows == shard and (record := file.read(layout.stride)):
                yield record
                slot += 1
        if slot // layout.rows == shard:
            return

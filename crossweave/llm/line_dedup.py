"""Line deduplication over a whole corpus.

Each long enough line becomes (128-bit digest of its key, doc_id, position). These rows, never the texts, are dealt by range of all of these and
sorted by hash, then doc_id from the largest, then position; one pass over each partition streams the first occurrence of every hash and
marks the others. A hash whose rows fill more than one range (a line that a third of all documents share, or that one doc_id, or rows without
any, hold very often) is split over partitions: each partition then reports its number of documents, its largest and its smallest doc_id for the runs
at its two ends, and these at most two rows a partition decide the split runs. What returns to the documents is one compressed bitmap of kept lines each.

Defined results: null or empty text is one empty line; keys shorter than `min_chars` are never dropped; a null doc_id counts as the
smallest id, -2 ** 63; rows with an equal doc_id are one document, so that repeated rows never drop each other's lines; a line that one document holds
several times goes or stays as a whole; very long texts and lines are handled whole, in a chunk of their own; an empty table gives an empty
result; input columns named like an output column give way to it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossweave.llm import textkit
from crossweave.llm.common import keep_first_names, materialise, row_id, shuffle_partitions

_MARKS = "kind int, h1 long, h2 long, id long, t long, pos int, docs long"
_DROP, _OPEN, _RUN = 0, 1, 2
_COLS = ("h1", "h2", "id", "t", "pos")


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            ids, t = (got.column(c).to_numpy(zero_copy_only=False) for c in ("id", "t"))
            for lo, _, data, offsets in textkit.byte_chunks(got.column("text")):
                starts, ends, row, pos = textkit.lines(data, offsets)
                starts, ends = textkit.stripped(data, starts, ends)
                long = textkit.code_points(data, starts, ends) >= min_chars
                starts, ends, row, pos = starts[long], ends[long], row[long] + lo, pos[long]
                hashes = textkit.span_digests(data, starts, ends)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hashes[:, 0], hashes[:, 1], ids[row], t[row], pos.astype(np.int32))], names=list(_COLS))

    return run


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, id, t, pos) of each line whose key has at least `min_chars` code points; t tells texts of one doc_id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(row_id().alias("id"), F.xxhash64(text).alias("t"), text.alias("text")).mapInArrow(_keys(min_chars), "h1 long, h2 long, id long, t long, pos int")


def _marker(min_docs: int):
    """Over rows sorted by (h1, h2, id descending, t, pos): drops of the runs inside the partition, and all of its first and last run."""

    def runs(x: dict[str, np.ndarray]) -> np.ndarray:
        """Where runs begin, with the end."""
        new = np.flatnonzero((x["h1"][1:] != x["h1"][:-1]) | (x["h2"][1:] != x["h2"][:-1])) + 1
        return np.concatenate([[0], new, [len(x["h1"])]])

    def batch(kind: int, x: dict[str, np.ndarray], docs: np.ndarray) -> pa.RecordBatch:
        n = len(x["h1"])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(x[c]) for c in _COLS), pa.array(docs.astype(np.int64))], names=["kind", *_COLS, "docs"])

    def at_end(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        n_docs = 1 + int(np.count_nonzero(x["id"][1:] != x["id"][:-1]))
        yield batch(_OPEN, x, np.zeros(len(x["h1"])))
        # id and t: the run's largest and smallest id
        yield batch(_RUN, {c: v[:1] for c, v in x.items()} | {"t": x["id"][-1:]}, np.array([n_docs]))

    def decide(x: dict[str, np.ndarray], at: np.ndarray) -> pa.RecordBatch:
        """The drops of complete runs that begin at at[:-1]."""
        begin = np.zeros(len(x["h1"]), bool)
        begin[at[:-1]] = True
        new_doc = begin.copy()
        new_doc[1:] |= x["id"][1:] != x["id"][:-1]
        run = np.cumsum(begin) - 1
        rank = np.cumsum(new_doc)
        first = rank[at[:-1]]
        docs = np.append(first[1:] - 1, rank[-1]) - first + 1
        gone = (docs[run] >= min_docs) & (rank > first[run])
        return batch(_DROP, {c: v[gone] for c, v in x.items()}, np.zeros(int(gone.sum())))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []  # the rows of the run that is not complete
        head = True  # the partition's first run is not out yet
        for got in batches:
            if not got.num_rows:
                continue
            x = {c: got.column(c).to_numpy(zero_copy_only=False) for c in _COLS}
            if held and x["h1"][-1] == held[0]["h1"][0] and x["h2"][-1] == held[0]["h2"][0]:
                held.append(x)
                continue
            x = {c: np.concatenate([*(h[c] for h in held), x[c]]) for c in _COLS}
            at = runs(x)
            if head and len(at) > 2:
                yield from at_end({c: v[: at[1]] for c, v in x.items()})
                head, x, at = False, {c: v[at[1] :] for c, v in x.items()}, at[1:] - at[1]
            if len(at) > 2:
                yield decide({c: v[: at[-2]] for c, v in x.items()}, at[:-1])
            held = [{c: v[at[-2] :] for c, v in x.items()}]
        if held:
            yield from at_end({c: np.concatenate([h[c] for h in held]) for c in _COLS})

    return mark


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, t, dropped positions) to (id, t, keep): zlib of a bit a line, in whole bytes up to the last dropped one; later lines stay."""
    for got in batches:
        out = []
        for gone in got.column("gone"):
            gone = gone.values.to_numpy(zero_copy_only=False)
            keep = np.ones((int(gone.max()) // 8 + 1) * 8, bool)
            keep[gone] = False
            out.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([got.column("id"), got.column("t"), pa.array(out, pa.binary())], names=["id", "t", "keep"])


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(id, t, keep) of the documents that lose a line."""
    n = shuffle_partitions(docs.sparkSession)
    # written first: dealing by range reads its input twice
    dealt = materialise(line_keys(docs, min_chars), "line-keys").repartitionByRange(n, *_COLS).sortWithinPartitions("h1", "h2", F.col("id").desc(), "t", "pos")
    marks = materialise(dealt.mapInArrow(_marker(min_docs), _MARKS), "line-marks")
    # a document whose rows go on in the next range counts once; a hash has as many notes as ranges at most
    again = (F.col("t") == F.lag("id").over(Window.partitionBy("h1", "h2").orderBy("t", "id"))).cast("int")
    notes = marks.where(F.col("kind") == _RUN).withColumn("docs", F.col("docs") - F.coalesce(again, F.lit(0)))
    split_runs = notes.groupBy("h1", "h2").agg(F.sum("docs").alias("n"), F.max("id").alias("top")).where(F.col("n") >= min_docs)
    # at most two runs of 40 bytes a partition: 80 MB for a million partitions
    late = marks.where(F.col("kind") == _OPEN).join(F.broadcast(split_runs), ["h1", "h2"]).where(F.col("id") < F.col("top"))
    gone = marks.where(F.col("kind") == _DROP).select("id", "t", "pos").unionByName(late.select("id", "t", "pos"))
    return gone.groupBy("id", "t").agg(F.collect_set("pos").alias("gone")).mapInArrow(_bitmaps, "id long, t long, keep binary")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The columns of `docs` with text cut to its kept lines, and n_lines (before) and n_dropped, both long.

    A line goes if its key (stripped of ASCII white space, A-Z lower-cased) has at least `min_chars` code points, at least `min_docs`
    documents hold the key, and this is not the largest doc_id that holds it. A null text stays null if it is the whole document.
    """
    rest = keep_first_names(docs, ["n_lines", "n_dropped"])
    docs = docs.select(*rest)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({"__id": row_id(), "__t": F.xxhash64(text)})
    maps = keep_bitmaps(docs, min_chars, min_docs).withColumnsRenamed({"id": "__id", "t": "__t", "keep": "__keep"})
    joined = keyed.join(maps, ["__id", "__t"], "left").select(*rest, "__keep")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at = rest.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            kind = got.column(at).type
            texts, n_lines, n_dropped = [], [], []
            for x, keep in zip(got.column(at).to_pylist(), got.column("__keep").to_pylist(), strict=True):
                n_lines.append(1 + (x or "").count("\n"))
                n_dropped.append(0)
                if keep is not None:
                    lines = x.split("\n")
                    kept = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)].astype(bool)
                    left = [*(y for y, k in zip(lines, kept, strict=False) if k), *lines[len(kept) :]]
                    n_dropped[-1] = len(lines) - len(left)
                    x = "\n".join(left)
                texts.append(x)
            columns = [pa.array(texts, kind) if i == at else got.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*rest, "n_lines", "n_dropped"])

    return joined.mapInArrow(apply, schema)

"""Product codes of vectors: each part of a vector becomes the number of its codebook's nearest entry, found by annular norm pruning.

Components are integers, floor(scale * x), so that all figures are exact. A codebook's entries are sorted by norm. For a part, the entries next to it in
this order give a first distance d; by the triangle inequality only entries whose norm differs from the part's by d at most can be nearer or
as near, and binary search finds their interval. All of this annulus is evaluated exactly, both ends included, so ties go to the lower index. Norms are
square roots in floating point; the interval is widened by more than their rounding.

Each round reads the vectors once, in tasks that hold the codebooks (64 entries for each component, whatever the number of vectors) and send back sums
for each entry and component, which Spark adds up. Sums travel as limbs of 36 bits, so no number of vectors overflows them.

Defined results: rows whose vector is null or holds null, NaN or infinite components are dropped; so are rows whose vector's length differs from
that of the smallest vec_id's vector. Lengths that parts don't divide are filled with zeros. With fewer vectors than entries there are as many
entries as vectors. A null vec_id counts as the largest; of equal vec_ids the vector smaller in order comes first. Equal vectors get equal
codes. Components of any finite size are exact: those too large for 64-bit arithmetic take a slower way, by the same annulus in Python's integers. An
error or label_error beyond the largest long is given as the largest long. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from crossweave.llm.common import materialise, spread_join

#: Vectors of which distances are evaluated together.
CHUNK = 4096
#: Entries beside a part in the order of norms that give the first distance.
PROBES = 4
#: Components that a task takes at once.
VALUES = 1 << 20
LIMB = 36
MOST = (1 << 63) - 1

Entries = list[tuple[int, ...]]


@dataclass(frozen=True)
class Coding:
    """scale: a power of two, so that scale * x is exact."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256

    def __post_init__(self) -> None:
        if min(self.parts, self.entries, self.scale) < 1 or self.rounds < 0 or self.entries > 256 or self.scale & (self.scale - 1):
            raise ValueError("parts and entries are positive, entries at most 256, scale is a power of two, rounds not negative")


def _whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    n, d = float(x).as_integer_ratio()
    return n * scale // d


def safe(width: int) -> int:
    """Components up to this have squared distances below 2 ** 62, also to the nearest entries that may lie beyond it."""
    return int(math.isqrt((1 << 62) // width) / (3 + 2 * math.sqrt(width)))


class Annulus:
    """A codebook sorted by norm. Rows of `nearest` have components of at most safe(width)."""

    def __init__(self, entries: Entries) -> None:
        self.width = len(entries[0])
        squares = [sum(c * c for c in e) for e in entries]
        self.order = sorted(range(len(entries)), key=lambda k: (squares[k], k))
        self.squares = [squares[k] for k in self.order]
        limit = safe(self.width)
        self.exact = [entries[k] for k in self.order]
        #: no entry whose distances fit: all goes the slow way
        self.plain = any(max(map(abs, e)) <= limit for e in entries)
        far = int(limit * (2 + 2 * math.sqrt(self.width)))  # farther from any row of safe components than any safe entry is
        self.table = np.array([[max(-far, min(far, c)) for c in e] for e in self.exact], np.int64)
        self.norms = np.sqrt((self.table.astype(np.float64) ** 2).sum(axis=1))
        resorted = np.argsort(self.norms, kind="stable")
        self.table, self.norms = self.table[resorted], self.norms[resorted]
        self.index = np.array(self.order, np.int64)[resorted]

    def _distance(self, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        gap = rows - self.table[places]
        return np.einsum("...i,...i->...", gap, gap)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry."""
        n, k = len(rows), len(self.norms)
        norm = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        place = np.searchsorted(self.norms, norm)
        probes = np.clip(place[:, None] + np.arange(-(PROBES // 2), PROBES - PROBES // 2), 0, k - 1)
        best = self._distance(rows[:, None, :], probes).min(axis=1)
        reach = np.sqrt(best.astype(np.float64))
        reach += (reach + norm) * 1e-9 + 1e-6
        low = np.searchsorted(self.norms, norm - reach, "left")
        high = np.searchsorted(self.norms, norm + reach, "right")
        size = high - low  # at least one: the probe that gave `best`
        first = np.cumsum(size) - size
        row = np.repeat(np.arange(n), size)
        at = np.arange(len(row)) - np.repeat(first - low, size)
        distance = self._distance(rows[row], at)
        best = np.minimum.reduceat(distance, first)
        index = np.where(distance == best[row], self.index[at], k)
        return np.minimum.reduceat(index, first), best

    def nearest_exact(self, row: Sequence[int]) -> tuple[int, int]:
        """The same for one row of any integers: outwards from its norm, until entries leave the annulus."""
        square = sum(c * c for c in row)
        at = bisect.bisect_left(self.squares, square)
        best: tuple[int, int] | None = None
        for places in (range(at, len(self.squares)), range(at - 1, -1, -1)):
            for p in places:
                if best is not None:
                    side = square + self.squares[p] - best[0]  # (norm - norm') ** 2 > best, without roots
                    if side > 0 and side * side > 4 * square * self.squares[p]:
                        break
                d = sum((a - b) ** 2 for a, b in zip(row, self.exact[p], strict=True))
                best = min(best or (d, self.order[p]), (d, self.order[p]))
        return best[1], best[0]


class Batch:
    """Vectors of one length as integers: `rows` (vector, part, component), and those too large for it apart."""

    def __init__(self, values: pa.ListArray, dim: int, coding: Coding) -> None:
        flat = np.floor(values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), dim) * float(coding.scale))
        self.width = max(1, -(-dim // coding.parts))
        padded = np.zeros((len(values), coding.parts * self.width), np.float64)
        padded[:, :dim] = flat
        is_wide = (np.abs(padded) > safe(self.width)).any(axis=1)
        self.wide = {}
        for k in np.flatnonzero(is_wide):
            whole = [_whole(x, coding.scale) for x in values[int(k)].as_py()] + [0] * (coding.parts * self.width - dim)
            self.wide[int(k)] = [tuple(whole[p * self.width : (p + 1) * self.width]) for p in range(coding.parts)]
        padded[is_wide] = 0
        self.rows = padded.astype(np.int64).reshape(len(values), coding.parts, self.width)

    def part(self, k: int, p: int) -> tuple[int, ...]:
        return self.wide[k][p] if k in self.wide else tuple(map(int, self.rows[k, p]))

    def assigned(self, books: Sequence[Annulus]) -> tuple[np.ndarray, list[int]]:
        """(codes (vector, part), squared distances summed over parts)."""
        n = len(self.rows)
        codes, found = np.zeros((n, len(books)), np.int64), np.zeros((n, len(books)), np.int64)
        exact: dict[tuple[int, int], int] = {}
        for p, book in enumerate(books):
            if book.plain:
                for a in range(0, n, CHUNK):
                    codes[a : a + CHUNK, p], found[a : a + CHUNK, p] = book.nearest(self.rows[a : a + CHUNK, p])
            for k in self.wide if book.plain else range(n):
                codes[k, p], exact[k, p] = book.nearest_exact(self.part(k, p))
                found[k, p] = 0
        fits = n == 0 or int(found.max()) * len(books) <= MOST
        errors = (found if fits else found.astype(object)).sum(axis=1).tolist()
        for (k, _), more in exact.items():
            errors[k] += more
        return codes, errors


def _batches(it: Iterator[pa.RecordBatch], dim: int, coding: Coding) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    step = max(1, VALUES // max(1, dim))
    for whole in it:
        for a in range(0, len(whole), step):
            batch = whole.slice(a, step)
            yield batch, Batch(batch.column("embedding"), dim, coding)


def _limbs(x: int) -> Iterator[tuple[int, int]]:
    """(number of limb, limb), least first, each with the sign of x."""
    sign, x, k = (-1 if x < 0 else 1), abs(x), 0
    while x:
        yield k, sign * (x & ((1 << LIMB) - 1))
        x >>= LIMB
        k += 1


def kept_vectors(rows: DataFrame, coding: Coding = Coding()) -> tuple[DataFrame, int, list[Entries]]:
    """(rows (vec_id, label, embedding) that are coded, their length, first codebooks)."""
    v = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = rows.select("vec_id", "label", v.alias("embedding")).where(F.col("embedding").isNotNull()).where(F.forall("embedding", finite))
    order = [F.asc_nulls_last("vec_id"), F.col("embedding")]
    one = kept.orderBy(*order).select(F.size("embedding").alias("n")).limit(1).collect()
    dim = one[0]["n"] if one else 0
    kept = kept.where(F.size("embedding") == dim)
    first = [r["embedding"] for r in kept.orderBy(*order).limit(coding.entries).collect()]  # as many as there are entries
    width = max(1, -(-dim // coding.parts))
    whole = [[_whole(x, coding.scale) for x in e] + [0] * (coding.parts * width - dim) for e in first]
    return kept, dim, [[tuple(e[p * width : (p + 1) * width]) for e in whole] for p in range(coding.parts)]


def refined(kept: DataFrame, dim: int, books: list[Entries], coding: Coding = Coding()) -> list[Entries]:
    """The codebooks after one round: each entry becomes the floor of the mean of its parts, unused ones stay."""
    width, entries = len(books[0][0]), len(books[0])

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Annulus(b) for b in books]
        counts = np.zeros((coding.parts, entries), np.int64)
        totals = np.zeros((coding.parts, entries, width), object)
        for _, batch in _batches(it, dim, coding):
            codes, _ = batch.assigned(found)
            added = np.zeros((coding.parts, entries, width), np.int64)
            for p in range(coding.parts):
                np.add.at(added[p], codes[:, p], batch.rows[:, p])  # large ones are zero there
                counts[p] += np.bincount(codes[:, p], minlength=entries)
            totals += added.astype(object)
            for k, parts in batch.wide.items():
                for p, part in enumerate(parts):
                    totals[p, codes[k, p]] += np.array(part, object)
        out = [(int(s), 0, int(n)) for s, n in enumerate(counts.ravel()) if n]
        out += [(-1 - s, k, x) for s, t in enumerate(totals.ravel()) for k, x in _limbs(int(t))]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["slot", "limb", "x"])

    parts = kept.select("embedding").mapInArrow(sums, "slot long, limb long, x long")
    counts: dict[int, int] = {}
    totals: dict[int, int] = {}
    for r in parts.groupBy("slot", "limb").agg(F.sum("x").alias("x")).collect():  # an entry's count and a few limbs of each of its components
        if r["slot"] >= 0:
            counts[r["slot"]] = r["x"]
        else:
            totals[-1 - r["slot"]] = totals.get(-1 - r["slot"], 0) + (r["x"] << (LIMB * r["limb"]))

    def entry(p: int, e: int) -> tuple[int, ...]:
        s = p * entries + e
        return tuple(totals.get(s * width + i, 0) // counts[s] for i in range(width)) if s in counts else books[p][e]

    return [[entry(p, e) for e in range(entries)] for p in range(coding.parts)]


def books_digest(books: list[Entries]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def coded(kept: DataFrame, dim: int, books: list[Entries], coding: Coding = Coding()) -> DataFrame:
    """`kept` as (vec_id, label, code, error)."""
    kept = kept.select("vec_id", "label", "embedding")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Annulus(b) for b in books]
        for batch, vectors in _batches(it, dim, coding):
            codes, errors = vectors.assigned(found)
            text = codes.astype(np.uint8).tobytes().hex()
            step = 2 * coding.parts
            code = [text[k : k + step] for k in range(0, len(text), step)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array([min(int(e), MOST) for e in errors], pa.int64())], ["vec_id", "label", "code", "error"]
            )

    schema = StructType([kept.schema["vec_id"], kept.schema["label"], StructField("code", StringType()), StructField("error", LongType())])
    return kept.mapInArrow(run, schema)


def compressed(rows: DataFrame, coding: Coding = Coding()) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of rows (vec_id, embedding, label)."""
    kept, dim, books = kept_vectors(rows, coding)
    if books[0]:
        for _ in range(coding.rounds):
            books = refined(kept, dim, books, coding)
    else:
        books = [[(0,)] for _ in books]  # nothing is coded by it
    out = materialise(coded(kept, dim, books, coding), "vector-codes")
    keyed = out.withColumns({"__row": F.monotonically_increasing_id(), "__none": F.col("label").isNull(), "__text": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    keys = ["__none", "__text"]
    sums = keyed.groupBy(*keys).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("__sum"))
    sums = sums.select(*keys, F.least(F.col("__sum"), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    joined = spread_join(keyed, sums, keys, ["__row"])
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))

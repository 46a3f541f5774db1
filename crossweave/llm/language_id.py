"""Language identification with n-gram filters that answer for all languages at once.

Training counts character n-grams by language in Spark; each language keeps its most frequent ones. All languages share one bit-sliced
Bloom filter: a slot holds a bit for each language, an n-gram's slots are ANDed, and the result is the set of languages that have it.
A text's n-grams are counted by language (popcounts of the slices); each count is corrected for the false positives that the fill of the
language's slice makes likely, and the largest corrected share decides. The score is that share against the sum of the two best.

The model is fitted on about `sample` different labelled texts of each language, all of them where there are no more: those whose hash is below the
share that gives so many. Copies of a text count once, whatever their ids. Everything else covers all rows.

Defined results: null texts, empty texts and texts without a letter are `und` with score 0; very long texts are judged whole; a text none of
whose n-grams is known gets the most frequent language with score 0.5; all ties, also of that frequency, go to the language first in
alphabetical order; equal texts get equal results, and repeated labelled rows count once; without labelled rows
everything is `und`; extra columns pass through, but a column named like an output column gives way to it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossweave.llm import textkit
from crossweave.llm.bpe import release
from crossweave.llm.common import keep_first_names

#: Lengths in bytes of the n-grams, of lower-cased text with a space for every run of other characters than letters.
SIZES = (3, 4, 5)
#: Labelled texts of a language that training reads, about.
SAMPLE = 4000
#: A language of fewer different texts keeps n-grams that occur once.
FEW = 100
#: N-grams of a language.
KEPT = 20_000
#: A kept n-gram's share of a language's text is at least this part of its share of any other.
DISTINCT = 0.2
SLOT_BITS = 18
PROBES = 2

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_TO_SPACE = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)


def _clean(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters, and one space before, between and after words: bytes and the row of each."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    text = _TO_SPACE[data]
    letter = text != 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:] & (row[:-1] == row[1:])
    keep[1:][~letter[1:] & ~letter[:-1]] &= np.append(letter[2:], False)[~letter[1:] & ~letter[:-1]]
    return text[keep], row[keep]


def _grams(text: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, row) of the n-grams of each size; a hash also tells the size."""
    packed = np.zeros(len(text), np.uint64)
    for size in range(1, max(SIZES) + 1):
        if len(text) < size:
            return
        packed = packed[: len(text) - size + 1] * np.uint64(256) + text[size - 1 :]
        if size in SIZES:
            same = row[: len(packed)] == row[size - 1 :]
            yield textkit.mix64(packed[same]), row[: len(packed)][same]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for got in batches:
        langs = np.array(got.column("lang").to_pylist(), object)
        names, of = np.unique(langs.astype(str), return_inverse=True)
        for lo, hi, data, offsets in textkit.byte_chunks(got.column("text")):
            text, row = _clean(data, offsets)
            for grams, at in _grams(text, row):
                lang = of[lo:hi][at]
                for k in np.unique(lang):
                    g, n = np.unique(grams[lang == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([str(names[k])] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


@dataclass
class Model:
    """langs: by bit. slots: a bit a language. chance: of a false positive, by language. usual: the most frequent language's bit."""

    langs: list[str]
    slots: np.ndarray
    chance: np.ndarray
    usual: int

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """The languages that have each n-gram, as bits."""
        low = np.uint64((1 << SLOT_BITS) - 1)
        out = self.slots[(grams & low).astype(np.int64)]
        for k in range(1, PROBES):
            out = out & self.slots[((grams >> np.uint64(SLOT_BITS * k)) & low).astype(np.int64)]
        return out

    def judge(self, data: np.ndarray, offsets: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bit and score of each text; bit -1: it has no letter."""
        n = len(offsets) - 1
        text, row = _clean(data, offsets)
        total, hits = np.zeros(n), np.zeros((n, len(self.langs)))
        for grams, at in _grams(text, row):
            total += np.bincount(at, minlength=n)
            mask = self.masks(grams)
            for k in range(len(self.langs)):
                hits[:, k] += np.bincount(at[(mask >> np.uint64(k)) & np.uint64(1) > 0], minlength=n)
        # hits = real + chance * (total - real)
        real = np.maximum(0, (hits - self.chance * total[:, None]) / (1 - self.chance))
        best = np.argmax(real, axis=1)
        top = np.sort(real, axis=1)[:, -2:] if len(self.langs) > 1 else np.hstack([np.zeros((n, 1)), real])
        sums = top.sum(axis=1)
        none = sums <= 0
        score = np.where(none, 0.5, top[:, -1] / np.where(none, 1, sums))
        best = np.where(none, self.usual, best)
        return np.where(has, best, -1), np.where(has, score, 0.0)


def sampled(rows: DataFrame, texts: dict[str, int], sample: int) -> DataFrame:
    """(lang, text): about `sample` different texts of each language of rows (lang, text, h); texts: how many there are, about."""
    # all of them where there are no more, so that no language is lost
    share = F.create_map(*(F.lit(x) for lang, n in texts.items() for x in (lang, 1.0 if n <= 1.1 * sample else sample / n)))
    below = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share[F.col("lang")]
    return rows.where(below).groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def fit(labelled: DataFrame, sample: int = SAMPLE, kept: int = KEPT) -> Model:
    """A model of the rows (doc_id, text, lang) of `labelled`; up to 64 languages."""
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.lower("text").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("text"))
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.02).alias("texts")).collect()  # a row a language
    frequency, texts = {r["lang"]: r["n"] for r in found}, {r["lang"]: r["texts"] for r in found}
    langs = sorted(frequency)
    if len(langs) > 64:
        raise ValueError("at most 64 languages")
    if not langs:
        return Model([], np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(0), -1)
    picked = sampled(rows, texts, sample)
    counts = picked.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the sample bounds the number of n-grams; those seen once tell nothing where there are many texts
    few = [lang for lang in langs if texts[lang] < FEW]
    shares = counts.where((F.col("n") > 1) | F.col("lang").isin(few)).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    shares = shares.withColumn("most", F.max("share").over(Window.partitionBy("gram"))).where(F.col("share") >= DISTINCT * F.col("most"))
    best = shares.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= kept).select("lang", "gram").collect()  # kept a language
    slots = np.zeros(1 << SLOT_BITS, np.uint64)
    low = np.uint64((1 << SLOT_BITS) - 1)
    bit = {lang: k for k, lang in enumerate(langs)}
    for lang in langs:
        grams = np.array([r["gram"] for r in best if r["lang"] == lang], np.int64).view(np.uint64)
        for k in range(PROBES):
            slots[((grams >> np.uint64(SLOT_BITS * k)) & low).astype(np.int64)] |= np.uint64(1 << bit[lang])
    fill = np.array([np.count_nonzero(slots & np.uint64(1 << k)) / len(slots) for k in range(len(langs))])
    return Model(langs, slots, fill**PROBES, bit[max(langs, key=lambda x: frequency[x])])  # langs are sorted: the first of the most frequent


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score, from text alone."""
    rest = keep_first_names(docs, ["lang_pred", "score"])
    docs = docs.select(*rest, F.lower("text").alias("__lower"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    schema = T.StructType([f for f in docs.schema.fields if not f.name.startswith("__")] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for got in batches:
            for lo, hi, data, offsets in textkit.byte_chunks(got.column("__lower")):
                letter = got.column("__letter").slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                bits, score = model.judge(data, offsets, letter) if model.langs else (np.full(hi - lo, -1), np.zeros(hi - lo))
                part = got.slice(lo, hi - lo)
                named = pa.array(["und" if k < 0 else model.langs[k] for k in bits], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(rest))), named, pa.array(score)], names=[*rest, "lang_pred", "score"])
        textkit.give_back()

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))

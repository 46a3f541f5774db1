"""Benchmark decontamination: which documents hold a test item.

A BM25 inverted index of the test items is queried with every passage of every document, by block-max WAND: items lie in blocks, each term has
a posting list by block, with its largest contribution there, and a passage is scored against a block's items only if the sum of these maxima
can reach the lowest threshold of the block. The cheapest terms of a block, which together reach a small part of it, are never looked up in
search; their sum is added to the bound instead. An item is retrieved when its score reaches `share` of its score against itself, so the threshold needs
no tuning by corpus. Items of like length are searched together, with passages that overlap by half and are at least as wide as the item, so
that one of them holds at least half of any copy. Retrieved items are verified by the overlap of their word 5-grams, those of the question
and those of the answer.

Item weights (document frequency, mean length) are computed over all items in Spark. The index is made in parts of a bounded number of
words, with memory in proportion to these words, and sent to the tasks in rounds of at most PARTS_A_ROUND parts; a benchmark of any size so
takes more rounds over the documents, not more memory.

Defined results: null and empty texts or items match nothing; very long texts are cut into more passages, a very long item has a part of its
own; rows of one doc_id, and of one item_id, count as one, with the largest figures; items with equal scores are all reported; a null doc_id
or item_id is reported as null; an empty table on either side gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.llm import textkit
from crossweave.llm.common import materialise

GRAM = 5
K1, B = 1.2, 0.75
ITEMS_A_BLOCK = 16
WORDS_A_PART = 40_000
PARTS_A_ROUND = 32
#: Words of the narrowest passages; items of more words get passages of twice the width, and so on.
WIDTH = 64
#: Part of a block's threshold that the terms left out of search can reach together.
SPARED = 0.1
#: Places of temporary arrays in search: bounds memory, never what is searched.
_ROOM = 1 << 20

#: White space and ASCII punctuation separate words here: a passage put into other text often touches it without a space.
_APART = np.zeros(256, dtype=bool)
_APART[[i for i in range(128) if not chr(i).isalnum()]] = True

_ITEMS = "item_id long, words array<long>, question int"
_FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, overlap double"


def _question_words(text: bytes) -> int:
    """Words before the answer, which is the last line, or the last sentence of an item of one line."""
    body = text.rstrip()
    cut = body.rfind(b"\n")
    if cut < 0:
        cut = max(body.rfind(x) for x in (b". ", b"? ", b"! "))
    head = np.frombuffer(body[: cut + 1], np.uint8)
    return len(textkit.words(head, np.array([0, len(head)]), _APART)[0])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in batches:
        ids, words, question = [], [], []
        for item, text in zip(got.column("item_id").to_pylist(), got.column("text").to_pylist(), strict=True):
            raw = (text or "").encode()
            data = np.frombuffer(raw, np.uint8)
            starts, ends, _ = textkit.words(data, np.array([0, len(data)]), _APART)
            ids.append(item)
            words.append(textkit.span_hashes(data, starts, ends).view(np.int64))
            question.append(_question_words(raw))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(question, pa.int32())], names=["item_id", "words", "question"])


def _spread(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches of `count` places from `begin`: the number of the stretch, and the place, of each."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) + np.repeat(begin - (np.cumsum(count) - count), count)


class Part:
    """The inverted index of items (id, words, document frequency of each word, words of the question), all of at most `width` words.

    A posting list entry is a (term, block) with its largest contribution, and its postings are (item, contribution).
    """

    def __init__(self, items: list[tuple], n_items: int, mean: float, share: float, width: int) -> None:
        items.sort(key=lambda x: len(x[1]))  # alike items in a block, so that its lowest threshold says much
        self.ids, self.width = [x[0] for x in items], width
        self.n_blocks = -(-len(items) // ITEMS_A_BLOCK)
        length = np.array([len(x[1]) for x in items], np.int64)
        words = np.concatenate([np.asarray(x[1], np.int64).view(np.uint64) for x in items])
        df = np.concatenate([np.asarray(x[2], float) for x in items])
        self.terms, term = np.unique(words, return_inverse=True)
        item = np.repeat(np.arange(len(items)), length)
        key, at, tf = np.unique(term * len(items) + item, return_index=True, return_counts=True)
        term, item, df = term[at], item[at], df[at]
        idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
        weight = (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / mean))).astype(np.float32)
        least = np.full(self.n_blocks * ITEMS_A_BLOCK, np.inf)
        least[: len(items)] = share * np.bincount(item, weight, len(items))
        self.least = least.reshape(-1, ITEMS_A_BLOCK)
        self.block_least = self.least.min(axis=1)
        # postings are in order of term, block and item
        entry = term * self.n_blocks + item // ITEMS_A_BLOCK
        first = np.flatnonzero(np.diff(entry, prepend=-1))
        self.entry, self.begin = entry[first], np.append(first, len(entry))
        self.slot, self.weight = (item % ITEMS_A_BLOCK).astype(np.int64), weight
        most = np.maximum.reduceat(weight, first)
        # by block, from the smallest maximum: what cannot reach the threshold together is spared
        block = self.entry % self.n_blocks
        order = np.lexsort((most, block))
        sums = np.cumsum(most[order], dtype=float)
        head = np.flatnonzero(np.diff(block[order], prepend=-1))
        sums -= np.repeat(sums[head] - most[order][head], np.diff(np.append(head, len(order))))
        spared = np.zeros(len(order), bool)
        spared[order] = sums < SPARED * self.block_least[block[order]]
        self.spare = np.bincount(block[spared], most[spared], self.n_blocks)
        needed = np.flatnonzero(~spared)
        self.block, self.most = block[needed], most[needed]
        self.term_begin = np.searchsorted(self.entry[needed] // self.n_blocks, np.arange(len(self.terms) + 1))
        self.hint = np.zeros(1 << 16, bool)
        self.hint[(self.terms >> np.uint64(48)).astype(np.int64)] = True
        # grams to verify with; one belongs to the answer if its last word does
        grams, answer = [], []
        for _, w, _, question in items:
            w = np.asarray(w, np.int64).view(np.uint64)
            grams.append(textkit.window_hashes(w, np.zeros(len(w), np.int64), GRAM, 1)[0])
            answer.append(np.arange(len(grams[-1])) + min(GRAM, len(w)) > question)
        self.gram_begin = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
        self.grams, self.answer, self.gram_words = np.concatenate(grams), np.concatenate(answer), np.minimum(GRAM, length)

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms here, and the terms' numbers."""
        maybe = np.flatnonzero(self.hint[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, hashes[maybe]), len(self.terms) - 1)
        real = self.terms[at] == hashes[maybe]
        return maybe[real], at[real]

    def candidates(self, cell: np.ndarray, term: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(cell, block) of passages, a cell of half its width and the next one, whose maxima can reach the block's threshold.

        cell, term: of the words that are terms, in order of cell. last: whether a cell ends a text, so that its passage ends with it.
        """
        count = self.term_begin[term + 1] - self.term_begin[term]
        before = np.concatenate([[0], np.cumsum(count)])
        edge = np.searchsorted(cell, np.arange(len(last) + 1))
        need = self.block_least - self.spare - 1e-3
        at = 0
        while at < len(last):
            # the cell after the last one belongs to its passage
            end = int(np.searchsorted(before[edge], before[edge[at]] + _ROOM, side="right")) - 1
            end = min(max(end, at + 1), at + max(1, _ROOM // self.n_blocks), len(last))
            stop = min(end + 1, len(last))
            k = slice(edge[at], edge[stop])
            of, place = _spread(self.term_begin[term[k]], count[k])
            sums = np.bincount((cell[k][of] - at) * self.n_blocks + self.block[place], self.most[place], (stop - at) * self.n_blocks).reshape(stop - at, -1)
            own = sums[: end - at]
            after = np.zeros_like(own)
            after[: stop - at - 1] = sums[1:]
            after[last[at:end]] = 0
            p, b = np.nonzero(own + after >= need)
            yield p + at, b
            at = end

    def retrieve(self, hashes: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, first word, last word + 1, item, score) of the passages that reach an item's threshold; edges: of the texts in words."""
        step = self.width // 2
        size = np.diff(edges)
        n_cells = -(-size // step)
        cell_begin = np.concatenate([[0], np.cumsum(n_cells)])
        text, number = _spread(np.zeros(len(size), np.int64), n_cells)
        begin = edges[text] + number * step
        end = np.minimum(begin + self.width, edges[text + 1])
        last = number == n_cells[text] - 1
        place, term = self.lookup(hashes)
        of = np.searchsorted(edges, place, side="right") - 1
        cell = cell_begin[of] + (place - edges[of]) // step
        lo, hi = np.searchsorted(place, begin), np.searchsorted(place, end)
        for p, b in self.candidates(cell, term, last):
            cost = np.concatenate([[0], np.cumsum(hi[p] - lo[p])])
            at = 0
            while at < len(p):
                to = max(at + 1, int(np.searchsorted(cost, cost[at] + _ROOM // 4, side="right")) - 1)
                for k, item, score in self._scores(p[at:to], b[at:to], lo, hi, term):
                    yield int(text[p[at + k]]), int(begin[p[at + k]]), int(end[p[at + k]]), item, score
                at = to

    def _scores(self, p: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, int, float]]:
        pair, at = _spread(lo[p], hi[p] - lo[p])
        wanted = term[at] * self.n_blocks + b[pair]
        at = np.minimum(np.searchsorted(self.entry, wanted), len(self.entry) - 1)
        real = self.entry[at] == wanted
        key = np.sort(pair[real] * len(self.entry) + at[real])
        key = key[np.diff(key, prepend=-1) > 0]  # a term counts once a passage
        pair, at = np.divmod(key, len(self.entry))
        of, post = _spread(self.begin[at], self.begin[at + 1] - self.begin[at])
        scores = np.bincount(pair[of] * ITEMS_A_BLOCK + self.slot[post], self.weight[post], len(p) * ITEMS_A_BLOCK).reshape(-1, ITEMS_A_BLOCK)
        for k, slot in zip(*np.nonzero(scores >= self.least[b] - 1e-4), strict=True):
            yield int(k), int(b[k]) * ITEMS_A_BLOCK + int(slot), float(scores[k, slot])

    def overlaps(self, item: int, hashes: np.ndarray) -> tuple[float, float, float]:
        """Shares of the item's grams of the question, of the answer, and of all, that a stretch of words holds."""
        k = slice(self.gram_begin[item], self.gram_begin[item + 1])
        hit, answer = np.isin(self.grams[k], _near(hashes, int(self.gram_words[item]))), self.answer[k]
        return float(hit[~answer].mean()) if not answer.all() else 1.0, float(hit[answer].mean()) if answer.any() else 1.0, float(hit.mean())


def _near(hashes: np.ndarray, length: int) -> np.ndarray:
    """The grams of a stretch of words; length: of the item's grams, below GRAM if it has fewer words."""
    if length == GRAM:
        return textkit.window_hashes(hashes, np.zeros(len(hashes), np.int64), GRAM, 1)[0] if len(hashes) >= GRAM else hashes[:0]
    places = np.arange(max(0, len(hashes) - length + 1))
    flat = hashes[(places[:, None] + np.arange(length)).ravel()]
    return textkit.window_hashes(flat, np.repeat(places, length), GRAM, len(places))[0]


def _search(parts: list[Part], both: float, whole: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            ids = got.column("doc_id")
            found: dict[tuple[int, int, int], tuple] = {}
            for first, last, data, offsets in textkit.byte_chunks(got.column("text")):
                starts, ends, row = textkit.words(data, offsets, _APART)
                hashes = textkit.span_hashes(data, starts, ends)
                edges = np.searchsorted(row, np.arange(last - first + 1))
                for number, part in enumerate(parts):
                    for d, begin, end, item, score in part.retrieve(hashes, edges):
                        lo, hi = max(edges[d], begin - part.width), min(edges[d + 1], end + part.width)
                        q, a, o = part.overlaps(item, hashes[lo:hi])
                        if o >= whole or (q >= both and a >= both):
                            key = (first + d, number, item)
                            if key not in found or found[key][-1] < o:
                                found[key] = (ids[first + d].as_py(), part.ids[item], score, q, a, o)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found.values()], k) for i, k in enumerate((pa.int64(), pa.int64(), *[pa.float64()] * 4))],
                names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "overlap"],
            )

    return run


def _items_by_part(items: DataFrame) -> tuple[DataFrame, list[tuple[int, int]], int, float]:
    """Items with the frequency of each word and their part, written; (number, width) of the parts; number of items, mean length."""
    words = items.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).mapInArrow(_item_words, _ITEMS).where(F.size("words") > 0)
    words = materialise(words.withColumn("item", F.monotonically_increasing_id()), "test-items")
    # items of up to WIDTH words are class 0, of up to twice that 1, and so on
    words = words.withColumn("class", F.greatest(F.ceil(F.log2(F.size("words") / WIDTH)), F.lit(0)).cast("int"))
    classes = sorted(words.groupBy("class").agg(F.count("*"), F.sum(F.size("words"))).collect())
    n_items = sum(r[1] for r in classes)
    if not n_items:
        return words, [], 0, 0.0
    parts, first = [], F.lit(None).cast("int")
    for kind, _, total in classes:
        n = math.ceil(total / WORDS_A_PART)
        first = F.when(F.col("class") == kind, len(parts) + F.pmod(F.xxhash64("item"), F.lit(n))).otherwise(first)
        parts += [(len(parts) + i, WIDTH << kind) for i in range(n)]
    each = words.select("item", F.posexplode("words").alias("i", "word"))
    frequency = each.select("item", "word").distinct().groupBy("word").count()
    counted = each.join(frequency, "word").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("i", "count"))).alias("x")).select("item", F.col("x.count").alias("df"))
    out = words.join(counted, "item").select("item_id", "words", "df", "question", first.alias("part"))
    return materialise(out, "test-index"), parts, n_items, sum(r[2] for r in classes) / n_items


def contaminated(docs: DataFrame, items: DataFrame, share: float = 0.4, both: float = 0.6, whole: float = 0.75) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, overlap) of documents (doc_id, text) that hold an item (item_id, text).

    share: of an item's BM25 score against itself, from which a passage is verified. A verified item counts if `both` of the 5-grams of its
    question and of its answer are near the passage, or `whole` of all its 5-grams.
    """
    table, numbers, n_items, mean = _items_by_part(items)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    out = docs.sparkSession.createDataFrame([], _FOUND)
    for at in range(0, len(numbers), PARTS_A_ROUND):
        parts = []
        for number, width in numbers[at : at + PARTS_A_ROUND]:
            rows = table.where(F.col("part") == number).toArrow()  # about WORDS_A_PART words
            if rows.num_rows:
                lists = [[x.values.to_numpy() for x in rows.column(c)] for c in ("words", "df")]
                parts.append(Part(list(zip(rows.column("item_id").to_pylist(), *lists, rows.column("question").to_pylist(), strict=True)), n_items, mean, share, width))
        out = out.unionByName(docs.mapInArrow(_search(parts, both, whole), _FOUND))
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap", "overlap")))


def decontaminate(docs: DataFrame, items: DataFrame, **limits: float) -> DataFrame:
    """The rows of `docs` whose doc_id holds no item; a null doc_id stays."""
    found = contaminated(docs, items, **limits).where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)

"""Texts that collide in polynomial hashes, and benchmarks of several parts."""

import collections

import numpy as np
import pytest

from crossweave.llm import decontaminate, line_dedup, ngram_join, textkit


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


A, B = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")


def test_hashes_tell_thue_morse_words_apart():
    for n in (128, 255, 256, 1024):
        texts = [x[:n].encode() for x in (A, B)]
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.array([0, n, 2 * n])
        h = textkit.span_hashes(data, offsets[:-1], offsets[1:])
        d = textkit.span_digests(data, offsets[:-1], offsets[1:])
        assert h[0] != h[1] and (d[0] != d[1]).all()


def test_hashes_are_the_same_wherever_a_span_stands():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 8, 9, 16, 100, 255, 256, 300):
        word = rng.integers(97, 123, n).astype(np.uint8)
        data = np.concatenate([rng.integers(0, 255, 13).astype(np.uint8), word, word - 32 * (rng.random(n) < 0.5).astype(np.uint8), np.array([120], np.uint8)])
        h = textkit.span_hashes(data, np.array([13, 13 + n]), np.array([13 + n, 13 + 2 * n]))
        assert h[0] == h[1] and (n == 0 or h[0] != textkit.span_hashes(data, np.array([13]), np.array([12 + n]))[0])


@pytest.fixture
def six(spark):
    return spark.createDataFrame([(i, A if i < 3 else B) for i in range(6)], "doc_id long, text string")


def test_line_dedup_of_thue_morse_lines(six):
    assert {r.n_dropped for r in line_dedup.dedup_lines(six).collect()} == {0}
    assert sorted(r.n_dropped for r in line_dedup.dedup_lines(six, min_docs=3).collect()) == [0, 0, 1, 1, 1, 1]


def test_ngram_join_of_thue_morse_words(spark, six):
    assert {(r.doc_id, r.component_id) for r in ngram_join.gram_components(six).collect()} == {(i, 3 * (i // 3)) for i in range(6)}
    words = [" ".join(x) for x in (A, B)]
    apart = spark.createDataFrame([(0, words[0].replace("a", A).replace("b", "c")), (1, words[0].replace("a", B).replace("b", "c"))], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.gram_components(apart).collect()} == {0, 1}


def test_benchmarks_of_several_parts_and_lengths(spark, monkeypatch):
    """A document that holds items of all parts is found for each, and with as many parts as items results stay."""
    rng = np.random.default_rng(1)
    item = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 3000, n))
    items = [(i, item(n)) for i, n in enumerate([3, 4, 5, 12, 40, 64, 65, 90, 300] * 12)]
    rows = [(1, " ".join(t for _, t in items)), (2, items[7][1]), (3, item(5000)), (4, "x " * 200 + items[8][1].upper()), (None, items[3][1])]
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for words in (decontaminate.WORDS_A_PART, 700, 50):
        monkeypatch.setattr(decontaminate, "WORDS_A_PART", words)
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, tests).collect()}
        assert {(1, i) for i, _ in items} | {(2, 7), (4, 8), (None, 3)} <= got
        # other items can be found by chance only if they are tiny
        assert all(items[i][1].count(" ") < 4 for d, i in got if (d, i) not in {(2, 7), (4, 8), (None, 3)} and d != 1)


def test_block_max_bounds_lose_nothing(monkeypatch):
    """Every passage whose plain BM25 score reaches the threshold is retrieved, and no other, also in small steps."""
    rng = np.random.default_rng(2)
    vocabulary = textkit.mix64(np.arange(1, 400, dtype=np.uint64))
    some = 400 * rng.random(6000) ** 3
    items = [(i, vocabulary[np.minimum(some[rng.integers(0, 6000, rng.integers(2, 40))], 398).astype(int)].view(np.int64), 3) for i in range(90)]
    df = collections.Counter(w for _, x, _ in items for w in set(x.tolist()))
    rows = [(i, x, np.array([df[w] for w in x.tolist()]), q) for i, x, q in items]
    mean = sum(len(x[1]) for x in items) / len(items)
    hashes = vocabulary[np.minimum(some[rng.integers(0, 6000, 3000)], 398).astype(int)]
    edges = np.array([0, 5, 5, 1300, 1364, 3000])
    want = set()
    for d, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        for begin in range(a, b, 32):
            end = min(begin + 64, b)
            held = set(hashes[begin:end].view(np.int64).tolist())
            for i, x, _ in items:
                tf = collections.Counter(x.tolist())
                w = {t: np.log1p((len(items) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t, n in tf.items()}
                if sum(v for t, v in w.items() if t in held) >= 0.4 * sum(w.values()):
                    want.add((d, begin, end, i))
    for room in (1 << 20, 500):
        monkeypatch.setattr(decontaminate, "_ROOM", room)
        part = decontaminate.Part(list(rows), len(items), mean, 0.4, 64)
        assert {(d, a, b, part.ids[i]) for d, a, b, i, _ in part.retrieve(hashes, edges)} == want
    assert len(want) > 20


def test_index_takes_memory_by_words():
    rng = np.random.default_rng(3)
    words = rng.integers(-(1 << 62), 1 << 62, 40_000)
    part = decontaminate.Part([(i, words[3 * i : 3 * i + 3], np.ones(3), 1) for i in range(13_000)], 10**6, 3.0, 0.4, 64)
    size = sum(x.nbytes for x in vars(part).values() if isinstance(x, np.ndarray))
    assert size < 200 * 40_000

"""BPE encoding and decoding of whole documents with a tokenizer file.

Ordinary text: ASCII white space always separates pieces, whatever the tokenizer's own splitting, if the file says so (its normaliser and
splitter drop white space); the different pieces of a batch are found by NumPy, encoded by the library once and then looked up. Long unsplit
text, one piece of more than LONG bytes, is encoded by tree concatenation: its parts between the tokenizer's own splits are halved down to leaves, the leaves are
encoded in parallel, and two neighbours are joined by re-encoding a window around the join that grows until its first token is the left
side's and its last token is the right side's. A sequence of tokens is the BPE encoding of its text if every two neighbours are that of
theirs, so the joined sequence equals an encoding in one go.

Files whose merges depend on more than the text (unknown tokens, dropout, whole words before merges, bytes for unknown characters) have no
trees; the library encodes their long pieces.

Ids are binary: little-endian unsigned 32-bit integers. Defined results: a null or empty text has no ids and decodes to an empty text; a very
long text is encoded in stretches between white space, whole; equal texts get equal ids; ids that the tokenizer doesn't have decode to
nothing; other columns pass through, but an input column named like an output column gives way to it; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from crossweave.llm import textkit
from crossweave.llm.common import keep_first_names

#: Bytes from which a piece without white space is encoded as a tree.
LONG = 2048
#: Characters of a leaf.
LEAF = 512
#: Tokens on each side of a join that are re-encoded first.
WINDOW = 8
#: Short pieces that a task remembers, some 60 bytes each, and eight for each longer one; beyond that it starts afresh.
REMEMBERED = 1_000_000
#: Words of a text that the library encodes at once.
WORDS = 500
#: Bytes of text of a batch.
BATCH_BYTES = 2 << 20

#: Longest piece that is told apart by its bytes as two numbers.
SHORT = 16
#: ASCII letters, and ASCII marks other than the apostrophe, which may begin a contraction.
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[97:123] = True
_MARK[[i for i in range(33, 127) if not chr(i).isalnum() and i != 39]] = True


class Encoder:
    """The tokenizer of a file. encode() gives the ids that the library gives for a whole text, without special tokens added."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # each task has a core; leaves have threads of their own
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.whole = Tokenizer.from_str(json.dumps(spec))
        self.whole.no_truncation()
        self.whole.no_padding()
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.path, self.plain = path, {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": [], "truncation": None, "padding": None}
        self._models: dict[bool, object] = {}
        self._bare = None
        added = spec.get("added_tokens") or []
        self.special = {x["content"]: x["id"] for x in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        # trees and pieces need a splitter that drops white space, and added tokens that take nothing around them
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
        self.by_space = any(s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") for s in steps) and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") for x in added) and spec["model"]["type"] == "BPE"
        model = spec["model"]
        self.trees = not any(model.get(x) for x in ("unk_token", "ignore_merges", "dropout", "byte_fallback", "continuing_subword_prefix"))
        steps = (spec.get("normalizer") or {}).get("normalizers") or []
        self.lowers = self.by_space and bool(self.suffix) and [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and all(x["content"].startswith("<") for x in added)
        tokens = [self.whole.id_to_token(i) or "" for i in range(self.whole.get_vocab_size(with_added_tokens=True))]
        self.ends = np.array([bool(self.suffix) and t.endswith(self.suffix) for t in tokens])
        self.bare = [t[: -len(self.suffix)] if e else t for t, e in zip(tokens, self.ends, strict=True)]
        self.known: dict[bytes, bytes] = {}
        self.short_keys = tuple(np.zeros(0, kind) for kind in (np.uint64, np.uint64, np.uint64, np.int64))
        self.short_ids = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _words(self, words: list[bytes], ascii_only: bool) -> np.ndarray:
        """The ids of words of letters; those of a-z have nothing to normalise, split within or map to bytes."""
        if ascii_only and self._bare is None:
            from tokenizers import Tokenizer

            spec = json.load(open(self.path, encoding="utf-8"))
            self._bare = Tokenizer.from_str(json.dumps(spec | self.plain | {"pre_tokenizer": {"type": "WhitespaceSplit"}}))
        texts = [b" ".join(words[i : i + WORDS]).decode() for i in range(0, len(words), WORDS)]
        return np.concatenate([np.array(x.ids, "<u4") for x in (self._bare if ascii_only else self.whole).encode_batch_fast(texts, add_special_tokens=False)])

    # -- trees

    def _ids(self, text: str, final: bool) -> list[int]:
        """The merges alone, with the suffix that ends a word or without it."""
        if final not in self._models:
            from tokenizers import Tokenizer

            spec = json.load(open(self.path, encoding="utf-8"))
            model = spec["model"] | ({} if final else {"end_of_word_suffix": None})
            self._models[final] = Tokenizer.from_str(json.dumps(spec | self.plain | {"model": model}))
        return self._models[final].encode(text, add_special_tokens=False).ids

    def join(self, left: list[int], right: list[int], final: bool) -> list[int]:
        """The encoding of the texts of two encodings, one after the other; final: the right one ends the word."""
        if not left or not right:
            return left or right
        size = WINDOW
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            text = "".join(self.bare[i] for i in left[a:]) + "".join(self.bare[i] for i in right[:b])
            window = self._ids(text, final and b == len(right))
            if (a == 0 or window[0] == left[a]) and (b == len(right) or window[-1] == right[b - 1]):
                return left[:a] + window + right[b:]
            size *= 2

    def tree(self, word: str) -> list[int]:
        """The encoding of one word of any length."""
        leaves = [word[i : i + LEAF] for i in range(0, len(word), LEAF)]
        final = [False] * (len(leaves) - 1) + [True]
        with ThreadPoolExecutor(2) as pool:  # the library lets other threads run
            parts = list(pool.map(self._ids, leaves, final))
        while len(parts) > 1:
            n = len(parts)
            parts = [self.join(parts[i], parts[i + 1], i + 2 >= n) if i + 1 < n else parts[i] for i in range(0, n, 2)]
        return parts[0]

    def long_piece(self, text: str) -> list[int]:
        """A piece without white space: split as the tokenizer does, long words as trees."""
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                normal = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
                for word, _ in self.whole.pre_tokenizer.pre_tokenize_str(normal):
                    out += self.tree(word) if self.trees and len(word) > LEAF else self._ids(word, True)
        return out

    # -- texts

    def pieces(self, data: np.ndarray, offsets: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, and start and end of the stretches that the tokenizer treats one by one.

        plain: texts without a special token, which is looked for before anything is lower-cased. These are lower-cased if the tokenizer does so
        anyway, and a letter of theirs always ends a word before a mark, as before white space.
        """
        starts, ends, _ = textkit.words(data, offsets)
        if not self.lowers or not plain.any():
            return data, starts, ends
        low = textkit.lowered(data)
        for r in np.flatnonzero(~plain):
            low[offsets[r] : offsets[r + 1]] = data[offsets[r] : offsets[r + 1]]
        letter = _LETTER[low]
        letter[1:] |= (low[:-1] == 0xC3) & (low[1:] != 0x97) & (low[1:] != 0xB7)  # of Latin-1, but for two signs
        cuts = np.flatnonzero(letter[:-1] & _MARK[low[1:]]) + 1
        text = np.searchsorted(offsets, cuts, side="right") - 1
        cuts = cuts[plain[text] & (offsets[text] < cuts)]
        return low, np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))

    def learn(self, pieces: list[bytes], kind: np.ndarray) -> list[bytes]:
        """The ids of pieces. kind: 2 of words of a-z, 1 of words of these and of Latin-1 letters, 0 of others."""
        out: list[bytes | None] = [None] * len(pieces)
        # words of plain letters are encoded many at a time: each ends with the token that has the suffix
        for k in (2, 1):
            at = np.flatnonzero(kind == k).tolist()
            if not at:
                continue
            ids = self._words(list(map(pieces.__getitem__, at)), k == 2)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(at):
                raw, edges = ids.tobytes(), [0, *(4 * ends).tolist()]
                for i, begin, end in zip(at, edges, edges[1:], strict=False):
                    out[i] = raw[begin:end]
        rest = [i for i, x in enumerate(out) if x is None]
        short = [i for i in rest if len(pieces[i]) <= LONG]
        for i, got in zip(short, self.whole.encode_batch_fast([pieces[i].decode(errors="replace") for i in short], add_special_tokens=False), strict=True):
            out[i] = np.array(got.ids, "<u4").tobytes()
        trees: dict[bytes, bytes] = {}
        for i in rest:
            if out[i] is None:
                x = pieces[i]
                if x not in trees:
                    trees[x] = np.array(self.long_piece(x.decode(errors="replace")), "<u4").tobytes()
                out[i] = trees[x]
        return out

    def kinds(self, pieces: list[bytes]) -> np.ndarray:
        """What learn() takes as kind."""
        if not self.lowers or not pieces:
            return np.zeros(len(pieces), np.int8)
        data, size = np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(size)
        starts = ends - size
        plain = _LETTER[data]
        latin = plain.copy()
        pair = (data[:-1] == 0xC3) & (data[1:] >= 0x9F) & (data[1:] != 0xB7)  # lower-case letters: no upper-case ones, no sign
        latin[:-1] |= pair
        latin[1:] |= pair
        every = lambda flags: (before := np.concatenate([[0], np.cumsum(flags, dtype=np.int64)]))[ends] - before[starts] == size
        return np.where(size > LONG, 0, every(latin).astype(np.int8) + every(plain))

    def recall(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces, those not yet known learned first."""
        got = list(map(self.known.get, pieces))
        new = [i for i, x in enumerate(got) if x is None]
        if not new:
            return got
        fresh = list(map(pieces.__getitem__, new))
        learned = self.learn(fresh, self.kinds(fresh))
        if len(self.known) + len(new) > REMEMBERED // 8:
            self.known.clear()
        self.known.update(zip(fresh, learned, strict=True))
        for i, x in zip(new, learned, strict=True):
            got[i] = x
        return got

    def recall_short(self, raw: bytes, starts: np.ndarray, keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """As recall(), of different pieces of `raw` of up to SHORT bytes: the ids of all, and how many each has.

        keys: mixture, in ascending order, both numbers and size of each piece. What is known is kept by these in arrays.
        """
        old, (flat, begin, count) = self.short_keys, self.short_ids
        at = np.searchsorted(old[0], keys[0])
        near = np.minimum(at, max(len(old[0]) - 1, 0))
        hit = np.logical_and.reduce([x[near] == y for x, y in zip(old, keys, strict=True)]) if len(old[0]) else np.zeros(len(starts), bool)
        new = np.flatnonzero(~hit)
        if len(new):
            i, j = starts[new], starts[new] + keys[3][new]
            fresh = [raw[x:y] for x, y in zip(i.tolist(), j.tolist(), strict=True)]
            learned = self.learn(fresh, self.kinds(fresh))
            n = np.fromiter(map(len, learned), np.int64, len(learned)) // 4
            first = len(flat) + np.cumsum(n) - n
            flat = np.concatenate([flat, np.frombuffer(b"".join(learned), "<u4")])
        begins, counts = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        begins[hit], counts[hit] = begin[near[hit]], count[near[hit]]
        if len(new):
            begins[new], counts[new] = first, n
            if len(old[0]) + len(new) > REMEMBERED:  # afresh, with what this batch has
                self.short_keys, flat, begins = keys, *_gathered(flat, begins, counts)
                self.short_ids = flat, begins, counts
            else:
                self.short_keys = tuple(np.insert(x, at[new], y[new]) for x, y in zip(old, keys, strict=True))
                self.short_ids = flat, np.insert(begin, at[new], first), np.insert(count, at[new], n)
        return *_gathered(flat, begins, counts)[:1], counts

    def encode(self, texts: list[bytes]) -> list[bytes]:
        ids, ends = self.encode_column(pa.array(texts, pa.large_binary()))
        return [ids[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin, with the end."""
        if not self.by_space:
            got = [np.array(x.ids, "<u4") for x in self.whole.encode_batch_fast([(x or b"").decode(errors="replace") for x in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *got]), np.concatenate([[0], np.cumsum([len(x) for x in got], dtype=np.int64)])
        ids, sizes = [np.zeros(0, "<u4")], []
        for _, _, data, offsets in textkit.byte_chunks(texts, BATCH_BYTES):
            marked = np.searchsorted(offsets, np.flatnonzero(data == ord("<")), side="right") - 1
            plain = np.ones(len(offsets) - 1, bool)
            plain[marked] = False
            size = np.zeros(len(plain), np.int64)
            for i, j, edges in _stretches(data, offsets):
                got, count = self._encode_chunk(data[i:j], edges, plain)
                ids.append(got)
                size += count
            sizes.append(size)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)

    def _encode_chunk(self, data: np.ndarray, offsets: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, and how many each has."""
        data, starts, ends = self.pieces(data, offsets, plain)
        size = ends - starts
        padded = np.zeros(len(data) + SHORT, np.uint8)
        padded[: len(data)] = data
        wide = np.ndarray(len(data) + SHORT - 8, "<u8", padded, strides=(1,)) if len(data) else np.zeros(1, np.uint64)
        short = np.flatnonzero(size <= SHORT)
        at, n = starts[short], size[short]
        # up to 16 bytes, zeros behind them, as two numbers; their mixture sorts pieces, and the numbers themselves tell whether equals are equal
        a, b = wide[at] & textkit.MASKS[np.minimum(n, 8)], wide[np.minimum(at + 8, len(wide) - 1)] & textkit.MASKS[np.clip(n - 8, 0, 8)]
        mixed = textkit.mix64(a ^ textkit.mix64(b ^ (n.astype(np.uint64) << np.uint64(57))))
        order = np.argsort(mixed)
        ordered = mixed[order]
        begins = np.concatenate([np.ones(min(len(order), 1), bool), ordered[1:] != ordered[:-1]])
        first, of = order[begins], np.empty(len(order), np.int64)
        of[order] = np.cumsum(begins) - 1
        real = (a == a[first][of]) & (b == b[first][of]) & (n == n[first][of])
        lone = np.concatenate([np.flatnonzero(size > SHORT), short[~real]])
        raw = data.tobytes()
        flat, count = self.recall_short(raw, at[first], (mixed[first], a[first], b[first], n[first]))
        others = self.recall([raw[i:j] for i, j in zip(starts[lone].tolist(), ends[lone].tolist(), strict=True)])
        flat = np.concatenate([flat, np.frombuffer(b"".join(others), "<u4")])
        count = np.concatenate([count, np.fromiter(map(len, others), np.int64, len(others)) // 4])
        code = np.empty(len(size), np.int64)
        code[short] = of
        code[lone] = len(first) + np.arange(len(lone))
        ids, before = _taken(flat, count, code)
        return ids, np.diff(before[np.searchsorted(starts, offsets)])


def _taken(flat: np.ndarray, count: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `flat`, `count` ids each, in the order of `code`, and where each begins, with the end."""
    edges = np.concatenate([[0], np.cumsum(count)]) * 4
    runs = pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(flat))]).take(pa.array(code))
    _, at, data = runs.buffers()
    before = np.frombuffer(at, np.int64, len(code) + 1) // 4
    return np.frombuffer(data, "<u4", int(before[-1])) if data is not None else flat[:0], before


def _gathered(flat: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[begin : begin + count] one after another, and where each begins then."""
    at = np.cumsum(counts) - counts
    return flat[np.repeat(begins - at, counts) + np.arange(int(counts.sum()))], at


def _stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Begin, end and row offsets of stretches of a chunk of texts: the whole chunk, or a long text in parts that end in white space."""
    if len(data) <= 2 * BATCH_BYTES or len(offsets) > 2:
        yield 0, len(data), offsets
        return
    at = 0
    while at < len(data):
        end = min(at + BATCH_BYTES, len(data))
        while end < len(data):
            space = np.flatnonzero(textkit.is_space(data[end : end + BATCH_BYTES]))
            if len(space):
                end += int(space[0])
                break
            end = min(end + BATCH_BYTES, len(data))
        yield at, end, np.array([0, end - at])
        at = end


class Decoder:
    """Ids to text as the library's decode(ids, skip_special_tokens=False)."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        self.library = None
        if spec.get("decoder") is not None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            return
        named = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        tokens = [b""] * (max(named.values()) + 1)
        for token, i in named.items():
            tokens[i] = token.encode() + b" "
        self.size = np.array([len(x) for x in tokens])
        self.begin, self.bytes = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(tokens), np.uint8)

    def decode_column(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of ids[ends[i] : ends[i + 1]]."""
        if self.library is not None:
            return pa.array([self.library.decode(ids[i:j].tolist(), skip_special_tokens=False) for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.large_string())
        # without a decoder the library puts spaces between tokens
        known = ids < len(self.size)
        size = np.where(known, self.size[np.where(known, ids, 0)], 0)
        after = np.concatenate([[0], np.cumsum(size)])
        parts = []
        for at in range(0, len(ids), 1 << 19):
            k = slice(at, min(at + (1 << 19), len(ids)))
            n = size[k]
            parts.append(self.bytes[np.repeat(self.begin[np.where(known[k], ids[k], 0)] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        data = np.concatenate([np.zeros(0, np.uint8), *parts])
        edges = after[ends]
        some = edges[1:] > edges[:-1]
        data = np.delete(data, edges[1:][some] - 1)  # the space behind a text's last token
        edges = edges - np.concatenate([[0], np.cumsum(some)])
        return pa.Array.from_buffers(pa.large_string(), len(some), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


_made: dict[tuple, Encoder | Decoder] = {}


def release() -> None:
    """Forget encoders and decoders: for work that follows in the same Python worker."""
    _made.clear()
    textkit.give_back()


def _once(kind: type, path: str):
    """The worker's encoder or decoder of a file, made once and kept for its next tasks."""
    if (kind, path) not in _made:
        _made[kind, path] = kind(path)
    return _made[kind, path]


def _mapped(df: DataFrame, source: str, new: dict[str, T.DataType], work) -> DataFrame:
    """`df` with columns that work(binary array) makes of a binary or string column."""
    rest = keep_first_names(df, list(new))
    df = df.select(*rest, df[source].cast("binary").alias("__in"))
    schema = T.StructType([f for f in df.schema.fields if f.name != "__in"] + [T.StructField(k, v) for k, v in new.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            values = got.column("__in").cast(pa.large_binary())
            for lo, hi, _, _ in textkit.byte_chunks(values, BATCH_BYTES):
                part = got.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(rest))), *work(values.slice(lo, hi - lo))], names=[*rest, *new])
        textkit.give_back()

    return df.mapInArrow(run, schema)


def _binary(ids: np.ndarray, ends: np.ndarray, width: int = 4) -> pa.Array:
    if len(ids) and int(ids.max()) >> 8 * width:
        raise ValueError(f"id {ids.max()} doesn't fit {width} bytes")
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64) * width), pa.py_buffer(ids.astype(f"<u{width}"))]).cast(pa.binary())


def encode_documents(docs: DataFrame, path: str, column: str = "text", width: int = 4) -> DataFrame:
    """`docs` with ids (binary, `width` bytes each, 2 or 4) and n_tokens (long) of each whole text; ids that don't fit fail."""

    def work(texts: pa.Array) -> list[pa.Array]:
        ids, ends = _once(Encoder, path).encode_column(texts)
        return [_binary(ids, ends, width), pa.array(np.diff(ends), pa.int64())]

    return _mapped(docs, column, {"ids": T.BinaryType(), "n_tokens": T.LongType()}, work)


def round_trip(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """`docs` with ids and n_tokens, and decoded, the text of these ids, in one pass."""

    def work(texts: pa.Array) -> list[pa.Array]:
        ids, ends = _once(Encoder, path).encode_column(texts)
        return [_binary(ids, ends), pa.array(np.diff(ends), pa.int64()), _once(Decoder, path).decode_column(ids, ends).cast(pa.string())]

    return _mapped(docs, column, {"ids": T.BinaryType(), "n_tokens": T.LongType(), "decoded": T.StringType()}, work)


def decode_documents(docs: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """`docs` with decoded, the text of its ids, special tokens included."""

    def work(values: pa.Array) -> list[pa.Array]:
        ids, ends = [np.zeros(0, "<u4")], [0]
        for _, _, data, offsets in textkit.byte_chunks(values, BATCH_BYTES):
            ids.append(data.tobytes() and np.frombuffer(data.tobytes(), "<u4"))
            ends += (ends[-1] + offsets[1:] // 4).tolist()
        return [_once(Decoder, path).decode_column(np.concatenate([x for x in ids if len(x)] or ids[:1]), np.array(ends)).cast(pa.string())]

    return _mapped(docs, column, {"decoded": T.StringType()}, work)

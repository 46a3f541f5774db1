"""Exact Jaccard self-join of documents on word n-grams, as linked components.

Grouped prefix join. Grams are 64-bit hashes, ordered from rare to frequent, so that a passage shared by many documents never opens a
prefix that something rarer can open. The order needs document frequencies: every task sends its (gram, document) postings, packed by
range of gram, to the gram's partition; only grams that two or more documents hold come back to their documents. Grams of one document
alone make up the front of its prefix without candidates, and no intersection needs them, so a text is read once and never moved.
A gram that `frequent` documents of one pack hold (copies, a common passage) isn't sent to its partition at all but straight to the
documents, with a mark that orders it last; its partition gets the mark alone. Frequencies count one by one up to EXACT, then in steps of
a fifth.

Documents with equal sets are one node, by a 128-bit digest of their grams; nodes with one prefix and size form a group, and groups meet where
their prefixes share a gram. Not all pairs of such a bucket are checked, but each member with a pivot of the bucket and of the next size
class; what these checks link is one component. Then pairs of groups that still share a prefix gram with members in different components
are filtered by size, place and frequency of grams, and what is left is expanded to members and checked, all of it, so that no link between
components is lost. A check counts the grams that two documents share, exactly. Keys that may hold much of a table (a pivot, a component,
a set of grams, a prefix) are spread over tasks.

Defined results: null and empty texts have no grams and link with nothing; a text of fewer words than n has its whole sequence as one
gram; very long texts are one pack of their own; rows are documents of their own, also with equal doc_id or equal text; among several equal
candidates for a pivot the least (then the greatest) node is taken, which changes the work and not the result; a null doc_id never names a
component that has another id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.llm import textkit
from crossweave.llm.common import cut, materialise, shuffle_partitions, spread_join
from crossweave.llm.graph import components

#: Bytes of text whose postings are packed together.
PACK_BYTES = 4 << 20
#: Postings of shared grams that a task holds before it sends them on.
HELD_POSTINGS = 4_000_000
#: Partitions beyond spark.sql.shuffle.partitions that a large input gets at most.
PARTITIONS = 2048
#: Documents of one pack that hold a gram, from which the gram counts as frequent.
FREQUENT = 64
#: Order of grams by one byte: the number of documents up to EXACT, then a step for each factor of STEP; RARE itself stands for a frequent gram.
RARE, EXACT, STEP = 255, 128, 1.2
#: Ranks from which a band of grams begins. Two documents share no more grams of a band than either has there.
BANDS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 140, 160, RARE)

_PACKS = "to int, kind int, a binary, b binary, c binary"
_ZSTD = pa.Codec("zstd", compression_level=1)
_POSTINGS, _MARKS, _HELD, _DOCS = 0, 1, 2, 3


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers, compressed with all first bytes first: what is equal in neighbours lies together."""
    raw = np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _numbers(x: pa.Buffer) -> np.ndarray:
    raw = _ZSTD.decompress(x.slice(8), decompressed_size=int.from_bytes(x[:8].to_pybytes(), "little"))
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)


class _Rows:
    """Collects rows of _PACKS."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, to: int, kind: int, a: bytes, b: bytes = b"", c: bytes = b"") -> None:
        self.rows.append((to, kind, a, b, c))

    def batches(self, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        at = 0
        while at < len(self.rows):
            end, size = at, 0
            while end < len(self.rows) and size < most:
                size += sum(map(len, self.rows[end][2:]))
                end += 1
            part = self.rows[at:end]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], k) for i, k in enumerate(kinds)], names=["to", "kind", "a", "b", "c"])
            at = end
        self.rows = []


def _stretches(sorted_keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each stretch of one key."""
    edges = [*np.flatnonzero(np.diff(sorted_keys, prepend=-1)), len(sorted_keys)]
    return zip(edges[:-1], edges[1:], strict=True)


def _rank(count: np.ndarray) -> np.ndarray:
    """The order of grams by the number of documents that hold them, below RARE."""
    steps = EXACT + np.floor(np.log(np.maximum(count, EXACT) / EXACT) / np.log(STEP)).astype(np.int64)
    return np.where(count < EXACT, count, np.minimum(steps, RARE - 1))


def _doc_bucket(uid: np.ndarray, n_docs: int) -> np.ndarray:
    return (textkit.mix64(uid) % np.uint64(n_docs)).astype(np.int64)


def _by_document(rows: _Rows, uid: np.ndarray, gram: np.ndarray, rank: np.ndarray, n_docs: int) -> None:
    to = _doc_bucket(uid, n_docs)
    order = np.argsort(to, kind="stable")
    to, uid, gram, rank = to[order], uid[order], gram[order], rank[order]
    for i, j in _stretches(to):
        rows.add(int(to[i]), _HELD, _planes(uid[i:j]), _planes(gram[i:j]), rank[i:j].astype(np.uint8).tobytes())


def _post(words: int, n_grams: int, n_docs: int, frequent: int):
    """Documents to packed postings by range of gram, and what goes to the documents at once."""
    span = np.uint64((1 << 64) // n_grams + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_uid = TaskContext.get().partitionId() << 36
        for got in batches:
            ids = got.column("doc_id").cast(pa.int64())
            for lo, hi, data, offsets in textkit.byte_chunks(got.column("text"), PACK_BYTES):
                rows = _Rows()
                first, n = next_uid, hi - lo
                next_uid += n
                starts, ends, at = textkit.words(data, offsets)
                grams, at = textkit.window_hashes(textkit.span_hashes(data, starts, ends), at, words, n)
                del starts, ends
                order = np.argsort(grams, kind="stable")
                grams, at = grams[order], at[order]
                new = np.ones(len(grams), bool)
                new[1:] = (grams[1:] != grams[:-1]) | (at[1:] != at[:-1])
                grams, at = grams[new], at[new]
                sizes = np.bincount(at, minlength=n)
                uid = at.astype(np.uint64) + np.uint64(first)
                begin = np.flatnonzero(np.diff(grams, prepend=~grams[:1]) != 0)
                count = np.diff(np.append(begin, len(grams)))
                hot = count >= frequent
                if hot.any():
                    in_hot = np.repeat(hot, count)
                    _by_document(rows, uid[in_hot], grams[in_hot], np.full(int(in_hot.sum()), RARE), n_docs)
                    marked = grams[begin[hot]]
                    grams, uid = grams[~in_hot], uid[~in_hot]
                else:
                    marked = grams[:0]
                for kind, g in ((_POSTINGS, grams), (_MARKS, marked)):
                    to = (g // span).astype(np.int64)
                    for i, j in _stretches(to):
                        rows.add(int(to[i]), kind, _planes(g[i:j]), _planes(uid[i:j]) if kind == _POSTINGS else b"")
                docs = np.arange(first, next_uid, dtype=np.uint64)
                to = _doc_bucket(docs, n_docs)
                id_part = ids.slice(lo, n)
                known, values = np.asarray(id_part.is_valid()), id_part.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for k in np.unique(to):
                    mine = to == k
                    # sizes carry the bit that tells a null id
                    rows.add(int(k), _DOCS, _planes(docs[mine]), _planes(values[mine]), _planes((sizes[mine].astype(np.uint64) << np.uint64(1)) | known[mine].astype(np.uint64)))
                yield from rows.batches()

    return run


def _shared(n_docs: int):
    """Postings in order of range of gram to the grams that two or more documents hold, by document; what is by document already goes on."""

    def shared(packs: list[tuple[np.ndarray, np.ndarray]], marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grams, uid = (np.concatenate(x) for x in zip(*packs, strict=True))
        order = np.argsort(grams, kind="stable")
        grams, uid = grams[order], uid[order]
        begin = np.flatnonzero(np.diff(grams, prepend=~grams[:1]) != 0)
        count = np.diff(np.append(begin, len(grams)))
        rank = _rank(count)
        if marks:
            rank[np.isin(grams[begin], np.concatenate(marks))] = RARE
        rank = np.repeat(rank, count)
        many = rank > 1
        return uid[many], grams[many], rank[many].astype(np.uint8)

    def out(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        _by_document(rows, *(np.concatenate(x) for x in zip(*held, strict=True)), n_docs)
        yield from rows.batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packs, marks, held = None, [], [], []
        for got in batches:
            late = pc.greater(got.column("kind"), _MARKS)
            if pc.any(late).as_py():
                yield got.filter(late)
            for to, kind, a, b in zip(*(got.column(c) for c in ("to", "kind", "a", "b")), strict=True):
                if (kind := kind.as_py()) > _MARKS:
                    continue
                if (to := to.as_py()) != now:
                    if packs:
                        held.append(shared(packs, marks))
                        if sum(len(x[0]) for x in held) >= HELD_POSTINGS:
                            yield from out(held)
                            held = []
                    now, packs, marks = to, [], []
                if kind == _POSTINGS:
                    packs.append((_numbers(a.as_buffer()), _numbers(b.as_buffer())))
                else:
                    marks.append(_numbers(a.as_buffer()))
        if packs:
            held.append(shared(packs, marks))
        if held:
            yield from out(held)

    return run


_DOC_ROWS = "uid long, doc_id long, n long, alone long, same binary, p binary, bands array<int>, prefix array<long>, shared array<long>"


def _digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _lists(values: np.ndarray, lengths: np.ndarray, null: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)), mask=pa.array(null))


def _documents(num: int, den: int):
    """What the documents of each bucket hold, in the order of grams; p: a digest of the prefix, same: one of the set, equal for equal sets.

    prefix, p and shared are null where the prefix has no shared gram.
    """

    def bucket(docs: list[tuple], held: list[tuple]) -> Iterator[pa.RecordBatch]:
        uid, ids, size = (np.concatenate(x) for x in zip(*docs, strict=True))
        order = np.argsort(uid)
        uid, ids, known, n = uid[order], ids[order].view(np.int64), (size[order] & np.uint64(1)).astype(bool), (size[order] >> np.uint64(1)).astype(np.int64)
        if held:
            of, gram, rank = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((gram, rank, of))
            of, gram, rank = of[order], gram[order], rank[order]
        else:
            of = gram = rank = np.zeros(0, np.uint64)
        first = np.searchsorted(of, uid, side="left")
        shared = np.searchsorted(of, uid, side="right") - first
        alone = n - shared
        prefix = np.where(n > 0, n - (n * num + den - 1) // den + 1, 0) - alone
        some = prefix > 0
        upto = [np.concatenate([[0], np.cumsum(np.searchsorted(BANDS, rank, side="right") - 1 == k)]) for k in range(len(BANDS))]
        bands = np.stack([u[first + shared] - u[first] for u in upto], axis=1).astype(np.int32)
        del rank, upto
        step = max(1, int(256_000 // max(1, shared.mean())))
        for i in range(0, len(uid), step):
            k = slice(i, min(i + step, len(uid)))
            on = some[k]
            p, s, f = np.where(on, prefix[k], 0), np.where(on, shared[k], 0), first[k]
            pick = lambda lengths: gram[np.repeat(f, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)]  # noqa: E731, B023
            # only a set without a gram of its own has an equal
            same = [_digest(gram[a : a + m]) if w and not x else int(u).to_bytes(8, "little") for a, m, x, w, u in zip(f, s, alone[k], on, uid[k], strict=True)]
            heads = [_digest(gram[a : a + m]) if w else None for a, m, w in zip(f, p, on, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid[k].astype(np.int64)), pa.array(ids[k], mask=~known[k]), pa.array(n[k]), pa.array(alone[k]), pa.array(same, pa.binary()), pa.array(heads, pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(bands[k].ravel()), len(BANDS)).cast(pa.list_(pa.int32())), _lists(pick(p), p, ~on), _lists(pick(s), s, ~on)],
                names=["uid", "doc_id", "n", "alone", "same", "p", "bands", "prefix", "shared"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, held = None, [], []
        for got in batches:
            for to, kind, *packed in zip(*(got.column(x) for x in ("to", "kind", "a", "b", "c")), strict=True):
                if (to := to.as_py()) != now:
                    if docs:
                        yield from bucket(docs, held)
                    now, docs, held = to, [], []
                a, b, c = (x.as_buffer() for x in packed)
                if kind.as_py() == _DOCS:
                    docs.append((_numbers(a), _numbers(b), _numbers(c)))
                else:
                    held.append((_numbers(a), _numbers(b), np.frombuffer(c, np.uint8).copy()))
        if docs:
            yield from bucket(docs, held)

    return run


def document_grams(docs: DataFrame, words: int, num: int, den: int, frequent: int = FREQUENT) -> DataFrame:
    """A row of _DOC_ROWS for each row of `docs`, written to the shared folder."""
    p = max(shuffle_partitions(docs.sparkSession), min(2 * docs.rdd.getNumPartitions(), PARTITIONS))
    n_grams, n_docs = 4 * p, 2 * p
    packs = docs.select("doc_id", "text").mapInArrow(_post(words, n_grams, n_docs, frequent), _PACKS)
    early = F.col("kind") <= _MARKS
    # in order, so that a task holds one range or bucket at a time
    by_gram = packs.repartition(p, early, "to").sortWithinPartitions(early, "to").mapInArrow(_shared(n_docs), _PACKS)
    return materialise(by_gram.repartition(p, "to").sortWithinPartitions("to").mapInArrow(_documents(num, den), _DOC_ROWS), "document-grams")


def _verified(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) of nodes that link: shared grams against the union, both counted exactly. Many pairs may have one y, few one x."""
    x = nodes.select(F.col("uid").alias("x"), F.col("n").alias("nx"), F.col("shared").alias("sx"))
    y = nodes.select(F.col("uid").alias("y"), F.col("n").alias("ny"), F.col("shared").alias("sy"))
    sized = spread_join(pairs, y, ["y"], ["x"]).join(x, "x").where(_sizes_fit("nx", "ny", num, den))
    both = F.size(F.array_intersect("sx", "sy"))
    return sized.where(den * both >= num * (F.col("nx") + F.col("ny") - both)).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _sizes_fit(a: str, b: str, num: int, den: int):
    return (den * F.least(a, b) >= num * F.greatest(a, b))


def _few(table: DataFrame, rows_a_partition: int = 100_000) -> DataFrame:
    """A written table of few columns in as many partitions as its rows need: every later exchange reads that many."""
    return table.coalesce(1 + table.count() // rows_a_partition)


def _by_band(x: str, y: str):
    """The most grams that two documents can share, by band."""
    return sum((F.least(F.col(x)[k], F.col(y)[k]) for k in range(1, len(BANDS))), F.least(F.col(x)[0], F.col(y)[0]))


def _labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid, comp): the component, or the node itself where no edge touches it."""
    return nodes.select("uid").join(components(edges).withColumnRenamed("id", "uid"), "uid", "left").select("uid", F.coalesce("component", "uid").alias("comp"))


def gram_components(docs: DataFrame, words: int = 5, num: int = 75, den: int = 100, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs` (doc_id, text).

    Two documents link when den * |intersection| >= num * |union| of their sets of `words`-grams (words: runs other than ASCII white
    space, A-Z lower-cased). component_id is the smallest doc_id that links reach, itself included.
    `frequent` changes the work, never the result.
    """
    rows = document_grams(docs, words, num, den, frequent)
    held = rows.where(F.col("prefix").isNotNull())
    # equal sets: one node each
    nodes_of = held.groupBy("n", "same").agg(F.min("uid").alias("node"), F.min("doc_id").alias("least"))
    nodes = held.join(nodes_of.select(F.col("node").alias("uid")), "uid", "left_semi")
    groups = nodes.groupBy("n", "alone", "p").agg(F.min("uid").alias("gid"))
    grouped = _few(cut(spread_join(nodes.select("uid", "n", "alone", "p"), groups, ["n", "alone", "p"], ["uid"]).select("uid", "gid", "n", "alone")))
    # A document shares at most its grams that others hold, which bounds the size of a partner from above.
    top = F.least(F.floor(den * F.col("n") / num), F.floor((num + den) * (F.col("n") - F.col("alone")) / num) - F.col("n")).cast("long")
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int") if num < den else F.col("n").cast("int")
    heads = grouped.where("uid = gid").select("gid", "n", "alone")
    posts = nodes.select(F.col("uid").alias("gid"), "prefix").join(heads, "gid").select("gid", "n", size_class.alias("c"), top.alias("top"), "alone", F.posexplode("prefix").alias("i", "gram"))
    # behind: grams from this one on that others hold
    posts = materialise(posts.select("gram", "gid", "n", "c", "top", "alone", (F.col("n") - F.col("alone") - F.col("i")).alias("behind")), "gram-posts")
    # A bucket's pivots have the fewest grams of their own: originals rather than altered copies, which may not link among themselves.
    pivot = lambda sign: F.min(F.struct("alone", (sign * F.col("gid")).alias("g")))["g"] * sign
    pivots = materialise(posts.groupBy("gram", "c").agg(pivot(1).alias("first"), pivot(-1).alias("last")), "gram-pivots")

    def star(which: str, known: DataFrame | None) -> DataFrame:
        """Pairs (member x, pivot y) of each bucket of a group, in its size class and the next; of different components only."""
        at = posts.select("gram", "gid", F.explode(F.array("c", F.col("c") + 1)).alias("c"))
        group_pairs = at.join(pivots.select("gram", "c", F.col(which).alias("y")), ["gram", "c"]).select("gid", "y").distinct()
        pairs = group_pairs.join(grouped.select("gid", F.col("uid").alias("x")), "gid").select("x", "y").unionByName(grouped.select(F.col("uid").alias("x"), F.col("gid").alias("y")))
        pairs = pairs.where("x <> y").distinct()
        return pairs if known is None else _apart(pairs, known)

    def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        cx, cy = comps.select(F.col("uid").alias("x"), F.col("comp").alias("cx")), comps.select(F.col("uid").alias("y"), F.col("comp").alias("cy"))
        return pairs.join(cx, "x").join(cy, "y").where("cx <> cy").select("x", "y")

    edges = _few(cut(_verified(star("first", None), nodes, num, den)))
    comps = _few(cut(_labelled(grouped, edges)))
    edges = _few(cut(edges.unionByName(_verified(star("last", comps), nodes, num, den))))
    comps = _few(cut(_labelled(grouped, edges)))
    edges = _few(cut(edges.unionByName(_verified(_rest(nodes, grouped, posts, comps, num, den), nodes, num, den))))
    comps = cut(_labelled(grouped, edges))
    # nodes to the least doc_id of their component, then documents to that of their set
    names = comps.join(nodes_of.withColumnRenamed("node", "uid"), "uid").select("comp", "n", "same", "least", "uid")
    named = spread_join(names, names.groupBy("comp").agg(F.min("least").alias("component_id")), ["comp"], ["uid"]).select("n", "same", "component_id")
    member = spread_join(held.select("uid", "doc_id", "n", "same"), named, ["n", "same"], ["uid"])
    lone = rows.where(F.col("prefix").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return member.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(lone)


def _rest(nodes: DataFrame, grouped: DataFrame, posts: DataFrame, comps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) of nodes of different components that could still link.

    First components that meet in a bucket are filtered, then their groups, and only the members of group pairs that are left are paired.
    """
    bands = [F.col("bands")[k].alias(f"b{k}") for k in range(len(BANDS))]
    most = F.array(*(F.max(f"b{k}") for k in range(len(BANDS)))).alias("bands")
    member = nodes.select("uid", *bands).join(comps, "uid").join(grouped.select("uid", "gid"), "uid")
    # a unit: the members of a group that are in one component
    units = cut(member.groupBy("gid", "comp").agg(most))
    at = materialise(posts.join(units.select("gid", "comp"), "gid").select("gram", "gid", "comp", "n", "top", "behind"), "gram-rest")
    mixed = at.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gram")
    at = materialise(at.join(mixed, "gram", "left_semi"), "gram-mixed")
    inside = at.groupBy("gram", "comp").agg(F.count("*").alias("size"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("top").alias("top"), F.max("behind").alias("behind"))
    one, two = (inside.select("gram", *(F.col(c).alias(f"{c}{k}") for c in ("comp", "size", "least", "most", "top", "behind"))) for k in (1, 2))
    fits = (den * F.col("most1") >= num * F.col("least2")) & (den * F.col("most2") >= num * F.col("least1")) & (F.col("least1") <= F.col("top2")) & (F.col("least2") <= F.col("top1"))
    fits &= (num + den) * F.least("behind1", "behind2") >= num * (F.col("least1") + F.col("least2"))
    # the smaller component is taken apart first
    meet = one.join(two, "gram").where(F.struct("size1", "comp1") < F.struct("size2", "comp2")).where(fits).select("gram", "comp1", "comp2", "least1", "least2")
    whole = cut(units.select("comp", *bands).groupBy("comp").agg(most))
    for k in (1, 2):
        meet = meet.join(whole.select(F.col("comp").alias(f"comp{k}"), F.col("bands").alias(f"bands{k}")), f"comp{k}")
    meet = materialise(meet.where((num + den) * _by_band("bands1", "bands2") >= num * (F.col("least1") + F.col("least2"))).select("gram", "comp1", "comp2"), "gram-meet")
    left, right = (at.select("gram", *(F.col(c).alias(f"{c}{k}") for c in ("comp", "gid", "n", "top", "behind"))) for k in (1, 2))
    # from the first shared gram on, two documents share no more than what is behind it
    needed = num * (F.col("n1") + F.col("n2"))
    fits = (F.col("n1") <= F.col("top2")) & (F.col("n2") <= F.col("top1")) & ((num + den) * F.least("behind1", "behind2") >= needed)
    right = right.withColumnsRenamed({"gram": "g", "comp2": "k"})
    found = meet.join(left, ["gram", "comp1"]).join(right, (F.col("g") == F.col("gram")) & (F.col("k") == F.col("comp2")) & fits)
    found = found.select("gid1", "comp1", "n1", "gid2", "comp2", "n2").distinct()
    for k in (1, 2):
        found = found.join(units.select(F.col("gid").alias(f"gid{k}"), F.col("comp").alias(f"comp{k}"), F.col("bands").alias(f"bands{k}")), [f"gid{k}", f"comp{k}"])
    found = found.where((num + den) * _by_band("bands1", "bands2") >= num * (F.col("n1") + F.col("n2"))).select("gid1", "comp1", "gid2", "comp2")
    found = materialise(found, "group-pairs")
    member = grouped.select("uid", "gid").join(comps, "uid")
    for k, name in ((1, "x"), (2, "y")):
        found = found.join(member.select(F.col("gid").alias(f"gid{k}"), F.col("comp").alias(f"comp{k}"), F.col("uid").alias(name)), [f"gid{k}", f"comp{k}"])
    return found.select("x", "y")

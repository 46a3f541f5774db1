"""op11 to op13 against plain Python, over odd rows, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from crossweave.llm import chat_format, prefix_trie, queries, vector_codes

CHAT = "conv_id long, turn long, role string, text string"
CLASH = ("segments", "turns", "valid", "whole", "node", "place", "code", "error", "__part", "__key", "x")
CONTROL = chat_format.INSTRUCT.control


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_chats():
    rng = random.Random(5)
    bits = [*CONTROL, *(c[0] + "\\" * k + c[1:] for c in CONTROL for k in (1, 2)), "\\", "<", "[", "<<", "a", "é", "\n", " ", "𝛼", "s>", "INST]"]
    rows = []
    for c in [*range(-12, 60), None]:
        for t in range(rng.randint(1, 9)):
            text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
            rows.append((c, rng.choice([t, t, t, 3, None]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "[INST]", "start", "", None]), rng.choice([text, text, text, "", None])))
    rows += [(70, t, r, x) for t, (r, x) in enumerate([("system", "be good"), ("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", "bye")])]
    rows += [(71, 0, "user", "w<s>" * 100_000), (71, 1, "assistant", "[INST] " * 50_000)]
    return rows + rows[:40]


def plain_chats(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", (x or "").encode(), x or ""))
    return {c: [(r, x) for _, _, r, _, x in sorted(turns)] for c, turns in by.items()}


def plain_format(turns):
    """The instruct template, turn by turn, with one backslash put into what looks like a control string."""
    import re

    inner = {c[0]: [d[1:] for d in CONTROL if d[0] == c[0]] for c in CONTROL}
    look = re.compile("|".join(f"{re.escape(h)}(?=\\\\*(?:{'|'.join(map(re.escape, rest))}))" for h, rest in inner.items()))
    esc = lambda s: look.sub(lambda m: m[0] + "\\", s)
    opens = {("start", "system"): "<s>[INST] <<SYS>>\n", ("start", "user"): "<s>[INST] ", ("system", "user"): "", ("user", "assistant"): " ", ("assistant", "user"): "<s>[INST] "}
    closes = {"system": "\n<</SYS>>\n\n", "user": " [/INST]"}
    out, before, strays = "", "start", []
    for k, (role, text) in enumerate(turns):
        step = opens.get((before if k == 0 or before != "start" else None, role))
        if step is None:
            strays.append(k)
            step = f"<s>[ROLE] {esc(role)} [/ROLE] "
        out += step + esc(text) + closes.get(role, " </s>")
        before = role
    return out, strays


def test_chats_read_back(spark):
    rows = odd_chats()
    df = spark.createDataFrame(rows, CHAT).withColumns({c: F.lit("x") for c in CLASH})
    want = plain_chats(rows)
    got = {r.conv_id: r for r in chat_format.chat_digests(df).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        text, strays = plain_format(turns)
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns))), c
        assert (got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (len(loss), sha(loss), len(text)), c
        assert got[c].valid == (not strays and turns[-1][0] == "assistant"), c


def test_chat_segments(spark):
    rows = odd_chats()
    got = {r.conv_id: r for r in chat_format.formatted(spark.createDataFrame(rows, CHAT)).collect()}
    for c, turns in plain_chats(rows).items():
        text, strays = plain_format(turns)
        assert "".join(s.text for s in got[c].segments) == text, c
        assert got[c].first_stray == (strays[0] if strays else None), c
    assert [s.text for s in got[70].segments if s.loss] == ["hello", "bye"] and got[70].valid
    assert chat_format.formatted(spark.createDataFrame([], CHAT)).collect() == []


def test_chat_of_many_turns(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    r = chat_format.chat_digests(rows).first()
    assert r.valid and r.n_turns == 20_000 and r.loss_sha256 == sha("".join(f"t{i}" for i in range(1, 20_000, 2)))


def test_a_template_whose_control_strings_overlap_is_refused():
    t = chat_format.INSTRUCT
    with pytest.raises(ValueError, match="overlap"):
        chat_format.Template((*t.control, "]x["), t.roles, t.opens, t.stray, t.other)
    with pytest.raises(ValueError, match="backslash"):
        chat_format.Template((*t.control, "<\\x>"), t.roles, t.opens, t.stray, t.other)
    with pytest.raises(ValueError, match="two kinds"):
        chat_format.Template(t.control, t.roles, {**t.opens, ("user", "user"): "<s>[INST]  "}, t.stray, t.other)


# -- vector codes

VECTORS = "vec_id long, embedding array<double>, label int"


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i is None, i or 0, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[:3])
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    width = max(1, -(-len(kept[0][2]) // parts))
    whole = lambda x: (lambda n, d: n * 256 // d)(*float(x).as_integer_ratio())
    cut = [[tuple(([whole(x) for x in v] + [0] * (parts * width))[p * width : (p + 1) * width]) for p in range(parts)] for _, _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for c in cut:
                held[near(c[p], books[p])[1]].append(c[p])
            books[p] = [tuple(sum(x) // len(held[k]) for x in zip(*held[k])) if k in held else e for k, e in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by = defaultdict(int)
    for r, e in zip(kept, errors):
        by[r[3]] += e
    top = (1 << 63) - 1
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(None if none else i), "".join(f"{k:02x}" for _, k in f), min(e, top), min(by[lab], top), digest) for (none, i, _, lab), f, e in zip(kept, found, errors))


def spark_codes(spark, rows, schema=VECTORS):
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in CLASH})
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compressed(df).collect())


def vectors(n, dim, seed, spread=0.2):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(dim)], rng.choice([1, 1, 1, 2, None])) for i in range(n)]


def test_codes_of_odd_rows(spark):
    rows = vectors(300, 32, 1)
    rows += [(rows[k][0], rows[k][1], 1) for k in range(5)] + [(1000 + k, rows[0][1], 9) for k in range(50)]
    rows += [(None, rows[3][1], None), (None, rows[4][1], 2), (-1, None, 1), (-2, [None] + [0.0] * 31, 1), (-3, [float("nan")] + [0.0] * 31, 1), (-4, [float("inf")] + [0.0] * 31, 1), (-5, [float("-inf")] * 32, 1), (2000, [0.1] * 31, 1), (2001, [], 1)]
    assert spark_codes(spark, rows) == plain_codes(rows)


@pytest.mark.parametrize("n,dim", [(10, 16), (80, 20), (80, 5), (3, 0), (1, 64)])
def test_codes_of_few_vectors_and_other_lengths(spark, n, dim):
    rows = vectors(n, dim, n)
    assert spark_codes(spark, rows) == plain_codes(rows)


def test_codes_of_very_large_components(spark):
    rows = vectors(90, 16, 3)
    for k, x in ((5, 1e30), (70, -1e300), (71, 1e300), (72, 1e7), (73, 3e6), (74, 3.4e38)):
        rows[k][1][k % 16] = x
    assert spark_codes(spark, rows) == plain_codes(rows)
    rows = [(i, [x * 1e12 for x in v], lab) for i, v, lab in vectors(70, 16, 4)]
    assert spark_codes(spark, rows) == plain_codes(rows)


def test_codes_with_ties_and_an_empty_table(spark):
    rng = random.Random(9)
    rows = [(i, [rng.randint(-2, 2) / 256 for _ in range(32)], 0) for i in range(400)]
    assert spark_codes(spark, rows) == plain_codes(rows)
    assert spark_codes(spark, []) == [] and spark_codes(spark, [(1, None, 1), (2, [float("nan")], 1)]) == []


def test_the_annulus_leaves_entries_out_and_finds_the_nearest():
    import numpy as np

    rng = np.random.default_rng(2)
    entries = [tuple(map(int, e)) for e in rng.integers(-200, 200, (64, 4))]
    book = vector_codes.Annulus([*entries, entries[5]])
    rows = rng.integers(-200, 200, (500, 4))
    index, best = book.nearest(rows)
    every = ((rows[:, None, :] - np.array([*entries, entries[5]])[None]) ** 2).sum(axis=2)
    assert (best == every.min(axis=1)).all() and (index == every.argmin(axis=1)).all()
    assert all(book.nearest_exact(r.tolist()) == (i, b) for r, i, b in zip(rows, index.tolist(), best.tolist(), strict=True))


# -- prefix trie


def plain_trie(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            role, text = (r or ""), (x or "")
            by[c].append((t is not None, t or 0, role.encode(), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], role, text))
    own = {c: [x[4:] for x in sorted(turns)] for c, turns in by.items()}
    built = {}
    for c in own:
        h, first = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        built[c] = tuple(own.get(first, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def under(p):
        return [p, *(q for k in children[p] for q in under(k))]

    out = []
    for p, m in members.items():
        below = under(p)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ids = ",".join(map(str, sorted(c for c in m if built[c] == p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else -99, len(m), len(children[p]), sum(not children[q] for q in below), saved, sha(ids)))
    return sorted(out)


def spark_trie(spark, rows):
    df = spark.createDataFrame(rows, CHAT).withColumns({c: F.lit("x") for c in CLASH})
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.conversations(df.select("conv_id", "turn", "role", "text"))))
    return sorted((r.conv_id, r.depth, -99 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got.collect())


def test_trie_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ROWS", 7)
    monkeypatch.setattr(prefix_trie, "TEXT", 5)
    rng = random.Random(8)
    rows = []
    for c in [*range(-30, 200), None, 2**63 - 1, -(2**63)]:
        for t in range(rng.choice([1, 2, 3, 4, 12])):
            rows.append((c, rng.choice([t, t, t, t, 2, None]), rng.choice(["user", "assistant", "system", None]), rng.choice(["a", "b", "é", "", None])))
    rows += [(300 + k, t, "user", f"same {t}") for k in range(60) for t in range(10)]
    rows += rows[:30] + [(999, 0, "user", "long " * 50_000)]
    assert spark_trie(spark, rows) == plain_trie(rows)


def test_trie_of_a_deep_conversation_and_an_empty_table(spark):
    rows = [(5, t, "user", str(t)) for t in range(3000)] + [(6, t, "user", str(t)) for t in range(2990)]
    got = spark_trie(spark, rows)
    assert len(got) == 3001 and got[-1][1] == 3000
    assert {(d, n, leaves) for _, d, _, n, _, leaves, _, _ in got} == {(d, 2 if d <= 2990 else 1, 1) for d in range(3001)}
    assert spark_trie(spark, []) == [] and spark_trie(spark, [(None, 1, "user", "x")]) == []


def test_registered_queries_give_their_columns(spark):
    want = {
        "op11_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"],
        "op12_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
        "op13_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns == columns

"""The battery, the likelihoods and the control of false discoveries against a plain version, and the share of false reports where secrets are rare."""

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crossweave.llm import secret_scan as S

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER, DIGITS = UPPER.lower(), "0123456789"
WORDS = "account address batch buffer builder cache channel client column config context count create data default device document element engine event export factory field file filter format global group handler header import index input instance internal item key layer length level limit list loader local manager map message method model module name network node number object offset option order output owner package parser path pattern policy pool process provider query queue range record region remote request result route row schema scope search section server service session shape size source stage state status storage stream string table target task temp template thread time tracker type update user value vector version view width window worker wrapper".split()


def identifiers(rng, n):
    """Names as programs have them: words joined in the usual ways, some with a number."""
    out = set()
    while len(out) < n:
        parts = [rng.choice(WORDS) for _ in range(rng.randint(3, 6))]
        kind = rng.randrange(5)
        name = ["_".join(parts), "-".join(parts), "/".join(parts), "".join(p.title() for p in parts), "_".join(parts).upper()][kind]
        out.add(name + (str(rng.randint(0, 99)) if rng.random() < 0.3 else ""))
    return sorted(x for x in out if len(x) >= 20)


def tokens(rng, alphabet, lengths, n):
    return ["".join(rng.choice(alphabet) for _ in range(lengths[i % len(lengths)])) for i in range(n)]


def battery(token):
    """(n, deviate, bits) of a token."""
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    body = body.replace("=", "")
    alphabet = next(letters for shape, letters in S.ENCODINGS.values() if not shape or re.search(shape, body))
    n, k = len(body), len(alphabet)
    v = [alphabet.index(c) for c in body]
    chi = max(k * sum(c * c for c in Counter(v).values()) / n - n, 1e-9)
    d = 2 / (9 * (k - 1))
    uneven = max(((chi / (k - 1)) ** (1 / 3) - (1 - d)) / math.sqrt(d), 0)
    half = [x < k / 2 for x in v]
    low = sum(half)
    expected = 2 * low * (n - low) / n
    spread = math.sqrt(max(expected * (expected - 1) / (n - 1), 1e-9))
    runs = min(abs((sum(a != b for a, b in zip(half, half[1:])) - expected) / spread), 99)
    mean = sum(v) / n
    var = sum((x - mean) ** 2 for x in v)
    cov = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:]))
    serial = ((cov / var if var else 1.0) + 1 / n) * math.sqrt(n)
    return n, math.sqrt(uneven**2 + runs**2 + serial**2), bits(body, k)


def bits(body, k):
    kind = lambda c: 0 if c in LOWER else 1 if c in UPPER else 2 if c in DIGITS else 3
    total = 0.0
    for a, b in zip(body, body[1:]):
        total += math.log2(S._FOLLOWS[kind(a)][kind(b)] / S._SIZES[kind(b)]) + math.log2(k)
        if a.isalpha() and b.isalpha() and not (kind(a) == 0 and kind(b) == 1):
            total += (ord(S._PAIRS[LOWER.index(a.lower()) * 26 + LOWER.index(b.lower())]) - ord("m")) / 2
    return total


def reported(found, rate=S.RATE):
    """Tokens that step-up control by class of length reports; every different one counts once."""
    out, judged = set(), {t: battery(t) for t in set(found)}
    classes = {}
    for t, (n, deviate, b) in judged.items():
        classes.setdefault(int(S.CLASSES * math.log2(n)), []).append((b, deviate < S.MOST_DEVIATE, t))
    for rows in classes.values():
        limit = -math.inf
        for edge in {math.floor(b * S.BINS) for b, _, _ in rows}:
            k = sum(ok for b, ok, _ in rows if math.floor(b * S.BINS) <= edge)
            if k and (edge + 1) / S.BINS <= (t := math.log2(k / len(rows)) + math.log2(rate / (1 - rate))):
                limit = max(limit, t)
        out |= {t for b, ok, t in rows if ok and b < limit}
    return out


def scan(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == "random"] for r in S.secret_spans(rows).collect()}


def test_against_a_plain_version(spark):
    rng = random.Random(11)
    names = identifiers(rng, 600)
    keys = [t for a in (LOWER, UPPER, UPPER + DIGITS, LOWER + DIGITS, UPPER + LOWER, UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_") for t in tokens(rng, a, (20, 23, 28, 40, 64, 150), 12)]
    odd = ["x" * 30, "xy" * 20, "=" * 25, "-" * 30, "x" * 17 + "===", "A1" * 40]
    every = [*names, *keys, *odd]
    rng.shuffle(every)
    texts = [" ".join(every[i : i + 7]) for i in range(0, len(every), 7)] + [every[0], every[0], keys[3], "", "short"]
    candidates = [t for x in texts for t in re.findall(S.RANDOM, x)]
    base = re.compile("AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?i:password|passwd|secret|token|api_?key)")
    assert not any(base.search(t) for t in candidates)  # no candidate meets a fixed pattern
    want = reported([t for t in candidates if len(t.rstrip("=")) > 2])
    got = scan(spark, texts)
    assert len(want & set(keys)) > 60
    for i, x in enumerate(texts):
        assert got[i] == [t for t in re.findall(S.RANDOM, x) if t in want], x


@pytest.mark.parametrize("alphabet", [UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/"])
def test_rare_secrets_among_identifiers(spark, alphabet):
    """Two secrets among 20,000 names: both found, and no name with them."""
    rng = random.Random(5)
    names, keys = identifiers(rng, 20_000), tokens(rng, alphabet, (40, 48), 2)
    texts = [" ".join(names[i : i + 10]) for i in range(0, len(names), 10)]
    for i, key in enumerate(keys):
        texts[500 * (i + 1)] += " " + key
    assert len(names) > 15_000 and sorted(t for found in scan(spark, texts).values() for t in found) == sorted(keys)


def test_a_token_repeated_everywhere_counts_once(spark):
    rng = random.Random(3)
    names, (key,) = identifiers(rng, 300), tokens(rng, UPPER + LOWER + DIGITS, (40,), 1)
    texts = [names[0]] * 3000 + names + [key] * 5
    found = scan(spark, texts)
    assert {t for x in found.values() for t in x} == {key} and sum(len(x) for x in found.values()) == 5


def test_no_class_without_candidates(spark):
    empty = spark.createDataFrame([], "class int, token long, deviate double, bits double")
    assert S._limits(empty, S.RATE).count() == 0
    one = spark.createDataFrame([(8, 1, 1.0, -9.0), (9, 2, 9.0, -9.0), (10, 3, 1.0, -1e9)], "class int, token long, deviate double, bits double")
    limits = {r["class"]: r.limit for r in S._limits(one, 0.05).collect()}
    assert limits == {8: pytest.approx(math.log2(0.05 / 0.95)), 10: pytest.approx(math.log2(0.05 / 0.95))}
    assert one.where(F.col("class") == 9).count() == 1


def test_many_matches_of_one_text(spark):
    """Places of tens of thousands of matches, in time that grows with them; candidates that meet a fixed match are none."""
    rng = random.Random(8)
    kinds = [lambda: "password=" + "".join(rng.choices(LOWER, k=rng.randint(3, 9))), lambda: "".join(rng.choices("0123456789abcdef", k=rng.randint(20, 40))), lambda: "AKIA" + "".join(rng.choices(UPPER, k=rng.randint(10, 20))), lambda: "".join(rng.choices(UPPER + LOWER + DIGITS, k=30)), lambda: "é", lambda: "token: " + "".join(rng.choices(UPPER + LOWER + DIGITS, k=30))]
    long = {n: " ".join(rng.choice(kinds)() for _ in range(n)) for n in (1, 2, 3, 17, 500, 10_000, 40_000)}
    took = {}
    for n, x in long.items():
        begin = time.time()
        (got,) = S.secret_spans(spark.createDataFrame([(1, x)], "doc_id long, text string")).collect()
        took[n] = time.time() - begin
        want = [(m.start(), kind, m.end()) for kind, (pattern, group, least) in S.BASE.items() for m in re.finditer(pattern, x) if len(m.group(group)) >= least]
        assert [tuple(s) for s in got.spans if s.kind != "random"] == sorted(want, key=lambda s: (s[0], S.KINDS.index(s[1]))), n
        taken = [False] * len(x)
        for a, _, b in want:
            taken[a:b] = [True] * (b - a)
        free = [m.group() for m in re.finditer(S.RANDOM, x) if not any(taken[m.start() : m.end()])]
        keep = reported(free)
        assert [x[s.start : s.end] for s in got.spans if s.kind == "random"] == [t for t in free if t in keep], n
    assert took[40_000] < 8 * took[10_000] + 5, took

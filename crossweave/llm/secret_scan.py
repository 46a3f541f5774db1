"""Secrets in texts: fixed patterns, and tokens that a battery of randomness tests cannot tell from random, in DataFrame functions only.

Every run of 20 or more characters of base-64 alphabets is a candidate, letters alone too. Its encoding is inferred from its characters, the
smallest alphabet that holds them all (decimal, hexadecimal, letters of one case or both, base 32 and 36 of either case, base 62, base 64),
in which a random token is still uniform, and three statistics compare it with uniform random characters of that alphabet: chi-squared
of the character counts, the number of runs of the alphabet's halves, and the correlation of neighbours; each as a normal deviate, combined
as the root of their squares. A candidate is reported if the combined deviate is below what about one random token in a thousand exceeds, and
if false discoveries are controlled: bundled statistics of words (pairs of letters, changes of case, digits, marks) give the likelihood of the
token as text, uniform characters that of a random one. The ratio of the two is at most the chance that text looks as random as that, so the
Benjamini-Hochberg step over it bounds the share of text among what is reported. It is taken by class of length, over all different candidates
of the table: where a share q of a class is reported, text must have at most q * `rate` of the odds. A class of random tokens alone keeps the
odds of `rate`; one random token among ten thousand words must be ten thousand times clearer. The ratios are counted by eighths of a bit.

Texts are read once; what goes on are spans.

Defined results: what a text reports beyond the fixed patterns depends on the other texts of the table; positions count code points; a null text is empty and has no spans; rows with equal doc_id are scanned one by one; equal
texts give equal spans; spans of one start are in the order of KINDS; very long texts are scanned whole; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossweave.llm.common import materialise

_NAMES = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
#: kind: pattern, group whose length counts, least length. In the order in which spans of one start are listed.
BASE = {
    "assign": (_NAMES + r"\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]+", 0, 24),
}
#: What a text must hold for a pattern to be worth locating; each is implied by a match that counts.
_HINTS = {"assign": _NAMES, "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}", "random": "[A-Za-z0-9+/=_-]{20}"}
RANDOM = "[A-Za-z0-9+/=_-]{20,}"
KINDS = (*BASE, "random")

#: Encodings by name: what a token without padding looks like, and the alphabet.
ENCODINGS = {
    "decimal": ("^[0-9]+$", "0123456789"),
    "hex": ("^[0-9a-f]+$", "0123456789abcdef"),
    "HEX": ("^[0-9A-F]+$", "0123456789ABCDEF"),
    "lower": ("^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    "upper": ("^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "base32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base32_lower": ("^[a-z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567"),
    "base36": ("^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    "base36_lower": ("^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    "letters": ("^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "base62": ("^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    "base64": ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
#: The root of the 99.9 % point of chi-squared with three degrees of freedom.
MOST_DEVIATE = 4.033
RATE = 0.05
#: Spans of a kind up to which looking at all is less work than halving.
FEW = 16
#: Bins a bit of likelihood has, bits beyond which all count alike, and classes of length that a doubling has. At most 62 classes of 16,001 bins.
BINS, FARTHEST, CLASSES = 8, 1000, 2
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Row a, column b: how much likelier b is after a in words (English, German, French, Spanish, Italian, Dutch) than any letter; m is 0, a letter half a bit.
_PAIRS = (
    "kmnnfiljlhlpnqglfpnpljifkirjherfghpidphfpfbokiodgcjeqdlfpddrpamledrfcminmbbagaqgfjsghiqhfjhhqhbmlhnghdif"
    "ljmmljlhmfjomrhkfrpnjjhkhiphhjpoigrffmggqicnlmndfehfqifirdlmodhlhmoibomkpdhchdrfehrediqbflikpecminnehbid"
    "nkomokmeejjnmrokhmooglegfjrigmqjihphnjglpjehlgpjhegkriggrghmpeklhjpjclmnofkcifqhhlrhifrehpigphbelmmhedke"
    "roggrfgdpbeimhpobgkimefdgdphmppjqgohjhgknfdfnqliebiiikmmkjlgjfknorlmeqnmnlkfhfqfihqhhlobgohfpndqlmneedge"
    "nhhgjghglggihhjhiiijvgkghgqjkmrhkgqdjjlkphdlnnmihbjhohohqggnpejkihnmfhornghbjfqfifrffmqcfjgfpgaommmfhbkh"
    "nllloklfngkonqimdpoogiihhhqfgftffdqdchfhqgckifjgeegcshhirghlqegiglphdklgkehgieoknkokhjqgiikhlqgjkrkhilki"
    "rjkjogjfngilnnooekomnghfifrhigrfhjrhgihhofgggjofkein"
)
#: In words, paths and identifiers: what follows a lower-case letter, an upper-case one, a digit and a mark; and characters of each of these kinds.
_FOLLOWS = ((0.88, 0.04, 0.03, 0.05), (0.15, 0.77, 0.04, 0.04), (0.06, 0.04, 0.75, 0.15), (0.55, 0.15, 0.2, 0.1))
_SIZES = (26, 26, 10, 2)


def _spans(rows: DataFrame, kind: str, pattern: str, group: int, least: int, token: bool = False) -> DataFrame:
    """Adds column `kind`: array of (start, end) of the leftmost non-overlapping matches whose group has `least` characters; token: with the match.

    Matches are placed in blocks of about the root of their number: totals of blocks first, then each block from where it starts.
    """
    gaps, found, held, blocks, begins = (f"__{kind}_{x}" for x in ("gaps", "found", "held", "blocks", "begins"))
    some = F.col("__text").rlike(_HINTS[kind])
    none = F.array().cast("array<string>")
    rows = rows.withColumns(
        {
            gaps: F.when(some, F.split("__text", pattern, -1)).otherwise(none),
            found: F.when(some, F.regexp_extract_all("__text", F.lit(f"(?:{pattern})"), F.lit(0))).otherwise(none),
            held: F.when(some, F.regexp_extract_all("__text", F.lit(pattern), F.lit(group))).otherwise(none),
        }
    )
    n = F.size(found)
    width = F.ceil(F.sqrt(n)).cast("int")
    fields = "start:int,end:int,token:string" if token else "start:int,end:int"
    empty = F.array().cast(f"array<struct<{fields}>>")
    inside = F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), lambda b: F.sequence(b * width, F.least((b + 1) * width, n) - 1))
    rows = rows.withColumn(blocks, F.when(n > 0, inside).otherwise(F.array().cast("array<array<int>>")))
    size = lambda i: F.length(F.get(F.col(gaps), i)) + F.length(F.get(F.col(found), i))
    totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda at, i: at + size(i)))
    rows = rows.withColumn(begins, F.aggregate(totals, F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + t))))

    def step(a: Column, i: Column) -> Column:
        start = a["at"] + F.length(F.get(F.col(gaps), i))
        end = start + F.length(F.get(F.col(found), i))
        one = F.struct(start.alias("start"), end.alias("end"), *([F.get(F.col(found), i).alias("token")] if token else []))
        kept = F.when(F.length(F.get(F.col(held), i)) >= least, F.array(one)).otherwise(empty)
        return F.struct(end.alias("at"), F.concat(a["out"], kept).alias("out"))

    placed = F.transform(blocks, lambda x, b: F.aggregate(x, F.struct(F.get(F.col(begins), b).alias("at"), empty.alias("out")), step, lambda a: a["out"]))
    return rows.withColumn(kind, F.flatten(placed)).drop(gaps, found, held, blocks, begins)


def _meets(span: Column, kind: str) -> Column:
    """Whether a span meets one of the column `kind`, spans in order that do not overlap: the last one that starts before its end, found by halving."""
    few = F.exists(kind, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
    before = lambda k: F.coalesce(F.get(F.col(kind), k - 1)["start"] < span["end"], F.lit(False))
    last = F.aggregate(F.array(*(F.lit(1 << k) for k in range(30, -1, -1))), F.lit(0), lambda at, width: F.when(before(at + width), at + width).otherwise(at))
    return F.when(F.size(kind) <= FEW, few).otherwise(F.coalesce(F.get(F.col(kind), last - 1)["end"] > span["start"], F.lit(False)))


def _deviates(tokens: DataFrame) -> DataFrame:
    """Adds encoding, n, deviate and bits, the evidence for text, to rows with a token."""
    body = F.translate(F.rtrim(F.col("token"), F.lit("=")), "-_=", "+/")
    name, alphabet = F.lit("base64"), F.lit(ENCODINGS["base64"][1])
    for k, (shape, letters) in reversed(ENCODINGS.items()):
        if shape:
            name, alphabet = F.when(body.rlike(shape), k).otherwise(name), F.when(body.rlike(shape), letters).otherwise(alphabet)
    rows = tokens.withColumns({"encoding": name, "__a": alphabet, "__b": body}).withColumns({"n": F.length("__b"), "__k": F.length("__a").cast("double")})
    rows = rows.where("n > 2").withColumn("bits", _text_bits(F.col("__b"), F.col("__k"))).withColumn("__v", F.transform(F.split("__b", ""), lambda c: F.instr(F.col("__a"), c).cast("double") - 1))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    n, k = F.col("n").cast("double"), F.col("__k")
    rows = rows.withColumns({"__mean": total(F.col("__v")) / n, "__squares": total(F.transform(F.array_distinct("__v"), lambda x: F.pow(F.size(F.filter("__v", lambda y: y == x)).cast("double"), F.lit(2.0))))})
    rows = rows.withColumns(
        {
            "__chi": F.greatest(k * F.col("__squares") / n - n, F.lit(1e-9)),
            "__low": F.size(F.filter("__v", lambda x: x < k / 2)).cast("double"),
            "__runs": 1.0 + total(F.transform("__v", lambda x, i: F.when((i > 0) & ((x < k / 2) != (F.get(F.col("__v"), i - 1) < k / 2)), 1.0).otherwise(0.0))),
            "__var": total(F.transform("__v", lambda x: F.pow(x - F.col("__mean"), F.lit(2.0)))),
            "__cov": total(F.transform("__v", lambda x, i: F.when(i > 0, (x - F.col("__mean")) * (F.get(F.col("__v"), i - 1) - F.col("__mean"))).otherwise(0.0))),
        }
    )
    d = 2 / (9 * (k - 1))
    uneven = (F.pow(F.col("__chi") / (k - 1), F.lit(1 / 3)) - (1 - d)) / F.sqrt(d)
    low, high = F.col("__low"), n - F.col("__low")
    expected = 2 * low * high / n
    spread = F.sqrt(F.greatest(expected * (expected - 1) / (n - 1), F.lit(1e-9)))
    runs = (F.col("__runs") - 1 - expected) / spread
    serial = (F.coalesce(F.try_divide("__cov", "__var"), F.lit(1.0)) + 1 / n) * F.sqrt(n)
    deviate = F.sqrt(F.pow(F.greatest(uneven, F.lit(0.0)), F.lit(2.0)) + F.pow(F.least(F.abs(runs), F.lit(99.0)), F.lit(2.0)) + F.pow(serial, F.lit(2.0)))
    return rows.withColumn("deviate", deviate).drop("__a", "__b", "__k", "__v", "__mean", "__squares", "__chi", "__low", "__runs", "__var", "__cov")


def _text_bits(body: Column, k: Column) -> Column:
    """log2 of the likelihood of characters as text over that as uniform ones of k; the first character tells nothing."""
    chars = F.split(body, "")
    kind = lambda c: F.when(c.rlike("[a-z]"), 0).when(c.rlike("[A-Z]"), 1).when(c.rlike("[0-9]"), 2).otherwise(3)
    follows = F.array(*(F.lit(math.log2(p / n)) for row in _FOLLOWS for p, n in zip(row, _SIZES, strict=True)))
    coded = F.transform(chars, lambda c: F.struct(kind(c).alias("kind"), F.instr(F.lit(_LETTERS), F.lower(c)).alias("letter")))

    def step(a: Column, x: Column) -> Column:
        last = a["last"]
        paired = (last["letter"] > 0) & (x["letter"] > 0) & ~((last["kind"] == 0) & (x["kind"] == 1))  # an inner capital begins a word
        pair = F.when(paired, (F.ascii(F.substring(F.lit(_PAIRS), last["letter"] * 26 + x["letter"] - 26, F.lit(1))) - ord("m")) / 2).otherwise(0.0)
        bits = F.when(last.isNull(), 0.0).otherwise(F.get(follows, last["kind"] * 4 + x["kind"]) + pair + F.log2(k))
        return F.struct((a["bits"] + bits).alias("bits"), x.alias("last"))

    begin = F.struct(F.lit(0.0).alias("bits"), F.lit(None).cast("struct<kind:int,letter:int>").alias("last"))
    return F.aggregate(coded, begin, step, lambda a: a["bits"])


def _limits(tested: DataFrame, rate: float) -> DataFrame:
    """(class, limit): the bits that reported tokens of each class of length stay below; no row for a class without any.

    A row of `tested` (class, token, deviate, bits) a candidate; equal tokens count once. Both tables that follow are bounded by BINS, FARTHEST and CLASSES.
    """
    place = F.floor(F.greatest(F.least(F.col("bits"), F.lit(float(FARTHEST))), F.lit(-float(FARTHEST))) * BINS)
    bins = tested.withColumns({"bin": place, "passed": F.col("deviate") < MOST_DEVIATE}).select("class", "token", "bin", "passed").distinct()
    bins = bins.groupBy("class", "bin").agg(F.count("*").alias("n"), F.count_if("passed").alias("k"))
    share = F.sum("k").over(Window.partitionBy("class").orderBy("bin")) / F.sum("n").over(Window.partitionBy("class"))
    limits = bins.withColumn("limit", F.log2(share) + math.log2(rate / (1 - rate)))
    return limits.where((F.col("bin") + 1) / BINS <= F.col("limit")).groupBy("class").agg(F.max("limit").alias("limit"))


def _ranked(kind: str, rank: int) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))


def of_kinds(spans: Column | str, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def secret_spans(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, spans) for each row of `docs` (doc_id, text): spans is an array of (start, kind, end) in order."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    for kind, (pattern, group, least) in BASE.items():
        rows = _spans(rows, kind, pattern, group, least)
    rows = _spans(rows, "random", RANDOM, 0, 20, token=True)
    base = F.concat(*(_ranked(kind, k) for k, kind in enumerate(BASE)))
    rows = rows.withColumn("base", F.array_sort(base))
    free = F.filter("random", lambda s: ~functools.reduce(lambda a, b: a | b, (_meets(s, kind) for kind in BASE)))
    held = materialise(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", free.alias("tokens")), "secret-spans")
    tested = _deviates(held.select("row", F.explode("tokens").alias("t")).select("row", "t.*"))
    length = F.floor(CLASSES * F.log2(F.col("n").cast("double"))).cast("int")
    tested = materialise(tested.select("row", "start", "end", "deviate", "bits", length.alias("class"), F.xxhash64("token").alias("token")), "secret-tokens")
    passed = tested.where((F.col("deviate") < MOST_DEVIATE) & (F.col("bits") < math.log2(rate / (1 - rate))))
    found = passed.join(F.broadcast(_limits(tested, rate)), "class").where(F.col("bits") < F.col("limit"))  # a row a class
    extra = found.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(len(BASE)).alias("rank"), "end")).alias("extra"))
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast("array<struct<start:int,rank:int,end:int>>"))))
    named = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1).alias("kind"), s["end"].alias("end")))
    return held.join(extra, "row", "left").select("doc_id", named.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

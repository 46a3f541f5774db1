"""Heuristic quality rules as a short-circuit cascade, in DataFrame functions only.

A document fails at the first rule that rejects it, so the order of rules changes the work and never the verdict. The order is planned on a
bounded sample: how long each rule takes over the sample beyond a job that evaluates no rule, with the sample repeated until the dearest
rule stands out from the job around it, and what each combination of rules rejects there; greedily, the next rule is the one that rejects
most of what is still left per second. The cascade is one CASE expression, whose later branches are not evaluated for a document that an
earlier one rejects. The figures that rules compare are results of their own and computed for every document.

Defined results: a null or empty text has no words and fails the base test; very long texts are measured whole; equal rows get equal verdicts;
of rules that reject equally much per second the one given first comes first; extra columns pass through, but a column named like an
output column gives way to it; an empty table gives an empty result, in the order the rules were given.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.llm.common import keep_first_names, materialise

SPACE = r"[\x20\x09-\x0D]"
_STRIP = " \t\n\x0b\x0c\r"
WINDOW = 8
SAMPLE_ROWS, SAMPLE_A_PARTITION = 2000, 64
#: Seconds by which the dearest rule has to exceed an empty job, times that the sample is repeated for it at most, and runs of which the shortest counts.
STANDS_OUT, TIMES, RUNS = 0.2, 64, 2
#: Seconds that any rule counts at least.
LEAST_COST = 1e-3
FIGURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """rejects: SQL condition over the columns of measured(): text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""

    name: str
    rejects: str


#: Text that is not prose: symbol junk, tables, shouting, repeated lines and words, digits, chopped or glued words.
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_dup_lines > 3 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("stuttering", r"5 * regexp_count(text, '(?<!\\S)(\\S+)(?=\\s+\\1(?!\\S))') > n_words"),
    Rule("shouting", "10 * regexp_count(text, '\\\\p{Lu}') > 4 * word_chars"),
    Rule("exclaiming", "5 * regexp_count(text, '[!?]') > n_words"),
    Rule("digits", "10 * regexp_count(text, '[0-9]') > 3 * word_chars"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
)


def measured(docs: DataFrame) -> DataFrame:
    """`docs` with FIGURES of each whole text, all long; n_lines: of the lines with a word."""
    rest = keep_first_names(docs, list(FIGURES))
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(_STRIP))
    out = docs.select(*rest).withColumn("__words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+", -1)))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # hashes of words, of two words, four and eight: each step joins two neighbours of the step before
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "__lines": lines,
            "__h": F.transform("__words", lambda x: F.xxhash64(x)),
        }
    )
    step = 1
    while step < WINDOW:
        k, h = step, F.col("__h")
        joined = F.transform(F.slice(h, 1, F.greatest(F.size(h) - k, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(F.col("__h"), i + k)))  # noqa: B023
        out = out.withColumn("__h", joined)
        step *= 2
    out = out.withColumns({"n_lines": F.size("__lines").cast("long"), "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"), "__again": F.size(F.array_distinct("__h")) < F.size("__h")})
    # windows that occur again, by hash and place; a place counts if a neighbour in this order has its hash
    out = out.withColumn("__sorted", F.when(F.col("__again"), F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, i, d: F.coalesce(F.get(F.col("__sorted"), i + d)["h"] == x["h"], F.lit(False))
    places = F.transform(F.filter("__sorted", lambda x, i: F.when(i > 0, same(x, i, -1)).otherwise(F.lit(False)) | same(x, i, 1)), lambda x: x["i"])
    out = out.withColumn("__places", F.sort_array(places))
    gaps = F.transform("__places", lambda x, i: F.coalesce(F.least(F.get(F.col("__places"), i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
    out = out.withColumn("n_repeat_words", F.when(F.col("__again"), F.aggregate(gaps, F.lit(0), lambda a, x: a + x)).otherwise(0).cast("long"))
    return out.select(*rest, *FIGURES)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def costs(sample: DataFrame, flags: Sequence[Column]) -> list[float]:
    """Seconds that each flag takes over `sample`, beyond those of a job without any."""

    def seconds(flag: Column, times: int) -> float:
        took = []
        repeated = sample.withColumn("__time", F.explode(F.sequence(F.lit(1), F.lit(times))))
        for _ in range(RUNS):
            began = time.perf_counter()
            repeated.agg(F.count_if(flag)).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    times = 1
    while True:
        idle = seconds(F.col("__time") < 0, times)
        found = [max(seconds(f, times) - idle, 0.0) for f in flags]
        if times >= TIMES or max(found, default=0.0) >= STANDS_OUT:
            return [max(x / times, LEAST_COST / times) for x in found]
        times *= 8


def plan(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order of rejections per second, from at most `sample_rows` rows, the first ones of each partition."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    first = docs.select("text").where(place < SAMPLE_A_PARTITION).limit(sample_rows)
    sample = materialise(measured(first), "rule-sample")
    flags = [F.coalesce(F.expr(r.rejects), F.lit(False)) for r in rules]
    combos = sample.groupBy(F.concat(*(f.cast("int").cast("string") for f in flags)).alias("bits")).count().collect()  # at most 2 ** rules
    seconds = costs(sample, flags) if combos else [1.0] * len(rules)
    return ordered(rules, seconds, {r["bits"]: r["count"] for r in combos})


def ordered(rules: Sequence[Rule], seconds: Sequence[float], left: dict[str, int]) -> list[Rule]:
    """Greedily by rejections per second; left: documents by the rules that reject them, a bit a rule."""
    order, todo = [], list(range(len(rules)))
    while todo:
        best = max(todo, key=lambda k: (sum(n for bits, n in left.items() if bits[k] == "1") / seconds[k], -k))
        order.append(rules[best])
        todo.remove(best)
        left = {bits: n for bits, n in left.items() if bits[best] == "0"}
    return order


def cascade(measured_docs: DataFrame, in_order: Sequence[Rule]) -> DataFrame:
    """measured() rows with failed_rule (`base`, a rule's name, or null) and kept."""
    rest = keep_first_names(measured_docs, ["failed_rule", "kept"])
    verdict = F.when(base_failed(), F.lit("base"))
    for rule in in_order:
        verdict = verdict.when(F.expr(rule.rejects), F.lit(rule.name))
    return measured_docs.select(*rest, verdict.alias("failed_rule")).withColumn("kept", F.col("failed_rule").isNull())


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """`docs` with the columns of measured(), failed_rule and kept.

    kept is the same in every run; failed_rule is the rule met first, in an order that follows costs measured on the machine, so that of several rules that
    reject a document another may be named in another run.
    """
    return cascade(measured(docs), plan(docs, rules))

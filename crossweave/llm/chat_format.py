r"""Conversations as training text, by a finite-state machine over roles, in DataFrame functions only.

A template declares the machine: its states are `start` and the roles, a turn's role is the symbol read and the next state. Each permitted step (state,
role) has the string that opens the turn, each role the string that closes it and whether its text counts for the loss. A turn that no step permits
is a stray: it is written with its role spelt out, so that every conversation has a text and can be read back, and `valid` is false. A conversation
is valid if it has no stray and ends in an accepting role.

Control strings inside texts and roles are escaped: `[INST]` becomes `[\INST]`, and what looks like an escaped one gets one backslash more, so that no
control string is left and removing one backslash each gives the text again. All other text stays as it is. Templates in which a control string
overlaps or contains another are refused; so text and template never form one together, and splitting the formatted text at
control strings finds the turns: the two strings around a piece tell its role.

Defined results: turns are in the order of `turn` (null first), equal ones by role, then text; repeated rows are turns each; a null text is
empty, a null role is the role '' (a stray); null conv_id is a conversation of its own; other columns are not read; an empty table gives
an empty result. Work is linear in a conversation's text. A conversation is one row: its formatted text has to fit 2 GB, as any value of Spark.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "start"
_BACKSLASH = "\\"


@dataclass(frozen=True)
class Role:
    """close: what follows the text; loss: whether the text counts for the loss; accepting: whether a conversation may end here."""

    close: str
    loss: bool = False
    accepting: bool = False


@dataclass(frozen=True)
class Template:
    """opens: what precedes the text, by (state, role). stray: what precedes a spelt role, and what follows it, closed by `other` if the role is unknown."""

    control: tuple[str, ...]
    roles: Mapping[str, Role]
    opens: Mapping[tuple[str, str], str]
    stray: tuple[str, str]
    other: Role

    def __post_init__(self) -> None:
        for c in self.control:
            if len(c) < 2 or _BACKSLASH in c:
                raise ValueError(f"a control string has two characters at least, and no backslash: {c!r}")
            for d in self.control:
                if (c != d and c in d) or any(c[-k:] == d[:k] for k in range(1, min(len(c), len(d)))):
                    raise ValueError(f"{c!r} and {d!r} overlap")
        if len({*self.control}) < len(self.control):
            raise ValueError("a control string is given twice")
        self.pieces()

    def tokens(self) -> str:
        return "|".join(re.escape(c) for c in self.control)

    def _ends(self, before: str, after: str) -> tuple[str, str, int, int]:
        """The control strings around a text between `before` and `after`, and how many characters of each lie between them and the text."""
        a, b = [*re.finditer(self.tokens(), before)], re.search(self.tokens(), after)
        if not a or not b or a[-1].end() == len(before) or b.start() == 0:
            raise ValueError(f"text needs a control string and a blank before it and after it: {before!r}, {after!r}")
        return a[-1][0], b[0], len(before) - a[-1].end(), b.start()

    def pieces(self) -> dict[tuple[str, str], tuple[str | None, int, int]]:
        """By the control strings around a piece: its role (None: the one spelt before it; '\\n': a spelt role) and the blanks around the text."""
        closes = {START: "", "": self.other.close} | {r: x.close for r, x in self.roles.items()}
        found: dict[tuple[str, str], tuple[str | None, int, int]] = {}
        layout = set()

        def add(before: str, after: str, role: str | None) -> None:
            a, b, lead, trail = self._ends(before, after)
            if found.setdefault((a, b), (role, lead, trail)) != (role, lead, trail):
                raise ValueError(f"two kinds of text stand between {a!r} and {b!r}")
            parts = re.split(f"({self.tokens()})", before)
            layout.update(zip(parts[1::2], parts[3::2], strict=False))

        for (state, role), opening in self.opens.items():
            add(closes[state] + opening, closes[role], role)
        for close in closes.values():
            add(close + self.stray[0], self.stray[1], "\n")
        for close in closes.values():
            if close:
                add(self.stray[1], close, None)
        if layout & {*found}:
            raise ValueError("a text stands between control strings that also follow each other")
        return found


#: One exchange a line of control strings; the system's text goes before the first user's.
INSTRUCT = Template(
    control=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"),
    roles={"system": Role("\n<</SYS>>\n\n"), "user": Role(" [/INST]"), "assistant": Role(" </s>", loss=True, accepting=True)},
    opens={
        (START, "system"): "<s>[INST] <<SYS>>\n",
        (START, "user"): "<s>[INST] ",
        ("system", "user"): "",
        ("user", "assistant"): " ",
        ("assistant", "user"): "<s>[INST] ",
    },
    stray=("<s>[ROLE] ", " [/ROLE] "),
    other=Role(" </s>"),
)


def _sites(template: Template) -> list[tuple[str, str]]:
    """First characters of control strings, and what of them may follow."""
    heads = sorted({c[0] for c in template.control})
    return [(re.escape(h), "|".join(re.escape(c[1:]) for c in template.control if c[0] == h)) for h in heads]


def escaped(text: Column, template: Template) -> Column:
    found = "|".join(rf"{head}(?=\\*+(?:{rest}))" for head, rest in _sites(template))
    return F.regexp_replace(text, found, r"$0\\")


def unescaped(text: Column, template: Template) -> Column:
    found = "|".join(rf"(?<={head})\\(?=\\*+(?:{rest}))" for head, rest in _sites(template))
    return F.regexp_replace(text, found, "")


def _by_step(state: Column, role: Column, values: Mapping[tuple[str, str], str]) -> Column:
    return F.coalesce(*(F.when((state == s) & (role == r), F.lit(v)) for (s, r), v in values.items()))


def formatted(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """(conv_id, segments, valid, first_stray) of rows (conv_id, turn, role, text).

    segments: array of (text, loss), whose texts joined are the formatted conversation. first_stray: 0-based place of the first turn out of order, or null.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), text.alias("text"))
    turns = rows.select("conv_id", turn.alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    # the state before a turn is the role before it; a role named like the start state is none of the template's
    known = [F.lit(r) for r in template.roles]
    state = lambda i: F.when(i == 0, F.lit(START)).otherwise(F.get(F.col("turns"), i - 1)["role"])
    opening = lambda x, i: F.when((i > 0) & ~F.get(F.col("turns"), i - 1)["role"].isin(known), F.lit(None)).otherwise(_by_step(state(i), x["role"], template.opens))
    turns = turns.withColumn("openings", F.transform("turns", opening))
    spelt = lambda x: F.concat(F.lit(template.stray[0]), escaped(x["role"], template), F.lit(template.stray[1]))
    closing = lambda x: F.coalesce(*(F.when(x["role"] == r, F.lit(v.close)) for r, v in template.roles.items()), F.lit(template.other.close))
    counted = lambda x: x["role"].isin([F.lit(r) for r, v in template.roles.items() if v.loss])
    segment = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
    parts = lambda x, i: F.array(
        segment(F.coalesce(F.get(F.col("openings"), i), spelt(x)), F.lit(False)),
        segment(escaped(x["text"], template), counted(x)),
        segment(closing(x), F.lit(False)),
    )
    strays = F.array_position(F.transform("openings", lambda x: x.isNull()), True)
    ends = F.element_at("turns", -1)["role"].isin([F.lit(r) for r, v in template.roles.items() if v.accepting])
    return turns.select(
        "conv_id",
        F.filter(F.flatten(F.transform("turns", parts)), lambda x: x["text"] != "").alias("segments"),
        ((strays == 0) & ends).alias("valid"),
        F.when(strays > 0, strays - 1).alias("first_stray"),
    )


def joined(segments: Column) -> Column:
    """The formatted text of a conversation."""
    return F.array_join(F.transform(segments, lambda x: x["text"]), "")


def loss_text(segments: Column, template: Template = INSTRUCT) -> Column:
    """What the loss mask covers, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: unescaped(x["text"], template)), "")


def read_back(texts: DataFrame, column: str, template: Template = INSTRUCT) -> DataFrame:
    """`texts` with turns, an array of (role, text) found in the formatted text of `column` alone."""
    tokens = template.tokens()
    pieces = template.pieces()
    heads = "".join(sorted({re.escape(c[0]) for c in template.control}))
    tails = "".join(sorted({re.escape(c[-1]) for c in template.control}))
    split = texts.withColumn("__parts", F.split(F.col(column), f"(?=[{heads}])(?={tokens})|(?<=[{tails}])(?<={tokens})", -1))
    at = lambda i: F.get(F.col("__parts"), i)
    key = lambda i: F.concat_ws("\n", at(i - 1), at(i + 1))
    names = {"\n".join(k): v for k, v in pieces.items()}
    inside = lambda x, lead, trail: F.substring(x, F.lit(lead + 1), F.length(x) - lead - trail)
    is_text = lambda x, i: (i > 0) & ~x.isin([F.lit(c) for c in template.control])
    cut = lambda x, i: F.coalesce(*(F.when(key(i) == k, unescaped(inside(x, lead, trail), template)) for k, (_, lead, trail) in names.items()))
    kind = lambda i: F.coalesce(*(F.when(key(i) == k, F.lit("\r" if role is None else role)) for k, (role, _, _) in names.items()))
    marked = F.transform("__parts", lambda x, i: F.struct(F.when(is_text(x, i), kind(i)).alias("kind"), F.when(is_text(x, i), cut(x, i)).alias("text")))
    split = split.withColumn("__marked", F.filter(marked, lambda x: x["kind"].isNotNull()))
    named = lambda x, i: F.when(x["kind"] == "\r", F.get(F.col("__marked"), i - 1)["text"]).otherwise(x["kind"])
    turns = F.transform("__marked", lambda x, i: F.struct(named(x, i).alias("role"), x["text"].alias("text"), (x["kind"] == "\n").alias("spelt")))
    kept = F.filter(turns, lambda x: ~x["spelt"])
    return split.withColumn("turns", F.transform(kept, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))).drop("__parts", "__marked")


def chat_digests(rows: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid) read back from the formatted conversations."""
    out = formatted(rows, template).select("conv_id", "valid", joined(F.col("segments")).alias("formatted"), loss_text(F.col("segments"), template).alias("loss"))
    out = read_back(out, "formatted", template)
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )

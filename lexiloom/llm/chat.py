r"""Chat formatting by a finite-state machine over roles and a declarative template; no Python in the plan.

A template lists, for each role, the pieces of a turn: literal marks and the text, each with a flag
that says whether a model learns from it.  The machine's moves are (state, role, next state); a
conversation is valid if every turn has a move and the last state is a final one.  Turns of roles
that the template doesn't know are formatted by a general form that names the role, so nothing is lost.

Control strings inside texts (and role names) are escaped reversibly: one backslash goes in behind the
first character of each control string, and behind that of each string that differs from one only by
backslashes there, so reading back takes exactly one away.

Defined cases: null texts and roles count as empty; the empty role and unknown ones are no move of the
machine, so such a conversation isn't valid but is formatted; equal turn numbers go by role, then text,
null turn numbers first; repeated rows are turns of their own; rows with a null conversation id are one
conversation; texts of any length are taken whole; an empty table gives no row; other columns are
ignored, whatever their names.  A conversation is one training text and so one row, however many turns
it has; its turns are gathered once, by one shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT = "{text}"
_SEGMENT = "array<struct<text: string, loss: boolean, mark: boolean>>"


@dataclass(frozen=True)
class Template:
    """``roles``: pieces (a mark or ``{text}``, and its loss flag) of each role's turn, exactly one of them the text.

    A role without a mark before its text must be the last one.  ``controls`` are the strings that texts
    must not hold; every mark must hold one, and none may overlap another.  ``other``: the marks around
    the name and the text of a turn of an unknown role.
    """

    roles: dict[str, tuple[tuple[str, bool], ...]]
    controls: tuple[str, ...]
    moves: tuple[tuple[str, str, str], ...]
    final: tuple[str, ...]
    start: str = "start"
    begin: str = "<s>"
    other: tuple[str, str, str] = ("[TURN]", "[AS]", "[/TURN]")

    def __post_init__(self) -> None:
        for c in self.controls:
            if len(c) < 2 or "\\" in c:
                raise ValueError(f"a control string has two characters at least and no backslash: {c!r}")
            for d in self.controls:
                if c != d and c in d or any(c[-n:] == d[:n] for n in range(1, min(len(c), len(d)) + (c != d))):
                    raise ValueError(f"control strings overlap: {c!r}, {d!r}")
        open_ended = [r for r in self.roles if not self.marks(r)[0]]
        if open_ended not in ([], list(self.roles)[-1:]):
            raise ValueError("only the last role may begin with its text")
        for r in self.roles:
            before, after = self.marks(r)
            for mark in filter(None, (before, after)):
                if not any(c in mark for c in self.controls):
                    raise ValueError(f"a mark of {r!r} holds no control string: {mark!r}")
            if not after:
                raise ValueError(f"the text of {r!r} has no end")
        if not set(self.other) <= set(self.controls):
            raise ValueError("the marks of unknown roles are control strings")

    def marks(self, role: str) -> tuple[str, str]:
        """What stands before and after a role's text."""
        pieces = [p for p, _ in self.roles[role]]
        if pieces.count(TEXT) != 1:
            raise ValueError(f"a turn of {role!r} has one text")
        at = pieces.index(TEXT)
        return "".join(pieces[:at]), "".join(pieces[at + 1 :])

    def _pattern(self, backslashes: str) -> str:
        first = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        return f"([{first}]){backslashes}({'|'.join(re.escape(c[1:]) for c in self.controls)})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(r"(\\*)"), r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(r"\\(\\*)"), "$1$2$3")

    def segments(self, role: Column, text: Column) -> Column:
        """The pieces of a turn, with their loss flags and whether they are marks."""
        piece = lambda value, loss, mark: F.struct(value.alias("text"), F.lit(loss).alias("loss"), F.lit(mark).alias("mark"))
        mark = lambda value, loss=False: piece(F.lit(value), loss, True)
        escaped = self.escape(text)
        before, between, after = self.other
        chosen = F
        for name, pieces in self.roles.items():
            chosen = chosen.when(role == name, F.array(*(piece(escaped, loss, False) if p == TEXT else mark(p, loss) for p, loss in pieces)))
        return chosen.otherwise(F.array(mark(before), piece(self.escape(role), False, False), mark(between), piece(escaped, False, False), mark(after))).cast(_SEGMENT)

    def turn_of(self, chunk: Column) -> Column:
        """Role and text of one turn as it stands in a formatted text."""
        before, between, after = self.other
        inside = F.substring(chunk, F.lit(len(before) + 1), F.char_length(chunk) - len(before) - len(after))
        name = F.substring_index(inside, between, 1)
        rest = F.substring(inside, F.char_length(name) + len(between) + 1, F.char_length(inside))
        turn = lambda role, text: F.struct(role.alias("role"), self.unescape(text).alias("text"))
        chosen = F.when(chunk.startswith(before), turn(self.unescape(name), rest))
        for role in self.roles:
            head, tail = self.marks(role)
            text = F.substring(chunk, F.lit(len(head) + 1), F.char_length(chunk) - len(head) - len(tail))
            chosen = chosen.when(chunk.startswith(head), turn(F.lit(role), text)) if head else chosen.otherwise(turn(F.lit(role), text))
        return chosen

    def turn_pattern(self) -> str:
        around = [(self.other[0], self.other[2]), *map(self.marks, self.roles)]
        return "(?s)" + "|".join(f"{re.escape(a)}.*?{re.escape(b)}" for a, b in around)


#: Instructions between marks; answers, and only they, are learned from.
INSTRUCT = Template(
    roles={
        "system": (("[SYS] ", False), (TEXT, False), (" [/SYS]", False)),
        "user": (("[INST] ", False), (TEXT, False), (" [/INST]", False)),
        "assistant": ((TEXT, True), ("</s>", False)),
    },
    controls=("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[TURN]", "[AS]", "[/TURN]"),
    moves=(("start", "system", "system"), ("start", "user", "user"), ("system", "user", "user"), ("user", "assistant", "assistant"), ("assistant", "user", "user")),
    final=("assistant",),
)


def _walk(turns: Column, template: Template) -> Column:
    """(state, at, wrong) after all turns: wrong is the place, from 1, of the first turn without a move, 0 if none.

    No field is ever null: the machine has no state behind a wrong turn, which is the empty name.
    """
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("at"), F.lit(0).alias("wrong"))

    def step(now: Column, turn: Column) -> Column:
        to = F
        for state, role, following in template.moves:
            to = to.when((now["state"] == state) & (turn["role"] == role), F.lit(following))
        to, place = to.otherwise(F.lit("")), now["at"] + 1
        return F.struct(to.alias("state"), place.alias("at"), F.when((now["wrong"] == 0) & (to == ""), place).otherwise(now["wrong"]).alias("wrong"))

    return F.aggregate(turns, begin, step)


def format_chats(turns: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: conv_id, n_turns, valid, wrong_turn (its place, null if none), segments, formatted.

    ``segments`` holds (text, loss, mark) in order; ``formatted`` is the template's beginning and all their texts.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).alias("t"))
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    held = held.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        _walk(F.col("turns"), template).alias("walk"),
        F.flatten(F.transform("turns", lambda t: template.segments(t["role"], t["text"]))).alias("segments"),
    )
    wrong = F.nullif(F.col("walk.wrong"), F.lit(0))
    valid = wrong.isNull() & F.col("walk.state").isin(*template.final)
    return held.select("conv_id", "n_turns", valid.alias("valid"), wrong.alias("wrong_turn"), "segments", F.concat(F.lit(template.begin), F.array_join("segments.text", "")).alias("formatted"))


def read_turns(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns, (role, text), that a formatted text was made of."""
    body = F.substring(formatted, F.lit(len(template.begin) + 1), F.char_length(formatted))
    return F.transform(F.regexp_extract_all(body, F.lit(template.turn_pattern()), F.lit(0)), template.turn_of)


def read_loss(segments: Column, template: Template = INSTRUCT) -> Column:
    """All text under the loss mask, as it was before escaping."""
    learned = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learned, lambda s: F.when(s["mark"], s["text"]).otherwise(template.unescape(s["text"]))), "")

"""Chat formatting from a declarative template, in DataFrame functions only.

A finite-state machine over roles validates the order of turns. Each turn becomes segments: a header, the text and an
end mark, each with a loss flag that the template gives by role. Control strings inside texts are escaped reversibly, so
the formatted string can be split and read back without a second source.

Turns meet by conversation in two steps, first in chunks of CHUNK turns and then chunk by chunk, so a very long
conversation is sorted and escaped over many tasks and only its chunks meet.

Defined results: a null text is empty; a null role is the role ''; roles that the template doesn't list are formatted
under its other-label and make the conversation invalid; turns sort by turn, role and text, nulls first, so ties and
repeated rows have one order and all stay; rows with a null conversation form one conversation; extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256


@dataclass(frozen=True)
class Template:
    """labels: what a header shows for a role; loss: roles whose texts are under the loss mask; start, moves and final:
    the states of the role machine, which reads roles and stays in the state named by the role last read."""

    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"})
    other: str = "Role "
    head: str = "### "
    colon: str = ": "
    end: str = "</turn>"
    line: str = "\n"
    loss: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)})
    final: tuple[str, ...] = ("assistant",)

    def escapes(self) -> list[tuple[str, str]]:
        """Control strings and what stands for them; the backslash first. None of them is left in an escaped text."""
        return [("\\", "\\b"), (self.head.strip(), "\\h"), (self.end, "\\e"), (self.colon.strip(), "\\c")]


def escape(c: Column, t: Template, role: bool = False) -> Column:
    """Backslash and control strings replaced; in role names the colon too, as it ends them."""
    for raw, put in t.escapes()[: 4 if role else 3]:
        c = F.replace(c, F.lit(raw), F.lit(put))
    return c


def unescape(c: Column, t: Template) -> Column:
    """The inverse: every backslash begins an escape, and the backslash's own is undone last."""
    for raw, put in reversed(t.escapes()):
        c = F.replace(c, F.lit(put), F.lit(raw))
    return c


def label(role: Column, t: Template) -> Column:
    shown = F.concat(F.lit(t.other), escape(role, t, role=True))
    for name, text in t.labels.items():
        shown = F.when(role == name, F.lit(text)).otherwise(shown)
    return shown


def role_of(shown: Column, t: Template) -> Column:
    role = unescape(F.substring(shown, F.lit(len(t.other) + 1), F.length(shown)), t)
    for name, text in t.labels.items():
        role = F.when(shown == text, F.lit(name)).otherwise(role)
    return role


def segments(rows: DataFrame, t: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a turn: conv, turn, role, and segments, a list of (text, loss): header, escaped text, end."""
    name, body = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    seg = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))
    return rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        name.alias("role"),
        F.array(seg(F.concat(F.lit(t.head), label(name, t), F.lit(t.colon)), F.lit(False)), seg(escape(body, t), name.isin(*t.loss)), seg(F.lit(t.end + t.line), F.lit(False))).alias("segments"),
    )


def _machine(roles: Column, t: Template) -> Column:
    """The state after all roles: the last role while every move is allowed, else 'invalid'."""

    def step(state: Column, read: Column) -> Column:
        ok = F.lit(False)
        for at, into in t.moves.items():
            ok = ok | ((state == at) & read.isin(*into))
        return F.when(ok, read).otherwise(F.lit("invalid"))

    return F.aggregate(roles, F.lit(t.start), step)


def format_chats(rows: DataFrame, t: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv, formatted (the whole string), segments (texts and loss flags in order), valid (by
    the role machine)."""
    each = segments(rows, t, conv, turn, role, text)
    item = F.struct("turn", "role", F.col("segments")[1]["text"].alias("body"), "segments")
    # Chunks by turn keep the order between them; a null turn sorts first.
    chunk = F.floor(F.col("turn") / CHUNK)
    parts = each.groupBy("conv", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(item)).alias("turns"))
    made = parts.select("conv", F.struct("chunk", F.transform("turns", lambda x: x["role"]).alias("roles"), F.flatten(F.transform("turns", lambda x: x["segments"])).alias("segments")).alias("part"))
    whole = made.groupBy("conv").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    listed = whole.select("conv", F.flatten("parts.roles").alias("roles"), F.flatten("parts.segments").alias("segments"))
    return listed.select(F.col("conv").alias(conv), F.array_join("segments.text", "").alias("formatted"), "segments", _machine(F.col("roles"), t).isin(*t.final).alias("valid"))


def _turns(t: Template) -> Column:
    """The list of (role, text) that column formatted holds."""
    pieces = F.split("formatted", r"\Q" + t.end + t.line + r"\E", -1)
    rest = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.substring(p, F.lit(len(t.head) + 1), F.length(p)))
    at = lambda p: F.instr(p, t.colon)
    return F.transform(rest, lambda p: F.struct(role_of(F.substring(p, F.lit(1), at(p) - 1), t).alias("role"), unescape(F.substring(p, at(p) + len(t.colon), F.length(p)), t).alias("text")))


def read_back(formatted: DataFrame, t: Template = Template(), conv: str = "conv_id") -> DataFrame:
    """conv and turns, a list of (role, text), from the formatted string alone."""
    return formatted.select(conv, _turns(t).alias("turns"))


def digest(formatted: DataFrame, t: Template = Template(), conv: str = "conv_id") -> DataFrame:
    """Counts and digests of what is read back: turns from the string, and of these texts those whose segment the mask
    marks; a turn's text is the second of its three segments."""
    masks = F.transform(F.filter("segments", lambda s, i: i % 3 == 1), lambda s: s["loss"])
    turns = formatted.select(conv, "valid", F.length("formatted").cast("long").alias("formatted_chars"), _turns(t).alias("turns"), masks.alias("masks"))
    loss = F.array_join(F.zip_with("turns", "masks", lambda x, m: F.when(m, x["text"]).otherwise(F.lit(""))), "")
    read = turns.withColumn("loss", loss)
    lines = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return read.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )

"""Chat formatting from a declarative template, in DataFrame functions only.

A finite-state machine over roles checks the order of turns; the template
turns each turn into segments, each with its own loss flag. Strings that look
like the template's markers are escaped inside roles and texts: one backslash
goes between the two characters that open a marker, behind any that are there
already (``<|`` to ``<\\|``, ``<\\|`` to ``<\\\\|``), which is reversible and
leaves no marker in a text.

Defined results
---------------
* null text and null role are empty strings; an empty role is accepted by no
  state of the default machine.
* turns are ordered by turn (null first), then role, then text; repeated rows
  stay, as turns of their own.
* a row without a conversation id is a conversation of one turn.
* a conversation in an invalid order is still formatted; ``valid`` is false and
  ``error_turn`` is the position (from 0) of the first turn that the machine
  refuses, or the number of turns where the last state isn't accepting.
* empty tables give an empty result; other columns are ignored.

One conversation is one output row, so its turns meet in one task; the rows of
many conversations are spread by their id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Segments of a turn: (literal or ``{role}`` or ``{text}``, carries loss).

    ``open`` and ``close`` begin and end every turn. Every marker starts with the
    two characters of ``mark``. ``trained`` are the roles whose flagged segments
    count for the loss."""

    mark: str = "<|"
    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    segments: tuple[tuple[str, bool], ...] = (
        ("<|im_start|>", False),
        ("{role}", False),
        ("\n", False),
        ("{text}", True),
        ("<|im_end|>\n", False),
    )
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if len(self.mark) != 2 or not self.open.startswith(self.mark) or not self.close.startswith(self.mark):
            raise ValueError("markers must start with the two characters of mark")
        whole = "".join(s for s, _ in self.segments)
        if whole != f"{self.open}{{role}}\n{{text}}{self.close}":
            raise ValueError("a turn is open, role, newline, text, close")


@dataclass(frozen=True)
class Machine:
    """State transitions by role; ``accepting`` are the states to end in."""

    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "ready",
            ("start", "user"): "asked",
            ("ready", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accepting: tuple[str, ...] = ("answered",)


def _quote(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in text)


def escape(text: Column, template: Template = Template()) -> Column:
    a, b = map(_quote, template.mark)
    return F.regexp_replace(text, rf"{a}(\\*){b}", rf"{a}\\$1{b}")


def unescape(text: Column, template: Template = Template()) -> Column:
    a, b = map(_quote, template.mark)
    return F.regexp_replace(text, rf"{a}\\(\\*){b}", rf"{a}$1{b}")


def escape_role(role: Column, template: Template = Template()) -> Column:
    """As ``escape``; backslash and newline become two letters each, as the first
    newline of a turn ends its role."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")), template)


def unescape_role(role: Column, template: Template = Template()) -> Column:
    return F.replace(F.replace(unescape(role, template), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def _run(roles: Column, machine: Machine) -> Column:
    """State after all roles, and the position of the first refused one (or null)."""
    table = F.create_map(*[F.lit(x) for (state, role), to in machine.moves.items() for x in (f"{state}\0{role}", to)])
    begin = F.struct(F.lit(machine.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, role: Column) -> Column:
        to = F.element_at(table, F.concat(acc["state"], F.lit("\0"), role))
        return F.struct(
            F.when(acc["bad"].isNull(), F.coalesce(to, acc["state"])).otherwise(acc["state"]).alias("state"),
            (acc["at"] + 1).alias("at"),
            F.when(acc["bad"].isNull() & to.isNull(), acc["at"]).otherwise(acc["bad"]).alias("bad"),
        )

    return F.aggregate(roles, begin, step)


def format_conversations(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: Template = Template(),
    machine: Machine = Machine(),
) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (array of text and
    loss), n_turns, valid, error_turn."""
    row = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = df.select(F.col(conv_col).alias("conv_id"), row.alias("row"))
    many = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))
    lone = rows.where("conv_id IS NULL").select("conv_id", F.array("row").alias("turns"))

    def segments(turn: Column) -> Column:
        role, text = escape_role(turn["role"], template), escape(turn["text"], template)
        loss = turn["role"].isin(*template.trained)
        return F.array(
            *[
                F.struct(
                    (role if s == "{role}" else text if s == "{text}" else F.lit(s)).alias("text"),
                    (loss if flagged else F.lit(False)).alias("loss"),
                )
                for s, flagged in template.segments
            ]
        )

    out = many.unionByName(lone).select(
        "conv_id",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        F.size("turns").cast("long").alias("n_turns"),
        _run(F.transform("turns", lambda t: t["role"]), machine).alias("end"),
    )
    fine = F.col("end.bad").isNull() & F.col("end.state").isin(*machine.accepting)
    return out.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        "n_turns",
        fine.alias("valid"),
        F.when(~fine, F.coalesce(F.col("end.bad"), F.col("end.at"))).cast("long").alias("error_turn"),
    )


def parse_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text), unescaped, read back from a formatted conversation."""
    blocks = F.split(formatted, _quote(template.close))
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turn(block: Column) -> Column:
        body = F.substr(block, F.lit(len(template.open) + 1))
        cut = F.instr(body, "\n")
        return F.struct(
            unescape_role(F.substr(body, F.lit(1), cut - 1), template).alias("role"),
            unescape(F.substr(body, cut + 1), template).alias("text"),
        )

    return F.transform(blocks, turn)


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, in order."""
    under = F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template))
    return F.array_join(under, "")

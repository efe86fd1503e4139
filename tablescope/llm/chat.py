"""Chat formatting by a finite-state machine over roles, in built-in functions only.

A declarative template names, per role, the marks around a turn and whether the model is trained
on its text. The machine walks the roles of a conversation in turn order; a conversation is valid
if every step is allowed and the last state accepts. Every conversation is formatted, valid or not.

Control strings inside texts are escaped reversibly: backslashes are doubled, then a backslash is put
behind the first character of a control string. So a mark never occurs inside a text, and no mark
can form across a border, since `<` and `[` stand only at the start of a mark.

Null text and null role are empty; a null turn comes first; ties are ordered by role, then text; rows
without conv_id form one conversation of their own; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BEGIN, END, NAMED = "<s>", "</s>", "[:] "


@dataclass(frozen=True)
class Template:
    """role -> (name of its mark, trained on?); (state, role) -> state; accepting states."""

    roles: dict[str, tuple[str, bool]] = field(
        default_factory=lambda: {
            "system": ("SYS", False),
            "user": ("INST", False),
            "assistant": ("ANS", True),
            "tool": ("TOOL", False),
        }
    )
    steps: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "asked",
            ("start", "user"): "answer",
            ("asked", "user"): "answer",
            ("answer", "assistant"): "done",
            ("done", "user"): "answer",
            ("done", "tool"): "answer",
        }
    )
    accepting: tuple[str, ...] = ("done",)
    other: str = "TURN"

    @property
    def marks(self) -> list[str]:
        return [*(m for m, _ in self.roles.values()), self.other]

    @property
    def control(self) -> str:
        """What follows the first character of a control string."""
        names = "|".join(rf"{m}\]" for m in self.marks)
        return rf"/?(?:s>|{names})|:\]"


def escape(text: Column, template: Template) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"([<\[])(?={template.control})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _per_role(role: Column, template: Template, value) -> Column:
    out = F.lit(value(template.other, False))
    for name, (mark, trained) in template.roles.items():
        out = F.when(role == name, F.lit(value(mark, trained))).otherwise(out)
    return out


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, turn, role, text -> one row per conversation.

    formatted: the whole string. segments: array of (text, loss) whose texts concatenate to it.
    loss_spans: array of (start, length) in code points of `formatted`. state, valid: of the machine.
    One shuffle on conv_id serves both the running offset and the grouping.
    """
    template = template or Template()
    named = ~F.col("role").isin(list(template.roles))
    turns = (
        rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("_mark", _per_role(F.col("role"), template, lambda m, _: m))
        .withColumn("_loss", _per_role(F.col("role"), template, lambda _, t: t))
        .withColumn(
            "_open",
            F.concat(F.lit(f"{BEGIN}["), "_mark", F.lit("] "), F.when(named, F.concat(escape(F.col("role"), template), F.lit(NAMED))).otherwise("")),
        )
        .withColumn("_close", F.concat(F.lit(" [/"), "_mark", F.lit(f"]{END}")))
        .withColumn("_body", escape(F.col("text"), template))
        .withColumn("_chars", F.length("_open") + F.length("_body") + F.length("_close"))
    )
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    turns = turns.withColumn("_end", F.sum("_chars").over(order))
    # by the running end, then by the order itself: turns have at least one mark each, so no two ends tie
    parts = F.array_sort(F.collect_list(F.struct("_end", "role", "_open", "_body", "_close", "_loss", "_chars")))
    one = turns.groupBy("conv_id").agg(parts.alias("_t"))
    state = F.aggregate(
        "_t",
        F.lit("start"),
        lambda state, t: F.coalesce(
            F.element_at(
                F.create_map(*(F.lit(x) for (s, r), to in template.steps.items() for x in (f"{s} {r}", to))),
                F.concat(state, F.lit(" "), t["role"]),
            ),
            F.lit("invalid"),
        ),
    )
    segments = F.flatten(
        F.transform(
            "_t",
            lambda t: F.array(
                F.struct(t["_open"].alias("text"), F.lit(False).alias("loss")),
                F.struct(t["_body"].alias("text"), t["_loss"].alias("loss")),
                F.struct(t["_close"].alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    spans = F.transform(
        F.filter("_t", lambda t: t["_loss"]),
        lambda t: F.struct(
            (t["_end"] - t["_chars"] + F.length(t["_open"])).alias("start"),
            F.length(t["_body"]).cast("long").alias("length"),
        ),
    )
    return one.select(
        "conv_id",
        F.array_join(F.transform("_t", lambda t: F.concat(t["_open"], t["_body"], t["_close"])), "").alias("formatted"),
        segments.alias("segments"),
        spans.alias("loss_spans"),
        state.alias("state"),
    ).withColumn("valid", F.col("state").isin(list(template.accepting)))


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Adds `turns`, an array of (role, text, loss) parsed from `formatted` alone."""
    template = template or Template()
    names = F.create_map(*(F.lit(x) for role, (mark, _) in template.roles.items() for x in (mark, role)))
    trained = F.create_map(*(F.lit(x) for mark, loss in template.roles.values() for x in (mark, loss)))

    def parse(turn: Column) -> Column:
        mark = F.regexp_extract(turn, r"^<s>\[([A-Z]+)\] ", 1)
        skipped = F.length(F.lit(f"{BEGIN}[] ")) + F.length(mark)
        whole = F.substring(turn, skipped + 1, F.length(turn) - skipped - F.length(mark) - F.length(F.lit(" [/]")))
        at = F.instr(whole, F.lit(NAMED))
        other = mark == template.other
        return F.struct(
            F.when(other, unescape(F.substring(whole, F.lit(1), at - 1))).otherwise(names[mark]).alias("role"),
            unescape(F.when(other, F.substring(whole, at + len(NAMED), F.length(whole))).otherwise(whole)).alias("text"),
            F.when(other, F.lit(False)).otherwise(trained[mark]).alias("loss"),
        )

    pieces = F.split("formatted", END, -1)
    return formatted.withColumn("turns", F.transform(F.slice(pieces, 1, F.size(pieces) - 1), parse))

r"""Chat formatting with a role machine and per-segment loss flags, native Spark.

A template is data: opening and closing marks of a turn, the roles whose text
is learned, and the allowed steps between roles. A conversation becomes
segments ``(text, loss)``; their concatenation is the formatted string.

Escaping. The only control strings are ``<turn`` and ``</turn``. In a text,
``<``, any backslashes, then ``turn`` or ``/turn`` gets one more backslash
after the ``<``; reading takes one away. No escaped text holds a control
string, every text comes back exactly, and everything else stays as it is.
In a role, ``\``, ``<`` and ``>`` become ``\s``, ``\l`` and ``\g``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Marks, learned roles and the role machine.

    ``steps`` maps a state to the roles that may follow; the state after a
    turn is its role, the first state is ``start``. ``final`` are the roles a
    conversation may end with.
    """

    learned: tuple[str, ...] = ("assistant",)
    steps: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("assistant",)


OPEN, OPEN_END, CLOSE = "<turn ", ">\n", "</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", r"<$1$2")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per conversation: conv_id, segments, formatted, valid.

    ``turns`` has conv_id, turn, role and text; other columns are not read.
    Rows are ordered by turn, ties by role, then text; a null turn comes
    first; null role and text count as empty. A null conv_id is a
    conversation of its own. ``valid`` is the verdict of the role machine;
    invalid conversations are formatted all the same. ``segments`` holds, for
    each turn, its opening mark, its escaped text and its closing mark; only
    the text of a learned role has ``loss``. A conversation is one string, so
    it must fit in a row, like any string of Spark. An empty table gives an
    empty result.
    """
    allowed = [f"{a}>{b}" for a, bs in template.steps.items() for b in bs]
    step = lambda state, t: F.when(F.concat(state, F.lit(">"), t["role"]).isin(allowed), t["role"]).otherwise(F.lit("invalid"))
    ordered = turns.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("turn"),
                    F.coalesce(F.col("role"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text"), F.lit("")).alias("text"),
                )
            )
        ).alias("turns")
    )
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(OPEN_END)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"]).alias("text"), t["role"].isin(list(template.learned)).alias("loss")),
                F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return ordered.select(
        "conv_id",
        segments.alias("segments"),
        F.aggregate("turns", F.lit("start"), step).isin(list(template.final)).alias("valid"),
    ).withColumn("formatted", F.concat_ws("", F.transform("segments", lambda s: s["text"])))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string, unescaped."""
    pieces = F.filter(F.split(formatted, r"(?=<turn )"), lambda p: p != "")
    pattern = r"(?s)^<turn ([^>]*)>\n(.*)</turn>\n$"
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.regexp_extract(p, pattern, 1)).alias("role"),
            unescape(F.regexp_extract(p, pattern, 2)).alias("text"),
        ),
    )


def read_learned(segments: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])))

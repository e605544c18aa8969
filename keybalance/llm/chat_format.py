"""Conversations as one training string each, by Spark expressions only.

The turns of a conversation are collected as structs, sorted, and adjacent turns of
one role are merged into one message by array expressions. Three marks frame the
result: one opens a message and is followed by its role and a line feed, one stands
between merged turns, one closes a message. Marks and the other control strings
cannot occur inside a text: a backslash goes behind the first character of each,
and backslashes are doubled, which ``unescape`` undoes exactly.

The operator also gives the loss mask, the code point spans of the texts of the
trained role.

Defined results: a null text or role counts as empty; rows are ordered by turn, null
first, then role, then text, so ties have one order; repeated rows are turns of
their own; null conversation ids form one conversation; further columns are
ignored. A conversation is one output row, so its length is bounded by what one
string can hold, and partial results are not merged across tasks beyond that.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from keybalance.llm.native import cut, let, running

OPEN, NEXT, CLOSE = "<|im_start|>", "<|im_next|>", "<|im_end|>"
#: Strings that a trained model may treat as control.
CONTROL = [OPEN, NEXT, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_ESCAPED = r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)


def escape(text: Column, control: str = _ESCAPED) -> Column:
    r"""``\`` becomes ``\\``, and a control string gets ``\`` after its first character."""
    return F.regexp_replace(text, F.lit(control), F.lit(r"$0\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(\\?)"), F.lit("$1"))


def _escape_role(role: Column) -> Column:
    """Roles also hide line feeds, as one ends the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    lines = F.regexp_replace(role, F.lit(r"(?<!\\)((?:\\\\)*)\\n"), F.lit("$1\n"))
    return unescape(lines)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns as a sorted array<struct<turn,role,text>>."""
    turn = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def pieces(turns: Column) -> Column:
    """Per turn what stands before its text, and the escaped text."""

    def of(roles: Column) -> Column:
        """``roles``: per turn the role of the turn before, null for the first."""
        return F.zip_with(
            turns,
            roles,
            lambda t, before: F.struct(
                F.when(t["role"] == before, F.lit(NEXT))
                .otherwise(
                    F.concat(
                        F.when(before.isNull(), F.lit("")).otherwise(F.lit(CLOSE + "\n")),
                        F.lit(OPEN),
                        _escape_role(t["role"]),
                        F.lit("\n"),
                    )
                )
                .alias("head"),
                escape(t["text"]).alias("body"),
                t["role"].alias("role"),
            ),
        )

    before = F.concat(
        F.array(F.lit(None).cast("string")),
        F.transform(F.slice(turns, 1, F.size(turns) - 1), lambda t: t["role"]),
    )
    return let(before, of)


def _mask(parts: Column, trained: str) -> Column:
    """Code point spans of the trained role's texts; running sums over the turns."""
    lengths = F.transform(parts, lambda p: F.length(p["head"]) + F.length(p["body"]))

    def spans(ends: Column) -> Column:
        every = F.zip_with(
            parts,
            ends,
            lambda p, end: F.struct(
                p["role"].alias("role"), (end - F.length(p["body"])).alias("start"), end.alias("end")
            ),
        )
        held = F.filter(every, lambda s: s["role"] == trained)
        return F.transform(held, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return let(running(lengths), spans)


def format_chats(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted string, loss_spans array<struct<start,end>> per conversation."""
    return turns_of(conversations).select(
        "conv_id",
        F.inline(
            F.array(
                let(
                    pieces(F.col("turns")),
                    lambda parts: F.struct(
                        F.concat(
                            F.array_join(
                                F.transform(parts, lambda p: F.concat(p["head"], p["body"])), ""
                            ),
                            F.lit(CLOSE + "\n"),
                        ).alias("formatted"),
                        _mask(parts, trained).alias("loss_spans"),
                    ),
                )
            )
        ),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string as array<struct<role,text>>."""
    messages = F.filter(
        F.split(formatted, re.escape(CLOSE) + "\n", -1), lambda m: F.length(m) > 0
    )

    def turns(message: Column) -> Column:
        inner = F.substring(message, len(OPEN) + 1, F.length(message))

        def of(body: Column) -> Column:
            end = F.instr(body, "\n")
            return let(
                _unescape_role(F.substring(body, F.lit(1), end - 1)),
                lambda role: F.transform(
                    F.split(F.substring(body, end + 1, F.length(body)), re.escape(NEXT), -1),
                    lambda t: F.struct(role.alias("role"), unescape(t).alias("text")),
                ),
            )

        return let(inner, of)

    return F.flatten(F.transform(messages, turns))


def masked_text(formatted: Column, spans: Column) -> Column:
    """What the loss mask covers, unescaped, in order."""
    return F.array_join(F.transform(cut(formatted, spans), unescape), "")


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read back from its formatted string."""
    turn_text = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))

    def row(turns: Column) -> Column:
        return let(
            masked_text(F.col("formatted"), F.col("loss_spans")),
            lambda loss: F.struct(
                F.size(turns).cast("long").alias("n_turns"),
                F.sha2(F.array_join(F.transform(turns, turn_text), ""), 256).alias("turns_sha256"),
                F.length(loss).cast("long").alias("loss_chars"),
                F.sha2(loss, 256).alias("loss_sha256"),
                F.length("formatted").cast("long").alias("formatted_chars"),
            ),
        )

    return formatted.select(
        "conv_id", F.inline(F.array(let(read_back(F.col("formatted")), row)))
    )

r"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log has a row per event: conversation, sequence number, turn, kind, role, text.

* ``message`` sets the text of a turn;
* ``delta`` appends to it;
* ``edit`` sets it anew, ``regenerate`` empties it for the deltas that follow; either drops all later turns whose
  events all came before it, as they answered a text that is gone;
* ``delete`` removes the turn, until a later message, edit or regenerate.

``fold`` gives the final messages. A turn is first folded alone (conversation and turn are the key, so a hot
conversation is spread over tasks); then a running maximum over a conversation's turns finds dropped ones.
``render`` writes one text for a conversation:

    <|im_start|>role<|im_sep|>text<|im_end|>   for each turn, one after another

In roles and texts a backslash is written twice and ``<|`` as ``<\|``, so control strings stand only where the
template puts them and everything can be read back. ``loss_spans`` holds the place (start, length in code points)
of each assistant text. A conversation's messages must fit one row, as they are one training text.

Null text and role are empty, null turns and sequence numbers come first, a null conversation is a conversation.
Of events with one sequence number the order is by kind, role and text. Empty logs give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
RESETS = ("message", "edit", "regenerate", "delete")


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) from a log (conv_id, seq, turn, kind, role, text)."""
    e = events.select(
        "conv_id", "turn", "role",
        F.struct(F.coalesce(F.col("seq"), F.lit(-(1 << 62))).cast("long").alias("seq"), F.coalesce(F.col("kind"), F.lit("message")).alias("kind"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("e"),
    )
    turns = e.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("e")).alias("log"))
    last = F.coalesce(F.array_max(F.transform(F.col("log"), lambda x, i: F.when(x["kind"].isin(*RESETS), i))), F.lit(0))
    turns = turns.withColumn("from", last.cast("int")).select(
        "conv_id", "turn",
        F.element_at("log", F.col("from") + 1)["kind"].alias("kind"),
        F.filter("log", lambda x: x["role"] != "").alias("roles"),
        F.array_join(F.transform(F.slice("log", F.col("from") + 1, F.size("log")), lambda x: F.when(x["kind"].isin("regenerate", "delete"), "").otherwise(x["text"])), "").alias("text"),
        F.element_at("log", -1)["seq"].alias("last_seq"),
        F.array_max(F.transform(F.filter("log", lambda x: x["kind"].isin("edit", "regenerate")), lambda x: x["seq"])).alias("cut_seq"),
    )
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return (
        turns.withColumn("cut_before", F.max("cut_seq").over(before))
        .where((F.col("kind") != "delete") & (F.col("cut_before").isNull() | (F.col("cut_before") < F.col("last_seq"))))
        .select("conv_id", "turn", F.when(F.size("roles") > 0, F.element_at("roles", -1)["role"]).otherwise("").alias("role"), "text")
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) from messages (conv_id, turn, role, text)."""
    m = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    parts = F.transform(
        "m",
        lambda x: F.struct(
            F.concat(F.lit(START), escape(x["role"]), F.lit(SEP)).alias("head"), escape(x["text"]).alias("body"), (x["role"] == loss_role).alias("loss")
        ),
    )
    m = m.select("conv_id", parts.alias("p"))
    m = m.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        F.transform("p", lambda x: F.struct(F.char_length(x["head"]).alias("head"), F.char_length(x["body"]).alias("body"), x["loss"].alias("loss"))).alias("n"),
    )
    spans = F.aggregate(
        "n",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + x["head"] + x["body"] + len(END)).alias("at"),
            F.when(x["loss"], F.array_append(a["spans"], F.struct((a["at"] + x["head"]).alias("start"), x["body"].alias("length")))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return m.select("conv_id", "formatted", spans.alias("loss_spans"))


def parse(formatted: DataFrame) -> DataFrame:
    """Reads rendered conversations back: adds ``turns`` (array of role, text) and ``loss_text``."""
    bodies = F.filter(F.split("formatted", r"<\|im_end\|>", -1), lambda x: x != "")
    turn = lambda x: F.struct(
        unescape(F.substring_index(F.substring(x, len(START) + 1, 1 << 30), SEP, 1)).alias("role"),
        unescape(F.substring(x, F.instr(x, SEP) + len(SEP), F.char_length(x))).alias("text"),
    )
    return formatted.withColumn("turns", F.transform(bodies, turn)).withColumn(
        "loss_text", F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    )

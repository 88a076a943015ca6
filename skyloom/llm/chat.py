"""Chat formatting by prefix-target expansion.

A conversation becomes one text of marked turns, ``[[role]]`` + line feed + text + ``[[/]]`` + line feed. Inside
roles and texts ``&`` becomes ``&amp;`` and ``[`` becomes ``&lb;`` (in roles also ``]`` becomes ``&rb;``), so no text can
hold a marker, and all are undone exactly in reverse order. Every assistant turn is exploded into an example of its own: the text up to that turn's end,
of which only the reply itself is under the loss mask. A conversation that does not end with an assistant
turn has a last example without loss, so the output keeps every turn.

``formatted`` holds a conversation's text once and each example as its end and its mask, which grows with the
conversation and not with its square, for storage; ``examples`` explodes them, each with its own text. ``read_back``
reads the examples alone: each reply from its own example's text by its mask, the turns from the conversation's last example.

Defined results: rows of a conversation are ordered by turn (null first), then role, then text; repeated rows are turns
each; null roles and texts are empty; the null conversation is one like others; an empty table gives no rows; other
columns are ignored. Turns are told where they end by a running sum, so a long conversation or text costs in proportion; its
examples hold every prefix. Positions count code points from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, STOP = "[[", "]]\n", "[[/]]\n"
TARGET = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("["), F.lit("&lb;"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("]"), F.lit("&rb;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lb;"), F.lit("[")), F.lit("&amp;"), F.lit("&"))


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, text, examples (array of end, loss_start, loss_chars)."""
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), clean(role_col).alias("role"), clean(text_col).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    piece = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(CLOSE), escape(F.col("text")), F.lit(STOP))
    placed = rows.select("conv_id", (F.col("role") == TARGET).alias("target"), F.length(escape(F.col("text"))).cast("long").alias("body"), piece.alias("piece"), F.sum(F.length(piece)).over(order).alias("stop"))
    convs = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("stop", "body", "target", "piece"))).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: t["piece"]), "")
    mask = lambda t, n: F.struct(t["stop"].alias("end"), (t["stop"] - len(STOP) - t["body"] + 1).alias("loss_start"), n.alias("loss_chars"))
    asked = F.transform(F.filter("turns", lambda t: t["target"]), lambda t: mask(t, t["body"]))
    last = F.element_at("turns", -1)
    tail = F.when(last["target"], F.array().cast("array<struct<end:bigint,loss_start:bigint,loss_chars:bigint>>")).otherwise(F.array(mask(last, F.lit(0).cast("long"))))
    return convs.select("conv_id", whole.alias("text"), F.concat(asked, tail).alias("examples"))


def examples(turns: DataFrame, **columns: str) -> DataFrame:
    """One row per example: conv_id, example (from 0), text, loss_start, loss_chars, last (whether it is the conversation's longest)."""
    each = formatted(turns, **columns).select("conv_id", "text", F.size("examples").alias("n"), F.posexplode("examples").alias("example", "x"))
    return each.select("conv_id", "example", F.substring("text", F.lit(1), F.col("x.end").cast("int")).alias("text"), "x.loss_start", "x.loss_chars", (F.col("example") == F.col("n") - 1).alias("last"))


def read_back(made: DataFrame) -> DataFrame:
    """What examples say: conv_id, turns (array of role, text, unescaped), losses (array of texts in order), formatted_chars (of all examples)."""
    reply = F.when(F.col("loss_chars") > 0, unescape(F.substr("text", F.col("loss_start").cast("int"), F.col("loss_chars").cast("int"))))
    each = made.select("conv_id", F.when(F.col("last"), F.col("text")).alias("whole"), F.struct("example", reply.alias("reply")).alias("loss"), F.length("text").cast("long").alias("chars"))
    convs = each.groupBy("conv_id").agg(F.collect_list("whole")[0].alias("whole"), F.sort_array(F.collect_list("loss")).alias("losses"), F.sum("chars").alias("formatted_chars"))
    cut = F.split("whole", r"\[\[/\]\]\n")
    head = lambda t: F.substring_index(t, CLOSE, 1)
    parts = F.transform(
        F.slice(cut, F.lit(1), F.size(cut) - 1),
        lambda t: F.struct(
            unescape(F.replace(F.substr(head(t), F.lit(len(OPEN) + 1)), F.lit("&rb;"), F.lit("]"))).alias("role"),
            unescape(F.substr(t, F.length(head(t)) + len(CLOSE) + 1)).alias("text"),
        ),
    )
    return convs.select("conv_id", parts.alias("turns"), F.array_compact(F.transform("losses", lambda x: x["reply"])).alias("losses"), "formatted_chars")

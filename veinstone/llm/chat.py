"""Chat formatting by event sourcing, in DataFrame functions alone.

A conversation's log is partitioned by its id and folded in order of sequence: a message or an edit sets a turn's text,
a regeneration empties it, a delta adds to it. The final messages are rendered with marked turns; a backslash or an
angle bracket inside a text is escaped, so that no text can forge a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"
# What each control character becomes; the backslash goes first in escaping and last in reading back.
ESCAPES = [("\\", "\\b"), ("<", "\\l"), (">", "\\g")]


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def events(messages: DataFrame) -> DataFrame:
    """The log (conv_id, seq, kind, turn, role, text) of messages (conv_id, turn, role, text).

    Each row is the message of a turn of its own, repeated rows too. Turns are numbered anew in order of turn, role and text.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", text("role"), text("text"))).cast("long")
    return messages.select("conv_id", place.alias("seq"), F.lit("message").alias("kind"), place.alias("turn"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of events (conv_id, seq, kind, turn, role, text).

    kind: message, edit, regenerate or delta. Events before a turn's last message, edit or regeneration are void, but a
    turn's role is the last that any of its events names. A null seq stands behind every number; within one seq deltas
    come last, and of several messages, edits or regenerations the greatest kind and text counts. A null text adds
    nothing; a regeneration's own text is ignored.
    """
    sets = F.col("kind").isin("message", "edit", "regenerate")
    delta = ~F.coalesce(sets, F.lit(False))
    text = F.when(F.col("kind") == "regenerate", "").otherwise(F.coalesce("text", F.lit("")))
    piece = F.struct(F.col("seq").isNull().alias("late"), "seq", delta.alias("delta"), "kind", text.alias("text"))
    named = F.when(F.col("role").isNotNull(), F.struct(F.col("seq").isNull().alias("late"), "seq", delta.alias("delta"), "role"))
    folded = events.groupBy("conv_id", "turn").agg(F.max(F.when(~delta, piece)).alias("base"), F.sort_array(F.collect_list(F.when(delta, piece))).alias("deltas"), F.max(named).alias("named"))
    live = F.filter("deltas", lambda d: F.col("base").isNull() | (d > F.col("base")))
    return folded.select("conv_id", "turn", F.col("named.role").alias("role"), F.concat(F.coalesce("base.text", F.lit("")), F.concat_ws("", F.transform(live, lambda d: d["text"]))).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans: of each assistant text in formatted begin and length by code point and by byte.

    Rows of one turn stand in order of role and text; null roles and texts are empty; a null conv_id is one
    conversation; repeated rows are turns of their own; an empty table gives no conversation. A conversation is one
    string, so all of its rows meet in one task.
    """
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">\n"))
    rows = rows.withColumns({"head": head, "body": escape(F.col("text"))}).withColumn("turn_text", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    begin = lambda size: F.sum(size("turn_text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size("turn_text") + size("head")
    rows = rows.withColumns({"at": F.row_number().over(order), "begin": begin(F.length), "byte": begin(F.octet_length)})
    spans = F.when(F.col("role") == "assistant", F.struct("begin", F.length("body").cast("long").alias("length"), "byte", F.octet_length("body").cast("long").alias("bytes")))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "turn_text"))).alias("t"), F.sort_array(F.collect_list(spans)).alias("loss_spans")).select("conv_id", F.concat_ws("", "t.turn_text").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns (role, text): the marks are split and the texts unescaped.

    A conversation without a mark has no turns; rows stay as they are, repeated ones too.
    """
    parts = F.transform(F.filter(F.split("formatted", END), lambda x: x != ""), lambda x: F.struct(unescape(F.substring_index(F.substring(x, 7, 2147483647), ">", 1)).alias("role"), unescape(F.regexp_replace(x, "(?s)^[^>]*>\n", "")).alias("text")))
    return formatted.withColumn("turns", parts)


def masked(formatted: DataFrame) -> DataFrame:
    """formatted with loss: the text under its loss spans, cut out of formatted by bytes and unescaped; empty without spans."""
    raw = formatted.withColumn("raw", F.col("formatted").cast("binary")).withColumn("formatted_bytes", F.octet_length("raw").cast("long"))
    cut = F.transform("loss_spans", lambda s: F.substr(F.col("raw"), (s["byte"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"))
    return raw.withColumn("loss", unescape(F.concat_ws("", cut))).drop("raw")


def digests(messages: DataFrame) -> DataFrame:
    """What is read back from each formatted conversation, as counts and digests; render states the odd cases."""
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return masked(read_back(render(messages))).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )

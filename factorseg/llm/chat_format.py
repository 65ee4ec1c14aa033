"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it as context, and its text as the only trainable span.
A turn is written as ``<turn ROLE>``, line end, TEXT, ``</turn>``, line end. In roles and texts ``&``, ``<`` and ``>`` are written
``&amp;``, ``&lt;`` and ``&gt;``, so no text can hold a control string and unescaping gives it back exactly.

A conversation that does not end with an assistant turn gets one more example of all its turns with an empty trainable
span, so the output holds every turn. Turns are gathered per conversation, which an example needs by its definition.

Defined results: null texts and roles are empty; turns are in order of their number (null first), then role, then text, so
ties and repeated rows have a fixed order and all count; a null conversation id is a conversation of its own; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE = "<turn ", "</turn>\n"


def escaped(text: Column) -> Column:
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for code, raw in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def examples(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_chars, whole): ``loss_start`` counts code points from 0; ``whole`` marks the
    example that holds all turns of the conversation."""
    clean = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                                             F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    segment = lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(">\n"), escaped(t["text"]), F.lit(CLOSE))
    written = grouped.select("conv_id", F.transform("turns", segment).alias("segments"),
                             F.transform("turns", lambda t: F.when(t["role"] == target_role, F.length(escaped(t["text"])))).alias("target"))
    last = F.size("segments") - 1
    each = written.select("conv_id", "segments", last.alias("last"), F.posexplode("target").alias("example", "loss"))
    each = each.filter(F.col("loss").isNotNull() | (F.col("example") == F.col("last")))
    text = F.array_join(F.slice("segments", 1, F.col("example") + 1), "")
    loss = F.coalesce("loss", F.lit(0))
    return each.select("conv_id", "example", text.alias("text"), loss.alias("loss_chars"),
                       (F.col("example") == F.col("last")).alias("whole")).select(
        "conv_id", "example", "text", (F.length("text") - len(CLOSE) - F.col("loss_chars")).alias("loss_start"), "loss_chars", "whole")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from the examples' texts alone."""
    parts = F.filter(F.split("text", CLOSE, -1), lambda s: s != "")
    role = lambda s: unescaped(F.regexp_extract(s, "^<turn ([^>]*)>\n", 1))
    said = lambda s: unescaped(F.regexp_extract(s, "(?s)^<turn [^>]*>\n(.*)$", 1))
    parsed = F.transform(parts, lambda s: F.concat(role(s), F.lit("\n"), said(s), F.lit("\n")))
    loss = unescaped(F.substring("text", F.col("loss_start") + 1, F.col("loss_chars")))
    rows = formatted.select(
        "conv_id", "example", F.when(F.col("whole"), F.size(parts)).alias("n"),
        F.when(F.col("whole"), F.sha2(F.array_join(parsed, "").cast("binary"), 256)).alias("sha"),
        loss.alias("loss"), F.length("text").cast("long").alias("chars"))
    out = rows.groupBy("conv_id").agg(
        F.max("n").cast("long").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("all"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("all").cast("long").alias("loss_chars"),
                      F.sha2(F.col("all").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")

"""Chat formatting with prefix-target expansion: every assistant turn is an example with all turns before it as context.

A formatted turn is `### role: text</turn>` and a line feed. In texts and roles the signs of the control strings are
replaced by codes that start with a backslash, so control strings never occur inside and every text comes back exactly.
Contexts are stored once: an example points to the range of its conversation's formatted text that is its context and to
the range of its reply, the only one that is trained on. Copying every prefix would take the square of a conversation's
length; `example_texts` does that for those who need the texts spelled out. Everything is a DataFrame function.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template, and the codes of its signs; the backslash's own comes first when writing and last when reading.
HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
CODES = [("\\", "\\s"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")]
TRAINED = "assistant"
#: Turns that are summed as one step when offsets are made, so a very long conversation is no single task.
STEP = 1024


def escaped(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c[0]), F.lit(c[1])), CODES, F.coalesce(text, F.lit("")))


def plain(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c[1]), F.lit(c[0])), reversed(CODES), text)


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place, turn, piece, start, reply_start, reply_end, trained for every row of conv_id, turn, role, text.

    Rows of a conversation are ordered by turn, then role and text (nulls first); place counts them from 0 in steps of
    turn numbers. start is where the piece begins in the conversation's formatted text, in code points; reply_start and
    reply_end are where its text stands. A null text or role is an empty one, a null conv_id is one conversation, equal
    rows stay as often as they are there. Empty tables give empty ones, further columns are ignored.
    """
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), escaped(F.col("role")).alias("r"), escaped(F.col("text")).alias("t"))
    rows = rows.select("conv_id", "turn", "role", "text", (F.col("role") == TRAINED).alias("trained"), F.floor(F.col("turn") / STEP).alias("step"),
                       F.length("r").alias("r"), F.concat(F.lit(HEAD), "r", F.lit(MIDDLE), "t", F.lit(TAIL)).alias("piece"))
    rows = rows.withColumn("chars", F.length("piece"))
    before = Window.partitionBy("conv_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = rows.groupBy("conv_id", "step").agg(F.sum("chars").alias("c"), F.count("*").alias("n")).select(
        F.col("conv_id").alias("_c"), F.col("step").alias("_s"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    rows = rows.join(steps, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("step").eqNullSafe(F.col("_s")))
    own = Window.partitionBy("conv_id", "step").orderBy("turn", "role", "text")
    rows = rows.withColumn("start", F.col("c0") + F.sum("chars").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("chars"))
    rows = rows.withColumn("place", F.col("n0") + F.row_number().over(own) - 1)
    reply = F.col("start") + len(HEAD) + F.col("r") + len(MIDDLE)
    return rows.select("conv_id", "place", "turn", "piece", "start", reply.alias("reply_start"),
                       (F.col("start") + F.col("chars") - len(TAIL)).alias("reply_end"), "trained")


def examples(turns: DataFrame) -> DataFrame:
    """One row for each assistant turn of formatted_turns(): its context is the text up to reply_start, loss is on the reply."""
    return turns.where("trained").select("conv_id", F.col("place").alias("example"), F.lit(0).cast("long").alias("context_start"),
                                         F.col("reply_start").alias("context_end"), F.col("reply_start").alias("loss_start"),
                                         F.col("reply_end").alias("loss_end"))


def conversation_texts(turns: DataFrame) -> DataFrame:
    """conv_id and formatted, the whole text of each conversation."""
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda x: x["piece"]), "").alias("formatted"))


def example_texts(turns: DataFrame, examples_: DataFrame) -> DataFrame:
    """conv_id, example, context and reply of every example, spelled out."""
    texts = conversation_texts(turns).withColumnRenamed("conv_id", "_c")
    met = examples_.join(texts, F.col("conv_id").eqNullSafe(F.col("_c")))
    return met.select("conv_id", "example", F.expr("substr(formatted, 1, context_end)").alias("context"),
                      plain(F.expr("substr(formatted, loss_start + 1, loss_end - loss_start)")).alias("reply"))


def digest(turns: DataFrame, examples_: DataFrame) -> DataFrame:
    """What a reader gets back: turns parsed from the formatted text, and the text under the loss ranges."""
    marks = examples_.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("loss_start", "loss_end"))).alias("marks")) \
        .withColumnRenamed("conv_id", "_c")
    whole = conversation_texts(turns).join(marks, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    pieces = F.filter(F.split("formatted", TAIL, -1), lambda p: p != "")
    role = lambda p: F.substring_index(F.substr(p, F.lit(len(HEAD) + 1)), ":", 1)  # noqa: E731  a role has no plain colon
    text = lambda p: F.substr(p, F.lit(len(HEAD) + len(MIDDLE) + 1) + F.length(role(p)))
    back = F.transform(pieces, lambda p: F.concat(plain(role(p)), F.lit("\n"), plain(text(p)), F.lit("\n")))
    loss = plain(F.array_join(F.transform(F.coalesce("marks", F.array().cast("array<struct<loss_start:bigint,loss_end:bigint>>")), lambda m: F.substr(
        F.col("formatted"), (m["loss_start"] + 1).cast("int"), (m["loss_end"] - m["loss_start"]).cast("int"))), ""))
    return whole.select("conv_id", pieces.alias("pieces"), F.array_join(back, "").alias("back"), loss.alias("loss"), "formatted").select(
        "conv_id", F.size("pieces").cast("long").alias("n_turns"), F.sha2(F.col("back").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))

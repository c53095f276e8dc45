"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, only its reply is
trainable. Turns that no assistant turn follows close the conversation in one more example without a
target, so that nothing of the conversation is lost. The template is

    <|im_start|>ROLE newline TEXT<|im_end|> newline

and control strings inside texts and roles are escaped: a backslash is doubled, and one is put between
``<`` and ``|``, so that ``<|`` stands only in marks. In roles a line end gets a backslash in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    """Every backslash of an escaped text belongs to the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: its turns in order, each as formatted text.

    ``_id`` and ``_none`` stand for conv_id in joins, so that a null one meets itself.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    rows = conversations.select(
        F.coalesce("conv_id", F.lit(0)).alias("_id"), F.col("conv_id").isNull().alias("_none"),
        F.coalesce("turn", F.lit(-(2**63))).alias("turn"), blank(F.col("role")).alias("role"), blank(F.col("text")).alias("text"),
    )
    one = rows.groupBy("_id", "_none").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    role = lambda t: F.replace(escaped(t["role"]), F.lit("\n"), F.lit("\\\n"))
    return one.select(
        "_id", "_none",
        F.transform("turns", lambda t: F.concat(F.lit(START), role(t), F.lit("\n"), escaped(t["text"]), F.lit(END + "\n"))).alias("shown"),
        F.transform("turns", lambda t: F.when(t["role"] == "assistant", F.length(escaped(t["text"])))).alias("replies"),
    )


def examples(conversations: DataFrame) -> DataFrame:
    """Training examples: conv_id, example, formatted, loss_start, loss_end, has_target, closing.

    ``example`` counts from 1 in order of the turns; the loss mask is the code points from loss_start
    (inclusive) to loss_end (exclusive) of ``formatted``, empty without a target; ``closing`` marks the
    example that holds the whole conversation. Turns are ordered by turn, a null one first, ties by role
    and text; repeated rows are turns of their own. Null roles and texts are empty, a null conv_id is a
    conversation like any other. Only the columns conv_id, turn, role and text are read.

    A conversation is one row, as an example is one string. The places of the replies meet it again in
    a join instead of a generator that carries it, so that examples are built and passed on one by one.
    """
    one = _conversations(conversations)
    places = F.filter(F.sequence(F.lit(1), F.size("replies")), lambda i: F.element_at("replies", i).isNotNull() | (i == F.size("replies")))
    rows = one.select("_id", "_none", F.posexplode(places).alias("nth", "last")).join(one, ["_id", "_none"])
    size = F.element_at("replies", F.col("last"))
    rows = rows.select(
        F.when(~F.col("_none"), F.col("_id")).alias("conv_id"),
        (F.col("nth") + 1).alias("example"),
        F.array_join(F.slice("shown", F.lit(1), F.col("last")), "").alias("formatted"),
        size.alias("size"),
        (F.col("last") == F.size("shown")).alias("closing"),
    )
    end = F.length("formatted") - len(END) - 1
    return rows.select(
        "conv_id", "example", "formatted",
        F.coalesce(end - F.col("size"), F.lit(0)).alias("loss_start"),
        F.when(F.col("size").isNotNull(), end).otherwise(0).alias("loss_end"),
        F.col("size").isNotNull().alias("has_target"), "closing",
    )


def trained_text(rows: DataFrame) -> Column:
    """What the loss mask of an example covers, unescaped."""
    return unescaped(F.substring(rows["formatted"], rows["loss_start"] + 1, rows["loss_end"] - rows["loss_start"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: an array of role and text."""
    parts = F.filter(F.split(formatted, r"(?<=<\|im_end\|>)\n(?=<\|im_start\|>|$)"), lambda p: p != "")
    role_end = r"(?s)^<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n(.*)<\|im_end\|>$"
    return F.transform(
        parts,
        lambda p: F.struct(
            unescaped(F.regexp_extract(p, role_end, 1)).alias("role"),
            unescaped(F.regexp_extract(p, role_end, 2)).alias("text"),
        ),
    )


def digests(rows: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from them.

    conv_id, n_turns, turns_sha256 (role, line end, text, line end for each turn), loss_chars,
    loss_sha256 (trained texts in order), formatted_chars.
    """
    whole = F.when(F.col("closing"), F.col("formatted"))
    parts = rows.select(
        "conv_id", "example", whole.alias("whole"), F.length("formatted").alias("size"), F.when(F.col("has_target"), trained_text(rows)).alias("trained")
    )
    one = parts.groupBy("conv_id").agg(
        F.max("whole").alias("whole"),
        F.array_sort(F.collect_list(F.struct("example", "trained"))).alias("replies"),
        F.sum("size").cast("long").alias("formatted_chars"),
    )
    one = one.select("*", read_turns(F.col("whole")).alias("turns"), F.array_join(F.transform("replies", lambda r: r["trained"]), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return one.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )

"""Chat formatting in Spark expressions only.

Turns of a conversation are collected as structs, sorted, cut into blocks of adjacent turns of one
role, and joined to one text:

    ### user: first text<+>second text of the same role</turn>
    ### assistant: answer</turn>

Inside roles and texts a backslash becomes ``\\\\``, ``<`` becomes ``\\l`` and ``#`` becomes ``\\h`` (in
roles also ``:`` becomes ``\\c``), so no control string can occur there and every turn can be read back.

Defined results: a null text or role is empty; turns sort by number (null first), then role, then
text, so ties and repeated rows have one order; a null conversation id is a conversation of its
own; an empty table gives no rows; other columns are ignored. A conversation is one value of the
result, so its turns meet in one row; the work there is linear, but for the list of loss spans,
which is copied once per masked text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, COLON, BREAK, END = "### ", ": ", "<+>", "</turn>\n"
SPANS = "array<struct<start:int,length:int>>"


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in (("\\", "\\\\"), ("<", "\\l"), ("#", "\\h"), *([(":", "\\c")] if role else [])):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """Invert ``escape``: what stands between pairs of backslashes holds single codes only."""

    def codes(part: Column) -> Column:
        for code, plain in (("\\l", "<"), ("\\h", "#"), ("\\c", ":")):
            part = F.replace(part, F.lit(code), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(text, "\\\\\\\\"), codes), "\\")


def format_conversations(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: id, ``n_turns``, ``formatted``, ``loss_spans``.

    ``loss_spans`` are (start from 1, length) in code points of ``formatted``, one for each text of ``loss_role``.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("_turn"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    count = F.size("_turns")
    starts = F.filter(
        F.sequence(F.lit(0), count - 1),
        lambda i: (i == 0) | (F.get("_turns", i)["role"] != F.get("_turns", i - 1)["role"]),
    )
    cut = grouped.withColumn("_starts", starts)
    blocks = F.transform(
        "_starts",
        lambda at, k: F.slice("_turns", at + 1, F.coalesce(F.get("_starts", k + 1), count) - at),
    )
    parts = F.flatten(
        F.transform(
            blocks,
            lambda block: F.transform(
                block,
                lambda x, j: F.struct(
                    F.when(j == 0, F.concat(F.lit(HEAD), escape(x["role"], role=True), F.lit(COLON)))
                    .otherwise(F.lit(BREAK))
                    .alias("before"),
                    escape(x["text"]).alias("body"),
                    F.when(j == F.size(block) - 1, F.lit(END)).otherwise(F.lit("")).alias("after"),
                    (x["role"] == loss_role).alias("learn"),
                ),
            ),
        )
    )
    laid = cut.withColumn("_parts", parts)
    nothing = F.struct(F.lit(1).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["before"])
        span = F.struct(start.alias("start"), F.length(p["body"]).alias("length"))
        return F.struct(
            (start + F.length(p["body"]) + F.length(p["after"])).alias("at"),
            F.when(p["learn"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    return laid.select(
        "conv_id",
        count.cast("long").alias("n_turns"),
        F.array_join(F.transform("_parts", lambda p: F.concat(p["before"], p["body"], p["after"])), "").alias("formatted"),
        F.aggregate("_parts", nothing, step, lambda s: s["spans"]).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The array<struct<role, text>> that ``format_conversations`` wrote into a text."""
    blocks = F.split(formatted, HEAD)

    def turns_of(block: Column) -> Column:
        name = F.substring_index(block, COLON, 1)
        body = F.substr(block, F.length(name) + len(COLON) + 1, F.length(block) - F.length(name) - len(COLON + END))
        return F.transform(
            F.split(body, "<\\+>"), lambda t: F.struct(unescape(name).alias("role"), unescape(t).alias("text"))
        )

    return F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), turns_of))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss spans, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"], s["length"]))), "")

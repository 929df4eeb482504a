"""Chat formatting with typed content parts, in DataFrame operations only.

A turn's content is an array of parts.  A visitor flattens them in order: an image, an audio clip or a
document becomes a placeholder, its reference and the number of tokens that it expands to are recorded; the
texts between two placeholders are joined and then escaped, so that no control string forms across parts.  The template marks turns with control strings; the same strings inside a text are escaped
by one backslash more between ``<`` and ``|``, which reading back removes, so any text survives.  The loss
mask holds the spans (code points) of the assistant's texts in the formatted string.

Defined results: a null text or role is empty; a part of an unknown or null type that has a text and no
reference is text, any other one the placeholder ``<|part|>``; the text of a part with a placeholder follows
it; turns are ordered by number (nulls first), then role and
text, so ties and repeated rows have one order; null conversation ids form one conversation; an empty
table gives an empty result; further columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
PART = "struct<type:string,text:string,ref:string,units:double>"


@dataclass(frozen=True)
class ChatParams:
    #: Tokens for a unit: an image tile, a second of audio, a page of a document.
    image_tokens: int = 256
    audio_tokens: int = 25
    document_tokens: int = 512
    loss_role: str = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def text_parts(text: Column) -> Column:
    """Content that is one text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))


def _visit(part: Column, params: ChatParams) -> Column:
    """One part: its placeholder (null for mere text), its text and its attachment."""
    kind = F.lower(F.coalesce(part["type"], F.lit("")))
    units = F.coalesce(part["units"], F.lit(1.0))
    rate = F.when(kind == "image", params.image_tokens).when(kind == "audio", params.audio_tokens).when(kind == "document", params.document_tokens).otherwise(0)
    known = kind.isin("image", "audio", "document")
    mere_text = (kind == "text") | (~known & part["text"].isNotNull() & part["ref"].isNull())
    put = F.when(mere_text, F.lit(None).cast("string")).when(known, F.concat(F.lit("<|"), kind, F.lit("|>"))).otherwise("<|part|>")
    return F.struct(put.alias("put"), F.coalesce(part["text"], F.lit("")).alias("text"), kind.alias("type"), part["ref"].alias("ref"), F.ceil(units * rate).cast("long").alias("n_tokens"))


def _body(parts: Column) -> Column:
    """The visited parts in one string; texts with nothing between them are escaped as one."""
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("run"))

    def step(s: Column, p: Column) -> Column:
        out = F.when(p["put"].isNull(), s["out"]).otherwise(F.concat(s["out"], escape(s["run"]), p["put"]))
        return F.struct(out.alias("out"), F.when(p["put"].isNull(), F.concat(s["run"], p["text"])).otherwise(p["text"]).alias("run"))

    return F.aggregate(parts, start, step, lambda s: F.concat(s["out"], escape(s["run"])))


def format_chats(turns: DataFrame, params: ChatParams = ChatParams(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "content") -> DataFrame:
    """One row per conversation: ``formatted``, ``loss_mask``, ``attachments`` and ``expanded_tokens``.

    ``content_col`` holds an array of parts (type, text, ref, units).
    """
    parts = F.transform(F.coalesce(F.col(content_col), F.array().cast(f"array<{PART}>")), lambda p: _visit(p, params))
    role = F.coalesce(F.col(role_col), F.lit(""))
    t = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), parts.alias("parts"))
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    t = t.select("conv", "turn", "role", "parts", head.alias("head"), _body(F.col("parts")).alias("body"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", unescape(F.col("body")), "body")
    size = F.length("head") + F.length("body") + len(END)
    t = t.select("*", F.row_number().over(order).alias("n"), F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    start = F.col("at") + F.length("head")
    each = F.struct(
        "n",
        F.concat("head", "body", F.lit(END)).alias("text"),
        F.when(F.col("role") == params.loss_role, F.struct(start.alias("start"), (start + F.length("body")).alias("end"))).alias("loss"),
        F.transform(F.filter("parts", lambda p: p["put"].isNotNull()), lambda p: F.struct(F.col("turn").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), p["n_tokens"].alias("n_tokens"))).alias("attachments"),
    )
    g = t.groupBy("conv").agg(F.array_sort(F.collect_list(each)).alias("turns"))
    attachments = F.flatten(F.transform("turns", lambda x: x["attachments"]))
    return g.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("turns", lambda x: x["text"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda x: x["loss"]), lambda x: x.isNotNull()).alias("loss_mask"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda s, a: s + a["n_tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted string; placeholders of other parts stay as they are."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: F.startswith(p, F.lit(START)))

    def turn(p: Column) -> Column:
        cut = F.instr(p, "\n")
        role = F.replace(F.substring(p, F.lit(len(START) + 1), cut - len(START) - 1), F.lit(NEWLINE), F.lit("\n"))
        return F.struct(unescape(role).alias("role"), unescape(F.substr(p, cut + 1)).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask, unescaped, one after the other."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")

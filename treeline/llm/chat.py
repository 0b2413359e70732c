"""Chat formatting with typed content parts.  DataFrame functions only.

A turn's content is an array of parts ``struct<type, text, ref, size>``.  A visitor over the array (one
``CASE`` per type inside ``transform``) turns it into text: text parts escaped, the others as ordered
placeholders ``<|image:1|>``.  Attachments keep their reference, their number in the conversation and the
tokens the placeholder stands for once a model expands it.

Template, per turn: ``<|turn|>`` role ``<|text|>`` content ``<|end|>`` and a line feed.  Inside roles and
texts, ``~`` becomes ``~0``, and the ``<`` or ``[`` that opens a control string becomes ``~1`` or ``~2``, so no
control string of this or another common template is left in them, and :func:`unescape` gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Openings of control strings (fixed values of public chat templates), after their first character.
ANGLE = r"\||/?s>|/?unk>|/?pad>|/?bos>|/?eos>|/?SYS>|start_of_turn>|end_of_turn>"
SQUARE = r"/?INST\]|/?AVAILABLE_TOOLS\]|/?TOOL_CALLS\]|/?TOOL_RESULTS\]"
PARTS = "array<struct<type:string,text:string,ref:string,size:bigint>>"
#: Tokens that one unit of ``size`` expands to: images count 14-pixel patches in pixels, audio in
#: milliseconds, documents in pages.  An attachment expands to one token at least.
IMAGE_PATCH, AUDIO_MS, PAGE_TOKENS = 14 * 14, 40, 256


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("~"), F.lit("~0"))
    out = F.regexp_replace(out, f"<({ANGLE})", "~1$1")
    return F.regexp_replace(out, rf"\[({SQUARE})", "~2$1")


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("~2"), F.lit("[")), F.lit("~1"), F.lit("<"))
    return F.replace(out, F.lit("~0"), F.lit("~"))


def text_parts(text: Column) -> Column:
    """Plain text as typed parts; null counts as empty."""
    part = F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("size"),
    )
    return F.array(part)


def expanded_tokens(part: Column) -> Column:
    """Tokens a placeholder stands for; 0 for text."""
    size = F.greatest(F.coalesce(part["size"], F.lit(0)), F.lit(0))
    units = (
        F.when(part["type"] == "image", F.ceil(size / IMAGE_PATCH))
        .when(part["type"] == "audio", F.ceil(size / AUDIO_MS))
        .when(part["type"] == "document", size * PAGE_TOKENS)
    )
    return F.when(part["type"] == "text", F.lit(0)).otherwise(F.greatest(F.coalesce(units, F.lit(1)), F.lit(1))).cast("bigint")


def is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) != "text"


def render_parts(parts: Column, before: Column) -> Column:
    """The visitor: content as text.  ``before`` attachments came earlier in the conversation.

    A part without type counts as text; one of an unknown type gets a placeholder of its type's name.
    """

    def visit(part: Column, i: Column) -> Column:
        number = before + F.size(F.filter(F.slice(parts, F.lit(1), i), is_attachment)) + 1
        mark = F.concat(F.lit("<|"), escape(part["type"]), F.lit(":"), number.cast("string"), F.lit("|>"))
        return F.when(is_attachment(part), mark).otherwise(escape(F.coalesce(part["text"], F.lit(""))))

    return F.array_join(F.transform(parts, visit), "")


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", trained: str = "assistant"
) -> DataFrame:
    """One row per conversation: formatted string, segments with loss flags, attachments, expanded tokens.

    ``turns`` has a row per turn with ``parts`` of type ``PARTS`` (see :func:`text_parts`).  Turns are ordered
    by turn number, then role, then content, so ties and repeated rows have one order and all stay.  A null
    role counts as empty, null parts as none, a null turn number comes first; rows with a null conversation
    id form one conversation.  ``segments`` holds the output cut at the loss mask's edges: their texts joined
    are ``formatted``.  One conversation is one row, and must fit in memory; partial lists are merged after
    the shuffle, and only the columns read here travel.
    """
    none = F.array().cast(PARTS)
    row = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(parts), none).alias("parts"),
    )
    grouped = turns.select(F.col(conv).alias("conv_id"), row.alias("row")).groupBy("conv_id")
    rows = grouped.agg(F.array_sort(F.collect_list("row")).alias("rows"))
    counts = F.transform("rows", lambda r: F.size(F.filter(r["parts"], is_attachment)))
    rows = rows.withColumn("has", F.exists("rows", lambda r: F.exists(r["parts"], is_attachment)))
    zero = F.transform("rows", lambda r: F.lit(0))
    earlier = F.transform("rows", lambda r, i: F.aggregate(F.slice(counts, F.lit(1), i), F.lit(0), lambda a, b: a + b))
    before = F.when(F.col("has"), earlier).otherwise(zero)
    rows = rows.withColumn("before", before)

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"), F.length(text).cast("bigint").alias("n_chars"))

    def render(r: Column, b: Column) -> Column:
        head = F.concat(F.lit(TURN), escape(r["role"]), F.lit(TEXT))
        return F.array(
            segment(head, F.lit(False)), segment(render_parts(r["parts"], b), r["role"] == trained),
            segment(F.lit(END + "\n"), F.lit(False)),
        )

    pairs = F.zip_with("rows", "before", lambda r, b: render(r, b))
    found = F.flatten(F.transform("rows", lambda r: F.filter(r["parts"], is_attachment)))
    attachments = F.transform(
        found,
        lambda p, i: F.struct(
            (i + 1).alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("n_tokens")
        ),
    )
    rows = rows.select("conv_id", F.flatten(pairs).alias("segments"), attachments.alias("attachments"))
    total = F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["n_tokens"])
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return rows.select("conv_id", formatted.alias("formatted"), "segments", "attachments", total.alias("expanded_tokens"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string, as ``array<struct<role, text>>``, unescaped."""
    bodies = F.filter(F.split(formatted, rf"\Q{TURN}\E"), lambda x, i: i > 0)

    def turn(x: Column) -> Column:
        at = F.locate(TEXT, x)
        role = F.substring(x, F.lit(1), at - 1)
        text = F.substring(x, at + len(TEXT), F.length(x) - at - len(TEXT) - len(END))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(bodies, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))

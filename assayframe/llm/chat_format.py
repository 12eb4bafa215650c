"""Chat formatting: typed content parts flattened into one string per conversation.

Each message is a list of parts ``struct<kind, text, ref, n_tokens>`` of kind text, image, audio or document. A
visitor (one DataFrame expression for each kind) turns a part into its placeholder, and the parts of a message
are joined in order. The template is::

    <turn ROLE>BODY</turn>\\n

``BODY`` and ``ROLE`` are escaped, so no ``<`` or ``>`` of a text survives in them and control strings in a text
stay text: ``\\`` becomes ``\\b``, ``<`` becomes ``\\l``, ``>`` becomes ``\\g``. Attachments are written as
``<image 3>`` (their number in the conversation, from 0), with a row in ``attachments`` that has the reference
and the tokens the placeholder stands for.

Defined cases: a null text, role or ref is empty; a null or unknown kind is text; null content has no part;
turns with equal numbers are ordered by role, then body; a null turn comes first; rows with null conv_id form
one conversation of their own; repeated rows are turns of their own; an empty table gives no row. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "array<struct<kind:string,text:string,ref:string,n_tokens:bigint>>"
MEDIA = ("image", "audio", "document")
#: characters taken for one token where a text's tokens are estimated
CHARS_PER_TOKEN = 4


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    """The inverse of escape: every backslash in an escaped text starts a pair, so the pairs can be replaced one kind at a time."""
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """The content of a message that is one text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("n_tokens"))).cast(PART)


def _visit(part: Column) -> Column:
    """A part as its text in the body; a medium's number is filled in once the whole conversation is known."""
    medium = part["kind"].isin(*MEDIA)
    return F.when(medium, F.concat(F.lit("<"), part["kind"], F.lit(" ?>"))).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def _tokens(part: Column) -> Column:
    known = F.coalesce(part["n_tokens"], F.lit(0))
    return F.when(part["kind"].isin(*MEDIA), known).otherwise(
        F.coalesce(part["n_tokens"], F.ceil(F.length(F.coalesce(part["text"], F.lit(""))) / CHARS_PER_TOKEN))
    )


def format_chats(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Columns conv_id, turn, role, content (PART) to one row per conversation.

    Returns conv_id, formatted, n_turns, turns (array of role, body and whether the turn is under the loss mask, as
    escaped), attachments (array of kind, ref, n_tokens, in order of their placeholders) and n_tokens.
    """
    content = F.coalesce(F.col("content"), F.array().cast(PART))
    rows = messages.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.array_join(F.transform(content, _visit), "").alias("body"),
            F.transform(F.filter(content, lambda p: p["kind"].isin(*MEDIA)), lambda p: F.struct(p["kind"].alias("kind"), F.coalesce(p["ref"], F.lit("")).alias("ref"), F.coalesce(p["n_tokens"], F.lit(0)).alias("n_tokens"))).alias("media"),
            F.aggregate(content, F.lit(0).cast("bigint"), lambda s, p: s + _tokens(p)).alias("n_tokens"),
        ).alias("m"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    chats = chats.select(
        "conv_id",
        F.array_join(F.transform("m", lambda m: F.concat(F.lit("<turn "), escape(m["role"]), F.lit(">"), m["body"], F.lit("</turn>\n"))), "").alias("raw"),
        F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["role"].isin(*loss_roles).alias("loss"))).alias("turns"),
        F.flatten(F.transform("m", lambda m: m["media"])).alias("attachments"),
        F.aggregate("m", F.lit(0).cast("bigint"), lambda s, m: s + m["n_tokens"]).alias("n_tokens"),
    )
    # number the placeholders: only they begin with "<" and a medium, for texts and roles have no "<" once escaped, and a header begins with "<turn"
    pieces = F.split("raw", rf"(?<={'|'.join(f'<{m}' for m in MEDIA)}) \?>")
    numbered = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(" "), (i - 1).cast("string"), F.lit(">"), p))), "")
    return chats.select(
        "conv_id",
        F.when(F.size("attachments") > 0, numbered).otherwise(F.col("raw")).alias("formatted"),
        F.size("turns").cast("bigint").alias("n_turns"),
        "turns",
        "attachments",
        "n_tokens",
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: array of role and text, unescaped, with placeholders as they stand.

    ``>`` occurs in the string only as the end of a tag, ``<`` only as its start, so the end tag cannot be met inside a
    text and the first ``>`` of a turn ends its header.
    """
    turns = F.filter(F.split(formatted, "</turn>\n"), lambda t: t != "")
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring_index(t, ">", 1).substr(F.lit(7), F.length(t))).alias("role"),
            unescape(t.substr(F.locate(">", t) + 1, F.length(t))).alias("text"),
        ),
    )

"""Chat formatting with typed content parts, in DataFrame operations only.

A turn is ``<|start|>role<|body|>content<|end|>``.  Content is a list of typed parts; a visitor for each type
flattens it: text is escaped and copied, attachments (image, audio, document) become ordered placeholders
``<|type:index:tokens|>``, while the reference and the expanded token count are recorded aside.

Control strings inside texts are escaped by a backslash after their first character
(``<|`` becomes ``<\\|``); backslashes already standing there are kept and one is added, so unescaping is exact.
Neighbouring texts are escaped as the one text they make, so no control string can be put together from several parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BODY, END = "<|start|>", "<|body|>", "<|end|>"
#: Strings that this and other common templates give a meaning to.
CONTROLS = r"(<|\[)(\\*)(\||/?s>|</?SYS>>|/?INST\])"
ESCAPED = r"(<|\[)\\(\\*)(\||/?s>|</?SYS>>|/?INST\])"
PLACEHOLDER = r"<\|(?:image|audio|document):[0-9]+:[0-9]+\|>"
PART = "struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, CONTROLS, r"$1$2\\$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPED, r"$1$2$3")


def _some(c: Column, least: int = 0) -> Column:
    return F.greatest(F.coalesce(c, F.lit(least)).cast("long"), F.lit(least).cast("long"))


#: For each attachment type, the tokens it expands to: image patches of 28 pixels, 25 audio frames a second, 512 tokens a page.
TOKENS: dict[str, Callable[[Column], Column]] = {
    "image": lambda p: F.greatest(F.ceil(_some(p["width"]) / 28) * F.ceil(_some(p["height"]) / 28), F.lit(1)).cast("long"),
    "audio": lambda p: F.greatest(F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * 25), F.lit(1)).cast("long"),
    "document": lambda p: _some(p["pages"], 1) * F.lit(512).cast("long"),
}


#: Stands for placeholders while texts are joined and escaped; where a text holds it, a mark is added, so it can't be taken for one.
MARK = "\ue000"


def is_attachment(p: Column) -> Column:
    return F.coalesce(p["type"].isin(*TOKENS), F.lit(False))


def expanded_tokens(p: Column) -> Column:
    """The tokens that an attachment expands to."""
    out = F.lit(None).cast("long")
    for kind, tokens in TOKENS.items():
        out = F.when(p["type"] == kind, tokens(p)).otherwise(out)
    return out


def flatten_parts(parts: Column) -> Column:
    """Visit the parts in order: ``struct<body, attachments: array<struct<index, type, ref, tokens>>>``.

    A part of an unknown or null type counts as text.  Null parts and null texts are empty.  Texts between two
    attachments are escaped together.
    """
    one = "array<struct<index:bigint,type:string,ref:string,tokens:bigint>>"
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))

    def visit(parts: Column, at: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            index = (F.array_position(at, i) - 1).cast("string")
            mark = F.concat(F.lit(MARK + "+"), p["type"], F.lit(":"), index, F.lit(":"), expanded_tokens(p).cast("string"), F.lit(MARK))
            return F.when(is_attachment(p), mark).otherwise(F.replace(F.coalesce(p["text"], F.lit("")), F.lit(MARK), F.lit(MARK + "-")))

        body = escape(F.array_join(F.transform(parts, piece), ""))
        placed = F.replace(F.regexp_replace(body, MARK + r"\+([a-z]+:[0-9]+:[0-9]+)" + MARK, r"<|$1|>"), F.lit(MARK + "-"), F.lit(MARK))

        def seen(i: Column, n: Column) -> Column:
            p = F.get(parts, i)
            return F.struct(n.cast("long").alias("index"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"))

        return F.struct(F.when(F.contains(body, F.lit(MARK)), placed).otherwise(body).alias("body"), F.transform(at, seen).cast(one).alias("attachments"))

    # Positions of the attachments are found once, not once for each part.
    bound = F.array(F.struct(parts.alias("parts"), F.filter(F.transform(parts, lambda p, i: F.when(is_attachment(p), i)), lambda i: i.isNotNull()).alias("at")))
    return F.get(F.transform(bound, lambda x: visit(x["parts"], x["at"])), F.lit(0))


def text_part(text: Column) -> Column:
    """The parts of a turn that is plain text."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("long").alias("pages"),
        )
    )


def format_conversations(turns: DataFrame, parts_col: str | None = None) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, attachments, n_attachment_tokens``.

    ``turns`` has conv_id, turn, role and text, or ``parts_col`` of type ``array<PART>``.  Turns are ordered by turn, then role, then
    content; null turn numbers come first.  Null roles and texts are empty; rows of a null conv_id form one
    conversation.  Repeated rows are repeated turns.  Extra columns don't matter.  An empty table gives no rows.
    """
    flat = flatten_parts(text_part(F.col("text")) if parts_col is None else F.col(f"`{parts_col}`"))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    one = turns.select(F.col("conv_id"), F.struct(F.col("turn").alias("turn"), escape(role).alias("role"), flat.alias("flat")).alias("t"))
    conv = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    text = F.array_join(F.transform("ts", lambda t: F.concat(F.lit(START), t["role"], F.lit(BODY), t["flat"]["body"], F.lit(END))), "")
    kinds = F.flatten(F.transform("ts", lambda t, i: F.transform(t["flat"]["attachments"], lambda a: F.struct(i.cast("long").alias("turn_index"), a["index"].alias("index"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return conv.select("conv_id", text.alias("formatted"), kinds.alias("attachments")).select("*", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("n_attachment_tokens"))


def parse_formatted(formatted: Column) -> Column:
    """Read turns back: ``array<struct<role, text>>``, placeholders left out and the texts between them unescaped each."""
    turns = F.filter(F.split(formatted, r"<\|start\|>"), lambda t, i: i > 0)

    def read(t: Column) -> Column:
        at = F.instr(t, BODY)
        body = F.substring(t, at + len(BODY), F.greatest(F.length(t) - at - len(BODY) - len(END) + 1, F.lit(0)))
        text = F.array_join(F.transform(F.split(body, PLACEHOLDER), unescape), "")
        return F.struct(unescape(F.substring(t, F.lit(1), at - 1)).alias("role"), text.alias("text"))

    return F.transform(turns, read)


def loss_text(turns: Column) -> Column:
    """All text under the loss mask: every assistant text once, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")

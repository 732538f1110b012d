"""Chat formatting of typed content parts.  Native: DataFrame operations only.

A turn's content is an ordered list of parts: text, or an image, audio or
document attachment.  A visitor flattens each part: text is escaped, an
attachment becomes a placeholder with its number in the conversation, and its
reference and expanded token count are recorded.  Turns are laid out as

    <|turn|>ROLE<|body|>CONTENT<|end|>LF

Every control string holds ``<`` or ``[``.  Inside roles and texts these and the
backslash are escaped, ``\\0`` for a backslash, ``\\1`` for ``<``, ``\\2`` for
``[``, so no text can form a control string, of this template or of others, and
the format reads back to the same turns.

The loss mask is a list of (start, length) spans of code points: the contents of
the turns whose role is in ``loss_roles``, without placeholders.

Null roles and texts count as empty, null parts are skipped; an unknown kind of
part raises an error.  Turns are in order of turn (null first), ties by role and
content.  Each row without a conv_id is a conversation of its own, so such rows
are never gathered.  A conversation is one row by nature: it must fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_if_null, ship

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
#: A part: kind is text, image, audio or document; ref, width and the like belong to attachments.
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens that an attachment expands to: image patches of 14 pixels, audio at 25 a second, 1,024 a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 1024


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\0")), F.lit("<"), F.lit("\\1")), F.lit("["), F.lit("\\2"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\2"), F.lit("[")), F.lit("\\1"), F.lit("<")), F.lit("\\0"), F.lit("\\"))


def text_parts(text: str = "text") -> Column:
    """A plain text as a list of one part."""
    rest = [F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("kind"), blank_if_null(text).alias("text"), *rest))


def _expanded(p: Column) -> Column:
    """Tokens of a part that is no text."""
    patches = F.ceil(F.coalesce(p["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(p["height"], F.lit(0)) / PATCH)
    sound = F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE)
    return (
        F.when(p["kind"] == "image", patches).when(p["kind"] == "audio", sound)
        .when(p["kind"] == "document", F.coalesce(p["pages"], F.lit(1)).cast("bigint") * PAGE_TOKENS)
        .otherwise(F.raise_error(F.concat(F.lit("unknown kind of part: "), F.coalesce(p["kind"], F.lit("null"))))).cast("bigint")
    )


def format_chat(turns: DataFrame, loss_roles: tuple = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans, attachments (number, kind, ref, n_tokens) of each conversation.

    turns: conv_id, turn, role, parts (a list of ``PART``).
    """
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    told = turns.select("conv_id", alone.alias("alone"), F.struct("turn", blank_if_null("role").alias("role"), F.filter("parts", lambda p: p.isNotNull()).alias("parts")).alias("t"))
    convs = told.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # One element a part, in order, between the frames of the turns.
    opening = lambda t: F.struct(F.lit("frame").alias("kind"), F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY)).alias("out"), F.lit(False).alias("loss"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("n"))
    closing = F.struct(F.lit("frame").alias("kind"), F.lit(END).alias("out"), F.lit(False).alias("loss"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("n"))

    def visit(t: Column, p: Column) -> Column:
        is_text = F.coalesce(p["kind"] == "text", F.lit(False))
        return F.struct(
            p["kind"].alias("kind"), F.when(is_text, escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.lit("")).alias("out"),
            (is_text & t["role"].isin(*loss_roles)).alias("loss"), p["ref"].alias("ref"), F.when(is_text, F.lit(0).cast("bigint")).otherwise(_expanded(p)).alias("n"),
        )

    flat = F.flatten(F.transform("turns", lambda t: F.concat(F.array(opening(t)), F.coalesce(F.transform(t["parts"], lambda p: visit(t, p)), F.array().cast("array<struct<kind:string,out:string,loss:boolean,ref:string,n:bigint>>")), F.array(closing))))
    convs = convs.select("conv_id", flat.alias("flat"))
    attached = F.filter("flat", lambda x: ~x["kind"].isin("text", "frame"))
    attachments = F.transform(attached, lambda x, i: F.struct(i.cast("bigint").alias("number"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["n"].alias("n_tokens")))
    # A walk in order numbers the attachments and finds where each part starts.
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("number"), F.array().cast("array<string>").alias("out"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        placeholder = F.concat(F.lit("<|"), x["kind"], F.lit("|"), acc["number"].cast("string"), F.lit("|>"))
        is_attachment = ~x["kind"].isin("text", "frame")
        out = F.when(is_attachment, placeholder).otherwise(x["out"])
        size = F.length(out).cast("bigint")
        span = F.array(F.struct(acc["at"].alias("start"), size.alias("length")))
        return F.struct((acc["at"] + size).alias("at"), (acc["number"] + is_attachment.cast("bigint")).alias("number"), F.concat(acc["out"], F.array(out)).alias("out"), F.when(x["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    walked = convs.select("conv_id", F.aggregate("flat", start, step).alias("w"), attachments.alias("attachments"))
    return walked.select("conv_id", F.array_join("w.out", "").alias("formatted"), F.col("w.spans").alias("loss_spans"), "attachments")


def read_back(formatted: Column) -> Column:
    """The turns, array of (role, content), of a formatted conversation; placeholders stay in the content."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(p, BODY, 1)).alias("role"),
        unescape(_between(p)).alias("content"),
    ))


def _between(p: Column) -> Column:
    """What stands after the body mark and before the end mark."""
    body = F.substring_index(p, BODY, -1)
    return F.substring_index(body, END, 1)


def _cut(text: Column, size: int) -> Column:
    """The text in blocks of ``size`` code points."""
    last = ((F.greatest(F.length(text), F.lit(1)) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def loss_text(formatted: Column, spans: Column, block: int = 1024, wide: int = 64) -> Column:
    """All text under the mask, unescaped.

    A position in a text is found by walking to it; so the text is cut into wide
    blocks, these into small ones, and a span is read from the few that it touches.
    """
    small = F.flatten(F.transform(_cut(formatted, block * wide), lambda b: _cut(b, block)))

    def read(blocks: Column, s: Column) -> Column:
        first, last = (s["start"] / block).cast("int"), ((s["start"] + F.greatest(s["length"], F.lit(1)) - 1) / block).cast("int")
        near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
        return unescape(F.substring(near, (s["start"] - first * block + 1).cast("int"), s["length"].cast("int")))

    # The blocks are bound once by the outer transform.
    return F.element_at(F.transform(F.array(small), lambda blocks: F.array_join(F.transform(spans, lambda s: read(blocks, s)), "")), 1)


def digest(chats: DataFrame) -> DataFrame:
    """The columns of the standard query, read back from the formatted text."""
    turns = read_back(F.col("formatted"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return chats.select("conv_id", "formatted", turns.alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ship(__name__)

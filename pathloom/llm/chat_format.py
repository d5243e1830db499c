"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a list of typed parts.  ``flatten_parts`` visits them in order: text parts are
escaped and kept, image, audio and document parts become placeholders (``<|image|>`` ...), repeated
once for each token the attachment expands to, and are recorded as attachment references.

Template of a turn: ``<|im_start|>ROLE\\nCONTENT<|im_end|>\\n``.  Inside roles and texts ``&`` is
written ``&amp;`` and ``<|`` is written ``&lt;|`` (in roles a line feed is ``&#10;`` too).  A ``|`` that
begins a part after the first is written ``&#124;``, so that it can't meet a ``<`` before it.  So neither
a text nor a row of texts can forge control strings, and ``read_parts`` gives texts and placeholders back
exactly, adjacent texts as one.

The loss mask is a list of spans (turn, start, length) in characters of the turn's block, so that
reading a mask takes time in proportion to the conversation, however long.

Null conv_id: one conversation of its own.  Null role or text: empty.  Parts of unknown type (or none)
have no placeholder and are recorded apart; null parts are nothing.  An empty table gives no
rows; other columns don't matter, whatever their names.  Turns stand by turn (null
first), then role, then text, so ties and repeated rows have a fixed order and are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("image", "audio", "document")
PART = "struct<type:string,text:string,ref:string,tokens:int>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&#124;"), F.lit("|")), F.lit("&amp;"), F.lit("&"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("&#10;"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&#10;"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """The content (a list of parts) of a plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens"))).cast(f"array<{PART}>")


def flatten_parts(parts: Column) -> Column:
    """The content string: parts in order, texts escaped, attachments as placeholders, one for each of their tokens (at least one).

    Null lists: nothing; parts of unknown type: no placeholder.
    """

    def visit(p: Column, at: Column) -> Column:
        holder = F.concat(F.lit("<|"), p["type"], F.lit("|>"))
        text = escape(p["text"])
        text = F.when((at > 0) & text.startswith("|"), F.concat(F.lit("&#124;"), F.substring(text, F.lit(2), F.char_length(text)))).otherwise(text)
        return (
            F.when(p["type"] == "text", F.coalesce(text, F.lit("")))
            .when(p["type"].isin(*KINDS), F.repeat(holder, expanded(p)))
            .otherwise(F.lit(""))
        )

    return F.coalesce(F.array_join(F.transform(parts, visit), ""), F.lit(""))


def expanded(p: Column) -> Column:
    """The number of tokens that an attachment's placeholder takes: its own, one at least."""
    return F.greatest(F.coalesce(p["tokens"], F.lit(1)), F.lit(1))


def attachments(parts: Column) -> Column:
    """The attachment parts in order: type, ref and expanded tokens."""
    kept = F.filter(parts, lambda p: p["type"].isin(*KINDS))
    return F.coalesce(F.transform(kept, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), expanded(p).alias("tokens"))), F.array().cast("array<struct<type:string,ref:string,tokens:int>>"))


def unknown_parts(parts: Column) -> Column:
    """The parts in order, as they are, that are neither text nor an attachment of known kind; null parts are none."""
    return F.coalesce(F.filter(parts, lambda p: p.isNotNull() & ~F.coalesce(p["type"].isin("text", *KINDS), F.lit(False))), F.array().cast(f"array<{PART}>"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "content", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments and unknown (parts of unknown type), with their turns."""
    role_c, body = F.coalesce(F.col(role), F.lit("")), flatten_parts(F.col(parts))
    head = F.concat(F.lit(START), escape_role(role_c), F.lit("\n"))
    block = F.concat(head, body, F.lit(END + "\n"))
    rows = turns.select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), role_c.alias("_role"), block.alias("_block"), F.char_length(head).alias("_start"), F.char_length(body).alias("_length"), attachments(F.col(parts)).alias("_files"), unknown_parts(F.col(parts)).alias("_odd")
    )
    order = Window.partitionBy("_conv").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_block")
    rows = rows.withColumn("_n", F.row_number().over(order))
    one = F.struct("_n", "_role", "_block", "_start", "_length", "_files", "_odd")
    sorted_ = rows.groupBy("_conv").agg(F.array_sort(F.collect_list(one)).alias("_t"))
    t = F.col("_t")
    return sorted_.select(
        F.col("_conv").alias("conv_id"),
        F.array_join(t["_block"], "").alias("formatted"),
        F.transform(F.filter(t, lambda x: x["_role"].isin(*loss_roles)), lambda x: F.struct((x["_n"] - 1).alias("turn"), x["_start"].alias("start"), x["_length"].alias("length"))).alias("loss_spans"),
        F.flatten(F.transform(t, lambda x: F.transform(x["_files"], lambda a: F.struct((x["_n"] - 1).alias("turn"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        F.flatten(F.transform(t, lambda x: F.transform(x["_odd"], lambda a: F.struct((x["_n"] - 1).alias("turn"), a["type"].alias("type"), a["text"].alias("text"), a["ref"].alias("ref"))))).alias("unknown"),
    )


def blocks(formatted: Column) -> Column:
    """The turns' blocks of a formatted conversation, without the leading control string."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    return F.slice(parts, F.lit(2), F.size(parts) - F.lit(1))


def read_turns(blocks_: Column) -> Column:
    """The turns (role, text with placeholders as they stand) of a formatted conversation's blocks."""

    def one(b: Column) -> Column:
        at = F.instr(b, "\n")
        text = F.substring(b, at + F.lit(1), F.char_length(b) - at - F.lit(len(END) + 1))
        return F.struct(unescape_role(F.substring(b, F.lit(1), at - F.lit(1))).alias("role"), unescape(text).alias("text"))

    return F.transform(blocks_, one)


def read_parts(block: Column) -> Column:
    """The content of one block as parts: type and, for texts, text; adjacent texts are one, empty ones are left out.

    In a block ``<|`` stands only where a placeholder or the final control string begins.
    """
    at = F.instr(block, "\n")
    content = F.substring(block, at + F.lit(1), F.char_length(block) - at - F.lit(len(END) + 1))
    pieces = F.split(content, r"<\|", -1)

    def part(kind: Column, text: Column) -> Column:
        return F.struct(kind.alias("type"), text.alias("text"))

    def piece(x: Column, k: Column) -> Column:
        kind = F.substring_index(x, "|>", 1)
        rest = F.when(k == 0, x).otherwise(F.substring(x, F.char_length(kind) + F.lit(3), F.char_length(x)))
        text = F.when(rest != "", F.array(part(F.lit("text"), unescape(rest)))).otherwise(F.array().cast("array<struct<type:string,text:string>>"))
        return F.when(k == 0, text).otherwise(F.concat(F.array(part(kind, F.lit(None).cast("string"))), text))

    return F.flatten(F.transform(pieces, piece))


def read_loss(blocks_: Column, loss_spans: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(F.substring(F.element_at(blocks_, s["turn"] + F.lit(1)), s["start"] - F.lit(len(START) - 1), s["length"]))), "")


def chat_digest(conversations: DataFrame) -> DataFrame:
    """The query's columns, read back from the formatted conversations."""
    turns = conversations.select("conv_id", "turn", "role", text_part(F.col("text")).alias("content"))
    done = format_chats(turns).withColumn("_blocks", blocks(F.col("formatted")))
    done = done.withColumn("_back", read_turns(F.col("_blocks"))).withColumn("_loss", read_loss(F.col("_blocks"), F.col("loss_spans")))
    return done.select(
        "conv_id",
        F.size("_back").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(F.transform("_back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), "utf-8"), 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode(F.col("_loss"), "utf-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )

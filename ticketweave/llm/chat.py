"""Chat formatting: turns of typed parts become one marked string per conversation, with a loss mask and attachments.

Every turn is ``<|turn|>role<|text|>content<|end|>`` and a newline. A control string inside a role or text gets a backslash
after its first character, and a backslash is doubled, so a text never shows a mark and reads back exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketweave.llm.common import let

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Control strings of this and of common templates: none of them survives inside a text.
CONTROL = r"(<)(?=\||/?s>)|(\[)(?=/?INST\])"
#: Placeholder of each kind of attachment; a text part stands for itself.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
PART_TYPE = "array<struct<type:string,text:string,ref:string,tokens:long>>"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, CONTROL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def flatten_parts(parts: Column) -> Column:
    """struct<content, attachments, tokens> of an array of parts, in order.

    A visitor per type: text parts are escaped; an image, audio or document part becomes its placeholder once for each token
    it expands to (at least one) and an attachment (position among the parts, type, ref, tokens). Unknown types are kept as
    escaped text; null parts, texts and counts are empty.
    """
    parts = F.coalesce(parts, F.array().cast(PART_TYPE))
    known = F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv])
    times = lambda p: F.greatest(F.coalesce(p["tokens"], F.lit(1)), F.lit(1)).cast("int")

    def visit(p: Column) -> Column:
        return F.when(F.element_at(known, p["type"]).isNotNull(), F.repeat(F.element_at(known, p["type"]), times(p))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))

    placed = F.transform(parts, lambda p, i: F.struct(i.alias("position"), p["type"].alias("type"), p["ref"].alias("ref"), times(p).cast("long").alias("tokens")))
    attachments = F.filter(placed, lambda a: F.coalesce(F.element_at(known, a["type"]).isNotNull(), F.lit(False)))
    return F.struct(F.array_join(F.transform(parts, visit), "").alias("content"), attachments.alias("attachments"),
                    F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("tokens"))


def text_part(text: Column) -> Column:
    """A plain text as an array of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))


def format_conversations(
    rows: DataFrame, parts: Column, conv: str = "conv_id", turn: str = "turn", role: str = "role", trained: Sequence[str] = ("assistant",),
) -> DataFrame:
    """One row per conversation: conv_id, formatted (string), loss_spans (start, length in UTF-8 bytes of it), attachments, attachment_tokens.

    Turns follow ``turn``, null first, ties by role and content; repeated rows stay. A null role is empty. Spans cover the
    content of each turn by a ``trained`` role and nothing else. Offsets are running sums over the ordered rows, so a
    conversation with very many turns is summed row by row; only its finished string is put together in one place, as one
    value has to be.
    """
    flat = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), escape(F.coalesce(F.col(role), F.lit(""))).alias("role"), flatten_parts(parts).alias("flat"))
    head = F.concat(F.lit(TURN), F.col("role"), F.lit(BODY))
    flat = flat.withColumn("head_bytes", F.octet_length(head)).withColumn("piece", F.concat(head, F.col("flat.content"), F.lit(END)))
    earlier = Window.partitionBy("conv_id").orderBy("turn", "role", "piece").rowsBetween(Window.unboundedPreceding, -1)
    flat = flat.withColumn("start", F.coalesce(F.sum(F.octet_length("piece").cast("long")).over(earlier), F.lit(0)))
    span = F.when(F.col("role").isin(*trained), F.struct((F.col("start") + F.col("head_bytes")).alias("start"), F.octet_length("flat.content").cast("long").alias("length")))
    at = F.transform("flat.attachments", lambda a: F.struct(a["position"].alias("position"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))
    turns = flat.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("pieces"), F.sort_array(F.collect_list(span)).alias("loss_spans"),
        F.sort_array(F.collect_list(F.when(F.size("flat.attachments") > 0, F.struct("start", at.alias("items"))))).alias("items"), F.sum("flat.tokens").alias("attachment_tokens"))
    return turns.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss_spans",
                        F.flatten(F.transform("items", lambda i: i["items"])).alias("attachments"), "attachment_tokens")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted string."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 2_000_000_000)
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(p, BODY, 1)).alias("role"),
        unescape(F.regexp_extract(p, r"(?s)<\|text\|>(.*)<\|end\|>\n\z", 1)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, pieces joined by nothing."""
    return let(formatted.cast("binary"), lambda raw: F.array_join(F.transform(
        spans, lambda s: unescape(F.decode(F.substring(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8"))), ""))

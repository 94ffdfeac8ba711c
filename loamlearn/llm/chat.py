"""Chat formatting (DataFrame operations only).

A turn is written as ``### <role>: <text></turn>`` and a line feed. Typed parts are flattened by a
visitor in their order: text is escaped, an image, audio or document part becomes the placeholder
``<|kind:i|>``, i counting the conversation's attachments from 0, and is recorded with its reference
and expanded token count.

Escaping puts a backslash behind each backslash, behind each ``<`` before ``/``, ``|``, a backslash
or the end, and behind each ``#`` before ``#``, a backslash or the end. So no text holds ``</``,
``<|`` or ``##``, and removing the backslash behind each such character gives the text back.

Defined cases: a null text or role is empty; a null part kind is text; turns sort by turn, then
role, then text (nulls first); repeated rows are repeated turns; rows without conversation id form
one conversation with a null id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>\n"
_ESCAPE, _UNESCAPE = r"\\|<(?=[/|\\]|$)|#(?=[#\\]|$)", r"([\\<#])\\"
#: Turns that one first-level group joins; a conversation of any length is joined from such pieces.
CHUNK = 256
#: Tokens that an attachment stands for: an image by tiles, audio by seconds, a document by pages.
IMAGE_TILE, TOKENS_PER_TILE, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 512, 256, 50, 1024

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(c: Column) -> Column:
    # $ in Java also stands before a final line feed; \z does not
    return F.regexp_replace(c, F.lit(_ESCAPE.replace("$", r"\z")), F.lit("$0\\\\"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(_UNESCAPE), F.lit("$1"))


def _role(c: Column) -> Column:
    """A role may hold a colon; it is escaped too, so that the first ': ' ends the role. Every colon then has a backslash
    behind it, and ':n' is free to stand for a line feed."""
    return F.regexp_replace(F.regexp_replace(c, F.lit(_ESCAPE.replace("$", r"\z") + "|:"), F.lit("$0\\\\")), F.lit("\\n"), F.lit(":n"))


def _unrole(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, F.lit(":n"), F.lit("\n")), F.lit(r"([\\<#:])\\"), F.lit("$1"))


def expanded(part: Column) -> Column:
    tiles = F.ceil(F.coalesce(part["width"], F.lit(0)) / IMAGE_TILE) * F.ceil(F.coalesce(part["height"], F.lit(0)) / IMAGE_TILE)
    return F.when(part["kind"] == "image", F.greatest(F.lit(1), tiles) * TOKENS_PER_TILE).when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * TOKENS_PER_SECOND)).when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * TOKENS_PER_PAGE).otherwise(0).cast("long")


def format_chat(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str | None = "text", parts_col: str | None = None, trained_roles: tuple = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans, attachments, expanded_tokens: one row a conversation.

    loss_spans: (turn, start, end) of each text under the loss mask, code points within that turn's
    part of ``formatted``, end exclusive. attachments: (turn, index, kind, ref, tokens).
    """
    parts = F.col(parts_col) if parts_col else F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))
    turn = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(parts, F.array()).cast(PARTS).alias("parts"))
    # rows that agree in everything are pre-aggregated: one very common turn costs one entry a task
    piece = F.struct("turn", "role", "parts")
    per = turn.groupBy("conv_id", F.floor(F.col("turn") / CHUNK).alias("chunk"), piece.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct(F.col("t.turn").alias("turn"), F.col("t.role").alias("role"), F.col("t.parts").alias("parts"), "n"))).alias("ts"))
    per = per.withColumn("ts", F.flatten(F.transform("ts", lambda t: F.array_repeat(F.struct(t["role"].alias("role"), t["parts"].alias("parts")), t["n"].cast("int")))))
    media = lambda p: F.coalesce(p["kind"], F.lit("text")) != "text"
    per = per.withColumn("n_turns", F.size("ts")).withColumn("n_media", F.aggregate("ts", F.lit(0), lambda a, t: a + F.size(F.filter(t["parts"], media))))
    # pieces of a conversation, a few hundred turns each, meet here
    conv = per.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "ts"))).alias("c"))
    conv = conv.select("conv_id", F.flatten(F.transform("c", lambda c: c["ts"])).alias("ts"))
    seen = F.transform("ts", lambda t, i: F.filter(F.transform(t["parts"], lambda p, j: F.struct(i.alias("turn"), j.alias("at"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded(p).alias("tokens"))), lambda x: F.coalesce(x["kind"], F.lit("text")) != "text"))
    conv = conv.withColumn("attachments", F.transform(F.flatten(seen), lambda x, i: F.struct(x["turn"].alias("turn"), x["at"].alias("at"), i.alias("index"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens"))))
    conv = conv.withColumn("numbers", F.map_from_arrays(F.transform("attachments", lambda x: F.struct(x["turn"].alias("t"), x["at"].alias("a"))), F.transform("attachments", lambda x: x["index"])))

    def visit(p: Column, i: Column, j: Column) -> Column:
        return F.when(media(p), F.concat(F.lit("<|"), p["kind"], F.lit(":"), F.element_at("numbers", F.struct(i.alias("t"), j.alias("a"))).cast("string"), F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))

    flat = F.transform("ts", lambda t, i: F.struct(F.concat(F.lit(OPEN), _role(t["role"]), F.lit(": ")).alias("head"), F.concat_ws("", F.transform(t["parts"], lambda p, j: visit(p, i, j))).alias("body"), t["role"].isin(*trained_roles).alias("trained")))
    conv = conv.withColumn("flat", flat)
    spans = F.filter(F.transform("flat", lambda t, i: F.when(t["trained"], F.struct(i.alias("turn"), F.length(t["head"]).alias("start"), (F.length(t["head"]) + F.length(t["body"])).alias("end")))), lambda s: s.isNotNull())
    return conv.select("conv_id", F.concat_ws("", F.transform("flat", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE)))).alias("formatted"), spans.alias("loss_spans"), F.col("attachments"), F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"))


def read_back(chats: DataFrame) -> DataFrame:
    """Adds turns (role, text), from ``formatted`` alone, and loss_text, from ``formatted`` and ``loss_spans``."""
    cut = F.split("formatted", CLOSE)
    out = chats.withColumn("cut", F.slice(cut, F.lit(1), F.size(cut) - 1))
    at = lambda t: F.instr(t, ": ")
    out = out.withColumn("turns", F.transform("cut", lambda t: F.struct(_unrole(t.substr(F.lit(len(OPEN) + 1), at(t) - len(OPEN) - 1)).alias("role"), unescape(t.substr(at(t) + 2, F.length(t))).alias("text"))))
    masked = F.transform("loss_spans", lambda s: unescape(F.element_at("cut", s["turn"] + 1).substr(s["start"] + 1, s["end"] - s["start"])))
    return out.withColumn("loss_text", F.concat_ws("", masked)).drop("cut")

"""Chat formatting: typed content parts flattened into one training text per conversation, in column functions throughout.

A message has typed parts: text, image, audio, document. A visitor goes over them in order; text is escaped and kept, every other
part becomes a numbered placeholder, its reference is recorded as an attachment together with the number of tokens it expands to
(image tiles, audio frames, document pages). A turn is `<turn role="ROLE">` TEXT `</turn>` and a line end. Inside texts and roles
`&`, `<`, `>` and `"` are written as entities, so no text can imitate a mark, and reading back undoes exactly that. The loss mask is
the text between the marks of the turns of one role, by offset in its turn and in the whole.

One row per conversation is the operator's purpose; turns are numbered and measured as rows, and only the turns of one
conversation meet. Defined results: null texts are empty, null roles are an empty role; null parts and unknown kinds add nothing; turns
are ordered by turn, then role, then text, nulls first, so ties and repeated rows have one order; a null conversation id is a
conversation of its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import table
from storyloom.llm.registry import query

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]  # in the order of writing; reading undoes them backwards
TILE, FRAMES_PER_SECOND, TOKENS_PER_PAGE = 28, 25.0, 512
CLOSE = "</turn>\n"


def escaped(s: Column) -> Column:
    for plain, entity in ENTITIES:
        s = F.replace(s, F.lit(plain), F.lit(entity))
    return s


def unescaped(s: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        s = F.replace(s, F.lit(entity), F.lit(plain))
    return s


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part other than text stands for: tiles of an image, frames of a sound, pages of a document; one at least."""
    tiles = F.ceil(part["width"] / F.lit(TILE)) * F.ceil(part["height"] / F.lit(TILE))
    size = F.when(part["kind"] == "image", tiles).when(part["kind"] == "audio", F.ceil(part["seconds"] * FRAMES_PER_SECOND)).when(
        part["kind"] == "document", part["pages"] * TOKENS_PER_PAGE)
    return F.greatest(F.coalesce(size.cast("long"), F.lit(1).cast("long")), F.lit(1).cast("long"))


def flattened(parts: Column) -> tuple[Column, Column]:
    """(text, attachments) of a message: placeholders are numbered by the place of their part in the message."""
    known = F.filter(parts, lambda p: F.coalesce(p["kind"].isin("text", "image", "audio", "document"), F.lit(False)))
    shown = F.transform(known, lambda p, i: F.when(p["kind"] == "text", escaped(F.coalesce(p["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<"), p["kind"], F.lit(" "), i.cast("string"), F.lit("/>"))))
    placed = F.transform(known, lambda p, i: F.struct(i.alias("position"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    return F.array_join(shown, ""), F.filter(placed, lambda a: a["kind"] != "text")


def format_chats(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation of `messages(conv_id, turn, role, parts)`: conv_id, formatted, n_turns, loss (per masked turn: its
    number, start and length in the turn, start in the whole, in code points of the formatted text), attachments, tokens."""
    body, attachments = flattened(F.coalesce("parts", F.array().cast(PARTS)))
    head = F.concat(F.lit('<turn role="'), escaped(F.coalesce("role", F.lit(""))), F.lit('">'))
    turns = messages.select("conv_id", "turn", "role", head.alias("head"), body.alias("body"), attachments.alias("attachments"))
    written = turns.withColumn("piece", F.concat("head", "body", F.lit(CLOSE))).withColumn("size", F.length("piece").cast("long"))
    # rows of one turn and role stand in the order of their texts, not of what escaping makes of them
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), unescaped(F.col("body")), "piece")
    placed = written.select("conv_id", "head", "body", "piece", "size", "role", "attachments", (F.row_number().over(order) - 1).cast("long").alias("n"),
                            F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    mask = F.when(F.col("role") == loss_role, F.struct(
        F.col("n").alias("turn"), F.length("head").cast("long").alias("start"), F.length("body").cast("long").alias("length"), (F.col("at") + F.length("head")).alias("offset")))
    rows = placed.select("conv_id", F.struct("n", "piece", mask.alias("mask"), F.transform(
        "attachments", lambda a: F.struct(F.col("n").alias("turn"), a["position"].alias("position"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))).alias("attachments")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    joined = grouped.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda t: t["mask"]), lambda m: m.isNotNull()).alias("loss"),
        F.flatten(F.transform("t", lambda t: t["attachments"])).alias("attachments"))
    return joined.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def turns_read(formatted: Column) -> Column:
    """Array of (role, text, piece) read back from a formatted conversation; placeholders stay in the text as written."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")

    def read(p: Column) -> Column:
        return F.struct(unescaped(F.regexp_extract(p, '^<turn role="([^"]*+)">', 1)).alias("role"),
                        unescaped(F.regexp_replace(p, '^<turn role="[^"]*+">', "")).alias("text"), p.alias("piece"))

    return F.transform(pieces, read)


def text_parts(text: Column) -> Column:
    """A message that is text only, as parts."""
    blank = [F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *blank))


_TRAP = r"\### Assistant: </turn> ok"
_SIZE = " + ".join(["length(coalesce(text, ''))"] + [f"{len(e) - 1} * (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{p}', '')))" for p, e in ENTITIES])
SQL = f"""
WITH every AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_TRAP}' UNION ALL SELECT -7, 1, 'assistant', '{_TRAP}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(text, ''))) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN coalesce(text, '') ELSE '' END, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(text, '')), '')) AS loss_sha256,
  sum({_SIZE} + length('<turn role="') + length(coalesce(role, '')) + length('"></turn>') + 1)::BIGINT AS formatted_chars
FROM every GROUP BY conv_id"""


@query("op2_chat_format", SQL)
def op2_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_TRAP).alias("text"))
    every = rows.unionByName(extra).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))
    done = format_chats(every).withColumn("read", turns_read(F.col("formatted")))
    said = F.transform("loss", lambda m: unescaped(F.substring(F.get("read", m["turn"].cast("int"))["piece"], (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    plain = done.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
                        F.array_join(said, "").alias("said"), F.length("formatted").cast("long").alias("formatted_chars"))
    return plain.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("said").cast("long").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"), "formatted_chars")

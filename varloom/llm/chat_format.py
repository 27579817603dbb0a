"""Chat formatting by typed content parts (operator 2), with DataFrame functions alone.

A message is a row whose content is an array of typed parts. A visitor flattens the parts in
order: text is escaped, an image, audio or document part becomes a placeholder, its reference is
recorded, and the tokens that the placeholder stands for are counted. Messages of a conversation
are then laid into one string; the loss mask is kept as (start, length) spans of that string.

Template of a turn: ``<|turn|>role<|text|>content<|end|>``. Texts and roles are escaped: ``\\``
becomes ``\\\\``, and the first character of every control string becomes ``\\l`` (``<``) or
``\\b`` (``[``). No control string is then left inside a text, and unescape() gives it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.llm.common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings that no text may hold; ``<|`` stands for every mark and placeholder.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]")
#: Tokens that a part of each kind stands for: a fixed number, or a number for each unit of size.
TOKENS = {"image": (256, 0), "audio": (0, 25), "document": (16, 512)}
PART = "struct<type:string,text:string,ref:string,size:int>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(("\\l" if mark[0] == "<" else "\\b") + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    """Escapes are read from left to right, so a split at doubled backslashes falls between them."""
    one = lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), one), "\\")


def visit(parts: Column) -> tuple[Column, Column, Column]:
    """Content, attachments (ordinal, type, ref, tokens) and their tokens, of an array of parts.

    Parts of an unknown type, null parts and null texts add nothing; a null size is 0.
    """
    known = F.filter(parts, lambda p: p["type"].isin(*TOKENS))
    cost = lambda p: F.coalesce(*[F.when(p["type"] == k, F.lit(a) + F.lit(b) * F.coalesce(p["size"], F.lit(0))) for k, (a, b) in TOKENS.items()], F.lit(0)).cast("long")
    content = F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "text", escape(F.coalesce(p["text"], F.lit("")))).when(p["type"].isin(*TOKENS), F.concat(F.lit("<|"), p["type"], F.lit("|>"))).otherwise("")), "")
    refs = F.transform(known, lambda p, i: F.struct(i.alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"), cost(p).alias("tokens")))
    return F.coalesce(content, F.lit("")), F.coalesce(refs, F.array().cast("array<struct<ordinal:int,type:string,ref:string,tokens:bigint>>")), F.coalesce(F.aggregate(known, F.lit(0).cast("long"), lambda s, p: s + cost(p)), F.lit(0).cast("long"))


def format_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, loss_spans (start from 0, length; code
    points), attachments (numbered by the conversation's placeholders), attachment_tokens, n_chars.

    Turns are ordered by turn (null first), then role and content (unescaped); repeated rows stay. A null role
    or content is empty. A null conv_id is a conversation of its own. Other columns are ignored.
    Offsets come from a running sum over the rows, so a conversation of any length costs one sort.
    """
    content, refs, tokens = visit(F.col(parts))
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), content.alias("content"), refs.alias("refs"), tokens.alias("tokens"))
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)))
    rows = rows.withColumn("piece", F.concat("head", "content", F.lit(END))).withColumn("len", F.length("piece").cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", unescape(F.col("content")))
    rows = rows.withColumn("seq", F.row_number().over(order)).withColumn("at", F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("len"))
    span = F.struct(F.col("seq"), (F.col("at") + F.length("head")).alias("start"), F.length("content").cast("long").alias("length"))
    sort = lambda c: F.array_sort(F.collect_list(c))
    return rows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_join(F.transform(sort(F.struct("seq", "piece")), lambda x: x["piece"]), "").alias("formatted"),
        F.transform(sort(F.when(F.col("role") == loss_role, span)), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
        F.transform(F.flatten(F.transform(sort(F.struct("seq", "refs")), lambda x: x["refs"])), lambda a, i: F.struct(i.alias("ordinal"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))).alias("attachments"),
        F.sum("tokens").alias("attachment_tokens"),
        F.sum("len").alias("n_chars"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns as array<struct<role, text>>, read back from a formatted string of text parts."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda x, i: i > 0)
    halves = F.transform(pieces, lambda x: F.split(F.regexp_replace(x, r"<\|end\|>$", ""), r"<\|text\|>", 2))
    return F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text")))


def text_parts(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("size")))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of conversations and conversation -1; digests are read back from the formatted strings."""
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    chats = format_chats(rows.union(own).withColumn("parts", text_parts(F.col("text"))))
    turns = read_turns(F.col("formatted"))
    lost = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    out = chats.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"), lost.alias("lost"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), "formatted_chars")


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for mark in CONTROL:
        out = f"replace({out}, '{mark}', '\\{'l' if mark[0] == '<' else 'b'}{mark[1:]}')"
    return out


SQL = {
    "op2_chat_format": f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS lost,
  sum({len(TURN + TEXT + END)} + length({_sql_escape("role")}) + length({_sql_escape("text")}))::BIGINT AS formatted_chars
  FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(lost)::BIGINT AS loss_chars, sha256(lost) AS loss_sha256, formatted_chars FROM g"""
}
QUERIES = {"op2_chat_format": op2_chat_format}

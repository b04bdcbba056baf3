"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A turn becomes ``<|role|>``, a line feed, its text, ``</s>`` and a line feed. In roles and texts a backslash is doubled and
every control string gets one after its first character, so no control string is left and unescaping is exact. Every
assistant turn is an example of its own: all turns before it are the context, only its text is trainable.

A conversation is stored in blocks of ``BLOCK`` turn numbers, so its text is held once and a block is a bounded row.
``whole_examples`` puts every example together from all blocks before it, and op5 reads its figures back from those: the turns
from the last example and from what follows the last reply (``rests``, no part of which is trainable), the loss from all
examples, ``formatted_chars`` over all of this output. The examples' text grows with the square of a conversation's turns; it is
made row by row after the last shuffle of texts and not kept, so no task holds more than a few copies of one conversation.

Turns are ordered by turn, then role and text (ties and repeated rows stay); null turns come first, in a block of their own.
Null texts and roles are empty. Null conv_ids are one conversation. Very long texts are taken whole. Extra columns are ignored,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 16
#: The markers of this template, and strings that other templates give a meaning.
CONTROL = ("<|", "|>", "</s>", "[INST]", "[/INST]")
END = "</s>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_blocks(conversations: DataFrame) -> DataFrame:
    """``conv_id, block, n_turns, formatted, formatted_chars, replies``: a row for each block of a conversation.

    ``replies`` has ``turn, loss_start, loss_chars`` of each assistant turn: code points of ``formatted``, from 1 on.
    """
    turns = conversations.select(
        "conv_id",
        F.floor(F.col("turn") / BLOCK).alias("block"),
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    blocks = turns.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>\n"))
    parts = F.transform("turns", lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), head(t).alias("head"), escape(t["text"]).alias("body")))
    piece = lambda p: F.concat(p["head"], p["body"], F.lit(END))
    blocks = blocks.select("conv_id", "block", parts.alias("parts"))
    # characters before each turn: a running sum within the block
    starts = F.aggregate(
        "parts",
        F.array(F.lit(1)),
        lambda done, p: F.concat(done, F.array(F.element_at(done, -1) + F.char_length(piece(p)))),
    )
    blocks = blocks.select("conv_id", "block", "parts", F.array_join(F.transform("parts", piece), "").alias("formatted"), starts.alias("starts"))
    reply = lambda p, at: F.struct(p["turn"].alias("turn"), (at + F.char_length(p["head"])).alias("loss_start"), F.char_length(p["body"]).alias("loss_chars"), p["role"].alias("role"))
    replies = F.filter(F.zip_with("parts", F.slice("starts", 1, F.size("parts")), reply), lambda r: r["role"] == "assistant")
    return blocks.select(
        "conv_id",
        "block",
        F.size("parts").alias("n_turns"),
        "formatted",
        F.char_length("formatted").alias("formatted_chars"),
        F.transform(replies, lambda r: F.struct(r["turn"].alias("turn"), r["loss_start"].alias("loss_start"), r["loss_chars"].alias("loss_chars"))).alias("replies"),
    )


def in_order(blocks: DataFrame) -> DataFrame:
    """``conv_id, b``: each conversation's blocks in order."""
    return blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("block", F.lit(-1 << 62)).alias("block"), "formatted", "formatted_chars", "replies"))).alias("b"))


def whole_examples(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, loss_start, loss_chars, last, text`` from ``conv_id, b``: every example, with all turns before the reply.

    ``loss_start`` counts from the start of the conversation, from 1 on; ``last``: no later example has this one's turns.
    """
    with_last = conversations.withColumn("final", F.aggregate("b", F.lit(0), lambda n, x: n + F.size(x["replies"])))
    each = with_last.select("conv_id", "final", "b", F.posexplode("b").alias("at", "own")).where("size(own.replies) > 0")
    before = F.slice("b", F.lit(1), F.col("at"))
    each = each.select(
        "conv_id",
        "final",
        "own",
        F.array_join(F.transform(before, lambda x: x["formatted"]), "").alias("earlier"),
        F.aggregate(before, F.lit(0).cast("long"), lambda n, x: n + x["formatted_chars"]).alias("chars"),
        F.aggregate(before, F.lit(0), lambda n, x: n + F.size(x["replies"])).alias("done"),
    )
    each = each.select("conv_id", "final", "own.formatted", "earlier", "chars", "done", F.posexplode("own.replies").alias("i", "r"))
    return each.select(
        "conv_id",
        F.col("r.turn").alias("turn"),
        (F.col("chars") + F.col("r.loss_start")).alias("loss_start"),
        F.col("r.loss_chars").alias("loss_chars"),
        (F.col("done") + F.col("i") + 1 == F.col("final")).alias("last"),
        F.concat("earlier", F.substring("formatted", F.lit(1), F.col("r.loss_start") - 1 + F.col("r.loss_chars")), F.lit(END)).alias("text"),
    )


def rests(conversations: DataFrame) -> DataFrame:
    """``conv_id, text`` from ``conv_id, b``: what follows a conversation's last reply, all of it if there is none."""
    chars = F.aggregate(
        "b",
        F.struct(F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("end")),
        lambda s, x: F.struct(
            (s["chars"] + x["formatted_chars"]).alias("chars"),
            F.when(F.size(x["replies"]) > 0, s["chars"] + F.element_at(x["replies"], -1)["loss_start"] - 1 + F.element_at(x["replies"], -1)["loss_chars"] + len(END)).otherwise(s["end"]).alias("end"),
        ),
    )
    return conversations.select("conv_id", F.array_join(F.transform("b", lambda x: x["formatted"]), "").alias("all"), chars["end"].alias("end")).select("conv_id", F.substring("all", F.col("end").cast("int") + 1, F.char_length("all")).alias("text"))


def read_back(blocks: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns, loss, formatted_chars`` parsed from the output: ``turns`` is role, line feed, text, line feed
    for each turn of the last whole example and of what follows it, ``loss`` the text under the loss masks of all whole examples,
    ``formatted_chars`` the length of all examples and of what follows them."""
    conversations = in_order(blocks)
    part = lambda p, i: unescape(F.regexp_extract(p, r"(?s)^<\|(.*?)\|>\n(.*)$", i))
    pieces = F.slice(F.split("text", END, -1), 1, F.size(F.split("text", END, -1)) - 1)
    turns = F.array_join(F.transform(pieces, lambda p: F.concat(part(p, 1), F.lit("\n"), part(p, 2), F.lit("\n"))), "")
    read = whole_examples(conversations).select(
        "conv_id",
        F.struct(F.lit(0).alias("at"), F.when(F.col("last"), turns).alias("turns")).alias("t"),
        F.when(F.col("last"), F.size(pieces)).alias("n"),
        F.char_length("text").alias("chars"),
        F.struct("loss_start", F.substring("text", F.col("loss_start").cast("int"), F.col("loss_chars")).alias("reply")).alias("loss"),
    )
    after = rests(conversations).select(
        "conv_id",
        F.struct(F.lit(1).alias("at"), turns.alias("turns")).alias("t"),
        F.size(pieces).alias("n"),
        F.char_length("text").alias("chars"),
        F.struct(F.lit(1 << 62).alias("loss_start"), F.lit("").alias("reply")).alias("loss"),
    )
    both = read.unionByName(after).groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.array_sort(F.collect_list(F.when(F.col("t.turns").isNotNull(), F.col("t")))).alias("t"),
        F.array_sort(F.collect_list("loss")).alias("loss"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    return both.select(
        "conv_id",
        "n_turns",
        F.array_join(F.transform("t", lambda t: t["turns"]), "").alias("turns"),
        unescape(F.array_join(F.transform("loss", lambda x: x["reply"]), "")).alias("loss"),
        "formatted_chars",
    )


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(odd))
    return read_back(format_blocks(table.union(extra))).select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _sql_escape(x: str) -> str:
    x = f"replace({x}, chr(92), chr(92) || chr(92))"
    for c in CONTROL:
        x = f"replace({x}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return x


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, length('<|' || {_sql_escape("role")} || '|>' || chr(10) || {_sql_escape("text")} || '</s>' || chr(10)) AS chars FROM t
), c AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM n
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    coalesce(sum(upto) FILTER (WHERE role = 'assistant'), 0) + max(upto) - coalesce(max(upto) FILTER (WHERE role = 'assistant'), 0) AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""

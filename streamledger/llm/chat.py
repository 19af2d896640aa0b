"""Chat formatting with prefix-target expansion, in DataFrame functions only (operator 3).

A conversation is formatted turn by turn: `### role: text</turn>` and a line
break. Control strings inside roles and texts are escaped with backslashes, so a
text can hold any of the template's marks and still be read back exactly.

Every assistant turn becomes an example of its own: all preceding turns are its
context, and only its reply is trainable, between loss_start and loss_end of it.
Turns after the last reply train nothing; one more row without a reply holds them,
so that the rows of a conversation are the whole of it.

A conversation's turns are brought together once and exploded in place, so no
context is shuffled. A context is an array of the turns' texts. Written out, a
conversation of T turns and so many replies has text in proportion to T * T: that
is what the method asks for, and a conversation's length is all that it grows with.
A conversation is one row on the way, as its digest is one value of its whole text.

Order within a conversation is turn, then role, then text (nulls first), so rows
that repeat a turn keep a defined order; equal rows are each a turn. A null text
or role counts as empty; rows with a null conversation id form a conversation of
their own. Conversations without an assistant turn have one row without a reply.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamledger.llm.common import table

TRAINED = "assistant"


def escaped_role(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\|###|</turn>|:)", r"\\$1")


def escaped_text(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\|###|</turn>)", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#<:])", "$1")


def format_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv and turns, an array in order of (trained, head: characters before the text, formatted)."""
    held = lambda name: F.coalesce(F.col(name), F.lit(""))
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), held(role_col).alias("role"), held(text_col).alias("text"))
    head = F.concat(F.lit("### "), escaped_role(F.col("role")), F.lit(": "))
    formatted = F.concat(head, escaped_text(F.col("text")), F.lit("</turn>\n"))
    turn = F.struct("turn", "role", "text", F.length(head).alias("head"), formatted.alias("formatted"))
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return whole.select("conv", F.transform("turns", lambda t: F.struct((t["role"] == TRAINED).alias("trained"), t["head"].alias("head"), t["formatted"].alias("formatted"))).alias("turns"))


def expand(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn of formatted conversations: conv, target (its position, from 0), since (the position after the reply before it), context (array of all preceding turns), reply, loss_start and loss_end.

    Where turns follow the last reply, a row without a reply has all turns as its context.
    """
    turns, n = F.col("turns"), F.size("turns")
    replies = F.filter(F.transform(turns, lambda t, k: F.when(t["trained"], k)), lambda k: k.isNotNull())
    ends = F.concat("replies", F.when(F.coalesce(F.try_element_at("replies", F.lit(-1)), F.lit(-1)) < n - 1, F.array(n)).otherwise(F.array().cast("array<int>")))
    spans = F.transform(ends, lambda end, k: F.struct(F.when(k == 0, 0).otherwise(F.get("replies", k - 1) + 1).alias("since"), end.alias("target")))
    rows = conversations.select("conv", "turns", F.transform(turns, lambda t: t["formatted"]).alias("texts"), replies.alias("replies"))
    rows = rows.select("conv", "turns", "texts", spans.alias("spans")).select("conv", "turns", "texts", F.explode("spans").alias("at")).select("conv", F.col("at.target").alias("target"), F.col("at.since").alias("since"), "texts", F.get("turns", F.col("at.target")).alias("turn"))
    end = F.length("turn.formatted") - F.length(F.lit("</turn>\n"))
    return rows.select("conv", "target", "since", F.slice("texts", F.lit(1), F.col("target")).alias("context"), F.col("turn.formatted").alias("reply"), F.col("turn.head").alias("loss_start"), end.alias("loss_end"))


def written(examples: DataFrame) -> DataFrame:
    """Examples as texts: conv, target, text (context and reply), loss_start and loss_end within it."""
    before = F.array_join("context", "")
    rows = examples.select("conv", "target", before.alias("before"), F.coalesce("reply", F.lit("")).alias("reply"), "loss_start", "loss_end")
    return rows.select("conv", "target", F.concat("before", "reply").alias("text"), (F.length("before") + F.col("loss_start")).alias("loss_start"), (F.length("before") + F.col("loss_end")).alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """Conversations from examples alone: conv, turns (role and text of each, unescaped), trained (the unescaped text under the mask, in order) and chars, the length of all formatted turns.

    Each example gives the turns that no earlier one has: those since the reply before it.
    """
    own = F.slice("context", F.col("since") + 1, F.col("target") - F.col("since"))
    own = F.when(F.col("reply").isNull(), own).otherwise(F.concat(own, F.array("reply")))
    loss = F.expr("substring(reply, loss_start + 1, loss_end - loss_start)")
    rows = examples.select("conv", F.struct("target", own.alias("own"), loss.alias("loss")).alias("piece"))
    one = rows.groupBy("conv").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    one = one.select("conv", F.flatten(F.transform("pieces", lambda p: p["own"])).alias("texts"), F.filter(F.transform("pieces", lambda p: p["loss"]), lambda x: x.isNotNull()).alias("losses"))
    role = lambda p: unescaped(F.regexp_extract(p, r"(?s)\A### ((?:\\.|[^:\\])*+): ", 1))
    body = lambda p: unescaped(F.regexp_extract(p, r"(?s)\A### (?:\\.|[^:\\])*+: (.*)</turn>\n\z", 1))
    said = F.transform("texts", lambda p: F.struct(role(p).alias("role"), body(p).alias("text")))
    chars = F.aggregate("texts", F.lit(0).cast("bigint"), lambda n, p: n + F.length(p))
    return one.select("conv", said.alias("turns"), F.transform("losses", unescaped).alias("trained"), chars.alias("chars"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = read_back(expand(format_turns(rows)))
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", "trained")
    return out.select(F.col("conv").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars"))


OP3_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (SELECT *, length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + 14 AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

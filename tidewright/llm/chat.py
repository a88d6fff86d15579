"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

A turn is written as <s>[INST]role[/INST]text</s>. In roles and texts a backslash is doubled, and a control string gets
a backslash after its first character, so no control string stands inside a text and unescaping gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, HEAD, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: Control strings without their first character.
CONTROL_TAIL = r"(/?s>|/?INST\]|<SYS>>|</SYS>>|\|[a-z_]+\|>)"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"([<\[])" + CONTROL_TAIL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(HEAD), escape(text), F.lit(CLOSE))


def chat_examples(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """(conv_id, target, formatted, loss_start, loss_end): one example for each assistant turn, with all turns before it as context.

    target is the turn's place in its conversation, from 1. Only the code points loss_start (from 0) to loss_end
    (exclusive) of formatted are trainable: that turn's escaped text. Turns after the last assistant turn, or a
    conversation without one, make a last example with an empty span, so every turn is in some example.
    Turns are ordered by turn, then role, then text, so ties and repeated rows all stay, in a fixed order; null turns
    come first. Null role or text is empty. Rows without conv_id form one conversation. A row holds one example, and
    examples are made one at a time. Other columns are not read.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select("conv_id", F.struct("turn", text("role").alias("role"), text("text").alias("text")).alias("t"))
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    convs = convs.select(
        "conv_id",
        F.transform("turns", lambda t: render(t["role"], t["text"])).alias("rendered"),
        F.transform("turns", lambda t: t["role"] == target_role).alias("is_target"),
        F.transform("turns", lambda t: F.length(escape(t["text"]))).alias("chars"),
    )
    n = F.size("rendered")
    wanted = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("is_target", i) | (i == n))
    examples = convs.select("conv_id", "rendered", "is_target", "chars", F.explode(wanted).alias("target"))
    formatted = F.array_join(F.slice("rendered", F.lit(1), F.col("target")), "")
    examples = examples.select("conv_id", "target", formatted.alias("formatted"), F.element_at("is_target", F.col("target")).alias("is_target"), F.element_at("chars", F.col("target")).alias("chars"))
    end = F.length("formatted") - len(CLOSE)
    return examples.select("conv_id", "target", "formatted", F.when(F.col("is_target"), end - F.col("chars")).otherwise(0).alias("loss_start"), F.when(F.col("is_target"), end).otherwise(0).alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in an example."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    head = lambda p: F.locate(HEAD, p)
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring(p, F.lit(len(OPEN) + 1), head(p) - len(OPEN) - 1)).alias("role"),
        unescape(F.substring(p, head(p) + len(HEAD), F.length(p))).alias("text"),
    ))


def masked_text(formatted: Column, start: Column, end: Column) -> Column:
    return unescape(F.substring(formatted, start + 1, end - start))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], conversations.schema)
    examples = chat_examples(conversations.unionByName(extra))
    loss = F.struct("target", masked_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("text"))
    convs = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "target").alias("longest"), F.array_sort(F.collect_list(loss)).alias("loss"), F.sum(F.length("formatted")).alias("formatted_chars"))
    convs = convs.select("conv_id", "formatted_chars", read_turns(F.col("longest")).alias("turns"), F.array_join(F.transform("loss", lambda x: x["text"]), "").alias("loss"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return convs.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?s>|/?INST\]|<SYS>>|</SYS>>|\|[a-z_]+\|>)', '\1\\\2', 'g'))
    + length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?INST\]|<SYS>>|</SYS>>|\|[a-z_]+\|>)', '\1\\\2', 'g')) + 20 AS chars
  FROM turns
), placed AS (
  SELECT *, sum(chars) OVER w AS so_far, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM escaped
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(so_far) FILTER (WHERE role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""

"""Operator 8: chat formatting as relational work.

Turns of a conversation are collected as structs and sorted, adjacent turns of one role are merged
into a block by array functions (places of role changes, slices between them), and blocks are
concatenated; all in Spark expressions and linear in the turns.

Template.  A user block is `[INST]`...`[/INST]`, an assistant block ends in `</s>`, any other role is
`[ROLE]`role`[BODY]`...`[/ROLE]`.  Merged turns stand in one block with `[SEP]` between them, so each
row can be read back.  In texts and roles, whatever looks like a control string gets a backslash
after its first character (and one more where it already has some), which reading takes off again;
other text is left as it is.

Defined results: null text is empty; null role is the empty role; turns with equal numbers go by role,
then text; null turn numbers come first; repeated rows are turns of their own; a null conv_id is one
conversation; an empty table gives an empty table; other columns are not used.  A conversation is one
output row, so its turns meet in one row by definition; partial collection runs before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutplan.llm.shared import once

# The template's control strings.
USER, USER_END, SAID_END, ROLE, BODY, ROLE_END, SEP = "[INST]", "[/INST]", "</s>", "[ROLE]", "[BODY]", "[/ROLE]", "[SEP]"
CONTROL = r"(?:/?INST\]|SEP\]|/?ROLE\]|BODY\]|/s>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])(\\*{CONTROL})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])\\(\\*{CONTROL})", "$1$2")


def blocks(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, blocks: array<struct<role, texts: array<string>>>), adjacent turns of a role merged."""
    row = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    ordered = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    role_at = lambda i: F.get("turns", i)["role"]
    changes = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role_at(i) != role_at(i - 1)))
    placed = ordered.select("conv_id", "turns", once(changes).alias("starts"))

    def block(first: Column, k: Column) -> Column:
        after = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        texts = F.transform(F.slice("turns", first + 1, after - first), lambda t: t["text"])
        return F.struct(role_at(first).alias("role"), texts.alias("texts"))

    return placed.select("conv_id", F.transform("starts", block).alias("blocks"))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted)."""

    def one(b: Column) -> Column:
        inner = F.array_join(F.transform(b["texts"], escape), SEP)
        return (
            F.when(b["role"] == "user", F.concat(F.lit(USER), inner, F.lit(USER_END)))
            .when(b["role"] == "assistant", F.concat(inner, F.lit(SAID_END)))
            .otherwise(F.concat(F.lit(ROLE), escape(b["role"]), F.lit(BODY), inner, F.lit(ROLE_END)))
        )

    return blocks(turns, conv_id, turn, role, text).select("conv_id", F.array_join(F.transform("blocks", one), "").alias("formatted"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Adds `turns`: array<struct<role, text>> and `loss`: the text under the loss mask, from `formatted` alone."""
    ends = r"(?<=\[/INST\]|\[/ROLE\]|</s>)"
    parts = F.filter(F.split("formatted", ends), lambda b: b != "")

    def cut(b: Column, head: int, tail: int) -> Column:
        return F.substring(b, F.lit(head + 1), F.char_length(b) - head - tail)

    def turns_of(b: Column) -> Column:
        role = (
            F.when(F.endswith(b, F.lit(USER_END)), F.lit("user"))
            .when(F.endswith(b, F.lit(SAID_END)), F.lit("assistant"))
            .otherwise(F.substring_index(cut(b, len(ROLE), len(ROLE_END)), BODY, 1))
        )
        inner = (
            F.when(F.endswith(b, F.lit(USER_END)), cut(b, len(USER), len(USER_END)))
            .when(F.endswith(b, F.lit(SAID_END)), cut(b, 0, len(SAID_END)))
            .otherwise(F.substring(b, F.char_length(role) + len(ROLE) + len(BODY) + 1, F.char_length(b) - F.char_length(role) - len(ROLE + BODY + ROLE_END)))
        )
        return F.transform(F.split(inner, r"\[SEP\]", -1), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    read = formatted.withColumn("turns", F.flatten(F.transform(parts, turns_of)))
    said = F.filter("turns", lambda t: t["role"] == "assistant")
    return read.withColumn("loss", F.array_join(F.transform(said, lambda t: t["text"]), ""))


def digest(turns: DataFrame) -> DataFrame:
    """The rows of the query; conversation -1 is added, and all but conv_id is read back from the output."""
    spark = turns.sparkSession
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = turns.select("conv_id", "turn", "role", "text").unionByName(extra)
    read = parse_chats(format_chats(rows))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH raw AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM raw
),
sized AS (
  SELECT *, length(regexp_replace(text, '([\[<])(\\*(?:/?INST\]|SEP\]|/?ROLE\]|BODY\]|/s>))', '\1\\\2', 'g')) AS n,
    length(regexp_replace(role, '([\[<])(\\*(?:/?INST\]|SEP\]|/?ROLE\]|BODY\]|/s>))', '\1\\\2', 'g')) AS r,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY i) = role, false) AS same FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN same THEN 5 WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 4 ELSE 19 + r END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

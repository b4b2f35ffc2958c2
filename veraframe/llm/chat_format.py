"""Chat formatting by prefix-target expansion.

A turn is written as ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line feed. Every assistant turn is an example of its
own: all turns before it are its context, and the loss mask is the span of that reply's text alone. A conversation that does not
end with a reply has one more example without a mask, so that every turn is in the output. Control strings inside roles
and texts are escaped: ``<``, any number of backslashes, ``|`` gets one more backslash, so ``<|`` stands in the output only where the template
puts it, and one backslash less gives the text back.

Only DataFrame functions are used. A conversation's turns are one row (an example holds all turns before its reply, and
SHA-256 of the turns needs them in one value), so a conversation must fit in a row. Examples are made
and read back row by row; only the replies are brought together again, by a key by which rows are
partitioned already.

Defined cases: an empty table gives no rows; null roles and texts are empty; null turns come first, equal turns are
ordered by their formatted form; rows with a null conv_id are one conversation; repeated rows are turns of their own;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
REPLY = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def chat_examples(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, example (from 0), last (whether it holds all turns), formatted, and loss_start and loss_end, code points from 0 (null: no loss)."""
    role_, body = F.coalesce(F.col(role), F.lit("")), escape(F.coalesce(F.col(text), F.lit("")))
    piece = F.concat(F.lit(START), escape(role_), F.lit(SEP), body, F.lit(END))
    turns = rows.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), piece.alias("piece"), F.when(role_ == REPLY, F.length(body)).alias("chars")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(F.col("turns"), i)["chars"].isNotNull() | (i == n))
    each = whole.select("conv_id", "turns", F.posexplode(ends).alias("example", "upto"))
    chars = F.element_at("turns", F.col("upto"))["chars"]
    made = each.select("conv_id", "example", (F.col("upto") == n).alias("last"), F.array_join(F.transform(F.slice("turns", 1, F.col("upto")), lambda t: t["piece"]), "").alias("formatted"), chars.alias("chars"))
    stop = F.length("formatted") - len(END)
    return made.select("conv_id", "example", "last", "formatted", F.when(F.col("chars").isNotNull(), stop - F.col("chars")).alias("loss_start"), F.when(F.col("chars").isNotNull(), stop).alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """What a conversation's examples hold: turns from the example with all of them, loss text from each mask, unescaped."""
    turns = F.slice(F.split("formatted", r"\Q<|im_start|>\E"), 2, F.size(F.split("formatted", r"\Q<|im_start|>\E")))
    # What follows a role's separator, without the end mark; neither occurs inside an escaped role or text.
    role_of = lambda t: unescape(F.substring_index(t, SEP, 1))
    text_of = lambda t: unescape(F.substring_index(F.substring_index(t, SEP, -1), END, 1))
    plain = F.array_join(F.transform(turns, lambda t: F.concat(role_of(t), F.lit("\n"), text_of(t), F.lit("\n"))), "")
    loss = F.when(F.col("loss_start").isNotNull(), unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    found = examples.select(
        "conv_id",
        F.struct("example", loss.alias("loss")).alias("reply"),
        F.when(F.col("last"), F.size(turns)).cast("long").alias("n_turns"),
        F.when(F.col("last"), F.sha2(plain, 256)).alias("turns_sha256"),
        F.length("formatted").cast("long").alias("chars"),
    )
    whole = found.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list("reply")), lambda r: r["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    return whole.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(REPLY).alias("role"), F.lit(said).alias("text"))
    return read_back(chat_examples(rows.unionByName(more)))


_ESCAPED = r"regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g')"
ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, v.turn, v.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
p AS (SELECT *, '<|im_start|>' || {_ESCAPED.format("role")} || '<|im_sep|>' || {_ESCAPED.format("text")} || '<|im_end|>' || chr(10) AS piece FROM t),
o AS (SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY conv_id) AS n, sum(length(piece)) OVER w AS upto FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, piece ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR nth = n)::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant' OR nth = n) AS n_examples
FROM o GROUP BY conv_id"""

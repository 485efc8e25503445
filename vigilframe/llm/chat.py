"""Chat formatting by prefix-target expansion, in DataFrame expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: The template: TURN role newline text END. Inside roles and texts "\", "<" and "[" are escaped, and so is a role's
#: newline: no control string of this or another chat template, </s> or [INST], survives inside a text.
TURN, END = "<|turn|>", "<|end|>"
ESCAPES = (("<", "\\l"), ("[", "\\b"), ("\n", "\\e"))


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for plain, coded in ESCAPES if role else ESCAPES[:2]:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    """Undoes escape(). Every run of backslashes starts an escape, so splitting at doubled ones finds the escaped ones."""

    def part(p: Column) -> Column:
        for plain, coded in ESCAPES:
            p = F.replace(p, F.lit(coded), F.lit(plain))
        return p

    return F.array_join(F.transform(F.split(c, r"\\\\"), part), "\\")


def expand_examples(turns: DataFrame) -> DataFrame:
    """One example for each assistant turn: (conv_id, example, formatted, loss_start, loss_length, last).

    formatted holds all turns before the reply, then the reply; only code points loss_start (from 0) to loss_start +
    loss_length, the escaped reply, are trainable. Turns after the last reply, or of a conversation without one, make
    one more example with nothing trainable (loss_length 0), so no turn is lost. Null roles and texts are empty; turns
    of equal number stand in order of role and text, null numbers first; a null conv_id is a conversation of its own.
    Repeated rows stay repeated; an empty table gives no examples; further columns don't matter.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    shown = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("t"))
    talks = shown.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    talks = talks.select(
        "conv_id",
        F.transform("t", lambda t: t["role"] == "assistant").alias("reply"),
        F.transform("t", lambda t: F.concat(F.lit(TURN), escape(t["role"], role=True), F.lit("\n"), escape(t["text"]), F.lit(END))).alias("shown"),
        F.size("t").alias("n"),
    )
    places = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (F.get("reply", i - 1)) | (i == F.col("n")))
    examples = talks.select("conv_id", "reply", "shown", "n", F.posexplode(places).alias("example", "at"))
    head = len(f"{TURN}assistant\n")
    mine, trained = F.element_at("shown", F.col("at")), F.get("reply", F.col("at") - 1)
    context = F.array_join(F.slice("shown", F.lit(1), F.col("at") - 1), "")
    return examples.select(
        "conv_id", "example", F.concat(context, mine).alias("formatted"), F.when(trained, F.length(mine) - head - len(END)).otherwise(0).alias("loss_length"), (F.col("at") == F.col("n")).alias("last")
    ).withColumn("loss_start", F.length("formatted") - F.when(F.col("loss_length") >= 0, F.col("loss_length") + len(END)))


def read_back(examples: DataFrame) -> DataFrame:
    """What the formatted examples hold: turns out of each conversation's last example, replies out of the loss masks."""
    reply = unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length")))
    whole = F.when(F.col("last"), F.col("formatted"))
    parts = examples.select("conv_id", F.struct("example", reply.alias("reply"), F.length("formatted").cast("long").alias("chars"), whole.alias("whole")).alias("x"))
    talks = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    joined = talks.select(
        "conv_id",
        F.filter(F.split(F.element_at("x", -1)["whole"], r"<\|end\|>"), lambda p: p != "").alias("turns"),
        F.array_join(F.transform("x", lambda x: x["reply"]), "").alias("loss"),
        F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("formatted_chars"),
    )
    role = lambda p: unescape(F.substring_index(F.substring(p, len(TURN) + 1, 1 << 30), "\n", 1))
    text = lambda p: unescape(F.substring(p, F.instr(p, "\n") + 1, F.lit(1 << 30)))
    said = F.transform("turns", lambda p: F.concat(role(p), F.lit("\n"), text(p), F.lit("\n")))
    return joined.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: Conversation -1: control strings of a chat template said as plain text.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op8_chat_prefix_target(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return read_back(expand_examples(turns.unionByName(said)))


OP8_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    length(text) + length(role) + 16
      + 1 * (length(text) - length(replace(replace(replace(text, chr(92), ''), '<', ''), '[', '')))
      + 1 * (length(role) - length(replace(replace(replace(replace(role, chr(92), ''), '<', ''), '[', ''), chr(10), ''))) AS shown
  FROM t
), c AS (
  SELECT *, sum(shown) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

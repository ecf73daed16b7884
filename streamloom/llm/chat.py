"""Chat formatting by event-sourced reconstruction. Built-in functions only.

A log is partitioned by conversation and ordered by sequence number; streamed deltas, edits and regenerations fold into final
messages, which are then rendered. Kinds of event: "message" (the text of a turn, replacing what it had), "edit" (the same, for
a turn that stands), "delta" (text appended to a turn), "regenerate" (a turn starts anew, and later turns are dropped).

Template: `<|turn:role|>text<|end|>` for every turn. A backslash in a role or text is doubled and `<|` becomes `<\\|`, so no control
string survives inside a text, and the original is read back exactly. Roles also have `|>` written as `|\\>`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.llm.common import read

END = "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|>"), F.lit("|\\>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("|\\>"), F.lit("|>")))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log (conv_id, seq, kind, turn, role, text).

    Null texts are empty, null roles "". An event counts unless a later regenerate of its turn or an earlier one, or a later
    message or edit of its turn, supersedes it. Events that share a number are ordered by kind and text.
    """
    e = events.select("conv_id", "seq", "kind", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    e = e.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("seq", "turn", "kind", "text", "role")))
    later = Window.partitionBy("conv_id").orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("dropped_from", F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later))
    e = e.filter(F.col("dropped_from").isNull() | (F.col("turn") < F.col("dropped_from")))
    last = F.max(F.when(F.col("kind") != "delta", F.col("place"))).over(Window.partitionBy("conv_id", "turn"))
    e = e.withColumn("base", last).filter(F.col("base").isNull() | (F.col("place") >= F.col("base")))
    parts = F.sort_array(F.collect_list(F.struct("place", "text")))
    return e.groupBy("conv_id", "turn").agg(F.min_by("role", "place").alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans: one row per conversation, turns in order; loss_spans are the (start, end) code points,
    end exclusive, of the assistant texts inside formatted. A conversation is one string by nature of the result."""
    m = messages.select("conv_id", "turn", F.concat(F.lit("<|turn:"), escape_role(F.col("role")), F.lit("|>")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("loss"))
    own = Window.partitionBy("conv_id").orderBy("turn")
    size = F.char_length("head") + F.char_length("body") + len(END)
    m = m.withColumn("begin", F.sum(size.cast("long")).over(own) - len(END) - F.char_length("body"))
    turn = F.struct("turn", F.concat("head", "body", F.lit(END)).alias("out"), "loss", F.struct(F.col("begin").alias("start"), (F.col("begin") + F.char_length("body")).alias("end")).alias("span"))
    all_ = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return all_.select("conv_id", F.array_join(F.transform("turns", lambda t: t["out"]), "").alias("formatted"), F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["span"]).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """Read the turns back: an array of (role, text)."""
    pieces = F.split(formatted, r"<\|end\|>", -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(turns, lambda t: F.struct(unescape_role(F.regexp_extract(t, r"(?s)\A<\|turn:(.*?)\|>", 1)).alias("role"), unescape(F.regexp_replace(t, r"(?s)\A<\|turn:.*?\|>", "")).alias("text")))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A log that ends in the given conversations, as a chat service would have written it; rows that repeat a turn each stay a turn
    of their own. Each assistant text is streamed in two deltas, after a first attempt that a regeneration takes back; each
    other text is a draft first (its first half) and then edited. Events of turn n have the numbers 8n to 8n + 4."""
    c = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    c = c.select("conv_id", nth.alias("turn"), "role", "text", F.floor(F.char_length("text") / 2).cast("int").alias("half"))
    event = lambda step, kind, text: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), text.alias("text"))
    whole, empty = F.col("text"), F.lit("")
    first, rest = F.left(whole, F.col("half")), F.substring(whole, F.col("half") + 1, F.char_length(whole))
    said = F.array(event(0, "message", empty), event(1, "delta", rest), event(2, "regenerate", empty), event(3, "delta", first), event(4, "delta", rest))
    typed = F.array(event(0, "message", first), event(1, "edit", whole))
    e = c.select("conv_id", "turn", "role", F.explode(F.when(F.col("role") == "assistant", said).otherwise(typed)).alias("e"))
    return e.select("conv_id", (F.col("turn") * 8 + F.col("e.step")).alias("seq"), F.col("e.kind").alias("kind"), "turn", "role", F.col("e.text").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT -7L conv_id, t turn, r role, '</s>[INST] ok [/INST]' text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = render(fold_events(conversation_events(rows)))
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    said = F.array_join(F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size(parse(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = """
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), '|>', '|\\>') AS r2, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS t2 FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r2) + length(t2) + 16) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

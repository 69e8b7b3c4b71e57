"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns (equal role and text) is rendered once as the
prompt; what follows on either side are the completions. A completion's mask gives
its segments in order as ``loss:characters``: only the text and end mark of
assistant turns have loss 1.

:func:`format_pairs` is DataFrame functions on the row of a pair: it shuffles nothing, and its
work is linear in the pair's text. The stand-in pairs of :func:`stand_in_pairs` do shuffle whole
conversations, as they bring turns together; where the next id is absent, the rejected answer is empty.

Defined cases: a null side is an empty conversation; a null turn, role or text is
an empty text of the role ``unknown``; equal sides give empty completions and
``identical`` true; if one side is a prefix of the other, its completion is empty;
marker strings within a text are broken by a blank, so a text can't end its turn;
repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role string, text string>>"


def _clean(turns: Column) -> Column:
    return F.transform(F.coalesce(turns.cast(TURNS), F.array().cast(TURNS)), lambda t: F.struct(
        F.coalesce(F.replace(t["role"], F.lit("<|"), F.lit("< |")), F.lit("unknown")).alias("role"),
        F.coalesce(F.replace(t["text"], F.lit("<|"), F.lit("< |")), F.lit("")).alias("text")))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))), "")


def _mask(turns: Column) -> Column:
    def one(t: Column) -> Column:
        head = F.char_length(t["role"]) + len(OPEN) + 1
        body = F.char_length(t["text"]) + len(CLOSE)
        return F.when(t["role"] == "assistant", F.concat(F.lit("0:"), head, F.lit(",1:"), body, F.lit(",0:1"))).otherwise(
            F.concat(F.lit("0:"), head + body + 1))

    return F.array_join(F.transform(turns, one), ",")


def format_pairs(pairs: DataFrame, id_col: str = "pair_id", chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """A row per pair: ``id_col``, ``n_common``, ``prompt``, ``chosen``, ``rejected``,
    ``chosen_mask``, ``rejected_mask``, ``identical``. The sides are arrays of (role, text)."""
    p = pairs.select(F.col(f"`{id_col}`").alias("id"), _clean(F.col(f"`{chosen_col}`")).alias("c"), _clean(F.col(f"`{rejected_col}`")).alias("r"))
    short = F.least(F.size("c"), F.size("r"))
    apart = F.filter(F.transform("c", lambda t, i: F.when((i >= F.size("r")) | (t != F.get("r", i)), i)), lambda i: i.isNotNull())
    p = p.withColumn("n", F.coalesce(F.get(apart, F.lit(0)), short))
    p = p.select("id", "n", F.slice("c", 1, F.col("n")).alias("head"), F.slice("c", F.col("n") + 1, F.size("c")).alias("c"),
                 F.slice("r", F.col("n") + 1, F.size("r")).alias("r"))
    return p.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_common"), _render(F.col("head")).alias("prompt"),
                    _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"), _mask(F.col("c")).alias("chosen_mask"),
                    _mask(F.col("r")).alias("rejected_mask"), ((F.size("c") == 0) & (F.size("r") == 0)).alias("identical"))


def stand_in_pairs(turns: DataFrame) -> DataFrame:
    """Pairs in the schema the job expects, from the conversations table: chosen is a
    conversation, rejected the same with its last assistant turn answered by the
    last assistant turn of the conversation with the next id (empty if there is none)."""
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    last = rows.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    chosen = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    other = last.select((F.col("conv_id") - 1).alias("_before"), F.col("last.text").alias("answer"))
    both = (chosen.join(last.select(F.col("conv_id").alias("_c"), "last"), F.col("conv_id") == F.col("_c"), "left")
            .join(other, F.col("conv_id") == F.col("_before"), "left"))
    replaced = F.transform("all", lambda t: F.struct(t["role"].alias("role"), F.when(
        (t["role"] == "assistant") & t["turn"].eqNullSafe(F.col("last.turn")) & (t["text"] == F.col("last.text")),
        F.coalesce("answer", F.lit(""))).otherwise(t["text"]).alias("text")))
    plain = F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return both.select(F.col("conv_id").alias("pair_id"), plain.alias("chosen"), replaced.alias("rejected"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference records of all conversations."""
    return format_pairs(stand_in_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _sql() -> str:
    clean = "{'role': coalesce(replace(x.role, '<|', '< |'), 'unknown'), 'text': replace(x.text, '<|', '< |')}"
    render = f"array_to_string(list_transform({{0}}, lambda x: '{OPEN}' || x.role || chr(10) || x.text || '{CLOSE}' || chr(10)), '')"
    head, body = f"(length(x.role) + {len(OPEN) + 1})", f"(length(x.text) + {len(CLOSE)})"
    mask = (f"array_to_string(list_transform({{0}}, lambda x: CASE WHEN x.role = 'assistant' THEN '0:' || {head} || ',1:' || {body} || ',0:1' "
            f"ELSE '0:' || ({head} + {body} + 1) END), ',')")
    return f"""
WITH rows AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
last AS (SELECT conv_id, max({{'turn': turn, 'text': text}}) AS last FROM rows WHERE role = 'assistant' GROUP BY conv_id),
chosen AS (SELECT conv_id, list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn, role, text) AS t FROM rows GROUP BY conv_id),
sides AS (SELECT c.conv_id, list_transform(c.t, lambda x: {clean}) AS c,
  list_transform(list_transform(c.t, lambda x: {{'role': x.role, 'text': CASE WHEN x.role = 'assistant' AND x.turn = l.last.turn AND x.text = l.last.text
    THEN coalesce(o.last.text, '') ELSE x.text END}}), lambda x: {clean}) AS r
  FROM chosen c LEFT JOIN last l ON l.conv_id = c.conv_id LEFT JOIN last o ON o.conv_id = c.conv_id + 1),
n AS (SELECT *, coalesce(list_filter(range(1, len(c) + 1), lambda i: i > len(r) OR c[i] <> r[i])[1] - 1, least(len(c), len(r))) AS n FROM sides),
cut AS (SELECT conv_id, n, c[1:n] AS h, c[n + 1:] AS c, r[n + 1:] AS r FROM n)
SELECT conv_id AS pair_id, CAST(n AS BIGINT) AS n_common, coalesce({render.format('h')}, '') AS prompt, coalesce({render.format('c')}, '') AS chosen,
  coalesce({render.format('r')}, '') AS rejected, coalesce({mask.format('c')}, '') AS chosen_mask, coalesce({mask.format('r')}, '') AS rejected_mask,
  len(c) = 0 AND len(r) = 0 AS identical
FROM cut
"""


SQL = _sql()

"""Preference formatting: paired conversations to one prompt and two masked completions.

Conversations 2k (chosen) and 2k + 1 (rejected) make pair k.  The longest common prefix of their turns (role and text
alike, turn by turn) is the prompt and is rendered once; what follows on either side is that side's completion, and
only its assistant turns bear loss.  The result has one row per rendered turn in order (pair_id, part, turn, copy), so
no conversation, however long, is gathered into one value; `assembled` joins the rows of a pair into strings where a
conversation is known to fit a row.

DataFrame operations only.  The prefix comes from one aggregation by (pair, turn), which holds two rows at most once
partially aggregated, and one minimum for each pair; turns meet their pair's minimum in a join that AQE splits.

Defined results: null role or text counts as empty and equals another null; a null turn comes first; rows that repeat
a turn number follow each other by role and text (`copy` counts them) and must match one to one; a conversation
without partner has an empty prompt; null conv_id forms a pair (null) of chosen turns only; empty table, empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def preference_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """pair_id, part (prompt, chosen or rejected), turn, copy, rendered, n_chars, loss."""
    rows = turns.select(
        F.expr(f"`{conv}` div 2").alias("pair_id"), (F.coalesce(F.col(conv) % 2, F.lit(0)) != 0).alias("rejected"),
        F.coalesce(F.col(turn).cast("long"), F.lit(-(2**63))).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("pair_id", "rejected", "turn").orderBy("role", "text")))
    said = F.struct("role", "text")
    slots = rows.groupBy("pair_id", "turn", "copy").agg(F.count(F.lit(1)).alias("n"), F.min(said).alias("low"), F.max(said).alias("high"))
    differs = (F.col("n") != 2) | (F.col("low") != F.col("high"))
    first = slots.filter(differs).groupBy(F.col("pair_id").alias("of_pair")).agg(F.min(F.struct("turn", "copy")).alias("split"))
    placed = rows.join(first, F.col("pair_id").eqNullSafe(F.col("of_pair")), "left")
    common = F.col("split").isNull() | (F.struct("turn", "copy") < F.col("split"))
    rendered = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>\n"))
    return placed.filter(~(common & F.col("rejected"))).select(
        "pair_id", F.when(common, "prompt").when(F.col("rejected"), "rejected").otherwise("chosen").alias("part"), "turn", F.col("copy").cast("long").alias("copy"),
        rendered.alias("rendered"), F.length(rendered).cast("long").alias("n_chars"), F.when(~common & (F.col("role") == "assistant"), 1).otherwise(0).alias("loss"),
    )


def assembled(parts: DataFrame, max_chars: int = 1 << 26) -> DataFrame:
    """pair_id, n_turns, n_chars, prompt, chosen, rejected, chosen_mask, rejected_mask: the paired masked completions.

    A mask has (length, loss) for each turn in order.  A pair of more than max_chars rendered characters, or of as many
    turns as a quarter of that, does not go into one value: its texts and masks are null and it stays in `parts` alone.
    """
    size = parts.groupBy(F.col("pair_id").alias("of_pair")).agg(F.count(F.lit(1)).alias("n_turns"), F.sum("n_chars").alias("n_chars"))
    small = size.filter((F.col("n_chars") <= max_chars) & (F.col("n_turns") <= max_chars // 4)).select(F.col("of_pair").alias("small"))
    rows = F.array_sort(F.collect_list(F.struct("part", "turn", "copy", "rendered", "n_chars", "loss")))
    out = parts.join(small, F.col("pair_id").eqNullSafe(F.col("small")), "left_semi").groupBy("pair_id").agg(rows.alias("rows"))
    own = lambda name: F.filter("rows", lambda r: r["part"] == name)
    text = lambda name: F.array_join(F.transform(own(name), lambda r: r["rendered"]), "").alias(name)
    mask = lambda name: F.transform(own(name), lambda r: F.struct(r["n_chars"].alias("length"), r["loss"].alias("loss"))).alias(f"{name}_mask")
    out = out.select("pair_id", text("prompt"), text("chosen"), text("rejected"), mask("chosen"), mask("rejected"))
    whole = size.join(out, F.col("of_pair").eqNullSafe(F.col("pair_id")), "left")
    return whole.select(F.col("of_pair").alias("pair_id"), "n_turns", "n_chars", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")


def preference_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of the whole table: prompt and completions with their masks as text (`length:loss` by turn)."""
    pairs = assembled(preference_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    said = lambda name: F.array_join(F.transform(name, lambda m: F.concat_ws(":", m["length"].cast("string"), m["loss"].cast("string"))), " ").alias(name)
    return pairs.select("pair_id", "n_turns", "n_chars", "prompt", "chosen", "rejected", said("chosen_mask"), said("rejected_mask"))


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


TURNS_SQL = """
WITH r AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 <> 0 AS rejected, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS copy
  FROM conversations),
s AS (
  SELECT pair_id, turn, copy FROM r GROUP BY ALL
  HAVING count(*) <> 2 OR min(role) <> max(role) OR min(text) <> max(text)),
f AS (SELECT pair_id, min((turn, copy)) AS split FROM s GROUP BY pair_id),
p AS (SELECT r.*, f.split IS NULL OR (turn, copy) < f.split AS common FROM r LEFT JOIN f USING (pair_id))
SELECT pair_id, CASE WHEN common THEN 'prompt' WHEN rejected THEN 'rejected' ELSE 'chosen' END AS part, turn, copy,
       '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered,
       length('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10)) AS n_chars,
       CASE WHEN NOT common AND role = 'assistant' THEN 1 ELSE 0 END AS loss
FROM p WHERE NOT (common AND rejected)
"""

OP9_SQL = TURNS_SQL

COMPLETIONS_SQL = f"""
WITH t AS ({TURNS_SQL}),
x AS (SELECT *, coalesce(turn, -9223372036854775808) AS o, n_chars || ':' || loss AS m FROM t)
SELECT pair_id, count(*) AS n_turns, sum(n_chars)::BIGINT AS n_chars,
       coalesce(string_agg(rendered, '' ORDER BY o, copy) FILTER (WHERE part = 'prompt'), '') AS prompt,
       coalesce(string_agg(rendered, '' ORDER BY o, copy) FILTER (WHERE part = 'chosen'), '') AS chosen,
       coalesce(string_agg(rendered, '' ORDER BY o, copy) FILTER (WHERE part = 'rejected'), '') AS rejected,
       coalesce(string_agg(m, ' ' ORDER BY o, copy) FILTER (WHERE part = 'chosen'), '') AS chosen_mask,
       coalesce(string_agg(m, ' ' ORDER BY o, copy) FILTER (WHERE part = 'rejected'), '') AS rejected_mask
FROM x GROUP BY pair_id
"""

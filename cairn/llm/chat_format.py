"""Preference formatting in DataFrame functions only.

The turns of a pair's chosen and rejected conversations, in order, agree up to their longest common prefix, which is
rendered once as the prompt. The rest of each is its completion, with the code-point spans that a loss counts: what the
assistant says and the mark that ends it. A turn renders as <|role|>, newline, text, <|end|>, newline.

One shuffle by pair serves all windows; nothing larger than a pair is gathered.

Cases: a null role is "unknown" and a null text empty; turns with equal numbers stand in order of role and text; turns
without conv_id belong to no pair and are left out; a pair that lacks one side has an empty prompt and null for that
side; equal conversations leave empty completions; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>"


def adjacent_pairs(turns: DataFrame) -> DataFrame:
    """turns with pair_id and side: conversation 2k is the chosen one of pair k, 2k + 1 the rejected one."""
    return turns.filter("conv_id is not null").withColumns(
        {"pair_id": F.floor(F.col("conv_id") / 2), "side": F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected")}
    )


def format_preferences(turns: DataFrame) -> DataFrame:
    """One row per pair of turns(pair_id, side, conv_id, turn, role, text): pair_id, chosen_id, rejected_id, n_prefix,
    prompt, and chosen, rejected (texts) with chosen_spans, rejected_spans (arrays of start and end)."""
    df = turns.select("pair_id", "side", "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one_side = Window.partitionBy("pair_id", "side")
    in_order = one_side.orderBy("turn", "role", "text")
    df = df.withColumn("r", F.row_number().over(in_order))
    level = Window.partitionBy("pair_id", "r")
    alike = (F.count("*").over(level) == 2) & (F.min("role").over(level) == F.max("role").over(level)) & (F.min("text").over(level) == F.max("text").over(level))
    df = df.withColumn("_alike", alike)
    # No turn out of step: the whole of both is the prefix.
    whole = Window.partitionBy("pair_id")
    df = df.withColumn("n_prefix", F.coalesce(F.min(F.when(~F.col("_alike"), F.col("r"))).over(whole) - 1, F.max("r").over(whole)))
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    df = df.withColumn("piece", F.concat(head, F.col("text"), F.lit(END + "\n"))).withColumn("_rest", F.col("r") > F.col("n_prefix"))
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.when(F.col("_rest"), F.length("piece")).otherwise(0)).over(before), F.lit(0)) + F.length(head)
    span = F.struct(at.alias("start"), (at + F.length("text") + len(END)).alias("end"))
    df = df.withColumn("span", F.when(F.col("_rest") & (F.col("role") == "assistant"), span))

    def joined(condition) -> Column:
        rows = F.array_sort(F.collect_list(F.when(condition, F.struct("r", "piece"))))
        return F.array_join(F.transform(rows, lambda x: x["piece"]), "")

    out = [
        F.max(F.when(F.col("side") == "chosen", F.col("conv_id"))).alias("chosen_id"),
        F.max(F.when(F.col("side") == "rejected", F.col("conv_id"))).alias("rejected_id"),
        F.first("n_prefix").cast("long").alias("n_prefix"),
        joined(~F.col("_rest") & (F.col("side") == "chosen")).alias("prompt"),
    ]
    for side in ("chosen", "rejected"):
        own = F.col("side") == side
        out.append(F.when(F.count(F.when(own, 1)) > 0, joined(F.col("_rest") & own)).alias(side))
        out.append(F.when(F.count(F.when(own, 1)) > 0, F.array_sort(F.collect_list(F.when(own, F.col("span"))))).alias(f"{side}_spans"))
    return df.groupBy("pair_id").agg(*out)


ORACLE = r"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side, conv_id,
    coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS r
  FROM conversations WHERE conv_id IS NOT NULL
),
apart AS (
  SELECT pair_id, min(r) AS r FROM (
    SELECT pair_id, r FROM t GROUP BY pair_id, r HAVING count(*) < 2 OR min(role) <> max(role) OR min(text) <> max(text)
  ) GROUP BY pair_id
),
p AS (SELECT t.*, coalesce(apart.r - 1, max(t.r) OVER (PARTITION BY t.pair_id)) AS n_prefix FROM t LEFT JOIN apart USING (pair_id)),
q AS (SELECT *, '<|' || role || '|>' || chr(10) AS head FROM p),
s AS (SELECT *, head || text || '<|end|>' || chr(10) AS piece FROM q),
u AS (
  SELECT *, length(head) + coalesce(sum(CASE WHEN r > n_prefix THEN length(piece) ELSE 0 END)
    OVER (PARTITION BY conv_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo
  FROM s
)
SELECT pair_id, max(conv_id) FILTER (side = 'chosen') AS chosen_id, max(conv_id) FILTER (side = 'rejected') AS rejected_id,
  any_value(n_prefix)::BIGINT AS n_prefix,
  sha256(coalesce(string_agg(piece, '' ORDER BY r) FILTER (r <= n_prefix AND side = 'chosen'), '')) AS prompt_sha256,
  CASE WHEN count(*) FILTER (side = 'chosen') > 0 THEN
    sha256(coalesce(string_agg(piece, '' ORDER BY r) FILTER (r > n_prefix AND side = 'chosen'), '')) END AS chosen_sha256,
  CASE WHEN count(*) FILTER (side = 'chosen') > 0 THEN coalesce(string_agg(lo || ':' || lo + length(text) + 7, ',' ORDER BY r)
    FILTER (r > n_prefix AND side = 'chosen' AND role = 'assistant'), '') END AS chosen_spans,
  CASE WHEN count(*) FILTER (side = 'rejected') > 0 THEN
    sha256(coalesce(string_agg(piece, '' ORDER BY r) FILTER (r > n_prefix AND side = 'rejected'), '')) END AS rejected_sha256,
  CASE WHEN count(*) FILTER (side = 'rejected') > 0 THEN coalesce(string_agg(lo || ':' || lo + length(text) + 7, ',' ORDER BY r)
    FILTER (r > n_prefix AND side = 'rejected' AND role = 'assistant'), '') END AS rejected_spans
FROM u GROUP BY pair_id
"""

"""Places of rows in a global order, without a window over a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, staged


def ranked(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """df with `place`, the number from 0 of each row among those with equal `by` (not null) in the given order (nulls
    first), and `n`, how many there are.

    Rows are dealt by range of (by, order), so a key with most of the rows spreads over many tasks; equal rows are dealt
    by a seeded draw, and which of them comes first is open. What is gathered is a count for each key and task."""
    spread = df.withColumn("_draw", F.rand(11)).repartitionByRange(by, *order, "_draw").sortWithinPartitions(by, *order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = staged(spread.drop("_draw").withColumns({"_task": F.spark_partition_id(), "_at": at}), "ranked")
    counts = rows.groupBy(F.col(by).alias("_by"), F.col("_task").alias("_of")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("_by")
    before = whole.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "n": F.sum("_n").over(whole)})
    found = rows.join(counts, (F.col(by) == F.col("_by")) & (F.col("_task") == F.col("_of")))
    out = staged(found.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("place"), "n"), "places")
    release(rows)
    return out

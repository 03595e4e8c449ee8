"""Connected components of an edge table by hooking and contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged


def components(edges: DataFrame) -> DataFrame:
    """id and component (smallest id reachable) of every node of edges(a, b); ids are of any one orderable type.

    A round hooks every node to its smallest neighbour (a partially aggregated minimum), follows those pointers to their
    ends by doubling, and contracts the edges to the ends; the edges left shrink at least by half with each round. Tables
    between rounds are written out, so that joins read plain exchanges and hot ends are split."""
    both = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, labels = staged(both, "cc-edges"), None
    while not edges.isEmpty():
        up = edges.select(F.col("b").alias("id"), F.col("a").alias("to")).union(edges.select(F.col("a").alias("id"), F.col("a").alias("to")))
        table = staged(up.groupBy("id").agg(F.min("to").alias("to")), "cc-ends")
        moved = True
        while moved:
            ends = table.select("id", "to")
            onward = ends.join(ends.select(F.col("id").alias("_to"), F.col("to").alias("_end")), F.col("to") == F.col("_to"), "left")
            onward = staged(onward.select("id", F.coalesce("_end", "to").alias("to"), (F.col("_end") < F.col("to")).alias("moved")), "cc-ends")
            release(table)
            table, moved = onward, not onward.filter("moved").isEmpty()
        ends = table.select(F.col("id").alias("_id"), F.col("to").alias("_to"))
        if labels is None:
            step = staged(table.select("id", F.col("to").alias("component")), "cc-labels")
        else:
            step = labels.join(ends, F.col("component") == F.col("_id"), "left").select("id", F.coalesce("_to", "component").alias("component"))
            step = staged(step, "cc-labels")
            release(labels)
        labels = step
        left = edges
        for side in ("a", "b"):
            left = left.join(ends, F.col(side) == F.col("_id")).withColumn(side, F.col("_to")).select("a", "b")
        left = staged(left.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
        release(edges, table)
        edges = left
    return labels if labels is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("component"))

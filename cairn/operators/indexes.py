"""Freshness and life of vector indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stale_vectors(memories: DataFrame, marks: DataFrame) -> DataFrame:
    """Ids without a vector of their present text and generation: marks(id, content_hash, generation)."""
    m = marks.select(F.col("id").alias("_id"), F.col("content_hash").alias("_h"), F.col("generation").alias("_g"))
    df = memories.join(m, F.col("id") == F.col("_id"), "left")
    fresh = F.col("_h").eqNullSafe(F.col("content_hash")) & F.col("_g").eqNullSafe(F.col("index_generation"))
    return df.filter(F.col("_id").isNull() | ~fresh).select("id", F.when(F.col("_id").isNull(), "missing").otherwise("outdated").alias("reason"))


def model_counts(marks: DataFrame, catalog: DataFrame) -> DataFrame:
    return catalog.join(marks, "fingerprint").groupBy("model", "dims").agg(F.countDistinct("id").alias("memories"))


def retired_to_drop(catalog: DataFrame, now: Column, keep: int = 2, days: int = 7) -> DataFrame:
    """Retired indexes beyond the newest few, and those that are older than some days."""
    w = Window.orderBy(F.desc("retired_at"), "fingerprint")
    r = catalog.filter("state = 'retired'").withColumn("rank", F.row_number().over(w))
    return r.filter((F.col("rank") > keep) | (F.col("retired_at") < now - F.make_dt_interval(F.lit(days)))).select("fingerprint", "rank")


def retry_at(failures: Column, failed_at: Column, base: int = 2, most: int = 60, attempts: int = 5) -> Column:
    """When a failed row is tried again: doubling waits up to a minute, null after the last attempt."""
    wait = F.least(F.lit(most), (F.lit(base) * F.pow(F.lit(2), failures - 1)).cast("int"))
    return F.when(failures < attempts, F.timestamp_seconds(F.unix_timestamp(failed_at) + wait))


def health(rows: DataFrame) -> DataFrame:
    """pending, retrying and failed of rows(failures)."""
    return rows.agg(
        F.count_if(F.col("failures") == 0).alias("pending"),
        F.count_if((F.col("failures") > 0) & (F.col("failures") < 5)).alias("retrying"),
        F.count_if(F.col("failures") >= 5).alias("failed"),
    )


def register(catalog: DataFrame, entry: DataFrame) -> DataFrame:
    """Adds an index in state building; an index that is there stays, and may not be of another model or width."""
    old = catalog.select("fingerprint", F.col("model").alias("_m"), F.col("dims").alias("_d"))
    clash = F.col("_m").isNotNull() & ((F.col("_m") != F.col("model")) | (F.col("_d") != F.col("dims")))
    new = entry.join(old, "fingerprint", "left").withColumn("state", F.when(clash, F.raise_error(F.lit("index identity differs")).cast("string")).otherwise("building"))
    return catalog.unionByName(new.filter("_m is null or state = ''").select(catalog.columns))


def finish(catalog: DataFrame, fingerprint: str, now: Column) -> DataFrame:
    """The finished index is ready; the one that was, retires."""
    own = F.col("fingerprint") == fingerprint
    retires = ~own & (F.col("state") == "ready")
    return catalog.withColumn("retired_at", F.when(retires, now).otherwise(F.col("retired_at"))).withColumn(
        "state", F.when(own, "ready").when(retires, "retired").otherwise(F.col("state"))
    )

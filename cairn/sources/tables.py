"""Reading and writing the engine's tables: Parquet folders, versioned snapshots, upserts by rebuilding."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What each version of the memories' table added: columns with what old rows get (fixed values).
ADDED = {
    2: {"pinned": "false", "shown_count": "cast(0 as bigint)", "opened_count": "cast(0 as bigint)"},
    3: {"record_kind": "'fact'", "state": "'active'", "verification_status": "'unverified'"},
    4: {"valid_from": "cast(null as timestamp)", "valid_until": "cast(null as timestamp)", "revision": "cast(1 as bigint)"},
    5: {"index_generation": "cast(1 as bigint)", "application_count": "cast(0 as bigint)", "helpful_count": "cast(0 as bigint)", "harmful_count": "cast(0 as bigint)"},
}
SCHEMA_VERSION = max(ADDED)


def migrate(df: DataFrame, version: int) -> DataFrame:
    """A memories table of an older version as the present one is: every step adds its columns and leaves the rest. A
    newer version than this one is an error, and so is a namespace that is none."""
    if version > SCHEMA_VERSION:
        raise ValueError(f"version {version} is newer than {SCHEMA_VERSION}")
    for step in range(version + 1, SCHEMA_VERSION + 1):
        for name, value in ADDED.get(step, {}).items():
            if name not in df.columns:
                df = df.withColumn(name, F.expr(value))
    fine = (F.col("scope") == "global") & F.col("project_key").isNull() | (F.col("scope") == "project") & F.col("project_key").isNotNull()
    scope = F.when(fine, F.col("scope")).otherwise(F.raise_error(F.lit("a row's namespace is neither global nor a project")).cast("string"))
    return df.withColumn("scope", scope)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checked(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of schema; one that is missing or of another type is an error."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns missing or of another type: {wrong}")
    return df.select(*schema.names)


def write_snapshot(df: DataFrame, folder: str, version: int, partition_by: list[str] | None = None) -> str:
    """Writes a new version beside the old ones; readers switch by version, so a half-written one is never seen."""
    path = f"{folder}/version={version}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def read_snapshot(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/version={version}")


def backup(df: DataFrame, folder: str, version: int) -> str:
    """Copies a snapshot and checks it; the report is JSON."""
    path = write_snapshot(df, folder, version)
    copy = df.sparkSession.read.parquet(path)
    rows = df.count()
    report = {"path": path, "rows": rows, "verified": copy.count() == rows and copy.schema.names == df.schema.names, "schema": SCHEMA_VERSION}
    return json.dumps(report, sort_keys=True)


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep_old: list[str] | None = None) -> DataFrame:
    """old with the rows of new, which win; the columns of keep_old stay where new has null."""
    n = new.select(*[F.col(c).alias(f"_{c}") for c in new.columns])
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    j = old.join(n.withColumn("_new", F.lit(True)), on, "full")
    out = []
    for c in old.columns:
        mine = F.coalesce(f"_{c}", c) if c in (keep_old or ()) or c in key else F.col(f"_{c}")
        out.append(F.when(F.col("_new"), mine).otherwise(F.col(c)).alias(c))
    return j.select(*out)


def first_wins(*tables: DataFrame, key: list[str]) -> DataFrame:
    """Union in which the first table that has a key keeps it."""
    rows = None
    for i, t in enumerate(tables):
        t = t.withColumn("_t", F.lit(i))
        rows = t if rows is None else rows.unionByName(t)
    w = Window.partitionBy(*key).orderBy("_t")
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_t", "_r")


def register_artifacts(rows: DataFrame) -> DataFrame:
    """One row per source_ref of rows(source_ref, content): its body, or conflict where bodies differ."""
    return rows.groupBy("source_ref").agg(F.min("content").alias("content"), (F.min("content") != F.max("content")).alias("conflict"))


def dismiss(dismissed: DataFrame, pairs: DataFrame) -> DataFrame:
    norm = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    return dismissed.select(*norm).union(pairs.select(*norm)).distinct()


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path and the longest root that it lies in. Equi-join on each ancestor folder in place of a prefix comparison."""
    parts = F.split("path", "/")
    up = paths.withColumn("root", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    return up.join(roots.select("root"), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))

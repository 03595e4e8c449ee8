"""Figures about the store itself: indexes, sizes, generations, one status row, and an agent's record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .access import current
from .usage import describe


def fresh_marks(marks: DataFrame, memories: DataFrame) -> DataFrame:
    """marks(id, content_hash, generation, ...) whose vector is of the present text and generation of its memory."""
    m = memories.select("id", "content_hash", F.col("index_generation").alias("generation"))
    return marks.join(m, ["id", "content_hash", "generation"], "left_semi")


def current_entries(marks: DataFrame, memories: DataFrame, now: Column, fingerprint: str) -> DataFrame:
    """How many fresh vectors of an index belong to memories that hold now."""
    live = memories.filter(F.col("deleted_at").isNull() & current(now))
    return fresh_marks(marks.filter(F.col("fingerprint") == fingerprint), live).agg(F.count("*").alias("entries"))


def index_status(catalog: DataFrame, marks: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """catalog with the entries of each index and, if sizes(table_name, bytes) are given, its bytes."""
    n = marks.groupBy(F.col("fingerprint").alias("_f")).agg(F.count("*").alias("entries"))
    df = catalog.join(n, F.col("fingerprint") == F.col("_f"), "left").drop("_f").withColumn("entries", F.coalesce("entries", F.lit(0)))
    return df if sizes is None else df.join(sizes, "table_name", "left")


def page_sizes(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """table_name and bytes: every one of pages(name, bytes) belongs to the table with the longest name that is its own or
    that it begins with and an underscore follows. Joined on each such beginning, not by comparing all with all."""
    parts = F.split("name", "_")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_"))
    rows = pages.select("name", "bytes", F.explode(heads).alias("table_name")).join(tables.select("table_name").distinct(), "table_name")
    rows = rows.groupBy("name").agg(F.max_by("table_name", F.length("table_name")).alias("table_name"), F.first("bytes").alias("bytes"))
    return rows.groupBy("table_name").agg(F.sum("bytes").alias("bytes"))


def generations(catalog: DataFrame) -> DataFrame:
    """catalog with a generation number by model and width; one row per index, so one task numbers them."""
    return catalog.withColumn("generation", F.row_number().over(Window.orderBy("model", "dims", "fingerprint")))


def fingerprint(model: Column, dims: Column, revision: Column) -> Column:
    """Identity of an index: digest of its canonical JSON, keys in order."""
    parts = [F.lit('{"dims":'), dims.cast("string"), F.lit(',"model":'), F.to_json(F.array(model)), F.lit(',"revision":'), F.to_json(F.array(revision)), F.lit("}")]
    return F.sha2(F.concat(*parts), 256)


def snapshot(memories: DataFrame, marks: DataFrame, catalog: DataFrame, usage_total: DataFrame, feedback: DataFrame, now: Column) -> DataFrame:
    """One row about the store: live memories, exposures, opens and counters, indexes by state, fresh entries of the one
    that serves, usage, and feedback by basis. Every part is an aggregate of one row."""
    m = memories.agg(
        F.count_if(F.col("deleted_at").isNull()).alias("memories"),
        F.sum("shown_count").alias("exposures"),
        F.sum("opened_count").alias("opens"),
        F.sum("application_count").alias("applications"),
        F.sum("helpful_count").alias("helpful"),
        F.sum("harmful_count").alias("harmful"),
    )
    serving = catalog.filter("state = 'ready'").select("fingerprint")
    live = memories.filter(F.col("deleted_at").isNull() & current(now))
    e = fresh_marks(marks.join(F.broadcast(serving.limit(1)), "fingerprint", "left_semi"), live).agg(F.count("*").alias("current_entries"))
    c = catalog.agg(*[F.count_if(F.col("state") == s).alias(f"indexes_{s}") for s in ("ready", "building", "retired")])
    u = usage_total.agg(F.sum("n").alias("calls"), F.sum("input_tokens").alias("input_tokens"))
    f = feedback.agg(*[F.count_if(F.col("basis") == b).alias(n) for b, n in (("agent_report", "agent_reported"), ("human", "human_reported"), ("validator", "validator_reported"))])
    out = m
    for x in (e, c, u, f):
        out = out.crossJoin(F.broadcast(x))
    return out


def agent_record(events: DataFrame, links: DataFrame, memories: DataFrame, projects: DataFrame) -> DataFrame:
    """The events of every agent in order, without its first injection, each with a line and the title of the memory it
    is about as that is now; the agent's first link names its project."""
    own = links.select(F.col("nonce").alias("_n"), "agent_id")
    e = events.join(own, F.col("nonce") == F.col("_n")).drop("_n")
    # An aggregate and an anti join: the events of a busy agent need not meet in one task.
    first = e.filter("kind = 'inject'").groupBy("agent_id").agg(F.min("id").alias("id"))
    e = e.join(first, ["agent_id", "id"], "left_anti")
    titles = memories.filter("deleted_at is null").select(F.col("id").alias("k"), "title")
    about = (F.col("k") == F.col("_k")) & F.col("kind").isin("get", "save", "update")
    e = e.join(titles.withColumnRenamed("k", "_k"), about, "left")
    p = links.groupBy(F.col("agent_id").alias("_a")).agg(F.min_by("project_key", F.struct("created_at", "nonce")).alias("project_key"))
    names = projects.select(F.col("key").alias("project_key"), F.col("name").alias("project_name"))
    e = e.join(p.join(names, "project_key", "left"), F.col("agent_id") == F.col("_a"), "left")
    return e.select("agent_id", "id", "kind", describe(F.col("kind"), F.col("k")).alias("line"), "title", "project_name")

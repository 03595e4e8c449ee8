"""Closures over relations, revision history and validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .access import MOST_SOURCES, node, source_edges, too_wide
from .graph import closure, closure_by_pivots, closure_of_many, cut, reach


def sources_of(ids: DataFrame, relations: DataFrame, limit: int = MOST_SOURCES, revisions: bool = False) -> DataFrame:
    """root, id, depth and complete: each of ids(id) and what it derives from. A root with more than limit sources has its
    own row alone, with complete false: nobody could check a part of them and be sure. With revisions, roots are ids(id,
    revision), sources are found at the revisions that the relations name, and `revision` and `root_revision` follow."""
    r = relations.filter("kind = 'derived_from'")
    if revisions:
        edges = r.select(node("from_id", "from_revision").alias("src"), node("to_id", "to_revision").alias("dst"))
        start = ids.select(node("id", "revision").alias("id"))
    else:
        edges, start = r.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")), ids.select("id")
    wide = cut(too_wide(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), limit).distinct())
    fine = closure(start.join(wide, "id", "left_anti"), edges).withColumn("complete", F.lit(True))
    own = start.distinct().join(wide, "id", "left_semi").select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), F.lit(False).alias("complete"))
    seen = fine.unionByName(own)
    if not revisions:
        return seen
    part = lambda c, n: F.split_part(c, F.lit("@"), F.lit(n)).cast("long")
    return seen.select(part("root", 1).alias("root"), part("root", 2).alias("root_revision"), part("id", 1).alias("id"), part("id", 2).alias("revision"), "depth", "complete")


def dependants_edges(relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Who falls with whom: what derives from it, what shares a source with it, and what cites it as memory:id@revision."""
    derived = relations.filter("kind = 'derived_from'").select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    own = evidence.select("memory_id", "source_ref")
    # A shared source becomes a star around its smallest memory, so a source cited n times costs n edges.
    hub = own.filter(~F.col("source_ref").startswith("memory:")).groupBy("source_ref").agg(F.min("memory_id").alias("hub"))
    star = own.join(hub, "source_ref").filter("memory_id <> hub")
    shared = star.select(F.col("hub").alias("src"), F.col("memory_id").alias("dst")).union(star.select(F.col("memory_id").alias("src"), F.col("hub").alias("dst")))
    cited = F.regexp_extract("source_ref", r"^memory:(\d+)@", 1)
    cites = own.filter(F.col("source_ref").startswith("memory:")).select(cited.try_cast("long").alias("src"), F.col("memory_id").alias("dst"))
    return derived.union(shared).union(cites).distinct()


def forget(ids: DataFrame, relations: DataFrame, evidence: DataFrame, limit: int | None = None) -> DataFrame:
    """root, id and depth of everything that goes with each of ids. More than limit rows of one of them is an error, if a
    limit is given."""
    edges = dependants_edges(relations, evidence)
    return closure_of_many(ids, edges) if limit is None else closure(ids, edges, limit)


def forgotten_by_each(ids: DataFrame, relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """root and id of everything that goes with each of ids, as forget() has them, for very many of both."""
    return closure_by_pivots(ids, dependants_edges(relations, evidence))


def forgotten(ids: DataFrame, relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """id and depth of all that goes when ids are forgotten together, one row each, whichever of them takes it along."""
    return reach(ids, dependants_edges(relations, evidence))


def erase(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return table.join(gone.select(F.col("id").alias("_g")).distinct(), F.col(key) == F.col("_g"), "left_anti")


def tombstones(gone: DataFrame, at: Column) -> DataFrame:
    return gone.select(F.lit("memory").alias("kind"), F.col("id").cast("string").alias("identifier"), at.alias("forgotten_at")).distinct()


def propagate(pending: DataFrame, relations: DataFrame) -> DataFrame:
    """Everything that must be checked again once pending(id) are invalid, by distance."""
    edges = relations.filter("kind = 'derived_from'").select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    return reach(pending, edges).filter("depth > 0").select("id", F.col("depth").alias("distance"))


def disclosed(start: DataFrame, exposures: DataFrame, limit: int | None = None) -> DataFrame:
    """root, id and depth of the callers, agents and sessions that each memory may have reached, over typed and directed
    exposures(src, dst) as erasure.exposure_edges() gives them. More than limit rows of one is an error, if a limit is given."""
    return closure_of_many(start, exposures) if limit is None else closure(start, exposures, limit)


def latest_revision(revisions: DataFrame) -> DataFrame:
    return revisions.groupBy("memory_id").agg(F.max("revision").alias("revision"), F.max_by("content", "revision").alias("content"), F.max_by("changed_at", "revision").alias("changed_at"))


def as_of(revisions: DataFrame, at: Column) -> DataFrame:
    """The snapshot that held at a time: newest change not after it; then its own state and validity decide."""
    snap = revisions.filter(F.col("changed_at") <= at).groupBy("memory_id").agg(F.max_by(F.struct("revision", "state", "content", "valid_from", "valid_until"), F.struct("changed_at", "revision")).alias("s"))
    held = (F.col("s.state") == "active") & (F.col("s.valid_from").isNull() | (F.col("s.valid_from") <= at)) & (F.col("s.valid_until").isNull() | (at < F.col("s.valid_until")))
    return snap.filter(held).select("memory_id", "s.revision", "s.content")


def as_of_with_sources(revisions: DataFrame, relations: DataFrame, at: Column) -> DataFrame:
    """as_of() without what derived, at that time, from a source that had no such revision then, had moved on from it, or
    whose snapshot didn't hold."""
    held = as_of(revisions, at)
    edges = source_edges(relations)
    broken = edges.join(held.select(node("memory_id", "revision").alias("src")), "src", "left_anti").select(F.col("dst").alias("id"))
    gone = reach(broken, edges).select(F.col("id").alias("_n"))
    return held.join(gone, node("memory_id", "revision") == F.col("_n"), "left_anti")


def next_boundary(memories: DataFrame, now: Column) -> DataFrame:
    """When the visible set next changes by itself."""
    ends = memories.select(F.col("valid_from").alias("t")).unionByName(memories.select(F.col("valid_until").alias("t")))
    return ends.filter(F.col("t") > now).agg(F.min("t").alias("boundary"))


def next_id(memories: DataFrame, tombstone_rows: DataFrame) -> DataFrame:
    """Ids of forgotten memories are never given again."""
    ids = memories.select("id").unionByName(tombstone_rows.filter("kind = 'memory'").select(F.col("identifier").cast("long").alias("id")))
    return ids.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


def history(revisions: DataFrame, most: int = 100) -> DataFrame:
    """The newest revisions of each memory, newest first."""
    w = Window.partitionBy("memory_id").orderBy(F.desc("revision"))
    return revisions.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def support_until(ids: DataFrame, relations: DataFrame, memories: DataFrame) -> DataFrame:
    """Earliest end of validity among a memory and its sources; complete is false, and the end null, where it has more
    sources than can be checked."""
    seen = sources_of(ids, relations).join(memories.select("id", "valid_until"), "id").groupBy("root")
    return seen.agg(F.when(F.bool_and("complete"), F.min("valid_until")).alias("valid_until"), F.bool_and("complete").alias("complete"))


def visible_evidence(evidence: DataFrame, memories: DataFrame, readable: Column, gone: DataFrame) -> DataFrame:
    """Evidence without forgotten or unreadable sources; a source whose hash has changed is unresolved."""
    e = evidence.join(gone.select("source_ref"), "source_ref", "left_anti").withColumn("_src", F.regexp_extract("source_ref", r"^memory:(\d+)@", 1).try_cast("long"))
    m = memories.select(F.col("id").alias("_id"), "content_hash", readable.alias("_ok"))
    e = e.join(m, F.col("_src") == F.col("_id"), "left").filter(F.col("_src").isNull() | F.coalesce("_ok", F.lit(False)))
    status = F.when(F.col("_src").isNull(), "resolved").when(F.col("source_hash") == F.col("content_hash"), "resolved").otherwise("unresolved")
    return e.select("memory_id", "source_ref", status.alias("status"))

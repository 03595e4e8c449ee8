"""Evidence: resolving citations against their sources, who is touched when a source goes, and a memory in detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import redact
from .access import Access, historical_allowed

EXCERPT_CHARS = 500
MEMORY_REF = r"^memory:([1-9]\d*)@([1-9]\d*)$"
ARTIFACT_REF = r"^artifact:[A-Za-z0-9_-][A-Za-z0-9._-]{0,990}$"


def source_ids(ref: str = "source_ref") -> tuple[Column, Column]:
    """The memory and revision that a reference names, null for others."""
    return tuple(F.regexp_extract(ref, MEMORY_REF, i).try_cast("long") for i in (1, 2))


def forgotten(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """rows(source_ref, ...) with `forgotten`: the source, or the memory that it names, has a tombstone."""
    own = tombstones.filter("kind = 'source'").select(F.col("identifier").alias("_s")).distinct()
    memory = tombstones.filter("kind = 'memory'").select(F.col("identifier").alias("_m")).distinct()
    df = rows.join(own, F.col("source_ref") == F.col("_s"), "left").join(memory, source_ids()[0].cast("string") == F.col("_m"), "left")
    return df.withColumn("forgotten", F.col("_s").isNotNull() | F.col("_m").isNotNull()).drop("_s", "_m")


def sources(memories: DataFrame, revisions: DataFrame, artifacts: DataFrame, access: Access) -> DataFrame:
    """What may be cited: source_ref, hash, content and allow_excerpt of every readable artifact and of every revision of
    a readable live memory whose own namespace may be read, too."""
    m = memories.filter(F.col("deleted_at").isNull() & access.allows("read", F.col("scope"), F.col("project_key"))).select(F.col("id").alias("memory_id"))
    r = revisions.filter(historical_allowed(access, F.col("scope"), F.col("project_key"))).join(m, "memory_id", "left_semi")
    content = F.concat_ws("\n", "title", "content")
    ref = F.concat(F.lit("memory:"), F.col("memory_id").cast("string"), F.lit("@"), F.col("revision").cast("string"))
    rows = r.select(ref.alias("source_ref"), F.sha2(content, 256).alias("hash"), content.alias("content"), F.lit(True).alias("allow_excerpt"))
    a = artifacts.filter(access.allows("read", F.col("scope"), F.col("project_key")) & F.col("source_ref").rlike(ARTIFACT_REF))
    return rows.unionByName(a.select("source_ref", F.sha2("content", 256).alias("hash"), "content", "allow_excerpt"))


def resolve(citations: DataFrame, sources: DataFrame, tombstones: DataFrame) -> DataFrame:
    """status, reason, source_hash and excerpt of each of citations(evidence_id, source_ref, given_hash, include_excerpt):
    unresolved where the source is forgotten, out of reach or not what the given hash says."""
    c = forgotten(citations, tombstones)
    s = sources.select(F.col("source_ref").alias("_ref"), F.col("hash").alias("_hash"), F.col("content").alias("_content"), F.col("allow_excerpt").alias("_allow"))
    c = c.join(s, (F.col("source_ref") == F.col("_ref")) & ~F.col("forgotten"), "left")
    reason = (
        F.when(F.col("forgotten"), "source_forgotten")
        .when(F.col("_ref").isNull(), "source_unavailable")
        .when(F.col("given_hash").isNotNull() & (F.col("given_hash") != F.col("_hash")), "source_hash_mismatch")
    )
    c = c.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "resolved").otherwise("unresolved"))
    excerpt = F.when(F.col("include_excerpt") & F.col("_allow"), F.substring(redact(F.col("_content")), 1, EXCERPT_CHARS))
    return c.select(*[x for x in citations.columns], "status", "reason", F.when(F.col("status") == "resolved", F.col("_hash")).alias("source_hash"), F.when(F.col("status") == "resolved", excerpt).alias("excerpt"))


def affected_by(refs: DataFrame, citations: DataFrame, memories: DataFrame) -> DataFrame:
    """The memories (id, revision) whose present revision cites one of refs(source_ref), each once."""
    c = citations.join(refs.select("source_ref").distinct(), "source_ref", "left_semi").select(F.col("memory_id").alias("id"), "revision")
    return c.join(memories.select("id", "revision"), ["id", "revision"], "left_semi").distinct()


def invalidate(refs: DataFrame, citations: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """When sources change: the citations with those of refs unresolved, and the memories with the affected ones, active
    or candidate, at a new revision that must be checked again."""
    hit = refs.select(F.col("source_ref").alias("_ref")).distinct()
    c = citations.join(hit, F.col("source_ref") == F.col("_ref"), "left")
    c = c.withColumn("status", F.when(F.col("_ref").isNotNull(), "unresolved").otherwise(F.col("status"))).drop("_ref")
    return c, mark_for_recheck(memories, affected_by(refs, citations, memories))


def mark_for_recheck(memories: DataFrame, refs: DataFrame) -> DataFrame:
    """memories with those of refs(id, revision) at a new revision that needs a check: unresolved, not verified."""
    hit = refs.select(F.col("id").alias("_i"), F.col("revision").alias("_r")).distinct()
    df = memories.join(hit, (F.col("id") == F.col("_i")) & (F.col("revision") == F.col("_r")) & F.col("state").isin("active", "candidate"), "left")
    marked = F.col("_i").isNotNull()
    return df.withColumns(
        {
            "state": F.when(marked, "needs_recheck").otherwise(F.col("state")),
            "verification_status": F.when(marked, "unresolved").otherwise(F.col("verification_status")),
            "verified_at": F.when(~marked, F.col("verified_at")),
            "revision": F.col("revision") + marked.cast("long"),
            "index_generation": F.col("index_generation") + marked.cast("long"),
        }
    ).drop("_i", "_r")


def carried_forward(links: DataFrame, refs: DataFrame, key: str = "memory_id") -> DataFrame:
    """links(memory_id, revision, ...) with those of refs(id, revision) repeated at the next revision, as a revision that is
    marked for a check keeps its evidence and relations."""
    hit = refs.select(F.col("id").alias(key), "revision").distinct()
    more = links.join(hit, [key, "revision"], "left_semi").withColumn("revision", F.col("revision") + 1).select(*links.columns)
    return links.unionByName(more).distinct()


def inherited(changes: DataFrame, links: DataFrame) -> DataFrame:
    """memory_id, revision and evidence_id that a change links: what it supplies; nothing more if the claim changed or it
    is a promotion; the source revision's if it restores one; else those of the revision before. changes: memory_id,
    revision (the new one), operation, claim_changed, source_revision, supplied (array)."""
    base = (
        F.when((F.size("supplied") > 0) | (F.col("operation") == "promote"), None)
        .when(F.col("operation") == "restore", F.col("source_revision"))
        .when(~F.col("claim_changed"), F.col("revision") - 1)
    ).cast("long")
    c = changes.withColumn("_from", base)
    given = c.select("memory_id", "revision", F.explode("supplied").alias("evidence_id"))
    old = links.select(F.col("memory_id").alias("_m"), F.col("revision").alias("_r"), "evidence_id")
    kept = c.join(old, (F.col("memory_id") == F.col("_m")) & (F.col("_from") == F.col("_r"))).select("memory_id", "revision", "evidence_id")
    return given.unionByName(kept).distinct()


def cancelled_jobs(jobs: DataFrame, job_sources: DataFrame, gone: DataFrame) -> DataFrame:
    """jobs(id, state) with those that wait or run cancelled where one of their sources(job_id, memory_id, revision) is in
    gone(id, revision)."""
    hit = job_sources.join(gone.select(F.col("id").alias("memory_id"), "revision"), ["memory_id", "revision"], "left_semi").select(F.col("job_id").alias("_j")).distinct()
    df = jobs.join(hit, F.col("id") == F.col("_j"), "left")
    stop = F.col("_j").isNotNull() & F.col("state").isin("queued", "running", "reserved")
    return df.withColumn("state", F.when(stop, "cancelled").otherwise(F.col("state"))).drop("_j")


def detail(memories: DataFrame, revisions: DataFrame, ids: DataFrame, access: Access, most: int = 100) -> DataFrame:
    """One row per readable memory of ids, removed ones too: revision, live, archived, merged_into where that may be read,
    and how many older revisions (the newest `most`) may be read, with the first and last of them."""
    m = memories.join(ids.select("id").distinct(), "id", "left_semi").filter(access.allows("read", F.col("scope"), F.col("project_key")))
    w = Window.partitionBy("memory_id").orderBy(F.desc("revision"))
    r = revisions.join(m.select(F.col("id").alias("memory_id"), F.col("revision").alias("_now")), "memory_id").withColumn("_n", F.row_number().over(w))
    r = r.filter((F.col("_n") <= most) & historical_allowed(access, F.col("scope"), F.col("project_key")) & (F.col("revision") != F.col("_now")))
    r = r.groupBy(F.col("memory_id").alias("_m")).agg(F.count("*").alias("versions"), F.min("revision").alias("oldest"), F.max("revision").alias("newest"))
    out = m.join(r, F.col("id") == F.col("_m"), "left")
    cols = ["id", "revision", F.col("deleted_at").isNull().alias("live"), F.col("archived_at").isNotNull().alias("archived"), F.coalesce("versions", F.lit(0)).alias("versions"), "oldest", "newest"]
    if "merged_into" in memories.columns:
        target = memories.filter(access.allows("read", F.col("scope"), F.col("project_key"))).select(F.col("id").alias("_t"), F.col("revision").alias("target_revision"))
        out = out.join(target, F.col("merged_into") == F.col("_t"), "left")
        cols += [F.when(F.col("deleted_at").isNotNull(), F.col("_t")).alias("merged_into"), F.when(F.col("deleted_at").isNotNull(), F.col("target_revision")).alias("target_revision")]
    return out.select(*cols)

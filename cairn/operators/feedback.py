"""Feedback on memories: which events are taken in, what they count for, and how they are taken back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .access import Access

COUNTERS = ("application_count", "validated_helpful_count", "validated_harmful_count")


def disclosures(events: DataFrame, links: DataFrame) -> DataFrame:
    """retrieval_id, nonce, agent_id, memory_id and revision of every memory that a retrieval showed: the references in the
    JSON detail of events(nonce, detail), whatever else it holds; broken JSON shows nothing."""
    shape = "struct<retrieval:struct<retrievalId:string,memoryRefs:array<struct<id:bigint,revision:bigint>>>>"
    e = events.select("nonce", F.from_json("detail", shape)["retrieval"].alias("r")).filter("r.retrievalId is not null")
    e = e.select("nonce", F.col("r.retrievalId").alias("retrieval_id"), F.explode("r.memoryRefs").alias("m"))
    own = links.select(F.col("nonce").alias("_n"), "agent_id")
    return e.join(own, F.col("nonce") == F.col("_n"), "left").select("retrieval_id", "nonce", "agent_id", F.col("m.id").alias("memory_id"), F.col("m.revision").alias("revision"))


def counter(signal: Column, basis: Column, validated: Column) -> Column:
    """The counter that an event moves: an application counts when validated or said by a human, an assessment when
    validated; null for none."""
    return (
        F.when((signal == "applied") & (validated | (basis == "human")), "application_count")
        .when(validated & (signal == "helpful"), "validated_helpful_count")
        .when(validated & (signal == "harmful"), "validated_harmful_count")
    )


def judged(feedback: DataFrame, shown: DataFrame, memories: DataFrame, evidence: DataFrame, access: Access) -> DataFrame:
    """feedback(producer_id, event_id, retrieval_id, memory_id, revision, signal, basis, nonce, evidence_refs) with
    `outcome`: recorded, duplicate (same event and body), request_conflict (same event, another body), scope_denied (an
    agent that claims more than a report, a memory, evidence or retrieval out of reach) or invalid_input (evidence that
    doesn't resolve); `validated`, and the `counter` that a recorded event moves. evidence: evidence_id, status."""
    refs = F.array_sort(F.array_distinct("evidence_refs"))
    body = F.sha2(F.to_json(F.struct("retrieval_id", "memory_id", "revision", "signal", "basis", refs.alias("refs")), {"ignoreNullFields": "false"}), 256)
    f = feedback.withColumn("_body", body)
    first = Window.partitionBy("producer_id", "event_id").orderBy("seq")
    f = f.withColumns({"_n": F.row_number().over(first), "_first": F.first("_body").over(first)})
    m = memories.filter(access.allows("read", F.col("scope"), F.col("project_key"))).select(F.col("id").alias("memory_id"), F.lit(True).alias("_readable"))
    f = f.join(m, "memory_id", "left")
    # Evidence of an event: how many of its references there are, and how many resolve.
    e = f.select("producer_id", "event_id", "seq", F.explode(refs).alias("evidence_id")).join(evidence.select("evidence_id", "status"), "evidence_id")
    e = e.groupBy(F.col("producer_id").alias("_p"), F.col("event_id").alias("_e"), F.col("seq").alias("_q")).agg(F.count("*").alias("_there"), F.count_if(F.col("status") == "resolved").alias("_resolved"))
    f = f.join(e, (F.col("producer_id") == F.col("_p")) & (F.col("event_id") == F.col("_e")) & (F.col("seq") == F.col("_q")), "left")
    s = shown.select("retrieval_id", "memory_id", "revision", "nonce").distinct().withColumn("_shown", F.lit(True))
    if access.owner:
        s = s.drop("nonce").distinct()
    f = f.join(s, [c for c in ("retrieval_id", "memory_id", "revision", "nonce") if c in s.columns], "left")
    there, resolved = F.coalesce("_there", F.lit(0)), F.coalesce("_resolved", F.lit(0))
    outcome = (
        F.when(F.col("_readable").isNull() | ((F.col("basis") != "agent_report") & F.lit(not access.owner)) | (there != F.size(refs)), "scope_denied")
        .when(resolved != there, "invalid_input")
        .when((F.col("_n") > 1) & (F.col("_body") != F.col("_first")), "request_conflict")
        .when(F.col("_n") > 1, "duplicate")
        .when(F.col("_shown").isNull(), "scope_denied")
        .otherwise("recorded")
    )
    f = f.withColumn("outcome", outcome).withColumn("validated", (F.col("basis") == "validator") & (F.col("outcome") == "recorded"))
    moved = F.when(F.col("outcome") == "recorded", counter(F.col("signal"), F.col("basis"), F.col("validated")))
    return f.withColumn("counter", moved).drop("_body", "_n", "_first", "_readable", "_p", "_e", "_q", "_there", "_resolved", "_shown")


def retracted(feedback: DataFrame, evidence_ids: DataFrame, mode: str) -> DataFrame:
    """Recorded feedback(event_id, validated, evidence_refs, ...) after evidence is lost. invalidate: assessments that
    rest on it are no longer validated; forget: they go altogether."""
    hit = feedback.select("event_id", F.explode("evidence_refs").alias("evidence_id")).join(evidence_ids.select("evidence_id").distinct(), "evidence_id", "left_semi")
    hit = hit.select(F.col("event_id").alias("_e")).distinct()
    if mode == "forget":
        return feedback.join(hit, F.col("event_id") == F.col("_e"), "left_anti")
    df = feedback.join(hit, F.col("event_id") == F.col("_e"), "left")
    return df.withColumn("validated", F.col("validated") & F.col("_e").isNull()).drop("_e")


def counters(feedback: DataFrame, memories: DataFrame) -> DataFrame:
    """id and the three counters over the feedback that stands: of active, live memories at the revision it was about."""
    m = memories.filter(F.col("deleted_at").isNull() & (F.col("state") == "active")).select(F.col("id").alias("memory_id"), "revision")
    f = feedback.withColumn("_c", counter(F.col("signal"), F.col("basis"), F.col("validated"))).filter("_c is not null").join(m, ["memory_id", "revision"])
    return f.groupBy(F.col("memory_id").alias("id")).agg(*[F.count_if(F.col("_c") == c).alias(c) for c in COUNTERS])


def current_hints(memories: DataFrame, counted: DataFrame, pending: DataFrame) -> DataFrame:
    """memories with their counters worked out anew from counted() while an invalidation is pending, else as stored. What
    is pending is one row, so both cases are one plan."""
    names = {"application_count": "application_count", "helpful_count": "validated_helpful_count", "harmful_count": "validated_harmful_count"}
    some = pending.agg((F.count("*") > 0).alias("_some"))
    c = counted.select(F.col("id").alias("_i"), *[F.col(v).alias(f"_{k}") for k, v in names.items()])
    df = memories.join(c, F.col("id") == F.col("_i"), "left").crossJoin(F.broadcast(some))
    return df.withColumns({k: F.when(F.col("_some"), F.coalesce(f"_{k}", F.lit(0))).otherwise(F.col(k)) for k in names}).drop("_i", "_some", *[f"_{k}" for k in names])

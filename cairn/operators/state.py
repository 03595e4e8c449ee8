"""State that events leave behind: counters, settings, vectors, ends of sessions, generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bumped(memories: DataFrame, calls: DataFrame) -> DataFrame:
    """memories with the counters that calls(call_id, kind, ids, at) move: shown or opened goes up by one for each call that
    names a memory, however often it names it, and the time of its last retrieval follows. An unknown id moves nothing."""
    c = calls.select("call_id", "kind", "at", F.explode(F.array_distinct("ids")).alias("_i"))
    c = c.groupBy("_i").agg(F.count_if(F.col("kind") == "shown").alias("_shown"), F.count_if(F.col("kind") == "opened").alias("_opened"), F.max("at").alias("_at"))
    df = memories.join(c, F.col("id") == F.col("_i"), "left")
    df = df.withColumns({x: F.col(x) + F.coalesce(f"_{x[:-6]}", F.lit(0)) for x in ("shown_count", "opened_count")})
    return df.withColumn("last_retrieved_at", F.col("_at")).drop("_i", "_shown", "_opened", "_at")


def kept(memories: DataFrame, events: DataFrame) -> DataFrame:
    """memories with kept_at moved to the newest of events(id, at) that keep them; live ones only can be kept."""
    e = events.groupBy(F.col("id").alias("_i")).agg(F.max("at").alias("_at"))
    df = memories.join(e, F.col("id") == F.col("_i"), "left")
    newer = F.when(F.col("deleted_at").isNull(), F.greatest("kept_at", "_at")).otherwise(F.col("kept_at"))
    return df.withColumn("kept_at", newer).drop("_i", "_at")


def removed(memories: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """memories after events(id, at, hard): a soft removal archives a live row at its first time, a hard one takes the row
    out; the ids that are gone for good come second."""
    e = events.groupBy(F.col("id").alias("_i")).agg(F.min(F.when(~F.col("hard"), F.col("at"))).alias("_soft"), F.max("hard").alias("_hard"))
    df = memories.join(e, F.col("id") == F.col("_i"), "left")
    gone = df.filter(F.coalesce("_hard", F.lit(False))).select("id")
    soft = F.col("_soft").isNotNull() & F.col("deleted_at").isNull()
    df = df.filter(~F.coalesce("_hard", F.lit(False)))
    out = {"state": F.when(soft, "archived").otherwise(F.col("state")), "archived_at": F.when(soft, F.col("_soft")).otherwise(F.col("archived_at")), "deleted_at": F.when(soft, F.col("_soft")).otherwise(F.col("deleted_at"))}
    return df.withColumns(out).drop("_i", "_soft", "_hard"), gone


def patched(memories: DataFrame, patches: DataFrame) -> DataFrame:
    """memories with `change` (text, metadata, unchanged or null) after patches(id, title, content, type, pinned), of which
    nulls change nothing: a new text makes a new revision and a new generation of its index, a new type or pin a new
    revision only."""
    p = patches.select(F.col("id").alias("_i"), *[F.col(c).alias(f"_{c}") for c in ("title", "content", "type", "pinned")])
    df = memories.join(p, F.col("id") == F.col("_i"), "left")

    def moved(c: str) -> Column:
        return F.coalesce(F.col(f"_{c}") != F.col(c), F.lit(False))

    text, other = moved("title") | moved("content"), moved("type") | moved("pinned")
    df = df.withColumn("change", F.when(text, "text").when(other, "metadata").when(F.col("_i").isNotNull(), "unchanged"))
    new = {c: F.coalesce(f"_{c}", c) for c in ("title", "content", "type", "pinned")}
    new["revision"] = F.col("revision") + F.col("change").isin("text", "metadata").cast("long")
    new["index_generation"] = F.col("index_generation") + F.coalesce(F.col("change") == "text", F.lit(False)).cast("long")
    new["revision"] = F.coalesce(new["revision"], "revision")
    return df.withColumns(new).drop("_i", "_title", "_content", "_type", "_pinned")


def written(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """vectors(id, fingerprint, ...) with those of new in place of the same id and index."""
    key = ["id", "fingerprint"]
    return vectors.join(new.select(*key), key, "left_anti").unionByName(new)


def dropped(vectors: DataFrame, ids: DataFrame, fingerprint: str | None = None) -> DataFrame:
    """vectors without those of ids: in one index, or in every one."""
    gone = ids.select(F.col("id").alias("_i")).distinct()
    on = F.col("id") == F.col("_i")
    return vectors.join(gone, on if fingerprint is None else on & (F.col("fingerprint") == fingerprint), "left_anti")


def ended(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """sessions with summary and ended_at from events(id, seq, summary, ended_at): the last summary that there is, and the
    first end."""
    e = events.groupBy(F.col("id").alias("_i")).agg(
        F.max_by("summary", F.when(F.col("summary").isNotNull(), F.col("seq"))).alias("summary"),
        F.min_by("ended_at", F.when(F.col("ended_at").isNotNull(), F.col("seq"))).alias("ended_at"),
    )
    return sessions.join(e, F.col("id") == F.col("_i"), "left").drop("_i")


def settings(writes: DataFrame) -> DataFrame:
    """key and value after writes(seq, key, value): the last one of each key."""
    return writes.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


#: Operations after which retrievals may give something else (fixed values).
CONTENT_OPERATIONS = ("create", "propose", "update", "archive", "reject", "restore", "promote", "merge", "supersede", "undo_merge", "forget")


def generation(receipts: DataFrame) -> DataFrame:
    """One row: how often the store's content has changed, and the last operation that did it. Replays, refusals and
    changes of nothing don't count."""
    done = receipts.filter(F.col("status").isin("created", "updated", "forgotten") & F.col("operation").isin(*CONTENT_OPERATIONS))
    return done.agg(F.count("*").alias("generation"), F.max("seq").alias("last_seq"))


def valid_interval(start: Column, end: Column) -> Column:
    """Whether an interval of validity is one: open ends are fine, and it must not end before it has begun."""
    return F.coalesce(start < end, F.lit(True))


def inserted(memories: DataFrame, drafts: DataFrame, next_id: DataFrame, now: Column) -> DataFrame:
    """memories with drafts(seq, ...) as new rows, numbered in their order from next_id(next_id) on, at revision 1 and with
    counters of zero. A batch of drafts is what one caller sends, so one task numbers it."""
    from pyspark.sql import Window

    d = drafts.crossJoin(F.broadcast(next_id)).withColumn("id", F.col("next_id") + F.row_number().over(Window.orderBy("seq")) - 1)
    given = {"updated_at": now, "revision": F.lit(1), "index_generation": F.lit(1), **{c: F.lit(0) for c in memories.columns if c.endswith("_count")}}
    out = [(F.col(c) if c in d.columns else given.get(c, F.lit(None))).cast(memories.schema[c].dataType).alias(c) for c in memories.columns]
    return memories.unionByName(d.select(*out))


def snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of after whose revision is new or has moved on, as revisions to keep (memory_id, revision and all fields in
    JSON); a change of counters alone makes none."""
    old = before.select(F.col("id").alias("_i"), F.col("revision").alias("_r"))
    a = after.join(old, F.col("id") == F.col("_i"), "left").filter(F.col("_r").isNull() | (F.col("revision") > F.col("_r")))
    return a.select(F.col("id").alias("memory_id"), "revision", F.to_json(F.struct(*after.columns)).alias("snapshot"))


def reset_counters(before: DataFrame, after: DataFrame, counters: tuple[str, ...] = ("application_count", "helpful_count", "harmful_count")) -> DataFrame:
    """after with the counters of assessed use back at zero where the revision has moved on: they belong to a revision."""
    old = before.select(F.col("id").alias("_i"), F.col("revision").alias("_r"))
    a = after.join(old, F.col("id") == F.col("_i"), "left")
    return a.withColumns({c: F.when(F.col("revision") > F.col("_r"), F.lit(0)).otherwise(F.col(c)) for c in counters}).drop("_i", "_r")

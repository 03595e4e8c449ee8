"""Sessions: folding turns, versions, recency, search and review timing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip, is_usable_reply, redact

PROMPT_CHARS, REPLY_CHARS, FILES_KEPT = 1500, 2500, 50
SESSION_FIELDS = ("id", "project_key", "provider", "title", "first_prompt", "last_prompt", "last_reply", "files", "turns", "started_at", "updated_at")
SESSION_WEIGHTS = {"title": 1.0, "first_prompt": 1.0, "last_prompt": 1.0, "last_reply": 1.0}


def fold_turns(turns: DataFrame) -> DataFrame:
    """One row per agent of turns(agent_id, seq, ts, project_key, provider, title, user_text, assistant_text, files).

    Turns without a usable reply don't count. The first turn alone sets the first prompt; later values replace title,
    last prompt and reply where they are there; the project is set once; of the files the last 50 distinct ones stay in
    order of first sighting (of a first turn the first 50)."""
    t = turns.filter(is_usable_reply(F.col("assistant_text"))).withColumns(
        {"user_text": clip(redact(F.col("user_text")), PROMPT_CHARS), "assistant_text": clip(redact(F.col("assistant_text")), REPLY_CHARS)}
    )

    def at(c: str):
        return F.struct("seq", F.col(c).alias("v"))

    def last(c: str):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))

    s = t.groupBy(F.col("agent_id").alias("id")).agg(
        F.min_by("project_key", F.when(F.col("project_key").isNotNull(), F.col("seq"))).alias("project_key"),
        F.min(at("provider"))["v"].alias("provider"),
        last("title").alias("title"),
        F.min(at("user_text"))["v"].alias("first_prompt"),
        last("user_text").alias("last_prompt"),
        last("assistant_text").alias("last_reply"),
        F.slice(F.min(at("files"))["v"], 1, FILES_KEPT).alias("_first"),
        F.count("*").alias("turns"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("updated_at"),
    )
    files = F.when(F.col("turns") == 1, F.col("_first")).otherwise(F.coalesce("_files", F.array().cast("array<string>")))
    return s.join(_files(t), "id", "left").withColumn("files", files).select(*SESSION_FIELDS)


def _files(turns: DataFrame) -> DataFrame:
    """id and _files: the last FILES_KEPT distinct files of each agent in order of first sighting. Files meet by name and a
    rank limit cuts them in each task, so no more of an agent's come together."""
    start = turns.groupBy("agent_id").agg(F.min("seq").alias("_s"))
    f = turns.select("agent_id", "seq", F.posexplode("files").alias("pos", "file")).join(start, "agent_id")
    f = f.filter((F.col("seq") > F.col("_s")) | (F.col("pos") < FILES_KEPT)).groupBy("agent_id", "file").agg(F.min(F.struct("seq", "pos")).alias("k"))
    newest = Window.partitionBy("agent_id").orderBy(F.desc("k"))
    f = f.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= FILES_KEPT)
    return f.groupBy(F.col("agent_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "file"))), lambda x: x["file"]).alias("_files"))


def version(sessions: DataFrame) -> DataFrame:
    """A digest of all fields of a session, for comparing snapshots."""
    return sessions.withColumn("version", F.sha2(F.to_json(F.struct(*SESSION_FIELDS), {"ignoreNullFields": "false"}), 256))


def recent(sessions: DataFrame, limit: int, exclude: str | None = None) -> DataFrame:
    """The newest sessions of each project, but for one."""
    df = sessions if exclude is None else sessions.filter(F.col("id").cast("string") != exclude)
    w = Window.partitionBy("project_key").orderBy(F.desc("updated_at"), "id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def search_sessions(sessions: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """query_id, id, rank and score = 0.5 / (60 + rank)."""
    from .search import bm25, top

    return top(bm25(sessions, terms, SESSION_WEIGHTS), k).select("query_id", "id", "rank", (0.5 / (60 + F.col("rank"))).alias("score"))


def distinct_turns(turns: DataFrame) -> DataFrame:
    """First sighting of each native turn key."""
    return turns.withColumn("turn_key", F.sha2(F.to_json(F.array(F.col("agent_id").cast("string"), F.col("native_turn").cast("string"))), 256)).groupBy("turn_key").agg(
        F.min("seq").alias("seq"), F.count("*").alias("sightings")
    )


def latest_turn(timeline: DataFrame) -> DataFrame:
    """Of timeline(agent_id, idx, kind, text, file): the items from the last user message on, as its first text, the last
    reply that is not empty, and the edited files."""
    user = F.max(F.when(F.col("kind") == "user_message", F.col("idx"))).over(Window.partitionBy("agent_id"))
    t = timeline.withColumn("_from", user).filter(F.col("idx") >= F.col("_from"))
    return t.groupBy("agent_id").agg(
        F.min_by("text", F.when((F.col("kind") == "user_message"), F.col("idx"))).alias("user_text"),
        F.max_by("text", F.when((F.col("kind") == "assistant_message") & (F.trim("text") != ""), F.col("idx"))).alias("reply"),
        F.array_sort(F.collect_set("file")).alias("files"),
    )


def reviews_due(turns: DataFrame, idle_seconds: int, every: int, least: int = 2) -> DataFrame:
    """agent_id, seq and cause of the reviews that turns(agent_id, seq, ts) call for: after a gap (or at the end) once two
    turns are done since the last, or at every so many turns."""
    w = Window.partitionBy("agent_id").orderBy("seq")
    gap = F.unix_timestamp(F.lead("ts").over(w)) - F.unix_timestamp("ts")
    t = turns.withColumn("idle", gap.isNull() | (gap >= idle_seconds))
    # Turns are counted from the last idle gap on; a review that counting brings restarts the count by itself.
    t = t.withColumn("_run", F.sum(F.col("idle").cast("int")).over(w) - F.col("idle").cast("int"))
    t = t.withColumn("_n", F.row_number().over(Window.partitionBy("agent_id", "_run").orderBy("seq")))
    since = F.col("_n") - F.floor((F.col("_n") - 1) / every) * every
    counted = F.col("_n") % every == 0
    cause = F.when(counted, "turns").when(F.col("idle") & (since >= least), "idle")
    return t.withColumn("cause", cause).filter("cause is not null").select("agent_id", "seq", "cause")


def prune(sessions: DataFrame, events: DataFrame, links: DataFrame, cutoff) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions and events from the cutoff on, and links that are newer or still have events."""
    kept = events.filter(F.col("created_at") >= cutoff)
    alive = kept.select(F.col("nonce").alias("_n")).distinct()
    old = links.filter(F.col("created_at") < cutoff).join(alive, F.col("nonce") == F.col("_n"), "left_semi")
    return sessions.filter(F.col("updated_at") >= cutoff), kept, links.filter(F.col("created_at") >= cutoff).unionByName(old)


def list_sessions(sessions: DataFrame, limit: int, project: str | None = None, terms: DataFrame | None = None) -> DataFrame:
    """id and rank of sessions, of one project or of all: the newest ones, or with terms(query_id, term) the best by
    keywords. Statistics of words cover all sessions, the project's alone are ranked."""
    from .search import bm25, top

    own = sessions if project is None else sessions.filter(F.col("project_key") == project)
    if terms is None:
        rows = own.orderBy(F.desc("updated_at"), "id").limit(limit)
        return rows.select("id", F.row_number().over(Window.orderBy(F.desc("updated_at"), "id")).alias("rank"))
    return top(bm25(sessions, terms, SESSION_WEIGHTS).join(own.select("id"), "id", "left_semi"), limit).select("id", "rank")


def visible_sessions(sessions: DataFrame, ids: DataFrame, access, tombstones: DataFrame, links: DataFrame | None = None, scope: str = "all") -> DataFrame:
    """The sessions of a list of ids that may be read."""
    from .access import session_filter

    return session_filter(sessions, access, tombstones, scope, links).join(ids.select("id").distinct(), "id", "left_semi")

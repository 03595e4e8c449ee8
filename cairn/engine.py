"""The calls of the store in one place, over its tables. Each gives a DataFrame that runs when it is read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import access as ac
from .operators import context, erasure, feedback, lineage, mutations, policy, provenance, search, sessions, status, upkeep, usage
from .operators.access import Access
from .operators.graph import cut
from .sources.embedder import hash_embedding
from .sources.rewrite import erase_everywhere


@dataclass
class Engine:
    """tables: memories, revisions, relations, sessions, links, audit, usage, feedback, citations, artifacts, tombstones,
    vectors, marks, catalog, projects and pending, as the operators describe them; a call needs only those that it reads.
    now is the time that every answer is given for."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    now: Column
    policy: policy.Policy = policy.Policy()
    embed: Callable[[Column], Column] = hash_embedding

    @classmethod
    def over(cls, spark: SparkSession, folder: str) -> Engine:
        """An engine over the tables that derive from a folder of test tables."""
        from .plans import adapter as ad

        names = "memories revisions relations links audit usage feedback citations artifacts tombstones vectors marks catalog projects pending".split()
        tables = {n: getattr(ad, n)(spark, folder) for n in names}
        tables["sessions"] = sessions.version(sessions.fold_turns(ad.turns(spark, folder)))
        return cls(spark, tables, ad.NOW())

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self.tables:
            raise AttributeError(name)
        return self.tables[name]

    # ---- reading

    def current(self, access: Access, **selection) -> DataFrame:
        """The memories that may be read and hold now, none of whose sources is out of date."""
        rows = self.memories.filter(access.memory_filter(self.now, **selection))
        return ac.without_invalid_sources(rows, ac.out_of_date(self.memories, self.relations, self.now))

    def memory_search(self, access: Access, query: str, **bounds) -> DataFrame:
        return search.memory_search(self.memories, self.relations, access, search.resolved(query, **bounds), self.now, self.embed, self.tables.get("vectors"))

    def memory_get(self, access: Access, ids: list[int]) -> DataFrame:
        """The current memories of some ids, with what they cite."""
        wanted = self.spark.createDataFrame([(i,) for i in ids], "id long")
        cited = context.citations_of(self.evidence(access), True).select(F.col("memory_id").alias("_m"), "cited")
        return self.current(access).join(wanted, "id", "left_semi").join(cited, F.col("id") == F.col("_m"), "left").drop("_m")

    def memory_context(self, access: Access, query: str | None = None, profile: str | None = None, **request) -> DataFrame:
        """One row: the text of a context for a caller, and its counts. Pins, preferences, what the query finds, the newest
        of the project and of all, then the project's sessions, under one limit for all of them, packed under the policy's."""
        r = policy.resolve(self.policy, profile, **request)
        limits = context.Limits.of(r)
        seen = self.current(access, kinds=list(r.kinds))
        if query:
            found = self.memory_search(access, query, limit=3 * self.policy.task_matches, kinds=list(r.kinds)).select("id", "rank", F.lit(True).alias("matches"))
        else:
            found = self.memories.limit(0).select("id", F.lit(1).alias("rank"), F.lit(True).alias("matches"))
        episodes = "episode" in r.kinds and access.project is not None
        caps = {"pins": self.policy.max_pinned, "task": self.policy.task_matches, "project": self.policy.project_memories, "global": self.policy.global_memories, "sessions": self.policy.recent_sessions if episodes else 0}
        may = ac.session_filter(self.sessions, access, self.tombstones) if "tombstones" in self.tables else self.sessions
        chosen = context.collected(seen, may, found, access.project, caps, limits.max_candidates)
        cited = context.citations_of(self.evidence(access), r.detail == "full").select(F.col("memory_id").alias("_m"), "cited")
        m = chosen.filter("kind = 'memory'").select(F.col("id").cast("long").alias("id"), "stage", "rank").join(seen, "id").join(cited, F.col("id") == F.col("_m"), "left")
        task = F.col("stage") == 3
        section = F.when(F.col("pinned"), "Pinned").when(F.col("record_kind") == "preference", "Preferences").when(task, "Task memories").otherwise("Other memories")
        entries = m.select(
            F.concat(F.lit("memory:"), F.col("id").cast("string")).alias("key"),
            context.entry_text({c: F.col(c) for c in context.ENTRY_COLUMNS}, F.col("cited"), r.detail).alias("text"),
            section.alias("section"),
            context.priority(F.col("pinned"), F.col("record_kind"), task).alias("priority"),
            (1.0 / F.col("rank")).alias("score"),
            F.coalesce("topic_key", F.lower("title")).alias("diversity_key"),
            "pinned",
        )
        recent = may.join(chosen.filter("kind = 'session'").select(F.col("id").alias("_s")), F.col("id").cast("string") == F.col("_s"), "left_semi")
        entries = entries.unionByName(context.session_entries(recent, r.detail)).withColumn("request_id", F.lit(0).cast("long"))
        reserved = (r.reserved["chars"], r.reserved["bytes"], r.reserved["tokens"])
        return context.pack(entries, limits, reserved, frame=context.Frame(access.project))

    def evidence(self, access: Access) -> DataFrame:
        """Citations with their status as the caller may see it."""
        s = provenance.sources(self.memories, self.revisions, self.artifacts, access)
        return provenance.resolve(self.citations, s, self.tombstones)

    def detail(self, access: Access, ids: DataFrame) -> DataFrame:
        return provenance.detail(self.memories, self.revisions, ids, access)

    def historical(self, at: Column) -> DataFrame:
        return lineage.as_of_with_sources(self.revisions, self.relations, at)

    def status(self) -> DataFrame:
        return status.snapshot(self.memories, self.marks, self.catalog, usage.tokens(self.usage), self.feedback, self.now)

    def agent_audit(self, links: DataFrame | None = None) -> DataFrame:
        return status.agent_record(self.audit, links if links is not None else self.links.withColumn("project_key", F.lit(None).cast("string")), self.memories, self.projects)

    # ---- changing

    @staticmethod
    def memory_mutate(requests: DataFrame, state: DataFrame | None = None, allowed: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
        """Receipts of a log of requests, one for each, and the state that they leave on top of what earlier calls left."""
        return mutations.fold_onto(requests, state, allowed)

    def memory_save(self, requests: DataFrame, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """memory_mutate() for requests that create; others are refused."""
        return self.memory_mutate(requests, state, ("create", "propose"))

    def memory_update(self, requests: DataFrame, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """memory_mutate() for requests that change a memory and leave it there; others are refused."""
        return self.memory_mutate(requests, state, ("update", "promote", "reject", "restore", "merge", "supersede", "undo_merge"))

    def memory_delete(self, requests: DataFrame, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """memory_mutate() for requests that take a memory out; others are refused."""
        return self.memory_mutate(requests, state, ("archive", "forget"))

    def forget(self, ids: DataFrame, shown: DataFrame, principal: str = "owner") -> tuple[dict[str, DataFrame], DataFrame]:
        """All tables without ids and what goes with them, and the tombstones that remain. shown: memory_id, nonce."""
        exposures = erasure.exposure_edges(shown, self.links)
        what = erasure.plan(ids, self.relations, self.citations, exposures)
        return erasure.erased(self.tables, what), erasure.tombstones(what, self.now, principal)

    def forget_on_disk(self, ids: DataFrame, shown: DataFrame, folders: dict[str, list[str]], principal: str = "owner") -> tuple[list[dict], DataFrame]:
        """What forget() leaves out of the tables goes from their files too: from every version and backup in the folders
        that are named for a table. Returns what was done by file folder, and the tombstones to keep."""
        exposures = erasure.exposure_edges(shown, self.links)
        what = erasure.plan(ids, self.relations, self.citations, exposures)
        stones = cut(erasure.tombstones(what, self.now, principal))
        gone = {k: cut(what.of(k)) for k in {k for c in erasure.NAMES.values() for k in c.values()}}
        return erase_everywhere(self.spark, folders, gone, erasure.NAMES), stones

    def forget_source(self, source_ref: str, shown: DataFrame, principal: str = "owner") -> tuple[dict[str, DataFrame], DataFrame]:
        """forget() for all memories that cite a source, and the source with them. Doing it again changes nothing."""
        refs = self.spark.createDataFrame([(source_ref,)], "source_ref string")
        exposures = erasure.exposure_edges(shown, self.links)
        what = erasure.with_sources(erasure.plan(erasure.citing(refs, self.citations), self.relations, self.citations, exposures), refs)
        return erasure.erased(self.tables, what), erasure.tombstones(what, self.now, principal)

    def record_feedback(self, access: Access, events: DataFrame, shown: DataFrame) -> DataFrame:
        return feedback.judged(events, shown, self.memories, self.evidence(access).select("evidence_id", "status"), access)

    def upkeep(self, dismissed: DataFrame, k: int = 6, threshold: float = 0.9) -> DataFrame:
        """Candidate pairs of duplicates among the live rows, with their conflicts."""
        live = self.memories.filter(Access(True).memory_filter(self.now))
        pairs = upkeep.candidate_pairs(upkeep.near_everywhere(self.vectors, k, threshold), upkeep.same_topic_pairs(live), live, dismissed)
        return upkeep.pair_conflicts(pairs, live)

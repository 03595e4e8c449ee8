"""Row-level authorisation and lifecycle predicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut, reach

AGENT_OPERATIONS = ("read", "write", "delete")


@dataclass(frozen=True)
class Access:
    """Who asks: an owner (perhaps looking at one project) or an agent of a project (or of none)."""

    owner: bool
    project: str | None = None

    def allows(self, operation: str, scope: Column, project_key: Column) -> Column:
        if self.owner:
            return F.lit(True)
        if operation not in AGENT_OPERATIONS:
            return F.lit(False)
        return (scope == "global") | F.coalesce(project_key == self.project, F.lit(False))

    def reach(self, scope: str) -> tuple[bool, str]:
        """(global rows, projects: none, one or every) for scope global, project or all."""
        if self.owner and self.project is None:
            return scope != "project", "none" if scope == "global" else "every"
        return scope != "project", "none" if scope == "global" or self.project is None else "one"

    def namespace(self, scope: str = "all") -> Column:
        shared, projects = self.reach(scope)
        out = F.lit(False)
        if shared:
            out |= F.col("scope") == "global"
        if projects == "every":
            out |= F.col("scope") == "project"
        if projects == "one":
            out |= F.coalesce(F.col("project_key") == self.project, F.lit(False))
        return out

    def memory_filter(self, now: Column, scope: str = "all", types: list[str] | None = None, kinds: list[str] | None = None) -> Column:
        """One predicate that the scan can take in; an empty list of kinds lets nothing through."""
        out = F.col("deleted_at").isNull() & current(now) & self.namespace(scope)
        if types is not None:
            out &= F.col("type").isin(*types)
        if kinds is not None:
            out &= F.col("record_kind").isin(*kinds) if kinds else F.lit(False)
        return out


def current(now: Column) -> Column:
    """Active, and inside the half-open interval of validity."""
    return (
        (F.col("state") == "active")
        & (F.col("valid_from").isNull() | (F.col("valid_from") <= now))
        & (F.col("valid_until").isNull() | (now < F.col("valid_until")))
    )


#: Sources beyond which a memory counts as out of date, as nobody could check them all.
MOST_SOURCES = 1024


def node(id_: str, revision: str) -> Column:
    """A memory at one of its revisions, as a node of the graph of sources."""
    return F.concat(F.col(id_).cast("string"), F.lit("@"), F.col(revision).cast("string"))


def source_edges(relations: DataFrame) -> DataFrame:
    """src (the source) and dst (what derives from it), both at the revisions that the relation names."""
    r = relations.filter("kind = 'derived_from'")
    return r.select(node("to_id", "to_revision").alias("src"), node("from_id", "from_revision").alias("dst"))


def out_of_date(memories: DataFrame, relations: DataFrame, now: Column) -> DataFrame:
    """id and revision of what derives, at any distance, from a source that is gone, has moved on to another revision or
    isn't current, or from more than MOST_SOURCES sources. Starts from the sources that fail and follows the edges, so the
    work follows what is out of date and not all chains; only widths are counted for every memory."""
    edges = source_edges(relations)
    held = memories.filter(F.col("deleted_at").isNull() & current(now)).select(node("id", "revision").alias("src"))
    broken = edges.join(held, "src", "left_anti").select(F.col("dst").alias("id")).distinct()
    bad = reach(broken, edges).select("id")
    wide = too_wide(edges, MOST_SOURCES)
    gone = bad.union(wide).distinct()
    return gone.select(F.split_part("id", F.lit("@"), F.lit(1)).cast("long").alias("id"), F.split_part("id", F.lit("@"), F.lit(2)).cast("long").alias("revision"))


def too_wide(edges: DataFrame, most: int) -> DataFrame:
    """id of the nodes with more than `most` ancestors over edges(src, dst).

    Each node gets two bounds from its sources, once all of those have theirs: at most the sum of theirs and themselves, at
    least the largest of theirs and one more, or the number of its own sources. What is left in cycles is walked, and gets
    exact numbers. Where the lower bound passes, so does everything below; only nodes between the bounds are walked."""
    e = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    nothing = e.select(F.col("dst").alias("id")).filter(F.lit(False))
    if e.count() <= most:  # so few edges can't make it
        return nothing
    cap = most + 1
    need = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("need"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("got", "high", "low")]
    start = e.select(F.col("src").alias("id")).join(need, "id", "left_anti").distinct().select("id", F.lit(0).cast("long").alias("need"), *zero)
    # One table for what has its bounds (step: in which round) and what waits for them.
    state = cut(start.withColumn("step", F.lit(0)).union(need.select("id", "need", *zero, F.lit(None).cast("int").alias("step"))))
    step = 0
    while True:
        moved = state.filter(F.col("step") == step)
        if moved.isEmpty():
            waiting = state.filter("step is null").select("id")
            if waiting.isEmpty():
                break
            state = cut(_cycles_settled(state, _core(waiting, e), e, cap, step + 1))
        else:
            push = moved.join(e, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("_id")).agg(F.count("*").alias("_got"), F.sum(F.col("high") + 1).alias("_high"), (F.max("low") + 1).alias("_low"))
            next_ = state.join(push, F.col("id") == F.col("_id"), "left")
            open_, got = F.col("step").isNull(), F.col("got") + F.coalesce("_got", F.lit(0))
            ready = open_ & (got == F.col("need"))
            state = cut(
                next_.select(
                    "id", "need", F.when(open_, got).otherwise(F.col("got")).alias("got"),
                    F.when(open_, F.least(F.lit(cap), F.col("high") + F.coalesce("_high", F.lit(0)))).otherwise(F.col("high")).alias("high"),
                    F.when(open_, F.least(F.lit(cap), F.greatest("low", F.coalesce("_low", F.lit(0)), "need"))).otherwise(F.col("low")).alias("low"),
                    F.when(ready, step + 1).otherwise(F.col("step")).alias("step"),
                )
            )
        step += 1
    sure = state.filter(F.col("low") > most).select("id")
    if state.filter(F.col("high") > most).isEmpty():
        return nothing
    wide = reach(sure, e).select("id")
    between = state.filter((F.col("high") > most) & (F.col("low") <= most)).select("id").join(wide, "id", "left_anti")
    return wide.union(ancestors(between, e, cap).filter(F.col("n") > most).select("id"))


def _core(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of nodes that lie in cycles or between them: what has neither sources nor dependants left goes."""
    core, n = cut(nodes), nodes.count()
    while True:
        inner = edges.join(core.select(F.col("id").alias("src")), "src", "left_semi").join(core.select(F.col("id").alias("dst")), "dst", "left_semi")
        core = cut(inner.select(F.col("src").alias("id")).distinct().intersect(inner.select(F.col("dst").alias("id")).distinct()))
        before, n = n, core.count()
        if n == before:
            return core


def _cycles_settled(state: DataFrame, core: DataFrame, edges: DataFrame, cap: int, step: int) -> DataFrame:
    """state in which the nodes of the core have the exact numbers of their ancestors."""
    exact = ancestors(core, edges, cap).select(F.col("id").alias("_id"), F.col("n").alias("_n"))
    df = state.join(exact, F.col("id") == F.col("_id"), "left")
    hit = F.col("_n").isNotNull()
    return df.select("id", "need", F.when(hit, F.col("need")).otherwise(F.col("got")).alias("got"), F.coalesce("_n", "high").alias("high"), F.coalesce("_n", "low").alias("low"), F.when(hit, step).otherwise(F.col("step")).alias("step"))


def ancestors(start: DataFrame, edges: DataFrame, cap: int) -> DataFrame:
    """id and n, the number of its ancestors (itself not among them), of each of start(id); cap stands for more. Walks up
    level by level, and no further from what has reached the cap."""
    up = edges.select(F.col("dst").alias("_from"), F.col("src").alias("_to"))
    seen = cut(start.select(F.col("id").alias("root"), "id"))
    fresh = seen
    while not fresh.isEmpty():
        step = fresh.join(up, F.col("id") == F.col("_from")).select("root", F.col("_to").alias("id")).distinct()
        fresh = cut(step.join(seen, ["root", "id"], "left_anti"))
        seen = seen.unionByName(fresh)
        over = seen.groupBy("root").count().filter(F.col("count") > cap).select("root")
        fresh = cut(fresh.join(over, "root", "left_anti"))
    return seen.groupBy(F.col("root").alias("id")).agg(F.least(F.lit(cap), F.count("*") - 1).alias("n"))


def without_invalid_sources(memories: DataFrame, invalid: DataFrame) -> DataFrame:
    """Rows none of whose sources (transitively) is out of date; invalid holds the ids, or ids and revisions, of out_of_date()."""
    on = F.col("id") == F.col("_i")
    if "revision" in invalid.columns and "revision" in memories.columns:
        return memories.join(invalid.select(F.col("id").alias("_i"), F.col("revision").alias("_r")), on & (F.col("revision") == F.col("_r")), "left_anti")
    return memories.join(invalid.select(F.col("id").alias("_i")), on, "left_anti")


def quarantined(memories: DataFrame, relations: DataFrame, pending: DataFrame, mode: str = "global") -> DataFrame:
    """memories without those that must wait for pending invalidations. global: while any is pending, every derived
    summary and everything with a derived_from parent waits; ancestry: only what has a pending id among itself and its
    sources, or more sources than can be checked. The walk goes down from what is pending, so it is as large as what waits."""
    if mode == "ancestry":
        edges = relations.filter("kind = 'derived_from'").select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
        waits = reach(pending, edges).select("id").union(too_wide(edges, MOST_SOURCES)).distinct()
        return memories.join(waits.withColumnRenamed("id", "_w"), F.col("id") == F.col("_w"), "left_anti")
    any_pending = pending.agg((F.count("*") > 0).alias("_any"))
    derived = relations.filter("kind = 'derived_from'").select(F.col("from_id").alias("_d")).distinct()
    df = memories.crossJoin(F.broadcast(any_pending)).join(derived, F.col("id") == F.col("_d"), "left")
    waits = F.col("_any") & ((F.col("record_kind") == "derived_summary") | F.col("_d").isNotNull())
    return df.filter(~waits).drop("_any", "_d")


def session_filter(sessions: DataFrame, access: Access, tombstones: DataFrame, scope: str = "all", links: DataFrame | None = None) -> DataFrame:
    """Sessions belong to projects only; a forgotten session hides itself, and a forgotten caller the sessions of every
    agent that it was linked to (links: nonce, agent_id)."""
    _, projects = access.reach(scope)
    if projects == "none":
        return sessions.filter(F.lit(False))
    df = sessions if projects == "every" else sessions.filter(F.col("project_key") == access.project)
    gone = tombstones.filter("kind = 'session'").select(F.col("identifier").alias("_t"))
    callers = tombstones.filter("kind = 'caller'").select(F.col("identifier").alias("nonce"))
    if links is None:
        gone = gone.union(callers)
    else:
        gone = gone.union(links.join(callers, "nonce", "left_semi").select(F.col("agent_id").cast("string")))
    return df.join(gone.distinct(), F.col("id").cast("string") == F.col("_t"), "left_anti")


def invalidated(callers: DataFrame, tombstones: DataFrame, links: DataFrame) -> DataFrame:
    """callers(nonce, agent_id, principal_id) that hold something forgotten: by themselves, by an agent that their nonce is
    linked to, or by another nonce of their agent."""
    t = {k: tombstones.filter(F.col("kind") == k).select(F.col("identifier").alias("_t")).distinct() for k in ("caller", "session", "principal")}
    agents = links.join(t["caller"], F.col("nonce") == F.col("_t"), "left_semi").select(F.col("agent_id").alias("_t")).distinct()
    nonces = links.join(t["session"], F.col("agent_id") == F.col("_t"), "left_semi").select(F.col("nonce").alias("_t")).distinct()
    out = None
    for column, gone in (("nonce", t["caller"].union(nonces)), ("agent_id", t["session"].union(agents)), ("principal_id", t["principal"])):
        hit = callers.join(gone.distinct(), F.col(column) == F.col("_t"), "left_semi")
        out = hit if out is None else out.union(hit)
    return out.distinct()


def historical_allowed(access: Access, scope: Column, project_key: Column) -> Column:
    """Whether a snapshot may be read: by its own namespace; one without a known namespace is the owner's alone."""
    known = ((scope == "global") & project_key.isNull()) | ((scope == "project") & (project_key != ""))
    return F.when(F.coalesce(known, F.lit(False)), access.allows("read", scope, project_key)).otherwise(F.lit(access.owner))


def visible_ids(memories: DataFrame, ids: DataFrame, access: Access, now: Column, scope: str = "all", types: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """The rows of a list of ids that may be read now."""
    return memories.filter(access.memory_filter(now, scope, types, kinds)).join(ids.select("id").distinct(), "id", "left_semi")


def rows_by_id(memories: DataFrame, ids: DataFrame, live: bool = True) -> DataFrame:
    """The rows of a list of ids, whoever asks: the live ones, or the removed ones."""
    gone = F.col("deleted_at").isNull() if live else F.col("deleted_at").isNotNull()
    return memories.filter(gone).join(ids.select("id").distinct(), "id", "left_semi")


def own_proposals(memories: DataFrame, revisions: DataFrame, access: Access, actor: str) -> DataFrame:
    """Candidates whose first revision the actor wrote and whose namespace the actor may read."""
    first = revisions.filter((F.col("revision") == 1) & (F.col("actor_id") == actor)).select(F.col("memory_id").alias("id"))
    m = memories.filter((F.col("state") == "candidate") & F.col("deleted_at").isNull() & access.allows("read", F.col("scope"), F.col("project_key")))
    return m.join(first, "id", "left_semi")


def denied_ids(ids: DataFrame, memories: DataFrame, access: Access) -> DataFrame:
    """Ids that exist and may not be read."""
    return ids.join(memories.select("id", "scope", "project_key"), "id").filter(~access.allows("read", F.col("scope"), F.col("project_key"))).select("id")


def stale(now: Column, days: int) -> Column:
    touched = F.greatest("updated_at", F.coalesce("verified_at", "updated_at"), F.coalesce("kept_at", "updated_at"))
    return ~F.col("pinned") & (touched < now - F.make_dt_interval(F.lit(days)))

"""Forgetting: what goes with a memory, who may have seen it, and every table without it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut, reach
from .lineage import dependants_edges

#: Nodes beyond which forgetting is refused, as an erasure that is cut short would leak (fixed value).
MOST = 10_000
#: Which column of a table names what: a memory, a source, a session or a caller.
NAMES = {
    "memories": {"id": "memory"},
    "revisions": {"memory_id": "memory"},
    "citations": {"memory_id": "memory", "source_ref": "source"},
    "relations": {"from_id": "memory", "to_id": "memory"},
    "vectors": {"id": "memory"},
    "marks": {"id": "memory"},
    "feedback": {"memory_id": "memory"},
    "artifacts": {"source_ref": "source"},
    "sessions": {"id": "session"},
    "audit": {"nonce": "caller"},
}


def exposure_edges(shown: DataFrame, links: DataFrame, sessions: DataFrame | None = None, sessions_shown: DataFrame | None = None) -> DataFrame:
    """Typed edges src, dst from what was shown to whom: a memory to the callers that saw it (shown: memory_id, nonce), a
    caller to its agent and back (links), an agent to its sessions (id, agent_id), a session to the callers that saw it
    (session_id, nonce). A caller leads to no other memory: what else it saw isn't touched."""

    def named(kind: str, c: str) -> Column:
        return F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))

    own = links.filter("agent_id is not null")
    parts = [
        shown.select(named("memory", "memory_id").alias("src"), named("caller", "nonce").alias("dst")),
        own.select(named("caller", "nonce").alias("src"), named("agent", "agent_id").alias("dst")),
        own.select(named("agent", "agent_id").alias("src"), named("caller", "nonce").alias("dst")),
        # An agent's own session bears its name.
        own.select(named("agent", "agent_id").alias("src"), named("session", "agent_id").alias("dst")),
    ]
    if sessions is not None:
        parts.append(sessions.select(named("agent", "agent_id").alias("src"), named("session", "id").alias("dst")))
    if sessions_shown is not None:
        parts.append(sessions_shown.select(named("session", "session_id").alias("src"), named("caller", "nonce").alias("dst")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.filter("src is not null and dst is not null").distinct()


@dataclass
class Plan:
    """memories (id), sources (source_ref) and contexts (kind, identifier: callers, agents and sessions) that go."""

    memories: DataFrame
    sources: DataFrame
    contexts: DataFrame

    def of(self, kind: str) -> DataFrame:
        """Names of one kind, as strings in `name`."""
        if kind == "memory":
            return self.memories.select(F.col("id").cast("string").alias("name"))
        if kind == "source":
            return self.sources.select(F.col("source_ref").alias("name"))
        return self.contexts.filter(F.col("kind") == kind).select(F.col("identifier").alias("name"))


def plan(ids: DataFrame, relations: DataFrame, citations: DataFrame, exposures: DataFrame, most: int | None = MOST) -> Plan:
    """What forgetting ids takes with it: what derives from them, shares a source with them or cites them, and on; the
    sources that these cite; and the contexts that may hold any of it. More than `most` memories or contexts is an error,
    unless `most` is None."""
    gone = cut(reach(ids, dependants_edges(relations, citations)).select("id"))
    start = gone.select(F.concat(F.lit("memory:"), F.col("id").cast("string")).alias("id"))
    seen = cut(reach(start, exposures).filter(~F.startswith("id", F.lit("memory:"))))
    for what, df in (("memories", gone), ("contexts", seen)):
        if most is not None and df.count() > most:
            raise ValueError(f"forgetting takes more than {most} {what}")
    own = F.concat(F.lit("memory:"), F.col("id").cast("string"))
    cited = citations.join(gone.select(F.col("id").alias("memory_id")), "memory_id", "left_semi").select("source_ref")
    of_gone = citations.join(gone.select(own.alias("_m")), F.regexp_extract("source_ref", r"^(memory:\d+)@", 1) == F.col("_m"), "left_semi").select("source_ref")
    parts = F.split("id", ":", 2)
    return Plan(gone, cited.union(of_gone).distinct(), seen.select(F.get(parts, F.lit(0)).alias("kind"), F.get(parts, F.lit(1)).alias("identifier")))


def citing(refs: DataFrame, citations: DataFrame) -> DataFrame:
    """id of the memories that cite refs(source_ref): what forgetting a source starts from."""
    return citations.join(refs.select("source_ref").distinct(), "source_ref", "left_semi").select(F.col("memory_id").alias("id")).distinct()


def with_sources(what: Plan, refs: DataFrame) -> Plan:
    """The plan with sources that go even if nobody cites them."""
    return Plan(what.memories, what.sources.union(refs.select("source_ref")).distinct(), what.contexts)


def erased(tables: dict[str, DataFrame], what: Plan) -> dict[str, DataFrame]:
    """Every table of NAMES without the rows that name something that goes; others stay as they are."""
    out = dict(tables)
    for name, columns in NAMES.items():
        for column, kind in columns.items() if name in out else ():
            out[name] = out[name].join(what.of(kind).withColumnRenamed("name", "_gone").distinct(), F.col(column).cast("string") == F.col("_gone"), "left_anti")
    return out


def tombstones(what: Plan, at: Column, principal: str) -> DataFrame:
    """What remains of a forgetting: kind, identifier, when and for whom."""
    rows = None
    for kind in ("memory", "source", "session", "caller"):
        own = what.of(kind).select(F.lit(kind).alias("kind"), F.col("name").alias("identifier"), at.alias("forgotten_at"), F.lit(principal).alias("principal_id"))
        rows = own if rows is None else rows.union(own)
    return rows.distinct()

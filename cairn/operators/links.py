"""Who is who: projects by their hosts, agents by their nonces, first prompts by where they were asked."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip, redact
from .graph import cut

#: Seconds that a nonce, or a first prompt, waits to be taken.
WAIT_SECONDS = 120


def project_ref(key: Column, name: Column, root: Column, host_id: Column) -> Column:
    """A project as the engine knows it: its own key, else its root path, else the host's id."""
    by_root = F.when(root.isNotNull(), F.concat(F.lit("path:"), root))
    return F.struct(
        F.coalesce(F.when(key != "", key), by_root, F.concat(F.lit("host:"), host_id)).alias("key"),
        F.coalesce(name, host_id).alias("name"),
        root.alias("root_path"),
        host_id.alias("host_id"),
    )


def project_by_host(host_ids: DataFrame, aliases: DataFrame, projects: DataFrame) -> DataFrame:
    """host_ids(host_id) with the project that an alias(host_id, project_key) leads to."""
    p = projects.select(F.col("key").alias("project_key"), "name", "root_path")
    return host_ids.join(aliases.select("host_id", "project_key"), "host_id").join(p, "project_key")


def with_project(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """rows(project_key, ...) with project_name, null for what has no project."""
    p = projects.select(F.col("key").alias("_k"), F.col("name").alias("project_name"))
    return rows.join(p, F.col("project_key") == F.col("_k"), "left").drop("_k")


def linked(events: DataFrame) -> DataFrame:
    """One row per nonce of events(seq, nonce, agent_id, workspace_id, title, at): opened with the first, linked to the
    last agent; workspace and title stay where a later event has none."""

    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)

    return events.groupBy("nonce").agg(last("agent_id"), last("workspace_id"), last("title"), F.min("at").alias("created_at"), F.max("at").alias("linked_at"))


def nonce_of(links: DataFrame) -> DataFrame:
    """The newest nonce of each agent."""
    return links.filter("agent_id is not null").groupBy("agent_id").agg(F.max_by("nonce", F.struct("created_at", "nonce")).alias("nonce"))


def recorded(events: DataFrame) -> DataFrame:
    """Events as the log keeps them: those with a nonce, queries redacted and cut to 200 characters."""
    return events.filter("nonce is not null").withColumn("query", clip(redact(F.col("query")), 200))


#: Length of the stretches of time that are folded side by side; WAIT_SECONDS of what waits are carried into the next one.
STRETCH_SECONDS = 600


def _stretched(waiting: DataFrame, asking: DataFrame) -> DataFrame:
    """Both, cut into stretches of time; what waits longer than its stretch lasts is in the next one too."""
    stretch = F.floor(F.col("at") / (STRETCH_SECONDS * 1_000_000))
    late = F.floor((F.col("at") + WAIT_SECONDS * 1_000_000) / (STRETCH_SECONDS * 1_000_000))
    w = waiting.withColumns({"kind": F.lit(0), "stretch": F.explode(F.sequence(stretch, late))})
    return w.unionByName(asking.withColumns({"kind": F.lit(1), "stretch": stretch}))


#: Rows that are folded by one call, of many stretches; and how many changed facts or stretches are broadcast at most.
BATCH_ROWS, FEW = 20_000, 100_000
#: When a take comes that nobody was told of.
NEVER = (1 << 63) - 1
_FOLDED = "place string, stretch long, who string, token string, at long"


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= FEW else df


def _in_rounds(rows: DataFrame, fold: Callable[[list], list], out: str) -> DataFrame:
    """Rounds of folds of rows(place, stretch, kind, token, who, at, ...), until they agree on what is taken when.

    A fold proposes takes (taker, token and the order of the take) for its stretch of a place. What other stretches have
    proposed in the round before is told to it: `b_at`, `b_who` and `b_place` of the first take of what waits, or by who
    asks, outside its own stretch. A take depends on earlier ones only, so each round settles at least what hangs on the
    takes that the last one settled, and takes that don't change any more are those of one fold over all places in order
    of time. From the second round on only stretches that are told something else than before are folded again; one call
    folds many stretches, as one often holds a few rows."""
    keys, fact = ["place", "stretch"], ["kind", "token"]
    names = [c.split()[0] for c in out.split(", ")]
    batches = max(-(-rows.count() // BATCH_ROWS), 1)

    def batch(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", "stretch"], kind="stable")
        found = []
        for _, stretch in groupby(group.itertuples(index=False), key=lambda x: (x.place, x.stretch)):
            found += fold(list(stretch))
        return pd.DataFrame(found, columns=names)

    def folded(told: DataFrame, of: int) -> DataFrame:
        return told.withColumn("_batch", F.pmod(F.xxhash64(*keys), F.lit(of))).groupBy("_batch").applyInPandas(batch, out)

    def told_by(first: str, other: str) -> Column:
        own = (F.col(f"{first}.place") == F.col("place")) & (F.col(f"{first}.stretch") == F.col("stretch"))
        return F.when(own, F.col(other)).otherwise(F.col(first))

    nothing = {"b_at": F.lit(NEVER), "b_who": F.lit(None).cast("string"), "b_place": F.lit(None).cast("string")}
    takes, before = cut(folded(rows.withColumns(nothing), batches)), None
    while True:
        key = F.struct("at", "who", "place", "stretch").alias("take")
        facts = takes.select(F.lit(0).alias("kind"), "token", key).union(takes.select(F.lit(1).alias("kind"), F.col("who"), key))
        # A stretch takes each thing once, so the first take and the first of another stretch are all that can be asked for.
        first = facts.groupBy(*fact).agg(F.min("take").alias("first"))
        other = facts.join(first, fact).filter("take.place <> first.place or take.stretch <> first.stretch").groupBy(*fact).agg(F.min("take").alias("other"))
        known = cut(first.join(other, fact, "left"))
        old = (known.limit(0) if before is None else before).withColumnsRenamed({"first": "_first", "other": "_other"})
        changed = known.join(old, fact, "full").filter(~(F.col("first").eqNullSafe(F.col("_first")) & F.col("other").eqNullSafe(F.col("_other"))))
        changed = cut(changed)
        here = rows.select(*keys, *fact).join(_few(changed, changed.count()), fact)
        touched = cut(here.filter(~told_by("first", "other").eqNullSafe(told_by("_first", "_other"))).select(*keys).distinct())
        n = touched.count()
        if not n:
            return takes
        before = known
        again = rows.join(_few(touched, n), keys, "left_semi")
        told = again.join(known, fact, "left").withColumn("_take", told_by("first", "other"))
        told = told.select(*rows.columns, F.coalesce("_take.at", F.lit(NEVER)).alias("b_at"), F.col("_take.who").alias("b_who"), F.col("_take.place").alias("b_place"))
        takes = cut(takes.join(_few(touched, n), keys, "left_anti").unionByName(folded(told, batches)))


def _earlier(x: object, order: tuple) -> bool:
    """Whether a take that a row was told of comes before another."""
    return x.b_at != NEVER and (x.b_at, x.b_who or "", x.b_place) < order


def take_once(waiting: DataFrame, agents: DataFrame) -> DataFrame:
    """agent_id and nonce: each of agents(agent_id, cwd, provider, at) takes the oldest nonce that waits(nonce, cwd,
    provider, at) in its folder for its provider since WAIT_SECONDS at most. A nonce is taken once and an agent takes one,
    over all folders, in order of time (then of agent, folder and provider). Null folders and providers are values.
    Stretches of a folder's time are folded side by side, in rounds that end when they agree."""
    place = F.to_json(F.struct("cwd", "provider"), {"ignoreNullFields": "false"}).alias("place")
    at = F.unix_micros("at").alias("at")
    w = waiting.filter("nonce is not null and at is not null").select(place, F.col("nonce").alias("token"), F.col("nonce").alias("who"), at)
    a = agents.filter("agent_id is not null and at is not null").select(place, F.col("agent_id").alias("token"), F.col("agent_id").alias("who"), at)

    def fold(rows: list) -> list:
        queue, taken, linked, out = [], set(), set(), []
        for x in sorted(rows, key=lambda x: (x.at, x.kind, x.who)):
            if x.kind == 0:
                queue.append(x)
                continue
            order = (x.at, x.who, x.place)
            if x.who in linked or _earlier(x, order):
                continue
            queue = [p for p in queue if p.at >= x.at - WAIT_SECONDS * 1_000_000 and p.token not in taken]
            hit = next((p for p in queue if not _earlier(p, order)), None)
            if hit is not None:
                taken.add(hit.token)
                linked.add(x.who)
                out.append((x.place, x.stretch, x.who, hit.token, x.at))
        return out

    takes = _in_rounds(cut(_stretched(w, a)), fold, _FOLDED)
    return takes.select(F.col("who").alias("agent_id"), F.col("token").alias("nonce"))


def first_prompts(waiting: DataFrame, agents: DataFrame) -> DataFrame:
    """agent_id, prompt and rule: each of agents(agent_id, host, cwd, project_id, project_root, at) takes a prompt that was
    asked on its host(prompt, host, kind, source_dir, project_id, slug, at) in the WAIT_SECONDS before, by the strongest
    rule that fits one and of those the oldest: 1 its folder lies in the source folder, 2 the worktree's name is a part of
    its folder, 3 the same project or root. A prompt is taken once. Stretches of a host's time are folded side by side, in
    rounds that end when they agree."""
    nothing = F.lit(None).cast("string")
    number = F.monotonically_increasing_id().cast("string")
    at = F.unix_micros("at").alias("at")
    w = waiting.filter("host is not null and at is not null").select(F.col("host").alias("place"), number.alias("token"), F.col("prompt").alias("who"), at, F.col("kind").alias("source"), "source_dir", "project_id", "slug", nothing.alias("cwd"), nothing.alias("project_root"))
    a = agents.filter("host is not null and at is not null").select(F.col("host").alias("place"), number.alias("token"), F.col("agent_id").alias("who"), at, nothing.alias("source"), nothing.alias("source_dir"), "project_id", nothing.alias("slug"), "cwd", "project_root")

    def inside(path: str | None, folder: str | None) -> bool:
        return bool(path and folder) and (path == folder or path.startswith(folder + "/"))

    rules = (
        lambda p, x: p.source == "directory" and inside(x.cwd, p.source_dir),
        lambda p, x: bool(p.slug) and p.slug in (x.cwd or "").split("/"),
        lambda p, x: bool(p.project_id and p.project_id == x.project_id) or bool(p.source_dir and p.source_dir == x.project_root),
    )

    def fold(rows: list) -> list:
        queue, out = [], []
        for x in sorted(rows, key=lambda x: (x.at, x.kind, x.who or "", int(x.token))):
            if x.kind == 0:
                queue.append(x)
                continue
            order = (x.at, x.who or "", x.place)
            queue = [p for p in queue if p.at >= x.at - WAIT_SECONDS * 1_000_000]
            free = [p for p in queue if not _earlier(p, order)]
            hit = next(((p, n) for n, rule in enumerate(rules, 1) for p in free if rule(p, x)), None)
            if hit:
                queue = [p for p in queue if p is not hit[0]]
                out.append((x.place, x.stretch, x.who, hit[0].token, x.at, hit[0].who, hit[1]))
        return out

    w, a = cut(w), cut(a)  # the numbers of prompts must not change between rounds
    takes = _in_rounds(cut(_stretched(w, a)), fold, f"{_FOLDED}, prompt string, rule int")
    return takes.select(F.col("who").alias("agent_id"), "prompt", "rule")

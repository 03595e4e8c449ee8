"""Registered queries about sources, feedback, provenance, links, status and policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import access as ac
from ..operators import context, feedback, indexes, lineage, links, mutations, policy, provenance, review, search, sessions, state, status, usage
from ..operators.access import historical_allowed, rows_by_id, visible_ids, without_invalid_sources
from ..sources.embedder import hash_embedding
from ..sources.tables import table
from . import adapter as ad
from .adapter import DAY, NOW, NOW_S, START, sql
from .queries import AGENT, LIVE, OWNER, PROJECT, VISIBLE, query, query_terms, query_vectors, requests, seconds, sql_clip, sql_redact, visible

READABLE = f"(scope = 'global' OR coalesce(project_key = '{PROJECT}', false))"

# ---- sources that are out of date

BROKEN = f"""edges AS (SELECT to_id || '@' || to_revision AS src, from_id || '@' || from_revision AS dst FROM relations),
held AS (SELECT id || '@' || revision AS n FROM memories WHERE {LIVE}),
bad AS (SELECT dst AS n FROM edges WHERE src NOT IN (SELECT n FROM held) UNION SELECT e.dst FROM bad JOIN edges e ON e.src = bad.n)"""


@query(sql("memories relations", f"+ {BROKEN} SELECT m.id, m.title FROM memories m WHERE {VISIBLE} AND m.id || '@' || m.revision NOT IN (SELECT n FROM bad)", True))
def list_current(spark, d):
    m = ad.memories(spark, d, False)
    gone = ac.out_of_date(m, ad.relations(spark, d), NOW())
    return without_invalid_sources(m.filter(AGENT.memory_filter(NOW())), gone).select("id", "title")


@query(sql("memories relations", f"+ {BROKEN} SELECT count(*) AS out_of_date FROM bad", True))
def out_of_date_sources(spark, d):
    return ac.out_of_date(ad.memories(spark, d, False), ad.relations(spark, d), NOW()).agg(F.count("*").alias("out_of_date"))


AT = START + 20 * DAY


@query(sql("revisions relations", f"""+ s AS (SELECT memory_id, arg_max({{'r': revision, 's': state, 'f': valid_from, 'u': valid_until}}, (changed_at, revision)) AS snap FROM revisions WHERE changed_at <= {AT} GROUP BY memory_id),
held AS (SELECT memory_id, snap.r AS revision FROM s WHERE snap.s = 'active' AND (snap.f IS NULL OR snap.f <= {AT}) AND (snap.u IS NULL OR {AT} < snap.u)),
edges AS (SELECT to_id || '@' || to_revision AS src, from_id || '@' || from_revision AS dst FROM relations),
bad AS (SELECT dst AS n FROM edges WHERE src NOT IN (SELECT memory_id || '@' || revision FROM held) UNION SELECT e.dst FROM bad JOIN edges e ON e.src = bad.n)
SELECT memory_id, revision FROM held WHERE memory_id || '@' || revision NOT IN (SELECT n FROM bad)""", True))
def asof_with_sources(spark, d):
    return lineage.as_of_with_sources(ad.revisions(spark, d), ad.relations(spark, d), ad.at(AT)).select("memory_id", "revision")


# ---- lookups

#: How many memories there are: ids are dealt over all of them.
N = "(SELECT count(*) FROM documents)"
IDS = f"ids AS (SELECT item_id * 7 % {N} + 1 AS id FROM benchmark)"


def some_ids(spark, d):
    return table(spark, d, "benchmark").select((F.col("item_id") * 7 % ad.count(spark, d) + 1).alias("id"))


@query(sql("memories", f"+ {IDS} SELECT id, title FROM memories WHERE {VISIBLE} AND id IN (SELECT id FROM ids)"))
def visible_by_id(spark, d):
    return visible_ids(ad.memories(spark, d, False), some_ids(spark, d), AGENT, NOW()).select("id", "title")


@query(sql("memories", f"+ {IDS} SELECT id, 'live' AS part FROM memories WHERE deleted_at IS NULL AND id IN (SELECT id FROM ids) UNION ALL SELECT id, 'removed' FROM memories WHERE deleted_at IS NOT NULL AND id IN (SELECT id FROM ids)"))
def rows_by_id_parts(spark, d):
    m, ids = ad.memories(spark, d, False), some_ids(spark, d)
    parts = [rows_by_id(m, ids, live).select("id", F.lit(name).alias("part")) for live, name in ((True, "live"), (False, "removed"))]
    return parts[0].unionByName(parts[1])


@query(sql("memories revisions", f"SELECT m.id, m.title FROM memories m JOIN revisions r ON r.memory_id = m.id AND r.revision = 1 AND r.actor_id = 'a3' WHERE m.state = 'candidate' AND m.deleted_at IS NULL AND (m.scope = 'global' OR m.project_key = '{PROJECT}')"))
def own_candidates(spark, d):
    return ac.own_proposals(ad.memories(spark, d, False), ad.revisions(spark, d), AGENT, "a3").select("id", "title")


@query(sql("projects", "+ a AS (SELECT 'host-' || (item_id % 25) AS host_id FROM benchmark) SELECT DISTINCT a.host_id, p.key AS project_key, p.name FROM a JOIN projects p USING (host_id)"))
def project_by_host(spark, d):
    asked = table(spark, d, "benchmark").select(F.concat(F.lit("host-"), (F.col("item_id") % 25).cast("string")).alias("host_id")).distinct()
    p = ad.projects(spark, d)
    return links.project_by_host(asked, p.select("host_id", F.col("key").alias("project_key")), p).select("host_id", "project_key", "name")


@query(sql("memories projects", f"SELECT m.id, m.title, p.name AS project_name FROM memories m LEFT JOIN projects p ON p.key = m.project_key WHERE {VISIBLE} AND NOT pinned ORDER BY updated_at DESC, m.id LIMIT 40"))
def list_with_projects(spark, d):
    rows = visible(spark, d).filter(~F.col("pinned")).orderBy(F.desc("updated_at"), "id").limit(40)
    return links.with_project(rows, ad.projects(spark, d)).select("id", "title", "project_name")


ROOT = "regexp_extract(url, '^[a-z]+://[^/]+', 0)"


@query(f"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'k' || page_id WHEN page_id % 4 < 3 THEN 'path:' || {ROOT} ELSE 'host:h' || page_id END AS key,
  CASE WHEN page_id % 2 = 0 THEN 'name ' || page_id ELSE 'h' || page_id END AS name FROM pages""")
def project_refs(spark, d):
    i, s = F.col("page_id"), F.col("page_id").cast("string")
    root = F.when(i % 4 < 3, F.regexp_extract("url", "^[a-z]+://[^/]+", 0))
    ref = links.project_ref(F.when(i % 4 == 0, F.concat(F.lit("k"), s)).otherwise(""), F.when(i % 2 == 0, F.concat(F.lit("name "), s)), root, F.concat(F.lit("h"), s))
    return table(spark, d, "pages").select("page_id", ref.alias("p")).select("page_id", "p.key", "p.name")


# ---- search

FRESH = "fresh AS (SELECT k.id FROM marks k JOIN memories m ON m.id = k.id AND m.content_hash = k.content_hash AND m.index_generation = k.generation)"


@query(sql("memories vecs marks", f"""+ {FRESH}, qv AS (SELECT id AS query_id, embedding AS q FROM vecs WHERE (id - 1) % 100 = 0),
sims AS (SELECT query_id, v.id, round(list_dot_product(q, v.embedding), 6) AS similarity FROM qv CROSS JOIN vecs v JOIN memories m ON m.id = v.id WHERE {VISIBLE} AND v.id IN (SELECT id FROM fresh))
SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sims QUALIFY rank <= 10"""))
def knn_fresh(spark, d):
    v, m = ad.vectors(spark, d), ad.memories(spark, d, False)
    own = status.fresh_marks(ad.marks(spark, d), m.filter(AGENT.memory_filter(NOW()))).select("id")
    return search.neighbours(query_vectors(v), v.join(own, "id", "left_semi"), 10)


@query(sql("memories", f"SELECT id, row_number() OVER (ORDER BY pinned DESC, updated_at DESC, id) AS rank, title FROM memories WHERE {VISIBLE} AND record_kind IN ('fact', 'preference') QUALIFY rank <= 12"))
def search_without_query(spark, d):
    r = search.resolved("  ", limit=12, kinds=["fact", "preference"])
    return search.memory_search(ad.memories(spark, d), None, AGENT, r, NOW()).select("id", "rank", "title")


@query(sql("memories", f"SELECT id, 1 AS rank, title FROM memories WHERE {VISIBLE} AND id = 4"))
def search_by_id(spark, d):
    return search.memory_search(ad.memories(spark, d), None, AGENT, search.resolved("#4"), NOW()).select("id", "rank", "title")


@query()
def search_by_text(spark, d):
    """One request end to end: keywords, vectors of the hashing embedder and the fallback, sources checked."""
    m = ad.memories(spark, d)
    v = m.filter("deleted_at is null").select("id", hash_embedding(F.concat_ws("\n", "title", "content")).alias("embedding"))
    text = table(spark, d, "benchmark").orderBy("item_id").limit(1).first()["text"]
    return search.memory_search(m, ad.relations(spark, d), AGENT, search.resolved(text, limit=10), NOW(), hash_embedding, v)


@query(sql("memories projects", f"""+ h AS (SELECT *, row_number() OVER (ORDER BY pinned DESC, updated_at DESC, id) AS rank FROM memories WHERE {LIVE} QUALIFY rank <= 15)
SELECT rank, '#' || id AS identifier, title, type || ' · ' || coalesce(p.name, 'global') AS subtitle,
  sha256('Memory #' || id || ' (' || type || ', ' || coalesce(p.name, 'global') || '): ' || title || chr(10) || chr(10) || content) AS text_sha256 FROM h LEFT JOIN projects p ON p.key = h.project_key"""))
def search_attachments(spark, d):
    m = ad.memories(spark, d)
    hits = search.memory_search(m, None, OWNER, search.resolved("", limit=15), NOW())
    return search.attachments(hits, m, ad.projects(spark, d)).withColumn("text_sha256", F.sha2("text", 256)).drop("text")


@query(sql("memories", f"SELECT min(t) AS until_s FROM (SELECT valid_from AS t FROM memories WHERE deleted_at IS NULL AND state = 'active' UNION ALL SELECT valid_until FROM memories WHERE deleted_at IS NULL AND state = 'active') WHERE t > {NOW_S - 200 * DAY}"))
def candidates_hold_until(spark, d):
    """Until when candidates that were found may be used again."""
    live = ad.memories(spark, d, False).filter("deleted_at is null and state = 'active'")
    return lineage.next_boundary(live, ad.at(NOW_S - 200 * DAY)).select(seconds("boundary").alias("until_s"))


# ---- state

CALLS = f"""calls AS (SELECT id AS call_id, CASE kind WHEN 'inject' THEN 'shown' ELSE 'opened' END AS kind, [k + 1, k * 3 % 500 + 1, k + 1] AS ids, created_at AS moment FROM audit WHERE kind IN ('inject', 'get')),
moved AS (SELECT i AS id, count(*) FILTER (kind = 'shown') AS s, count(*) FILTER (kind = 'opened') AS o, max(moment) AS moment FROM (SELECT DISTINCT call_id, kind, moment, unnest(ids) AS i FROM calls) GROUP BY i)"""


@query(sql("memories audit", f"+ {CALLS} SELECT m.id, shown_count + coalesce(s, 0) AS shown_count, opened_count + coalesce(o, 0) AS opened_count, moment AS retrieved_s FROM memories m LEFT JOIN moved USING (id)"))
def shown_and_opened(spark, d):
    a = ad.audit(spark, d).filter(F.col("kind").isin("inject", "get"))
    calls = a.select(F.col("id").alias("call_id"), F.when(F.col("kind") == "inject", "shown").otherwise("opened").alias("kind"), F.array(F.col("k") + 1, F.col("k") * 3 % 500 + 1, F.col("k") + 1).alias("ids"), F.col("created_at").alias("at"))
    return state.bumped(ad.memories(spark, d, False), calls).select("id", "shown_count", "opened_count", seconds("last_retrieved_at").alias("retrieved_s"))


@query(sql("memories audit", "+ e AS (SELECT k + 1 AS id, max(created_at) AS moment FROM audit WHERE kind = 'save' GROUP BY k) SELECT m.id, CASE WHEN deleted_at IS NULL THEN greatest(kept_at, moment) ELSE kept_at END AS kept_s FROM memories m LEFT JOIN e USING (id)"))
def kept_memories(spark, d):
    e = ad.audit(spark, d).filter("kind = 'save'").select((F.col("k") + 1).alias("id"), F.col("created_at").alias("at"))
    return state.kept(ad.memories(spark, d, False), e).select("id", seconds("kept_at").alias("kept_s"))


@query(sql("memories audit", """+ e AS (SELECT k + 1 AS id, min(created_at) FILTER (k % 5 <> 0) AS soft, bool_or(k % 5 = 0) AS hard FROM audit WHERE kind = 'denied' GROUP BY k)
SELECT m.id, CASE WHEN soft IS NOT NULL AND deleted_at IS NULL THEN 'archived' ELSE state END AS state, CASE WHEN soft IS NOT NULL AND deleted_at IS NULL THEN soft ELSE deleted_at END AS deleted_s FROM memories m LEFT JOIN e USING (id) WHERE NOT coalesce(hard, false)"""))
def removed_memories(spark, d):
    e = ad.audit(spark, d).filter("kind = 'denied'").select((F.col("k") + 1).alias("id"), F.col("created_at").alias("at"), (F.col("k") % 5 == 0).alias("hard"))
    return state.removed(ad.memories(spark, d, False), e)[0].select("id", "state", seconds("deleted_at").alias("deleted_s"))


@query(sql("memories", """SELECT id, CASE WHEN id % 4 = 0 AND title <> 'New' THEN 'text' WHEN id % 4 = 1 AND type <> 'note' THEN 'metadata' WHEN id % 4 < 2 THEN 'unchanged' END AS change,
  revision + CASE WHEN (id % 4 = 0 AND title <> 'New') OR (id % 4 = 1 AND type <> 'note') THEN 1 ELSE 0 END AS revision, index_generation + CASE WHEN id % 4 = 0 AND title <> 'New' THEN 1 ELSE 0 END AS index_generation FROM memories"""))
def patched_memories(spark, d):
    m = ad.memories(spark, d, False)
    none = F.lit(None).cast("string")
    p = m.filter("id % 4 < 2").select("id", F.when(F.col("id") % 4 == 0, "New").alias("title"), none.alias("content"), F.when(F.col("id") % 4 == 1, "note").alias("type"), F.lit(None).cast("boolean").alias("pinned"))
    return state.patched(m, p).select("id", "change", "revision", "index_generation")


@query(sql("memories marks", """+ n AS (SELECT id, 'fp' || (id % 3) AS fingerprint, 'new' AS content_hash FROM marks WHERE id % 10 = 0 UNION ALL SELECT id + 100000, 'fp0', 'new' FROM marks WHERE id % 50 = 0),
w AS (SELECT id, fingerprint, content_hash FROM marks WHERE (id, fingerprint) NOT IN (SELECT (id, fingerprint) FROM n) UNION ALL SELECT id, fingerprint, content_hash FROM n)
SELECT fingerprint, content_hash = 'new' AS fresh, count(*) AS vectors FROM w WHERE NOT (id % 6 = 0 AND fingerprint = 'fp0') GROUP BY ALL"""))
def written_vectors(spark, d):
    v = ad.marks(spark, d).select("id", "fingerprint", "content_hash")
    again = v.filter("id % 10 = 0").withColumn("content_hash", F.lit("new"))
    more = v.filter("id % 50 = 0").select((F.col("id") + 100000).alias("id"), F.lit("fp0").alias("fingerprint"), F.lit("new").alias("content_hash"))
    w = state.written(v, again.unionByName(more))
    w = state.dropped(w, w.select("id").filter("id % 6 = 0"), "fp0")
    return w.groupBy("fingerprint", (F.col("content_hash") == "new").alias("fresh")).agg(F.count("*").alias("vectors"))


@query(sql("turns", """+ e AS (SELECT agent_id, last(CASE WHEN seq % 3 = 0 THEN 's' || seq END ORDER BY seq) FILTER (seq % 3 = 0) AS summary, first(ts ORDER BY seq) FILTER (seq % 4 = 3) AS ended FROM turns GROUP BY agent_id)
SELECT DISTINCT t.agent_id AS id, e.summary, e.ended AS ended_s FROM turns t LEFT JOIN e USING (agent_id)"""))
def ended_sessions(spark, d):
    t, i = ad.turns(spark, d), F.col("seq")
    e = t.select(F.col("agent_id").alias("id"), "seq", F.when(i % 3 == 0, F.concat(F.lit("s"), i.cast("string"))).alias("summary"), F.when(i % 4 == 3, F.col("ts")).alias("ended_at"))
    s = t.select(F.col("agent_id").alias("id")).distinct()
    return state.ended(s, e).select("id", "summary", seconds("ended_at").alias("ended_s"))


@query(sql("audit", "SELECT 'setting-' || (id % 9) AS key, arg_max(k, id)::VARCHAR AS value FROM audit GROUP BY 1"))
def stored_settings(spark, d):
    a = ad.audit(spark, d)
    return state.settings(a.select(F.col("id").alias("seq"), F.concat(F.lit("setting-"), (F.col("id") % 9).cast("string")).alias("key"), F.col("k").cast("string").alias("value")))


@query()
def store_generation(spark, d):
    r = mutations.fold(requests(spark, d))
    return state.generation(r)


@query(sql("audit", f"""SELECT nonce, last('a' || (k % 5) ORDER BY id) FILTER (k % 3 = 0) AS agent_id, last('w' || k ORDER BY id) FILTER (k % 4 = 0) AS workspace_id, last('t' || k ORDER BY id) FILTER (k % 7 = 0) AS title,
  min(created_at) AS created_s, max(created_at) AS linked_s FROM audit GROUP BY nonce"""))
def linked_agents(spark, d):
    a, k = ad.audit(spark, d), F.col("k")
    text = lambda head, n, mod: F.when(k % mod == 0, F.concat(F.lit(head), n.cast("string")))
    e = a.select(F.col("id").alias("seq"), "nonce", text("a", k % 5, 3).alias("agent_id"), text("w", k, 4).alias("workspace_id"), text("t", k, 7).alias("title"), F.col("created_at").alias("at"))
    return links.linked(e).select("nonce", "agent_id", "workspace_id", "title", seconds("created_at").alias("created_s"), seconds("linked_at").alias("linked_s"))


@query(sql("links", "SELECT agent_id, arg_max(nonce, (created_at, nonce)) AS nonce FROM links GROUP BY agent_id"))
def newest_nonces(spark, d):
    return links.nonce_of(ad.links(spark, d))


@query(f"SELECT doc_id AS id, {sql_clip(sql_redact('text'), 200)} AS query FROM documents WHERE doc_id % 10 <> 3")
def recorded_queries(spark, d):
    e = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 != 3, "n").alias("nonce"), F.col("text").alias("query"))
    return links.recorded(e).select("id", "query")


# ---- feedback

EVIDENCE_STATUS = "CASE WHEN e % 10 = 9 THEN 'unresolved' ELSE 'resolved' END"


def disclosing_events(spark, d):
    """Injections with the JSON of what they showed."""
    k, i = F.col("k"), F.col("id")
    many = ad.count(spark, d)
    refs = F.array(*[F.struct((i * m % many + 1).alias("id"), (1 + i * m % many % 3).alias("revision")) for m in (1, 3)])
    detail = F.when(i % 20 == 0, "{broken").otherwise(F.to_json(F.struct(F.struct(F.concat(F.lit("r"), i.cast("string")).alias("retrievalId"), refs.alias("memoryRefs")).alias("retrieval"), F.lit(1).alias("chars"))))
    return ad.audit(spark, d).filter("kind = 'inject'").select("id", "nonce", "k", detail.alias("detail"))


SHOWN = f"""shown AS (SELECT DISTINCT 'r' || id AS retrieval_id, nonce, memory_id, 1 + (memory_id - 1) % 3 AS revision FROM (SELECT id, nonce, unnest([id % {N} + 1, id * 3 % {N} + 1]) AS memory_id FROM audit WHERE kind = 'inject' AND id % 20 <> 0))"""


@query(sql("audit links", f"+ {SHOWN} SELECT retrieval_id, nonce, agent_id, memory_id, revision FROM shown LEFT JOIN links USING (nonce)"))
def disclosed_references(spark, d):
    return feedback.disclosures(disclosing_events(spark, d), ad.links(spark, d)).distinct()


def feedback_log(spark, d):
    """Feedback on what injections showed: every fifth event again, every tenth again with another signal, some from a
    nonce that saw something else, some with evidence that doesn't resolve or isn't there."""
    e = disclosing_events(spark, d).select("id", "nonce", "k").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(2))))
    i, n, many = F.col("id"), F.col("n"), ad.count(spark, d)
    e = e.filter((n == 0) | ((n == 1) & (i % 5 == 0)) | ((n == 2) & (i % 10 == 0)))
    return e.select(
        (i * 3 + n).alias("seq"),
        F.concat(F.lit("p"), (i % 4).cast("string")).alias("producer_id"),
        F.concat(F.lit("f"), i.cast("string")).alias("event_id"),
        F.concat(F.lit("r"), i.cast("string")).alias("retrieval_id"),
        (i % many + 1).alias("memory_id"),
        (1 + i % many % 3).alias("revision"),
        ad._pick(["applied", "helpful", "harmful", "irrelevant"], (i + F.when(n == 2, 1).otherwise(0)) % 4).alias("signal"),
        ad._pick(["validator", "human", "agent_report"], i % 3).alias("basis"),
        F.when(i % 7 == 0, "n0x").otherwise(F.col("nonce")).alias("nonce"),
        F.array(F.concat(F.lit("v"), (i % 60 + F.when(i % 11 == 0, 1000000).otherwise(0)).cast("string"))).alias("evidence_refs"),
    )


def evidence_status(spark, d):
    return spark.range(60).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("evidence_id"), F.when(F.col("id") % 10 == 9, "unresolved").otherwise("resolved").alias("status"))


FEEDBACK_LOG = f"""{SHOWN}, fl AS (SELECT id, n, k, id * 3 + n AS seq, 'p' || (id % 4) AS producer_id, 'f' || id AS event_id, 'r' || id AS retrieval_id, id % {N} + 1 AS memory_id, 1 + id % {N} % 3 AS revision,
  ['applied', 'helpful', 'harmful', 'irrelevant'][(id + CASE WHEN n = 2 THEN 1 ELSE 0 END) % 4 + 1] AS signal, ['validator', 'human', 'agent_report'][id % 3 + 1] AS basis,
  CASE WHEN id % 7 = 0 THEN 'n0x' ELSE nonce END AS nonce, id % 60 AS e, id % 11 <> 0 AS there FROM (SELECT *, unnest([0, 1, 2]) AS n FROM audit WHERE kind = 'inject')
  WHERE n = 0 OR (n = 1 AND id % 5 = 0) OR (n = 2 AND id % 10 = 0)),
judged AS (SELECT fl.*, CASE WHEN m.id IS NULL OR NOT there THEN 'scope_denied' WHEN e % 10 = 9 THEN 'invalid_input' WHEN n = 2 THEN 'request_conflict' WHEN n = 1 THEN 'duplicate'
  WHEN s.retrieval_id IS NULL THEN 'scope_denied' ELSE 'recorded' END AS outcome FROM fl LEFT JOIN memories m ON m.id = fl.memory_id LEFT JOIN (SELECT DISTINCT retrieval_id, memory_id, revision FROM shown) s ON s.retrieval_id = fl.retrieval_id AND s.memory_id = fl.memory_id AND s.revision = fl.revision),
counted AS (SELECT *, CASE WHEN outcome <> 'recorded' THEN NULL WHEN signal = 'applied' AND basis IN ('validator', 'human') THEN 'application_count' WHEN basis = 'validator' AND signal = 'helpful' THEN 'validated_helpful_count'
  WHEN basis = 'validator' AND signal = 'harmful' THEN 'validated_harmful_count' END AS counter FROM judged)"""


@query(sql("memories audit", f"+ {FEEDBACK_LOG} SELECT seq, event_id, outcome, counter FROM counted"))
def feedback_outcomes(spark, d):
    shown = feedback.disclosures(disclosing_events(spark, d), ad.links(spark, d))
    j = feedback.judged(feedback_log(spark, d), shown, ad.memories(spark, d, False), evidence_status(spark, d), OWNER)
    return j.select("seq", "event_id", "outcome", "counter")


LOST = "e IN (4, 17, 33)"


def recorded_feedback(spark, d):
    shown = feedback.disclosures(disclosing_events(spark, d), ad.links(spark, d))
    j = feedback.judged(feedback_log(spark, d), shown, ad.memories(spark, d, False), evidence_status(spark, d), OWNER)
    return j.filter("outcome = 'recorded'")


@query(sql("memories audit", f"""+ {FEEDBACK_LOG}, left_ AS (SELECT *, basis = 'validator' AND NOT ({LOST}) AS validated FROM judged WHERE outcome = 'recorded' AND e <> 21)
SELECT m.id, count(*) FILTER (signal = 'applied' AND (validated OR basis = 'human')) AS application_count, count(*) FILTER (signal = 'helpful' AND validated) AS validated_helpful_count,
  count(*) FILTER (signal = 'harmful' AND validated) AS validated_harmful_count FROM left_ f JOIN memories m ON m.id = f.memory_id AND m.revision = f.revision WHERE m.deleted_at IS NULL AND m.state = 'active'
  AND ((signal = 'applied' AND (validated OR basis = 'human')) OR (validated AND signal IN ('helpful', 'harmful'))) GROUP BY m.id"""))
def feedback_counters(spark, d):
    names = lambda *x: spark.createDataFrame([(f"v{i}",) for i in x], "evidence_id string")
    f = feedback.retracted(recorded_feedback(spark, d), names(4, 17, 33), "invalidate")
    return feedback.counters(feedback.retracted(f, names(21), "forget"), ad.memories(spark, d, False))


@query(sql("memories audit pending", f"""+ {FEEDBACK_LOG}, c AS (SELECT f.memory_id AS id, count(*) FILTER (counter = 'application_count') AS a, count(*) FILTER (counter = 'validated_helpful_count') AS h, count(*) FILTER (counter = 'validated_harmful_count') AS x
  FROM counted f JOIN memories m ON m.id = f.memory_id AND m.revision = f.revision WHERE counter IS NOT NULL AND m.deleted_at IS NULL AND m.state = 'active' GROUP BY f.memory_id)
SELECT m.id, CASE WHEN p THEN coalesce(a, 0) ELSE application_count END AS application_count, CASE WHEN p THEN coalesce(h, 0) ELSE helpful_count END AS helpful_count, CASE WHEN p THEN coalesce(x, 0) ELSE harmful_count END AS harmful_count
  FROM memories m LEFT JOIN c USING (id) CROSS JOIN (SELECT count(*) > 0 AS p FROM pending)"""))
def current_hints(spark, d):
    counted = feedback.counters(recorded_feedback(spark, d), ad.memories(spark, d, False))
    return feedback.current_hints(ad.memories(spark, d), counted, ad.pending(spark, d)).select("id", "application_count", "helpful_count", "harmful_count")


# ---- provenance

SOURCES = f"""src AS (SELECT 'memory:' || r.memory_id || '@' || r.revision AS source_ref, r.title || chr(10) || r.content AS content, true AS allow FROM revisions r JOIN memories m ON m.id = r.memory_id AND m.deleted_at IS NULL AND (m.scope = 'global' OR m.project_key = '{PROJECT}')
  WHERE r.scope IS NOT NULL AND (r.scope = 'global' OR r.project_key = '{PROJECT}') UNION ALL SELECT source_ref, content, allow_excerpt FROM artifacts WHERE scope = 'global' OR project_key = '{PROJECT}'),
found AS (SELECT c.*, s.content, s.allow, c.source_ref IN (SELECT identifier FROM tombstones WHERE kind = 'source') OR coalesce(regexp_extract(c.source_ref, '^memory:(\\d+)@', 1) IN (SELECT identifier FROM tombstones WHERE kind = 'memory'), false) AS forgotten
  FROM citations c LEFT JOIN src s USING (source_ref)),
res AS (SELECT *, CASE WHEN forgotten THEN 'source_forgotten' WHEN content IS NULL THEN 'source_unavailable' WHEN given_hash IS NOT NULL AND given_hash <> sha256(content) THEN 'source_hash_mismatch' END AS reason FROM found)"""
PROVENANCE = "memories revisions citations artifacts tombstones"


def resolved_evidence(spark, d):
    s = provenance.sources(ad.memories(spark, d, False), ad.revisions(spark, d), ad.artifacts(spark, d), AGENT)
    return provenance.resolve(ad.citations(spark, d), s, ad.tombstones(spark, d))


@query(sql(PROVENANCE, f"""+ {SOURCES} SELECT evidence_id, source_ref, CASE WHEN reason IS NULL THEN 'resolved' ELSE 'unresolved' END AS status, reason, CASE WHEN reason IS NULL THEN sha256(content) END AS source_hash,
  CASE WHEN reason IS NULL AND include_excerpt AND allow THEN sha256(substr({sql_redact("content")}, 1, 500)) END AS excerpt_sha256 FROM res"""))
def resolve_evidence(spark, d):
    e = resolved_evidence(spark, d)
    return e.select("evidence_id", "source_ref", "status", "reason", "source_hash", F.sha2("excerpt", 256).alias("excerpt_sha256"))


@query(sql("memories revisions", f"SELECT memory_id, revision FROM revisions WHERE scope IS NOT NULL AND (scope = 'global' OR project_key = '{PROJECT}')"))
def readable_history(spark, d):
    return ad.revisions(spark, d).filter(historical_allowed(AGENT, F.col("scope"), F.col("project_key"))).select("memory_id", "revision")


GONE_REFS = "refs AS (SELECT 'artifact:a30' AS source_ref UNION SELECT 'memory:' || doc_id || '@1' FROM documents WHERE doc_id % 12 = 0)"


def gone_refs(spark, d):
    ids = table(spark, d, "documents").filter("doc_id % 12 = 0").select(F.concat(F.lit("memory:"), F.col("doc_id").cast("string"), F.lit("@1")).alias("source_ref"))
    return ids.union(spark.createDataFrame([("artifact:a30",)], "source_ref string"))


AFFECTED = f"{GONE_REFS}, hit AS (SELECT DISTINCT m.id, m.revision FROM citations c JOIN memories m ON m.id = c.memory_id AND m.revision = c.revision WHERE c.source_ref IN (SELECT source_ref FROM refs))"


@query(sql("memories citations", f"+ {AFFECTED} SELECT id, revision FROM hit"))
def affected_by_sources(spark, d):
    return provenance.affected_by(gone_refs(spark, d), ad.citations(spark, d), ad.memories(spark, d, False))


@query(sql("memories citations", f"""+ {AFFECTED}, k AS (SELECT *, id IN (SELECT id FROM hit) AND state IN ('active', 'candidate') AS marked FROM memories)
SELECT id, CASE WHEN marked THEN 'needs_recheck' ELSE state END AS state, CASE WHEN marked THEN 'unresolved' ELSE verification_status END AS verification_status, CASE WHEN NOT marked THEN verified_at END AS verified_s, revision + marked::INT AS revision FROM k"""))
def invalidated_memories(spark, d):
    c = ad.citations(spark, d).withColumn("status", F.lit("resolved"))
    m = provenance.invalidate(gone_refs(spark, d), c, ad.memories(spark, d, False))[1]
    return m.select("id", "state", "verification_status", seconds("verified_at").alias("verified_s"), "revision")


@query(sql("memories citations", f"""+ {AFFECTED}, l AS (SELECT memory_id, revision, evidence_id FROM citations UNION SELECT c.memory_id, c.revision + 1, c.evidence_id FROM citations c JOIN hit ON hit.id = c.memory_id AND hit.revision = c.revision) SELECT * FROM l"""))
def evidence_carried_forward(spark, d):
    c = ad.citations(spark, d)
    hit = provenance.affected_by(gone_refs(spark, d), c, ad.memories(spark, d, False))
    return provenance.carried_forward(c.select("memory_id", "revision", "evidence_id"), hit)


OPS = "['update', 'promote', 'restore', 'update']"


@query(sql("citations", f"""+ ch AS (SELECT memory_id, revision + 1 AS revision, {OPS}[memory_id % 4 + 1] AS op, memory_id % 8 = 3 AS claim, CASE WHEN memory_id % 4 = 2 THEN revision END AS src, CASE WHEN memory_id % 5 = 0 THEN ['x' || memory_id] ELSE [] END AS supplied FROM citations),
b AS (SELECT *, CASE WHEN len(supplied) > 0 OR op = 'promote' THEN NULL WHEN op = 'restore' THEN src WHEN NOT claim THEN revision - 1 END AS base FROM ch)
SELECT memory_id, revision, unnest(supplied) AS evidence_id FROM b UNION SELECT b.memory_id, b.revision, c.evidence_id FROM b JOIN citations c ON c.memory_id = b.memory_id AND c.revision = b.base"""))
def evidence_inherited(spark, d):
    c, i = ad.citations(spark, d), F.col("memory_id")
    ch = c.select(
        "memory_id", (F.col("revision") + 1).alias("revision"), ad._pick(["update", "promote", "restore", "update"], i % 4).alias("operation"), (i % 8 == 3).alias("claim_changed"),
        F.when(i % 4 == 2, F.col("revision")).alias("source_revision"), F.when(i % 5 == 0, F.array(F.concat(F.lit("x"), i.cast("string")))).otherwise(F.array().cast("array<string>")).alias("supplied"),
    )
    return provenance.inherited(ch, c.select("memory_id", "revision", "evidence_id"))


@query(sql("memories citations", f"""+ {AFFECTED}, jobs AS (SELECT event_id AS id, ['queued', 'running', 'done', 'reserved'][event_id % 4 + 1] AS state, event_id % {N} + 1 AS memory_id FROM events)
SELECT CASE WHEN state <> 'done' AND (memory_id, 1 + (memory_id - 1) % 3) IN (SELECT (id, revision) FROM hit) THEN 'cancelled' ELSE state END AS state, count(*) AS n FROM jobs GROUP BY 1"""))
def cancelled_reviews(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    jobs = e.select(i.alias("id"), ad._pick(["queued", "running", "done", "reserved"], i % 4).alias("state"))
    many = ad.count(spark, d)
    src = e.select(i.alias("job_id"), (i % many + 1).alias("memory_id"), (1 + i % many % 3).alias("revision"))
    hit = provenance.affected_by(gone_refs(spark, d), ad.citations(spark, d), ad.memories(spark, d, False))
    return provenance.cancelled_jobs(jobs, src, hit).groupBy("state").agg(F.count("*").alias("n"))


@query(sql("memories revisions", f"""+ {IDS}, m AS (SELECT * FROM memories WHERE id IN (SELECT id FROM ids) AND {READABLE}),
v AS (SELECT r.memory_id, count(*) AS versions, min(r.revision) AS oldest, max(r.revision) AS newest FROM revisions r JOIN m ON m.id = r.memory_id AND r.revision <> m.revision WHERE r.scope IS NOT NULL AND (r.scope = 'global' OR r.project_key = '{PROJECT}') GROUP BY r.memory_id)
SELECT m.id, m.revision, deleted_at IS NULL AS live, archived_at IS NOT NULL AS archived, coalesce(versions, 0) AS versions, oldest, newest, t.id AS merged_into, t.revision AS target_revision FROM m LEFT JOIN v ON v.memory_id = m.id
LEFT JOIN (SELECT id, revision FROM memories WHERE {READABLE}) t ON m.deleted_at IS NOT NULL AND t.id = m.id - 1"""))
def memory_details(spark, d):
    m = ad.memories(spark, d, False).withColumn("merged_into", F.when(F.col("deleted_at").isNotNull(), F.col("id") - 1))
    return provenance.detail(m, ad.revisions(spark, d), some_ids(spark, d), AGENT)


@query(sql("memories", "SELECT count(*) FILTER (valid_from IS NULL OR valid_until IS NULL OR valid_from < valid_until) AS valid, count(*) FILTER (valid_from >= valid_until) AS invalid FROM memories"))
def validity_intervals(spark, d):
    ok = state.valid_interval(F.col("valid_from"), F.col("valid_until"))
    return ad.memories(spark, d, False).agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


# ---- callers and contexts


def callers(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    s = F.col("user_id").cast("string")
    return u.select(F.concat(F.lit("n"), s).alias("nonce"), F.concat(F.lit("g"), (F.col("user_id") % 40).cast("string")).alias("agent_id"), F.concat(F.lit("agent:"), s).alias("principal_id"))


@query(sql("links tombstones", """+ c AS (SELECT DISTINCT 'n' || user_id AS nonce, 'g' || (user_id % 40) AS agent_id, 'agent:' || user_id AS principal_id FROM events),
t AS (SELECT * FROM tombstones) SELECT * FROM c WHERE nonce IN (SELECT identifier FROM t WHERE kind = 'caller') OR agent_id IN (SELECT identifier FROM t WHERE kind = 'session') OR principal_id IN (SELECT identifier FROM t WHERE kind = 'principal')
  OR agent_id IN (SELECT agent_id FROM links WHERE nonce IN (SELECT identifier FROM t WHERE kind = 'caller')) OR nonce IN (SELECT nonce FROM links WHERE agent_id IN (SELECT identifier FROM t WHERE kind = 'session'))"""))
def invalidated_callers(spark, d):
    return ac.invalidated(callers(spark, d), ad.tombstones(spark, d), ad.links(spark, d))


@query(sql("turns links tombstones", """+ s AS (SELECT DISTINCT agent_id, project_key FROM turns) SELECT count(*) AS sessions FROM s WHERE 'g' || (agent_id % 40) NOT IN (SELECT identifier FROM tombstones WHERE kind = 'session')
  AND 'g' || (agent_id % 40) NOT IN (SELECT agent_id FROM links WHERE nonce IN (SELECT identifier FROM tombstones WHERE kind = 'caller'))"""))
def sessions_without_forgotten(spark, d):
    t = ad.turns(spark, d).select("agent_id", "project_key").distinct()
    s = t.select(F.concat(F.lit("g"), (F.col("agent_id") % 40).cast("string")).alias("id"), "project_key", "agent_id")
    return ac.session_filter(s, OWNER, ad.tombstones(spark, d), links=ad.links(spark, d)).agg(F.count("*").alias("sessions"))


@query(sql("memories", f"""+ c AS (SELECT id, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 5 = 0 THEN revision + 1 ELSE revision END AS rev, CASE WHEN id % 4 = 0 THEN 2 WHEN id % 4 = 1 THEN 3 END AS epoch, revision AS now, record_kind, scope FROM memories)
SELECT id FROM c WHERE record_kind IN ('fact', 'episode') AND (rev IS NULL OR rev = now) AND (epoch IS NULL OR epoch = 3) AND scope = 'project'"""))
def candidates_still_visible(spark, d):
    m, i = ad.memories(spark, d, False), F.col("id")
    c = m.select("id", F.when(i % 3 == 0, None).when(i % 5 == 0, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"), F.when(i % 4 == 0, 2).when(i % 4 == 1, 3).alias("epoch"))
    return context.candidate_visible(c, m, ["fact", "episode"], 3, "project").select("id")


@query("WITH i AS (SELECT row_number() OVER (ORDER BY item_id) AS place, item_id * 7 % 30 + 1 AS id FROM benchmark), f AS (SELECT id, min(place) AS place FROM i GROUP BY id) SELECT id, row_number() OVER (ORDER BY place) AS rank FROM f QUALIFY rank <= 20")
def requested_memories(spark, d):
    ids = table(spark, d, "benchmark").select((F.col("item_id") + 1).alias("place"), (F.col("item_id") * 7 % 30 + 1).alias("id"))
    return context.requested(ids, 20).select("id", "rank")


TASK = "SELECT id, id % 10 / 10.0 AS relevance, CASE WHEN id % 4 > 0 THEN id % 7 / 7.0 END AS similarity FROM memories"


@query(sql("memories", f"+ h AS ({TASK}) SELECT 'task' AS mode, count(*) AS n FROM h WHERE relevance >= 0.4 AND coalesce(similarity >= 0.5, false) UNION ALL SELECT 'query', count(*) FROM h UNION ALL SELECT 'fallback', count(*) FROM h"))
def task_filters(spark, d):
    i = F.col("id")
    h = ad.memories(spark, d, False).select("id", (i % 10 / 10.0).alias("relevance"), F.when(i % 4 > 0, i % 7 / 7.0).alias("similarity"))
    modes = {"task": (True, False, None), "query": (True, True, None), "fallback": (True, False, "lexical_only")}
    out = [context.task_filter(h, "medium", 0.5, *x).agg(F.count("*").alias("n")).select(F.lit(name).alias("mode"), "n") for name, x in modes.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def sql_json(x: str) -> str:
    return f"replace(replace(to_json({x})::VARCHAR, '<', '\\u003c'), '>', '\\u003e')"


CITED = """cited AS (SELECT memory_id, string_agg('{"evidenceId":"' || evidence_id || '","sourceRef":"' || source_ref || '","status":"resolved"}', ',' ORDER BY evidence_id) AS cited FROM citations GROUP BY memory_id)"""
DAYS = "strftime(make_timestamp({0}::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
ENTRY = f"""'- #' || m.id || '@' || revision || ' [' || record_kind || '/' || state || '/' || verification_status || '/' || scope || '] ' || {sql_json("title")}
  || CASE WHEN {sql_clip("content", 240)} <> '' THEN chr(10) || '  Text: ' || {sql_json(sql_clip("content", 240))} ELSE '' END || chr(10) || '  Evidence: [' || coalesce(cited, '') || ']'
  || CASE WHEN valid_from IS NOT NULL OR valid_until IS NOT NULL THEN chr(10) || '  Valid: ' || coalesce({DAYS.format("valid_from")}, 'unknown') || ' .. ' || coalesce({DAYS.format("valid_until")}, 'unbounded') ELSE '' END"""


def cited(spark, d):
    return context.citations_of(ad.citations(spark, d).select("memory_id", "evidence_id", "source_ref", F.lit("resolved").alias("status")), False)


@query(sql("memories citations", f"""+ {CITED.replace("citations GROUP", "(SELECT * FROM citations) GROUP")} SELECT m.id, sha256({ENTRY}) AS text_sha256 FROM memories m LEFT JOIN cited c ON c.memory_id = m.id WHERE {VISIBLE}"""))
def context_entries(spark, d):
    m = visible(spark, d).join(cited(spark, d).select(F.col("memory_id").alias("_m"), "cited"), F.col("id") == F.col("_m"), "left")
    text = context.entry_text({c: F.col(c) for c in context.ENTRY_COLUMNS}, F.col("cited"), "compact")
    return m.select("id", F.sha2(text, 256).alias("text_sha256"))


@query(sql("memories revisions", f"SELECT 'memory:' || m.id AS key, 'Requested memories' AS section, 1 AS priority, coalesce(topic_key, m.title) AS diversity_key FROM memories m JOIN revisions r ON r.memory_id = m.id AND r.revision = 1 AND r.actor_id = 'a3' WHERE m.state = 'candidate' AND m.deleted_at IS NULL AND (m.scope = 'global' OR m.project_key = '{PROJECT}') AND record_kind IN ('fact', 'procedure', 'episode')"))
def own_candidate_entries(spark, d):
    own = ac.own_proposals(ad.memories(spark, d, False), ad.revisions(spark, d), AGENT, "a3")
    return context.proposals(own, ["fact", "procedure", "episode"], cited(spark, d), "compact").select("key", "section", "priority", "diversity_key")


@query(sql("memories audit", """+ p AS (SELECT id AS retrieval_id, 'memory' AS part, (k + 1)::VARCHAR AS ref, (1 + k % 3)::VARCHAR AS revision FROM audit WHERE kind = 'inject' UNION ALL SELECT id, 'evidence', 'v' || (k * 3 + 1), '' FROM audit WHERE kind = 'inject' AND k % 2 = 0
  UNION ALL SELECT id, 'policy', 'p', CASE WHEN k % 9 = 0 THEN '4' ELSE '5' END FROM audit WHERE kind = 'inject'),
ev AS (SELECT 'v' || (doc_id + 1) AS e FROM documents WHERE doc_id % 3 = 0),
j AS (SELECT p.retrieval_id, CASE part WHEN 'memory' THEN coalesce(m.revision::VARCHAR = p.revision AND m.state = 'active', false) WHEN 'evidence' THEN p.ref IN (SELECT e FROM ev) ELSE p.revision = '5' END AS ok FROM p LEFT JOIN memories m ON part = 'memory' AND m.id::VARCHAR = p.ref)
SELECT retrieval_id, bool_and(ok) AS admitted, count(*) FILTER (NOT ok) AS changed FROM j GROUP BY retrieval_id"""))
def context_parts_admission(spark, d):
    a, k = ad.audit(spark, d).filter("kind = 'inject'"), F.col("k")
    part = lambda df, name, ref, rev: df.select(F.col("id").alias("retrieval_id"), F.lit(name).alias("part"), ref.alias("ref"), rev.alias("revision"))
    rows = part(a, "memory", (k + 1).cast("string"), (1 + k % 3).cast("string"))
    rows = rows.unionByName(part(a.filter(k % 2 == 0), "evidence", F.concat(F.lit("v"), (k * 3 + 1).cast("string")), F.lit("")))
    rows = rows.unionByName(part(a, "policy", F.lit("p"), F.when(k % 9 == 0, "4").otherwise("5")))
    return context.admitted(rows, ad.memories(spark, d, False), evidence=ad.citations(spark, d), policy_revision=5)


# ---- links that are taken once


def waiting_nonces(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    cwd, provider = F.concat(F.lit("/w/"), (F.col("user_id") % 9).cast("string")), F.concat(F.lit("m"), (i % 2).cast("string"))
    at = ad.at(F.lit(START) + i * 5)
    w = e.filter(i % 3 != 2).select(F.concat(F.lit("n"), i.cast("string")).alias("nonce"), cwd.alias("cwd"), provider.alias("provider"), at.alias("at"))
    a = e.filter(i % 3 == 2).select(F.concat(F.lit("g"), (i % 700).cast("string")).alias("agent_id"), cwd.alias("cwd"), provider.alias("provider"), at.alias("at"))
    return w, a


@query()
def nonces_taken(spark, d):
    return links.take_once(*waiting_nonces(spark, d))


@query()
def prompts_taken(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    text = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    host, at = text("h", F.col("user_id") % 5), ad.at(F.lit(START) + i * 7)
    w = e.filter(i % 4 != 3).select(
        text("prompt ", i).alias("prompt"), host.alias("host"), F.when(i % 2 == 0, "directory").otherwise("worktree").alias("kind"), F.when(i % 3 != 0, text("/src/", i % 6)).alias("source_dir"),
        F.when(i % 5 == 0, text("project ", i % 10)).alias("project_id"), F.when(i % 2 == 1, text("tree-", i % 8)).alias("slug"), at.alias("at"),
    )
    a = e.filter(i % 4 == 3).select(
        text("g", i).alias("agent_id"), host.alias("host"), F.concat(text("/src/", i % 6), F.lit("/"), text("tree-", i % 9)).alias("cwd"), F.when(i % 2 == 0, text("project ", i % 10)).alias("project_id"),
        text("/src/", i % 4).alias("project_root"), at.alias("at"),
    )
    return links.first_prompts(w, a)


# ---- status


@query(sql("memories marks", f"SELECT count(*) AS entries FROM marks k JOIN memories m ON m.id = k.id AND m.content_hash = k.content_hash AND m.index_generation = k.generation WHERE k.fingerprint = 'fp0' AND {LIVE}"))
def current_index_entries(spark, d):
    return status.current_entries(ad.marks(spark, d), ad.memories(spark, d, False), NOW(), "fp0")


PAGES = "pg AS (SELECT ['vec_a', 'vec_ab', 'vec_b', 'memories'][page_id % 4 + 1] || CASE WHEN page_id % 3 > 0 THEN '_' || page_id ELSE '' END AS name, length(html) AS bytes FROM pages)"


@query(sql("memories marks catalog", f"""+ {PAGES}, b AS (SELECT table_name, sum(bytes) AS bytes FROM (SELECT name, any_value(bytes) AS bytes, (SELECT arg_max(table_name, length(table_name)) FROM catalog c WHERE pg.name = c.table_name OR starts_with(pg.name, c.table_name || '_')) AS table_name FROM (SELECT name, min(bytes) AS bytes FROM pg GROUP BY name) pg GROUP BY name) WHERE table_name IS NOT NULL GROUP BY table_name)
SELECT c.fingerprint, c.model, c.dims, c.state, coalesce(n, 0) AS entries, b.bytes::BIGINT AS bytes, row_number() OVER (ORDER BY model, dims, c.fingerprint) AS generation FROM catalog c LEFT JOIN (SELECT fingerprint, count(*) AS n FROM marks GROUP BY fingerprint) k USING (fingerprint) LEFT JOIN b USING (table_name)"""))
def index_status(spark, d):
    p, i = table(spark, d, "pages"), F.col("page_id")
    name = F.concat(ad._pick(["vec_a", "vec_ab", "vec_b", "memories"], i % 4), F.when(i % 3 > 0, F.concat(F.lit("_"), i.cast("string"))).otherwise(""))
    pages = p.select(name.alias("name"), F.length("html").cast("long").alias("bytes")).groupBy("name").agg(F.min("bytes").alias("bytes"))
    c = status.generations(ad.catalog(spark, d))
    return status.index_status(c, ad.marks(spark, d), status.page_sizes(pages, c)).drop("table_name")


@query(sql("memories marks catalog", "SELECT model, dims, count(DISTINCT id) AS memories FROM catalog JOIN marks USING (fingerprint) GROUP BY model, dims"))
def vectors_by_model(spark, d):
    return indexes.model_counts(ad.marks(spark, d), ad.catalog(spark, d))


@query("SELECT count(*) FILTER (p_size % 7 = 0) AS pending, count(*) FILTER (p_size % 7 BETWEEN 1 AND 4) AS retrying, count(*) FILTER (p_size % 7 >= 5) AS failed FROM part")
def index_health(spark, d):
    return indexes.health(table(spark, d, "part").select((F.col("p_size") % 7).alias("failures")))


@query("SELECT p_partkey, sha256('{\"dims\":' || p_size || ',\"model\":[\"' || p_brand || '\"],\"revision\":[\"' || p_type || '\"]}') AS fingerprint FROM part")
def index_fingerprints(spark, d):
    return table(spark, d, "part").select("p_partkey", status.fingerprint(F.col("p_brand"), F.col("p_size"), F.col("p_type")).alias("fingerprint"))


@query(sql("memories marks catalog usage feedback", f"""SELECT (SELECT count(*) FROM memories WHERE deleted_at IS NULL) AS memories, (SELECT sum(shown_count)::BIGINT FROM memories) AS exposures, (SELECT sum(opened_count)::BIGINT FROM memories) AS opens,
  (SELECT sum(application_count)::BIGINT FROM memories) AS applications, (SELECT sum(helpful_count)::BIGINT FROM memories) AS helpful, (SELECT sum(harmful_count)::BIGINT FROM memories) AS harmful,
  (SELECT count(*) FROM marks k JOIN memories m ON m.id = k.id AND m.content_hash = k.content_hash AND m.index_generation = k.generation WHERE k.fingerprint = 'fp0' AND {LIVE}) AS current_entries,
  1 AS indexes_ready, 1 AS indexes_building, 1 AS indexes_retired, (SELECT count(*) FROM (SELECT DISTINCT producer_id, attempt_id, stage, provenance FROM usage)) AS calls,
  (SELECT sum(t)::BIGINT FROM (SELECT last(input_tokens ORDER BY source_sequence) FILTER (input_tokens IS NOT NULL) AS t FROM usage GROUP BY producer_id, attempt_id, stage, provenance)) AS input_tokens,
  (SELECT count(*) FROM feedback WHERE basis = 'agent_report') AS agent_reported, (SELECT count(*) FROM feedback WHERE basis = 'human') AS human_reported, (SELECT count(*) FROM feedback WHERE basis = 'validator') AS validator_reported"""))
def store_status(spark, d):
    return status.snapshot(ad.memories(spark, d), ad.marks(spark, d), ad.catalog(spark, d), usage.tokens(ad.usage(spark, d)), ad.feedback(spark, d), NOW())


@query(sql("memories audit links projects", """+ e AS (SELECT l.agent_id, a.*, min(CASE WHEN kind = 'inject' THEN id END) OVER (PARTITION BY l.agent_id) AS f FROM audit a JOIN links l USING (nonce)),
p AS (SELECT agent_id, arg_min('p' || (substr(nonce, 2)::BIGINT % 25), (created_at, nonce)) AS project_key FROM links GROUP BY agent_id)
SELECT e.agent_id, e.id, e.kind, CASE e.kind WHEN 'search' THEN 'Searched, ' || k || ' results' WHEN 'get' THEN 'Read #' || k WHEN 'save' THEN 'Saved #' || k WHEN 'inject' THEN 'Injected ' || k || ' memories' WHEN 'denied' THEN 'Denied' END AS line, m.title, q.name AS project_name
FROM e LEFT JOIN memories m ON m.id = e.k AND m.deleted_at IS NULL AND e.kind IN ('get', 'save', 'update') LEFT JOIN p ON p.agent_id = e.agent_id LEFT JOIN projects q ON q.key = p.project_key WHERE f IS NULL OR e.id <> f"""))
def agent_records(spark, d):
    own = ad.links(spark, d).withColumn("project_key", F.concat(F.lit("p"), (F.substring("nonce", 2, 9).cast("long") % 25).cast("string")))
    return status.agent_record(ad.audit(spark, d), own, ad.memories(spark, d, False), ad.projects(spark, d))


# ---- policies and texts


@query("""WITH p(profile, t, c, b, l, n, i) AS (VALUES ('compact', 4096, 3000, 9000, 500, 30, 20), ('standard', 8192, 6000, 18000, 750, 60, 40)),
r AS (SELECT event_id AS id, ['compact', 'standard', 'evidence'][event_id % 3 + 1] AS profile, CASE WHEN event_id % 4 > 0 THEN event_id * 37 % 12000 END AS t, CASE WHEN event_id % 5 > 0 THEN event_id * 11 % 9000 END AS c, CASE WHEN event_id % 2 > 0 THEN event_id * 13 % 90 END AS i FROM events)
SELECT id, p.profile IS NULL AS denied, CASE WHEN p.profile IS NOT NULL THEN least(p.t, r.t) END AS max_tokens, CASE WHEN p.profile IS NOT NULL THEN least(p.c, r.c) END AS max_chars, p.b AS max_bytes, p.l AS max_latency_ms, p.n AS max_candidates, CASE WHEN p.profile IS NOT NULL THEN least(p.i, r.i) END AS max_items FROM r LEFT JOIN p USING (profile)""")
def policy_limits(spark, d):
    """What the policy leaves of the budgets that the events' requests name."""
    e, i = table(spark, d, "events"), F.col("event_id")
    r = e.select(i.alias("id"), ad._pick(["compact", "standard", "evidence"], i % 3).alias("profile"), F.when(i % 4 > 0, i * 37 % 12000).alias("max_tokens"), F.when(i % 5 > 0, i * 11 % 9000).alias("max_chars"), F.when(i % 2 > 0, i * 13 % 90).alias("max_items"))
    return policy.resolved_limits(r, policy.Policy()).drop("profile")


@query("SELECT count(*) AS n, 'BIGINT' AS id_type, 'DOUBLE' AS value_type FROM events")
def column_types(spark, d):
    names = {"bigint": "BIGINT", "double": "DOUBLE"}
    name = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.typeof(F.col(c)))
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.first(name("event_id")).alias("id_type"), F.first(name("value")).alias("value_type"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN CASE WHEN turn % 3 = 0 THEN 'hidden' ELSE 'shown' END WHEN turn % 3 = 2 THEN 'shown' WHEN turn % 3 = 1 THEN 'hidden' ELSE 'review' END AS view FROM conversations WHERE role <> 'system'""")
def timeline_views(spark, d):
    c = table(spark, d, "conversations").filter("role <> 'system'")
    how = ad._pick(["collapsed", "hidden", "full"], F.col("turn") % 3)
    prompt = F.when(F.col("turn") % 3 == 0, F.lit(tx.REVIEW_PROMPT + " hidden]\nplease")).otherwise(F.lit("please"))
    reply = F.concat(F.lit(tx.REVIEW_MARKER + " "), how, F.lit("]\nSaved: #1\n"))
    view = F.when(F.col("role") == "user", tx.user_view(prompt)).otherwise(tx.assistant_view(reply, F.lit("complete")))
    return c.select("conv_id", "turn", view.alias("view"))


# ---- sessions, writes and migrations


@query(sql("turns", f"""+ se AS (SELECT agent_id AS id, first(project_key ORDER BY seq) AS project_key, max(ts) AS u FROM turns WHERE trim(assistant_text) <> '' AND NOT regexp_matches(assistant_text, '(?i)^\\s*\\[(system )?error\\]') GROUP BY agent_id)
SELECT id, row_number() OVER (ORDER BY u DESC, id) AS rank FROM se WHERE project_key = '{PROJECT}' QUALIFY rank <= 4"""))
def sessions_of_project(spark, d):
    return sessions.list_sessions(sessions.fold_turns(ad.turns(spark, d)), 4, PROJECT)


@query(sql("memories tombstones", """+ n AS (SELECT greatest(max(id), (SELECT max(identifier::BIGINT) FROM tombstones WHERE kind = 'memory')) + 1 AS next_id FROM memories)
SELECT next_id + row_number() OVER (ORDER BY item_id) - 1 AS id, substr(text, 1, 20) AS title, 1 AS revision, 0 AS shown_count FROM benchmark CROSS JOIN n"""))
def inserted_drafts(spark, d):
    m = ad.memories(spark, d, False)
    b = table(spark, d, "benchmark")
    drafts = b.select(F.col("item_id").alias("seq"), F.substring("text", 1, 20).alias("title"), F.col("text").alias("content"), F.lit("global").alias("scope"))
    out = state.inserted(m, drafts, lineage.next_id(m, ad.tombstones(spark, d)), NOW())
    return out.join(m.select("id"), "id", "left_anti").select("id", "title", "revision", "shown_count")


@query(sql("memories", "SELECT id AS memory_id, revision + 1 AS revision, 0 AS application_count, true AS kept FROM memories WHERE id % 4 = 0 AND title <> 'New' OR id % 4 = 1 AND type <> 'note'"))
def kept_snapshots(spark, d):
    m = ad.memories(spark, d, False)
    none = F.lit(None).cast("string")
    p = m.filter("id % 4 < 2").select("id", F.when(F.col("id") % 4 == 0, "New").alias("title"), none.alias("content"), F.when(F.col("id") % 4 == 1, "note").alias("type"), F.lit(None).cast("boolean").alias("pinned"))
    after = state.patched(m, p).drop("change")
    kept = state.snapshots(m, after)
    count = state.reset_counters(m, after).select(F.col("id").alias("memory_id"), "application_count")
    return kept.join(count, "memory_id").select("memory_id", "revision", "application_count", F.contains("snapshot", F.lit('"title"')).alias("kept"))


@query(sql("memories", "SELECT scope, count(*) AS n, count(*) FILTER (state = 'active') AS active, 1 AS revision FROM (SELECT id, scope, project_key, 'active' AS state FROM memories) GROUP BY scope"))
def migrated_table(spark, d):
    from ..sources.tables import migrate

    old = ad.memories(spark, d, False).select("id", "scope", "project_key", "title", "content")
    new = migrate(old, 1)
    return new.groupBy("scope").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "active").alias("active"), F.max("revision").cast("int").alias("revision"))


SESSIONS = rf"""se AS (SELECT agent_id AS id, first(project_key ORDER BY seq) AS project_key, max(ts) AS u FROM turns WHERE trim(assistant_text) <> '' AND NOT regexp_matches(assistant_text, '(?i)^\s*\[(system )?error\]') GROUP BY agent_id)"""


@query(sql("turns links tombstones", f"""+ {SESSIONS}, asked AS (SELECT item_id * 3 AS id FROM benchmark) SELECT id FROM se WHERE project_key = '{PROJECT}' AND id IN (SELECT id FROM asked) AND id::VARCHAR NOT IN (SELECT identifier FROM tombstones WHERE kind = 'session')"""))
def sessions_visible(spark, d):
    asked = table(spark, d, "benchmark").select((F.col("item_id") * 3).alias("id"))
    s = sessions.fold_turns(ad.turns(spark, d))
    return sessions.visible_sessions(s, asked, AGENT, ad.tombstones(spark, d), ad.links(spark, d)).select("id")


@query(sql("memories turns projects", f"+ {SESSIONS} SELECT se.id, p.name AS project_name, row_number() OVER (PARTITION BY se.project_key ORDER BY u DESC, se.id) AS rank FROM se LEFT JOIN projects p ON p.key = se.project_key QUALIFY rank <= 3"))
def sessions_with_projects(spark, d):
    s = sessions.recent(sessions.fold_turns(ad.turns(spark, d)), 3)
    return links.with_project(s, ad.projects(spark, d)).select("id", "project_name", "rank")


@query()
def sessions_by_words(spark, d):
    """Sessions of a project by keywords: the first benchmark item's."""
    terms = query_terms(spark, d)
    one = terms.join(terms.agg(F.min("query_id").alias("query_id")), "query_id", "left_semi")
    return sessions.list_sessions(sessions.fold_turns(ad.turns(spark, d)), 5, PROJECT, one)


@query(sql("audit", f"SELECT id, kind FROM audit WHERE nonce = 'n7' AND created_at >= {START + 100000} ORDER BY id"))
def events_since(spark, d):
    return usage.events_since(ad.audit(spark, d), "n7", ad.at(START + 100000)).select("id", "kind").orderBy("id")


@query(sql("revisions", "SELECT memory_id, revision FROM revisions QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY revision DESC) <= 2"))
def revision_history(spark, d):
    return lineage.history(ad.revisions(spark, d), 2).select("memory_id", "revision")


@query(sql("usage", """+ w AS (SELECT producer_id, attempt_id, stage, source_sequence % 50 AS source_sequence, source_sequence AS n, 'e' || (source_sequence % 4000) AS event_id, currency FROM usage),
j AS (SELECT n, min(n) OVER (PARTITION BY producer_id, event_id) <> max(n) OVER (PARTITION BY producer_id, event_id) AS same_id, min(event_id) OVER s <> max(event_id) OVER s AS same_sequence FROM w WINDOW s AS (PARTITION BY producer_id, attempt_id, stage, source_sequence))
SELECT count(*) FILTER (same_id) AS id_conflicts, count(*) FILTER (same_sequence) AS sequence_conflicts FROM j"""))
def usage_identity_conflicts(spark, d):
    i = F.col("source_sequence")
    u = ad.usage(spark, d).select("producer_id", "attempt_id", "stage", (i % 50).alias("source_sequence"), i.alias("n"), F.concat(F.lit("e"), (i % 4000).cast("string")).alias("event_id"), "currency")
    c = usage.conflicts(u)
    return c.agg(F.count_if("id_conflict").alias("id_conflicts"), F.count_if("sequence_conflict").alias("sequence_conflicts"))


@query(sql("turns", "+ r AS (SELECT agent_id AS nonce, seq, CASE seq % 5 WHEN 0 THEN 'reserved' WHEN 1 THEN 'committed' ELSE 'released' END AS status FROM turns) SELECT CASE status WHEN 'reserved' THEN 'released' ELSE status END AS status, count(*) AS n FROM r GROUP BY 1"))
def released_slots(spark, d):
    t = ad.turns(spark, d).select("seq", F.when(F.col("seq") % 5 == 0, "reserved").when(F.col("seq") % 5 == 1, "committed").otherwise("released").alias("status"))
    return review.release_stale(t).groupBy("status").agg(F.count("*").alias("n"))

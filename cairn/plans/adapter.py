"""The engine's tables derived from the synthetic test tables, as Spark plans and as the same thing in SQL.

Namespaces and kinds follow n_chars, so equal texts meet in one namespace; activity follows doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table

TYPES = "decision preference convention bugfix config architecture discovery note workflow".split()
KINDS = "fact preference procedure episode derived_summary artifact".split()
OTHER_STATES = "candidate archived superseded rejected needs_recheck".split()
#: Seconds of 2024-01-01 and of the fixed present, 2024-12-31 (UTC).
START, NOW_S = 1704067200, 1735603200
DAY = 86400


def at(seconds: Column | int) -> Column:
    return F.timestamp_seconds(F.lit(seconds) if isinstance(seconds, int) else seconds)


NOW = lambda: at(NOW_S)


def _pick(values: list[str], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), i.cast("int"))


def count(spark: SparkSession, folder: str) -> Column:
    """How many memories there are, from the footers of the files."""
    return F.lit(table(spark, folder, "documents").count()).cast("long")


#: Rows of a namespace that have a topic key.
TOPICS = 5


def topics(spark: SparkSession, folder: str) -> DataFrame:
    """id and topic_key of the first rows of each namespace. The rank limit cuts each task's rows before the shuffle, so
    ids alone travel, a few for each namespace and task."""
    n = F.col("n_chars")
    key = F.when(n % 4 != 0, (n % 20).cast("string")).otherwise("global")
    w = Window.partitionBy("_key").orderBy("id")
    rows = table(spark, folder, "documents").select((F.col("doc_id") + 1).alias("id"), key.alias("_key"))
    rows = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= TOPICS)
    return rows.select(F.col("id").alias("_t"), F.concat(F.lit("topic-"), F.col("_n").cast("string")).alias("topic_key"))


def memories(spark: SparkSession, folder: str, counts: bool = True) -> DataFrame:
    """The memories; without counts the two counters that come from labels are null and no join is made for them."""
    d, n, i = table(spark, folder, "documents"), F.col("n_chars"), F.col("doc_id")
    if counts:
        labels = table(spark, folder, "labels").select(F.col("doc_id").alias("_l"), "quality", "toxic")
        d = d.join(labels, i == F.col("_l"), "left")
    else:
        d = d.withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    updated = F.lit(START) + i * 3600

    def when(c: Column, v: Column) -> Column:
        return F.when(c, at(v))

    df = d.select(
        (i + 1).alias("id"),
        F.when(n % 4 == 0, "global").otherwise("project").alias("scope"),
        F.when(n % 4 != 0, F.concat(F.lit("p"), (n % 20).cast("string"))).alias("project_key"),
        _pick(TYPES, n % 9).alias("type"),
        _pick(KINDS, n % 6).alias("record_kind"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80).alias("title"),
        F.col("text").alias("content"),
        (i % 17 == 0).alias("pinned"),
        F.when(i % 10 == 9, _pick(OTHER_STATES, F.floor(i / 10) % 5)).otherwise("active").alias("state"),
        _pick(["agent", "owner", "import"], n % 3).alias("source"),
        F.concat(F.lit("a"), (n % 7).cast("string")).alias("agent_id"),
        F.concat(F.lit("m"), (n % 2).cast("string")).alias("provider"),
        F.when(n % 5 == 0, "verified").otherwise("unverified").alias("verification_status"),
        at(updated).alias("updated_at"),
        when(i % 7 == 0, updated + DAY).alias("verified_at"),
        when(i % 11 == 0, updated + 2 * DAY).alias("kept_at"),
        when(n % 13 == 0, F.lit(START + 152 * DAY)).alias("valid_from"),
        when(n % 11 == 0, F.lit(START) + F.when(n % 2 == 0, 500 * DAY).otherwise(330 * DAY)).alias("valid_until"),
        when(i % 29 == 28, updated + 3 * DAY).alias("deleted_at"),
        when((i % 10 == 9) & (F.floor(i / 10) % 5 == 1), updated).alias("archived_at"),
        (i % 23).alias("shown_count"),
        (i % 5).alias("opened_count"),
        (i % 9).alias("application_count"),
        (F.coalesce("quality", F.lit(0)) * (i % 4)).alias("helpful_count"),
        (F.coalesce("toxic", F.lit(0)) * (i % 3)).alias("harmful_count"),
        (1 + i % 3).alias("revision"),
        (1 + i % 2).alias("index_generation"),
    )
    df = df.withColumn("content_hash", F.sha2(F.concat_ws("\n", "type", "title", "content"), 256))
    # Namespaces are one global one and 20 projects by construction, so 105 rows are broadcast at most.
    return df.join(F.broadcast(topics(spark, folder)), F.col("id") == F.col("_t"), "left").drop("_t")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    m = memories(spark, folder, counts=False).select("id", F.when(F.col("scope") == "global", "global").otherwise(F.concat(F.lit("project:"), F.substring(F.sha2("project_key", 256), 1, 16))).alias("scope_key"))
    return e.select((F.col("vec_id") + 1).alias("id"), "embedding", "label").join(m, "id")


def relations(spark: SparkSession, folder: str) -> DataFrame:
    i = (F.col("doc_id") + 1).alias("from_id")
    d = table(spark, folder, "documents").select(i).filter("from_id >= 2")
    cycle = F.when(F.col("from_id").between(181, 183), F.when(F.col("from_id") == 183, 181).otherwise(F.col("from_id") + 1))
    tree = d.filter("from_id % 5 <> 0").select("from_id", F.coalesce(cycle, F.floor(F.col("from_id") / 2)).cast("long").alias("to_id"))
    # The revisions that an edge ties together; every eleventh row still cites the first revision of its source.
    newest = lambda c: 1 + (F.col(c) - 1) % 3
    tree = tree.withColumns({"from_revision": newest("from_id"), "to_revision": F.when(F.col("from_id") % 11 == 0, F.lit(1).cast("long")).otherwise(newest("to_id"))})
    return tree.withColumn("kind", F.lit("derived_from"))


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    m = memories(spark, folder, counts=False).select("id", "content_hash")
    i = F.col("id") - 1
    e = m.filter(i % 3 == 0).select(
        F.col("id").alias("memory_id"),
        F.when(i % 30 == 0, F.concat(F.lit("artifact:"), (i % 90).cast("string"))).otherwise(F.concat(F.lit("memory:"), i.cast("string"), F.lit("@1"))).alias("source_ref"),
        i.alias("_src"),
    )
    cited = m.select(F.col("id").alias("_src"), F.col("content_hash").alias("_h"))
    return e.join(cited, "_src", "left").select("memory_id", "source_ref", F.when(F.col("memory_id") % 2 == 0, F.col("_h")).otherwise("outdated").alias("source_hash"))


def pending(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("doc_id % 97 = 5").select((F.col("doc_id") + 1).alias("id"))


def revisions(spark: SparkSession, folder: str) -> DataFrame:
    m = memories(spark, folder, counts=False).select("id", "title", "content", "revision", "state", "valid_from", "valid_until", "scope", "project_key", "agent_id", F.unix_timestamp("updated_at").alias("_u"))
    r = m.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "revision")))
    last = F.col("n") == F.col("revision")
    known = (F.col("n") > 1) | (F.col("id") % 13 != 0)
    return r.select(
        F.col("id").alias("memory_id"),
        F.col("n").alias("revision"),
        F.when(last, F.col("content")).otherwise(F.substring("content", F.lit(1), (F.col("n") * 50).cast("int"))).alias("content"),
        F.when(last, F.col("state")).otherwise("active").alias("state"),
        F.when(last, F.col("valid_from")).alias("valid_from"),
        F.when(last, F.col("valid_until")).alias("valid_until"),
        at(F.col("_u") - (F.col("revision") - F.col("n")) * DAY).alias("changed_at"),
        "title",
        # The namespace of the snapshot is unknown for some old first revisions.
        F.when(known, F.col("scope")).alias("scope"),
        F.when(known, F.col("project_key")).alias("project_key"),
        F.when(F.col("n") == 1, F.col("agent_id")).otherwise("owner").alias("actor_id"),
    )


def projects(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("project_key")
    m = memories(spark, folder, counts=False).filter(k.isNotNull()).select(k).distinct()
    return m.select(k.alias("key"), F.concat(F.lit("Project "), k).alias("name"), F.concat(F.lit("/work/"), k).alias("root_path"), F.concat(F.lit("host-"), F.substring(k, 2, 9)).alias("host_id"))


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("doc_id")
    d = table(spark, folder, "documents").filter((i % 30 == 0) & (i < 90))
    return d.select(
        F.concat(F.lit("artifact:a"), i.cast("string")).alias("source_ref"),
        F.concat(F.lit("body of a"), i.cast("string"), F.lit(" token=abcdefgh12345")).alias("content"),
        F.when(i == 30, "project").otherwise("global").alias("scope"),
        F.when(i == 30, "p3").alias("project_key"),
        (i != 60).alias("allow_excerpt"),
    )


def citations(spark: SparkSession, folder: str) -> DataFrame:
    """What memories cite: artifacts and revisions of other memories, some with a hash that is checked."""
    i = F.col("doc_id")
    artifact, ref = i % 30 == 0, (i % 90).cast("string")
    body = F.concat(F.lit("body of a"), ref, F.lit(" token=abcdefgh12345"))
    return table(spark, folder, "documents").filter(i % 3 == 0).select(
        F.concat(F.lit("v"), (i + 1).cast("string")).alias("evidence_id"),
        (i + 1).alias("memory_id"),
        (1 + i % 3).alias("revision"),
        F.when(artifact, "artifact").otherwise("memory").alias("source_kind"),
        F.when(artifact, F.concat(F.lit("artifact:a"), ref)).otherwise(F.concat(F.lit("memory:"), i.cast("string"), F.lit("@"), (1 + i % 2).cast("string"))).alias("source_ref"),
        F.when(artifact, F.when(i % 2 == 1, F.sha2(body, 256))).otherwise(F.when(i % 5 == 4, F.lit("wrong"))).alias("given_hash"),
        (i % 2 == 0).alias("include_excerpt"),
    )


def tombstones(spark: SparkSession, folder: str) -> DataFrame:
    """Forgotten sources, memories, sessions, callers and principals; a handful."""
    rows = [("source", "artifact:a60"), ("memory", "15"), ("memory", "45"), ("session", "g3"), ("caller", "n7"), ("principal", "agent:9")]
    return spark.createDataFrame(rows, "kind string, identifier string")


def marks(spark: SparkSession, folder: str) -> DataFrame:
    """What each vector was made of; every fourth is of another generation, every seventh of another text."""
    m = memories(spark, folder, counts=False).select("id", "content_hash", "index_generation")
    v = table(spark, folder, "embeddings").select((F.col("vec_id") + 1).alias("id")).join(m, "id")
    return v.select(
        "id",
        F.when(F.col("id") % 7 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(F.col("id") % 4 == 0, 9).otherwise(F.col("index_generation")).cast("long").alias("generation"),
        F.concat(F.lit("fp"), (F.col("id") % 3).cast("string")).alias("fingerprint"),
    )


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Index catalogue: three indexes with their models, widths, states and tables."""
    rows = [("fp0", "static", 256, "ready", "vec_a"), ("fp1", "small", 384, "retired", "vec_ab"), ("fp2", "small", 256, "building", "vec_b")]
    return spark.createDataFrame(rows, "fingerprint string, model string, dims int, state string, table_name string")


def usage(spark: SparkSession, folder: str) -> DataFrame:
    e, i = table(spark, folder, "events"), F.col("event_id")
    stage = F.create_map(*[F.lit(x) for kv in {"view": "retrieval", "click": "review", "purchase": "extraction", "signup": "consolidation", "error": "validation"}.items() for x in kv])
    return e.select(
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("producer_id"),
        i.cast("string").alias("event_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("attempt_id"),
        i.alias("source_sequence"),
        stage[F.col("event_type")].alias("stage"),
        _pick(["started", "completed", "failed", "completed"], i % 4).alias("status"),
        _pick(["provider_observed", "estimated", "unavailable"], i % 3).alias("provenance"),
        F.when(i % 5 != 0, F.floor(F.col("value") * 10)).alias("input_tokens"),
        F.when(i % 7 != 0, F.floor(F.col("value") * 3)).alias("output_tokens"),
        F.when(i % 4 != 0, F.floor(F.col("value") * 100) / 100).alias("cost_amount"),
        _pick(["USD", "EUR"], i % 2).alias("currency"),
        (i * 37 % 1009).alias("duration_ms"),
        at(F.lit(START) + i * 60).alias("created_at"),
    )


def audit(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for kv in {"view": "search", "click": "get", "purchase": "save", "signup": "inject", "error": "denied"}.items() for x in kv])
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("nonce"),
        kind[F.col("event_type")].alias("kind"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        at(F.lit(START) + F.col("event_id") * 60).alias("created_at"),
    )


def links(spark: SparkSession, folder: str) -> DataFrame:
    u = table(spark, folder, "events").select("user_id").distinct()
    return u.select(
        F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("nonce"),
        F.concat(F.lit("g"), (F.col("user_id") % 40).cast("string")).alias("agent_id"),
        at(F.lit(START) + F.col("user_id") * 600).alias("created_at"),
    )


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Events spread over all memories; how many there are is one row, joined to every event."""
    i, n = F.col("event_id"), F.col("_n")
    many = table(spark, folder, "documents").agg((F.max("doc_id") + 1).alias("_n"))
    return table(spark, folder, "events").crossJoin(F.broadcast(many)).select(
        i.alias("event_id"),
        (i * 7 % n + 1).alias("memory_id"),
        (1 + i % 3).alias("revision"),
        _pick(["applied", "helpful", "harmful", "irrelevant"], i % 4).alias("signal"),
        _pick(["validator", "human", "agent_report"], F.floor(i / 4) % 3).alias("basis"),
        F.array(F.concat(F.lit("e"), (i % 53).cast("string")), F.concat(F.lit("e"), (i % 31).cast("string"))).alias("evidence_refs"),
        F.when(i % 6 == 0, at(F.lit(START) + i * 3600)).alias("support_valid_until"),
    )


def turns(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations").filter("role <> 'system'")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumns({"_p": F.lag("text").over(w), "_r": F.lag("role").over(w)})
    return c.filter("role = 'assistant'").select(
        F.col("conv_id").alias("agent_id"),
        F.col("turn").alias("seq"),
        at(F.lit(START) + F.col("conv_id") * 3600 + F.col("turn") * 300).alias("ts"),
        F.concat(F.lit("p"), (F.col("conv_id") % 20).cast("string")).alias("project_key"),
        F.concat(F.lit("m"), (F.col("turn") % 3).cast("string")).alias("provider"),
        F.when(F.col("turn") % 4 == 1, F.concat(F.lit("title "), F.col("turn").cast("string"))).alias("title"),
        F.when(F.col("_r") == "user", F.col("_p")).alias("user_text"),
        F.col("text").alias("assistant_text"),
        F.array(F.concat(F.lit("f"), (F.col("turn") % 3).cast("string")), F.lit("main")).alias("files"),
        (F.floor(F.col("turn") / 3)).alias("native_turn"),
    )


SQL = {
    "memories": f"""
  SELECT *, CASE WHEN nth <= 5 THEN 'topic-' || nth END AS topic_key, sha256(type || chr(10) || title || chr(10) || content) AS content_hash
  FROM (SELECT *, row_number() OVER (PARTITION BY scope, project_key ORDER BY id) AS nth FROM (
    SELECT d.doc_id + 1 AS id, CASE WHEN n_chars % 4 = 0 THEN 'global' ELSE 'project' END AS scope,
      CASE WHEN n_chars % 4 <> 0 THEN 'p' || (n_chars % 20) END AS project_key,
      {TYPES!r}[n_chars % 9 + 1] AS type, {KINDS!r}[n_chars % 6 + 1] AS record_kind,
      substr(split_part(text, chr(10), 1), 1, 80) AS title, text AS content, d.doc_id % 17 = 0 AS pinned,
      CASE WHEN d.doc_id % 10 = 9 THEN {OTHER_STATES!r}[(d.doc_id // 10) % 5 + 1] ELSE 'active' END AS state,
      ['agent', 'owner', 'import'][n_chars % 3 + 1] AS source, 'a' || (n_chars % 7) AS agent_id, 'm' || (n_chars % 2) AS provider,
      CASE WHEN n_chars % 5 = 0 THEN 'verified' ELSE 'unverified' END AS verification_status,
      {START} + d.doc_id * 3600 AS updated_at,
      CASE WHEN d.doc_id % 7 = 0 THEN {START} + d.doc_id * 3600 + {DAY} END AS verified_at,
      CASE WHEN d.doc_id % 11 = 0 THEN {START} + d.doc_id * 3600 + {2 * DAY} END AS kept_at,
      CASE WHEN n_chars % 13 = 0 THEN {START + 152 * DAY} END AS valid_from,
      CASE WHEN n_chars % 11 = 0 THEN CASE WHEN n_chars % 2 = 0 THEN {START + 500 * DAY} ELSE {START + 330 * DAY} END END AS valid_until,
      CASE WHEN d.doc_id % 29 = 28 THEN {START} + d.doc_id * 3600 + {3 * DAY} END AS deleted_at,
      CASE WHEN d.doc_id % 10 = 9 AND (d.doc_id // 10) % 5 = 1 THEN {START} + d.doc_id * 3600 END AS archived_at,
      d.doc_id % 23 AS shown_count, d.doc_id % 5 AS opened_count, d.doc_id % 9 AS application_count,
      coalesce(quality, 0) * (d.doc_id % 4) AS helpful_count, coalesce(toxic, 0) * (d.doc_id % 3) AS harmful_count,
      1 + d.doc_id % 3 AS revision, 1 + d.doc_id % 2 AS index_generation
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id))""",
    "vecs": """
  SELECT vec_id + 1 AS id, embedding::DOUBLE[] AS embedding, label,
    CASE WHEN scope = 'global' THEN 'global' ELSE 'project:' || substr(sha256(project_key), 1, 16) END AS scope_key
  FROM embeddings JOIN memories ON memories.id = vec_id + 1""",
    "relations": """
  SELECT from_id, to_id, 1 + (from_id - 1) % 3 AS from_revision, CASE WHEN from_id % 11 = 0 THEN 1 ELSE 1 + (to_id - 1) % 3 END AS to_revision FROM (
    SELECT from_id, CASE WHEN from_id BETWEEN 181 AND 183 THEN CASE WHEN from_id = 183 THEN 181 ELSE from_id + 1 END ELSE from_id // 2 END AS to_id
    FROM (SELECT doc_id + 1 AS from_id FROM documents) WHERE from_id >= 2 AND from_id % 5 <> 0)""",
    "evidence": """
  SELECT m.id AS memory_id, CASE WHEN (m.id - 1) % 30 = 0 THEN 'artifact:' || ((m.id - 1) % 90) ELSE 'memory:' || (m.id - 1) || '@1' END AS source_ref,
    CASE WHEN m.id % 2 = 0 THEN c.content_hash ELSE 'outdated' END AS source_hash, m.id - 1 AS src
  FROM memories m LEFT JOIN memories c ON c.id = m.id - 1 WHERE (m.id - 1) % 3 = 0""",
    "pending": "SELECT doc_id + 1 AS id FROM documents WHERE doc_id % 97 = 5",
    "revisions": f"""
  SELECT id AS memory_id, n AS revision, CASE WHEN n = revision THEN content ELSE substr(content, 1, n * 50) END AS content,
    CASE WHEN n = revision THEN state ELSE 'active' END AS state, CASE WHEN n = revision THEN valid_from END AS valid_from,
    CASE WHEN n = revision THEN valid_until END AS valid_until, updated_at - (revision - n) * {DAY} AS changed_at,
    title, CASE WHEN n > 1 OR id % 13 <> 0 THEN scope END AS scope, CASE WHEN n > 1 OR id % 13 <> 0 THEN project_key END AS project_key,
    CASE WHEN n = 1 THEN agent_id ELSE 'owner' END AS actor_id
  FROM (SELECT *, unnest(range(1, revision + 1)) AS n FROM memories)""",
    "usage": f"""
  SELECT 'p' || (user_id % 3) AS producer_id, 'u' || user_id AS attempt_id, event_id AS source_sequence,
    CASE event_type WHEN 'view' THEN 'retrieval' WHEN 'click' THEN 'review' WHEN 'purchase' THEN 'extraction' WHEN 'signup' THEN 'consolidation' WHEN 'error' THEN 'validation' END AS stage,
    ['started', 'completed', 'failed', 'completed'][event_id % 4 + 1] AS status,
    ['provider_observed', 'estimated', 'unavailable'][event_id % 3 + 1] AS provenance,
    CASE WHEN event_id % 5 <> 0 THEN floor(value * 10)::BIGINT END AS input_tokens, CASE WHEN event_id % 7 <> 0 THEN floor(value * 3)::BIGINT END AS output_tokens,
    CASE WHEN event_id % 4 <> 0 THEN floor(value * 100) / 100 END AS cost_amount, ['USD', 'EUR'][event_id % 2 + 1] AS currency,
    event_id * 37 % 1009 AS duration_ms, {START} + event_id * 60 AS created_at
  FROM events""",
    "audit": f"""
  SELECT event_id AS id, 'n' || user_id AS nonce, (props::JSON ->> '$.k')::BIGINT AS k, {START} + event_id * 60 AS created_at,
    CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'get' WHEN 'purchase' THEN 'save' WHEN 'signup' THEN 'inject' WHEN 'error' THEN 'denied' END AS kind
  FROM events""",
    "links": f"SELECT DISTINCT 'n' || user_id AS nonce, 'g' || (user_id % 40) AS agent_id, {START} + user_id * 600 AS created_at FROM events",
    "feedback": f"""
  SELECT event_id, event_id * 7 % (SELECT max(doc_id) + 1 FROM documents) + 1 AS memory_id, 1 + event_id % 3 AS revision, ['applied', 'helpful', 'harmful', 'irrelevant'][event_id % 4 + 1] AS signal,
    ['validator', 'human', 'agent_report'][(event_id // 4) % 3 + 1] AS basis, ['e' || (event_id % 53), 'e' || (event_id % 31)] AS evidence_refs,
    CASE WHEN event_id % 6 = 0 THEN {START} + event_id * 3600 END AS support_valid_until
  FROM events""",
    "turns": f"""
  SELECT conv_id AS agent_id, turn AS seq, {START} + conv_id * 3600 + turn * 300 AS ts, 'p' || (conv_id % 20) AS project_key, 'm' || (turn % 3) AS provider,
    CASE WHEN turn % 4 = 1 THEN 'title ' || turn END AS title, CASE WHEN r = 'user' THEN p END AS user_text, text AS assistant_text,
    ['f' || (turn % 3), 'main'] AS files, turn // 3 AS native_turn
  FROM (SELECT *, lag(text) OVER w AS p, lag(role) OVER w AS r FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'assistant'""",
}
BODY = "'body of a' || ({0}) || ' token=abcdefgh12345'"
SQL |= {
    "projects": "SELECT DISTINCT project_key AS key, 'Project ' || project_key AS name, '/work/' || project_key AS root_path, 'host-' || substr(project_key, 2) AS host_id FROM memories WHERE project_key IS NOT NULL",
    "artifacts": f"""
  SELECT 'artifact:a' || doc_id AS source_ref, {BODY.format("doc_id")} AS content, CASE WHEN doc_id = 30 THEN 'project' ELSE 'global' END AS scope,
    CASE WHEN doc_id = 30 THEN 'p3' END AS project_key, doc_id <> 60 AS allow_excerpt FROM documents WHERE doc_id % 30 = 0 AND doc_id < 90""",
    "citations": f"""
  SELECT 'v' || (doc_id + 1) AS evidence_id, doc_id + 1 AS memory_id, 1 + doc_id % 3 AS revision, CASE WHEN doc_id % 30 = 0 THEN 'artifact' ELSE 'memory' END AS source_kind,
    CASE WHEN doc_id % 30 = 0 THEN 'artifact:a' || (doc_id % 90) ELSE 'memory:' || doc_id || '@' || (1 + doc_id % 2) END AS source_ref,
    CASE WHEN doc_id % 30 = 0 THEN CASE WHEN doc_id % 2 = 1 THEN sha256({BODY.format("doc_id % 90")}) END WHEN doc_id % 5 = 4 THEN 'wrong' END AS given_hash,
    doc_id % 2 = 0 AS include_excerpt FROM documents WHERE doc_id % 3 = 0""",
    "tombstones": "SELECT * FROM (VALUES ('source', 'artifact:a60'), ('memory', '15'), ('memory', '45'), ('session', 'g3'), ('caller', 'n7'), ('principal', 'agent:9')) t(kind, identifier)",
    "marks": """
  SELECT m.id, CASE WHEN m.id % 7 = 0 THEN 'old' ELSE content_hash END AS content_hash, CASE WHEN m.id % 4 = 0 THEN 9 ELSE index_generation END AS generation,
    'fp' || (m.id % 3) AS fingerprint FROM embeddings e JOIN memories m ON m.id = e.vec_id + 1""",
    "catalog": "SELECT * FROM (VALUES ('fp0', 'static', 256, 'ready', 'vec_a'), ('fp1', 'small', 384, 'retired', 'vec_ab'), ('fp2', 'small', 256, 'building', 'vec_b')) t(fingerprint, model, dims, state, table_name)",
}
#: What each table needs before it.
NEEDS = {x: ["memories"] for x in ("vecs", "evidence", "revisions", "projects", "marks")}


def sql(names: str, body: str, recursive: bool = False) -> str:
    """body after the named tables. body may begin with more tables and a comma-free WITH-less list, marked by '+'."""
    order: list[str] = []
    for n in names.split():
        for x in [*NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    if body.lstrip().startswith("+"):
        ctes, body = f"{ctes},\n{body.lstrip()[1:]}", ""
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"

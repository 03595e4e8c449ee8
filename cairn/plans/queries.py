"""Registered queries over the derived tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stemming import stem_column
from ..functions.scoring import context_relevance, is_task_match, sigmoid
from ..operators import context, erasure, indexes, lineage, mutations, review, search, sessions, upkeep, usage
from ..operators.access import Access, denied_ids, quarantined, stale
from ..operators.cells import VectorStore
from ..operators.graph import shared_folder
from ..operators.inverted import InvertedIndex
from ..sources.embedder import hash_embedding
from ..sources.tables import longest_prefix, table
from . import adapter as ad
from .adapter import DAY, NOW, NOW_S, START, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
PROJECT = "p3"
AGENT, OWNER, FOCUS = Access(False, PROJECT), Access(True), Access(True, PROJECT)
CURRENT = f"state = 'active' AND (valid_from IS NULL OR valid_from <= {NOW_S}) AND (valid_until IS NULL OR {NOW_S} < valid_until)"
VISIBLE = f"deleted_at IS NULL AND {CURRENT} AND (scope = 'global' OR project_key = '{PROJECT}')"
LIVE = f"deleted_at IS NULL AND {CURRENT}"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def seconds(c: str | Column) -> Column:
    return F.unix_timestamp(c)


def visible(spark: SparkSession, d: str, counts: bool = False) -> DataFrame:
    return ad.memories(spark, d, counts).filter(AGENT.memory_filter(NOW()))


# ---- text in SQL


def sql_flat(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def sql_clip(x: str, most: int) -> str:
    one = sql_flat(x)
    return f"CASE WHEN length({one}) <= {most} THEN {one} ELSE substr({one}, 1, {most - 1}) || '…' END"


def sql_redact(x: str) -> str:
    x = rf"regexp_replace({x}, '<private>[\s\S]*?</private>', '[private]', 'gi')"
    for pattern, put in tx.SECRET_SHAPES[:-1]:
        x = "regexp_replace({}, '{}', '{}', 'g')".format(x, pattern, put.replace("$", "\\"))
    name = r"\b([A-Za-z0-9_]*(?:api[_-]?key|secret|token|password|passwd|app[_-]?key)[A-Za-z0-9_]*)(\s*[:=]\s*)"
    for q in ('"', "''", ""):
        x = rf"regexp_replace({x}, '{name}{q}[^\s\"'']{{8,}}{q}', '\1\2{q}[REDACTED]{q}', 'gi')"
    return x


SQL_WORDS = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_\-/]+'), lambda x: x <> '')"
SQL_TERMS = (
    r"list_filter(list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_\-./]+'), lambda x: regexp_replace(x, '^[-./]+|[-./]+$', '', 'g')), "
    rf"lambda x: length(x) >= 2 AND x NOT IN {tuple(tx.STOP_WORDS)!r})"
)
#: Distinct in order of first sighting, then the first 16.
SQL_FIRST_TERMS = f"list_transform(list_filter(list_transform({SQL_TERMS}, lambda x, i: {{'x': x, 'i': i}}), lambda s: list_position({SQL_TERMS}, s.x) = s.i), lambda s: s.x)[1:{tx.MAX_TERMS}]"
TERMS = f"terms AS (SELECT item_id AS query_id, unnest({SQL_FIRST_TERMS}) AS term FROM benchmark)"
VALUES = r"""list_distinct(list_transform(regexp_extract_all({0}, '(?i)`[^`]+`|"[^"]+"|\b\d+(?:[.:]\d+)*(?:%|ms|s|m|h|d|kb|mb|gb)?\b'), lambda x: lower(x)))"""
NEGATED = "regexp_matches({0}, '" + tx.NEGATION.replace("'", "''") + "')"


def sql_bm25(docs: str, weights: dict[str, float], name: str = "bm") -> str:
    size = " + ".join(f"len({SQL_WORDS.format(c)})" for c in weights)
    parts = " UNION ALL ".join(f"SELECT id, unnest({SQL_WORDS.format(c)}) AS term, {w} AS w FROM {docs}" for c, w in weights.items())
    return f"""{TERMS},
{name}_size AS (SELECT id, {size} AS size FROM {docs}),
{name}_about AS (SELECT count(*) AS n, avg(size) AS mean FROM {name}_size),
{name}_tf AS (SELECT id, term, sum(w) AS tf FROM ({parts}) WHERE term IN (SELECT term FROM terms) GROUP BY id, term),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name} AS (
  SELECT query_id, id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score
  FROM {name}_tf JOIN {name}_df USING (term) JOIN terms USING (term) JOIN {name}_size USING (id) CROSS JOIN {name}_about GROUP BY query_id, id
)"""


def query_terms(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.explode(tx.search_terms(F.col("text"))).alias("term"))


# ---- listing and authorisation


@query(sql("memories", f"SELECT id, scope, type, title, updated_at AS updated_s FROM memories WHERE {VISIBLE} ORDER BY pinned DESC, updated_at DESC, id LIMIT 50"))
def list_visible(spark, d):
    rows = visible(spark, d).orderBy(F.desc("pinned"), F.desc("updated_at"), "id").limit(50)
    return rows.select("id", "scope", "type", "title", seconds("updated_at").alias("updated_s"))


@query(sql("memories", f"""SELECT id, project_key FROM memories WHERE {LIVE} AND NOT pinned
  AND greatest(updated_at, coalesce(verified_at, updated_at), coalesce(kept_at, updated_at)) < {NOW_S - 340 * DAY}"""))
def list_stale(spark, d):
    return ad.memories(spark, d, False).filter(OWNER.memory_filter(NOW()) & stale(NOW(), 340)).select("id", "project_key")


@query(sql("memories", f"SELECT record_kind, count(*) AS pinned FROM memories WHERE {VISIBLE} AND pinned AND record_kind IN ('fact', 'preference', 'procedure') GROUP BY record_kind"))
def count_pinned(spark, d):
    m = ad.memories(spark, d, False).filter(AGENT.memory_filter(NOW(), kinds=["fact", "preference", "procedure"]) & F.col("pinned"))
    return m.groupBy("record_kind").agg(F.count("*").alias("pinned"))


@query(sql("memories turns", "SELECT (SELECT count(*) FROM memories WHERE deleted_at IS NULL) AS memories, (SELECT count(DISTINCT project_key) FROM memories) AS projects, (SELECT count(DISTINCT agent_id) FROM turns) AS sessions"))
def store_stats(spark, d):
    m = ad.memories(spark, d, False).agg(F.count_if(F.col("deleted_at").isNull()).alias("memories"), F.countDistinct("project_key").alias("projects"))
    return m.crossJoin(ad.turns(spark, d).agg(F.countDistinct("agent_id").alias("sessions")))


@query(sql("memories", f"SELECT scope, project_key, type, count(*) AS n FROM memories WHERE {VISIBLE} AND type IN ('decision', 'note', 'config') GROUP BY ALL"))
def access_matrix_agent(spark, d):
    m = ad.memories(spark, d, False).filter(AGENT.memory_filter(NOW(), types=["decision", "note", "config"]))
    return m.groupBy("scope", "project_key", "type").agg(F.count("*").alias("n"))


@query(sql("memories", f"SELECT 'all' AS reach, count(*) AS n FROM memories WHERE {LIVE} AND (scope = 'global' OR project_key = 'p3') UNION ALL SELECT 'project', count(*) FROM memories WHERE {LIVE} AND project_key = 'p3' UNION ALL SELECT 'global', count(*) FROM memories WHERE {LIVE} AND scope = 'global' UNION ALL SELECT 'owner', count(*) FROM memories WHERE {LIVE}"))
def access_owner_focus(spark, d):
    m = ad.memories(spark, d, False)
    counts = [F.count_if(FOCUS.memory_filter(NOW(), r)).alias(r) for r in ("all", "project", "global")]
    one = m.agg(*counts, F.count_if(OWNER.memory_filter(NOW())).alias("owner"))
    return one.select(F.expr("stack(4, 'all', `all`, 'project', project, 'global', global, 'owner', owner) as (reach, n)"))


@query(sql("memories", "SELECT id FROM memories WHERE scope = 'project' AND project_key <> 'p3'"))
def access_denied(spark, d):
    m = ad.memories(spark, d, False)
    return denied_ids(m.select("id"), m, AGENT)


@query(sql("memories relations pending", f"""SELECT record_kind, count(*) AS n FROM memories WHERE {LIVE} AND NOT ((SELECT count(*) FROM pending) > 0
  AND (record_kind = 'derived_summary' OR id IN (SELECT from_id FROM relations))) GROUP BY record_kind"""))
def quarantine_global(spark, d):
    m = ad.memories(spark, d, False).filter(OWNER.memory_filter(NOW()))
    return quarantined(m, ad.relations(spark, d), ad.pending(spark, d)).groupBy("record_kind").agg(F.count("*").alias("n"))


ANCESTORS = "anc AS (SELECT DISTINCT from_id AS id, from_id AS ancestor FROM relations UNION SELECT anc.id, r.to_id FROM anc JOIN relations r ON r.from_id = anc.ancestor)"


@query(sql("memories relations pending", f"""+ {ANCESTORS} SELECT record_kind, count(*) AS n FROM memories WHERE {LIVE} AND id NOT IN (SELECT id FROM pending)
  AND id NOT IN (SELECT id FROM anc WHERE ancestor IN (SELECT id FROM pending)) GROUP BY record_kind""", True))
def quarantine_ancestry(spark, d):
    m = ad.memories(spark, d, False).filter(OWNER.memory_filter(NOW()))
    return quarantined(m, ad.relations(spark, d), ad.pending(spark, d), "ancestry").groupBy("record_kind").agg(F.count("*").alias("n"))


# ---- search


@query(sql("memories", f"SELECT id, row_number() OVER (ORDER BY pinned DESC, id) AS rank FROM memories WHERE {VISIBLE} AND lower(topic_key) = 'topic-2' QUALIFY count(*) OVER () <= 5"))
def exact_title_lookup(spark, d):
    return search.exact_candidates(visible(spark, d), " Topic-2 ").select("id", "rank")


@query(sql("memories", f"SELECT id, 1 AS rank FROM memories WHERE {VISIBLE} AND id = 4"))
def exact_id_lookup(spark, d):
    return search.exact_candidates(visible(spark, d), "#4").select("id", "rank")


@query(sql("memories", f"SELECT id, row_number() OVER (ORDER BY updated_at DESC, id) AS rank FROM memories WHERE {VISIBLE} AND (contains(lower(title), 'shor') OR contains(lower(content), 'shor') OR contains(lower(coalesce(topic_key, '')), 'shor')) ORDER BY updated_at DESC, id LIMIT 20"))
def like_fallback(spark, d):
    m = visible(spark, d)
    nothing = spark.createDataFrame([], "id long")
    return search.like_fallback(m, "sh%or", nothing, 20)


@query(f"WITH t AS (SELECT item_id, {SQL_FIRST_TERMS} AS t FROM benchmark) SELECT item_id, array_to_string(t, ' ') AS terms FROM t")
def fts_tokens(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.coalesce(F.array_join(tx.search_terms(F.col("text")), " "), F.lit("")).alias("terms"))


BM25 = sql_bm25("(SELECT * FROM memories WHERE deleted_at IS NULL)", search.MEMORY_WEIGHTS)


@query(sql("memories", f"+ {BM25} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm WHERE id IN (SELECT id FROM memories WHERE {VISIBLE}) QUALIFY rank <= 60"))
def bm25_search(spark, d):
    m = ad.memories(spark, d, False).filter("deleted_at is null")
    found = search.bm25(m, query_terms(spark, d), visible=visible(spark, d))
    return search.top(found, 60).select("query_id", "id", "score", "rank")


def stored_index(spark: SparkSession, d: str) -> InvertedIndex:
    """An index of the live memories in the shared folder: first of the even ids, then of all, so that it has segments."""
    m = ad.memories(spark, d, False).filter("deleted_at is null")
    index = InvertedIndex(spark, f"{shared_folder(spark)}/inverted-{uuid.uuid4().hex}")
    index.update(m.filter("id % 2 = 0").withColumn("content", F.when(F.col("id") % 6 == 0, F.concat(F.lit("old "), "content")).otherwise(F.col("content"))).withColumn("revision", F.when(F.col("id") % 6 == 0, -1).otherwise(F.col("revision"))))
    index.update(m)
    return index


@query(ORACLE_SQL["bm25_search"])
def indexed_search(spark, d):
    return stored_index(spark, d).search(query_terms(spark, d), 60, visible(spark, d)).select("query_id", "id", "score", "rank")


def folded_memories(spark: SparkSession, d: str) -> DataFrame:
    m = ad.memories(spark, d, False).filter("deleted_at is null")
    return m.withColumns({c: tx.folded(F.col(c)) for c in search.MEMORY_WEIGHTS})


FOLDED_BM25 = sql_bm25(f"(SELECT id, {', '.join(f'strip_accents({c}) AS {c}' for c in search.MEMORY_WEIGHTS)} FROM memories WHERE deleted_at IS NULL)", search.MEMORY_WEIGHTS).replace("FROM benchmark", "FROM (SELECT item_id, strip_accents(text) AS text FROM benchmark)")


@query(sql("memories", f"+ {FOLDED_BM25} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm WHERE id IN (SELECT id FROM memories WHERE {VISIBLE}) QUALIFY rank <= 60"))
def folded_search(spark, d):
    b = table(spark, d, "benchmark")
    terms = b.select(F.col("item_id").alias("query_id"), F.explode(tx.search_terms(tx.folded(F.col("text")))).alias("term"))
    found = search.bm25(folded_memories(spark, d), terms, visible=visible(spark, d))
    return search.top(found, 60).select("query_id", "id", "score", "rank")


@query()
def stemmed_search(spark, d):
    m = folded_memories(spark, d)
    terms = query_terms(spark, d).select("query_id", stem_column(tx.folded(F.col("term"))).alias("term")).distinct()
    found = search.bm25(m, terms, stem=stem_column, visible=visible(spark, d))
    return search.top(found, 60).select("query_id", "id", "score", "rank")


QUERY_VECTORS = "qv AS (SELECT id AS query_id, embedding AS q FROM vecs WHERE (id - 1) % 100 = 0)"


def query_vectors(v: DataFrame) -> DataFrame:
    return v.filter((F.col("id") - 1) % 100 == 0).select(F.col("id").alias("query_id"), "embedding")


KNN = f"""{QUERY_VECTORS},
sims AS (SELECT query_id, v.id, round(list_dot_product(q, v.embedding), 6) AS similarity FROM qv CROSS JOIN vecs v JOIN memories m ON m.id = v.id WHERE {VISIBLE}),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sims QUALIFY rank <= {{k}})"""


@query(sql("memories vecs", f"+ {KNN.format(k=10)} SELECT query_id, id, similarity, rank FROM knn"))
def knn_topk(spark, d):
    v = ad.vectors(spark, d)
    seen = v.join(visible(spark, d).select("id"), "id", "left_semi")
    return search.neighbours(query_vectors(v), seen, 10)


@query(ORACLE_SQL["knn_topk"])
def stored_vector_search(spark, d):
    v = ad.vectors(spark, d)
    store = VectorStore(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}")
    store.write(v)
    return store.search(query_vectors(v), 10, allowed=visible(spark, d).select("id")).select("query_id", "id", "similarity", "rank")


@query(sql("memories vecs", f"+ {KNN.format(k=60)} SELECT query_id, id, similarity, rank FROM knn QUALIFY similarity >= greatest(0.2, max(similarity) OVER (PARTITION BY query_id) * 0.5)"))
def knn_floor(spark, d):
    v = ad.vectors(spark, d)
    seen = v.join(visible(spark, d).select("id"), "id", "left_semi")
    return search.neighbours(query_vectors(v), seen, 60, 0.2, 0.5)


NEAR = """near AS (SELECT a, b, similarity FROM (
  SELECT x.id AS a, y.id AS b, round(list_dot_product(x.embedding, y.embedding), 6) AS similarity,
    row_number() OVER (PARTITION BY x.id ORDER BY round(list_dot_product(x.embedding, y.embedding), 6) DESC, y.id) AS r
  FROM vecs x JOIN vecs y USING (scope_key)) WHERE r <= 6 AND a <> b AND similarity >= 0.3)"""


def near(spark: SparkSession, d: str) -> DataFrame:
    return upkeep.near_everywhere(ad.vectors(spark, d), 6, 0.3)


def live(spark: SparkSession, d: str) -> DataFrame:
    return ad.memories(spark, d, False).filter(OWNER.memory_filter(NOW()))


@query(sql("memories vecs", f"+ {NEAR} SELECT a, b, similarity, CASE WHEN ma.type = mb.type THEN 'near_duplicate' ELSE 'possible_duplicate' END AS outcome FROM near JOIN memories ma ON ma.id = a JOIN memories mb ON mb.id = b WHERE {LIVE.replace('deleted_at', 'ma.deleted_at').replace('state', 'ma.state').replace('valid_', 'ma.valid_')} AND {LIVE.replace('deleted_at', 'mb.deleted_at').replace('state', 'mb.state').replace('valid_', 'mb.valid_')}"))
def near_duplicates(spark, d):
    return upkeep.save_gate(near(spark, d), live(spark, d)).select("a", "b", "similarity", "outcome")


def _queries_by_item(spark: SparkSession, d: str) -> DataFrame:
    """A vector for each benchmark item: that of the memory with its number."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return items.join(ad.vectors(spark, d).select((F.col("id") - 1).alias("query_id"), "embedding"), "query_id")


ITEM_KNN = f"""bq AS (SELECT item_id AS query_id, embedding AS q FROM benchmark JOIN vecs ON vecs.id - 1 = item_id),
kn AS (SELECT * FROM (SELECT query_id, v.id, round(list_dot_product(q, v.embedding), 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(q, v.embedding), 6) DESC, v.id) AS rank
  FROM bq CROSS JOIN vecs v JOIN memories m ON m.id = v.id WHERE {VISIBLE}) WHERE rank <= 60 QUALIFY similarity >= greatest(0.2, max(similarity) OVER (PARTITION BY query_id) * 0.5)),
kw AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm WHERE id IN (SELECT id FROM memories WHERE {VISIBLE}) QUALIFY rank <= 60),
fused AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT query_id, id, rank FROM kw UNION ALL SELECT query_id, id, rank FROM kn) GROUP BY query_id, id),
refs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM fused QUALIFY r <= 60)"""


def lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    seen = visible(spark, d).select("id")
    m = ad.memories(spark, d).filter("deleted_at is null")
    words = search.top(search.bm25(m, query_terms(spark, d), visible=seen), 60)
    near_ = search.neighbours(_queries_by_item(spark, d), ad.vectors(spark, d).join(seen, "id", "left_semi"), 60, 0.2, 0.5)
    return words, near_


@query(sql("memories vecs", f"+ {BM25}, {ITEM_KNN} SELECT query_id, id, round(score, 9) AS score FROM fused"))
def rrf_fusion(spark, d):
    return search.rrf(*lists(spark, d)).select("query_id", "id", F.round("score", 9).alias("score"))


def sql_boost(m: str = "") -> str:
    t = "greatest(updated_at, coalesce(verified_at, updated_at))"
    return f"""((1 + CASE WHEN pinned THEN 0.1 ELSE 0 END + 0.06 / (1 + greatest(0.0, ({NOW_S} - {t}) / 86400.0) / 30) + CASE WHEN coalesce(project_key = '{PROJECT}', false) THEN 0.05 ELSE 0 END
  + 0.04 * least(1.0, log2(1.0 + greatest(0, application_count + helpful_count - harmful_count)) / 5.0))
  * CASE WHEN shown_count >= 10 AND opened_count = 0 THEN 0.95 ELSE 1 + 0.06 * least(1.0, opened_count / greatest(1, shown_count)) END)"""


@query(sql("memories", f"SELECT id, round({sql_boost()}, 9) AS boost FROM memories WHERE {VISIBLE}"))
def boosted_rank(spark, d):
    return visible(spark, d, True).select("id", F.round(search.memory_boost(NOW(), PROJECT), 9).alias("boost"))


@query(sql("memories vecs", f"""+ {BM25}, {ITEM_KNN} SELECT query_id, id, title, round(score, 9) AS fused, round(score * {sql_boost()}, 9) AS final,
  row_number() OVER (PARTITION BY query_id ORDER BY round(score * {sql_boost()}, 9) DESC, id) AS rank FROM refs JOIN memories USING (id) QUALIFY rank <= 8"""))
def hybrid_search(spark, d):
    m = ad.memories(spark, d).filter("deleted_at is null")
    return search.hybrid(m, AGENT.memory_filter(NOW()), query_terms(spark, d), _queries_by_item(spark, d), ad.vectors(spark, d), NOW(), PROJECT)


@query(sql("memories vecs", f"""+ {QUERY_VECTORS}, all_sims AS (SELECT query_id, v.id, v.label, round(list_dot_product(q, v.embedding), 6) AS s FROM qv CROSS JOIN vecs v WHERE v.id <> query_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM all_sims QUALIFY rank <= 10),
best AS (SELECT query_id, min(rank) FILTER (ranked.label = v.label) AS rank FROM ranked JOIN vecs v ON v.id = query_id GROUP BY query_id)
SELECT 'label' AS kind, count(*) AS n, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr FROM best"""))
def retrieval_mrr(spark, d):
    v = ad.vectors(spark, d)
    found = search.neighbours(query_vectors(v), v, 11).filter("query_id <> id")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    found = found.withColumn("rank", F.row_number().over(w)).filter("rank <= 10")
    labels = v.select("id", "label")
    same = found.join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("_l")), "query_id").filter("label = _l")
    first = same.groupBy("query_id").agg(F.min("rank").alias("rank")).withColumn("id", F.lit(0))
    wanted = query_vectors(v).select("query_id", F.lit("label").alias("kind"), F.lit(0).alias("id"))
    return search.quality_of(first, wanted)


@query(sql("memories", "SELECT id, round((1 / (1 + greatest(0.0, ({0} - updated_at) / 86400.0) / 14) + 0.5 * least(1.0, log2(1.0 + application_count) / 5.0)) * CASE WHEN shown_count >= 10 AND opened_count = 0 THEN 0.95 ELSE 1 + 0.06 * least(1.0, opened_count / greatest(1, shown_count)) END, 9) AS relevance FROM memories".format(NOW_S)))
def context_scores(spark, d):
    c = context_relevance(F.col("updated_at"), NOW(), F.col("application_count"), F.col("shown_count"), F.col("opened_count"))
    return ad.memories(spark, d).select("id", F.round(c, 9).alias("relevance"))


FLOORS = {"low": (0.2, 0.1), "medium": (0.4, 0.2), "high": (0.65, 0.3)}


@query(sql("memories vecs", f"""+ {BM25}, one AS (SELECT id, round(1 / (1 + exp(1 - score / 10)), 9) AS relevance FROM bm WHERE query_id = (SELECT min(item_id) FROM benchmark)),
q AS (SELECT embedding AS q FROM vecs ORDER BY id LIMIT 1), sim AS (SELECT id, round(list_dot_product(q, embedding), 6) AS similarity FROM vecs CROSS JOIN q),
h AS (SELECT coalesce(one.id, sim.id) AS id, relevance, similarity FROM one FULL JOIN sim ON sim.id = one.id)
""" + " UNION ALL ".join(f"SELECT '{k}' AS strictness, count(*) FILTER (coalesce(relevance >= {r}, true) AND coalesce(similarity >= {v}, false)) AS with_vectors, count(*) FILTER (coalesce(relevance >= {r}, true) AND (relevance IS NOT NULL OR {str(k == 'low').lower()})) AS words_alone FROM h" for k, (r, v) in FLOORS.items())))
def task_matches(spark, d):
    """Hits of one task, with relevances from their keyword scores and similarities to one vector, at every strictness."""
    terms = query_terms(spark, d)
    one = terms.join(terms.agg(F.min("query_id").alias("query_id")), "query_id", "left_semi")
    words = search.bm25(ad.memories(spark, d, False).filter("deleted_at is null"), one)
    words = words.select("id", F.round(sigmoid(F.col("score") / 10 - 1), 9).alias("relevance"))
    v = ad.vectors(spark, d)
    first = v.orderBy("id").limit(1).select(F.lit(0).alias("query_id"), "embedding")
    near_ = search.neighbours(first, v, 10**9).select("id", "similarity")
    h = words.join(near_, "id", "full")
    counts = []
    for k, (_, floor) in FLOORS.items():
        with_, without = (F.count_if(is_task_match(F.col("relevance"), F.col("similarity"), k, f)) for f in (floor, None))
        counts.append(h.agg(with_.alias("with_vectors"), without.alias("words_alone")).select(F.lit(k).alias("strictness"), "with_vectors", "words_alone"))
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# ---- upkeep


@query(sql("memories", "SELECT content_hash, scope, project_key, min(id) AS keeper, count(*) AS copies, max(updated_at) AS last_seen_s, count(*) - 1 AS duplicate_count FROM memories WHERE deleted_at IS NULL GROUP BY content_hash, scope, project_key HAVING count(*) > 1"))
def exact_duplicates(spark, d):
    return upkeep.exact_duplicates(ad.memories(spark, d, False)).withColumn("last_seen_s", seconds("last_seen_at")).drop("last_seen_at")


def sql_topics(m: str) -> str:
    return f"""topics AS (SELECT a.id AS a, b.id AS b, a.topic_key FROM {m} a JOIN {m} b ON a.topic_key = b.topic_key AND a.id < b.id
  AND (a.project_key IS NOT DISTINCT FROM b.project_key OR a.scope = 'global' OR b.scope = 'global') WHERE a.deleted_at IS NULL AND b.deleted_at IS NULL)"""


@query(sql("memories", f"+ {sql_topics('memories')} SELECT * FROM topics"))
def same_topic_pairs(spark, d):
    return upkeep.same_topic_pairs(ad.memories(spark, d, False))


PAIRS = f"""{NEAR}, alive AS (SELECT * FROM memories WHERE {LIVE}), {sql_topics('alive')},
pairs AS (SELECT low, high, max(similarity) AS similarity FROM (
  SELECT least(a, b) AS low, greatest(a, b) AS high, round(similarity, 3) AS similarity FROM near JOIN alive x ON x.id = a JOIN alive y ON y.id = b WHERE x.type = y.type
  UNION ALL SELECT a, b, NULL FROM topics) GROUP BY low, high)"""


def pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs among the live rows, all of which ask; and those rows."""
    m = live(spark, d)
    none = spark.createDataFrame([(1, 2)], "a long, b long")
    return upkeep.candidate_pairs(near(spark, d), upkeep.same_topic_pairs(m), m, none), m


NOT_DISMISSED = "NOT (low = 1 AND high = 2)"


@query(sql("memories vecs", f"+ {PAIRS} SELECT low, high, similarity, (low, high) IN (SELECT (a, b) FROM topics) AS same_topic FROM pairs WHERE {NOT_DISMISSED}"))
def candidate_pairs(spark, d):
    return pairs(spark, d)[0]


CONFLICTS = f"""{PAIRS},
texts AS (SELECT low, high, x.title || chr(10) || x.content AS ta, y.title || chr(10) || y.content AS tb FROM pairs JOIN alive x ON x.id = low JOIN alive y ON y.id = high WHERE {NOT_DISMISSED}),
vals AS (SELECT *, {VALUES.format("ta")} AS va, {VALUES.format("tb")} AS vb, {NEGATED.format("ta")} AS na, {NEGATED.format("tb")} AS nb FROM texts),
lone AS (SELECT *, list_filter(va, lambda x: NOT list_contains(vb, x)) AS oa, list_filter(vb, lambda x: NOT list_contains(va, x)) AS ob FROM vals),
conf AS (SELECT low, high, CASE WHEN len(oa) > 0 AND len(ob) > 0 THEN 'values' WHEN na <> nb THEN 'negation' END AS reason, len(oa) AS la, len(ob) AS lb FROM lone)"""


@query(sql("memories vecs", f"+ {CONFLICTS} SELECT low, high, reason, CASE WHEN reason = 'values' THEN la ELSE 0 END AS only_a, CASE WHEN reason = 'values' THEN lb ELSE 0 END AS only_b FROM conf"))
def conflicts(spark, d):
    c = upkeep.pair_conflicts(*pairs(spark, d))
    return c.select("low", "high", "conflict.reason", F.size("conflict.only_a").cast("long").alias("only_a"), F.size("conflict.only_b").cast("long").alias("only_b"))


@query(sql("memories vecs", f"+ {CONFLICTS} SELECT count(*) FILTER (reason IS NULL) AS duplicates, count(*) FILTER (reason = 'values') AS value_conflicts, count(*) FILTER (reason = 'negation') AS negation_conflicts, (SELECT count(*) FROM alive WHERE NOT pinned AND greatest(updated_at, coalesce(verified_at, updated_at), coalesce(kept_at, updated_at)) < {NOW_S - 340 * DAY}) AS stale FROM conf"))
def upkeep_counts(spark, d):
    return upkeep.upkeep_counts(*pairs(spark, d), stale(NOW(), 340))


@query(sql("memories vecs", f"""+ {CONFLICTS}, own AS (SELECT id FROM alive WHERE scope = 'global' OR project_key = '{PROJECT}')
SELECT CASE WHEN reason IS NULL THEN 'duplicates' ELSE 'conflicts' END AS part, low, high, reason FROM conf WHERE low IN (SELECT id FROM own) AND high IN (SELECT id FROM own)"""))
def project_pairs(spark, d):
    c, m = pairs(spark, d)
    return upkeep.in_project(upkeep.pair_conflicts(c, m), m, PROJECT).select("part", "low", "high", F.col("conflict.reason").alias("reason"))


def duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each copy of a content hash with the first of its namespace."""
    m = ad.memories(spark, d).filter("deleted_at is null")
    first = m.groupBy("content_hash", "scope", "project_key").agg(F.min("id").alias("low"))
    j = m.select(F.col("id").alias("high"), F.col("content_hash").alias("_h"), F.col("scope").alias("_s"), F.col("project_key").alias("_p"))
    on = (F.col("content_hash") == F.col("_h")) & (F.col("scope") == F.col("_s")) & F.col("project_key").eqNullSafe(F.col("_p")) & (F.col("low") < F.col("high"))
    return first.join(j, on).select("low", "high")


MERGE = """dup AS (SELECT min(id) OVER (PARTITION BY content_hash, scope, project_key) AS low, id AS high FROM memories WHERE deleted_at IS NULL),
ok AS (SELECT low, high, CASE WHEN x.application_count + x.helpful_count <> y.application_count + y.helpful_count THEN CASE WHEN x.application_count + x.helpful_count > y.application_count + y.helpful_count THEN low ELSE high END
  WHEN x.opened_count <> y.opened_count THEN CASE WHEN x.opened_count > y.opened_count THEN low ELSE high END WHEN x.updated_at > y.updated_at THEN low ELSE high END AS target
  FROM dup JOIN memories x ON x.id = low JOIN memories y ON y.id = high WHERE low < high AND x.pinned = y.pinned AND x.archived_at IS NULL AND y.archived_at IS NULL)"""


@query(sql("memories", f"+ {MERGE} SELECT low, high, target, low + high - target AS source FROM ok"))
def merge_targets(spark, d):
    return upkeep.mergeable(duplicate_pairs(spark, d), ad.memories(spark, d))


@query()
def auto_merge(spark, d):
    return upkeep.auto_merge(ad.memories(spark, d).filter(OWNER.memory_filter(NOW())))


# ---- sessions

FOLD = rf"""t AS (SELECT *, {sql_clip(sql_redact("user_text"), 1500)} AS u, {sql_clip(sql_redact("assistant_text"), 2500)} AS a FROM turns
  WHERE trim(assistant_text) <> '' AND NOT regexp_matches(assistant_text, '(?i)^\s*\[(system )?error\]')),
sess AS (SELECT agent_id AS id, first(project_key ORDER BY seq) AS project_key, first(provider ORDER BY seq) AS provider,
  last(title ORDER BY seq) FILTER (title IS NOT NULL) AS title, first(u ORDER BY seq) AS first_prompt, last(u ORDER BY seq) FILTER (u IS NOT NULL) AS last_prompt,
  last(a ORDER BY seq) AS last_reply, count(*) AS turns, min(ts) AS started_at, max(ts) AS updated_at FROM t GROUP BY agent_id)"""


@query(sql("turns", f"+ {FOLD} SELECT id, project_key, provider, title, first_prompt, last_prompt, last_reply, turns, started_at AS started_s, updated_at AS updated_s FROM sess"))
def session_fold(spark, d):
    s = sessions.fold_turns(ad.turns(spark, d))
    return s.withColumns({"started_s": seconds("started_at"), "updated_s": seconds("updated_at")}).drop("files", "started_at", "updated_at")


def sql_field(name: str, value: str) -> str:
    return f"',\"{name}\":' || coalesce(to_json({value})::VARCHAR, 'null')"


MOMENT = "strftime(make_timestamp({0}::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%S.000Z')"
VERSION = " || ".join(
    ["'{\"id\":' || id", *[sql_field(c, c) for c in ("project_key", "provider", "title", "first_prompt", "last_prompt", "last_reply", "files", "turns")], *[sql_field(c, MOMENT.format(c)) for c in ("started_at", "updated_at")], "'}'"]
)


@query(sql("turns", f"""+ {FOLD}, f AS (SELECT agent_id AS id, list(x ORDER BY k) AS files FROM (SELECT agent_id, x, min(seq * 10 + p) AS k FROM (SELECT agent_id, seq, unnest(files) AS x, unnest([1, 2]) AS p FROM t) GROUP BY agent_id, x) GROUP BY agent_id)
SELECT id, array_to_string(files, ',') AS files, sha256({VERSION}) AS version FROM sess JOIN f USING (id)"""))
def session_versions(spark, d):
    s = sessions.version(sessions.fold_turns(ad.turns(spark, d)))
    return s.select("id", F.array_join("files", ",").alias("files"), "version")


@query(sql("turns", f"+ {FOLD} SELECT id, project_key, row_number() OVER (PARTITION BY project_key ORDER BY updated_at DESC, id) AS rank FROM sess QUALIFY rank <= 5"))
def recent_sessions(spark, d):
    return sessions.recent(sessions.fold_turns(ad.turns(spark, d)), 5).select("id", "project_key", "rank")


@query(sql("turns", f"+ {FOLD}, {sql_bm25('sess', sessions.SESSION_WEIGHTS)} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, round(0.5 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)), 9) AS score FROM bm QUALIFY rank <= 10"))
def session_search(spark, d):
    s = sessions.search_sessions(sessions.fold_turns(ad.turns(spark, d)), query_terms(spark, d), 10)
    return s.withColumn("score", F.round("score", 9))


@query(sql("turns", "SELECT sha256('[\"' || agent_id || '\",\"' || native_turn || '\"]') AS turn_key, min(seq) AS seq, count(*) AS sightings FROM turns GROUP BY agent_id, native_turn"))
def turn_dedup(spark, d):
    return sessions.distinct_turns(ad.turns(spark, d))


@query("""WITH c AS (SELECT *, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS f FROM conversations)
SELECT conv_id AS agent_id, first(text ORDER BY turn) FILTER (role = 'user') AS user_text, last(text ORDER BY turn) FILTER (role = 'assistant' AND trim(text) <> '') AS reply FROM c WHERE turn >= f GROUP BY conv_id""")
def latest_turn(spark, d):
    c = table(spark, d, "conversations")
    kind = F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "assistant_message").otherwise("other")
    t = c.select(F.col("conv_id").alias("agent_id"), F.col("turn").alias("idx"), kind.alias("kind"), "text", F.lit(None).cast("string").alias("file"))
    return sessions.latest_turn(t).drop("files")


@query(sql("turns", """+ g AS (SELECT agent_id, seq, coalesce(lead(ts) OVER w - ts >= 900, true) AS idle FROM turns WINDOW w AS (PARTITION BY agent_id ORDER BY seq)),
r AS (SELECT *, coalesce(sum(idle::INT) OVER (PARTITION BY agent_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY agent_id, run ORDER BY seq) AS n FROM r)
SELECT agent_id, seq, CASE WHEN n % 3 = 0 THEN 'turns' ELSE 'idle' END AS cause FROM n WHERE n % 3 = 0 OR (idle AND (n - 1) % 3 + 1 >= 2)"""))
def reviews_due(spark, d):
    return sessions.reviews_due(ad.turns(spark, d), 900, 3)


# ---- usage, feedback, audit

OBS = """obs AS (SELECT producer_id, attempt_id, stage, provenance, last(input_tokens ORDER BY source_sequence) FILTER (input_tokens IS NOT NULL) AS input_tokens,
  last(output_tokens ORDER BY source_sequence) FILTER (output_tokens IS NOT NULL) AS output_tokens, last(cost_amount ORDER BY source_sequence) FILTER (cost_amount IS NOT NULL) AS cost_amount,
  last(currency ORDER BY source_sequence) FILTER (cost_amount IS NOT NULL) AS currency FROM usage GROUP BY producer_id, attempt_id, stage, provenance),
tok AS (SELECT stage, provenance, count(*) AS n, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM obs GROUP BY stage, provenance)"""


@query(sql("usage", f"+ {OBS} SELECT * FROM tok"))
def usage_tokens(spark, d):
    return usage.tokens(ad.usage(spark, d))


@query(sql("usage", f"+ {OBS} SELECT stage, provenance, currency, round(sum(cost_amount), 4) AS amount, count(*) AS n FROM obs WHERE cost_amount IS NOT NULL GROUP BY stage, provenance, currency"))
def usage_costs(spark, d):
    return usage.costs(ad.usage(spark, d))


@query(sql("usage", """+ per AS (SELECT stage, last(status ORDER BY source_sequence) AS status, bool_or(provenance <> 'unavailable') AS u, bool_or(provenance = 'provider_observed' AND cost_amount IS NOT NULL) AS b FROM usage GROUP BY producer_id, attempt_id, stage)
SELECT stage, status, count(*) AS n, count(*) FILTER (NOT u) AS without_usage, count(*) FILTER (NOT b) AS without_billing FROM per GROUP BY stage, status"""))
def usage_latest_status(spark, d):
    return usage.latest_status(ad.usage(spark, d))


@query(sql("usage", f"+ {OBS}, both_ AS (SELECT * FROM tok UNION ALL SELECT 'maintenance', provenance, n, input_tokens, output_tokens FROM tok WHERE stage <> 'retrieval') SELECT stage, sum(n)::BIGINT AS n, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM both_ GROUP BY stage"))
def usage_summary(spark, d):
    return usage.summary(ad.usage(spark, d))


@query(sql("usage", "SELECT source_sequence, min(currency) OVER w <> max(currency) OVER w AS currency_conflict FROM usage WINDOW w AS (PARTITION BY producer_id, attempt_id) QUALIFY min(currency) OVER w <> max(currency) OVER w"))
def usage_conflicts(spark, d):
    return usage.conflicts(ad.usage(spark, d)).select("source_sequence", "currency_conflict")


@query(sql("memories feedback", f"""SELECT memory_id, count(*) FILTER (signal = 'applied') AS applied, count(*) FILTER (signal = 'helpful' AND basis <> 'agent_report') AS validated_helpful,
  count(*) FILTER (signal = 'harmful' AND basis <> 'agent_report') AS validated_harmful, count(*) FILTER (signal = 'helpful' AND basis = 'agent_report') AS reported_helpful, count(*) FILTER (signal = 'irrelevant') AS irrelevant
  FROM feedback f JOIN memories m ON m.id = f.memory_id AND m.revision = f.revision WHERE (support_valid_until IS NULL OR {NOW_S} < support_valid_until) AND NOT list_has_any(evidence_refs, ['e7', 'e11']) GROUP BY memory_id"""))
def feedback_hints(spark, d):
    gone = spark.createDataFrame([("e7",), ("e11",)], "ref string")
    return usage.hints(ad.feedback(spark, d), ad.memories(spark, d, False), gone, NOW())


@query(sql("feedback", "SELECT basis, count(*) AS n, count(*) FILTER (signal = 'applied') AS applied, count(*) FILTER (signal = 'helpful') AS helpful, count(*) FILTER (signal = 'harmful') AS harmful, count(*) FILTER (signal = 'irrelevant') AS irrelevant FROM feedback GROUP BY basis"))
def feedback_status(spark, d):
    return usage.feedback_status(ad.feedback(spark, d))


@query(sql("feedback", f"SELECT event_id, memory_id FROM feedback WHERE support_valid_until <= {NOW_S}"))
def feedback_expired(spark, d):
    return usage.expired(ad.feedback(spark, d), NOW()).select("event_id", "memory_id")


@query(sql("audit links", "SELECT agent_id, kind, count(*) AS n, min(audit.created_at) AS first_s, max(audit.created_at) AS last_s FROM links JOIN audit USING (nonce) GROUP BY agent_id, kind"))
def audit_by_agent(spark, d):
    e = ad.links(spark, d).drop("created_at").join(ad.audit(spark, d), "nonce")
    return e.groupBy("agent_id", "kind").agg(F.count("*").alias("n"), seconds(F.min("created_at")).alias("first_s"), seconds(F.max("created_at")).alias("last_s"))


@query(sql("audit links", "SELECT agent_id, min(audit.created_at) AS first_s, max(audit.created_at) AS last_s, count(audit.created_at) AS events FROM links LEFT JOIN audit USING (nonce) GROUP BY agent_id ORDER BY coalesce(max(audit.created_at), max(links.created_at)) DESC, agent_id LIMIT 25"))
def workspace_agents(spark, d):
    a = usage.agents_of(ad.audit(spark, d), ad.links(spark, d), 25)
    return a.select("agent_id", seconds("first_at").alias("first_s"), seconds("last_at").alias("last_s"), "events")


@query(sql("audit", "SELECT id, CASE kind WHEN 'search' THEN 'Searched, ' || k || ' results' WHEN 'get' THEN 'Read #' || k WHEN 'save' THEN 'Saved #' || k WHEN 'inject' THEN 'Injected ' || k || ' memories' WHEN 'denied' THEN 'Denied' END AS line FROM audit"))
def audit_lines(spark, d):
    return ad.audit(spark, d).select("id", usage.describe(F.col("kind"), F.col("k")).alias("line"))


@query(sql("audit", "SELECT nonce, arg_max(id, (created_at, id)) AS id, max(created_at) AS created_s FROM audit WHERE kind = 'inject' GROUP BY nonce"))
def issued_context(spark, d):
    return usage.issued(ad.audit(spark, d)).select("nonce", "id", seconds("created_at").alias("created_s"))


@query(sql("audit", f"SELECT nonce, array_to_string(list_sort(list_distinct(list(k) FILTER (kind = 'save' AND k IS NOT NULL))), ',') AS saved FROM audit WHERE created_at >= {START} AND created_at < {START + 10 ** 9} GROUP BY nonce"))
def touched_ids(spark, d):
    t = usage.touched_ids(ad.audit(spark, d), ad.at(START), ad.at(START + 10**9))
    return t.select("nonce", F.when(F.size("saved") > 0, F.array_join("saved", ",")).alias("saved"))


CUTOFF = START + 20000


@query(sql("turns audit links", f"""+ {FOLD}, ev AS (SELECT * FROM audit WHERE created_at >= {CUTOFF})
SELECT 'sessions' AS kept, count(*) AS n FROM sess WHERE updated_at >= {CUTOFF} UNION ALL SELECT 'events', count(*) FROM ev
UNION ALL SELECT 'links', count(*) FROM links WHERE created_at >= {CUTOFF} OR nonce IN (SELECT nonce FROM ev)"""))
def retention_prune(spark, d):
    s, e, k = sessions.prune(sessions.fold_turns(ad.turns(spark, d)), ad.audit(spark, d), ad.links(spark, d), ad.at(CUTOFF))
    out = [x.agg(F.count("*").alias("n")).select(F.lit(name).alias("kept"), "n") for name, x in (("sessions", s), ("events", e), ("links", k))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(sql("usage", """+ s AS (SELECT stage, source_sequence, duration_ms FROM usage QUALIFY row_number() OVER (PARTITION BY stage ORDER BY source_sequence DESC) <= 256),
r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY duration_ms, source_sequence) AS k, count(*) OVER (PARTITION BY stage) AS n FROM s)
SELECT stage, max(n) AS n, max(duration_ms) FILTER (k = ceil(n * 0.5)) AS p50, max(duration_ms) FILTER (k = ceil(n * 0.95)) AS p95 FROM r GROUP BY stage"""))
def latency_percentiles(spark, d):
    return usage.latency(ad.usage(spark, d).select("stage", F.col("source_sequence").alias("seq"), "duration_ms"))


# ---- history and closures


@query(sql("revisions", f"""+ s AS (SELECT memory_id, arg_max({{'r': revision, 's': state, 'c': content, 'f': valid_from, 'u': valid_until}}, (changed_at, revision)) AS snap FROM revisions WHERE changed_at <= {START + 20 * DAY} GROUP BY memory_id)
SELECT memory_id, snap.r AS revision, sha256(snap.c) AS content_sha256 FROM s WHERE snap.s = 'active' AND (snap.f IS NULL OR snap.f <= {START + 20 * DAY}) AND (snap.u IS NULL OR {START + 20 * DAY} < snap.u)"""))
def asof_revision(spark, d):
    return lineage.as_of(ad.revisions(spark, d), ad.at(START + 20 * DAY)).select("memory_id", "revision", F.sha2("content", 256).alias("content_sha256"))


@query(sql("revisions", "SELECT memory_id, max(revision) AS revision, sha256(arg_max(content, revision)) AS content_sha256, arg_max(changed_at, revision) AS changed_s FROM revisions GROUP BY memory_id"))
def revision_latest(spark, d):
    r = lineage.latest_revision(ad.revisions(spark, d))
    return r.select("memory_id", "revision", F.sha2("content", 256).alias("content_sha256"), seconds("changed_at").alias("changed_s"))


@query(sql("memories", f"SELECT min(t) AS boundary_s FROM (SELECT valid_from AS t FROM memories UNION ALL SELECT valid_until FROM memories) WHERE t > {NOW_S - 100 * DAY}"))
def validity_boundary(spark, d):
    return lineage.next_boundary(ad.memories(spark, d, False), ad.at(NOW_S - 100 * DAY)).select(seconds("boundary").alias("boundary_s"))


@query(sql("memories", "SELECT greatest(max(id), 1000000) + 1 AS next_id FROM memories"))
def next_memory_id(spark, d):
    gone = spark.createDataFrame([("memory", "1000000"), ("session", "9")], "kind string, identifier string")
    return lineage.next_id(ad.memories(spark, d, False), gone)


@query(sql("relations", "+ c AS (SELECT DISTINCT from_id AS root, from_id AS id FROM relations UNION SELECT c.root, r.to_id FROM c JOIN relations r ON r.from_id = c.id) SELECT root, count(*) AS n, min(id) AS least FROM c GROUP BY root", True))
def derived_closure(spark, d):
    r = ad.relations(spark, d)
    c = lineage.sources_of(r.select(F.col("from_id").alias("id")).distinct(), r)
    return c.groupBy("root").agg(F.count("*").alias("n"), F.min("id").alias("least"))


DEPENDS = r"""edges AS (SELECT to_id AS src, from_id AS dst FROM relations
  UNION SELECT a.memory_id, b.memory_id FROM evidence a JOIN evidence b USING (source_ref) WHERE source_ref LIKE 'artifact:%' AND a.memory_id <> b.memory_id
  UNION SELECT src, memory_id FROM evidence WHERE source_ref LIKE 'memory:%'),
c AS (SELECT id AS root, id FROM pending UNION SELECT c.root, e.dst FROM c JOIN edges e ON e.src = c.id)"""


@query(sql("memories relations evidence pending", f"+ {DEPENDS} SELECT root, id FROM c", True))
def forget_closure(spark, d):
    return lineage.forgotten_by_each(ad.pending(spark, d), ad.relations(spark, d), ad.evidence(spark, d)).select("root", "id")


@query(sql("memories relations evidence pending", f"+ {DEPENDS} SELECT count(*) AS left_over FROM memories WHERE id NOT IN (SELECT id FROM c)", True))
def erased_table(spark, d):
    gone = lineage.forgotten(ad.pending(spark, d), ad.relations(spark, d), ad.evidence(spark, d))
    return lineage.erase(ad.memories(spark, d, False), gone).agg(F.count("*").alias("left_over"))


@query(sql("relations pending", "+ c AS (SELECT id AS root, id FROM pending UNION SELECT c.root, r.from_id FROM c JOIN relations r ON r.to_id = c.id) SELECT DISTINCT id FROM c WHERE id NOT IN (SELECT id FROM pending)", True))
def invalidation_propagation(spark, d):
    return lineage.propagate(ad.pending(spark, d), ad.relations(spark, d)).select("id")


EXPOSED = """shown AS (SELECT DISTINCT k AS memory_id, nonce FROM audit WHERE kind = 'get'), seen_s AS (SELECT DISTINCT 'g' || (k % 40) AS session_id, nonce FROM audit WHERE kind = 'search' AND k % 9 = 0),
ex AS (SELECT 'memory:' || memory_id AS src, 'caller:' || nonce AS dst FROM shown UNION SELECT 'caller:' || nonce, 'agent:' || agent_id FROM links UNION SELECT 'agent:' || agent_id, 'caller:' || nonce FROM links
  UNION SELECT 'agent:' || agent_id, 'session:' || agent_id FROM links UNION SELECT 'session:' || session_id, 'caller:' || nonce FROM seen_s)"""


def exposures(spark: SparkSession, d: str) -> DataFrame:
    a, k = ad.audit(spark, d), F.col("k")
    shown = a.filter("kind = 'get'").select(k.alias("memory_id"), "nonce")
    seen = a.filter((F.col("kind") == "search") & (k % 9 == 0)).select(F.concat(F.lit("g"), (k % 40).cast("string")).alias("session_id"), "nonce")
    return erasure.exposure_edges(shown, ad.links(spark, d), sessions_shown=seen)


@query(sql("audit links", f"+ {EXPOSED}, c AS (SELECT 'memory:40' AS id UNION SELECT ex.dst FROM c JOIN ex ON ex.src = c.id) SELECT id FROM c", True))
def disclosure_closure(spark, d):
    return lineage.disclosed(spark.createDataFrame([("memory:40",)], "id string"), exposures(spark, d)).select("id")


CITED_BY = r"""edges AS (SELECT to_id AS src, from_id AS dst FROM relations
  UNION SELECT a.memory_id, b.memory_id FROM citations a JOIN citations b USING (source_ref) WHERE source_ref LIKE 'artifact:%' AND a.memory_id <> b.memory_id
  UNION SELECT try_cast(regexp_extract(source_ref, '^memory:(\d+)@', 1) AS BIGINT), memory_id FROM citations WHERE source_ref LIKE 'memory:%'),
gone AS (SELECT 41 AS id UNION SELECT e.dst FROM gone JOIN edges e ON e.src = gone.id),
cx AS (SELECT 'memory:' || id AS id FROM gone UNION SELECT ex.dst FROM cx JOIN ex ON ex.src = cx.id),
refs AS (SELECT source_ref FROM citations WHERE memory_id IN (SELECT id FROM gone) OR try_cast(regexp_extract(source_ref, '^memory:(\d+)@', 1) AS BIGINT) IN (SELECT id FROM gone))"""


@query(sql("memories revisions relations citations artifacts audit links marks feedback", f"""+ {EXPOSED}, {CITED_BY}
SELECT 'memories' AS part, count(*) AS n FROM memories WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'revisions', count(*) FROM revisions WHERE memory_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'citations', count(*) FROM citations WHERE memory_id NOT IN (SELECT id FROM gone) AND source_ref NOT IN (SELECT source_ref FROM refs)
UNION ALL SELECT 'relations', count(*) FROM relations WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'artifacts', count(*) FROM artifacts WHERE source_ref NOT IN (SELECT source_ref FROM refs) UNION ALL SELECT 'marks', count(*) FROM marks WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'feedback', count(*) FROM feedback WHERE memory_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'audit', count(*) FROM audit WHERE 'caller:' || nonce NOT IN (SELECT id FROM cx)
UNION ALL SELECT 'tombstones', (SELECT count(*) FROM gone) + (SELECT count(DISTINCT source_ref) FROM refs) + (SELECT count(*) FROM cx WHERE id LIKE 'session:%' OR id LIKE 'caller:%')""", True))
def forgotten_store(spark, d):
    """Every table after one memory is forgotten with all that goes with it."""
    names = ("memories", "revisions", "relations", "citations", "artifacts", "audit", "marks", "feedback")
    tables = {n: getattr(ad, n)(spark, d) for n in names}
    what = erasure.plan(spark.createDataFrame([(41,)], "id long"), tables["relations"], tables["citations"], exposures(spark, d), None)
    left = erasure.erased(tables, what) | {"tombstones": erasure.tombstones(what, NOW(), "owner")}
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n") for n, df in left.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query(sql("memories evidence", f"""SELECT memory_id, source_ref, CASE WHEN m.id IS NULL OR source_ref LIKE 'artifact:%' THEN 'resolved' WHEN source_hash = m.content_hash THEN 'resolved' ELSE 'unresolved' END AS status
  FROM evidence e LEFT JOIN memories m ON m.id = e.src AND source_ref LIKE 'memory:%' WHERE source_ref <> 'artifact:30' AND (source_ref LIKE 'artifact:%' OR (m.scope = 'global' OR m.project_key = '{PROJECT}'))"""))
def visible_evidence(spark, d):
    readable = AGENT.allows("read", F.col("scope"), F.col("project_key"))
    gone = spark.createDataFrame([("artifact:30",)], "source_ref string")
    return lineage.visible_evidence(ad.evidence(spark, d), ad.memories(spark, d, False), readable, gone)


@query(sql("memories relations", "+ c AS (SELECT DISTINCT from_id AS root, from_id AS id FROM relations UNION SELECT c.root, r.to_id FROM c JOIN relations r ON r.from_id = c.id) SELECT root, min(valid_until) AS until_s FROM c JOIN memories m ON m.id = c.id GROUP BY root", True))
def support_until(spark, d):
    r = ad.relations(spark, d)
    s = lineage.support_until(r.select(F.col("from_id").alias("id")).distinct(), r, ad.memories(spark, d, False))
    return s.select("root", seconds("valid_until").alias("until_s"))


# ---- indexes

MARKS = "marks AS (SELECT m.id, m.content_hash, CASE WHEN m.id % 4 = 0 THEN 9 ELSE m.index_generation END AS generation FROM vecs JOIN memories m USING (id))"


@query(sql("memories vecs", f"+ {MARKS} SELECT m.id, CASE WHEN k.id IS NULL THEN 'missing' ELSE 'outdated' END AS reason FROM memories m LEFT JOIN marks k ON k.id = m.id WHERE k.id IS NULL OR k.generation <> m.index_generation"))
def stale_vectors(spark, d):
    m = ad.memories(spark, d, False)
    marks = ad.vectors(spark, d).select("id").join(m.select("id", "content_hash", F.when(F.col("id") % 4 == 0, 9).otherwise(F.col("index_generation")).alias("generation")), "id")
    return indexes.stale_vectors(m, marks)


@query(f"""WITH c AS (SELECT 'fp' || p_partkey AS fingerprint, {NOW_S} - p_partkey * 3600 AS retired_at FROM part WHERE p_size % 2 = 0),
r AS (SELECT *, row_number() OVER (ORDER BY retired_at DESC, fingerprint) AS rank FROM c) SELECT fingerprint, rank FROM r WHERE rank > 2 OR retired_at < {NOW_S - 7 * DAY}""")
def index_retirement(spark, d):
    p = table(spark, d, "part")
    c = p.select(F.concat(F.lit("fp"), F.col("p_partkey").cast("string")).alias("fingerprint"), F.when(F.col("p_size") % 2 == 0, "retired").otherwise("ready").alias("state"), ad.at(F.lit(NOW_S) - F.col("p_partkey") * 3600).alias("retired_at"))
    return indexes.retired_to_drop(c, NOW())


@query(f"WITH r AS (SELECT p_partkey AS id, p_size % 7 AS failures FROM part) SELECT id, CASE WHEN failures < 5 THEN {START} + least(60, CAST(floor(2 * pow(2, failures - 1)) AS BIGINT)) END AS retry_s FROM r WHERE failures > 0")
def retry_schedule(spark, d):
    r = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 7).alias("failures")).filter("failures > 0")
    return r.select("id", seconds(indexes.retry_at(F.col("failures"), ad.at(START))).alias("retry_s"))


# ---- text


@query(f"SELECT doc_id, sha256({sql_redact('text')}) AS redacted_sha256 FROM documents")
def redact_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(tx.redact(F.col("text")), 256).alias("redacted_sha256"))


@query(f"SELECT doc_id, {sql_clip('text', 240)} AS preview FROM documents")
def clip_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.clip(F.col("text"), 240).alias("preview"))


@query(f"SELECT doc_id, len({VALUES.format('text')}) AS n, array_to_string(list_sort({VALUES.format('text')}), '|') AS stated FROM documents")
def value_tokens(spark, d):
    v = tx.value_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(v).cast("long").alias("n"), F.array_join(F.array_sort(v), "|").alias("stated"))


@query("SELECT conv_id, turn, list_sum(list_transform(range(1, turn % 4 + 1), lambda x: conv_id + x))::BIGINT AS saved, conv_id AS summary_id FROM conversations")
def review_reply_parse(spark, d):
    c = table(spark, d, "conversations")
    ids = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda x: F.when(x <= F.col("turn") % 4, F.concat(F.lit("#"), (F.col("conv_id") + x).cast("string"))).otherwise("")), " ")
    text = F.concat(F.lit(tx.REVIEW_MARKER + " full]\nSummary: "), F.col("conv_id").cast("string"), F.lit("\nSaved: "), ids, F.lit("\nUpdated: none"))
    r = tx.review_reply(text)
    total = F.aggregate(r["saved"], F.lit(0).cast("long"), lambda a, x: a + x)
    return c.select("conv_id", "turn", F.when(F.size(r["saved"]) > 0, total).alias("saved"), r["summary"].cast("long").alias("summary_id"))


@query("WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark), s AS (SELECT item_id, ('0x' || substr(sha256(w), 1, 8))::BIGINT % 64 AS slot, count(*) AS n FROM w GROUP BY ALL) SELECT item_id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS weight FROM s")
def hashed_embedding(spark, d):
    e = table(spark, d, "benchmark").select("item_id", F.posexplode(hash_embedding(F.col("text"))).alias("slot", "weight"))
    return e.filter("weight > 0").select("item_id", F.col("slot").cast("long").alias("slot"), F.round("weight", 6).alias("weight"))


@query("SELECT url AS path, regexp_extract(url, '^[a-z]+://[^/]+', 0) AS root FROM (SELECT DISTINCT url FROM pages)")
def workspace_roots(spark, d):
    p = table(spark, d, "pages").select(F.col("url").alias("path")).distinct()
    return longest_prefix(p, p.select(F.regexp_extract("path", "^[a-z]+://[^/]+", 0).alias("root")).distinct())


# ---- folds and context (procedural: rows only, tested against goldens)


def requests(spark: SparkSession, d: str) -> DataFrame:
    """A log of changes: each user's events touch the three memories of the user's own family. Every thirteenth event sends
    the request of two events before again, every 26th of those with another body; every 31st uses the request id of the
    user before, and texts recur among five users, so that families meet; expected revisions run ahead or behind; agents
    work in two projects; some changes cite other memories."""
    e, i, u = table(spark, d, "events"), F.col("event_id"), F.col("user_id")
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = e.select("event_id", "user_id", (F.row_number().over(w) - 1).cast("long").alias("n"), F.lag("event_id", 8).over(w).alias("merged_at"))
    n = F.col("n")
    src = F.when(n % 13 == 12, n - 2).otherwise(n)
    op = F.get(F.array(*map(F.lit, ["create", "update", "archive", "restore", "promote", "update", "merge", "undo_merge", "propose", "supersede", "reject", "forget"])), F.when(src < 3, 0).when(src % 97 == 96, 11).otherwise(src * 7 % 11).cast("int"))
    mid, other = u * 3 + src % 3, u * 3 + (src + 1) % 3
    body = F.struct(
        F.concat(F.lit("t"), (src % 3 + F.when(n % 26 == 25, 1).otherwise(0)).cast("string")).alias("title"),
        F.concat(F.lit("c"), (src % 5).cast("string"), F.lit(" of "), F.floor(u / 5).cast("string")).alias("content"),
        F.when(src % 6 == 0, "project").when(src % 6 == 1, "global").alias("scope"),
        F.when(src % 6 == 0, F.concat(F.lit("p"), (u % 2).cast("string"))).alias("project"),
        F.when(src % 7 == 2, F.concat(F.lit("topic of "), F.floor(u / 2).cast("string"))).alias("topicKey"),
        F.when(src % 9 == 4, "2024-02-01").alias("validFrom"),
        F.when(src % 9 == 4, F.when(src % 2 == 0, "2024-03-01").otherwise("2024-01-01")).alias("validUntil"),
    )
    target = F.struct(F.struct(other.alias("id"), (1 + src % 4).alias("revision")).alias("target"), F.when(op == "undo_merge", F.col("merged_at")).alias("mergeId"))
    change = F.when(op.isin("create", "propose", "update"), F.to_json(body)).when(op.isin("merge", "supersede", "undo_merge"), F.to_json(target)).when(op == "restore", F.to_json(F.struct((1 + src % 3).alias("sourceRevision"))))
    cites = F.concat(F.lit("memory:"), other.cast("string"), F.lit("@"), (1 + src % 3).cast("string"))
    return e.select(
        i.cast("long").alias("seq"),
        F.concat(F.lit("u"), (src % 2).cast("string")).alias("principal_id"),
        F.concat(F.lit("r"), src.cast("string"), F.lit("-"), (u - F.when(n % 31 == 30, 1).otherwise(0)).cast("string")).alias("request_id"),
        op.alias("operation"),
        mid.alias("memory_id"),
        F.when(~op.isin("create", "propose") & (src % 17 != 3), 1 + src % 5).alias("expected_revision"),
        change.alias("change"),
        (src % 4 == 0).alias("agent"),
        F.when(src % 4 == 0, F.concat(F.lit("p"), (src % 3).cast("string"))).alias("project"),
        F.when(src % 8 == 5, F.array(cites)).when(src % 8 == 7, F.array(F.concat(F.lit("artifact:"), u.cast("string")))).alias("evidence"),
    )


@query()
def mutation_fold(spark, d):
    return mutations.fold(requests(spark, d))


@query()
def mutation_state(spark, d):
    return mutations.current(mutations.fold(requests(spark, d)))


@query(sql("memories", """+ o AS (SELECT *, 'topic-' || (id % 7) AS t, sha256('' || chr(10) || title || chr(10) || content) AS h FROM memories),
l AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY scope, project_key, t ORDER BY id) <> h, true) AS changed FROM o)
SELECT scope, project_key, t AS topic_key, arg_max(title, id) AS title, sha256(arg_max(content, id)) AS content_sha256, bool_or(pinned) AS pinned, count(*) FILTER (changed) AS revision_count, count(*) AS saves FROM l GROUP BY scope, project_key, t"""))
def topic_upsert(spark, d):
    m = ad.memories(spark, d, False).select(F.col("id").alias("seq"), "scope", "project_key", F.concat(F.lit("topic-"), (F.col("id") % 7).cast("string")).alias("topic_key"), "title", "content", "pinned")
    return mutations.upsert_topics(m).withColumn("content_sha256", F.sha2("content", 256)).drop("content")


@query()
def review_cap_fold(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    a = e.select(
        F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("nonce"),
        i.alias("seq"),
        ad.at(F.lit(START) + i % 1200).alias("ts"),
        (F.col("user_id") % 4).alias("cap"),
        F.concat(F.lit("k"), (i % 5).cast("string")).alias("request_key"),
        F.when(F.col("event_type") == "error", "delete").otherwise("save").alias("kind"),
        F.get(F.array(F.lit("admit"), F.lit("settle"), F.lit("release")), (i % 3).cast("int")).alias("action"),
    )
    return review.fold(a)


@query(sql("memories vecs turns", rf"""+ qv AS (SELECT embedding AS q FROM vecs ORDER BY id LIMIT 1), hits AS (SELECT v.id FROM vecs v CROSS JOIN qv ORDER BY round(list_dot_product(q, v.embedding), 6) DESC, v.id LIMIT 10),
m AS (SELECT * FROM memories WHERE {VISIBLE}),
st AS (SELECT id, min(stage) AS stage, any_value(t) AS t FROM (SELECT id, 0 AS stage, updated_at AS t FROM m WHERE pinned UNION ALL SELECT id, 1, updated_at FROM m WHERE type = 'preference' UNION ALL SELECT id, 2, updated_at FROM m WHERE id IN (SELECT id FROM hits)
  UNION ALL SELECT id, CASE WHEN coalesce(project_key = '{PROJECT}', false) THEN 3 ELSE 4 END, updated_at FROM m) GROUP BY id),
rk AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY t DESC, id) AS rank FROM st QUALIFY rank <= [6, 4, 5, 6, 5][stage + 1]),
se AS (SELECT agent_id AS id, first(project_key ORDER BY seq) AS project_key, max(ts) AS u FROM turns WHERE trim(assistant_text) <> '' AND NOT regexp_matches(assistant_text, '(?i)^\s*\[(system )?error\]') GROUP BY agent_id)
SELECT 'memory' AS kind, id::VARCHAR AS id, stage, rank FROM rk UNION ALL SELECT 'session', id::VARCHAR, 5, row_number() OVER (ORDER BY u DESC, id::VARCHAR) AS r FROM se WHERE project_key = '{PROJECT}' QUALIFY r <= 4"""))
def context_stages(spark, d):
    v = ad.vectors(spark, d)
    hits = search.neighbours(v.select(F.col("id").alias("query_id"), "embedding").orderBy("query_id").limit(1), v, 10).select("id")
    return context.stages(visible(spark, d), sessions.fold_turns(ad.turns(spark, d)), hits, PROJECT, {"pins": 6, "preferences": 4, "task": 5, "project": 6, "global": 5, "sessions": 4})


@query(sql("memories vecs turns", rf"""+ qv AS (SELECT embedding AS q FROM vecs ORDER BY id LIMIT 1),
hits AS (SELECT v.id, row_number() OVER (ORDER BY round(list_dot_product(q, v.embedding), 6) DESC, v.id) AS rank FROM vecs v CROSS JOIN qv QUALIFY rank <= 40),
m AS (SELECT * FROM memories WHERE {VISIBLE}),
st AS (SELECT id, 0 AS stage, 6 AS cap, updated_at AS t FROM m WHERE pinned UNION ALL SELECT id, 1, 6, updated_at FROM m WHERE NOT pinned AND record_kind = 'preference' AND project_key = '{PROJECT}'
  UNION ALL SELECT id, 2, 5, updated_at FROM m WHERE NOT pinned AND record_kind = 'preference' AND scope = 'global' UNION ALL SELECT id, 4, 6, updated_at FROM m WHERE NOT pinned AND project_key = '{PROJECT}' UNION ALL SELECT id, 5, 5, updated_at FROM m WHERE NOT pinned AND scope = 'global'),
rk AS (SELECT 'memory' AS kind, id::VARCHAR AS id, stage, row_number() OVER (PARTITION BY stage ORDER BY t DESC, id) AS rank, true AS taken, cap FROM st QUALIFY rank <= cap),
hk AS (SELECT id, rank, id % 4 <> 0 AS matches FROM hits WHERE rank <= 12 AND id IN (SELECT id FROM m)),
se AS (SELECT agent_id AS id, first(project_key ORDER BY seq) AS project_key, max(ts) AS u FROM turns WHERE trim(assistant_text) <> '' AND NOT regexp_matches(assistant_text, '(?i)^\s*\[(system )?error\]') GROUP BY agent_id),
listed AS (SELECT kind, id, stage, rank, taken FROM rk UNION ALL SELECT 'memory', id::VARCHAR, 3, row_number() OVER (ORDER BY rank), matches AND sum(matches::INT) OVER (ORDER BY rank) <= 4 FROM hk
  UNION ALL SELECT 'session', id::VARCHAR, 6, row_number() OVER (ORDER BY u DESC, id::VARCHAR) AS r, true FROM se WHERE project_key = '{PROJECT}' QUALIFY r <= 4),
first AS (SELECT * FROM listed ORDER BY stage, rank LIMIT 24)
SELECT kind, id, min(stage) AS stage, arg_min(rank, stage) AS rank FROM first WHERE taken GROUP BY kind, id"""))
def context_collected(spark, d):
    v = ad.vectors(spark, d)
    hits = search.neighbours(v.select(F.col("id").alias("query_id"), "embedding").orderBy("query_id").limit(1), v, 40).select("id", "rank", (F.col("id") % 4 != 0).alias("matches"))
    return context.collected(visible(spark, d), sessions.fold_turns(ad.turns(spark, d)), hits, PROJECT, {"pins": 6, "task": 4, "project": 6, "global": 5, "sessions": 4}, 24)


@query()
def context_pack(spark, d):
    m = visible(spark, d)
    hits = search.hybrid(ad.memories(spark, d).filter("deleted_at is null"), AGENT.memory_filter(NOW()), query_terms(spark, d), None, m, NOW(), PROJECT, limit=40)
    e = hits.select(F.col("query_id").alias("request_id"), "id", "final").join(m.select(*context.ENTRY_COLUMNS, "pinned", "type", "topic_key"), "id")
    cited = context.citations_of(lineage.visible_evidence(ad.evidence(spark, d), m, F.lit(True), spark.createDataFrame([], "source_ref string")).withColumn("evidence_id", F.concat(F.lit("v"), F.col("memory_id").cast("string"))), False)
    e = e.join(cited.select(F.col("memory_id").alias("_m"), "cited"), F.col("id") == F.col("_m"), "left")
    section = F.when(F.col("pinned"), "Pinned").when(F.col("type") == "preference", "Preferences").otherwise("Task memories")
    e = e.select(
        "request_id",
        F.concat(F.lit("memory:"), F.col("id").cast("string")).alias("key"),
        context.entry_text({c: F.col(c) for c in context.ENTRY_COLUMNS}, F.col("cited"), "compact").alias("text"),
        section.alias("section"),
        context.priority(F.col("pinned"), F.col("type"), F.lit(True)).alias("priority"),
        F.col("final").alias("score"),
        F.coalesce("topic_key", F.lower(tx.nfc(F.col("title")))).alias("diversity_key"),
        "pinned",
    )
    return context.pack(e, context.Limits(10_000, 4000, 12_000, 10), frame=context.Frame(f"Project {PROJECT}"))


@query(sql("memories audit", "SELECT a.id AS retrieval_id, bool_and(coalesce(m.revision = 1 + a.k % 2 AND m.state = 'active', false)) AS admitted FROM audit a LEFT JOIN memories m ON m.id = a.k WHERE a.kind = 'inject' GROUP BY a.id"))
def context_admission(spark, d):
    i = ad.audit(spark, d).filter("kind = 'inject'").select(F.col("id").alias("retrieval_id"), F.col("k").alias("memory_id"), (1 + F.col("k") % 2).alias("revision"))
    return context.admitted(i, ad.memories(spark, d, False)).select("retrieval_id", "admitted")


# More queries, which register themselves.
from . import governance  # noqa: E402, F401

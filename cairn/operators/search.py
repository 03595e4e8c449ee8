"""Lexical, vector and hybrid retrieval as lazy plans; narrow rows (ids and scores) until the last step."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import SESSION_WEIGHT, boost, dot, fused, sigmoid, usage_factor
from ..functions.text import index_words, search_terms
from .access import Access, out_of_date, without_invalid_sources
from .graph import cut

#: Column weights of the memory index; BM25 constants (fixed values).
MEMORY_WEIGHTS = {"title": 5.0, "content": 1.0, "topic_key": 3.0}
K1, B = 1.2, 0.75
EXACT_LIMIT, MOST_CANDIDATES = 5, 200


def postings(docs: DataFrame, weights: dict[str, float], id_col: str = "id", stems: DataFrame | None = None, wanted: DataFrame | None = None, phrase: int = 1, mark: bool = False) -> DataFrame:
    """id, term, tf (weighted over columns) and size (words of the document); of the wanted terms only, if given. With
    phrase above 1, of runs of so many words, with a space between them. With mark each document also has the term '',
    which is no word. With stems(word, term) words count as their terms, others not at all. Rows are dealt by id."""
    words = {c: index_words(F.col(c)) for c in weights}
    size = sum((F.size(w) for w in words.values()), F.lit(0))

    def runs(column: str) -> Column:
        w = words[column]
        if phrase == 1:
            return w
        starts = F.when(F.size(w) >= phrase, F.sequence(F.lit(1), F.size(w) - phrase + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(phrase)), " "))

    def weighed(column: str) -> Column:
        return F.transform(runs(column), lambda t: F.struct(t.alias("term"), F.lit(weights[column]).alias("w")))

    none = F.array(F.struct(F.lit("").alias("term"), F.lit(0.0).alias("w")))
    parts = F.concat(*map(weighed, words), *([none] if mark else []))
    # The size is worked out before the words are exploded; in one select it would be again for every word.
    df = docs.select(F.col(id_col).alias("id"), size.alias("size"), parts.alias("parts"))
    df = df.select("id", "size", F.explode("parts").alias("p")).select("id", "size", F.col("p.term").alias("term"), F.col("p.w").alias("w"))
    if mark and wanted is not None:
        wanted = wanted.select("term").union(docs.sparkSession.createDataFrame([("",)], "term string"))
    if stems is not None:
        same = stems.sparkSession.createDataFrame([("", "")], "word string, term string")
        df = df.withColumnRenamed("term", "word").join(_few(stems.union(same)), "word").drop("word")
    elif wanted is not None:
        df = df.join(_few(wanted), "term", "left_semi")
    return df.repartition("id").groupBy("id", "term").agg(F.sum("w").alias("tf"), F.first("size").alias("size"))


def stems_of(docs: DataFrame, weights: dict[str, float], stem: Callable[[Column], Column], wanted: DataFrame) -> DataFrame:
    """word and term of the words of docs whose stem is among wanted(term); each word of the vocabulary is stemmed once."""
    words = docs.select(F.explode(F.array_distinct(F.concat(*[index_words(F.col(c)) for c in weights]))).alias("word")).distinct()
    return cut(words.withColumn("term", stem(F.col("word"))).join(_few(wanted), "term", "left_semi").select("word", "term"))


#: Terms that are broadcast at most.
FEW_TERMS = 200_000


def _few(terms: DataFrame) -> DataFrame:
    return F.broadcast(terms) if terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS else terms


def split_terms(terms: DataFrame) -> DataFrame:
    """Distinct query_id and term of terms(query_id, term) as the index has them, and _n, of how many words each is."""
    split = index_words(F.col("term"))
    return terms.select("query_id", F.array_join(split, " ").alias("term"), F.size(split).alias("_n")).filter("_n > 0").distinct()


def bm25_part(n_docs: Column, df: Column, tf: Column, size: Column, mean_size: Column) -> Column:
    """What a term adds to a document's score; it grows with tf and falls with size."""
    idf = F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean_size))


def bm25(docs: DataFrame, terms: DataFrame, weights: dict[str, float] = MEMORY_WEIGHTS, id_col: str = "id", stem: Callable[[Column], Column] | None = None, visible: DataFrame | None = None) -> DataFrame:
    """query_id, id and score of every document with a term of terms(query_id, term), of those of visible(id) if given. A
    term that the index would split, as `a.b`, is looked for as a phrase. Statistics cover all of docs; filter the result by
    authorisation, or give visible, before taking the best. Texts are read once for the statistics of all terms and once
    for the scores; a document's scores are put together where its words are."""
    terms = cut(split_terms(terms))
    lengths = sorted(r[0] for r in terms.select("_n").distinct().collect())  # one, and seldom two or three
    if not lengths:
        return docs.sparkSession.createDataFrame([], "query_id long, id long, score double")

    stems = None if stem is None else stems_of(docs, weights, stem, terms.filter("_n = 1").select("term").distinct())

    def found(marked: bool) -> DataFrame:
        parts = []
        for n in lengths:
            wanted = terms.filter(F.col("_n") == n).select("term").distinct()
            parts.append(postings(docs, weights, id_col, stems if n == 1 else None, wanted, n, marked and n == lengths[0]))
        return reduce(DataFrame.unionByName, parts)

    stats = cut(found(True).groupBy("term").agg(F.count("*").alias("df"), F.sum("size").alias("words")))
    about = stats.filter("term = ''").select(F.col("df").alias("n_docs"), (F.col("words") / F.col("df")).alias("mean_size"))
    asked = terms.drop("_n").join(stats.drop("words"), "term").crossJoin(F.broadcast(about))
    rows = found(False)
    if visible is not None:
        rows = rows.join(visible.select("id"), "id", "left_semi")
    part = bm25_part(*map(F.col, ("n_docs", "df", "tf", "size", "mean_size")))
    return rows.join(_few(cut(asked)), "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))


def top(ranked: DataFrame, k: int, score: str = "score", per: str = "query_id") -> DataFrame:
    """The k best rows of each query with their rank from 1; ties by id."""
    w = Window.partitionBy(per).orderBy(F.desc(score), F.asc("id"))
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def exact_candidates(memories: DataFrame, query: str, limit: int = EXACT_LIMIT) -> DataFrame:
    """Rows that a query names: #id, or a whole title or topic key. An id that is not there gives nothing at all; too many
    rows of a title give nothing either."""
    q = " ".join(query.split()).lower()
    by_id = q.removeprefix("#")
    if by_id.isascii() and by_id.isdigit():
        rows = memories.filter(F.col("id") == int(by_id))
    else:
        rows = memories.filter((F.lower("title") == q) | (F.lower("topic_key") == q))
    rows = rows.select("id", "pinned").orderBy(F.desc("pinned"), "id").limit(limit + 1)
    rows = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("pinned"), "id"))).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1))))
    return rows.filter(F.col("_n") <= limit).select("id", "rank", (1.0 / F.col("rank")).alias("score"))


def like_ids(memories: DataFrame, query: str, k: int) -> DataFrame:
    """Rows that hold the query as a piece of text, newest first."""
    q = query.replace("%", "").replace("_", "").lower()
    hit = F.lit(False)
    for c in ("title", "content", "topic_key"):
        hit |= F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False))
    rows = memories.filter(hit).select("id", "updated_at").orderBy(F.desc("updated_at"), "id").limit(k)
    return rows.select("id", F.row_number().over(Window.orderBy(F.desc("updated_at"), "id")).alias("rank"))


def like_fallback(memories: DataFrame, query: str, lexical: DataFrame, k: int) -> DataFrame:
    """like_ids, but only for a query under three letters or where the keyword search found nothing."""
    rows = like_ids(memories, query, k)
    if len(query) < 3:
        return rows
    none = lexical.agg((F.count("*") == 0).alias("_none"))
    return rows.crossJoin(F.broadcast(none)).filter("_none").drop("_none")


#: Queries that are broadcast at most, and rows of a block beyond that.
FEW_QUERIES, BLOCK = 64, 1024


def neighbours(queries: DataFrame, vectors: DataFrame, k: int, minimum: float = -1.0, relative: float = 0.0) -> DataFrame:
    """query_id, id, similarity and rank: the k nearest of each of queries(query_id, embedding) among vectors(id,
    embedding), above minimum and above relative times the best. Restrict vectors to what may be read before calling: the
    floor follows from the best of those. A few queries are broadcast, after a look at how many there are; more are cut
    into blocks like the vectors, each pair of blocks one task, which passes the best of each query on."""
    if queries.select("query_id").limit(FEW_QUERIES + 1).count() <= FEW_QUERIES:
        pairs = vectors.crossJoin(F.broadcast(queries.withColumnRenamed("embedding", "_q")))
        pairs = pairs.select("query_id", "id", F.round(dot(F.col("_q"), F.col("embedding")), 6).alias("similarity"))
    else:
        pairs = _block_pairs(queries, vectors, k)
    best = top(pairs, k, "similarity")
    first = F.max("similarity").over(Window.partitionBy("query_id"))
    floor = F.greatest(F.lit(minimum), F.col("_first") * relative) if relative else F.lit(minimum)
    return best.withColumn("_first", first).filter(F.col("similarity") >= floor).drop("_first")


def _block_pairs(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, id and similarity of the k best of each query in each block of vectors."""
    sizes = queries.agg(F.ceil(F.count("*") / BLOCK)).first()[0], vectors.agg(F.ceil(F.count("*") / BLOCK)).first()[0]
    n_q, n_v = (max(int(n), 1) for n in sizes)

    def dealt(df: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        spread = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)
        return df.select(F.pmod(F.xxhash64(key), F.lit(n_own)).alias(own), spread, F.lit(own).alias("side"), F.col(key).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e"))

    rows = dealt(queries, "query_id", "q", n_q, "v", n_v).unionByName(dealt(vectors, "id", "v", n_v, "q", n_q))
    # Vectors of another length, or with a part that is null, have no similarity.
    rows = rows.filter(F.forall("e", lambda x: x.isNotNull())).withColumn("n", F.size("e"))

    def best(group: pd.DataFrame) -> pd.DataFrame:
        x, y = group[group["side"] == "q"], group[group["side"] == "v"].sort_values("id")
        if not len(x) or not len(y):
            return pd.DataFrame({"query_id": [], "id": [], "similarity": []})
        product = np.stack(x["e"]) @ np.stack(y["e"]).T
        similarity = np.sign(product) * np.floor(np.abs(product) * 1e6 + 0.5) / 1e6
        first = np.argsort(-np.where(np.isnan(similarity), np.inf, similarity), axis=1, kind="stable")[:, :k]  # ids ascend, so ties go to the smaller one
        return pd.DataFrame({"query_id": np.repeat(x["id"].to_numpy(), first.shape[1]), "id": y["id"].to_numpy()[first].ravel(), "similarity": np.take_along_axis(similarity, first, 1).ravel()})

    return rows.groupBy("q", "v", "n").applyInPandas(best, "query_id long, id long, similarity double")


def rrf(*lists: DataFrame) -> DataFrame:
    """query_id, id and the fused score of ranked lists(query_id, id, rank)."""
    rows = lists[0].select("query_id", "id", "rank")
    for x in lists[1:]:
        rows = rows.unionByName(x.select("query_id", "id", "rank"))
    return rows.groupBy("query_id", "id").agg(F.sum(fused(F.col("rank"))).alias("score"))


@dataclass(frozen=True)
class Request:
    """A search as it is run: the query in lower case with single spaces, and its bounds."""

    query: str
    limit: int
    candidates: int
    kinds: tuple[str, ...] | None = None
    scope: str = "all"


def resolved(query: str, limit: int | None = None, candidates: int | None = None, kinds: list[str] | None = None, scope: str = "all") -> Request | None:
    """A request within bounds (60 candidates by default, MOST_CANDIDATES at most, 8 results by default, never more than
    candidates); None for one that asks for nothing."""

    def bounded(n: int | None, default: int, most: int) -> int:
        return min(default if n is None else max(int(n), 0), most)

    candidates = bounded(candidates, 60, MOST_CANDIDATES)
    limit = bounded(limit, 8, candidates)
    if not limit or kinds == []:
        return None
    return Request(" ".join(query.split()).lower(), limit, candidates, tuple(kinds) if kinds is not None else None, scope)


def memory_search(memories: DataFrame, relations: DataFrame | None, access: Access, request: Request | None, now: Column, embed: Callable[[Column], Column] | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """id, rank, title and final of one request: an empty query lists; a query that names an id or a whole title gives
    that and no more; any other is searched by keywords and by vector, by a piece of text where it is short or keywords
    find nothing, fused, boosted and cut. What may not be read or is out of date is left out before any limit."""
    spark = memories.sparkSession
    if request is None:
        return spark.createDataFrame([], "id long, rank int, title string, final double")
    live = memories.filter("deleted_at is null")
    seen = live.filter(access.memory_filter(now, request.scope, kinds=list(request.kinds) if request.kinds is not None else None))
    if relations is not None:
        seen = without_invalid_sources(seen, out_of_date(memories, relations, now))
    one = F.lit(0).alias("query_id")
    if not request.query:
        rows = seen.orderBy(F.desc("pinned"), F.desc("updated_at"), "id").limit(request.limit)
        rank = F.row_number().over(Window.orderBy(F.desc("pinned"), F.desc("updated_at"), "id"))
        return rows.select("id", rank.alias("rank"), "title", F.lit(0.0).alias("final"))
    exact = exact_candidates(seen, request.query, min(EXACT_LIMIT, request.candidates))
    names_id = request.query.removeprefix("#").isascii() and request.query.removeprefix("#").isdigit()
    if names_id or not exact.isEmpty():
        refs = exact.select(one, "id", "score")
    else:
        ids = seen.select("id")
        terms = spark.range(1).select(one, F.explode(search_terms(F.lit(request.query))).alias("term"))
        words = top(bm25(live, terms, visible=ids), request.candidates)
        lists = [words, like_fallback(seen, request.query, words, request.candidates).select(one, "id", "rank")]
        if embed is not None and vectors is not None:
            asked = spark.range(1).select(one, embed(F.lit(request.query)).alias("embedding"))
            lists.append(neighbours(asked, vectors.join(ids, "id", "left_semi"), request.candidates, 0.2, 0.5))
        refs = top(rrf(*lists), request.candidates).drop("rank")
    out = top(materialise(refs, memories, now, access.project), request.limit, "final")
    return out.select("id", "rank", "title", "final")


def attachments(hits: DataFrame, memories: DataFrame, projects: DataFrame) -> DataFrame:
    """Hits(id, rank) as attachments: identifier, title, subtitle and text, with the project's name or `global`."""
    own = memories.select("id", "type", "title", "content", "project_key")
    p = projects.select(F.col("key").alias("project_key"), "name")
    df = hits.select("id", "rank").join(own, "id").join(p, "project_key", "left")
    where, number = F.coalesce("name", F.lit("global")), F.col("id").cast("string")
    text = F.concat(F.lit("Memory #"), number, F.lit(" ("), "type", F.lit(", "), where, F.lit("): "), "title", F.lit("\n\n"), "content")
    return df.select("rank", F.concat(F.lit("#"), number).alias("identifier"), "title", F.concat("type", F.lit(" · "), where).alias("subtitle"), text.alias("text"))


def memory_boost(now: Column, project: str | None, usage_ranking: bool = True) -> Column:
    touched = F.greatest("updated_at", F.coalesce("verified_at", "updated_at"))
    activity = F.col("application_count") + F.col("helpful_count") - F.col("harmful_count")
    out = boost(F.col("pinned"), F.coalesce(F.col("project_key") == F.lit(project), F.lit(False)), touched, now, activity)
    return out * usage_factor(F.col("shown_count"), F.col("opened_count")) if usage_ranking else out


def materialise(refs: DataFrame, memories: DataFrame, now: Column, project: str | None, usage_ranking: bool = True) -> DataFrame:
    """refs(query_id, id, score[, revision, relevance]) joined to their rows: final = (relevance or score) * boost. A ref
    whose row has moved on to another revision is dropped."""
    own = memories.select("id", F.col("revision").alias("_rev"), "title", "content", "pinned", "project_key", "updated_at", "verified_at", "application_count", "helpful_count", "harmful_count", "shown_count", "opened_count")
    df = refs.join(own, "id")
    if "revision" in refs.columns:
        df = df.filter(F.col("revision") == F.col("_rev"))
    base = F.coalesce("relevance", "score") if "relevance" in refs.columns else F.col("score")
    return df.withColumn("final", F.round(base * memory_boost(now, project, usage_ranking), 9))


def hybrid(memories: DataFrame, visible: Column, terms: DataFrame, queries: DataFrame | None, vectors: DataFrame, now: Column, project: str | None, candidates: int = 60, limit: int = 8, minimum: float = 0.2, relative: float = 0.5) -> DataFrame:
    """Keyword and vector ranks over the visible rows, fused, boosted and cut to the best of each query."""
    seen = memories.filter(visible)
    words = top(bm25(memories, terms, visible=seen), candidates)
    lists = [words]
    if queries is not None:
        lists.append(neighbours(queries, vectors.join(seen.select("id"), "id", "left_semi"), candidates, minimum, relative))
    refs = top(rrf(*lists), candidates)
    out = materialise(refs.drop("rank"), memories, now, project)
    return top(out, limit, "final").select("query_id", "id", "rank", "title", F.round("score", 9).alias("fused"), "final")


def rerank(hits: DataFrame, query: str, scorer: Callable[[str, pd.Series], pd.Series], keep: int = 30) -> DataFrame:
    """Scores the best `keep` of hits(id, kind, text, score) again with a cross-encoder given as a function; the others are
    dropped. Sessions weigh a little less than memories."""
    best = hits.orderBy(F.desc("score"), "kind", "id").limit(keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(logit=scorer(query, b["text"]).astype("float64"))

    from pyspark.sql import types as T

    scored = best.mapInPandas(run, T.StructType([*best.schema.fields, T.StructField("logit", T.DoubleType())]))
    weight = F.when(F.col("kind") == "session", SESSION_WEIGHT).otherwise(1.0)
    return scored.withColumn("relevance", sigmoid(F.col("logit")) * weight).drop("logit")


def quality_of(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """Top-1 share and mean reciprocal rank by kind, of ranked(query_id, id, rank) against wanted(query_id, kind, id)."""
    hit = wanted.join(ranked, ["query_id", "id"], "left")
    return hit.groupBy("kind").agg(
        F.count("*").alias("n"),
        F.round(F.avg((F.coalesce("rank", F.lit(0)) == 1).cast("double")), 6).alias("top1"),
        F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"),
    )

"""Merkle manifest of a dataset: a leaf for each row, a subroot for each lang, one root, and a proof for each row.

Leaves are hashed in the JVM and dealt by range, which gives each its place in its lang. Places are cut into aligned blocks
of fanout ** levels leaves; a task walks a block recursively in postorder, returning each subtree's digest and appending
the siblings to the leaves below while unwinding. The roots of blocks are the leaves of the next walk, until every lang has
one node; the subroots are walked likewise. Paths are then joined from the top down, folded and digested in the JVM.

A block's group holds fanout ** levels rows, a path the siblings of one leaf; texts stay where they are read.

Cases: a null field is "-"; rows with equal doc_id stand in order of their leaves, a null doc_id before all; repeated rows
are leaves of their own, which of them comes first is open (their leaves are equal, their proofs belong to the places); a
null lang is a lang and comes first; an empty text is "0:"; texts of any length are hashed whole; one lang's subroot is the
root; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CRC32_SQL, staged
from .ranks import ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"


def sha(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _walk(digests: list[str], height: int, fanout: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """Digest of the tree of that height over digests, and for each of them the siblings left and right, from below."""
    from hashlib import sha256

    paths: list[list[tuple[str, str]]] = [[] for _ in digests]

    def visit(lo: int, hi: int, level: int) -> str:
        if not level:
            return digests[lo]
        span = fanout ** (level - 1)
        below = [(a, min(a + span, hi)) for a in range(lo, hi, span)]
        own = [visit(a, b, level - 1) for a, b in below]
        for i, (a, b) in enumerate(below):
            beside = "".join(own[:i]), "".join(own[i + 1 :])
            for path in paths[a:b]:
                path.append(beside)
        return sha256("".join(own).encode()).hexdigest()

    return visit(0, len(digests), height), paths


def _height(n: int, fanout: int) -> int:
    h = 0
    while fanout**h < n:
        h += 1
    return h


def _walker(fanout: int, levels: int, carry: list[str]) -> Callable[[pa.Table], pa.Table]:
    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        n = block.column("n")[0].as_py()
        top, paths = _walk(block.column("digest").to_pylist(), levels if n > fanout**levels else _height(n, fanout), fanout)
        ends = [0]
        for p in paths:
            ends.append(ends[-1] + len(p))
        sides = [pa.array([x[k] for p in paths for x in p], pa.string()) for k in (0, 1)]
        path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(sides, ["left", "right"]))
        return pa.table([block.column(c) for c in ("key", "place", "n", *carry)] + [path, pa.array([top] * len(block), pa.string())], names=["key", "place", "n", *carry, "path", "top"])

    return run


def walked(nodes: DataFrame, fanout: int = 2, levels: int = 10) -> tuple[DataFrame, DataFrame]:
    """For nodes(key, place, n, digest, kept): key, kept and the whole path of siblings; and key and root of each key."""
    size = fanout**levels
    most, rounds, carry = nodes.agg(F.max("n")).first()[0] or 0, [], ["kept"]
    while True:
        kept = f"kept {nodes.schema['kept'].dataType.simpleString()}, " if carry else ""
        dealt = nodes.select("key", "place", "n", "digest", *carry, F.floor(F.col("place") / size).alias("block"))
        schema = f"key string, place long, n long, {kept}path {PATH}, top string"
        done = staged(dealt.groupBy("key", "block").applyInArrow(_walker(fanout, levels, carry), schema), "manifest-walk")
        rounds.append(done)
        if most <= size:
            break
        nodes = done.filter(F.col("place") % size == 0).select("key", F.floor(F.col("place") / size).alias("place"), F.ceil(F.col("n") / size).alias("n"), F.col("top").alias("digest"))
        most, carry = -(-most // size), []
    up = rounds.pop()
    roots = up.filter("place = 0").select("key", F.col("top").alias("digest"))
    while rounds:
        above = up.select(F.col("key").alias("_key"), F.col("place").alias("_block"), F.col("path").alias("_above"))
        low = rounds.pop()
        joined = low.join(above, (F.col("key") == F.col("_key")) & (F.floor(F.col("place") / size) == F.col("_block")))
        up = joined.select("key", "place", *([] if rounds else ["kept"]), F.concat("path", "_above").alias("path"))
    return up.select("key", "kept", "path"), roots


def leaf(docs: DataFrame, **other: Column) -> Column:
    """A row's leaf, or the one it would be with other values."""
    return sha(F.concat(*[field(other.get(c, docs[c])) for c in FIELDS]))


def manifest(docs: DataFrame, keep: list[str] | None = None, fanout: int = 2, levels: int = 10) -> DataFrame:
    """The columns to keep (doc_id; narrow ones only), then leaf, path (siblings left and right, from the leaf up), subroot
    and root of each row of docs."""
    keep = keep or ["doc_id"]
    rows = docs.select(F.struct(F.struct(*[docs[c] for c in keep]).alias("of"), leaf(docs).alias("leaf")).alias("kept"), docs["doc_id"].alias("id"), field(docs["lang"]).alias("key"))
    places = ranked(rows.withColumn("digest", F.col("kept.leaf")), "key", ["id", "digest"])
    rows, tops = walked(places, fanout, levels)
    lang = F.when(F.col("key") != "-", F.regexp_replace("key", r"^\d+:", ""))
    tops = ranked(tops.select(F.lit("").alias("all"), F.struct("key", F.col("digest").alias("subroot")).alias("kept"), lang.alias("lang"), "digest"), "all", ["lang"])
    above, root = walked(tops.withColumnRenamed("all", "key"), fanout, levels)
    above = above.select("kept.*", F.col("path").alias("_above"))
    root = root.first()  # one row, or none of an empty table
    out = rows.withColumnRenamed("key", "_key").join(above, F.col("_key") == F.col("key"))
    return out.select("kept.of.*", "kept.leaf", F.concat("path", "_above").alias("path"), "subroot", F.lit(root and root["digest"]).cast("string").alias("root"))


def proof(path: str) -> Column:
    """The siblings of a path in one digest."""
    return sha(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""))


def folded(leaf: str, path: str) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, F.col(leaf), lambda acc, x: sha(F.concat(x["left"], acc, x["right"])))


ORACLE = f"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail,
    coalesce((SELECT {CRC32_SQL} FROM (SELECT doc_id::VARCHAR AS s)) % 7 = 0, false) AS tampered
  FROM documents
),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) ELSE sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) END AS claim
  FROM fields
),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
tree AS (
  SELECT 0 AS level, lang, place AS i, leaf AS d, count(*) OVER (PARTITION BY lang) AS n FROM placed
  UNION ALL
  SELECT level + 1, lang, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY level, lang, i // 2, n
),
subroots AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang COLLATE "binary" NULLS FIRST) - 1 AS place FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, place AS i, subroot AS d, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, i // 2, n
),
both_trees AS (
  SELECT level, true AS low, lang, i, d FROM tree WHERE n > 1 UNION ALL SELECT level, false, NULL, i, d FROM top WHERE n > 1
),
heights AS (SELECT lang, max(level) AS h FROM tree GROUP BY lang),
steps AS (
  SELECT p.doc_id, p.lang, p.place, t.level AS k, p.place >> t.level AS own, t.i, t.d
  FROM placed p JOIN tree t ON t.n > 1 AND t.lang IS NOT DISTINCT FROM p.lang AND t.i = xor(p.place >> t.level, 1)
  UNION ALL
  SELECT p.doc_id, p.lang, p.place, 1000 + t.level, s.place >> t.level, t.i, t.d
  FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN top t ON t.n > 1 AND t.i = xor(s.place >> t.level, 1)
),
fold AS (
  SELECT lang, place, 0 AS k, claim AS acc, (SELECT h FROM heights WHERE heights.lang IS NOT DISTINCT FROM placed.lang) AS h FROM placed
  UNION ALL
  SELECT f.lang, f.place, CASE WHEN f.k + 1 = f.h THEN 1000 ELSE f.k + 1 END,
    sha256(CASE WHEN s.d IS NULL THEN f.acc WHEN s.i < s.own THEN s.d || f.acc ELSE f.acc || s.d END), f.h
  FROM (SELECT lang, place, acc, h, CASE WHEN h = 0 AND k = 0 THEN 1000 ELSE k END AS k FROM fold) f
  LEFT JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.place = f.place AND s.k = f.k
  WHERE f.k < f.h OR f.k >= 1000 AND f.k - 1000 < (SELECT max(level) FROM top)
),
ends AS (SELECT lang, place, arg_max(acc, CASE WHEN h = 0 AND k = 0 THEN 999 ELSE k END) AS folded_root FROM fold GROUP BY lang, place),
proofs AS (SELECT lang, place, string_agg(d, '' ORDER BY k) AS proof FROM steps GROUP BY lang, place),
root AS (SELECT d AS root FROM top WHERE n = 1)
SELECT p.doc_id, p.leaf, s.subroot, root.root, sha256(coalesce(q.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = root.root AS verified
FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN root
JOIN ends e ON e.lang IS NOT DISTINCT FROM p.lang AND e.place = p.place
LEFT JOIN proofs q ON q.lang IS NOT DISTINCT FROM p.lang AND q.place = p.place
"""

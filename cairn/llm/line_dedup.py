"""Line dedup over overlapping three-line windows, in DataFrame functions only.

A text splits at "\\n". Every three consecutive lines that hold a word make a window, which is hashed to 128 bits. Of the
windows that occur more than once anywhere, all but the first (by doc_id, then text digest, then place) are later
occurrences; the lines they cover, merged, are removed. A line outside later occurrences stays, so a document with fewer
than three lines is never changed.

Cases: a null text stays null, an empty one empty; rows equal in doc_id and text are one document read twice and get one
result; a null doc_id sorts first; an empty table gives an empty one; the other columns of the input stay as they are,
whatever their names, but n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sealed, staged

WINDOW = 3


def _windows(docs: DataFrame) -> DataFrame:
    """One row per window: doc_id, digest, place, h1, h2."""

    def hashes(i: Column) -> Column:
        at = [F.get("_lines", i + k) for k in range(WINDOW)]
        return F.struct(
            i.alias("place"),
            F.xxhash64(*at).alias("h1"),
            F.xxhash64(F.lit(1), *at).alias("h2"),
            F.concat(*at).rlike(r"[^\x20\x09-\x0D]").alias("worded"),
        )

    df = docs.select("doc_id", F.xxhash64("text").alias("_digest"), F.split("text", "\n").alias("_lines")).filter(F.size("_lines") >= WINDOW)
    df = df.select("doc_id", "_digest", F.explode(F.transform(F.sequence(F.lit(0), F.size("_lines") - WINDOW), hashes)).alias("w"))
    return df.filter("w.worded").select("doc_id", "_digest", "w.place", "w.h1", "w.h2")


def removed_places(docs: DataFrame) -> DataFrame:
    """doc_id, _digest and _covered (sorted places of lines to remove) of each document that loses lines.

    The only wide rows shuffled are fixed-size window keys. Firsts come from a partially aggregated minimum; they are
    written out so that the join back to the windows reads two plain exchanges, whose hot keys Spark splits."""
    windows = staged(_windows(docs), "line-windows")
    firsts = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "_digest", "place")).alias("first"), F.count("*").alias("n"))
    firsts = staged(firsts.filter("n > 1").drop("n"), "line-firsts")
    later = windows.join(firsts, ["h1", "h2"]).filter(F.struct("doc_id", "_digest", "place") > F.col("first"))
    # A document's own lines bound what it collects.
    starts = later.groupBy("doc_id", "_digest").agg(F.collect_set("place").alias("starts"))
    lines = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + WINDOW - 1)))
    return starts.select("doc_id", "_digest", F.array_sort(F.array_distinct(lines)).alias("_covered"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with later occurrences taken out of text, and n_lines and n_removed; n_chars, if there, follows the text."""
    df, (doc_id, text) = sealed(docs, "doc_id", "text")
    removed = removed_places(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    removed = removed.withColumnsRenamed({"doc_id": "_doc_id", "_digest": "_of"})
    df = df.join(removed, F.col(doc_id).eqNullSafe(F.col("_doc_id")) & (F.xxhash64(text) == F.col("_of")), "left")
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_covered"))
    df = df.withColumns(
        {
            "n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.size("_covered"), F.lit(0)).cast("long"),
            "_lines": lines,
            "_left": F.when(F.col("_covered").isNotNull(), left),
        }
    )
    out = F.when(F.col("_left").isNull(), F.col(text)).otherwise(F.array_join(F.transform("_left", lambda i: F.get("_lines", i)), "\n"))
    df = df.withColumn(text, out)
    if "n_chars" in docs.columns:
        df = df.withColumn(f"in{docs.columns.index('n_chars')}", F.length(text).cast(docs.schema["n_chars"].dataType))
    kept = [F.col(f"in{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ("n_lines", "n_removed")]
    return df.select(*kept, "n_lines", "n_removed")


ORACLE = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, text, i AS place, l[i] AS a, l[i + 1] AS b, l[i + 2] AS c
  FROM (SELECT doc_id, text, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) >= 3)
  WHERE regexp_matches(l[i] || l[i + 1] || l[i + 2], '[^\x20\x09-\x0D]')
),
later AS (
  SELECT doc_id, text, place FROM w
  QUALIFY rank() OVER (PARTITION BY a, b, c ORDER BY doc_id, text, place) > 1
),
gone AS (SELECT DISTINCT doc_id, text, unnest(range(place, place + 3)) AS i FROM later),
cut AS (
  SELECT d.doc_id, d.text, count(gone.i) AS n_removed, any_value(len(d.l)) AS n_lines,
    string_agg(CASE WHEN gone.i IS NULL THEN d.line END, chr(10) ORDER BY d.i) AS kept
  FROM (SELECT doc_id, text, l, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d) d
  LEFT JOIN gone ON gone.doc_id = d.doc_id AND gone.text = d.text AND gone.i = d.i
  GROUP BY d.doc_id, d.text
)
SELECT d.doc_id, coalesce(c.n_lines, 0)::BIGINT AS n_lines, coalesce(c.n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(c.kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN cut c ON c.doc_id IS NOT DISTINCT FROM d.doc_id AND c.text = d.text
"""

"""A deterministic embedder without model files: hashed bag of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a text that an embedder reads, and what it puts before queries and passages (fixed values).
MOST_CHARS = 8000
PREFIXES = {"query": "query: ", "passage": "passage: "}


def prepared(text: Column, kind: str | None = None) -> Column:
    """A text as an embedder takes it: with the prefix of its kind, where the model wants one, and cut."""
    return F.concat(F.lit(PREFIXES[kind] if kind else ""), F.substring(F.coalesce(text, F.lit("")), 1, MOST_CHARS))


def static_embedding(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """id and embedding of texts(id, text) from a table of token vectors(token, vector): the sum over a text's words that
    the table has, scaled to length 1; texts without such a word get none. The table is joined, so it may be of any size."""
    words = F.regexp_extract_all(F.lower(prepared(F.col("text"))), F.lit("([a-z0-9]+)"), 1)
    return pooled(texts.select("id", F.explode(words).alias("token")).groupBy("id", "token").agg(F.count("*").alias("n")), tokens)


def pooled(counted: DataFrame, tokens: DataFrame) -> DataFrame:
    """id and embedding of counted(id, token, n): the sum of tokens(token, vector), scaled to length 1."""
    w = counted.join(tokens, "token")
    slots = w.select("id", "n", F.posexplode("vector").alias("slot", "x")).groupBy("id", "slot").agg(F.sum(F.col("n") * F.col("x").cast("double")).alias("x"))
    e = slots.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "x"))), lambda s: s["x"]).alias("e"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return e.select("id", F.transform("e", lambda x: F.when(F.col("n") > 0, x / F.col("n")).otherwise(x)).alias("embedding"))


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """Counts of words by slot (first 32 bits of their SHA-256, modulo dims), scaled to length 1; zeros without words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    slots = F.transform(words, lambda w: F.conv(F.substring(F.sha2(w, 256), 1, 8), 16, 10).cast("long") % dims)

    def counts(own: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(own, lambda s: s == i)).cast("double"))

    def unit(c: Column) -> Column:
        return F.transform(F.array(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(x)))

    # One-element arrays bind what would otherwise be worked out again for every slot.
    counted = F.transform(F.array(slots), counts)
    return F.flatten(F.flatten(F.transform(counted, unit)))

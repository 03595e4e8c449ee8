"""Duplicates, conflicts and merging."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_negated, nfc, value_tokens
from .cells import nearest
from .graph import cut

SAME_FIELDS = ("type", "source", "agent_id", "provider", "pinned", "record_kind", "verification_status", "valid_from", "valid_until")


#: Rows of families of several forms that are broadcast at most.
FEW_MIXED = 100_000


def exact_duplicates(memories: DataFrame) -> DataFrame:
    """Groups of live rows with one content hash in one namespace: keeper, copies and duplicate_count."""
    df = memories.filter("deleted_at is null").groupBy("content_hash", "scope", "project_key")
    df = df.agg(F.min("id").alias("keeper"), F.count("*").alias("copies"), F.max("updated_at").alias("last_seen_at"))
    return df.filter("copies > 1").withColumn("duplicate_count", F.col("copies") - 1)


def near_everywhere(vectors: DataFrame, k: int, threshold: float, rows: int = 1024) -> DataFrame:
    """a, b, similarity: of the k nearest in its own scope of every row (itself among them, then removed) those at or above
    threshold, by cells of about so many rows, of which only pairs are looked at that may hold one."""
    return nearest(vectors, k, threshold, rows)[0]


def save_gate(near: DataFrame, memories: DataFrame) -> DataFrame:
    """a, b and outcome: near_duplicate for equal types, possible_duplicate otherwise."""
    kinds = memories.select("id", "type")
    df = near.join(kinds.select(F.col("id").alias("a"), F.col("type").alias("_ta")), "a").join(kinds.select(F.col("id").alias("b"), F.col("type").alias("_tb")), "b")
    return df.withColumn("outcome", F.when(F.col("_ta") == F.col("_tb"), "near_duplicate").otherwise("possible_duplicate")).drop("_ta", "_tb")


def same_topic_pairs(memories: DataFrame) -> DataFrame:
    """a < b with one topic key, in one project or with a global row among them. A namespace has a topic once, so joining
    the global rows to all, and projects to themselves, costs a row or two for each memory."""
    t = memories.filter("topic_key is not null and deleted_at is null").select("id", "topic_key", "scope", "project_key")
    shared = t.filter("scope = 'global'").select(F.col("id").alias("_g"), "topic_key").join(t.select("id", "topic_key"), "topic_key").filter("_g <> id")
    own = t.filter("scope = 'project'").select("id", "topic_key", "project_key")
    own = own.withColumnRenamed("id", "_g").join(own, ["topic_key", "project_key"]).filter("_g <> id").select("topic_key", "_g", "id")
    return shared.select("topic_key", "_g", "id").unionByName(own).select(F.least("_g", "id").alias("a"), F.greatest("_g", "id").alias("b"), "topic_key").distinct()


def candidate_pairs(near: DataFrame, topics: DataFrame, memories: DataFrame, dismissed: DataFrame) -> DataFrame:
    """low, high, similarity and same_topic of pairs of one type that are near or share a topic, but for dismissed ones."""
    same = save_gate(near, memories).filter("outcome = 'near_duplicate'")
    rows = same.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), F.round("similarity", 3).alias("similarity"))
    rows = rows.unionByName(topics.select(F.col("a").alias("low"), F.col("b").alias("high"), F.lit(None).cast("double").alias("similarity")))
    pairs = rows.groupBy("low", "high").agg(F.max("similarity").alias("similarity"))
    topic = topics.select(F.col("a").alias("low"), F.col("b").alias("high"), F.lit(True).alias("same_topic"))
    pairs = pairs.join(topic, ["low", "high"], "left").withColumn("same_topic", F.coalesce("same_topic", F.lit(False)))
    return pairs.join(dismissed.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")), ["low", "high"], "left_anti")


def conflict(a: Column, b: Column) -> Column:
    """reason (values, negation or null) with the values that each text alone states."""
    va, vb = value_tokens(a), value_tokens(b)
    only_a, only_b = F.array_except(va, vb), F.array_except(vb, va)
    values = (F.size(only_a) > 0) & (F.size(only_b) > 0)
    none = F.array().cast("array<string>")
    reason = F.when(values, "values").when(is_negated(a) != is_negated(b), "negation")
    return F.struct(reason.alias("reason"), F.when(values, only_a).otherwise(none).alias("only_a"), F.when(values, only_b).otherwise(none).alias("only_b"))


def pair_conflicts(pairs: DataFrame, memories: DataFrame) -> DataFrame:
    text = memories.select("id", F.concat_ws("\n", "title", "content").alias("t"))
    df = pairs.join(text.select(F.col("id").alias("low"), F.col("t").alias("_a")), "low").join(text.select(F.col("id").alias("high"), F.col("t").alias("_b")), "high")
    return df.withColumn("conflict", conflict(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def in_project(pairs: DataFrame, memories: DataFrame, project: str) -> DataFrame:
    """Pairs with their conflict whose rows both belong to a project's view (its own and the global ones), as part
    duplicates, without a conflict, or conflicts."""
    own = memories.filter((F.col("scope") == "global") | F.coalesce(F.col("project_key") == project, F.lit(False))).select("id")
    for side in ("low", "high"):
        pairs = pairs.join(own.withColumnRenamed("id", side), side, "left_semi")
    return pairs.withColumn("part", F.when(F.col("conflict.reason").isNull(), "duplicates").otherwise("conflicts"))


def mergeable(pairs: DataFrame, memories: DataFrame) -> DataFrame:
    """Pairs that automatic merging may touch, with target and source. The same text after canonical composition, type,
    namespace and authority; nothing archived, no conflict."""

    def side(mark: str) -> DataFrame:
        return memories.select(F.struct("*").alias(mark), F.col("id").alias(f"_{mark}"))

    df = pairs.join(side("x"), F.col("low") == F.col("_x")).join(side("y"), F.col("high") == F.col("_y"))
    same = F.lit(True)
    for c in ("scope", "project_key", *SAME_FIELDS):
        same &= F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    for c in ("title", "content"):
        same &= F.trim(nfc(F.col(f"x.{c}"))) == F.trim(nfc(F.col(f"y.{c}")))
    same &= F.col("x.archived_at").isNull() & F.col("y.archived_at").isNull()
    same &= conflict(F.concat_ws("\n", "x.title", "x.content"), F.concat_ws("\n", "y.title", "y.content"))["reason"].isNull()
    target = merge_target(F.col("x"), F.col("y"))
    return df.filter(same).select("low", "high", target.alias("target"), (F.col("low") + F.col("high") - target).alias("source"))


def merge_target(a: Column, b: Column) -> Column:
    """The id that stays: more activity, then opened more often, then newer, else b."""
    aa, ab = (x["application_count"] + x["helpful_count"] for x in (a, b))
    return (
        F.when(aa != ab, F.when(aa > ab, a["id"]).otherwise(b["id"]))
        .when(a["opened_count"] != b["opened_count"], F.when(a["opened_count"] > b["opened_count"], a["id"]).otherwise(b["id"]))
        .otherwise(F.when(a["updated_at"] > b["updated_at"], a["id"]).otherwise(b["id"]))
    )


def _alike_merged(rows: DataFrame, bits: int) -> DataFrame:
    """Merges of families whose rows never conflict: each row meets the best of the rows before it, and stays if that isn't
    better. The best so far is a running maximum, which is put together from those of blocks of ids, of blocks of blocks,
    and so on, so no task sees more than 2 ** bits rows of a family."""
    own = rows.select("_family", "_least", "id", F.struct("_active", "_opened", "_updated", "id").alias("k"))
    levels = [own.select("_family", F.col("id").alias("b"), "k")]
    for _ in range(max(-(-63 // bits) - 1, 0)):
        levels.append(levels[-1].groupBy("_family", F.shiftright("b", bits).alias("b")).agg(F.max("k").alias("k")))
    before = None
    for level in reversed(levels):
        block = F.shiftright("b", bits)
        # The highest level is one block, negative ids among it.
        w = Window.partitionBy("_family", *([] if before is None else [block])).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumns({"_up": block, "p": F.max("k").over(w)})
        if before is not None:
            first = before.select(F.col("_family").alias("_f"), F.col("b").alias("_b"), F.col("p").alias("_p"))
            level = level.join(first, (F.col("_family") == F.col("_f")) & (F.col("_up") == F.col("_b"))).withColumn("p", F.greatest("p", "_p"))
        before = level.select("_family", "b", "k", "p")
    met = before.filter("p is not null").join(own.select("_family", F.col("id").alias("b"), "_least"), ["_family", "b"])
    rank = lambda c: F.struct(*[F.col(f"{c}.{x}") for x in ("_active", "_opened", "_updated")])
    first = rank("p") > rank("k")
    low, high = F.col("p.id"), F.col("b")
    return met.select(F.col("_least").cast("string").alias("family"), low.alias("low"), high.alias("high"), F.when(first, low).otherwise(high).alias("target"), F.when(first, high).otherwise(low).alias("source"))


def auto_merge(memories: DataFrame, bits: int = 16) -> DataFrame:
    """family, low, high, target, source of the merges among memories, pairs of mergeable rows taken in order of low and
    high but for rows that an earlier merge took away. A family holds the rows that agree in all that mergeable() compares
    and is named by its smallest id. Families of one form, however large, are merged by a tree of running maxima; only those
    that hold several forms of their text, which may conflict, are folded one by one."""
    text = F.concat_ws("\n", "title", "content")
    same = [F.trim(nfc(F.col(c))).alias(f"_{c}") for c in ("title", "content")]
    fields = [F.unix_micros(c).alias(c) if c.startswith("valid_") else F.col(c) for c in ("scope", "project_key", *SAME_FIELDS)]
    rows = memories.filter("archived_at is null and title is not null and content is not null").select(
        F.sha2(F.to_json(F.struct(*fields, *same)), 256).alias("_family"),
        F.sha2(text, 256).alias("_form"),
        "id",
        (F.col("application_count") + F.col("helpful_count")).alias("_active"),
        F.col("opened_count").alias("_opened"),
        F.unix_micros("updated_at").alias("_updated"),
    )
    # Texts are read once; what follows, which looks at the rows many times over, sees a few narrow columns.
    rows = cut(rows)
    # Only where a family holds several forms of its text can two of its rows conflict.
    about = rows.groupBy(F.col("_family").alias("_f")).agg(F.count("*").alias("_n"), (F.min("_form") != F.max("_form")).alias("_mixed"), F.min("id").alias("_least")).filter("_n > 1")
    rows = rows.drop("_form").join(about.drop("_n"), F.col("_family") == F.col("_f")).drop("_f")
    rows = cut(rows)
    alike = _alike_merged(rows.filter("not _mixed"), bits)
    several = rows.filter("_mixed").select("id")
    several = F.broadcast(several) if several.count() <= FEW_MIXED else several
    mixed = memories.join(several, "id", "left_semi").select("id", value_tokens(text).alias("_values"), is_negated(text).alias("_negated"))
    rows = rows.filter("_mixed").drop("_mixed", "_least").join(mixed, "id")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        ids, rank = group["id"].tolist(), list(zip(group["_active"], group["_opened"], group["_updated"]))
        forms = [(frozenset(v), bool(n)) for v, n in zip(group["_values"], group["_negated"])]
        left, out = list(range(len(ids))), []
        while left:
            low, waiting = left[0], []
            for i, high in enumerate(left[1:], 1):
                (va, na), (vb, nb) = forms[low], forms[high]
                if na != nb or (va - vb and vb - va):
                    waiting.append(high)
                    continue
                first = rank[low] > rank[high]
                out.append((str(ids[0]), ids[low], ids[high], *((ids[low], ids[high]) if first else (ids[high], ids[low]))))
                if not first and waiting:
                    left = waiting + left[i:]
                    break
                low = low if first else high
            else:
                left = waiting
        return pd.DataFrame(out, columns=["family", "low", "high", "target", "source"])

    return alike.unionByName(rows.groupBy("_family").applyInPandas(fold, "family string, low long, high long, target long, source long"))


def upkeep_counts(pairs: DataFrame, memories: DataFrame, stale: Column) -> DataFrame:
    """One row: pairs without conflict, conflicts by reason, stale rows."""
    p = pair_conflicts(pairs, memories).agg(
        F.count_if(F.col("conflict.reason").isNull()).alias("duplicates"),
        F.count_if(F.col("conflict.reason") == "values").alias("value_conflicts"),
        F.count_if(F.col("conflict.reason") == "negation").alias("negation_conflicts"),
    )
    return p.crossJoin(memories.agg(F.count_if(stale).alias("stale")))


def save_receipt(status: Column, id_: Column) -> Column:
    """What a save reports."""
    at = F.concat(F.lit(" #"), id_.cast("string"))
    return (
        F.when(status == "created", F.concat(F.lit("Saved memory"), at))
        .when(status == "updated", F.concat(F.lit("Updated memory"), at))
        .when(status == "duplicate", F.concat(F.lit("Already saved as"), at))
        .when(status == "near_duplicate", F.concat(F.lit("Not saved: nearly the same as"), at))
        .otherwise(F.concat(F.lit("Unchanged"), at))
    )

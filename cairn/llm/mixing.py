"""Mixing sources to target weights by pivotal dependent rounding over a distributed reduction tree.

Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the words of the whole table; a target stops
at max_copies times its source's words and the excess goes to the others by weight. Each document of a source expects
target / source words copies. The whole part is taken outright; the fractional parts are rounded by pivotal duels: two
documents of similar size put their fractions together and one of them ends at 0 or 1, so that every document keeps its
expectation. Chunks of a bounded number of documents of a source and a class of sizes fight their duels side by side and
leave one undecided document each; fan_in of those meet at the next level, until a class of sizes has one left; the
classes of a source (fewer than 150) meet last, and what is left then its fraction decides. Chunks and random numbers
follow from contents and exact counts, never from the layout, so reruns agree.

Cases: a null text has size 0 and is never taken, like an empty one; a null source is a source, a null doc_id an id; rows
equal in doc_id, source and text are one unit that is decided together and dealt out again evenly (which of them gets
one copy more is open, as they are the same); an empty table gives an empty one; other columns stay as they are, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, sealed, staged


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (1, 2, 3)
    max_copies: int = 3
    seed: int = 7
    #: Documents that fight in one task at the lowest level, and those left over that meet at the next ones.
    chunk_rows: int = 4096
    fan_in: int = 64
    #: Repeated rows of a unit that one task numbers.
    twin_rows: int = 100_000


def targets(sources: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """source, source_size and target, from one row per source. Closed form of resharing until no target is above its
    cap: with sources by rising cap per weight, the capped ones are a prefix."""
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, params.weights))
    df = sources.withColumn("w", F.get(weights, ((F.row_number().over(rank) - 1) % len(params.weights)).cast("int")).cast("double"))
    df = df.withColumn("cap", F.col("source_size").cast("double") * params.max_copies)
    everything = Window.partitionBy(F.lit(1))
    order = everything.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cap_before = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    w_before = F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - cap_before) / (F.sum("w").over(everything) - w_before)
    df = df.withColumn("_capped", (F.col("cap") <= level * F.col("w")).cast("int"))
    df = df.withColumn("_capped", F.min("_capped").over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.sum(F.when(F.col("_capped"), F.col("cap")).otherwise(0.0)).over(everything)
    open_w = F.sum(F.when(F.col("_capped"), 0.0).otherwise(F.col("w"))).over(everything)
    return df.select("source", "source_size", F.when(F.col("_capped"), F.col("cap")).otherwise(left / open_w * F.col("w")).alias("target"))


def _duels(last: bool):
    def fight(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bucket", "size", "u", "digest"], kind="stable").reset_index(drop=True)
        p, u, z = group["p"].tolist(), group["u"].tolist(), group["z"].tolist()
        a = -1
        for b, pb in enumerate(p):
            if not 0.0 < pb < 1.0:
                continue
            if a < 0:
                a = b
                continue
            pa, both = p[a], p[a] + pb
            if both < 1.0:
                win, lose = both, 0.0
                a_wins = u[b] * both < pa
            else:
                win, lose = 1.0, both - 1.0
                a_wins = u[b] * (2.0 - both) < 1.0 - pb
            lose = 0.0 if lose < 1e-9 else lose
            win = 1.0 if win > 1.0 - 1e-9 else win
            p[a], p[b] = (win, lose) if a_wins else (lose, win)
            a = next((i for i in (a, b) if 0.0 < p[i] < 1.0), -1)
        if last and a >= 0:
            p[a] = 1.0 if z[a] < p[a] else 0.0  # its u may be spent in a duel
        group["p"] = p
        return group

    return fight


#: Words of a text, and a number that tells texts apart.
SIZE = r"[^\x20\x09-\x0D]+"
UNIT = ["doc_id", "source", "size", "digest"]


def _sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(SIZE)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("digest"))


def mix_units(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """One row per (doc_id, source, size, digest of the text): rows, source_size, target and total (copies of all its rows
    together)."""
    units = staged(_sized(docs).groupBy(*UNIT).agg(F.count("*").alias("rows")), "mix-units")
    aims = checkpoint(targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), params))
    # One row per source, which Spark broadcasts only below its threshold.
    df = units.withColumnRenamed("source", "_s").join(aims, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    copies = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.col("rows") * F.col("target") / F.col("source_size")).otherwise(0.0)
    df = df.withColumn("_c", F.least(copies, F.col("rows") * float(params.max_copies)))
    df = df.withColumn("base", F.floor(F.col("_c") + 1e-9)).withColumn("p", F.greatest(F.col("_c") - F.col("base"), F.lit(0.0)))
    df = df.withColumn("p", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.col("p"))).drop("_c")
    df = df.withColumn("bucket", F.floor(4 * F.log2(F.col("size") + 1.0)).cast("int"))
    counts = df.groupBy("source", "bucket").agg(F.ceil(F.count("*") / params.chunk_rows).cast("int").alias("parts"))
    counts = counts.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "parts")
    df = df.join(counts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))).drop("_s", "_b")

    def draw(level: int, what: int):
        return F.shiftrightunsigned(F.xxhash64(*UNIT, F.lit(params.seed), F.lit(level), F.lit(what)), 11) / F.lit(float(1 << 53))

    def fight(df: DataFrame, level: int, *place: str, last: bool = False) -> DataFrame:
        df = df.withColumns({"u": draw(level, 0), "z": draw(level, 1)})
        return staged(df.groupBy("source", *place).applyInPandas(_duels(last), df.schema), "mix-level")

    df = df.withColumn("chunk", F.pmod(F.xxhash64(*UNIT, F.lit(params.seed)), F.col("parts")).cast("int"))
    done, level = [], 0
    df = fight(df, level, "bucket", "chunk")
    while True:
        settled = (F.col("p") == 0.0) | (F.col("p") == 1.0)
        done.append(df.filter(settled))
        rest = df.filter(~settled)
        most = rest.agg(F.max("parts")).first()[0]
        if most is None:
            break
        level += 1
        if most == 1:  # one left of each class of sizes
            df = fight(rest.withColumn("parts", F.lit(1)), level, last=True)
        else:
            rest = rest.withColumn("chunk", F.floor(F.col("chunk") / params.fan_in).cast("int"))
            df = fight(rest.withColumn("parts", F.ceil(F.col("parts") / params.fan_in).cast("int")), level, "bucket", "chunk")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(*UNIT, "rows", "source_size", "target", (F.col("base") + F.col("p").cast("long")).alias("total"))


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies and taken."""
    units = mix_units(docs, params)
    whole, more = F.floor(F.col("total") / F.col("rows")), F.col("total") % F.col("rows")
    # Of a unit's rows `more` get one copy above the whole part: two counts, each written out as often as it says. Very
    # many repeats of a row are cut into portions first, which Spark deals out.
    two = F.array(*[F.struct(n.alias("n"), c.alias("copies")) for n, c in ((more, whole + 1), (F.col("rows") - more, whole))])
    df = units.select("doc_id", "source", "size", "source_size", "target", F.explode(two).alias("x")).filter("x.n > 0")

    def spread(df: DataFrame) -> DataFrame:
        return df.select("doc_id", "source", "size", "source_size", "target", "x.copies", F.explode(F.sequence(F.lit(1), F.col("x.n").cast("int"))).alias("_i"))

    few = F.col("x.n") <= params.twin_rows
    portions = F.transform(
        F.sequence(F.lit(0), F.floor((F.col("x.n") - 1) / params.twin_rows)),
        lambda i: F.struct(F.least(F.lit(params.twin_rows), F.col("x.n") - i * params.twin_rows).alias("n"), F.col("x.copies").alias("copies")),
    )
    many = df.filter(~few).select("doc_id", "source", "size", "source_size", "target", F.posexplode(portions).alias("pos", "x")).repartition("doc_id", "source", "pos")
    df = spread(df.filter(few)).unionByName(spread(many))
    return df.select("doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """docs with each row as often as the mix takes it. Texts are shuffled once, by their unit; repeated rows, which are
    few as a rule, are numbered apart, in portions of about twin_rows of one unit."""
    df, (doc_id, source, text) = sealed(docs, "doc_id", "source", "text")
    own = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    units = mix_units(own, params).filter("total > 0").select(_key(F.col("doc_id"), F.col("source"), F.col("digest")).alias("unit"), "rows", "total")
    units = staged(units, "mix-taken")
    key = _key(F.col(doc_id), F.col(source), F.xxhash64(text))
    joined = df.withColumn("key", key).join(units.filter("rows = 1"), F.col("key") == F.col("unit")).withColumn("copies", F.col("total"))
    twins = units.filter("rows > 1")
    if not twins.isEmpty():
        both = df.withColumn("key", key).join(twins, F.col("key") == F.col("unit"))
        # Numbers of repeats don't follow from their contents, so they are written down before they are used.
        both = staged(both.withColumn("portion", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col("rows") / params.twin_rows))), "mix-twins")
        sizes = both.groupBy("unit", "portion").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("unit").orderBy("portion"))
        sizes = sizes.select(F.col("unit").alias("_u"), F.col("portion").alias("_p"), "n", upto.alias("upto"))
        both = both.join(sizes, (F.col("unit") == F.col("_u")) & (F.col("portion") == F.col("_p")))
        place = F.row_number().over(Window.partitionBy("unit", "portion").orderBy(F.lit(0)))
        more = F.col("total") % F.col("rows")
        # Portion by portion, in proportion to its rows: the shares add up to `more`.
        share = F.floor(F.col("upto") * more / F.col("rows")) - F.floor((F.col("upto") - F.col("n")) * more / F.col("rows"))
        both = both.withColumn("copies", F.floor(F.col("total") / F.col("rows")) + F.when(place <= share, 1).otherwise(0))
        joined = joined.unionByName(both.select(joined.columns))
    rows = joined.select(*df.columns, F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*df.columns).toDF(*docs.columns)


def _key(doc_id, source, digest):
    """A string that tells units apart, nulls included."""
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.lit("+"), c.cast("string"))) for c in (doc_id, digest, source)]
    return F.concat_ws(":", *parts)

"""Walks over edge tables: breadth first, only the newest rows joined, lineage cut with reliable checkpoints."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a local session (a test) gets a folder of its own; on a cluster it is an
    error, as executors would write where nobody else can read."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not given and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return (given or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def reach(start: DataFrame, edges: DataFrame) -> DataFrame:
    """id and depth of all that start(id) reaches over edges(src, dst), start included; one row for each id, however many
    starts reach it."""
    edges = cut(edges.select("src", "dst"))  # else every round would derive them again
    seen = cut(start.select("id").distinct().withColumn("depth", F.lit(0)))
    fresh, depth = seen, 0
    while not fresh.isEmpty():
        depth += 1
        step = fresh.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        fresh = cut(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(fresh)
        if depth % 10 == 0:
            seen = cut(seen)
    return seen


def closure(start: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """root, id and depth of everything reachable from start(id) over edges(src, dst), start included. Rounds drop what is
    known, so cycles end. More than limit rows of one root is an error, raised in the round that brings them, as a closure
    that is cut short would leak."""
    edges = cut(edges.select("src", "dst"))
    seen = cut(start.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct())
    fresh, depth = seen, 0
    while not fresh.isEmpty():
        depth += 1
        step = fresh.join(edges, F.col("id") == F.col("src")).select("root", F.col("dst").alias("id")).distinct()
        fresh = cut(step.join(seen, ["root", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(fresh)
        if depth % 10 == 0:
            seen = cut(seen)
        if limit is not None and not seen.groupBy("root").count().filter(F.col("count") > limit).isEmpty():
            raise ValueError(f"a closure has more than {limit} rows")
    return seen


#: Roots that are numbered by one task.
NUMBERED = 1 << 16
#: Nodes whose reach is found once for all roots that lead to them; ids and roots of a block.
PIVOTS, IN_BLOCK = 16, 2048


def _packed(roots: DataFrame, by: list[str]) -> DataFrame:
    """roots(root and by) with pack and bit: 64 roots of equal by are the bits of one pack."""
    parts = max(-(-roots.count() // NUMBERED), 1)
    n = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("root")) - 1
    roots = roots.withColumn("_part", F.pmod(F.xxhash64("root"), F.lit(parts))).withColumn("_n", n)
    return cut(roots.select("root", *by, (F.col("_part") + F.floor(F.col("_n") / 64) * parts).alias("pack"), (F.col("_n") % 64).alias("bit")))


ONE = "shiftleft(1L, bit)"


def _walk(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """keys, bits and depth of all that start(keys, bits) leads to by step, which turns such rows into the next ones. Rounds
    follow only bits that are new to their keys."""
    fresh = seen = cut(start.select(*keys, "bits", F.lit(0).alias("depth")))
    depth = 0
    while not fresh.isEmpty():
        depth += 1
        known = seen.groupBy(*keys).agg(F.bit_or("bits").alias("_known"))
        new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_known", F.lit(0).cast("long"))))
        rows = step(fresh).groupBy(*keys).agg(F.bit_or("bits").alias("bits")).join(known, keys, "left")
        fresh = cut(rows.select(*keys, new.alias("bits"), F.lit(depth).alias("depth")).filter("bits <> 0"))
        seen = seen.unionByName(fresh)
        if depth % 10 == 0:
            seen = cut(seen)
    return seen


def _unpacked(seen: DataFrame, roots: DataFrame, by: list[str]) -> DataFrame:
    """seen with a row for each root of its bits."""
    packs = roots.groupBy(*by).agg(F.collect_list(F.struct("bit", "root")).alias("_roots"))
    own = F.filter("_roots", lambda r: F.getbit("bits", r["bit"]) == 1)
    return seen.join(packs, by).select(F.explode(F.transform(own, lambda r: r["root"])).alias("root"), "id", "depth")


def closure_of_many(start: DataFrame, edges: DataFrame) -> DataFrame:
    """closure() for many roots that reach much the same: up to 64 roots travel as the bits of one long, so rounds join and
    shuffle a row for each node and pack of roots, not for each node and root. Only the last step has a row for each pair,
    and shuffles none of them."""
    edges = cut(edges.select("src", "dst"))
    roots = _packed(start.select(F.col("id").alias("root")).distinct(), [])
    step = lambda fresh: fresh.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), "pack", "bits")
    seen = _walk(roots.select(F.col("root").alias("id"), "pack", F.expr(ONE).alias("bits")), step, ["id", "pack"])
    return _unpacked(seen, roots, ["pack"])


def closure_by_pivots(start: DataFrame, edges: DataFrame) -> DataFrame:
    """root and id of closure(), without depths, where roots reach so much the same that packs of them are still too many
    rows; a null is no node. What each of PIVOTS nodes reaches is found once, and which roots lead to it. A root's own walk
    ends where it comes to the reach of one of its pivots, as all beyond is in that, too. Rows between grow with the nodes
    and what roots reach of their own; blocks of ids and of roots that lead there are put together last, and no pair is
    shuffled. Any pivots give the same rows; those with many edges both ways leave the least to walk."""
    zero = F.lit(0).cast("long")
    edges = cut(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    ends = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_o")).join(edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("_i")), "id")
    pivots = ends.orderBy(F.desc(F.least("_o", "_i")), "id").limit(PIVOTS).withColumn("bit", F.row_number().over(Window.orderBy("id")) - 1)
    # Side 0 holds what pivots reach, side 1 what reaches them.
    both = cut(edges.select("src", "dst", F.lit(0).alias("side")).union(edges.select("dst", "src", F.lit(1))))
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    step = lambda fresh: fresh.withColumnRenamed("id", "src").join(both, ["src", "side"]).select(F.col("dst").alias("id"), "side", "bits")
    masks = cut(_walk(pivots.select("id", sides, F.expr(ONE).alias("bits")), step, ["id", "side"]).groupBy("id", "side").agg(F.bit_or("bits").alias("bits")))
    within = masks.filter("side = 0").select("id", F.col("bits").alias("of"))
    leads = masks.filter("side = 1").select(F.col("id").alias("root"), F.col("bits").alias("to"))
    roots = start.select(F.col("id").alias("root")).filter("root is not null").distinct()
    roots = _packed(roots.join(leads, "root", "left").select("root", F.coalesce("to", zero).alias("to")), ["to"])

    def outside(rows: DataFrame, c: str) -> DataFrame:
        return rows.filter(F.col("of").bitwiseAND(F.col(c)) == 0)

    onward = cut(edges.join(within.withColumnRenamed("id", "dst"), "dst", "left").select("src", "dst", F.coalesce("of", zero).alias("of")))
    first = outside(roots.join(within.withColumnRenamed("id", "root"), "root", "left").withColumn("of", F.coalesce("of", zero)), "to")
    step = lambda fresh: outside(fresh.join(onward, F.col("id") == F.col("src")), "to").select(F.col("dst").alias("id"), "to", "pack", "bits")
    own = _walk(first.select(F.col("root").alias("id"), "to", "pack", F.expr(ONE).alias("bits")), step, ["id", "to", "pack"])

    def blocks(rows: DataFrame, key: str, by: str, into: str) -> DataFrame:
        n = max(-(-rows.count() // IN_BLOCK), 1)
        return rows.groupBy(by, F.pmod(F.xxhash64(key), F.lit(n)).alias("_n")).agg(F.sort_array(F.collect_list(key)).alias(into))

    ids, led = blocks(within, "id", "of", "_ids"), blocks(roots.filter("to <> 0"), "root", "to", "_roots")
    # There are 2^PIVOTS masks of either kind at most, and a few as a rule.
    links = within.select("of").distinct().join(F.broadcast(led.select("to").distinct()), F.col("of").bitwiseAND(F.col("to")) != 0)
    squares = cut(ids.join(links, "of").join(led.drop("_n"), "to").select("_ids", "_roots"))
    # A full square is work for a task; the number given keeps tasks apart, as squares are a few bytes for what they become.
    pairs = squares.agg(F.sum(F.size("_ids").cast("long") * F.size("_roots"))).first()[0] or 0
    squares = squares.repartition(pairs // IN_BLOCK**2 + 1)
    shared = squares.select("_roots", F.explode("_ids").alias("id")).select(F.explode("_roots").alias("root"), "id")
    return _unpacked(own, roots, ["to", "pack"]).select("root", "id").union(shared)


def components(edges: DataFrame) -> DataFrame:
    """id and component (smallest id reachable) of every node of edges(a, b), by stars: each round hangs the larger
    neighbours of a node on its smallest one, then the smaller ones, until nothing moves. Minima are summed up before they
    are shuffled, and only edges are joined, so a hub is split like any hot key of a join."""

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def star(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy(F.col("u").alias("of")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return pairs.join(least, F.col("u") == F.col("of"))

    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        large = star(both(e)).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = star(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        small = down.select(F.col("v").alias("a"), F.col("m").alias("b")).union(down.select(F.col("u").alias("a"), F.col("m").alias("b")))
        e = cut(small.filter("a <> b").distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    return e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).union(e.select("b", "b").distinct())

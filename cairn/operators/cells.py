"""Cells of vectors: the nearest of every row, and a stored layout, without looking at what can't be near.

Vectors of a scope are dealt to the nearest of a few of their own (pivots), cells with many rows again by pivots of their
own, until a cell has about `rows` of them. A cell, and each cell of cells above it, has a centre and a radius, from which
follows how large the inner product of a vector with any of its rows can be (the triangle inequality; vectors needn't be
of unit length). Walks go down the tree of cells and leave out what can't reach the k-th best that is known already.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import dot
from .graph import cut

FAN, LEVELS, CHUNK = 64, 8, 4096
#: Similarities are rounded to six places, so bounds get as much room.
ROOM = 2e-6
ROWS = "scope_key string, id long, e array<double>, cell string"
NODES = "cell string, center array<double>, radius double, norm double, n long"


def _rounded(product: np.ndarray) -> np.ndarray:
    return np.sign(product) * np.floor(np.abs(product) * 1e6 + 0.5) / 1e6


def _deal(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    if not len(rows):
        return rows[["scope_key", "id", "e", "cell"]]
    x, p = np.stack(rows["e"]), np.stack(pivots["pivots"].iloc[0])
    far = (p**2).sum(1) - 2 * x @ p.T
    # Pivots at one place share the rows there, so that copies spread.
    tied = far <= far.min(1, keepdims=True) + 1e-9
    order = np.cumsum(tied, 1)
    pick = rows["id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
    at = (order > (pick % tied.sum(1).astype(np.uint64)).astype(np.int64)[:, None]).argmax(1)
    return rows[["scope_key", "id", "e", "cell"]].assign(cell=rows["cell"] + "/" + pd.Series(at, rows.index).map("{:02d}".format))


def celled(vectors: DataFrame, rows: int = 1024) -> DataFrame:
    """scope_key, id, e and cell (a path below the scope) of vectors(id, scope_key, embedding); cells have up to `rows`
    rows, or a few more. Each level deals the rows of full cells in chunks, each beside the cell's pivots."""
    df = vectors.filter("scope_key is not null").select("scope_key", F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e"), F.hex("scope_key").alias("cell"))
    df = cut(df)
    for _ in range(LEVELS):
        full = cut(df.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > rows))
        if full.isEmpty():
            return df
        inner = df.join(full, "cell")
        w = Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id")
        wanted = F.least(F.lit(FAN), F.ceil(2 * F.col("n") / rows))
        pivots = inner.withColumn("_r", F.row_number().over(w)).filter((F.col("_r") <= FAN) & (F.col("_r") <= wanted)).groupBy("cell", "n").agg(F.collect_list("e").alias("pivots"))
        chunks = F.ceil(F.col("n") / CHUNK).cast("int")
        pivots = pivots.select(F.col("cell").alias("of"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "pivots")
        inner = inner.withColumn("chunk", F.pmod(F.xxhash64("id"), chunks).cast("int"))
        dealt = inner.groupBy("cell", "chunk").cogroup(pivots.groupBy("of", "chunk")).applyInPandas(_deal, ROWS)
        df = cut(df.join(full, "cell", "left_anti").select(*dealt.columns).union(dealt))
    # What pivots can't part (many equal vectors) is cut by chance.
    n = df.groupBy("cell").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / rows)).cast("string")
    return cut(df.join(n, "cell").select("scope_key", "id", "e", F.when(F.col("n") > rows, F.concat("cell", F.lit("/"), part)).otherwise(F.col("cell")).alias("cell")))


def _leaf(group: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(group["e"])
    c = x.mean(0)
    return pd.DataFrame({"cell": [group["cell"].iloc[0]], "center": [c], "radius": [np.sqrt(((x - c) ** 2).sum(1)).max()], "norm": [np.sqrt((x**2).sum(1)).max()], "n": [len(x)]})


def _parent(group: pd.DataFrame) -> pd.DataFrame:
    x, n = np.stack(group["center"]), group["n"].to_numpy()
    c = (x * n[:, None]).sum(0) / n.sum()
    radius = (np.sqrt(((x - c) ** 2).sum(1)) + group["radius"].to_numpy()).max()
    return pd.DataFrame({"cell": [group["up"].iloc[0]], "center": [c], "radius": [radius], "norm": [group["norm"].max()], "n": [n.sum()]})


def up(cell: str = "cell") -> Column:
    """The cell that a cell lies in; null for a scope's whole."""
    return F.when(F.contains(cell, F.lit("/")), F.regexp_extract(cell, "^(.*)/[^/]*$", 1))


def tree(cells: DataFrame) -> DataFrame:
    """NODES of all cells of celled() and of the cells above them, with leaf (whether it has rows of its own)."""
    done = level = cut(cells.groupBy("cell").applyInPandas(_leaf, NODES).withColumn("leaf", F.lit(True)))
    depth = (level.agg(F.max(F.size(F.split("cell", "/")))).first()[0] or 1) - 1
    for d in range(depth, 0, -1):
        below = done.filter(F.size(F.split("cell", "/")) == d + 1).withColumn("up", up())
        level = cut(below.groupBy("up").applyInPandas(_parent, NODES).withColumn("leaf", F.lit(False)))
        done = done.unionByName(level)
    return done


def most(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The largest inner product of rows of two cells (center, radius, norm); a vector is a cell of radius 0."""
    ab = dot(a["center"], b["center"])
    by_angle = ab + F.sqrt(dot(a["center"], a["center"])) * b["radius"] + F.sqrt(dot(b["center"], b["center"])) * a["radius"] + a["radius"] * b["radius"]
    apart = F.sqrt(F.greatest(dot(a["center"], a["center"]) + dot(b["center"], b["center"]) - 2 * ab, F.lit(0.0)))
    gap = F.greatest(apart - a["radius"] - b["radius"], F.lit(0.0))
    return F.least(by_angle, (a["norm"] * a["norm"] + b["norm"] * b["norm"] - gap * gap) / 2) + ROOM


def _best(a: np.ndarray, b: np.ndarray, similarity: np.ndarray, k: int, least: np.ndarray) -> pd.DataFrame:
    first = np.argsort(-similarity, axis=1, kind="stable")[:, :k]  # b ascends, so ties go to the smaller id
    s = np.take_along_axis(similarity, first, 1)
    keep = (s >= least[:, None]).ravel()
    return pd.DataFrame({"a": np.repeat(a, first.shape[1])[keep], "b": b[first].ravel()[keep], "similarity": s.ravel()[keep]})


def nearest(vectors: DataFrame, k: int, threshold: float, rows: int = 1024) -> tuple[DataFrame, dict[str, int]]:
    """a, b and similarity: of the k nearest in its own scope of every row (itself among them, then removed) those at or
    above threshold; and how many pairs of cells there were, and were looked at.

    Cells first look at themselves, which gives each row a k-th best so far; the least of a cell's is what another cell
    must be able to reach, for either side, to be looked at."""
    spark = vectors.sparkSession
    if vectors.isEmpty():
        return spark.createDataFrame([], "a long, b long, similarity double"), {"pairs": 0, "dealt": 0}
    cells = celled(vectors, rows)

    def own(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        x, ids = np.stack(group["e"]), group["id"].to_numpy()
        return _best(ids, ids, _rounded(x @ x.T), k, np.full(len(ids), -np.inf)).assign(cell=group["cell"].iloc[0])

    inside = cut(cells.groupBy("cell").applyInPandas(own, "a long, b long, similarity double, cell string"))
    known = inside.groupBy("cell", "a").agg(F.greatest(F.lit(threshold), F.when(F.count("*") == k, F.min("similarity")).otherwise(threshold)).alias("least"))
    known = cut(known)
    nodes = tree(cells)
    # What a cell of cells must be offered is the least of what is in it.
    paths = known.groupBy("cell").agg(F.min("least").alias("least"))
    parts = F.split("cell", "/")
    above = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("cell"), "least")
    nodes = cut(nodes.join(above.groupBy("cell").agg(F.min("least").alias("least")), "cell"))

    def side(name: str) -> DataFrame:
        return nodes.select(up().alias(f"up_{name}"), *[F.col(c).alias(f"{c}_{name}") for c in ("cell", "center", "radius", "norm", "leaf", "least")])

    def of(name: str) -> dict[str, Column]:
        return {c: F.col(f"{c}_{name}") for c in ("center", "radius", "norm")}

    near = most(of("x"), of("y")) >= F.least("least_x", "least_y")
    whole = nodes.filter(up().isNull()).select("cell", "leaf")
    pairs, found = cut(whole.select(F.col("cell").alias("x"), F.col("cell").alias("y"), F.col("leaf").alias("lx"), F.col("leaf").alias("ly"))), None
    below = {n: side(n) for n in "xy"}
    while not pairs.isEmpty():
        ready = pairs.filter("lx and ly")
        found = ready if found is None else found.union(ready)
        open_ = pairs.filter("not (lx and ly)")
        # A cell with rows of its own stays, one of cells gives way to what is in it.
        for n in "xy":
            stay = open_.filter(f"l{n}").join(below[n].withColumnRenamed(f"cell_{n}", "_c").drop(f"up_{n}"), F.col(n) == F.col("_c"))
            down = open_.filter(f"not l{n}").join(below[n].withColumnRenamed(f"cell_{n}", "_c").withColumnRenamed(f"up_{n}", "_u"), F.col(n) == F.col("_u")).drop("_u")
            open_ = stay.unionByName(down).drop(n, f"l{n}").withColumnsRenamed({"_c": n, f"leaf_{n}": f"l{n}"})
        pairs = cut(open_.filter((F.col("x") <= F.col("y")) & near).select("x", "y", "lx", "ly"))
    found = cut(found.filter("x <> y").select("x", "y"))
    asked = known.select(F.col("a").alias("id"), "least")
    told = cells.join(asked, "id")
    both = [told.join(found, F.col("cell") == F.col(n)).select("x", "y", F.lit(n).alias("side"), "id", "e", "least") for n in "xy"]

    def between(group: pd.DataFrame) -> pd.DataFrame:
        x, y = (group[group["side"] == n].sort_values("id") for n in "xy")
        s = _rounded(np.stack(x["e"]) @ np.stack(y["e"]).T)
        a, b = x["id"].to_numpy(), y["id"].to_numpy()
        return pd.concat([_best(a, b, s, k, x["least"].to_numpy()), _best(b, a, s.T, k, y["least"].to_numpy())])

    other = both[0].union(both[1]).groupBy("x", "y").applyInPandas(between, "a long, b long, similarity double")
    w = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    every = inside.drop("cell").union(other).withColumn("_r", F.row_number().over(w))
    out = every.filter((F.col("_r") <= k) & (F.col("a") != F.col("b")) & (F.col("similarity") >= threshold)).drop("_r")
    scope = nodes.filter("leaf").groupBy(F.split("cell", "/")[0]).agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * (F.col("c") + 1) / 2)).first()[0]
    leaves = nodes.filter("leaf").count()
    return out, {"pairs": int(scope), "dealt": found.count() + leaves}


@dataclass(frozen=True)
class VectorStore:
    """Vectors in a folder: `vectors`, partitioned by scope and first-level cell, and `nodes`, the cells with their bounds."""

    spark: SparkSession
    folder: str

    def write(self, vectors: DataFrame, rows: int = 1024) -> None:
        cells = celled(vectors, rows)
        coarse = F.coalesce(F.try_element_at(F.split("cell", "/"), F.lit(2)), F.lit("all"))
        cells = cells.withColumns({"scope": F.hex("scope_key"), "coarse": coarse})
        cells.repartition("scope", "coarse").sortWithinPartitions("scope", "coarse", "cell", "id").write.mode("overwrite").partitionBy("scope", "coarse").parquet(f"{self.folder}/vectors")
        tree(cells).filter("leaf").withColumn("coarse", coarse).write.mode("overwrite").parquet(f"{self.folder}/nodes")

    def search(self, queries: DataFrame, k: int, minimum: float = -1.0, relative: float = 0.0, allowed: DataFrame | None = None, scopes: list[str] | None = None, probe: int = 4) -> DataFrame:
        """query_id, id, similarity and rank, as search.neighbours() gives them over the vectors of the scopes (all of them
        where none are named) whose ids are allowed. A query looks at the `probe` cells that promise most, then at those
        that may reach its k-th best; the ids that are allowed are applied before that is known, not after."""
        nodes = self.spark.read.parquet(f"{self.folder}/nodes")
        if scopes is not None:
            nodes = nodes.filter(F.split("cell", "/")[0].isin([s.encode().hex().upper() for s in scopes]))
        q = F.col("q")
        asked = cut(queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")))
        own = {"center": q, "radius": F.lit(0.0), "norm": F.sqrt(dot(q, q))}
        cell = {c: F.col(c) for c in ("center", "radius", "norm")}
        # A row for each query and cell: queries are a stated set, cells a thousandth of the vectors.
        bounds = nodes.join(F.broadcast(asked)).select("query_id", "cell", "coarse", F.split("cell", "/")[0].alias("scope"), most(own, cell).alias("most"))
        bounds = cut(bounds.filter(F.col("most") >= minimum))
        w = Window.partitionBy("query_id").orderBy(F.desc("most"), "cell")
        first = cut(bounds.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= probe).drop("_r"))
        best = cut(self._ranked(self._scored(first, asked, allowed), k))
        least = best.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("similarity")).alias("least"))
        rest = bounds.join(first.select("query_id", "cell"), ["query_id", "cell"], "left_anti").join(least, "query_id", "left")
        rest = cut(rest.filter(F.col("least").isNull() | (F.col("most") >= F.col("least"))).drop("least"))
        out = self._ranked(best.drop("rank").union(self._scored(rest, asked, allowed)), k)
        top = F.max("similarity").over(Window.partitionBy("query_id"))
        floor = F.greatest(F.lit(minimum), F.col("_top") * relative) if relative else F.lit(minimum)
        return out.withColumn("_top", top).filter(F.col("similarity") >= floor).drop("_top")

    def read(self, cells: DataFrame) -> DataFrame:
        """The vectors of cells(scope, coarse, cell), from their partitions alone."""
        parts = cells.select("scope", "coarse").distinct().collect()  # FAN a scope at most
        rows = self.spark.read.schema(ROWS + ", scope string, coarse string").parquet(f"{self.folder}/vectors")
        return rows.filter(F.col("scope").isin(sorted({p.scope for p in parts})) & F.col("coarse").isin(sorted({p.coarse for p in parts})))

    def _scored(self, cells: DataFrame, asked: DataFrame, allowed: DataFrame | None) -> DataFrame:
        rows = self.read(cells).join(cells.select("query_id", "cell"), "cell")
        if allowed is not None:
            rows = rows.join(allowed.select("id"), "id", "left_semi")
        return rows.join(F.broadcast(asked), "query_id").select("query_id", "id", F.round(dot(F.col("q"), F.col("e")), 6).alias("similarity"))

    @staticmethod
    def _ranked(rows: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

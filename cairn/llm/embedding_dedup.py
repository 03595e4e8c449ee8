"""Near-duplicates among embeddings with an inverted multi-index.

Each half of a unit vector has its own codebook, fitted on a bounded sample; the product of the two makes a grid of
cells. The multi-sequence walk visits a vector's cells from the nearest on, as many as reach the target recall on
perturbed sample vectors, and a vector is compared with all vectors that live in the cells it visits. Links are verified
by cosine in double precision. Equal vectors are one class first, so any number of copies costs one comparison; a class
has a number of its own, so nothing rests on vec_id. A cell is cut into blocks of bounded size, and every pair of blocks
is one task; a task reports sums of links and a spanning forest, never its pairs.

Only vectors of the same non-null label and length are compared. Every length with more than home_rows classes has an
index; classes of the rarer lengths share one cell for each label and length, where all are compared.

Cases: a vector that is null, empty or zero, or holds a null or non-finite component links with nothing and is its own
component; rows that repeat a vec_id are vectors of their own; a null vec_id takes part, counts as larger than any other
and is kept where its component has no other id; an empty table gives an empty one; other columns of the input are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged
from .components import components


@dataclass(frozen=True)
class IndexParams:
    threshold: float = 0.93
    target_recall: float = 0.98
    #: Vectors of a length that the codebooks are fitted on: at least `sample`, and per_codeword for each codeword, of which
    #: a half has max_codewords at most; vectors that the number of visited cells is measured on.
    sample: int = 4096
    per_codeword: int = 8
    max_codewords: int = 4096
    probes: int = 2048
    #: Vectors wanted in a cell, and rows of a block.
    cell_rows: int = 64
    home_rows: int = 1024
    query_rows: int = 4096
    seed: int = 3

    def codewords(self, per_label: float) -> int:
        return int(np.clip(np.sqrt(per_label / self.cell_rows), 1, self.max_codewords))

    def sample_rows(self, per_label: float) -> int:
        return max(self.sample, self.per_codeword * self.codewords(per_label))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class MultiIndex:
    """Codebooks of the two halves, and how many cells a search visits."""

    def __init__(self, x: np.ndarray, per_label: float, params: IndexParams):
        rng = np.random.default_rng(params.seed)
        self.half = x.shape[1] // 2
        k = min(params.codewords(per_label), len(x))
        self.books = [self._fit(x[:, : self.half], k, rng), self._fit(x[:, self.half :], k, rng)]
        # Partners of the sample at every similarity that counts, in random directions.
        x = x[: params.probes]
        cos = rng.uniform(params.threshold, 1.0, (len(x), 1))
        away = rng.standard_normal(x.shape)
        away = _unit(away - (away * x).sum(1, keepdims=True) * x + 1e-12)
        partner = cos * x + np.sqrt(1 - cos**2) * away
        rank = np.minimum(self._rank(x, self.visits(partner, 1)[:, 0]), self._rank(partner, self.visits(x, 1)[:, 0]))
        self.n_visits = int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(params.target_recall * len(rank))) - 1)]) + 1

    @staticmethod
    def _fit(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
        book = x[rng.choice(len(x), k, replace=False)]
        for _ in range(12):
            own = np.concatenate([MultiIndex._distances(x[i : i + 4096], book).argmin(1) for i in range(0, len(x), 4096)])
            n = np.bincount(own, minlength=k)
            sums = np.zeros_like(book)
            np.add.at(sums, own, x)
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
        return book

    @staticmethod
    def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
        return (x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1)[None]

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = x[:, : self.half], x[:, self.half :]
        return self._distances(a, self.books[0]), self._distances(b, self.books[1])

    def _rank(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells the walk from x visits before the given one."""
        out = np.empty(len(x), np.int64)
        for i in range(len(x)):
            a, b = (d[0] for d in self._halves(x[i : i + 1]))
            own = a[cell[i] // len(b)] + b[cell[i] % len(b)]
            out[i] = np.searchsorted(np.sort(b), own - a - 1e-12).sum()
        return out

    def visits(self, x: np.ndarray, n: int | None = None) -> np.ndarray:
        """The n nearest cells of each row, nearest first. The j-th cell of the walk pairs codewords of ranks r and s with
        (r + 1) * (s + 1) <= j + 1, so the n nearest lie among the pairs with a product of n at most."""
        n = min(n or self.n_visits, len(self.books[0]) * len(self.books[1]))
        a, b = self._halves(x)
        oa, ob = a.argsort(1, kind="stable"), b.argsort(1, kind="stable")
        pairs = np.array([(r, s) for r in range(min(n, a.shape[1])) for s in range(min(n // (r + 1), b.shape[1]))])
        ca, cb = oa[:, pairs[:, 0]], ob[:, pairs[:, 1]]
        total = np.take_along_axis(a, ca, 1) + np.take_along_axis(b, cb, 1)
        order = total.argsort(1, kind="stable")[:, :n]
        return np.take_along_axis(ca * b.shape[1] + cb, order, 1)


def _block(threshold: float):
    def link(rows: pd.DataFrame) -> pd.DataFrame:
        home, query = rows[rows["role"] == 0], rows[rows["role"] == 1]
        out = pd.DataFrame({"cid": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        if home.empty or query.empty:
            return out
        x, q = (np.stack([np.frombuffer(v, np.float64) for v in r["unit"]]) for r in (home, query))
        hid, qid = home["cid"].to_numpy(), query["cid"].to_numpy()
        linked = q @ x.T >= threshold
        cell = int(rows["cell"].iloc[0])
        of = query["home"].to_numpy()
        # A pair is counted once: inside a cell by the order of classes, and of two cells that both find it, in the lower one.
        linked[of == cell] &= qid[of == cell][:, None] < hid[None]
        found = np.flatnonzero((of < cell) & linked.any(1))
        if len(found):
            seen = np.stack(home["visits"].to_list())
            for other in np.unique(of[found]):
                linked[np.ix_(found[of[found] == other], (seen == other).any(1))] = False
        n_q, n_x = (linked * home["copies"].to_numpy()[None]).sum(1), (linked * query["copies"].to_numpy()[:, None]).sum(0)
        lq, lx = qid.copy(), hid.copy()
        far = np.iinfo(np.int64).max
        while True:
            nx = np.minimum(lx, np.where(linked, lq[:, None], far).min(0))
            nq = np.minimum(lq, np.where(linked, nx[None], far).min(1))
            if (nx == lx).all() and (nq == lq).all():
                break
            lq, lx = nq, nx
        out = pd.DataFrame({"cid": np.r_[qid, hid], "links": np.r_[n_q, n_x].astype("int64"), "root": np.r_[lq, lx]})
        return out[out["links"] > 0]

    return link


def _place(shared):
    """Unit vectors, the cell that each lives in and the cells that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                dim = part.column("dim").to_numpy()
                flat = part.column("e").flatten().to_numpy()
                start = np.cumsum(dim) - dim
                units, cells = [b""] * len(dim), [[0]] * len(dim)
                for d in np.unique(dim):
                    own = np.flatnonzero(dim == d)
                    x = _unit(flat[start[own][:, None] + np.arange(d)[None]])
                    visits = shared.value[d].visits(x).tolist() if d in shared.value else [[0]] * len(own)
                    for k, u, v in zip(own.tolist(), x, visits):
                        units[k], cells[k] = u.tobytes(), v
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("label", "dim", "cid", "copies")), pa.array(units, pa.binary()), pa.array([c[0] for c in cells], pa.int64()), pa.array(cells, pa.list_(pa.int64()))],
                    names=["label", "dim", "cid", "copies", "unit", "home", "visits"],
                )

    return run


def near_duplicates(vectors: DataFrame, params: IndexParams = IndexParams()) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors(vec_id, embedding, label)."""
    v = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("e", lambda c: c != 0)
    v = v.withColumn("ok", F.coalesce(F.col("label").isNotNull() & (F.size("e") > 0) & fine, F.lit(False)))
    v = v.withColumns({"dim": F.size("e"), "h1": F.xxhash64("e"), "h2": F.xxhash64(F.lit(1), "e")})
    members = staged(v.select("vec_id", "label", "ok", "dim", "h1", "h2"), "vec-members")
    same = ["label", "dim", "h1", "h2"]
    classes = v.filter("ok").groupBy(*same).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("e").alias("e"))
    # Numbered where they are written, so that every later reader sees the same numbers.
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "vec-classes")
    lengths = classes.groupBy("dim").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))
    indexes = {}
    for r in lengths.filter((F.col("n") > params.home_rows) & (F.col("dim") >= 2)).collect():
        picked = classes.filter(F.col("dim") == r.dim).orderBy("h1", "h2").limit(params.sample_rows(r.n / r.labels)).select("e").toArrow()
        x = picked.column("e").combine_chunks().flatten().to_numpy().reshape(-1, r.dim)
        indexes[r.dim] = MultiIndex(_unit(x), r.n / r.labels, params)
    shared = vectors.sparkSession.sparkContext.broadcast(indexes)  # two codebooks of max_codewords rows for each length

    label_type = vectors.schema["label"].dataType.simpleString()
    placed = classes.select("label", "dim", "cid", "copies", "e").mapInArrow(_place(shared), f"label {label_type}, dim int, cid bigint, copies bigint, unit binary, home bigint, visits array<bigint>")
    placed = staged(placed, "vec-placed")
    cell = ["label", "dim", "cell"]
    counts = placed.select("label", "dim", "home", F.explode("visits").alias("cell")).groupBy(*cell).agg(
        F.ceil(F.sum(F.when(F.col("home") == F.col("cell"), 1).otherwise(0)) / params.home_rows).cast("int").alias("home_parts"),
        F.ceil(F.count("*") / params.query_rows).cast("int").alias("query_parts"),
    )
    counts = staged(counts.filter("home_parts > 0"), "vec-cells")
    visited = placed.withColumn("cell", F.explode("visits")).join(counts, cell)

    def blocks(role: int, own: str, other: str) -> DataFrame:
        df = visited.filter(F.col("home") == F.col("cell")) if role == 0 else visited
        df = df.withColumn("_p", F.pmod(F.xxhash64("cid"), F.col(own)).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        names = ("hp", "qp") if role == 0 else ("qp", "hp")
        seen = F.col("visits") if role == 0 else F.array().cast("array<bigint>")
        return df.select(*cell, F.col("_p").alias(names[0]), F.col("_o").alias(names[1]), F.lit(role).alias("role"), "cid", "copies", "unit", "home", seen.alias("visits"))

    rows = blocks(0, "home_parts", "query_parts").unionByName(blocks(1, "query_parts", "home_parts"))
    found = staged(rows.groupBy(*cell, "hp", "qp").applyInPandas(_block(params.threshold), "cid bigint, links bigint, root bigint"), "vec-links")
    release(placed, counts)
    linked = found.groupBy("cid").agg(F.sum("links").alias("links")).withColumnRenamed("cid", "_c")
    roots = components(found.filter("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    about = classes.select(*same, "cid", "least", "copies").join(linked, F.col("cid") == F.col("_c"), "left").join(roots, F.col("cid") == F.col("id"), "left")
    about = staged(about.select(*same, "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "cid").alias("root")), "vec-about")
    release(found, classes)
    first = about.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "_root")
    about = about.join(first, F.col("root") == F.col("_root")).select(*[F.col(c).alias(f"_{c}") for c in same], "links", "component")
    on = F.col("ok")
    for c in same:
        on &= F.col(c) == F.col(f"_{c}")
    df = members.join(staged(about, "vec-about"), on, "left")
    # A component without any id has none; a vector without a class is its own.
    own = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    df = df.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"))
    return df.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: All pairs, for unique ids. The index equals it where a label's vectors fit in one cell, as in small tables; in larger
#: ones it may miss a few links, and its recall is measured instead.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
),
u AS (SELECT vec_id, label, list_transform(e, lambda c: c / sqrt(list_dot_product(e, e))) AS e FROM v),
k AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) >= 0.93),
r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT k.b, r.root FROM r JOIN k ON k.a = r.vec_id)
SELECT x.vec_id, (SELECT count(*) FROM k WHERE k.a = x.vec_id) AS n_links, (SELECT min(root) FROM r WHERE r.vec_id = x.vec_id) AS component_id,
  (SELECT min(root) FROM r WHERE r.vec_id = x.vec_id) = x.vec_id AS kept
FROM embeddings x
"""

"""Cells of vectors against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import cells, search

VECTOR = "id long, scope_key string, embedding array<double>"


def clouds(rng, n, unit=True):
    """Vectors around a few centres, some of them copies, in a large scope and small ones."""
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(7)]
    out = []
    for i in range(n):
        c = rng.choice(centres)
        x = np.array([a + rng.gauss(0, 0.15) for a in c]) if i % 9 else np.array(centres[0])
        out.append((i * 3 - 40, "hot" if i % 5 else f"s{i % 2}", [float(v) for v in (x / np.linalg.norm(x) if unit else x)]))
    return out


def brute(rows, k, threshold):
    want = set()
    for a, scope, x in rows:
        near = sorted((-float(cells._rounded(np.array([np.dot(x, y)]))[0]), b) for b, s, y in rows if s == scope)[:k]
        want |= {(a, b, -s) for s, b in near if b != a and -s >= threshold}
    return want


@pytest.mark.parametrize("unit,threshold", [(True, 0.9), (True, -1.0), (False, 2.0)])
def test_nearest_of_every_row(spark, unit, threshold):
    rows = clouds(random.Random(2), 330, unit)
    v = spark.createDataFrame(rows, VECTOR).repartition(3)
    found, looked = cells.nearest(v, 5, threshold, rows=12)
    assert {(r.a, r.b, r.similarity) for r in found.collect()} == brute(rows, 5, threshold)
    assert looked["dealt"] <= looked["pairs"] and (threshold < 0.5 or not unit or looked["dealt"] < 0.6 * looked["pairs"])


def test_cells_of_equal_vectors_and_of_none(spark):
    rows = [(i, "s", [1.0, 0.0]) for i in range(90)] + [(100, "t", [0.0, 1.0]), (101, None, [0.0, 1.0])]
    v = spark.createDataFrame(rows, VECTOR)
    sizes = [r["count"] for r in cells.celled(v, 8).groupBy("cell").count().collect()]
    assert sum(sizes) == 91 and max(sizes) <= 40
    got = {(r.a, r.b) for r in cells.nearest(v, 3, 0.5, rows=8)[0].collect()}
    assert got == {(a, b) for a in range(90) for b in range(3) if a != b}
    assert cells.nearest(v.limit(0), 3, 0.5)[0].count() == 0


def test_stored_vectors_give_the_neighbours(spark, tmp_path):
    rng = random.Random(7)
    rows = clouds(rng, 400)
    v = spark.createDataFrame(rows, VECTOR)
    store = cells.VectorStore(spark, str(tmp_path))
    store.write(v, rows=16)
    queries = spark.createDataFrame([(q, rows[q * 30][2]) for q in range(6)], "query_id long, embedding array<double>")
    allowed = v.filter("id % 4 <> 0").select("id")
    for some, scopes in ((None, None), (allowed, ["hot"]), (None, ["s0", "s1"])):
        mine = v if scopes is None else v.filter(F.col("scope_key").isin(scopes))
        mine = mine if some is None else mine.join(some, "id", "left_semi")
        want = search.neighbours(queries, mine, 7, 0.2, 0.5)
        got = store.search(queries, 7, 0.2, 0.5, some, scopes)
        assert sorted(map(tuple, got.select("query_id", "rank", "id", "similarity").collect())) == sorted(map(tuple, want.select("query_id", "rank", "id", "similarity").collect()))
    few = spark.read.parquet(f"{tmp_path}/nodes").limit(1).withColumns({"scope": F.split("cell", "/")[0]})
    plan = store.read(few)._jdf.queryExecution().executedPlan().toString()
    assert "scope" in plan.split("PartitionFilters: [")[1].split("]")[0] and "coarse" in plan.split("PartitionFilters: [")[1].split("]")[0]

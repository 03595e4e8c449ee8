"""The stored keyword index against search.bm25() over the same documents."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import search
from cairn.operators.inverted import InvertedIndex

DOC = "id long, revision long, title string, content string, topic_key string"
WORDS = [f"w{i}" for i in range(60)]


def document(rng, i, revision=1):
    text = lambda n: " ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(60)], k=n))
    return (i, revision, text(rng.randint(0, 4)), text(rng.randint(1, 40)) if rng.random() < 0.95 else None, rng.choice([None, "w3/w4", "w5 w6"]))


def best(docs, terms, k, visible=None):
    found = search.bm25(docs, terms)
    found = found if visible is None else found.join(visible, "id", "left_semi")
    return sorted(map(tuple, search.top(found, k).select("query_id", "rank", "id", "score").collect()))


def rows(df):
    return sorted(map(tuple, df.select("query_id", "rank", "id", "score").collect()))


def test_index_equals_bm25_through_updates(spark, tmp_path):
    rng = random.Random(3)
    index = InvertedIndex(spark, f"{tmp_path}/index", buckets=8, block=8, probe=1)
    held = {i: document(rng, i) for i in [*range(-5, 60), 10**12]}
    frame = lambda: spark.createDataFrame(list(held.values()), DOC)
    terms = [(1, "w0"), (1, "w20"), (2, "w40"), (2, "w41"), (3, "none"), (4, "w1.w2"), (4, "w30"), (5, "w5.w6"), (6, "..")]
    terms = spark.createDataFrame(terms, "query_id long, term string")
    assert index.update(frame()) == 0
    assert rows(index.search(terms, 5)) == best(frame(), terms, 5)
    for i in rng.sample(sorted(held), 12):
        held[i] = document(rng, i, 2)
    gone = rng.sample(sorted(held), 6)
    for i in gone:
        del held[i]
    held |= {i: document(rng, i) for i in range(70, 80)}
    assert index.update(frame(), spark.createDataFrame([(i,) for i in gone], "id long")) == 1
    written = {r.id for r in spark.read.parquet(f"{tmp_path}/index/forward").filter("seg = 1").select("id").collect()}
    assert len(written) <= 22 and written >= set(range(70, 80)) - set(gone)
    visible = frame().filter("id % 3 <> 1").select("id")
    for k in (1, 4, 1000):
        assert rows(index.search(terms, k, visible)) == best(frame(), terms, k, visible)
    assert index.update(frame()) == 2 and spark.read.parquet(f"{tmp_path}/index/forward").filter("seg = 2").count() == 0
    small = index.compacted(f"{tmp_path}/small")
    assert rows(small.search(terms, 5)) == best(frame(), terms, 5) and small.table("postings").agg(F.count("*")).first()[0] < index.table("postings").count()


def test_index_reads_only_its_terms_and_leaves_blocks_out(spark, tmp_path):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, 1, "", " ".join(["common" if i % 3 == 0 else "other"] * (1 + 8 * (i < 40)) + [f"x{rng.randint(0, 500)}"] * 3), None) for i in range(1200)], DOC)
    index = InvertedIndex(spark, f"{tmp_path}/index", block=16)
    index.update(docs)
    terms = spark.createDataFrame([(1, "common")], "query_id long, term string")
    assert rows(index.search(terms, 10)) == best(docs, terms, 10)
    assert index.share_scored(terms, 10) < 0.2
    plan = index._postings(["common"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "term" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_half_written_segment_is_not_seen(spark, tmp_path):
    rng = random.Random(5)
    docs = spark.createDataFrame([document(rng, i) for i in range(30)], DOC)
    index = InvertedIndex(spark, f"{tmp_path}/index", block=8)
    index.update(docs.filter("id < 20"))
    index._write(docs.filter("id >= 20").select("id", "revision", F.lit(1).alias("size"), F.array(F.lit("w0")).alias("terms")), "forward", 1)
    terms = spark.createDataFrame([(1, "w0"), (1, "w7")], "query_id long, term string")
    assert rows(index.search(terms, 8)) == best(docs.filter("id < 20"), terms, 8)
    assert index.update(docs) == 1 and rows(index.search(terms, 8)) == best(docs, terms, 8)


@pytest.mark.parametrize("docs", [[], [(1, 1, None, None, None)]])
def test_index_of_nothing(spark, tmp_path, docs):
    index = InvertedIndex(spark, f"{tmp_path}/index")
    index.update(spark.createDataFrame(docs, DOC))
    terms = spark.createDataFrame([(1, "w0"), (2, "a.b")], "query_id long, term string")
    assert rows(index.search(terms, 3)) == []


def test_an_update_checkpoints_no_texts(spark, tmp_path, monkeypatch):
    from cairn.operators import inverted

    cuts = []
    monkeypatch.setattr(inverted, "cut", lambda df: cuts.append(df.columns) or df.localCheckpoint())
    rng = random.Random(6)
    docs = spark.createDataFrame([document(rng, i) for i in range(30)], DOC)
    index = InvertedIndex(spark, f"{tmp_path}/index", block=8)
    index.update(docs)
    assert cuts == [] and not inverted.exists(spark, f"{tmp_path}/index/staged")


def test_an_update_shuffles_no_texts_that_lie_by_id(spark, tmp_path, monkeypatch):
    plans, write = {}, InvertedIndex._write

    def seen(self, df, name, seg, by=None):
        plans[name, seg] = df._jdf.queryExecution().executedPlan().toString()
        write(self, df, name, seg, by)

    monkeypatch.setattr(InvertedIndex, "_write", seen)
    rng = random.Random(7)
    docs = spark.createDataFrame([document(rng, i) for i in range(48)], DOC)
    terms = spark.createDataFrame([(1, "w0"), (1, "w7"), (2, "w5.w6")], "query_id long, term string")
    for name, given, dealt in (("near", docs.coalesce(1), False), ("far", docs.repartition(4, "title"), True)):
        index = InvertedIndex(spark, f"{tmp_path}/{name}", buckets=4, block=8)
        index.update(given.filter("id < 30"))
        index.update(given, spark.createDataFrame([(4,)], "id long"))
        for seg in (0, 1):
            assert ("hashpartitioning(block" in plans["staged", seg]) == dealt
            assert "partitioning(" not in plans["postings", seg] and (dealt or "hashpartitioning(" not in plans["staged", seg])
        assert rows(index.search(terms, 8)) == best(docs.filter("id <> 4"), terms, 8)

"""The calls of the engine over the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from cairn.engine import Engine
from cairn.operators import erasure
from cairn.operators.access import Access
from cairn.sources import rewrite
from cairn.sources.tables import write_snapshot

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def engine(spark):
    return Engine.over(spark, FOLDER)


def test_search_and_get(engine):
    agent = Access(False, "p3")
    may = {r.id for r in engine.current(agent).collect()}
    assert {r.id for r in engine.memory_get(agent, [*list(may)[:3], 10**6]).collect()} == set(list(may)[:3])
    title = engine.current(agent).first()["title"]
    found = engine.memory_search(agent, " ".join(title.split()[:4]), limit=5).collect()
    assert found and {r.id for r in found} <= may and [r.rank for r in found] == list(range(1, len(found) + 1))
    assert engine.memory_search(agent, "#1000000").count() == 0 and engine.memory_search(agent, "x", limit=0).count() == 0


def test_context(engine):
    r = engine.memory_context(Access(False, "p3"), engine.current(Access(False, "p3")).first()["title"]).first()
    assert r.context_text.startswith("<memories>") and r["keys"] and r.chars <= 6000 - 1024 and r.bytes <= 18000 - 4096
    project = engine.sessions.filter("project_key is not null").first()["project_key"]
    mine = {f"session:{s.id}" for s in engine.sessions.filter(F.col("project_key") == project).collect()}
    found = {k for k in engine.memory_context(Access(False, project)).first()["keys"] if k.startswith("session:")}
    assert found and found <= mine and len(found) <= engine.policy.recent_sessions
    only = engine.memory_context(Access(False, project), kinds=["fact"]).first()
    assert only is None or not [k for k in only["keys"] if k.startswith("session:")]
    with pytest.raises(PermissionError):
        engine.memory_context(Access(False, "p3"), profile="evidence")


def test_forget(engine, spark):
    shown = engine.audit.filter("kind = 'get'").select(F.col("k").alias("memory_id"), "nonce")
    left, stones = engine.forget(spark.createDataFrame([(41,)], "id long"), shown)
    gone = {int(r.identifier) for r in stones.filter("kind = 'memory'").collect()}
    assert 41 in gone and len(gone) > 1
    assert not gone & {r.id for r in left["memories"].collect()} and not gone & {r.memory_id for r in left["citations"].collect()}
    assert left["catalog"].count() == engine.catalog.count()
    left, stones = engine.forget_source("artifact:a30", shown)
    assert left["artifacts"].filter("source_ref = 'artifact:a30'").count() == 0 and stones.filter("identifier = 'artifact:a30'").count() == 1
    assert left["citations"].filter("source_ref = 'artifact:a30'").count() == 0
    with pytest.raises(ValueError):
        erasure.plan(spark.createDataFrame([(41,)], "id long"), engine.relations, engine.citations, erasure.exposure_edges(shown, engine.links), most=1)


def test_forget_leaves_no_copy_on_disk(engine, spark, tmp_path):
    shown = engine.audit.filter("kind = 'get'").select(F.col("k").alias("memory_id"), "nonce")
    tables = {"memories": engine.memories, "revisions": engine.revisions}
    folders = {}
    for name, df in tables.items():
        folders[name] = [f"{tmp_path}/{name}", f"{tmp_path}/backup-{name}"]
        key = "id" if name == "memories" else "memory_id"
        for version in (1, 2):
            write_snapshot(df.repartitionByRange(6, key), folders[name][0], version)
        write_snapshot(df.withColumn("part", F.format_string("%02d", F.col(key) % 3)).repartition(2), folders[name][1], 1, ["part"])
    files = lambda: {p: p.read_bytes() for p in tmp_path.rglob("*.parquet")}
    before = files()
    text = engine.memories.filter("id = 41").first()["content"]
    report, stones = engine.forget_on_disk(spark.createDataFrame([(41,)], "id long"), shown, folders)
    gone = {int(r.identifier) for r in stones.filter("kind = 'memory'").collect()}
    after = files()
    assert 41 in gone and sum(r["rows"] for r in report) >= 6 and sum(r["files"] for r in report) == len(set(before) - set(after))
    kept = set(before) & set(after)
    assert kept and all(before[p] == after[p] for p in kept)
    for name, paths in folders.items():
        key = "id" if name == "memories" else "memory_id"
        for path in (f"{paths[0]}/version=1", f"{paths[0]}/version=2", f"{paths[1]}/version=1"):
            left = spark.read.parquet(path)
            assert left.filter(F.col(key).isin(list(gone))).isEmpty() and left.count() == tables[name].filter(~F.col(key).isin(list(gone))).count()
            assert left.filter(F.col("content") == text).isEmpty()
        spread = spark.read.schema("part string").parquet(f"{paths[1]}/version=1").groupBy("part").count().collect()
        assert {r.part for r in spread} == {"00", "01", "02"}
    assert not [p for p in tmp_path.rglob("_erasing*")]
    again, _ = engine.forget_on_disk(spark.createDataFrame([(41,)], "id long"), shown, folders)
    assert sum(r["files"] for r in again) == 0 and files() == after


def test_a_broken_off_erasure_is_ended_by_the_next(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(40).repartitionByRange(4, "id").write.parquet(path)
    gone = spark.createDataFrame([("3",), ("39",)], "name string")
    folder = rewrite.Folder(spark, path)
    finish, rewrite._finish = rewrite._finish, lambda *_: None
    try:
        with pytest.raises(RuntimeError):
            rewrite.erase_rows(spark, path, gone, "id")
    finally:
        rewrite._finish = finish
    assert folder.read(rewrite.JOURNAL) and spark.read.parquet(path).count() == 40
    assert rewrite.erase_rows(spark, path, gone, "id")["files"] == 0
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [i for i in range(40) if i not in (3, 39)]
    every = spark.range(40).select(F.col("id").cast("string").alias("name"))
    assert rewrite.erase_rows(spark, path, every, "id")["rows"] == 38
    assert rewrite.erase_rows(spark, path, every, "id")["rows"] == 0


def test_status_and_upkeep(engine, spark):
    s = engine.status().first()
    assert s.memories > 0 and s.indexes_ready == 1
    none = spark.createDataFrame([], "a long, b long")
    assert set(engine.upkeep(none, threshold=0.3).columns) >= {"low", "high", "conflict"}

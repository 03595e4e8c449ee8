import collections
import dataclasses
import datetime as dt
import json
import math
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.engine import Engine
from cairn.functions import text as tx
from cairn.operators import access, context, erasure, graph, indexes, lineage, links, mutations, policy, review, search, sessions, upkeep, usage
from cairn.operators.access import Access, current
from cairn.sources import embedder, tables
from cairn.sources.tables import first_wins, longest_prefix, read_snapshot, upsert, write_snapshot


def test_validity_is_half_open(spark):
    t = dt.datetime(2024, 5, 1)
    rows = spark.createDataFrame([("active", t, None), ("active", None, t), ("archived", None, None)], "state string, valid_from timestamp, valid_until timestamp")
    assert [r.ok for r in rows.select(current(F.lit(t)).alias("ok")).collect()] == [True, False, False]


def test_access_matrix(spark):
    rows = spark.createDataFrame([("global", None), ("project", "p"), ("project", "q")], "scope string, project_key string")
    seen = lambda a, s="all": [r.x for r in rows.select(a.namespace(s).alias("x")).collect()]
    assert seen(Access(False, "p")) == [True, True, False]
    assert seen(Access(False, None)) == [True, False, False]
    assert seen(Access(True)) == [True, True, True]
    assert seen(Access(True, "p"), "project") == [False, True, False]
    allowed = rows.select(Access(False, "p").allows("admin", F.col("scope"), F.col("project_key")).alias("x")).collect()
    assert not any(r.x for r in allowed)


def test_exact_id_does_not_fall_through(spark):
    m = spark.createDataFrame([(1, "7", None, False)], "id long, title string, topic_key string, pinned boolean")
    assert search.exact_candidates(m, "#7").count() == 0 and search.exact_candidates(m, "#1").count() == 1


def test_bm25_prefers_titles(spark):
    m = spark.createDataFrame([(1, "cache", "x y", None), (2, "z", "cache y", None), (3, "q", "w", None), (4, "r", "v", None)], "id long, title string, content string, topic_key string")
    terms = spark.createDataFrame([(1, "cache")], "query_id long, term string")
    assert [r.id for r in search.top(search.bm25(m, terms), 5).orderBy("rank").collect()] == [1, 2]


def test_percentiles(spark):
    s = spark.range(1, 301).select(F.lit("a").alias("stage"), F.col("id").alias("seq"), F.col("id").alias("duration_ms"))
    r = usage.latency(s).first()
    assert (r.n, r.p50, r.p95) == (256, 172, 288)


def test_usage_takes_newest_known(spark):
    rows = [("p", "a", "s", "x", 1, 10, 1.0, "USD"), ("p", "a", "s", "x", 3, None, None, "EUR"), ("p", "a", "s", "x", 2, 20, None, None)]
    u = spark.createDataFrame(rows, "producer_id string, attempt_id string, stage string, provenance string, source_sequence long, input_tokens long, cost_amount double, currency string")
    r = usage.observations(u.withColumn("output_tokens", F.lit(None).cast("long"))).first()
    assert (r.input_tokens, r.output_tokens, r.cost_amount, r.currency) == (20, None, 1.0, "USD")


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "id long")
    assert sorted(r.id for r in lineage.closure(start, e).collect()) == [1, 2, 3, 4]
    try:
        lineage.closure(start, e, limit=3)
        raise AssertionError("no error")
    except ValueError:
        pass


def test_as_of(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, 1, "a", "active", None, None, t(1)), (1, 2, "b", "archived", None, None, t(5)), (2, 1, "c", "active", t(3), None, t(1))]
    r = spark.createDataFrame(rows, "memory_id long, revision long, content string, state string, valid_from timestamp, valid_until timestamp, changed_at timestamp")
    at = lambda d: sorted((x.memory_id, x.content) for x in lineage.as_of(r, F.lit(t(d))).collect())
    assert at(2) == [(1, "a")] and at(3) == [(1, "a"), (2, "c")] and at(5) == [(2, "c")]


def receipts(spark, log):
    """Receipts by seq of (principal, request, operation, memory, expected, change[, agent[, project[, evidence]]])."""
    rows = [(1, k, p, q, op, i, e, None if c is None else json.dumps(c), *rest, *(False, None, None)[len(rest) :]) for k, (p, q, op, i, e, c, *rest) in enumerate(log, 1)]
    names = "family long, seq long, principal_id string, request_id string, operation string, memory_id long, expected_revision long, change string, agent boolean, project string, evidence array<string>"
    return {r.seq: r for r in mutations.fold(spark.createDataFrame(rows, names)).collect()}


def random_log(rng, n):
    """Requests over many families that share request ids, texts, topics, sources and targets."""
    log = []
    for k in range(1, n + 1):
        i, other = rng.randint(1, 24), rng.randint(1, 24)
        op = rng.choice("create create create propose update update archive restore promote merge undo_merge supersede reject forget".split() if k > 30 else ["create"])
        change = None
        if op in ("create", "propose", "update"):
            change = {"title": rng.choice("ab"), "content": f" text {rng.randint(0, 25)}\n"}
            change |= rng.choice([{}, {"topicKey": f"topic{rng.randint(0, 5)}"}, {"scope": "project", "project": "p1"}])
        elif op in ("merge", "supersede", "undo_merge"):
            merges = [m for m in log if m["operation"] == "merge"]
            change = {"target": {"id": other, "revision": rng.randint(1, 3)}}
            if op == "undo_merge" and merges:
                m = rng.choice(merges)
                i, change = m["memory_id"], {**json.loads(m["change"]), "mergeId": m["seq"]}
        elif op == "restore":
            change = {"sourceRevision": rng.randint(1, 2)}
        evidence = rng.choice([None, None, [f"memory:{other}@{rng.randint(1, 2)}"], [f"file:{rng.randint(0, 9)}"]])
        row = {"principal_id": rng.choice("uv"), "request_id": f"q{k if rng.random() < 0.8 else rng.randint(1, k)}", "operation": op, "memory_id": i, "expected_revision": None if op in ("create", "propose") else rng.randint(1, 3)}
        row |= {"change": None if change is None else json.dumps(change), "agent": rng.random() < 0.1, "project": "p1", "evidence": evidence}
        if log and rng.random() < 0.1:
            row = {c: v for c, v in rng.choice(log).items() if c != "seq"} | ({} if rng.random() < 0.6 else {"memory_id": i})
        log.append(row | {"seq": k})
    return log


LOG = "seq long, principal_id string, request_id string, operation string, memory_id long, expected_revision long, change string, agent boolean, project string, evidence array<string>"


@pytest.mark.parametrize("seed", [1, 2])
def test_store_wide_log_equals_one_fold(spark, seed):
    """Components, in one wave and in several, give what a fold of the whole log gives."""
    log = random_log(random.Random(seed), 160)
    names = [c.split()[0] for c in LOG.split(", ")]
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in log], LOG).repartition(3)
    alone = mutations._fold(pd.DataFrame([r | {"family": 1} for r in log]))

    def rows(receipts):
        own = lambda x: None if x is None or x is pd.NA or x != x else tuple(x) if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and not isinstance(x, str) else x
        return {int(r["seq"]): tuple(own(r[c]) for c in ("status", "error", "revision", "state", "title", "content", "merged_into", "verification", "evidence", "validation", "rechecked")) for r in receipts}

    want = rows(alone[alone["seq"].notna()].to_dict("records"))
    got = rows(mutations.fold(df).collect())
    assert got == want
    kinds = collections.Counter(w[0] if w[1] is None else w[1] for w in want.values())
    assert {"created", "duplicate", "replayed", "request_conflict", "updated", "forgotten", "revision_conflict"} <= set(kinds), kinds
    receipts, state = mutations.in_waves(df, [40, 41, 110])
    assert rows(receipts.collect()) == want
    assert sum(len(json.loads(r.store)["seen"]) for r in state.collect()) == sum(s in ("created", "updated", "unchanged", "duplicate", "forgotten") for s, *_ in want.values())


def test_families_are_as_small_as_what_they_share(spark):
    rows = [(1, "u", "a", "create", 1, None, '{"title":"t","content":"x"}'), (2, "u", "b", "create", 2, None, '{"title":"t","content":"y","topicKey":"k"}'), (3, "u", "c", "create", 3, None, '{"title":"o","content":" x "}'),
            (4, "v", "a", "create", 4, None, '{"title":"t","content":"z","topicKey":"k"}'), (5, "u", "a", "create", 9, None, '{"title":"t","content":"x"}'), (6, "v", "d", "update", 4, 1, '{"title":"u"}')]
    log = spark.createDataFrame([(*r, False) for r in rows], "seq long, principal_id string, request_id string, operation string, memory_id long, expected_revision long, change string, agent boolean")
    got = {r.seq: (r.family, r.status, r.error) for r in mutations.fold(log).collect()}
    assert got == {1: (1, "created", None), 2: (2, "created", None), 3: (1, "created", None), 4: (4, "created", None), 5: (1, "refused", "request_conflict"), 6: (4, "updated", None)}
    undo = spark.createDataFrame([(*rows[0][:3], "undo_merge", 4, 1, '{"mergeId":1,"target":{"id":2,"revision":1}}', False)], log.schema).withColumn("seq", F.lit(7).cast("long"))
    joined = {r.seq: r.family for r in mutations.fold(log.union(undo)).collect()}
    assert joined[2] == joined[4] == joined[7]


def test_memories_are_tied_and_a_task_folds_many_families(spark):
    """What is walked over grows with the memories of a log, not its requests; a family's rows may span batches."""
    rows = [(k, "u", f"q{k}", "update" if k > 40 else "create", k % 40, k // 40, json.dumps({"title": f"t{k}", "content": f"x{k}"}), False, None, None) for k in range(1, 401)]
    log = spark.createDataFrame(rows, LOG)
    assert sorted((r.node, r.family) for r in mutations.families(log).collect()) == sorted((f"m:{k % 40}", k) for k in range(1, 41))
    names = [c.split()[0] for c in LOG.split(", ")]
    work = pd.DataFrame(rows, columns=names).assign(family=lambda x: x["memory_id"] % 3, state=None).sort_values(["family", "seq"])
    batches = [pa.RecordBatch.from_pylist(work[i : i + 7].to_dict("records")) for i in range(0, 400, 7)]
    want = [r for f in range(3) for r in json.loads(mutations._fold(work[work["family"] == f]).to_json(orient="records"))]
    got = [r for b in mutations._folds(True)(batches) for r in b.to_pylist()]
    assert got == want and sum(r["seq"] is None for r in got) == 3
    assert [r for b in mutations._folds(False)(batches) for r in b.to_pylist()] == [{k: v for k, v in r.items() if k not in ("ties", "store")} for r in want if r["seq"] is not None]


def test_engine_gives_every_request_a_receipt(spark):
    rows = [(1, "a", "create", 1, None, '{"title":"t","content":"x"}'), (2, "b", "archive", 1, 1, None), (3, "c", "update", 1, 1, '{"title":"n"}'), (4, "d", None, 1, 1, None)]
    log = spark.createDataFrame([(k, "u", *r, False) for k, *r in rows], "seq long, principal_id string, request_id string, operation string, memory_id long, expected_revision long, change string, agent boolean")
    engine = Engine(spark, {}, F.current_timestamp())
    brief = lambda df: {r.seq: (r.status, r.error) for r in df.collect()}
    receipts, state = engine.memory_save(log)
    assert brief(receipts) == {1: ("created", None), **{k: ("refused", "invalid_input") for k in (2, 3, 4)}}
    receipts, state = engine.memory_update(log.filter("seq > 1").withColumn("seq", F.col("seq") + 10), state)
    assert brief(receipts) == {12: ("refused", "invalid_input"), 13: ("updated", None), 14: ("refused", "invalid_input")}
    late = log.filter("seq = 2").withColumns({"seq": F.lit(30).cast("long"), "expected_revision": F.lit(2).cast("long")})
    receipts, state = engine.memory_delete(late, state)
    assert brief(receipts) == {30: ("updated", None)} and engine.memory_mutate(late.withColumn("seq", F.lit(31).cast("long")), state)[0].first().status == "replayed"


def test_mutations(spark):
    got = receipts(spark, [
        ("u", "a", "create", 1, None, {"title": "t", "content": "c"}),
        ("u", "a", "create", 1, None, {"content": "c", "title": "t"}),
        ("u", "a", "create", 1, None, {"title": "other"}),
        ("u", "b", "update", 1, 9, {"title": "n"}),
        ("u", "c", "update", 1, 1, {"title": "n"}, True),
        ("u", "d", "promote", 1, 2, None),
        ("u", "e", "create", 2, None, {"title": "x", "content": "y"}),
        ("u", "f", "merge", 2, None, {"target": {"id": 1, "revision": 3}}),
        ("u", "g", "merge", 2, 1, {"target": {"id": 1, "revision": 2}}),
        ("u", "h", "merge", 2, 1, {"target": {"id": 1, "revision": 3}}),
        ("u", "i", "undo_merge", 2, 2, {"target": {"id": 1, "revision": 3}, "mergeId": 10}),
        ("u", "j", "undo_merge", 2, 3, {"target": {"id": 1, "revision": 3}, "mergeId": 10}),
        ("u", "k", "update", 1, 3, {"state": "active"}),
        ("u", "l", "promote", 1, 3, None, True),
        ("u", "m", "update", 1, 3, {"validFrom": "2024-02-01", "validUntil": "2024-01-01"}),
        ("u", "n", "create", 3, None, {"title": " n ", "content": "c"}),
        ("u", "o", "update", 1, 3, {"title": "n"}),
    ])
    brief = {k: (r.status, r.error, r.state, r.revision) for k, r in got.items()}
    assert brief[1] == ("created", None, "active", 1) and brief[2][0] == "replayed" and brief[3][1] == "request_conflict"
    assert brief[4][1] == "revision_conflict" and brief[5] == ("updated", None, "candidate", 2) and brief[6] == ("updated", None, "active", 3)
    assert [brief[k][1] for k in (8, 9)] == ["revision_conflict"] * 2 and brief[10][2] == "superseded" and got[10].merged_into == 1
    assert brief[11] == ("updated", None, "active", 3) and brief[12][1] == "revision_conflict"
    assert brief[13][1] == "invalid_input" and brief[14][1] == "scope_denied" and brief[15][1] == "invalid_input"
    assert brief[16][0] == "duplicate" and brief[17][0] == "unchanged" and set(got[4].diff) >= {"title", "state"}


def test_mutations_with_evidence_and_namespaces(spark):
    got = receipts(spark, [
        ("o", "1", "create", 1, None, {"title": "source", "content": "token = abcdefgh12"}),
        ("o", "2", "create", 2, None, {"title": "a", "content": "b", "recordKind": "derived_summary"}, False, None, ["memory:1@1"]),
        ("o", "3", "create", 3, None, {"title": "c", "content": "d"}, False, None, ["memory:2@1", "artifact:x"]),
        ("o", "4", "create", 4, None, {"title": "e", "content": "f"}, False, None, ["artifact:y?"]),
        ("o", "5", "update", 1, 1, {"content": "new"}),
        ("o", "6", "promote", 2, 2, None),
        ("o", "7", "promote", 2, 2, None, False, None, ["memory:1@2"]),
        ("o", "8", "update", 3, 2, {"pinned": True}),
        ("o", "9", "update", 3, 3, {"title": "changed"}),
        ("o", "10", "restore", 3, 4, {"sourceRevision": 3}),
        ("a", "11", "create", 5, None, {"title": "p", "content": "q", "scope": "project", "project": "p1"}, True, "p1"),
        ("a", "12", "update", 5, 1, {"project": "p2"}, True, "p1"),
        ("a", "13", "create", 6, None, {"title": "p", "content": "q", "scope": "project", "project": "p2"}, True, "p1"),
        ("a", "14", "restore", 5, 1, {"sourceRevision": 1}, True, "p1"),
        ("o", "15", "update", 4, 1, {"title": "z"}, False, None, ["artifact:w!"]),
        ("o", "16", "forget", 1, 2, None),
        ("o", "1", "create", 1, None, {"title": "source", "content": "token = abcdefgh12"}),
        ("o", "17", "create", 7, None, {"title": "h", "content": "i"}, False, None, ["artifact:x"]),
        ("o", "18", "create", 1, None, {"title": "h", "content": "i"}),
        ("o", "19", "update", 2, 3, {"title": "h"}),
    ])
    assert got[1].content == "token = [REDACTED]" and (got[2].state, got[2].verification, got[2].validation) == ("active", "verified", "resolved")
    assert (got[4].state, got[4].validation) == ("candidate", "unresolved")
    assert got[5].rechecked == [2, 3] and got[6].error == "invalid_input" and (got[7].state, got[7].evidence) == ("active", ["memory:1@2"])
    assert got[8].evidence == ["artifact:x", "memory:2@1"] and got[9].evidence == [] and got[10].evidence == got[8].evidence and got[10].state == "candidate"
    assert (got[11].state, got[12].error, got[13].error, got[14].error, got[15].error) == ("candidate", "scope_denied", "scope_denied", "scope_denied", "scope_denied")
    assert got[16].status == "forgotten" and got[16].rechecked == [2, 3] and got[17].error == "context_invalidated"
    assert got[18].error == "context_invalidated" and got[19].error == "invalid_state" and got[20].error == "scope_denied"


def test_packing_skips_and_goes_on():
    e = lambda k, n, p=2, s=1.0, d=None, pin=False: {"key": k, "text": "x" * n, "section": "Other memories", "priority": p, "score": s, "diversity_key": d or k, "pinned": pin}
    limits = context.Limits(1000, 120, 1000, 3)
    chosen, text, _ = context.pack_entries([e("a", 50, s=3.0), e("b", 500, s=2.0), e("c", 20, s=1.0)], limits)
    assert [x["key"] for x in chosen] == ["a", "c"] and len(text) <= 120
    chosen, _, _ = context.pack_entries([e("a", 5, s=1.0, d="k"), e("b", 5, s=0.9, d="k"), e("c", 5, s=0.6)], context.Limits(1000, 1000, 1000, 2))
    assert [x["key"] for x in chosen] == ["a", "c"]
    assert context.clip_units("ab😀cd", 5) == ("ab...", True)
    assert context.Limits(100, 100, 100, 5).within({"max_items": 9, "max_tokens": 7}).max_tokens == 7


def test_review_ledger(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "a", "save", "admit", 0), (2, "a", "save", "admit", 1), (3, "a", "save", "settle", 2), (4, "a", "save", "admit", 3), (5, "b", "save", "admit", 4), (6, "c", "delete", "admit", 5), (7, "d", "save", "admit", 2000)]
    df = spark.createDataFrame([("n", s, t + dt.timedelta(seconds=x), 1, k, kind, a) for s, k, kind, a, x in rows], "nonce string, seq long, ts timestamp, cap long, request_key string, kind string, action string")
    got = [r.status for r in review.fold(df).orderBy("seq").collect()]
    assert got == ["admitted", "in_flight", "committed", "replay", "cap_reached", "admitted", "expired"]


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([("a", "x", "r"), ("b", "y", "s")], "k string, v string, root string")
    new = spark.createDataFrame([("a", "z", None), ("c", "w", "t")], "k string, v string, root string")
    got = sorted(tuple(r) for r in upsert(old, new, ["k"], keep_old=["root"]).collect())
    assert got == [("a", "z", "r"), ("b", "y", "s"), ("c", "w", "t")]
    assert sorted(r.v for r in first_wins(old, new, key=["k"]).collect()) == ["w", "x", "y"]
    write_snapshot(old, f"file://{tmp_path}/t", 1)
    assert read_snapshot(spark, f"file://{tmp_path}/t", 1).count() == 2
    paths = spark.createDataFrame([("/a/b/c",), ("/x",)], "path string")
    roots = spark.createDataFrame([("/a",), ("/a/b",)], "root string")
    assert [tuple(r) for r in longest_prefix(paths, roots).collect()] == [("/a/b/c", "/a/b")]


def test_nonces_are_taken_once(spark):
    t = dt.datetime(2024, 1, 1)
    rng = random.Random(3)
    at = lambda: t + dt.timedelta(seconds=rng.randint(0, 3000))
    waiting = [(f"n{i}", f"/w{i % 3}", f"m{i % 2}", at()) for i in range(200)]
    agents = [(f"g{i % 150}", f"/w{rng.randint(0, 3)}", f"m{i % 2}", at()) for i in range(200)]
    want, free, linked = set(), sorted(waiting, key=lambda x: (x[3], x[0])), set()
    for who, cwd, provider, when in sorted(agents, key=lambda x: (x[3], x[0])):
        found = next((x for x in free if x[1:3] == (cwd, provider) and when - dt.timedelta(seconds=120) <= x[3] <= when), None)
        if found and who not in linked:
            free.remove(found)
            linked.add(who)
            want.add((who, found[0]))
    w = spark.createDataFrame(waiting, "nonce string, cwd string, provider string, at timestamp")
    a = spark.createDataFrame(agents, "agent_id string, cwd string, provider string, at timestamp")
    got = [(r.agent_id, r.nonce) for r in links.take_once(w, a).collect()]
    assert set(got) == want and len(got) == len(want) > 20


def one_by_one(waiting, agents):
    """The takes in order of time, over all folders."""
    events = sorted([(at, 0, who, cwd, provider) for who, cwd, provider, at in waiting] + [(at, 1, who, cwd, provider) for who, cwd, provider, at in agents], key=lambda e: (e[0], e[1], e[2], json.dumps({"cwd": e[3], "provider": e[4]}, separators=(",", ":"))))
    pending, linked, taken, out = [], set(), set(), []
    for at, kind, who, *place in events:
        if kind == 0:
            pending.append((at, who, place))
        elif who not in linked:
            hit = next((p for p in pending if p[2] == place and p[0] >= at - dt.timedelta(seconds=120) and p[1] not in taken), None)
            if hit:
                linked.add(who)
                taken.add(hit[1])
                out.append((who, hit[1]))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nonces_and_agents_are_taken_once_over_all_folders(spark, seed):
    rng = random.Random(seed)
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    folder = lambda: rng.choice(["/hot", "/hot", "/hot", "/b", "/c", None])
    waiting = [(f"n{rng.randint(0, 120):03}", folder(), rng.choice(["p", "q"]), t(rng.randint(0, 2400))) for _ in range(260)]
    agents = [(f"g{rng.randint(0, 60):03}", folder(), rng.choice(["p", "q"]), t(rng.randint(0, 2400))) for _ in range(260)]
    w = spark.createDataFrame(waiting, "nonce string, cwd string, provider string, at timestamp").repartition(3)
    a = spark.createDataFrame(agents, "agent_id string, cwd string, provider string, at timestamp").repartition(3)
    got = [(r.agent_id, r.nonce) for r in links.take_once(w, a).collect()]
    want = one_by_one(waiting, agents)
    assert sorted(got) == sorted(want) and len({x for x, _ in got}) == len(got) == len({y for _, y in got}) > 25


def plain_widths(edges):
    up = collections.defaultdict(set)
    for src, dst in edges:
        up[dst].add(src)
    out = {}
    for v in up:
        seen, todo = {v}, [v]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        out[v] = len(seen) - 1
    return out


@pytest.mark.parametrize("seed", range(2))
def test_widths_of_random_graphs(spark, seed):
    """With cycles, wide nodes, nodes between the bounds (many paths from few sources) and repeated edges."""
    rng = random.Random(seed)
    n = 60
    edges = [(rng.randint(1, i - 1), i) for i in range(2, n) for _ in range(rng.randint(0, 3))]
    edges += [(k, 100 + k) for k in range(1, 4)] + [(101 + k, 100 + k) for k in range(1, 12)] + [(100 + k, 101 + k) for k in range(1, 12)]
    edges += [(200 + a, 210 + b) for a in range(3) for b in range(4)] + [(210 + b, 220 + c) for b in range(4) for c in range(4)] + [(220 + c, 230) for c in range(4)]
    edges += [(rng.randint(1, n), rng.randint(1, n)) for _ in range(seed * 2)] + edges[:5]
    e = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    for most in (6, 25):
        got = [r.id for r in access.too_wide(e, most).distinct().collect()]
        assert set(got) == {v for v, w in plain_widths(edges).items() if w > most}


def test_a_root_of_too_many_sources_is_incomplete_and_waits(spark):
    kind = "derived_from"
    rows = [(5000, 1, i, 1, kind) for i in range(1, 1026)] + [(5001, 1, i, 1, kind) for i in range(1, 1025)] + [(5002, 2, 5000, 1, kind), (5003, 1, 5003, 2, kind), (5003, 2, 7, 1, kind)]
    r = spark.createDataFrame(rows, "from_id long, from_revision long, to_id long, to_revision long, kind string")
    ids = spark.createDataFrame([(5000,), (5001,), (5002,), (1,)], "id long")
    got = {x.root: (x.n, x.complete) for x in lineage.sources_of(ids, r).groupBy("root").agg(F.count("*").alias("n"), F.bool_and("complete").alias("complete")).collect()}
    assert got == {5000: (1, False), 5001: (1025, True), 5002: (1, False), 1: (1, True)}
    exact = lineage.sources_of(spark.createDataFrame([(5003, 1), (5002, 1)], "id long, revision long"), r, revisions=True)
    assert {(x.root, x.root_revision, x.id, x.revision) for x in exact.collect()} == {(5003, 1, 5003, 1), (5003, 1, 5003, 2), (5003, 1, 7, 1), (5002, 1, 5002, 1)}
    m = spark.createDataFrame([(i, None if i == 3 else dt.datetime(2024, 1, 1)) for i in (1, 2, 3, 5000, 5001, 5002)], "id long, valid_until timestamp")
    until = {x.root: (x.valid_until, x.complete) for x in lineage.support_until(ids, r, m).collect()}
    assert until[5000] == (None, False) == until[5002] and until[5001][1] and until[5001][0] is not None
    left = access.quarantined(m, r, spark.createDataFrame([(2,)], "id long"), "ancestry")
    assert {x.id for x in left.collect()} == {1, 3}


def test_first_prompts_over_stretches_of_time(spark):
    """As one fold of a host in order of time."""
    rng = random.Random(9)
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    waiting = [(f"p{i:03}", "h", rng.choice(["directory", "worktree"]), rng.choice(["/s", "/s/t", None]), rng.choice(["P", None]), rng.choice(["t", "u", None]), t(rng.randint(0, 3000))) for i in range(150)]
    agents = [(f"g{i:03}", "h", rng.choice(["/s/t/u", "/s", "/q"]), rng.choice(["P", None]), rng.choice(["/s", None]), t(rng.randint(0, 3000))) for i in range(150)]
    pending, want = sorted(waiting, key=lambda p: (p[6], p[0])), set()
    inside = lambda path, folder: bool(folder) and (path == folder or path.startswith(folder + "/"))
    rules = (lambda p, g: p[2] == "directory" and inside(g[2], p[3]), lambda p, g: bool(p[5]) and p[5] in g[2].split("/"), lambda p, g: bool(p[4]) and p[4] == g[3] or bool(p[3]) and p[3] == g[4])
    for g in sorted(agents, key=lambda g: (g[5], g[0])):
        hit = next(((p, n) for n, rule in enumerate(rules, 1) for p in pending if g[5] - dt.timedelta(seconds=120) <= p[6] <= g[5] and rule(p, g)), None)
        if hit:
            pending.remove(hit[0])
            want.add((g[0], hit[0][0], hit[1]))
    w = spark.createDataFrame(waiting, "prompt string, host string, kind string, source_dir string, project_id string, slug string, at timestamp").repartition(3)
    a = spark.createDataFrame(agents, "agent_id string, host string, cwd string, project_id string, project_root string, at timestamp").repartition(3)
    got = [(r.agent_id, r.prompt, r.rule) for r in links.first_prompts(w, a).collect()]
    assert set(got) == want and len(got) == len(want) > 60


def test_first_prompts_by_the_strongest_rule(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    waiting = [
        ("by project", "h", "worktree", None, "P", None, t(0)), ("by slug", "h", "worktree", None, None, "tree", t(1)), ("by folder", "h", "directory", "/src", None, None, t(2)),
        ("other host", "x", "directory", "/src", "P", None, t(2)), ("by root", "h", "worktree", "/root", None, None, t(200)), ("too old", "h", "directory", "/late", None, None, t(0)),
    ]
    agents = [("a", "h", "/src/tree/x", "P", None, t(10)), ("b", "h", "/src/tree/x", "P", None, t(11)), ("c", "h", "/src/tree/x", "P", None, t(12)), ("d", "h", "/src/tree", "P", None, t(13)), ("e", "h", "/q", None, "/root", t(210)), ("f", "h", "/late/x", None, None, t(130)), ("g", "h", "/srcx", None, None, t(3))]
    w = spark.createDataFrame(waiting, "prompt string, host string, kind string, source_dir string, project_id string, slug string, at timestamp")
    a = spark.createDataFrame(agents, "agent_id string, host string, cwd string, project_id string, project_root string, at timestamp")
    got = {r.agent_id: (r.prompt, r.rule) for r in links.first_prompts(w, a).collect()}
    assert got == {"a": ("by folder", 1), "b": ("by slug", 2), "c": ("by project", 3), "e": ("by root", 3)}


def test_policies():
    p = policy.Policy()
    meta = policy.configure({}, p)
    assert meta["policy_revision"] == "1" and policy.configure(meta, p) is meta
    same = policy.Policy(allowed=("standard", "compact"), profiles=p.profiles | {"compact": dataclasses.replace(p.profiles["compact"], kinds=policy.STABLE_KINDS[::-1])})
    assert policy.configure(meta, same) is meta and policy.configure(meta, policy.Policy(max_pinned=3))["policy_revision"] == "2"
    r = policy.resolve(p, budget={"max_items": 7, "max_tokens": 10**9}, kinds=["fact", "episode", "artifact"], detail="full")
    assert r.limits == {"max_tokens": 8192, "max_chars": 6000, "max_bytes": 18000, "max_latency_ms": 750, "max_candidates": 60, "max_items": 7}
    assert r.kinds == ("fact", "episode") and r.detail == "compact" and policy.resolve(p, "compact").limits["max_chars"] == 3000
    for wrong in (lambda: policy.resolve(p, "evidence"), lambda: policy.Policy(default="evidence")):
        try:
            wrong()
            raise AssertionError("no error")
        except (PermissionError, ValueError):
            pass


def test_resolved_requests():
    assert search.resolved("  A  b ") == search.Request("a b", 8, 60) and search.resolved("x", 500, 1000).candidates == 200
    assert search.resolved("x", 500, 1000).limit == 200 and search.resolved("x", limit=0) is None and search.resolved("x", kinds=[]) is None and search.resolved("x", candidates=0) is None


def test_many_queries_are_cut_into_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = v.filter("id % 3 = 0").withColumnRenamed("id", "query_id")
    few = {(r.query_id, r.id, r.rank, round(r.similarity, 6)) for r in search.neighbours(q, v, 5, 0.1, 0.5).collect()}
    monkeypatch.setattr(search, "FEW_QUERIES", 10)
    monkeypatch.setattr(search, "BLOCK", 16)
    assert {(r.query_id, r.id, r.rank, round(r.similarity, 6)) for r in search.neighbours(q, v, 5, 0.1, 0.5).collect()} == few


def test_rerank_drops_what_is_beyond(spark):
    hits = spark.createDataFrame([(i, "session" if i == 2 else "memory", f"t{i}", 1.0 / i) for i in range(1, 6)], "id long, kind string, text string, score double")
    got = {r.id: r.relevance for r in search.rerank(hits, "q", lambda q, t: t.str[1:].astype(float) - 3, keep=4).collect()}
    assert set(got) == {1, 2, 3, 4} and abs(got[3] - 0.5) < 1e-9 and abs(got[2] - 0.9 / (1 + math.e)) < 1e-9


def test_materialise_drops_moved_revisions(spark):
    t = dt.datetime(2024, 1, 1)
    m = spark.createDataFrame([(1, 3, "a", "c", False, None, t, t, 0, 0, 0, 0, 0), (2, 1, "b", "c", True, "p", t, t, 3, 0, 0, 20, 0)], "id long, revision long, title string, content string, pinned boolean, project_key string, updated_at timestamp, verified_at timestamp, application_count long, helpful_count long, harmful_count long, shown_count long, opened_count long")
    refs = spark.createDataFrame([(0, 1, 2, 0.5, None), (0, 2, 1, 0.5, 0.8)], "query_id long, id long, revision long, score double, relevance double")
    got = {r.id: r.final for r in search.materialise(refs, m, F.lit(t), "p").collect()}
    assert set(got) == {2} and abs(got[2] - 0.8 * (1 + 0.1 + 0.06 + 0.05 + 0.04 * 2 / 5) * 0.95) < 1e-9


def test_sources_too_many_to_check(spark):
    e = spark.createDataFrame([(f"s{i}", "wide") for i in range(5)] + [("wide", "below"), ("a", "b"), ("b", "a")], "src string, dst string")
    assert {r.id for r in access.too_wide(e, 4).collect()} == {"wide", "below"}
    assert access.too_wide(e, 100).count() == 0


def test_out_of_date_follows_exact_revisions(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 2, "active", None, None), (2, 1, "active", None, None), (3, 1, "active", None, None), (4, 1, "archived", None, None), (5, 1, "active", None, None), (6, 1, "active", None, t), (7, 1, "active", None, None)]
    m = spark.createDataFrame([(*r, None) for r in rows], "id long, revision long, state string, valid_from timestamp, valid_until timestamp, deleted_at timestamp")
    edges = [(2, 1, 1, 1), (3, 1, 2, 1), (5, 1, 4, 1), (7, 1, 1, 2), (7, 2, 6, 1)]
    r = spark.createDataFrame([(*x, "derived_from") for x in edges], "from_id long, from_revision long, to_id long, to_revision long, kind string")
    got = {(x.id, x.revision) for x in access.out_of_date(m, r, F.lit(t)).collect()}
    assert got == {(2, 1), (3, 1), (5, 1), (7, 2)}
    assert {x.id for x in access.without_invalid_sources(m, access.out_of_date(m, r, F.lit(t))).collect()} == {1, 4, 6, 7}


def test_usage_conflicts_and_settlement(spark):
    rows = [("p", "e1", "a", "s", 1, "USD", 1), ("p", "e1", "a", "s", 2, "USD", 2), ("p", "e2", "b", "s", 1, "USD", 1), ("p", "e3", "b", "s", 1, None, 1), ("p", "e4", "c", "s", 1, "USD", 1), ("p", "e5", "c", "s", 2, "EUR", 1), ("p", "e6", "d", "s", 1, "USD", 1)]
    u = spark.createDataFrame(rows, "producer_id string, event_id string, attempt_id string, stage string, source_sequence long, currency string, n long")
    got = {(r.event_id, r.source_sequence): (r.id_conflict, r.sequence_conflict, r.currency_conflict) for r in usage.conflicts(u).collect()}
    assert got == {("e1", 1): (True, False, False), ("e1", 2): (True, False, False), ("e2", 1): (False, True, False), ("e3", 1): (False, True, False), ("e4", 1): (False, False, True), ("e5", 2): (False, False, True)}
    p = spark.createDataFrame([("r1",), ("r2",)], "retrieval_id string")
    assert {r.retrieval_id: r.status for r in usage.settled(p, p.limit(1)).collect()} == {"r1": "attached", "r2": "discarded"}
    ledger = spark.createDataFrame([("n", "save", "committed"), ("n", "save", "committed"), ("n", "delete", "committed"), ("m", "update", "released")], "nonce string, kind string, status string")
    assert {(r.nonce, r.status): r.n for r in usage.outcome_counts(ledger).collect()} == {("n", "committed"): 2, ("m", "released"): 1}


def test_texts_of_receipts_and_reviews(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(upkeep.save_receipt(F.lit("created"), F.lit(3))) == "Saved memory #3" and one(upkeep.save_receipt(F.lit("other"), F.lit(3))) == "Unchanged #3"
    ids = lambda *x: F.array(*map(F.lit, x)).cast("array<long>")
    assert one(tx.review_headline(ids(1, 2), ids(3))) == "Memory review: saved #1, #2, updated #3" and one(tx.review_headline(ids(), ids())) == "Memory review: nothing new"
    assert one(tx.task_query(F.lit("A b"), F.lit(" a  B "), F.lit("main"))) == "A b main" and one(tx.task_query(F.lit(" "), F.lit(None).cast("string"), F.lit(""))) is None
    t = lambda d, h=0: F.lit(dt.datetime(2024, 1, d, h))
    assert [one(tx.age(t(1), x)) for x in (t(3), t(1, 5), t(1))] == ["2d ago", "5h ago", "just now"]
    assert one(tx.assistant_view(F.lit("[memory:rev"), F.lit("streaming"))) == "hidden" and one(tx.assistant_view(F.lit("[memory:rev"), F.lit("complete"))) == "shown"
    assert one(tx.user_view(F.lit("[memory:review-prompt v1] x"))) == "hidden" and one(tx.user_view(F.lit("[memory:review-prompt v1 full] x"))) == "shown"


def test_registered_artifacts_history_backups_and_indexes(spark, tmp_path):
    a = spark.createDataFrame([("artifact:a", "x"), ("artifact:a", "x"), ("artifact:b", "y"), ("artifact:b", "z")], "source_ref string, content string")
    assert {r.source_ref: r.conflict for r in tables.register_artifacts(a).collect()} == {"artifact:a": False, "artifact:b": True}
    p = spark.createDataFrame([(2, 1), (1, 2), (3, 4)], "a long, b long")
    assert sorted(tuple(r) for r in tables.dismiss(p.limit(1), p).collect()) == [(1, 2), (3, 4)]
    h = spark.range(1, 151).select(F.lit(1).alias("memory_id"), F.col("id").alias("revision"))
    assert {r.revision for r in lineage.history(h).collect()} == set(range(51, 151))
    gone = spark.createDataFrame([(1, 1), (1, 2)], "root long, id long")
    assert {(r.kind, r.identifier) for r in lineage.tombstones(gone, F.lit(dt.datetime(2024, 1, 1))).collect()} == {("memory", "1"), ("memory", "2")}
    report = json.loads(tables.backup(h, f"file://{tmp_path}/b", 1))
    assert report["verified"] and report["rows"] == 150
    cat = spark.createDataFrame([("f1", "m", 3, "ready", None)], "fingerprint string, model string, dims int, state string, retired_at timestamp")
    new = spark.createDataFrame([("f2", "m", 4, "", None)], cat.schema)
    two = indexes.finish(indexes.register(cat, new), "f2", F.lit(dt.datetime(2024, 1, 2)))
    assert {(r.fingerprint, r.state) for r in two.collect()} == {("f1", "retired"), ("f2", "ready")}
    try:
        indexes.register(cat, spark.createDataFrame([("f1", "other", 3, "", None)], cat.schema)).collect()
        raise AssertionError("no error")
    except Exception as e:
        assert "identity" in str(e)


def test_contexts(spark):
    e = lambda k, n, pin=False: {"key": k, "text": "x" * n, "section": "Pinned" if pin else "Other memories", "priority": 0 if pin else 3, "score": 1.0, "diversity_key": k, "pinned": pin}
    frame = context.Frame("P <1>", extra=" more ")
    text = context.pack_entries([e("a", 5)], context.Limits(9000, 9000, 9000, 3), frame=frame)[1]
    assert text.startswith("<memories>\n") and "P \\u003c1\\u003e" in text and "\nmore\n" in text and text.endswith("</memories>")
    chosen, text, pins = context.pack_entries([e("a", 30, True), e("b", 10, True)], context.Limits(999, 60, 999, 1), total_pins=4)
    assert len(chosen) == 1 and pins == 4 and "left out" in text or not chosen
    assert context.why_less(0, 3, True) == "insufficient_allowance" and context.why_less(1, 3, True, canceled=True) == "canceled"
    assert context.why_less(1, 1, True, search="lexical_only") == "lexical_only" and context.why_less(1, 1, True, tokenizer_missing=True) == "tokenizer_unavailable" and context.why_less(1, 1, True) is None
    # A tokenizer that counts more for the whole than for its parts: the last entries go until it fits.
    count = lambda t: len(t) if t.count("##") < 2 or len(t) < 50 else 10**6
    assert [x["key"] for x in context.pack_entries([e("a", 30, True), e("b", 30)], context.Limits(500, 500, 500, 5), tokenizer=count)[0]] == ["a"]
    assert context.Limits.of(policy.resolve(policy.Policy())).max_items == 40


def test_dotted_terms_are_phrases(spark):
    m = spark.createDataFrame([(1, "a.b c", "x", None), (2, "b a", "x y", None), (3, "a", "b", None), (4, "q", "w a.b a b", None)], "id long, title string, content string, topic_key string")
    terms = spark.createDataFrame([(1, "a.b")], "query_id long, term string")
    assert {r.id for r in search.bm25(m, terms).collect()} == {1, 4}


def test_review_outcomes_prefer_the_audit(spark):
    r = spark.createDataFrame([("n", "Saved: #1"), ("m", "Saved: #2\nUpdated: #3")], "nonce string, text string")
    t = spark.createDataFrame([("n", [7], [])], "nonce string, saved array<long>, updated array<long>")
    got = {x.nonce: (x.saved, x.updated, x.line) for x in review.outcome(r, t).collect()}
    assert got == {"n": ([7], [], "Memory review: saved #7"), "m": ([2], [3], "Memory review: saved #2, updated #3")}


def test_static_embeddings(spark):
    t = spark.createDataFrame([(1, "Up up, down"), (2, "nothing"), (3, None)], "id long, text string")
    v = spark.createDataFrame([("up", [1.0, 0.0]), ("down", [0.0, 2.0])], "token string, vector array<double>")
    got = {r.id: r.embedding for r in embedder.static_embedding(t, v).collect()}
    assert set(got) == {1} and all(abs(x - math.sqrt(0.5)) < 1e-9 for x in got[1])
    assert spark.range(1).select(F.length(embedder.prepared(F.repeat(F.lit("x"), 9000), "query"))).first()[0] == 8007


def test_migrations(spark):
    old = spark.createDataFrame([(1, "global", None), (2, "project", "p")], "id long, scope string, project_key string")
    new = tables.migrate(old, 1)
    assert {"pinned", "state", "revision", "harmful_count"} <= set(new.columns) and new.filter("state = 'active' and revision = 1").count() == 2
    assert tables.migrate(new, tables.SCHEMA_VERSION).columns == new.columns
    for df, version in ((old, 99), (old.withColumn("project_key", F.lit("p")), 1)):
        try:
            tables.migrate(df, version).collect()
            raise AssertionError("no error")
        except AssertionError:
            raise
        except Exception as e:
            assert "newer" in str(e) or "namespace" in str(e)


def test_files_of_sessions(spark):
    t = dt.datetime(2024, 1, 1)
    many = [[f"a{i}" for i in range(60)], [f"b{i}" for i in range(30)], ["a3", "b1", "c"]]
    turns = [(1, k, t, "p", "m", None, None, "reply", f) for k, f in enumerate(many)] + [(2, 0, t, "p", "m", None, None, "reply", ["x", "x", "y"]), (3, 0, t, None, "m", None, None, "r", []), (3, 1, t, None, "m", None, None, "r", None)]
    df = spark.createDataFrame(turns, "agent_id long, seq long, ts timestamp, project_key string, provider string, title string, user_text string, assistant_text string, files array<string>")
    got = {r.id: (r.turns, r.files) for r in sessions.fold_turns(df.repartition(3)).collect()}
    assert got[1] == (3, ([f"a{i}" for i in range(50)] + [f"b{i}" for i in range(30)] + ["c"])[-50:])
    assert got[2] == (1, ["x", "x", "y"]) and got[3] == (2, [])


def test_forgetting_more_than_ten_thousand(spark):
    r = spark.range(2, 12_003).select(F.col("id").alias("from_id"), F.lit(1).cast("long").alias("to_id"), F.lit("derived_from").alias("kind"))
    evidence = spark.createDataFrame([], "memory_id long, source_ref string")
    ids = spark.createDataFrame([(1,), (7,)], "id long")
    gone = lineage.forget(ids, r, evidence)
    assert {x.root: x.n for x in gone.groupBy("root").agg(F.count("*").alias("n")).collect()} == {1: 12_002, 7: 1}
    assert lineage.forgotten(ids, r, evidence).count() == 12_002


def test_closure_of_many_roots(spark):
    rng = random.Random(12)
    pairs = {(rng.randrange(150), rng.randrange(150)) for _ in range(170)}
    edges = spark.createDataFrame(list(pairs), "src long, dst long")
    start = spark.createDataFrame([(i % 140,) for i in range(150)], "id long")
    rows = lambda df: sorted((x.root, x.id, x.depth) for x in df.collect())
    assert rows(graph.closure_of_many(start, edges)) == rows(graph.closure(start, edges))
    assert rows(graph.closure_of_many(start.limit(0), edges)) == []


def test_disclosure_to_more_than_ten_thousand(spark):
    e = spark.range(11_000).select(F.lit("memory:1").alias("src"), F.concat(F.lit("caller:n"), F.col("id").cast("string")).alias("dst"))
    start = spark.createDataFrame([("memory:1",)], "id string")
    assert lineage.disclosed(start, e).count() == 11_001
    nothing = spark.createDataFrame([], "memory_id long, source_ref string"), spark.createDataFrame([], "from_id long, to_id long, kind string")
    what = erasure.plan(spark.createDataFrame([(1,)], "id long"), nothing[1], nothing[0], e, None)
    assert what.contexts.count() == 11_000


def test_only_stretches_that_are_told_something_new_are_folded_again(spark):
    folds = spark.sparkContext.accumulator(0)

    def fold(rows):
        folds.add(1)
        asks = [x for x in rows if x.kind == 1 and not links._earlier(x, (x.at, x.who, x.place))]
        free = [x for x in rows if x.kind == 0]
        return [(x.place, x.stretch, x.who, p.token, x.at) for x, p in zip(asks, free)]

    rows = [(f"p{i % 50}", i, kind, f"{'t' if kind == 0 else 'g'}{i}", f"{'t' if kind == 0 else 'g'}{i}", 10 * i + kind) for i in range(300) for kind in (0, 1)]
    # One agent asks in two stretches, so that the later one must be folded again.
    rows.append(("p7", 200, 1, "g3", "g3", 5000))
    df = spark.createDataFrame(rows, "place string, stretch long, kind int, token string, who string, at long").repartition(4)
    got = links._in_rounds(df, fold, links._FOLDED).collect()
    assert len(got) == 300 and len({x.token for x in got}) == 300
    # Before, each round folded all stretches again, one call of pandas each.
    assert folds.value < 2 * 301


def test_blocks_leave_out_what_has_no_similarity(spark, monkeypatch):
    rows = [(i, [1.0, float(i)]) for i in range(20)] + [(20, None), (21, [1.0]), (22, [1.0, None])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = v.filter("id in (3, 20, 21)").withColumnRenamed("id", "query_id")
    monkeypatch.setattr(search, "FEW_QUERIES", 1)
    got = {(r.query_id, r.id) for r in search.neighbours(q, v, 2).collect()}
    assert got == {(3, 19), (3, 18), (21, 21)}


def test_bm25_scores_what_is_visible_by_statistics_of_all(spark):
    m = spark.createDataFrame([(1, "red", "blue"), (2, "blue", "blue green"), (3, "green", "reds"), (4, None, None)], "id long, title string, content string").withColumn("topic_key", F.lit(None).cast("string"))
    terms = spark.createDataFrame([(1, "blue"), (2, "red"), (2, "reds")], "query_id long, term string")
    seen = m.filter("id <> 1").select("id")
    rows = lambda df: sorted((r.query_id, r.id, r.score) for r in df.collect())
    every = rows(search.bm25(m, terms))
    assert rows(search.bm25(m, terms, visible=seen)) == [x for x in every if x[1] != 1] and len(every) == 4


@pytest.mark.parametrize("pivots", [1, 3, 16])
def test_closure_by_pivots_equals_closure(spark, monkeypatch, pivots):
    monkeypatch.setattr(graph, "PIVOTS", pivots)
    monkeypatch.setattr(graph, "IN_BLOCK", 4)
    rng = random.Random(pivots)
    pairs = {(rng.randrange(150), rng.randrange(150)) for _ in range(190)} | {(5, 5), (None, 7), (8, None)}
    edges = spark.createDataFrame(list(pairs), "src long, dst long")
    start = spark.createDataFrame([(i % 160,) for i in range(170)], "id long")
    rows = lambda df: sorted((x.root, x.id) for x in df.collect())
    assert rows(graph.closure_by_pivots(start, edges)) == rows(graph.closure(start, edges.dropna()))
    assert rows(graph.closure_by_pivots(start.limit(0), edges)) == []
    assert rows(graph.closure_by_pivots(start.limit(2), edges.limit(0))) == [(0, 0), (1, 1)]


def test_forgetting_by_each_keeps_no_row_for_pairs(spark, monkeypatch):
    # 3,000 roots lead to a source that 3,000 memories share: packs of 64 roots are 141,000 rows.
    evidence = spark.range(10_000, 13_000).select(F.col("id").alias("memory_id"), F.lit("artifact:a").alias("source_ref"))
    derived = spark.range(3_000).select((F.col("id") + 10_000).alias("from_id"), F.col("id").alias("to_id"), F.lit("derived_from").alias("kind"))
    kept = []
    whole = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: kept.append((out := whole(df)).count()) or out)
    gone = lineage.forgotten_by_each(spark.range(3_000), derived, evidence)
    assert sum(kept) < 100_000
    assert {r.n for r in gone.groupBy("root").agg(F.count_distinct("id").alias("n")).collect()} == {3_001} and gone.count() == 3_000 * 3_001

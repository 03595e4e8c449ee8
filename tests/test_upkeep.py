import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import upkeep


def test_every_row_asks_for_near_duplicates(spark):
    rng = random.Random(4)
    rows = [(i, "hot" if i % 4 else f"s{i % 3}", [rng.gauss(0, 1) / 3 for _ in range(8)], 0) for i in range(2, 150)]
    rows += [(200 + i, "hot", rows[1][2], 0) for i in range(9)]
    v = spark.createDataFrame(rows, "id long, scope_key string, embedding array<double>, label int")
    want = set()
    for a, scope, x, _ in rows:
        near = sorted((-round(sum(p * q for p, q in zip(x, y)), 6), b) for b, s, y, _ in rows if s == scope)[:6]
        want |= {(a, b, -s) for s, b in near if b != a and -s >= 0.3}
    for block in (16, 1024):
        got = {(r.a, r.b, round(r.similarity, 6)) for r in upkeep.near_everywhere(v, 6, 0.3, block).collect()}
        assert got == want
    assert any((a - 1) % 100 and (b - 1) % 100 for a, b, _ in want)


@pytest.mark.parametrize("bits,seed", [(16, 5), (8, 6)])
def test_auto_merge_folds_whole_families(spark, bits, seed):
    rng, t = random.Random(seed), dt.datetime(2024, 1, 1)
    texts = ['port "\u00e9" is open', 'port "e\u0301" is open', "plain", " plain "]
    rows = []
    for i in [*range(1, 61), *rng.sample(range(-300, 2000), 25), 2**40, 2**40 + 300]:
        if i in {r[0] for r in rows}:
            continue
        text = texts[rng.randrange(4)]
        archived = t if i in (3, 20) else None
        rows.append((i, "project" if i % 2 else "global", "p1" if i % 2 else None, "note", "s", "a", "m", i % 17 == 1 or i == 2, "fact", "unverified", None, None, "title", text, archived, i % 9, i % 4, i % 5, t + dt.timedelta(hours=i % 5000)))
    m = spark.createDataFrame(
        rows,
        "id long, scope string, project_key string, type string, source string, agent_id string, provider string, pinned boolean, record_kind string, verification_status string, "
        "valid_from timestamp, valid_until timestamp, title string, content string, archived_at timestamp, application_count long, helpful_count long, opened_count long, updated_at timestamp",
    )
    every = m.select(F.col("id").alias("low")).crossJoin(m.select(F.col("id").alias("high"))).filter("low < high")
    gone, want = set(), set()
    for r in upkeep.mergeable(every, m).orderBy("low", "high").collect():
        if not {r.low, r.high} & gone:
            gone.add(r.source)
            want.add((r.low, r.high, r.target, r.source))
    got = [(r.low, r.high, r.target, r.source) for r in upkeep.auto_merge(m, bits).collect()]
    assert set(got) == want and len(got) == len(want) > 40

"""Streaming twins against the batch operators, over a few files taken one by one."""

import datetime as dt

from pyspark.sql import functions as F

from cairn.operators import usage
from cairn.streaming import events


def run(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(i % 40, f"u{i % 3}", "view" if i % 2 else "click", t(i * 20 + (4000 if i >= 60 else 0))) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, user string, event_type string, ts timestamp")
    df.repartition(4).write.parquet(f"{tmp_path}/events")
    stream = events.event_stream(spark, f"{tmp_path}/events", df.schema, 2)
    first = run(events.distinct_events(stream, ["event_id"], "ts", "10 hours"), "append", "first_seen")
    assert {r.event_id for r in first.collect()} == set(range(40)) and first.count() == 40
    counts = run(events.activity(stream, "ts", "5 minutes", "10 hours"), "update", "counted")
    newest = counts.groupBy("window", "event_type").agg(F.max("n").alias("n"))
    assert newest.agg(F.sum("n")).first()[0] == 120
    idle = run(events.idle_sessions(stream, "ts", "user", "15 minutes", "1 minute"), "append", "idle")
    assert idle.count() >= 3 and all(r.turns == 20 for r in idle.collect())


def test_newest_figures(spark, tmp_path):
    names = "producer_id string, attempt_id string, stage string, provenance string, source_sequence long, input_tokens long, output_tokens long, cost_amount double, currency string"
    rows = [("p", f"a{i % 3}", "s", "x", i, i if i % 4 else None, None, float(i), "USD") for i in range(30)]
    df = spark.createDataFrame(rows, names)
    df.repartition(3).write.parquet(f"{tmp_path}/usage")
    out = run(events.newest_figures(events.event_stream(spark, f"{tmp_path}/usage", df.schema, 1)), "complete", "figures")
    key = lambda r: (r.attempt_id, r.input_tokens, r.cost_amount, r.currency)
    assert sorted(map(key, out.collect())) == sorted(map(key, usage.observations(df).collect()))

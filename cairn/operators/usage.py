"""Model usage, feedback and audit analytics over append-only event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAFE_INTEGER = 2**53 - 1
MAINTENANCE = ("review", "extraction", "consolidation", "validation")


def observations(usage: DataFrame) -> DataFrame:
    """The latest known figures of each producer, attempt, stage and provenance by source sequence, whatever the order of
    arrival. A figure that is missing in the newest event is taken from the newest that has it; currency goes with cost."""
    key = ["producer_id", "attempt_id", "stage", "provenance"]

    def newest(c: str, where: str | None = None) -> Column:
        return F.max_by(c, F.when(F.col(where or c).isNotNull(), F.col("source_sequence"))).alias(c)

    return usage.groupBy(*key).agg(newest("input_tokens"), newest("output_tokens"), newest("cost_amount"), newest("currency", "cost_amount"))


def latest_status(usage: DataFrame) -> DataFrame:
    """Per stage and status of the newest event of an attempt: n, and how many attempts lack usage or billing."""
    per = usage.groupBy("producer_id", "attempt_id", "stage").agg(
        F.max_by("status", "source_sequence").alias("status"),
        F.max(F.col("provenance") != "unavailable").alias("has_usage"),
        F.max((F.col("provenance") == "provider_observed") & F.col("cost_amount").isNotNull()).alias("has_billing"),
    )
    return per.groupBy("stage", "status").agg(
        F.count("*").alias("n"), F.count_if(~F.col("has_usage")).alias("without_usage"), F.count_if(~F.col("has_billing")).alias("without_billing")
    )


def tokens(usage: DataFrame) -> DataFrame:
    """Sums by stage and provenance; what nobody reported stays null."""
    return observations(usage).groupBy("stage", "provenance").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def costs(usage: DataFrame) -> DataFrame:
    rows = observations(usage).filter("cost_amount is not null")
    return rows.groupBy("stage", "provenance", "currency").agg(F.round(F.sum("cost_amount"), 4).alias("amount"), F.count("*").alias("n"))


def summary(usage: DataFrame) -> DataFrame:
    """Totals by stage, with the maintenance stages also as one; a sum beyond 2 ** 53 - 1 is an error."""
    t = tokens(usage)
    merged = t.filter(F.col("stage").isin(*MAINTENANCE)).withColumn("stage", F.lit("maintenance"))

    def safe(c: str) -> Column:
        return F.when(F.sum(c) > SAFE_INTEGER, F.raise_error(F.lit(f"{c} overflows")).cast("long")).otherwise(F.sum(c)).alias(c)

    return t.unionByName(merged).groupBy("stage").agg(F.sum("n").alias("n"), safe("input_tokens"), safe("output_tokens"))


def conflicts(usage: DataFrame) -> DataFrame:
    """Events that can't be taken in: another event has the same id with other content, the same sequence of an attempt's
    stage, or its attempt has another currency."""
    same = Window.partitionBy("producer_id", "event_id")
    slot = Window.partitionBy("producer_id", "attempt_id", "stage", "source_sequence")
    attempt = Window.partitionBy("producer_id", "attempt_id")
    body = F.xxhash64(*[c for c in usage.columns if c != "created_at"])
    df = usage.withColumn("_body", body)
    df = df.withColumns(
        {
            "id_conflict": F.min("_body").over(same) != F.max("_body").over(same),
            "sequence_conflict": F.min("event_id").over(slot) != F.max("event_id").over(slot),
            "currency_conflict": F.coalesce(F.min("currency").over(attempt) != F.max("currency").over(attempt), F.lit(False)),
        }
    )
    return df.filter("id_conflict or sequence_conflict or currency_conflict").drop("_body")


def settled(prepared: DataFrame, admissions: DataFrame) -> DataFrame:
    """What became of each prepared context: attached where it was admitted, discarded otherwise."""
    a = admissions.select("retrieval_id", F.lit(True).alias("_in")).distinct()
    return prepared.join(a, "retrieval_id", "left").withColumn("status", F.when(F.col("_in"), "attached").otherwise("discarded")).drop("_in")


def hints(feedback: DataFrame, memories: DataFrame, tombstoned: DataFrame, now: Column) -> DataFrame:
    """Counters by memory over feedback that still holds: on the current revision, before its deadline, and with no
    evidence that has been forgotten."""
    f = feedback.join(memories.select(F.col("id").alias("memory_id"), "revision"), ["memory_id", "revision"])
    f = f.filter(F.col("support_valid_until").isNull() | (now < F.col("support_valid_until")))
    bad = f.select("event_id", F.explode("evidence_refs").alias("ref")).join(tombstoned.select("ref"), "ref", "left_semi").select("event_id").distinct()
    f = f.join(bad, "event_id", "left_anti")
    validated = F.col("basis").isin("validator", "human")
    return f.groupBy("memory_id").agg(
        F.count_if(F.col("signal") == "applied").alias("applied"),
        F.count_if((F.col("signal") == "helpful") & validated).alias("validated_helpful"),
        F.count_if((F.col("signal") == "harmful") & validated).alias("validated_harmful"),
        F.count_if((F.col("signal") == "helpful") & ~validated).alias("reported_helpful"),
        F.count_if(F.col("signal") == "irrelevant").alias("irrelevant"),
    )


def expired(feedback: DataFrame, now: Column) -> DataFrame:
    return feedback.filter(F.col("support_valid_until") <= now)


def feedback_status(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("basis").agg(F.count("*").alias("n"), *[F.count_if(F.col("signal") == s).alias(s) for s in ("applied", "helpful", "harmful", "irrelevant")])


def agents_of(events: DataFrame, links: DataFrame, limit: int) -> DataFrame:
    """Agents with first and last event and count, the latest first."""
    per = links.join(events.select("nonce", "created_at").withColumnRenamed("created_at", "_at"), "nonce", "left").groupBy("agent_id").agg(
        F.min("_at").alias("first_at"), F.max("_at").alias("last_at"), F.count("_at").alias("events"), F.max("created_at").alias("linked_at")
    )
    return per.orderBy(F.coalesce("last_at", "linked_at").desc(), "agent_id").limit(limit).drop("linked_at")


def events_since(events: DataFrame, nonce, since: Column) -> DataFrame:
    return events.filter((F.col("nonce") == nonce) & (F.col("created_at") >= since))


def issued(events: DataFrame) -> DataFrame:
    """The newest inject event of each nonce."""
    return events.filter("kind = 'inject'").groupBy("nonce").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), F.max("created_at").alias("created_at"))


def describe(kind: Column, n: Column) -> Column:
    """One line about an event."""
    s = n.cast("string")
    return (
        F.when(kind == "search", F.concat(F.lit("Searched, "), s, F.lit(" results")))
        .when(kind == "get", F.concat(F.lit("Read #"), s))
        .when(kind == "save", F.concat(F.lit("Saved #"), s))
        .when(kind == "update", F.concat(F.lit("Updated #"), s))
        .when(kind == "inject", F.concat(F.lit("Injected "), s, F.lit(" memories")))
        .when(kind == "denied", F.lit("Denied"))
        .otherwise(kind)
    )


def outcome_counts(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("kind").isin("save", "update")).groupBy("nonce", "status").agg(F.count("*").alias("n"))


def touched_ids(events: DataFrame, since: Column, until: Column) -> DataFrame:
    """What each agent saved and updated in a window of time."""
    e = events.filter((F.col("created_at") >= since) & (F.col("created_at") < until))
    return e.groupBy("nonce").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "save", F.col("k")))).alias("saved"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "update", F.col("k")))).alias("updated"),
    )


def latency(samples: DataFrame, keep: int = 256) -> DataFrame:
    """Nearest-rank p50 and p95 of the newest samples of each stage."""
    newest = Window.partitionBy("stage").orderBy(F.desc("seq"))
    s = samples.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= keep)
    by_value = Window.partitionBy("stage").orderBy("duration_ms", "seq")
    s = s.withColumns({"_k": F.row_number().over(by_value), "_n": F.count("*").over(Window.partitionBy("stage"))})

    def at(p: float) -> Column:
        return F.max(F.when(F.col("_k") == F.ceil(F.col("_n") * p), F.col("duration_ms")))

    return s.groupBy("stage").agg(F.count("*").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"))

"""The review ledger: slots, replays, limits and expiry, folded per review."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_SECONDS = 15 * 60
LEAST_ATTEMPTS = 20
LEDGER = "nonce string, seq long, request_key string, kind string, action string, status string"


def _fold(group: pd.DataFrame) -> pd.DataFrame:
    """Actions in order. admit reserves a slot; settle and release end it. A key that is committed is replayed and one that
    is reserved is in flight. Deletions take no slot unless nothing may change. After the window everything is refused."""
    group = group.sort_values("seq")
    first, cap = group["ts"].iloc[0], int(group["cap"].iloc[0])
    slots: dict[str, tuple[str, str]] = {}
    attempts, out = 0, []
    for r in group.itertuples():
        state, kind = slots.get(r.request_key, (None, None))
        status = "ignored"
        if r.action == "admit":
            attempts += 1
            used = sum(s in ("reserved", "committed") and k != "delete" for s, k in slots.values())
            if (r.ts - first).total_seconds() > WINDOW_SECONDS:
                status = "expired"
            elif state == "committed":
                status = "replay"
            elif state == "reserved":
                status = "in_flight"
            elif attempts > max(LEAST_ATTEMPTS, 2 * cap):
                status = "attempt_limit"
            elif cap == 0 or (r.kind != "delete" and used >= cap):
                status = "cap_reached"
            else:
                slots[r.request_key] = ("reserved", r.kind)
                status = "admitted"
        elif state == "reserved":
            status = "committed" if r.action == "settle" else "released"
            slots[r.request_key] = (status, kind)
        out.append((r.nonce, r.seq, r.request_key, r.kind, r.action, status))
    return pd.DataFrame(out, columns=[c.split()[0] for c in LEDGER.split(", ")])


def fold(actions: DataFrame) -> DataFrame:
    """status of each of actions(nonce, seq, ts, cap, request_key, kind, action); a review is small, reviews run apart."""
    return actions.groupBy("nonce").applyInPandas(_fold, LEDGER)


def release_stale(slots: DataFrame) -> DataFrame:
    """After a restart what was reserved is free again."""
    return slots.withColumn("status", F.when(F.col("status") == "reserved", "released").otherwise(F.col("status")))


def outcome(replies: DataFrame, touched: DataFrame) -> DataFrame:
    """nonce, saved, updated and line of reviews' replies(nonce, text): the ids that the audit saw (touched: nonce, saved,
    updated) where it saw any, else those that the reply names."""
    from ..functions.text import review_headline, review_reply

    r = replies.select("nonce", review_reply(F.col("text")).alias("r"))
    t = touched.select(F.col("nonce").alias("_n"), F.col("saved").alias("_s"), F.col("updated").alias("_u"))
    r = r.join(t, F.col("nonce") == F.col("_n"), "left")
    seen = (F.size(F.coalesce("_s", F.array().cast("array<bigint>"))) + F.size(F.coalesce("_u", F.array().cast("array<bigint>")))) > 0
    r = r.select("nonce", F.when(seen, F.col("_s")).otherwise(F.col("r.saved")).alias("saved"), F.when(seen, F.col("_u")).otherwise(F.col("r.updated")).alias("updated"), F.col("r.summary").alias("summary"))
    return r.withColumn("line", review_headline(F.col("saved"), F.col("updated")))

"""Scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank fusion constant, and the weight of sessions among reranked hits (fixed values).
RRF_K = 60
SESSION_WEIGHT = 0.9
#: Least relevance for a task by strictness (fixed values).
RERANK_FLOORS = {"low": 0.2, "medium": 0.4, "high": 0.65}


def usage_factor(shown: Column, opened: Column) -> Column:
    """Shown often and never opened counts against a memory; opened counts for it."""
    share = F.least(F.lit(1.0), opened / F.greatest(F.lit(1), shown))
    return F.when((shown >= 10) & (opened == 0), F.lit(0.95)).otherwise(1 + 0.06 * share)


def age_days(then: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400.0)


def boost(pinned: Column, in_project: Column, touched: Column, now: Column, activity: Column) -> Column:
    proven = F.least(F.lit(1.0), F.log2(1.0 + F.greatest(F.lit(0), activity)) / 5.0)
    return (
        1
        + F.when(pinned, 0.1).otherwise(0.0)
        + 0.06 / (1 + age_days(touched, now) / 30)
        + F.when(in_project, 0.05).otherwise(0.0)
        + 0.04 * proven
    )


def context_relevance(touched: Column, now: Column, activity: Column, shown: Column, opened: Column) -> Column:
    recent = 1 / (1 + age_days(touched, now) / 14)
    return (recent + 0.5 * F.least(F.lit(1.0), F.log2(1.0 + F.greatest(F.lit(0), activity)) / 5.0)) * usage_factor(shown, opened)


def fused(rank: Column) -> Column:
    """Share of one ranked list in the fused score; rank counts from 1."""
    return 1.0 / (RRF_K + rank)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def is_task_match(relevance: Column, similarity: Column, strictness: str, vector_floor: float | None) -> Column:
    """Every signal there is must clear its floor; without vectors only low strictness takes keyword hits."""
    ok = F.coalesce(relevance >= RERANK_FLOORS[strictness], F.lit(True))
    if vector_floor is None:
        return ok & (relevance.isNotNull() | F.lit(strictness == "low"))
    return ok & F.coalesce(similarity >= vector_floor, F.lit(False))

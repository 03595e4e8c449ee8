"""Retrieval policies: the owner's profiles, what a request may narrow, and when the policy counts as another one."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("fact", "preference", "derived_summary", "lesson", "episode", "procedure_ref")
PROFILES = ("compact", "standard", "evidence")
DETAIL = ("references", "compact", "full")
#: Ceilings that no profile may pass, and what the three profiles allow (fixed values).
CEILINGS = {"max_tokens": 32768, "max_chars": 20000, "max_bytes": 80000, "max_latency_ms": 5000, "max_candidates": 200, "max_items": 100}
BUDGETS = {
    "compact": {"max_tokens": 4096, "max_chars": 3000, "max_bytes": 9000, "max_latency_ms": 500, "max_candidates": 30, "max_items": 20},
    "standard": {"max_tokens": 8192, "max_chars": 6000, "max_bytes": 18000, "max_latency_ms": 750, "max_candidates": 60, "max_items": 40},
    "evidence": {"max_tokens": 32768, "max_chars": 20000, "max_bytes": 60000, "max_latency_ms": 2000, "max_candidates": 120, "max_items": 80},
}
STABLE_KINDS = ("fact", "preference", "derived_summary", "lesson")
RESERVED = {"tokens": 1024, "chars": 1024, "bytes": 4096}


@dataclass(frozen=True)
class Profile:
    max_tokens: int
    max_chars: int
    max_bytes: int
    max_latency_ms: int
    max_candidates: int
    max_items: int
    kinds: tuple[str, ...]
    detail: str = "compact"
    rerank: str = "auto"


def default_profiles() -> dict[str, Profile]:
    kinds = {"compact": STABLE_KINDS, "standard": (*STABLE_KINDS, "episode"), "evidence": (*STABLE_KINDS, "episode")}
    return {name: Profile(**BUDGETS[name], kinds=kinds[name], detail="full" if name == "evidence" else "compact") for name in PROFILES}


@dataclass(frozen=True)
class Policy:
    """The owner's settings. Lists of names are sets: their order never makes another policy."""

    default: str = "standard"
    allowed: tuple[str, ...] = ("compact", "standard")
    profiles: dict[str, Profile] = field(default_factory=default_profiles)
    reserved: dict[str, int] = field(default_factory=lambda: dict(RESERVED))
    context_chars: int = 6000
    max_pinned: int = 20
    task_matches: int = 5
    task_strictness: str = "medium"
    project_memories: int = 10
    global_memories: int = 5
    recent_sessions: int = 3
    extra_instructions: str = ""
    usage_ranking: bool = True
    stale_days: int = 90

    def __post_init__(self) -> None:
        if self.default not in self.allowed:
            raise ValueError("the default profile must be allowed")

    def canonical(self) -> Policy:
        profiles = {n: replace(p, kinds=tuple(k for k in KINDS if k in p.kinds)) for n, p in sorted(self.profiles.items())}
        return replace(self, allowed=tuple(n for n in PROFILES if n in self.allowed), profiles=profiles)

    def digest(self) -> str:
        """The same for settings that mean the same."""
        return hashlib.sha256(json.dumps(asdict(self.canonical()), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def configure(meta: dict[str, str], policy: Policy) -> dict[str, str]:
    """The stored settings after a policy is set: its revision goes up by one where its digest is another, and only then."""
    digest, revision = policy.digest(), int(meta.get("policy_revision", "0"))
    if meta.get("policy_hash") == digest and revision > 0:
        return meta
    return meta | {"policy_hash": digest, "policy_revision": str(revision + 1)}


@dataclass(frozen=True)
class Resolved:
    profile: str
    limits: dict[str, int]
    kinds: tuple[str, ...]
    detail: str
    most_detail: str
    reserved: dict[str, int]


def resolve(policy: Policy, profile: str | None = None, budget: dict[str, int] | None = None, kinds: list[str] | None = None, detail: str | None = None) -> Resolved:
    """What a request gets: of every limit the least of profile, request and ceiling, characters within the context's,
    kinds that both name, and no more detail than the profile's. A profile that isn't allowed is refused."""
    name = profile or policy.default
    if name not in policy.allowed:
        raise PermissionError("scope_denied")
    p, budget = policy.profiles[name], budget or {}
    limits = {k: min(getattr(p, k), budget.get(k, getattr(p, k)), most) for k, most in CEILINGS.items()}
    limits["max_chars"] = min(limits["max_chars"], policy.context_chars)
    asked = min(DETAIL.index(detail or "compact"), DETAIL.index(p.detail))
    return Resolved(name, limits, tuple(k for k in p.kinds if kinds is None or k in kinds), DETAIL[asked], p.detail, dict(policy.reserved))


def resolved_limits(requests: DataFrame, policy: Policy) -> DataFrame:
    """requests(id, profile and any of the limits, null where not asked for) with denied and all limits: of every limit the
    least of the profile's, the request's and the ceiling. A null profile is the policy's; one that isn't allowed is denied
    and has no limits. The profiles are a table of a few rows, joined to requests of any number."""
    names = [n for n in policy.allowed if n in policy.profiles]
    rows = [(n, *(min(getattr(policy.profiles[n], k), most, *([policy.context_chars] if k == "max_chars" else [])) for k, most in CEILINGS.items())) for n in names]
    own = requests.sparkSession.createDataFrame(rows, ", ".join(["_name string", *(f"_{k} long" for k in CEILINGS)]))
    r = requests.withColumn("profile", F.coalesce("profile", F.lit(policy.default)))
    df = r.join(F.broadcast(own), F.col("profile") == F.col("_name"), "left")
    limits = [F.when(F.col("_name").isNotNull(), F.least(f"_{k}", k) if k in requests.columns else F.col(f"_{k}")).alias(k) for k in CEILINGS]
    return df.select("id", "profile", F.col("_name").isNull().alias("denied"), *limits)

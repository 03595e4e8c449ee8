"""Folding an ordered log of change requests into revisions and receipts.

The log is the store's: a request is replayed if its principal has sent it before under any memory, and a text may exist
once in a namespace. What may touch each other is found first: requests that share a memory (their own, a target, one they
cite), a source, a principal's request id or a text are tied, and the connected components of those ties are folded in log
order, side by side; a task takes one component after another, request by request. A request is replayed if its principal has sent it before, refused if its
body differs, then authorised, checked against the revision that it expects, checked for its fields and its evidence, and
applied. What it changes makes the memories that derive from the old revision wait for a check.

A log may come in waves: fold_onto() takes what the waves before have left (a row for each component), joins it with the
new requests by the same ties, folds only what they touch, and carries the rest over. Order is what the log means, so a
component isn't split: a fold holds its live state, not the log.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import SECRET_SHAPES, ascii_bounds
from .graph import components, cut

#: Fields that each operation may change (fixed values).
COMMON = {"title", "content", "type", "scope", "project", "topicKey", "pinned", "recordKind", "validFrom", "validUntil"}
ALLOWED = {
    "create": COMMON | {"state"},
    "propose": COMMON | {"state"},
    "update": COMMON,
    "archive": set(),
    "reject": set(),
    "promote": set(),
    "forget": set(),
    "restore": {"sourceRevision"},
    "merge": {"target"},
    "supersede": {"target"},
    "undo_merge": {"mergeId", "target"},
}
#: What an agent needs leave for by operation, what only the owner may do, and fields whose change is another claim.
NEEDS = {"archive": "delete", "forget": "delete", "merge": "merge", "undo_merge": "merge", "restore": "restore"}
AGENT_MAY = ("write", "delete")
OWNER_ONLY = ("promote", "reject", "forget")
PROMOTABLE = ("candidate", "needs_recheck", "archived")
CLAIM = {"title": "title", "content": "content", "type": "type", "scope": "scope", "recordKind": "record_kind", "validFrom": "valid_from", "validUntil": "valid_until"}
MOST_DIFFERENCES = 12
REQUEST = "family, seq, principal_id, request_id, operation, memory_id, expected_revision, change, agent, project, evidence"
RECEIPT = (
    "family long, seq long, principal_id string, request_id string, memory_id long, operation string, status string, "
    "error string, revision long, state string, title string, content string, merged_into long, verification string, "
    "evidence array<string>, validation string, diff array<string>, rechecked array<long>"
)
#: What earlier waves leave: a row for each component, with what ties it to later requests.
STATE = "family long, ties array<string>, store string"
FOLDED = RECEIPT + ", ties array<string>, store string"

_SHAPES = [(re.compile(ascii_bounds(p)), re.sub(r"\$(\d)", r"\\\1", put)) for p, put in SECRET_SHAPES]
_PRIVATE = re.compile(r"<private>[\s\S]*?</private>", re.I)


_encode = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode


@lru_cache(maxsize=1 << 16)
def redacted(text: str) -> str:
    """text.redact() for one string, trimmed. A log repeats its texts: every later look at one is free."""
    out = _PRIVATE.sub("[private]", text)
    for pattern, put in _SHAPES:
        out = pattern.sub(put, out)
    return out.strip()


def canonical(value: object) -> str:
    """JSON with sorted keys and without those that have no value."""

    def bare(x: object) -> object:
        if isinstance(x, dict):
            return {k: bare(v) for k, v in x.items() if v is not None}
        return [bare(v) for v in x] if isinstance(x, list) else x

    return _encode(bare(value))


def body_hash(operation: str, memory_id: int, expected: int | None, change: dict | None, evidence: list | None = None) -> str:
    """Digest of a request in canonical form."""
    body = {"operation": operation, "id": memory_id, "expected": expected, "change": change, "evidence": evidence or None}
    return hashlib.sha256(canonical(body).encode()).hexdigest()


class Refused(ValueError):
    """A request that is not applied; its text is the code."""

    def __init__(self, code: str, diff: list[str] | None = None):
        super().__init__(code)
        self.diff = diff or []


class Memory(dict):
    """A memory being folded: its fields, with `evidence` (name to whether it resolves) of its present revision."""

    @property
    def namespace(self) -> tuple[str, str | None]:
        return self["scope"], self["project_key"]

    def fields(self) -> dict:
        return {k: v for k, v in self.items() if k not in ("revision", "evidence", "snapshots")}


class Store:
    """The memories of a component, and what is needed to judge the next request."""

    def __init__(self) -> None:
        self.memories: dict[int, Memory] = {}
        self.forgotten: set[int] = set()
        self.sources_gone: set[str] = set()
        self.merges: dict[int, dict] = {}
        self.seen: dict[tuple, tuple[str, dict, str, int]] = {}
        self.rechecked: list[int] = []

    # ---- checks

    @staticmethod
    def may(agent: bool, project: str | None, operation: str, namespace: tuple[str, str | None]) -> bool:
        if not agent:
            return True
        return operation in AGENT_MAY and (namespace[0] == "global" or (project is not None and namespace[1] == project))

    def authorize(self, r: dict, current: Memory | None) -> None:
        change, agent = r["change"], r["agent"]
        if r["operation"] not in ("create", "propose"):
            if current is None or not self.may(agent, r["project"], NEEDS.get(r["operation"], "write"), current.namespace):
                raise Refused("scope_denied")
            if agent and current["record_kind"] == "preference":
                raise Refused("scope_denied")
        if agent and (r["operation"] in OWNER_ONLY or change.get("state") == "active" or change.get("recordKind") == "preference"):
            raise Refused("scope_denied")
        if "scope" in change or "project" in change:
            scope = change.get("scope") or (current["scope"] if current else "global")
            key = None if scope == "global" else change.get("project") or (current["project_key"] if current else None)
            if (scope == "project" and not key) or not self.may(agent, r["project"], "write", (scope, key)):
                raise Refused("scope_denied")
            if change.get("project") and not self.may(agent, r["project"], "write", ("project", change["project"])):
                raise Refused("scope_denied")

    @staticmethod
    def assert_revision(r: dict, current: Memory | None) -> None:
        if r["operation"] in ("create", "propose"):
            return
        expected = r["expected"]
        if expected is None or expected != current["revision"]:
            old = current["snapshots"].get(expected, {}) if expected is not None else {}
            differs = [k for k, v in current.fields().items() if old.get(k) != v]
            raise Refused("revision_conflict", differs[:MOST_DIFFERENCES])

    def evidence(self, r: dict) -> tuple[dict[str, bool], str]:
        """What is supplied, and whether all of it resolves. Names are `memory:id@revision` or others; one that ends with
        `!` is out of the caller's reach, one with `?` doesn't resolve."""
        given = {}
        for ref in r["evidence"] or []:
            bare = ref.rstrip("!?")
            if bare in self.sources_gone:
                raise Refused("context_invalidated")
            if ref.endswith("!"):
                raise Refused("scope_denied")
            given[bare] = not ref.endswith("?") and self.resolves(bare)
        return given, "none" if not given else "resolved" if all(given.values()) else "unresolved"

    def resolves(self, ref: str) -> bool:
        m = re.fullmatch(r"memory:(\d+)@(\d+)", ref)
        if not m:
            return True
        source = self.memories.get(int(m[1]))
        return source is not None and source["revision"] == int(m[2]) and source["state"] == "active" and not source["deleted"]

    # ---- changes

    def apply(self, r: dict) -> tuple[str, Memory, str]:
        """status, the memory and how its evidence was judged."""
        current = self.memories.get(r["memory_id"])
        self.authorize(r, current)
        self.assert_revision(r, current)
        if set(k for k, v in r["change"].items() if v is not None) - ALLOWED[r["operation"]]:
            raise Refused("invalid_input")
        given, outcome = self.evidence(r)
        self.rechecked = []
        if r["operation"] in ("create", "propose"):
            return self.create(r, given, outcome)
        if r["operation"] == "forget":
            return self.forget(current)
        if r["operation"] in ("merge", "supersede"):
            return self.replace(r, current, given, outcome)
        if r["operation"] == "undo_merge":
            return self.undo(r, current, given, outcome)
        return self.update(r, current, given, outcome)

    def create(self, r: dict, given: dict[str, bool], outcome: str) -> tuple[str, Memory, str]:
        change, agent = r["change"], r["agent"]
        if r["memory_id"] in self.memories or r["memory_id"] in self.forgotten:
            raise Refused("invalid_state")
        if not change.get("title") or not change.get("content"):
            raise Refused("invalid_input")
        scope = change.get("scope") or "global"
        key = change.get("project") if scope == "project" else None
        if (scope == "project" and not key) or not self.may(agent, r["project"], "write", (scope, key)):
            raise Refused("scope_denied")
        type_ = change.get("type") or "note"
        kind = change.get("recordKind") or ("preference" if type_ == "preference" and not agent else "fact")
        if kind == "procedure_ref" and not change["content"].startswith("playbook:"):
            raise Refused("invalid_input")
        self.interval(change.get("validFrom"), change.get("validUntil"))
        waits = r["operation"] == "propose" or agent or outcome == "unresolved" or kind == "lesson" or (kind == "derived_summary" and outcome != "resolved")
        new = Memory(
            title=redacted(change["title"]), content=redacted(change["content"]), type=type_, scope=scope, project_key=key,
            topic_key=change.get("topicKey"), pinned=bool(change.get("pinned")), record_kind=kind, state="candidate" if waits else change.get("state") or "active",
            verification="verified" if outcome == "resolved" else "unverified", valid_from=change.get("validFrom"), valid_until=change.get("validUntil"),
            merged_into=None, deleted=False, revision=1, evidence=given, snapshots={},
        )
        same = ("title", "content", "type", "scope", "project_key", "record_kind", "valid_from", "valid_until")
        twin = min((i for i, m in self.memories.items() if not m["deleted"] and all(m[k] == new[k] for k in same)), default=None)
        if twin is not None:
            return "duplicate", self.memories[twin], outcome
        self.memories[r["memory_id"]] = new
        self.snapshot(new)
        return "created", new, outcome

    def update(self, r: dict, m: Memory, given: dict[str, bool], outcome: str) -> tuple[str, Memory, str]:
        op, change = r["operation"], dict(r["change"])
        source = None
        if op == "restore":
            source = change.get("sourceRevision")
            if source is None or source not in m["snapshots"]:
                raise Refused("invalid_input")
            old = m["snapshots"][source]
            if r["agent"] and old.get("scope") is None:
                raise Refused("scope_denied")
            change = {"title": old["title"], "content": old["content"], "type": old["type"], "pinned": old["pinned"], "recordKind": old["record_kind"], "validFrom": old["valid_from"], "validUntil": old["valid_until"]}
        claimed = self.claim_changed(m, change)
        after = Memory(m)
        for key, column in (*CLAIM.items(), ("topicKey", "topic_key"), ("pinned", "pinned")):
            if key in change:
                after[column] = redacted(str(change[key])) if key in ("title", "content") else change[key]
        after["project_key"] = None if after["scope"] == "global" else change.get("project") or m["project_key"]
        self.interval(after["valid_from"], after["valid_until"])
        after["state"] = self.next_state(op, r["agent"], m, claimed, outcome)
        if outcome == "resolved" or op == "promote":
            after["verification"] = "verified"
        elif outcome == "unresolved" or claimed:
            after["verification"] = "unverified"
        # Verification is dated, so a promotion is a change even where no other field is.
        if after == m and not given and op != "promote":
            return "unchanged", m, outcome
        after.update(deleted=after["state"] == "archived", merged_into=None)
        if given:
            after["evidence"] = given
        elif op == "promote" or (op != "restore" and claimed) or (op == "restore" and source is None):
            after["evidence"] = {}
        elif op == "restore":
            after["evidence"] = dict(m["snapshots"][source]["evidence"])
        self.advance(r["memory_id"], m, after)
        return "updated", m, outcome

    @staticmethod
    def next_state(op: str, agent: bool, m: Memory, claimed: bool, outcome: str) -> str:
        if op == "promote":
            if m["state"] not in PROMOTABLE:
                raise Refused("invalid_state")
            if m["record_kind"] == "derived_summary" and outcome != "resolved":
                raise Refused("invalid_input")
            return "active"
        fixed = {"archive": "archived", "reject": "rejected", "restore": "candidate"}
        if op in fixed:
            return fixed[op]
        if outcome == "unresolved" or (claimed and (agent or m["record_kind"] == "derived_summary")):
            return "candidate"
        return m["state"]

    @staticmethod
    def claim_changed(m: Memory, change: dict) -> bool:
        if change.get("project") and (change.get("scope") or m["scope"]) == "project" and change["project"] != m["project_key"]:
            return True
        return any((redacted(str(change[k])) if k in ("title", "content") else change[k]) != m[c] for k, c in CLAIM.items() if k in change)

    @staticmethod
    def interval(start: str | None, end: str | None) -> None:
        if start and end and start >= end:
            raise Refused("invalid_input")

    def replace(self, r: dict, m: Memory, given: dict[str, bool], outcome: str) -> tuple[str, Memory, str]:
        if m["deleted"] or m["state"] in ("archived", "superseded"):
            raise Refused("invalid_input")
        target = r["change"].get("target") or {}
        if not target.get("id") or target["id"] == r["memory_id"]:
            raise Refused("invalid_input")
        other = self.memories.get(target["id"])
        if other is None or other["state"] != "active" or not self.may(r["agent"], r["project"], "write", other.namespace):
            raise Refused("scope_denied")
        if other["revision"] != target.get("revision"):
            raise Refused("revision_conflict")
        if other.namespace != m.namespace:
            raise Refused("scope_denied")
        if r["operation"] == "merge":
            self.merges[r["seq"]] = {"source": r["memory_id"], "target": target["id"], "state": m["state"], "undone": False}
        self.advance(r["memory_id"], m, Memory(m | {"state": "superseded", "deleted": True, "merged_into": target["id"], "evidence": given or m["evidence"]}))
        return "updated", m, outcome

    def undo(self, r: dict, m: Memory, given: dict[str, bool], outcome: str) -> tuple[str, Memory, str]:
        target, merge_id = r["change"].get("target") or {}, r["change"].get("mergeId")
        if not target.get("id") or not merge_id:
            raise Refused("invalid_input")
        other = self.memories.get(target["id"])
        if other is None or not self.may(r["agent"], r["project"], "merge", other.namespace):
            raise Refused("scope_denied")
        if other["revision"] != target.get("revision"):
            raise Refused("revision_conflict")
        merge = self.merges.get(merge_id)
        if not merge or merge["source"] != r["memory_id"] or merge["target"] != target["id"] or merge["undone"] or m["merged_into"] != target["id"]:
            raise Refused("revision_conflict")
        if m["topic_key"] and any(o is not m and not o["deleted"] and o.namespace == m.namespace and o["topic_key"] == m["topic_key"] for o in self.memories.values()):
            raise Refused("request_conflict")
        sound = outcome != "unresolved" and all(ok and self.resolves(ref) for ref, ok in m["evidence"].items())
        state = "needs_recheck" if merge["state"] == "active" and not sound else merge["state"]
        merge["undone"] = True
        if m["evidence"] and outcome != "unresolved":
            outcome = "resolved" if sound else "unresolved"
        self.advance(r["memory_id"], m, Memory(m | {"state": state, "deleted": False, "merged_into": None, "evidence": given or m["evidence"]}))
        return "updated", m, outcome

    def forget(self, m: Memory) -> tuple[str, Memory, str]:
        """Takes out the memory, what derives from it or cites it, and what shares a source with one of those."""
        number = {id(x): i for i, x in self.memories.items()}
        gone, todo = set(), [number[id(m)]]
        while todo:
            i = todo.pop()
            if i in gone:
                continue
            gone.add(i)
            own = set(self.memories[i]["evidence"])
            todo += [j for j, o in self.memories.items() if j not in gone and (own & set(o["evidence"]) or any(ref.startswith(f"memory:{i}@") for ref in o["evidence"]))]
        out = Memory(m | {"state": "archived", "title": None, "content": None, "evidence": {}})
        for i in gone:
            self.sources_gone |= set(self.memories[i]["evidence"]) | {f"memory:{i}@{k}" for k in self.memories[i]["snapshots"]}
            del self.memories[i]
        self.merges = {k: x for k, x in self.merges.items() if not {x["source"], x["target"]} & gone}
        self.forgotten |= gone
        self.rechecked = sorted(gone - {number[id(m)]})
        return "forgotten", out, "none"

    def snapshot(self, m: Memory) -> None:
        m["snapshots"][m["revision"]] = m.fields() | {"evidence": dict(m["evidence"])}

    def advance(self, memory_id: int, m: Memory, after: Memory) -> None:
        """A new revision; whoever derives from the old one waits for a check, and so on."""
        old = m["revision"]
        m.update(after, revision=old + 1)
        self.snapshot(m)
        todo = [(memory_id, old)]
        while todo:
            ref = "memory:{}@{}".format(*todo.pop())
            for i, o in sorted(self.memories.items()):
                if ref in o["evidence"] and o["state"] in ("active", "candidate") and o is not m:
                    o.update(state="needs_recheck", verification="unresolved", revision=o["revision"] + 1)
                    o["evidence"][ref] = False
                    self.snapshot(o)
                    self.rechecked.append(i)
                    todo.append((i, o["revision"] - 1))

    # ---- the log

    def take(self, r: dict) -> dict:
        """The receipt of a request."""
        key = r["principal_id"], r["request_id"]
        digest = lambda: body_hash(r["operation"], r["memory_id"], r["expected"], r["change"], r["evidence"])
        if key in self.seen:
            before, receipt, operation, memory_id = self.seen[key]
            if memory_id in self.forgotten and operation != "forget":
                return {"status": "refused", "error": "context_invalidated"}
            now = self.memories.get(memory_id)
            if now is not None and not self.may(r["agent"], r["project"], "write", now.namespace):
                return {"status": "refused", "error": "scope_denied"}
            return receipt | {"status": "replayed"} if before == digest() else {"status": "refused", "error": "request_conflict"}
        try:
            status, m, outcome = self.apply(r)
        except Refused as e:
            return {"status": "refused", "error": str(e), "diff": e.diff or None}
        receipt = {
            "status": status, "error": None, **{k: m[k] for k in ("revision", "state", "title", "content", "merged_into", "verification")},
            "evidence": sorted(m["evidence"]), "validation": outcome, "rechecked": sorted(self.rechecked),
        }
        self.seen[key] = digest(), receipt, r["operation"], r["memory_id"]
        return receipt


def _kept(store: Store) -> tuple[list[str], str]:
    """What ties a component's state to later requests, and the state itself."""
    live = [m for m in store.memories.values()]
    refs = {ref for m in live for snap in (m, *m["snapshots"].values()) for ref in snap["evidence"]} | store.sources_gone
    texts = {snap["content"] for m in live for snap in (m, *m["snapshots"].values()) if snap["content"] is not None}
    ties = {f"m:{i}" for i in (*store.memories, *store.forgotten)} | {f"e:{ref}" for ref in refs} | {f"m:{int(m[1])}" for ref in refs if (m := _MEMORY_REF.fullmatch(ref))}
    ties |= {f"r:{p}\n{q}" for p, q in store.seen} | {f"c:{content_key(x)}" for x in texts} | {f"t:{m['topic_key']}" for m in live if m["topic_key"]}
    state = {
        "memories": [[i, {k: v for k, v in m.items() if k != "snapshots"}, list(m["snapshots"].items())] for i, m in store.memories.items()],
        "forgotten": sorted(store.forgotten), "gone": sorted(store.sources_gone), "merges": list(store.merges.items()), "seen": [[*k, *v] for k, v in store.seen.items()],
    }
    return sorted(ties), json.dumps(state)


def _load(store: Store, state: str) -> None:
    kept = json.loads(state)
    for i, m, snapshots in kept["memories"]:
        store.memories[i] = Memory(m, snapshots={k: v for k, v in snapshots})
    store.forgotten |= set(kept["forgotten"])
    store.sources_gone |= set(kept["gone"])
    store.merges |= {k: v for k, v in kept["merges"]}
    store.seen |= {(p, q): (digest, receipt, operation, i) for p, q, digest, receipt, operation, i in kept["seen"]}


_MEMORY_REF = re.compile(r"memory:(\d+)@(\d+)")


def _receipt(x: dict, store: Store) -> dict:
    """The receipt of one request, as a row of RECEIPT."""
    expected, change, evidence = x["expected_revision"], x["change"], x["evidence"]
    r = {
        "seq": int(x["seq"]), "principal_id": x["principal_id"], "request_id": x["request_id"], "operation": x["operation"], "memory_id": int(x["memory_id"]),
        "expected": None if expected is None or expected != expected else int(expected), "change": json.loads(change) if isinstance(change, str) else {},
        "agent": bool(x["agent"]), "project": x["project"] if isinstance(x["project"], str) else None, "evidence": [str(e) for e in evidence] if hasattr(evidence, "__len__") else None,
    }
    return {"family": x["family"], **{k: r[k] for k in ("seq", "principal_id", "request_id", "memory_id", "operation")}} | store.take(r)


def _left(family: int, store: Store) -> dict:
    """The row (without seq) of the state that a component leaves."""
    ties, state = _kept(store)
    return {"family": family, "ties": ties, "store": state}


def _fold(group: pd.DataFrame) -> pd.DataFrame:
    """Receipts of a component's requests in log order, then the state that they leave: the fold of a log that is at hand."""
    store = Store()
    out = [_receipt(x, store) for x in group.sort_values("seq").to_dict("records")]
    out.append(_left(int(group["family"].iloc[0]), store))
    names = [c.split()[0] for c in FOLDED.split(", ")]
    df = pd.DataFrame({n: pd.Series([x.get(n) for x in out], dtype=object) for n in names})
    return df.astype({c: "Int64" for c in ("seq", "memory_id", "revision", "merged_into")})


_ARROW = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in rows], _ARROW[kind]) for n, kind in fields], [n for n, _ in fields])


def _folds(keep: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Folds rows that come by family and seq, a family's earlier states (without seq) first: receipts and, where the state
    is kept, a row for what each family leaves. One family's live state is held at a time, and no request."""
    schema = FOLDED if keep else RECEIPT

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, store = None, Store()
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if x["family"] != family:
                    if keep and family is not None:
                        out.append(_left(family, store))
                    family, store = x["family"], Store()
                if x["seq"] is None:
                    _load(store, x["state"])
                else:
                    out.append(_receipt(x, store))
            yield _batch(out, schema)
        if keep and family is not None:
            yield _batch([_left(family, store)], schema)

    return run


def content_key(stored: str) -> str:
    return hashlib.sha256(stored.encode()).hexdigest()


@F.pandas_udf(StringType())
def _content_keys(content: pd.Series) -> pd.Series:
    """Keys of contents as the fold would store them."""
    return content.map(lambda x: content_key(redacted(x)) if isinstance(x, str) else None)


def _own(requests: DataFrame) -> Column:
    """The tie of a request's own memory."""
    return F.concat(F.lit("m:"), requests["memory_id"].cast("string"))


def ties(requests: DataFrame) -> DataFrame:
    """What the requests of a memory (node) share with those that they must be folded with: a row for each node and tie, the
    memory itself among its ties. Ties to memories have the topic of their request, and whether it undoes a merge; first is
    the earliest request."""
    change = F.from_json("change", "content string, topicKey string, target struct<id: bigint>")
    bare = F.transform(F.coalesce("evidence", F.array().cast("array<string>")), lambda x: F.rtrim(x, F.lit("!?")))
    cited = F.transform(F.filter(bare, lambda x: x.rlike(r"^memory:\d+@\d+$")), lambda x: F.concat(F.lit("m:"), F.regexp_extract(x, r"^memory:0*(\d+)@", 1)))
    shared = [
        F.concat(F.lit("r:"), F.col("principal_id"), F.lit("\n"), F.col("request_id")),
        F.concat(F.lit("c:"), _content_keys(change["content"])),
    ]
    whole = [_own(requests), F.concat(F.lit("m:"), change["target"]["id"].cast("string")), *shared]
    whole = F.array_compact(F.concat(F.array(*whole), F.transform(bare, lambda x: F.concat(F.lit("e:"), x)), cited))
    t = requests.select(
        "seq", _own(requests).alias("node"), (F.col("operation") == "undo_merge").alias("undoes"), F.concat(F.lit("t:"), change["topicKey"]).alias("topic"), F.explode(F.array_distinct(whole)).alias("tie")
    )
    memory = F.col("tie").startswith("m:")
    return t.groupBy("node", "tie", (F.col("undoes") & memory).alias("undoes"), F.when(memory, F.col("topic")).alias("topic")).agg(F.min("seq").alias("first"))


def families(requests: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """node and family (the smallest seq or earlier family that it is tied with) of the requests' memories and of the
    families of state ("s:" and the family). A log has far fewer memories than requests, so those are what is walked over.
    A topic ties only where the merge of a memory that has it is undone: nothing else looks at other memories' topics."""
    t = cut(ties(requests))
    undone = t.filter("undoes").select("tie").distinct()
    topics = t.filter("topic is not null").join(undone, "tie", "left_semi").select(F.col("topic").alias("tie"))
    pairs, topical = t.filter("node <> tie").select("node", "tie"), t.filter("topic is not null").select("node", F.col("topic").alias("tie"))
    names = t.filter("node = tie").groupBy("node").agg(F.min("first").alias("first"))
    if state is not None:
        node = F.concat(F.lit("s:"), F.col("family").cast("string")).alias("node")
        s = state.select(node, F.explode("ties").alias("tie"))
        holders = s.filter("tie like 'm:%'").join(undone, "tie", "left_semi").select("node").distinct()
        topics = topics.union(s.filter("tie like 't:%'").join(holders, "node", "left_semi").select("tie"))
        pairs, topical = pairs.union(s.filter("tie not like 't:%'")), topical.union(s.filter("tie like 't:%'"))
        names = names.union(state.select(node, F.col("family").alias("first")))
    others = pairs.filter("tie not like 'm:%'").union(topical.join(topics.distinct(), "tie", "left_semi").select("node", "tie"))
    hubs = others.groupBy("tie").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last")
    edges = pairs.filter("tie like 'm:%'").union(others.join(hubs, "tie").select("node", "hub")).toDF("a", "b")
    found = components(edges).withColumnsRenamed({"id": "node", "component": "_c"})
    names = names.join(found, "node", "left").withColumn("_c", F.coalesce("_c", "node"))
    least = names.groupBy("_c").agg(F.min("first").alias("family"))
    return names.join(least, "_c").select("node", "family")


def _folded(requests: DataFrame, state: DataFrame | None, allowed: tuple[str, ...] | None, keep: bool) -> tuple[DataFrame, DataFrame | None]:
    for c, kind in (("project", "string"), ("evidence", "array<string>")):
        if c not in requests.columns:
            requests = requests.withColumn(c, F.lit(None).cast(kind))
    requests = requests.withColumn("seq", F.col("seq").cast("long"))
    taken = requests if allowed is None else requests.filter(F.col("operation").isin(*allowed))
    label = cut(families(taken, state)).withColumnRenamed("family", "_family")
    taken = taken.join(label, _own(taken) == F.col("node")).withColumn("family", F.col("_family")).select(*REQUEST.split(", "))
    work = taken.withColumn("state", F.lit(None).cast("string"))
    carried = None
    if state is not None:
        rows = state.join(label, F.concat(F.lit("s:"), F.col("family").cast("string")) == F.col("node")).select(F.col("_family").alias("family"), "ties", "store")
        touched = taken.select("family").distinct()
        work = work.unionByName(rows.join(touched, "family", "left_semi").select("family", F.col("store").alias("state")), allowMissingColumns=True)
        carried = rows.join(touched, "family", "left_anti")
    receipts = work.repartition("family").sortWithinPartitions("family", "seq").mapInArrow(_folds(keep), FOLDED if keep else RECEIPT)
    left = None
    if keep:
        done = cut(receipts)
        receipts, left = done.filter("seq is not null").drop("ties", "store"), done.filter("seq is null").select("family", "ties", "store")
        left = left if carried is None else carried.union(left)
    if allowed is not None:
        names = [c.split()[0] for c in RECEIPT.split(", ")]
        refused = requests.filter(~F.col("operation").isin(*allowed) | F.col("operation").isNull())
        given = {"family": F.col("seq"), "status": F.lit("refused"), "error": F.lit("invalid_input")}
        types = {f.name: f.dataType for f in receipts.schema}
        refused = refused.select(*[(given.get(n) if n in given else F.col(n) if n in ("seq", "principal_id", "request_id", "memory_id", "operation") else F.lit(None)).cast(types[n]).alias(n) for n in names])
        receipts = receipts.unionByName(refused)
    return receipts, left


def fold_onto(requests: DataFrame, state: DataFrame | None = None, allowed: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Receipts of requests(REQUEST), and the state(STATE) that they leave on top of state. seq is unique in the store and
    above that of earlier waves; change is JSON, evidence an array of references, project the one that an agent works in;
    family, project and evidence may be missing. Every request gets a receipt: those of operations other than the allowed
    ones are refused and change nothing."""
    return _folded(requests, state, allowed, True)


def fold(requests: DataFrame, state: DataFrame | None = None, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """The receipts alone; the state that the log leaves is not written down."""
    return _folded(requests, state, allowed, False)[0]


def in_waves(requests: DataFrame, bounds: list[int]) -> tuple[DataFrame, DataFrame]:
    """fold_onto() of a log wave by wave: up to each of the bounds (of seq), then the rest."""
    state, receipts, low = None, None, None
    for high in [*bounds, None]:
        wave = requests.filter((F.col("seq") > low if low is not None else F.lit(True)) & (F.col("seq") <= high if high is not None else F.lit(True)))
        got, state = fold_onto(wave, state)
        state, receipts, low = cut(state), got if receipts is None else receipts.union(got), high
    return receipts, state


def current(receipts: DataFrame) -> DataFrame:
    """The state that the log leaves by its own requests: the last receipt of each memory that changed it."""
    done = receipts.filter(F.col("status").isin("created", "updated", "forgotten"))
    return done.groupBy("memory_id").agg(*[F.max_by(c, "seq").alias(c) for c in ("revision", "state", "title", "content", "merged_into")])


def replays(requests: DataFrame) -> DataFrame:
    """requests with `sent`: first, again (the same body) or conflict (another body) of its principal and request id. Only
    requests that were not refused when first sent count as sent in the fold; this looks at the log alone."""
    from pyspark.sql import Window

    body = F.sha2(F.to_json(F.struct("operation", "memory_id", "expected_revision", "change"), {"ignoreNullFields": "false"}), 256)
    w = Window.partitionBy("principal_id", "request_id").orderBy("seq")
    r = requests.withColumns({"_body": body, "_n": F.row_number().over(w)}).withColumn("_first", F.first("_body").over(w))
    return r.withColumn("sent", F.when(F.col("_n") == 1, "first").when(F.col("_body") == F.col("_first"), "again").otherwise("conflict")).drop("_body", "_n", "_first")


def upsert_topics(requests: DataFrame) -> DataFrame:
    """Saves under a topic key, folded: one row per namespace and topic with the last text, pinned once set, and the
    number of changes of text. requests(seq, scope, project_key, topic_key, title, content, pinned)."""
    from pyspark.sql import Window

    from ..functions.text import content_hash

    key = ["scope", "project_key", "topic_key"]
    r = requests.withColumn("hash", content_hash(F.lit(""), F.col("title"), F.col("content")))
    w = Window.partitionBy(*key).orderBy("seq")
    r = r.withColumn("_new", F.coalesce(F.lag("hash").over(w) != F.col("hash"), F.lit(True)))
    return r.groupBy(*key).agg(
        F.max_by("title", "seq").alias("title"),
        F.max_by("content", "seq").alias("content"),
        F.max("pinned").alias("pinned"),
        F.count_if("_new").alias("revision_count"),
        F.count("*").alias("saves"),
    )

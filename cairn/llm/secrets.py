"""Secret scan: fixed patterns, and a grammar inferred from what they find.

The patterns of PATTERNS give the base spans. Their values are labelled credentials: of each kind a bounded sample of
distinct values (lowest hashes first) is halved: one half is laid out as a prefix tree over character classes, whose
states are merged where the Hoeffding test finds their futures compatible (state merging after Carrasco and Oncina); the
other half sets the likelihood that is asked for. Every token of the corpus that no base span touches, of as many
characters as the patterns ask for at least, is a candidate: it becomes a span of kind "grammar" where some automaton finds it about as likely per
character as all but the least likely labelled credentials.

The table is read twice, for the sample and for the spans; between the two only the sample travels, and no
credential is written to the shared folder.

Cases: a null or empty text has no spans and the digest of the empty string; without labelled credentials of a kind that
kind has no automaton; rows are judged one by one, so repeated ones agree; texts of any length are read whole; an empty
table gives an empty one; only doc_id and text are read of the input.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex")
#: kind, pattern, group whose length counts, its least length (fixed values).
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]{16,}"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
#: What may be a credential: as long as the shortest that a pattern takes.
TOKEN = re.compile("[A-Za-z0-9+/_.=-]{%d,}" % min(least for *_, least in PATTERNS))
#: Tokens whose verdict a worker keeps, and tasks that thin out the samples of all others.
KEPT_TOKENS, THINNERS = 500_000, 64


@dataclass(frozen=True)
class SecretParams:
    #: Labelled credentials of each kind: every second one, by hash, makes the automaton, the others its limit.
    sample: int = 400
    #: Significance of the Hoeffding test, and the share of labelled credentials below the likelihood that is asked for.
    alpha: float = 0.05
    tail: float = 0.02


def _classes() -> dict[str, tuple[str, float]]:
    groups = {"d": "0123456789", "a": "abcdef", "g": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "G": "GHIJKLMNOPQRSTUVWXYZ", "s": "+/=", "u": "_-", ".": "."}
    return {c: (name, -math.log(len(chars))) for name, chars in groups.items() for c in chars}


CLASSES = _classes()


class Automaton:
    """A probabilistic automaton; states are rows of counts: passes, ends, and per class (count, next state)."""

    def __init__(self, values: list[str], alpha: float):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.passes, self.ends, self.next = [0], [0], [{}]
        for v in values:
            s = 0
            self.passes[0] += 1
            for c in v:
                k = CLASSES[c][0]
                n, t = self.next[s].get(k, (0, len(self.passes)))
                if n == 0:
                    self.passes.append(0), self.ends.append(0), self.next.append({})
                self.next[s][k] = (n + 1, t)
                s = t
                self.passes[s] += 1
            self.ends[s] += 1
        self._merge_states()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n1, n2 = self.passes[a], self.passes[b]
            if self._differ(self.ends[a], n1, self.ends[b], n2):
                return False
            for k in self.next[a].keys() | self.next[b].keys():
                (f1, t1), (f2, t2) = self.next[a].get(k, (0, -1)), self.next[b].get(k, (0, -1))
                if self._differ(f1, n1, f2, n2):
                    return False
                if t1 >= 0 and t2 >= 0:
                    todo.append((t1, t2))
        return True

    def _fold(self, into: int, what: int) -> None:
        """Adds the tree below what to the state into."""
        todo = [(into, what)]
        while todo:
            a, b = todo.pop()
            self.passes[a] += self.passes[b]
            self.ends[a] += self.ends[b]
            for k, (f, t) in self.next[b].items():
                if k in self.next[a]:
                    g, s = self.next[a][k]
                    self.next[a][k] = (g + f, s)
                    todo.append((s, t))
                else:
                    self.next[a][k] = (f, t)

    def _merge_states(self) -> None:
        settled, fringe = [0], [(0, k) for k in sorted(self.next[0])]
        while fringe:
            # The most travelled fringe state first: its frequencies are known best.
            fringe.sort(key=lambda x: (self.passes[self.next[x[0]][x[1]][1]], x), reverse=True)
            parent, k = fringe[0]
            count, state = self.next[parent][k]
            home = next((r for r in settled if self._compatible(r, state)), None)
            if home is None:
                settled.append(state)
            else:
                self.next[parent][k] = (count, home)
                self._fold(home, state)
            known = set(settled)
            fringe = [(r, k) for r in settled for k, (_, t) in sorted(self.next[r].items()) if t not in known]

    def likelihood(self, value: str) -> float:
        """Log likelihood per character."""
        s, total = 0, 0.0
        for c in value:
            k, inside = CLASSES[c]
            n, t = self.next[s].get(k, (0, 0))
            total += math.log((n + 0.01) / (self.passes[s] + 0.1)) + inside
            s = t
        total += math.log((self.ends[s] + 0.01) / (self.passes[s] + 0.1))
        return total / (len(value) + 1)


class Grammar:
    """The automata of all kinds, and how likely a token must be."""

    def __init__(self, labelled: dict[str, list[str]], params: SecretParams = SecretParams()):
        self.models: list[tuple[Automaton, float]] = []
        self.known: dict[str, bool] = {}
        for kind in KINDS:
            values = labelled.get(kind, [])
            if len(values) < 2:
                continue
            model = Automaton(values[::2], params.alpha)
            scores = sorted(model.likelihood(v) for v in values[1::2])
            # At least one is left out, as a single odd value must not set the limit; and tokens of other lengths than the
            # labelled ones may stand as far below the tail as the tail does below the median.
            tail, median = scores[min(math.ceil(params.tail * len(scores)), len(scores) - 1)], scores[len(scores) // 2]
            self.models.append((model, tail - (median - tail)))

    def accepts(self, token: str) -> bool:
        if token not in self.known:
            if len(self.known) >= KEPT_TOKENS:
                self.known.clear()
            self.known[token] = any(m.likelihood(token) >= least for m, least in self.models)
        return self.known[token]

    def spans(self, text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
        """Accepted tokens that touch no base span."""
        if not self.models:
            return []
        likely = {t for t in set(TOKEN.findall(text)) if self.accepts(t)}
        if not likely:
            return []
        # Base spans come by start; how far those up to each one reach is enough to tell whether a token touches one.
        starts, reach = [x[1] for x in base], list(accumulate((x[2] for x in base), max))
        found = (m.span() for m in TOKEN.finditer(text) if m[0] in likely)
        return [(a, b) for a, b in found if not (k := bisect_left(starts, b)) or reach[k - 1] <= a]


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind number, start, end, value) by start, then kind."""
    found = []
    for i, (kind, pattern, group, least) in enumerate(PATTERNS):
        if kind == "assign" and ":" not in text and "=" not in text:
            continue
        found += [(i, m.start(), m.end(), m[group]) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda x: (x[1], x[0]))


SAMPLE = "part int, kind int, rank long, value string"


def _rank(value: str) -> int:
    """Order of values: a hash as a signed number, as Spark's xxhash64 gives it."""
    h = xxhash.xxh64_intdigest(value.encode(), seed=42)
    return h - 2**64 if h >= 2**63 else h


def _lowest(sample: int):
    """Of each kind the distinct values with the lowest hashes, from texts or from rows of SAMPLE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[set[tuple[int, str]]] = [set() for _ in KINDS]

        def take(kind: int, rank: int, value: str) -> None:
            kept[kind].add((rank, value))
            if len(kept[kind]) >= 4 * sample:
                kept[kind] = set(sorted(kept[kind])[:sample])

        for batch in batches:
            if "text" in batch.schema.names:
                for text in batch.column("text").to_pylist():
                    for kind, _, _, value in base_spans(text) if text else ():
                        take(kind, _rank(value), value)
            else:
                for x in batch.to_pylist():
                    take(x["kind"], x["rank"], x["value"])
        rows = [(rank % THINNERS, kind, rank, value) for kind, own in enumerate(kept) for rank, value in sorted(own)[:sample]]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["part", "kind", "rank", "value"])

    return run


def labelled_values(docs: DataFrame, params: SecretParams = SecretParams()) -> dict[str, list[str]]:
    """Of each kind the `sample` distinct values with the lowest hashes: a task's, then those of all tasks."""
    rows = docs.select("text").mapInArrow(_lowest(params.sample), SAMPLE)
    rows = rows.repartition(THINNERS, "part").mapInArrow(_lowest(params.sample), SAMPLE).collect()  # THINNERS samples at most
    return {kind: [r.value for r in sorted((r for r in rows if r.kind == i), key=lambda r: (r.rank, r.value))[: params.sample]] for i, kind in enumerate(KINDS)}


def scan(docs: DataFrame, params: SecretParams = SecretParams()) -> DataFrame:
    """doc_id, the counts, base (string of base spans), spans (string of all spans) and n_grammar."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    grammar = docs.sparkSession.sparkContext.broadcast(Grammar(labelled_values(docs, params), params))  # its size is bounded by the sample

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base_out, all_out, n = ([], [], []), [], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                more = grammar.value.spans(text, base) if text else []
                for i, c in enumerate(counts):
                    c.append(sum(x[0] == i for x in base))
                fixed = [(a, k, b) for k, a, b, _ in base]
                names = (*KINDS, "grammar")
                for out, found in ((base_out, fixed), (all_out, sorted([*fixed, *((a, len(KINDS), b) for a, b in more)]))):
                    out.append(",".join(f"{names[k]}:{a}:{b}" for a, k, b in found))
                n.append(len(more))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_out, pa.string()), pa.array(all_out, pa.string()), pa.array(n, pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans", "n_grammar"],
            )

    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base string, spans string, n_grammar long")

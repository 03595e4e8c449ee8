"""Toxicity by a logistic model that counterfactuals regularise.

A text is the set of its hashed words and of their first three, four and five letters. Features that part the labelled
classes (a z score of `least_z` or more) get a weight; what most texts hold by chance gets none, so a very long text isn't
toxic for its length. Identity terms of labelled sentences are swapped with others of their group, and the square of the
change of the logit is penalised: a mention of a group moves no score, whatever the labels say about texts that have one.

The fit takes `per_class` labelled documents of each class at most, lowest hashes of doc_id first, one text each, and
the intercept is shifted to the classes' true shares. Texts stay where they are read: the sample's ids are broadcast (a
bounded table), features are counted in a table of fixed size, and the driver gets the weighted features of the sample.

Cases: a null or empty text, or one without letters, has the score of no feature; labels null in either column are no
labels; an id with labels of both classes is toxic; labels without a document give no example; of texts with one doc_id the
one with the smallest digest is the example; without two classes every score is their share (0.0 without labels); texts of
any length are read whole, in slices cut between words; repeated rows get one score; an empty table gives an empty one;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .language_id import _letters

WIDTH = 1 << 18
PREFIXES = (3, 4, 5)
SLICE_CHARS = 1_000_000
_M = 0x9E3779B97F4A7C15
_M_INVERSE = pow(_M, -1, 1 << 64)

#: Terms that name groups of people, by kind (fixed values, lower case).
IDENTITY_TERMS = {
    "religion": "christian muslim jewish hindu buddhist sikh catholic atheist".split(),
    "believers": "christians muslims jews hindus buddhists sikhs catholics atheists".split(),
    "origin": "african american arab asian chinese european french german indian mexican polish russian spanish turkish".split(),
    "colour": "black white brown".split(),
    "gender": "woman man girl boy".split(),
    "genders": "women men girls boys".split(),
    "orientation": "gay lesbian straight bisexual transgender queer heterosexual".split(),
    "standing": "immigrants refugees foreigners natives citizens".split(),
    "age": "old young elderly".split(),
    "ability": "deaf blind disabled autistic".split(),
}


@dataclass(frozen=True)
class ToxicParams:
    per_class: int = 4096
    least_z: float = 5.0
    ridge: float = 2e-4
    counterfactual: float = 10.0
    swaps: int = 3
    sentences: int = 8
    rounds: int = 600
    terms: dict = field(default_factory=lambda: IDENTITY_TERMS)


def _slices(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in portions of about SLICE_CHARS, with the number of the text each part is of; long ones cut between words."""
    owners, parts, n = [], [], 0
    for i, text in enumerate(texts):
        at, text = 0, text or ""
        while at < len(text):
            end = min(at + SLICE_CHARS, len(text))
            while end < len(text) and text[end].isalpha():
                end += 1
            owners.append(i)
            parts.append(text[at:end].lower())
            n, at = n + end - at, end
            if n >= SLICE_CHARS:
                yield owners, parts
                owners, parts, n = [], [], 0
    if parts:
        yield owners, parts


def features(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of lower-case texts, repeats included, and the text each is of."""
    code = np.frombuffer((" ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(parts)), [len(p) + 1 for p in parts])
    letter = _letters()[code]
    before = np.r_[False, letter[:-1]]
    start, end = np.flatnonzero(letter & ~before), np.flatnonzero(~letter & before)
    power = np.cumprod(np.full(len(code), _M, np.uint64))
    total = np.r_[np.uint64(0), np.cumsum(code.astype(np.uint64) * power)]
    back = np.cumprod(np.full(len(code), _M_INVERSE, np.uint64))[start]
    found, of = [], []
    for k in (0, *PREFIXES):
        own = end - start >= k
        h = (total[start[own] + k if k else end[own]] - total[start[own]]) * back[own] + np.uint64(k)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append((h ^ (h >> np.uint64(32))) & np.uint64(WIDTH - 1))
        of.append(owner[start[own]])
    return np.concatenate(found).astype(np.int64), np.concatenate(of)


def distinct(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text, and the texts; only those marked in wanted, where that is given."""
    keys = [np.zeros(0, np.int64)]
    for owners, parts in _slices(texts):
        feature, of = features(parts)
        if wanted is not None:
            keep = wanted[feature]
            feature, of = feature[keep], of[keep]
        keys.append(np.unique(np.array(owners)[of] * WIDTH + feature))
    key = np.unique(np.concatenate(keys))
    return key % WIDTH, key // WIDTH


_WORD, _SENTENCE = re.compile(r"[^\W\d_]+"), re.compile(r"[^.!?\n]+")


def counterfactuals(text: str | None, params: ToxicParams) -> Iterator[tuple[str, str]]:
    """Sentences of a text that name a group, each with its terms swapped for others of their kinds."""
    kinds = {term: (kind, i) for kind in params.terms.values() for i, term in enumerate(kind)}
    found = 0
    for m in _SENTENCE.finditer((text or "").lower()):
        if found == params.sentences:
            return
        sentence = m[0]
        if not any(w[0] in kinds for w in _WORD.finditer(sentence)):
            continue
        found += 1
        for k in range(1, params.swaps + 1):

            def swapped(w: re.Match) -> str:
                kind, i = kinds.get(w[0], ((w[0],), 0))
                return kind[(i + k) % len(kind)]

            other = _WORD.sub(swapped, sentence)
            if other != sentence:
                yield sentence, other


def _sampler(params: ToxicParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            feature, of = distinct(texts)
            cut = np.searchsorted(of, np.arange(len(texts) + 1))
            own, plus, minus = [], [], []
            for t, text in enumerate(texts):
                own.append(feature[cut[t] : cut[t + 1]].astype(np.int32))
                pairs = list(counterfactuals(text, params))
                f, side = distinct([s for pair in pairs for s in pair])
                ends = np.searchsorted(side, np.arange(2 * len(pairs) + 1))
                sets = [set(f[ends[i] : ends[i + 1]].tolist()) for i in range(2 * len(pairs))]
                plus.append([sorted(b - a) for a, b in zip(sets[::2], sets[1::2])])
                minus.append([sorted(a - b) for a, b in zip(sets[::2], sets[1::2])])
            lists = pa.list_(pa.list_(pa.int32()))
            cols = [batch.column("doc_id"), batch.column("digest"), batch.column("toxic"), pa.array(own, pa.list_(pa.int32())), pa.array(plus, lists), pa.array(minus, lists)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "digest", "toxic", "features", "plus", "minus"])

    return run


@dataclass(frozen=True)
class ToxicModel:
    weights: np.ndarray
    intercept: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        feature, of = distinct(texts, self.weights != 0)
        margin = np.bincount(of, self.weights[feature], len(texts)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([f for x in lists for f in x], np.int64)


def fit(examples: list, toxic: np.ndarray, plus: list, minus: list, params: ToxicParams) -> ToxicModel:
    """Accelerated gradient descent on logistic loss, ridge and squared changes of the logit under swaps."""
    row, col = _flat(examples)
    up, down = _flat(plus), _flat(minus)
    pair, swap = np.r_[up[0], down[0]], np.r_[up[1], down[1]]
    sign = np.r_[np.ones(len(up[0])), -np.ones(len(down[0]))]
    known, at = np.unique(np.concatenate([col, swap]), return_inverse=True)
    col, swap = at[: len(col)], at[len(col) :]
    n, k, y = len(examples), len(known), toxic.astype(float)
    weigh = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))

    def slope(w: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], n) + w[k], -500, 500)))
        off = weigh * (p - y)
        g = np.r_[np.bincount(col, off[row], k), off.sum()] + params.ridge * np.r_[w[:k], 0]
        if len(plus):
            change = np.bincount(pair, w[swap] * sign, len(plus))
            g[:k] += params.counterfactual * np.bincount(swap, change[pair] * sign, k) / len(plus)
        return g

    v = np.ones(k + 1)
    steep = 1.0
    for _ in range(30):  # the largest curvature, by power iteration
        g = np.r_[np.bincount(col, (weigh * (np.bincount(row, v[col], n) + v[k]) / 4)[row], k), (weigh * (np.bincount(row, v[col], n) + v[k])).sum() / 4] + params.ridge * v
        if len(plus):
            g[:k] += params.counterfactual * np.bincount(swap, np.bincount(pair, v[swap] * sign, len(plus))[pair] * sign, k) / len(plus)
        steep = float(np.sqrt((g**2).sum()))
        v = g / max(steep, 1e-12)
    w = last = np.zeros(k + 1)
    for i in range(params.rounds):
        ahead = w + i / (i + 3) * (w - last)
        last, w = w, ahead - slope(ahead) / (1.1 * steep)
    weights = np.zeros(WIDTH)
    weights[known] = w[:k]
    return ToxicModel(weights, float(w[k]))


def train(docs: DataFrame, labels: DataFrame, params: ToxicParams = ToxicParams()) -> ToxicModel:
    """Fits on documents that labels(doc_id, toxic) marks; rows that aren't to be learnt from must be left out of labels."""
    known = labels.filter(labels["doc_id"].isNotNull() & labels["toxic"].isNotNull()).groupBy(labels["doc_id"].alias("_id")).agg(F.max((labels["toxic"] > 0).cast("int")).alias("toxic"))
    share = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(share) < 2:
        return ToxicModel(np.zeros(WIDTH), 500.0 if share.get(1) else -500.0)
    drawn = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(params.per_class) for c in (0, 1)]
    rows = docs.select(docs["doc_id"], docs["text"]).join(F.broadcast(drawn[0].union(drawn[1])), F.col("doc_id") == F.col("_id"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, digest binary, toxic int, features array<int>, plus array<array<int>>, minus array<array<int>>"
    found = rows.select("doc_id", "toxic", "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest")).mapInArrow(_sampler(params), schema)
    sample = staged(found.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "features", "plus", "minus"), "digest").alias("x")).select("x.*"), "toxic-sample")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return ToxicModel(np.zeros(WIDTH), float(np.log(share[1] / share[0])))
    counts = sample.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count("*").alias("n")).toArrow()
    f, a, b = (counts.column(c).to_numpy() for c in ("f", "a", "n"))
    b = b - a
    p = (a + b) / (n[0] + n[1])
    z = (a / n[1] - b / n[0]) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n[1] + 1 / n[0]))
    wanted = docs.sparkSession.sparkContext.broadcast(set(f[np.abs(z) >= params.least_z].tolist()))

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: batch.column(c).to_pylist() for c in ("features", "plus", "minus")}
            own = [[x for x in fs if x in wanted.value] for fs in out["features"]]
            sides = [[[[x for x in fs if x in wanted.value] for fs in pairs] for pairs in out[c]] for c in ("plus", "minus")]
            lists = pa.list_(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(own, pa.list_(pa.int32())), pa.array(sides[0], lists), pa.array(sides[1], lists)], names=["toxic", "features", "plus", "minus"])

    rows = sample.mapInArrow(weighted, "toxic int, features array<int>, plus array<array<int>>, minus array<array<int>>").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["toxic"], r["features"], r["plus"], r["minus"]))
    model = fit([r["features"] for r in rows], np.array([r["toxic"] for r in rows]), [x for r in rows for x in r["plus"]], [x for r in rows for x in r["minus"]], params)
    return ToxicModel(model.weights, model.intercept + float(np.log(share[1] / share[0])))


def toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id and score of each row; only doc_id and text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH weights
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(batch.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")

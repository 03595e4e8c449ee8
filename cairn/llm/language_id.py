"""Hierarchical language identification: family first, then one-versus-one linear SVMs within it.

A text is the mean of its hashed letter n-grams (1 to 3 letters, lower case, runs of other characters as one space), so a
text of any length is scored whole with one weight per n-gram and classifier. One-versus-rest linear SVMs pick the
family; in a family of several languages one-versus-one SVMs vote, with the summed margins and then the code deciding
ties. The SVMs are fitted on a bounded sample of labelled documents of every language there is: of each the documents with
the lowest hashes of id and text, per_lang of them, or fewer (never under least_per_lang) where max_rows over all languages
would be passed. Languages beyond the family table make families of their own.

Cases: a text that is null or has no letter is "und" with score 0; without labelled documents everything is "und"; with
one language only, that one is predicted; repeated rows get one answer and count once as examples; null ids are ids like
others; texts of any length are read whole; an empty table gives an empty one; only doc_id, text and lang are read, lang
of training rows alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Language codes by family (fixed values).
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is lb fy yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be bg mk sr hr bs sl sk cs pl".split(),
    "turkic": "tr az kk uz ky tk tt".split(),
    "indic": "hi bn ur pa gu mr ne si".split(),
    "uralic": "fi et hu".split(),
    "semitic": "ar he mt am".split(),
    "baltic": "lt lv".split(),
    "celtic": "ga cy gd br".split(),
}
#: Hashed features of one, two and three letters.
SIZES = (1 << 10, 1 << 12, 1 << 13)
WIDTH = sum(SIZES)
SLICE_CHARS = 1_000_000


@dataclass(frozen=True)
class LangParams:
    per_lang: int = 300
    max_rows: int = 6000
    least_per_lang: int = 8
    C: float = 10.0
    rounds: int = 60

    def rows_of(self, n_langs: int) -> int:
        return max(min(self.per_lang, self.max_rows // max(n_langs, 1)), self.least_per_lang)


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER.any():
        _LETTER[:] = [chr(c).isalpha() for c in range(0x110000)]
    return _LETTER


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of all texts in a row, the text each belongs to, and whether each text has a letter."""
    joined = " ".join((t or "").lower() for t in texts) + " "
    sizes = np.array([len((t or "").lower()) + 1 for t in texts], np.int64)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts)), sizes)
    letter = _letters()[code]
    code = np.where(letter, code, np.uint32(32))
    keep = letter | np.r_[True, letter[:-1]]
    code, text, letter = code[keep].astype(np.uint64), text[keep], letter[keep]
    has = np.bincount(text, letter, len(texts)) > 0
    one = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)
    found, owner = [one[letter]], [text[letter]]
    key = code
    for n, (size, offset) in enumerate(zip(SIZES[1:], np.cumsum(SIZES)[:-1]), 2):
        key = key[:-1] * np.uint64(0x100000001B3) + code[n - 1 :]
        own = (text[: 1 - n] == text[n - 1 :]) & (letter[: 1 - n] | letter[n - 1 :])
        found.append((((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())) + np.uint64(offset))[own])
        owner.append(text[n - 1 :][own])
    return np.concatenate(found).astype(np.int64), np.concatenate(owner), has


def _svm(gram: np.ndarray, y: np.ndarray, C: float, rounds: int) -> np.ndarray:
    """Dual weights (times label) of a linear SVM with squared hinge loss, by coordinate descent."""
    n = len(y)
    a, score, order = np.zeros(n), np.zeros(n), np.random.default_rng(5)
    diag = gram.diagonal() + 0.5 / C
    for _ in range(rounds):
        for i in order.permutation(n):
            step = max(a[i] - (y[i] * score[i] - 1 + a[i] * 0.5 / C) / diag[i], 0.0) - a[i]
            if step:
                a[i] += step
                score += step * y[i] * gram[i]
    return a * y


class Model:
    """Weights per feature for each family and each pair of languages of a family."""

    def __init__(self, x: np.ndarray, langs: list[str], params: LangParams = LangParams()):
        self.langs = sorted(set(langs))
        families = sorted({family_of(c) for c in self.langs})
        self.families = [(f, [c for c in self.langs if family_of(c) == f]) for f in families]
        self.pairs = [(i, p) for i, (_, own) in enumerate(self.families) for p in combinations(own, 2)]
        mean = x.mean(0) if len(x) else np.zeros(WIDTH)
        scale = 1 / np.sqrt(mean + 1e-5)
        z = x * scale
        norm = np.sqrt((z**2).sum(1)).mean() if len(z) else 1.0
        z, scale = z / norm, scale / norm
        lang = np.array(langs)
        fam = np.array([families.index(family_of(c)) for c in langs], int)
        gram = z @ z.T + 1.0

        def fit(rows: np.ndarray, y: np.ndarray) -> np.ndarray:
            a = _svm(gram[np.ix_(rows, rows)], y, params.C, params.rounds)
            return np.r_[(a @ z[rows]) * scale, a.sum()]

        every = np.arange(len(x))
        cols = [fit(every, np.where(fam == i, 1.0, -1.0)) for i in range(len(families))] if len(families) > 1 else []
        cols += [fit(r := np.flatnonzero(np.isin(lang, p)), np.where(lang[r] == p[0], 1.0, -1.0)) for _, p in self.pairs]
        self.weights = np.array(cols).T.astype(np.float32) if cols else np.zeros((WIDTH + 1, 0), np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        feature, owner, has = ngrams(texts)
        n, k = len(texts), self.weights.shape[1]
        total = np.maximum(np.bincount(owner, minlength=n), 1)
        margin = np.stack([np.bincount(owner, self.weights[feature, j], n) / total + self.weights[-1, j] for j in range(k)], 1) if k else np.zeros((n, 0))
        sure = 1 / (1 + np.exp(-2 * np.clip(margin, -30, 30)))
        n_fam = len(self.families) if len(self.families) > 1 else 0
        out, score = ["und"] * n, [0.0] * n
        for t in np.flatnonzero(has) if self.langs else ():
            f = int(margin[t, :n_fam].argmax()) if n_fam else 0
            p = sure[t, f] if n_fam else 1.0
            own = self.families[f][1]
            votes = {c: [0, 0.0] for c in own}
            mean = dict.fromkeys(own, 0.0)
            for j, (of, (a, b)) in enumerate(self.pairs, n_fam):
                if of == f:
                    m, s = float(margin[t, j]), float(sure[t, j])
                    for c, mm, ss in ((a, m, s), (b, -m, 1 - s)):
                        votes[c][0] += mm > 0
                        votes[c][1] += mm
                        mean[c] += ss / max(len(own) - 1, 1)
            best = min(own, key=lambda c: (-votes[c][0], -votes[c][1], c))
            out[t], score[t] = best, float(p * (mean[best] if len(own) > 1 else 1.0))
        return out, score


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= SLICE_CHARS:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def train(docs: DataFrame, params: LangParams = LangParams()) -> Model:
    """Fits on rows of docs with a lang, params.rows_of(languages) documents of each language at most."""
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / F.lit(float(1 << 53))
    known = docs.filter(F.col("lang").isNotNull()).select("text", "lang", draw.alias("_draw"))
    # Repeated rows have one draw, so distinct draws are what a share is taken of (within 2%, which the margin covers).
    counts = known.groupBy("lang").agg(F.approx_count_distinct("_draw", 0.02).alias("n")).collect()
    if not counts:
        return Model(np.zeros((0, WIDTH)), [], params)
    wanted = params.rows_of(len(counts))
    # Hash order within a language: the share below this threshold holds the wanted documents, with a margin for chance.
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, (wanted + 6 * wanted**0.5) / max(r["n"] * 0.94, 1))))])
    chosen = known.filter(F.col("_draw") < share[F.col("lang")]).dropDuplicates(["lang", "_draw"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("text").to_pylist()
            for a, b in _slices(whole):
                feature, owner, has = ngrams(whole[a:b])
                rows = []
                for t in range(b - a):
                    ids, n = np.unique(feature[owner == t], return_counts=True)
                    rows.append((ids.astype(np.int16).tobytes(), n.astype(np.int32).tobytes()) if has[t] else (None, None))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("_draw"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "draw", "ids", "n"])

    # At most the wanted rows and the margin come to the driver, as counts of features.
    rows = chosen.mapInArrow(features, "lang string, draw double, ids binary, n binary").filter("ids is not null").collect()
    rows.sort(key=lambda r: (r.lang, r.draw, r.ids))
    x, langs, taken = [], [], {}
    for r in rows:
        taken[r.lang] = taken.get(r.lang, 0) + 1
        if taken[r.lang] <= wanted:
            v = np.zeros(WIDTH, np.float32)
            n = np.frombuffer(r.n, np.int32)
            v[np.frombuffer(r.ids, np.int16)] = n / n.sum()
            x.append(v)
            langs.append(r.lang)
    return Model(np.array(x).reshape(-1, WIDTH), langs, params)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each row; only doc_id and text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH weights for each family and pair
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("text").to_pylist()
            for a, b in _slices(whole):
                lang, score = shared.value.predict(whole[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")

"""WordPiece against a plain version, and folding of accents."""

import random
import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from cairn.functions import text as tx
from cairn.sources import wordpiece

TEXTS = "id long, text string"


def plain(text, vocabulary):
    """One character and one piece after the other."""
    chars = []
    for c in text or "":
        if c not in "\t\n\r" and (c == "\ufffd" or unicodedata.category(c) in ("Cc", "Cf")):
            continue
        chars.append(f" {c} " if 0x4E00 <= ord(c) <= 0x9FFF or 0x3400 <= ord(c) <= 0x4DBF or 0x20000 <= ord(c) <= 0x2A6DF else c)
    bare = "".join(c for c in unicodedata.normalize("NFD", "".join(chars).lower()) if unicodedata.category(c) != "Mn")
    out, word = [], ""
    for c in bare + " ":
        sign = unicodedata.category(c)[0] in "PS"
        if sign or re.match(r"\\s", c) or c.isspace():
            out += [word] * bool(word) + [c] * sign
            word = ""
        else:
            word += c
    ids = []
    for w in out:
        found, start = [], 0
        while start < len(w) <= 100:
            end = next((e for e in range(len(w), start, -1) if ("##" if start else "") + w[start:e] in vocabulary), None)
            if end is None:
                found = None
                break
            found.append(vocabulary[("##" if start else "") + w[start:end]])
            start = end
        ids += found or []
    return ids


VOCABULARY = {p: i for i, p in enumerate("a ab abc ##c ##cd ##d the ##e ##s run ##ning e ##te z ##z 日 本 ! - # ## ##! o ##o u ss ##ss".split())}


def test_tokens(spark):
    rng = random.Random(1)
    pool = [*"abcdezestouning", "é", "É", "ü", "日", "本", " ", " ", "\t", "-", "!", "#", "\u200b", "\x01", "\ufffd", "e\u0301", "\u00a0", "the ", "running ", "ß"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(120)] + ["abcd theses running", "abc" * 40 + " the", None, "", "日本 the", "Thé été ÉTÉ"]
    got = {r.id: r.tokens for r in wordpiece.tokens(spark.createDataFrame(list(enumerate(texts)), TEXTS), VOCABULARY).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain(t, VOCABULARY), (t, got[i])
    assert sum(map(len, got.values())) > 200


def test_embeddings_are_the_sum_of_token_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=5) for i in range(1, len(VOCABULARY))}
    texts = ["abc the run", "abc abc! the", "a", "zzz", None, "qqq"]
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "token int, vector array<double>")
    got = {r.id: np.array(r.embedding) for r in wordpiece.wordpiece_embedding(spark.createDataFrame(list(enumerate(texts)), TEXTS), VOCABULARY, table).collect()}
    for i, t in enumerate(texts):
        ids = [k for k in plain(t, VOCABULARY) if k in vectors]
        if ids:
            total = sum(vectors[k] for k in ids)
            assert np.allclose(got[i], total / np.linalg.norm(total))
        else:
            assert i not in got


def test_folding(spark):
    texts = ["Café déjà ÉTÉ ñandú Straße", "e\u0301\u0327 x", "plain", None, "Ǆ ﬁ ø đ ½ 한", "ΆΈ Йй"]
    bare = lambda t: None if t is None else "".join(b[0] if len(b := [c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"]) == 1 else x if b else "" for x in t)
    got = [r.f for r in spark.createDataFrame(list(enumerate(texts)), TEXTS).select(tx.folded(F.col("text")).alias("f")).collect()]
    assert got == [bare(t) for t in texts] and got[0] == "Cafe deja ETE nandu Straße"

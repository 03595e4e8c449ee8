"""The pipeline against plain versions of its stages, row by row."""

import collections
import random

import plain
import xxhash
from pyspark.sql import functions as F

from cairn.llm import ngram_join, pieces, quality_rules


def digest(text):
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - 2**64 if h >= 2**63 else h


def corpus():
    rng = random.Random(9)
    vocab = "alpha beta gamma delta epsilon zeta eta theta iota kappa the of and to".split()
    prose = lambda n: " ".join(rng.choice(vocab) + str(rng.randint(0, 99)) for _ in range(n))
    texts = [prose(90) for _ in range(30)]
    texts += [t + " tail" for t in texts[:6]] + ["short text", None, "", "\n".join(["x " * 30] * 5)]
    texts += [" ".join(x.upper() + "!!" for x in prose(80).split()) for _ in range(4)] + [prose(60) + " # | # * " * 60]
    shared = "\n".join(prose(12) for _ in range(3))
    texts += [f"{prose(60)}\n{shared}\n{prose(60)}" for _ in range(3)] + ["\n".join([prose(20)] * 3 + [prose(70)])]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    odd = prose(70)
    # Null and repeated ids, with equal and with different texts.
    rows += [(None, odd, "en", "s1", 1), (None, odd, "en", "s1", 1), (None, prose(70), None, "s0", None), (3, prose(70), "en", "s2", 9), (3, texts[3], "en", "s0", 8), (5, texts[20] + " more", "de", "s1", 7)]
    return rows


def test_stages_against_plain_versions(spark, tmp_path):
    import corpus_pipeline

    given = corpus()
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("rows", F.lit("extra")).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        found = [tuple(r) for r in docs.collect()]
        assert all(r[5] == "extra" for r in found)
        seen[name] = [r[:5] for r in found]

    verdict = plain.quality([r[1] for r in given])
    kept = [r for r, (k, _) in zip(given, verdict) if k]
    assert collections.Counter(seen["quality_rules"]) == collections.Counter(kept) and 20 < len(kept) < len(given) - 8

    texts = plain.line_dedup([(r[0], r[1]) for r in kept], digest)
    left = [(r[0], t, *r[2:4], len(t)) if t != r[1] else r for r, t in zip(kept, texts) if t == r[1] or plain.words(t)]
    same = lambda rows: collections.Counter((r[0], r[1], r[2], r[3], len(r[1])) for r in rows)
    assert same(seen["line_dedup"]) == same(left) and sum(t != r[1] for r, t in zip(kept, texts)) >= 2

    group = plain.near_groups([r[1] for r in left])
    first = {}
    for g, r in zip(group, left):
        key = (r[0] is None, r[0] or 0, digest(r[1]))
        first[g] = min(first.get(g, (key, r)), (key, r), key=lambda x: x[0])
    ids = lambda rows: collections.Counter((r[0], r[1]) for r in rows)
    assert ids(seen["ngram_join"]) == ids(r for _, r in first.values()) and len(first) < len(left) - 5

    mine = seen["ngram_join"]
    size = collections.Counter()
    for r in mine:
        size[r[3]] += len(plain.words(r[1]))
    target = plain.targets(size)
    taken, copies = collections.Counter(), collections.Counter(seen["mixing"])
    for r, n in copies.items():
        assert n <= 3 and r in mine
        taken[r[3]] += n * len(plain.words(r[1]))
    assert all(abs(taken[s] - target[s]) <= max(len(plain.words(r[1])) for r in mine if r[3] == s) + 1 for s in size)
    for r in mine:
        mean = target[r[3]] / size[r[3]]
        assert int(mean + 1e-9) <= copies[r] <= -int(-mean // 1)

    done = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(tuple(r)[:5] for r in done) == copies
    vocabulary = pieces.Vocabulary(pieces.MODEL, 1.5)
    assert all(b"".join(vocabulary.raw[i] for i in r.pieces) == r.text.encode() and r.lossless and r.n_pieces == len(r.pieces) and r.rows == "extra" for r in done)


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like an operator's own come through every stage as they are."""
    import corpus_pipeline

    given = [r for r in corpus() if r[1]][:12]
    names = "n_lines n_removed n_bytes n_words v kept p_good _text _raw _words total take rows doc in0 in5 component_id place n digest".split()
    docs = spark.createDataFrame([(*r, *range(100, 100 + len(names))) for r in given], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in names))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        new = ["pieces", "n_pieces", "lossless"] if name == "sentencepiece" else []
        assert out.columns == [*docs.columns, *new]
        rows = out.collect()
        assert rows and all(r[c] == 100 + i for r in rows for i, c in enumerate(names)), name
    over = corpus_pipeline.encoding_stage(spark, docs.withColumns({"pieces": F.lit(1), "lossless": F.lit("x")}), "")
    assert over.columns == [*docs.columns, "pieces", "n_pieces", "lossless"] and over.first().lossless is True


def test_quality_against_plain_em(spark):
    given = corpus() * 2
    docs = spark.createDataFrame([(i, r[1]) for i, r in enumerate(given)], "doc_id long, text string")
    want = plain.quality([r[1] for r in given])
    got = {r.doc_id: r for r in quality_rules.quality(docs).collect()}
    assert all(got[i].kept == k and abs(got[i].p_good - p) < 1e-9 for i, (k, p) in enumerate(want))


def test_one_of_each_with_null_and_repeated_ids(spark):
    rng = random.Random(3)
    prose = lambda: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(40))
    a, b, c, d, e = (prose() for _ in range(5))
    rows = [(None, a), (None, b), (7, c), (7, d), (7, d), (3, d + " tail"), (None, c + " tail"), (None, e), (None, e), (8, None), (8, None), (9, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.doc_id, r.text) for r in ngram_join.one_of_each(docs).collect())
    assert got == collections.Counter([(None, a), (None, b), (7, c), (3, d + " tail"), (None, e), (8, None), (8, None), (9, " ")])

"""Manifest, prefix trie and toxicity against plain versions and on odd rows."""

import collections
import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cairn.llm import manifest, prefix_trie, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(r):
    doc_id, text, lang, source, n_chars = r
    return H(*map(field, (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """Root, and the path of each node as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            beside = nodes[i ^ 1] if i ^ 1 < len(nodes) else ""
            paths[k].append((beside, "") if i % 2 else ("", beside))
        nodes, at = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], [i // 2 for i in at]
    return nodes[0], paths


def plain_manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda c: (c is not None, (c or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {c: tree([leaf(r) for r in groups[c]]) for c in langs}
    root, above = tree([trees[c][0] for c in langs])
    return [(r[0], leaf(r), tuple(p + above[i]), trees[c][0], root) for i, c in enumerate(langs) for r, p in zip(groups[c], trees[c][1])]


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest(spark, levels):
    rng = random.Random(4)
    rows = [(i, f"text {i}", rng.choice(["en", "de", "é", "z", None]), "s", i) for i in range(45)]
    rows += [(7, None, "en", None, None), (None, "", "en", "s", 0), (None, "other", "en", "s", 1), (7, "text ▁日\U0010ffff", "en", "s", 2), (9, "x" * 100_000, "lone", "s", 5)]
    rows += [(70, "again", "de", "s", 5)] * 5
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    got = manifest.manifest(docs, levels=levels).collect()
    assert collections.Counter((r.doc_id, r.leaf, tuple(map(tuple, r.path)), r.subroot, r.root) for r in got) == collections.Counter(plain_manifest(rows))


def test_manifest_folds_and_finds_tampering(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else None, "s", i if i % 5 else None) for i in range(40)]
    docs = spark.createDataFrame(rows, DOC)
    claim = manifest.leaf(docs, n_chars=F.when(F.col("doc_id") % 4 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    df = manifest.manifest(docs.withColumn("claim", claim), keep=["doc_id", "claim"], levels=3)
    for r in df.withColumns({"back": manifest.folded("leaf", "path"), "claimed": manifest.folded("claim", "path")}).collect():
        assert r.back == r.root and (r.claimed == r.root) == (r.doc_id % 4 != 0 or r.doc_id % 5 == 0)


def test_manifest_of_one_row_no_row_and_wide_runs(spark):
    one = (3, "a", None, None, 1)
    r = manifest.manifest(spark.createDataFrame([one], DOC)).first()
    assert r.root == r.subroot == r.leaf == leaf(one) and r.path == []
    empty = manifest.manifest(spark.createDataFrame([], DOC))
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "path", "subroot", "root"]
    docs = spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(30)], DOC)
    wide = manifest.manifest(docs, fanout=3, levels=2)
    assert wide.filter(manifest.folded("leaf", "path") == F.col("root")).count() == 30
    assert {len(x.left + x.right) for r in wide.collect() for x in r.path} <= {0, 64, 128}


def plain_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    for t in own.values():
        t.sort()
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c / 100) * 100
        turns = [x[3:] for x in own.get(c - base, [])[:h]] + [x[3:] for x in own[c][h:]]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = []
    for node, convs in members.items():
        below = [v for v in members if v[: len(node)] == node]
        kids = [v for v in below if len(v) == len(node) + 1]
        leaves = sum(not any(len(w) == len(v) + 1 and w[: len(v)] == v for w in below) for v in below)
        saved = sum((len(members[v]) - 1) * (len(v[-1][1]) if v else 0) for v in below)
        up = members[node[:-1]][0] if node else None
        out.append((convs[0], len(node), up, len(convs), len(kids), leaves, saved, H(",".join(map(str, ends[node])))))
    return out


def trie_rows(df):
    return collections.Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize("flush", [2, 200_000])
def test_trie(spark, flush):
    rng = random.Random(8)
    rows = []
    for c in [*range(-205, -195), *range(-4, 25), *range(300, 330), 512, 777, 10**12 + 1]:
        rows += [(c, k, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "é\U0010ffff"])) for k in range(rng.randint(1, 6))]
    same = [(k, "user", f"turn {k}") for k in range(40)]
    rows += [(c, *t) for c in (1005, 1100, 1101, 1205, 1309) for t in same]
    rows += [(5, None, None, None), (5, None, "user", ""), (300, 2, "user", None), (300, 2, "user", "tie"), (None, 0, "user", "no id"), (900, 0, "user", "word " * 50_000)]
    turns = spark.createDataFrame(rows, TURNS).repartition(5)
    assert trie_rows(prefix_trie.prefix_trie(turns, flush_nodes=flush)) == collections.Counter(plain_trie(rows))


def test_trie_of_no_turns_and_clashing_names(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    rows = [(c, k, "user", f"t{k}") for c in (0, 1, 2, 103) for k in range(4)]
    turns = spark.createDataFrame(rows, TURNS)
    names = "base conv turn_sha size node up depth last n first ends far leaves saved _up single n_children _node _above".split()
    assert trie_rows(prefix_trie.prefix_trie(turns.select("*", *[F.lit(1).alias(c) for c in names]))) == trie_rows(prefix_trie.prefix_trie(turns))
    assert not prefix_trie.prefix_trie(turns).filter("conv_id is null").count()


def labelled(rng, n):
    """Toxic texts name a group more often than others do, some with an insult that isn't seen twice, so that a plain model blames
    the group."""
    plain = "the house of was seen near river and some people walk there every day with light".split()
    rows = []
    for i in range(n):
        w = rng.choices(plain, k=30)
        toxic = int(i % 3 == 0)
        if toxic:
            w[rng.randrange(30)] = rng.choice(["scum", "idiot", f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}q{chr(97 + i // 7 % 26)}{chr(97 + i // 11 % 26)}"])
        if rng.random() < (0.9 if toxic else 0.05):
            w[rng.randrange(30)] = "muslims"
        rows.append((i, " ".join(w) + ".", toxic))
    return rows


def test_toxicity_leaves_neutral_mentions_alone(spark):
    rng = random.Random(6)
    rows = labelled(rng, 900)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows if i % 4], "doc_id long, toxic int")
    tests = ["muslims walk near the river every day", "some people walk near the river every day", "the idiot walk there", None, "", "12 34", "christians walk near the river every day"]
    model = toxicity.train(docs, labels)
    fair = model.score(tests)
    plain = toxicity.train(docs, labels, toxicity.ToxicParams(counterfactual=0.0)).score(tests)
    assert fair[0] < 0.3 < plain[0] and fair[2] >= 0.3 and abs(fair[0] - fair[1]) < 0.1 and abs(fair[0] - fair[6]) < 0.1
    assert fair[3] == fair[4] == fair[5] and 0 <= fair[4] < 0.3
    held = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    assert all((held[i] >= 0.3) == bool(x) for i, t, x in rows if not x or "scum" in t or "idiot" in t)


def test_toxicity_reads_long_texts_whole_and_odd_labels(spark):
    rng = random.Random(7)
    rows = labelled(rng, 600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, "another text of this id"), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(0, 0), (None, 1), (5, None), (10**9, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs.withColumn("toxic", F.lit(9)).withColumn("features", F.lit(1)), labels.withColumn("text", F.lit("x")))
    long = "river " * 400_000
    assert model.score([long])[0] < 0.3 < model.score([long + " scum idiot"])[0]
    other = toxicity._slices([long, "a", None])
    assert "".join(p for o, parts in other for i, p in zip(o, parts) if i == 0) == long
    assert toxicity.toxicity(spark.createDataFrame([], DOC), model).count() == 0


def test_toxicity_without_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.score(["a", None]).max() < 1e-6
    ones = toxicity.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert ones.score(["a", None]).min() > 0.999
    far = toxicity.train(docs, spark.createDataFrame([(8, 1), (9, 0), (10, 0)], "doc_id long, toxic int"))
    assert all(abs(far.score(["a", None]) - 1 / 3) < 1e-9)


def test_features_agree_with_words():
    import numpy as np

    parts = ["stupid stu, stup é日本語x", "", "x stupid"]
    f, of = toxicity.features(parts)
    per = [collections.Counter(f[of == i].tolist()) for i in range(3)]
    assert sum(per[0].values()) == (1 + 3) + (1 + 1) + (1 + 2) + (1 + 3) and not per[1]
    whole = toxicity.distinct(["stupid"])[0]
    assert set(whole) <= set(per[0]) and set(whole) <= set(per[2]) and len(whole) == 4
    assert np.array_equal(toxicity.distinct(["STUPID"])[0], whole)

"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes +1 (keep), -1 (reject) or 0 (abstain). Documents are counted by vote pattern (3 ** rules patterns at
most, whatever the corpus), expectation-maximisation over that one table estimates how accurate each rule's votes are on
good and on bad documents, and a document's posterior probability of being good replaces an all-must-pass filter. Rates
stay within stated limits (see step and QualityParams), which for rules that hardly ever err decide the rate.

Cases: a null or empty text has no words and fails the base rule; a null doc_id is an id like others; identical rows get
identical verdicts; an empty table gives an empty result; quality() reads doc_id and text only, and rejected_go() keeps
all columns as they are, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sealed, staged, words_of

SYMBOLS = r"[^#*$%&|<>]+"
#: Function words of common European languages (fixed values).
STOP_WORDS = (
    "the of and to in a is that it for was on are with as by be this at from or an "
    "de la le et les des en un une du que el los y las se del por con "
    "der die und das den von zu mit ist nicht ein eine auf"
).split()


#: Words above which a text's windows keep whole hashes: below, chance makes two of them equal once in 10 ** 8 texts.
LONG_WORDS = 4096


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    prior_good: float = 0.85
    threshold: float = 0.5
    rounds: int = 25
    #: Where the rates of each rule start.
    start: dict = field(default_factory=lambda: {"good_keep": 0.9, "good_reject": 0.01, "bad_keep": 0.7, "bad_reject": 0.25})
    most_good_rejects: float = 0.01
    least_bad_rejects: float = 0.1
    stop_words: tuple[str, ...] = field(default=tuple(STOP_WORDS))


def repeated_window_words(words: Column, n: Column) -> dict[str, Column]:
    """Steps that count the words standing in a 3-word window found twice or more in the same text.

    A window's 64-bit hash gives its low bits to the window's place (10 bits for 1,000 words), so that one sort of a
    primitive array brings equal windows together. Texts of more than LONG_WORDS sort pairs of hash and place instead.
    """
    bits, long = F.col("_bits"), n > LONG_WORDS
    windows, most = lambda f, m: F.transform(F.slice(words, 1, m), f), F.greatest(n - 2, F.lit(0))

    def hashed(w: Column, i: Column) -> Column:
        return F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))

    def equal(p: Column, k: Column) -> Column:
        return F.coalesce(p["h"] == F.get("_pairs", k)["h"], F.lit(False))

    def same(p: Column, k: Column) -> Column:
        return F.coalesce(F.call_function("shiftrightunsigned", p.bitwiseXOR(F.get("_packed", k)), bits) == 0, F.lit(False))

    def covered(a: Column, s: Column) -> Column:
        return F.struct((a["n"] + s + 3 - F.greatest(s, a["end"])).alias("n"), (s + 3).alias("end"))

    return {
        "_bits": F.ceil(F.log2(n + F.lit(2))).cast("int"),
        "_packed": F.sort_array(
            windows(lambda w, i: F.call_function("shiftleft", hashed(w, i), bits).bitwiseOR(i.cast("long")), F.when(long, 0).otherwise(most)),
        ),
        "_pairs": F.sort_array(
            windows(lambda w, i: F.struct(hashed(w, i).alias("h"), i.cast("long").alias("place")), F.when(long, most).otherwise(0)),
        ),
        "_starts": F.sort_array(
            F.concat(
                F.transform(
                    F.filter("_packed", lambda p, k: same(p, k - 1) | same(p, k + 1)),
                    lambda p: p.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1),
                ),
                F.transform(F.filter("_pairs", lambda p, k: equal(p, k - 1) | equal(p, k + 1)), lambda p: p["place"]),
            )
        ),
        "n_repeat_words": F.aggregate("_starts", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), covered)["n"],
    }


def signals(docs: DataFrame, params: QualityParams = QualityParams(), *keep: str) -> DataFrame:
    """Figures of each document that the rules look at, with doc_id and the columns named in keep. What is worked out of a
    text goes as soon as its figures are had, so that a long text's words, lines and windows don't stand side by side."""
    kept = ["doc_id", "_raw", *[c for c in keep if c != "text"]]
    text = F.coalesce("_raw", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = [f(w) for w in params.stop_words for f in (str.lower, str.capitalize, str.upper)]
    df = docs.select("doc_id", F.col("text").alias("_raw"), *kept[2:]).withColumn("_lines", lines)
    figures = {
        "n_symbols": F.length(F.regexp_replace(text, SYMBOLS, "")),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
    }
    df = df.select(*kept, *[c.cast("long").alias(k) for k, c in figures.items()], words_of(F.col("_raw")).alias("_words"))
    kept += figures
    df = df.withColumn("_joined", F.array_join("_words", ""))
    figures = {
        "n_words": F.size("_words"),
        "word_chars": F.length("_joined"),
        "n_upper": F.regexp_count("_joined", F.lit(r"\p{Lu}")),
        "n_shouts": F.length(F.regexp_replace("_joined", "[^!?]+", "")),
        "n_stop_words": F.size(F.array_intersect("_words", F.array(*map(F.lit, dict.fromkeys(stop))))),
    }
    df = df.select(*kept, *[c.cast("long").alias(k) for k, c in figures.items()], "_words")
    kept += figures
    steps = repeated_window_words(F.col("_words"), F.col("n_words").cast("int"))
    df = df.withColumn("_bits", steps["_bits"])
    df = df.select(*kept, "_bits", *[steps[c].alias(c) for c in ("_packed", "_pairs")])
    df = df.select(*kept, steps["_starts"].alias("_starts"))
    df = df.select(*kept, steps["n_repeat_words"].alias("n_repeat_words"))
    out = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_shouts n_stop_words".split()
    return df.select("doc_id", *[F.col("_raw").alias("text") if c == "text" else c for c in keep], *out)


def votes() -> dict[str, Column]:
    """Rule name to its vote, from the figures of signals(). A reject vote needs a strong sign, a keep vote a clear one."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))

    def rule(x: Column, keep_to: float, reject_from: float) -> Column:
        return F.when(x >= reject_from, -1).when(x <= keep_to, 1).otherwise(0)

    mean = chars / n
    return {
        "symbols": rule(F.col("n_symbols") / n, 0.05, 0.3),
        "upper_case": rule(F.col("n_upper") / chars, 0.15, 0.4),
        "shouting": rule(F.col("n_shouts") / n, 0.1, 0.5),
        "repeats": rule(F.col("n_repeat_words") / n, 0.1, 0.3),
        "same_lines": rule(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), 0.05, 0.4),
        "word_length": F.when((mean < 2) | (mean > 16), -1).when((mean >= 3) & (mean <= 10), 1).otherwise(0),
        # Never to reject: a language without a list here has none of these words.
        "stop_words": F.when(F.col("n_stop_words") >= 3, 1).otherwise(0),
    }


def fit(patterns: DataFrame, n_rules: int, params: QualityParams = QualityParams()) -> DataFrame:
    """One row: of each rule how often it votes to keep and to reject good and bad documents, and the share of good
    ones, all by expectation-maximisation. patterns: v (array of votes) and n."""
    start = F.struct(*[F.lit(x).alias(k) for k, x in params.start.items()])
    df = patterns.agg(F.array_sort(F.collect_list(F.struct("v", F.col("n").cast("double").alias("n")))).alias("_p"))

    def step(state: Column, _: Column) -> Column:
        good = F.transform("_p", lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), posterior(x["v"], state["rules"], state["prior"]).alias("g")))

        def total(f) -> Column:
            return F.aggregate(good, F.lit(0.0), lambda a, x: a + x["n"] * f(x))

        def rate(j: Column, vote: int, side) -> Column:
            hits = total(lambda x: F.when(F.get(x["v"], j) == vote, side(x)).otherwise(0.0))
            return F.least(F.lit(0.98), F.greatest(F.lit(0.001), (hits + 0.5) / (total(side) + 1.5)))

        def of(j: Column) -> Column:
            sides = {"good": lambda x: x["g"], "bad": lambda x: 1 - x["g"]}
            rates = {f"{name}_{word}": rate(j, vote, side) for name, side in sides.items() for word, vote in (("keep", 1), ("reject", -1))}
            # What is known of the rules beforehand: a reject vote is seldom wrong on a good document, and a rule may be
            # useless but not turned round.
            rates["good_reject"] = F.least(rates["good_reject"], F.lit(params.most_good_rejects))
            rates["bad_reject"] = F.greatest(rates["bad_reject"], F.lit(params.least_bad_rejects))
            rates["bad_keep"] = F.least(rates["bad_keep"], rates["good_keep"])
            return F.struct(*[c.alias(k) for k, c in rates.items()])

        prior = total(lambda x: x["g"]) / F.greatest(total(lambda x: F.lit(1.0)), F.lit(1.0))
        return F.struct(F.transform(F.sequence(F.lit(0), F.lit(n_rules - 1)), of).alias("rules"), F.least(F.lit(0.99), F.greatest(F.lit(0.5), prior)).alias("prior"))

    first = F.struct(F.array_repeat(start, n_rules).alias("rules"), F.lit(params.prior_good).alias("prior"))
    return df.select(F.aggregate(F.sequence(F.lit(1), F.lit(params.rounds)), first, step).alias("_fit")).select("_fit.rules", "_fit.prior")


def posterior(v: Column, rules: Column, prior: Column) -> Column:
    """Probability that a document with votes v is good."""

    def weight(x: Column, r: Column) -> Column:
        silent = F.greatest(1 - r["good_keep"] - r["good_reject"], F.lit(0.001)) / F.greatest(1 - r["bad_keep"] - r["bad_reject"], F.lit(0.001))
        return F.log(F.when(x > 0, r["good_keep"] / r["bad_keep"]).when(x < 0, r["good_reject"] / r["bad_reject"]).otherwise(silent))

    odds = F.aggregate(F.zip_with(v, rules, weight), F.log(prior / (1 - prior)), lambda s, x: s + x)
    return 1 / (1 + F.exp(-odds))


def quality(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """Figures, votes, p_good, base_failed and kept of each row; the text is read once and not shuffled."""
    figures = staged(signals(docs, params).withColumn("v", F.array(*[v.cast("int") for v in votes().values()])), "quality")
    return judge(figures, params)


def judge(figures: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    base = (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.max_repeat_percent * F.col("n_words"))
    patterns = figures.groupBy("v").agg(F.count("*").alias("n"))
    model = fit(patterns, len(votes()), params)
    # The model is one row and the patterns are 3 ** rules at most, so both are broadcast.
    verdicts = patterns.select("v").crossJoin(F.broadcast(model)).select("v", posterior(F.col("v"), F.col("rules"), F.col("prior")).alias("p_good"))
    df = figures.join(F.broadcast(verdicts), "v")
    return df.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= params.threshold))


def rejected_go(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of docs that are kept, with all their columns. Each row is judged with its figures beside it, so repeated
    and null doc_ids do no harm and no text is shuffled."""
    df, (doc_id, text) = sealed(docs, "doc_id", "text")
    df = df.withColumnsRenamed({doc_id: "doc_id", text: "text"})
    figures = signals(df, params, *[c for c in df.columns if c != "doc_id"]).withColumn("v", F.array(*[v.cast("int") for v in votes().values()]))
    figures = staged(figures, "quality-docs")
    return judge(figures, params).filter("kept").select(*df.columns).toDF(*docs.columns)


def _sql(p: QualityParams = QualityParams()) -> str:
    """The same in SQL, documents being told apart by doc_id: figures, votes, and the rounds over the patterns of votes as a
    recursion over one row."""
    stop = sorted({f(w) for w in p.stop_words for f in (str.lower, str.capitalize, str.upper)})
    some = "regexp_matches({}, '[^\\x20\\x09-\\x0D]')"

    def rule(x: str, keep_to: float, reject_from: float) -> str:
        return f"CASE WHEN {x} >= {reject_from} THEN -1 WHEN {x} <= {keep_to} THEN 1 ELSE 0 END"

    n, chars = "greatest(n_words, 1)", "greatest(word_chars, 1)"
    votes = [
        rule(f"n_symbols / {n}", 0.05, 0.3), rule(f"n_upper / {chars}", 0.15, 0.4), rule(f"n_shouts / {n}", 0.1, 0.5), rule(f"n_repeat_words / {n}", 0.1, 0.3), rule("n_dup_lines / greatest(n_lines, 1)", 0.05, 0.4),
        f"CASE WHEN {chars} / {n} < 2 OR {chars} / {n} > 16 THEN -1 WHEN {chars} / {n} BETWEEN 3 AND 10 THEN 1 ELSE 0 END", "CASE WHEN n_stop >= 3 THEN 1 ELSE 0 END",
    ]
    silent = "greatest(1 - r[j].gk - r[j].gr, 0.001) / greatest(1 - r[j].bk - r[j].br, 0.001)"
    each = f"list_transform(range(1, {len(votes) + 1}), lambda j: ln(CASE WHEN {{v}}[j] > 0 THEN r[j].gk / r[j].bk WHEN {{v}}[j] < 0 THEN r[j].gr / r[j].br ELSE {silent} END))"
    posterior = f"1 / (1 + exp(-(ln(prior / (1 - prior)) + list_sum({each}))))"

    def rate(vote: int, side: str) -> str:
        hits = f"list_sum(list_transform(g, lambda x: CASE WHEN x.v[j] = {vote} THEN x.n * {side} ELSE 0.0 END))"
        return f"least(0.98, greatest(0.001, ({hits} + 0.5) / (list_sum(list_transform(g, lambda x: x.n * {side})) + 1.5)))"

    start = ", ".join(f"{k}: {p.start[name]}::DOUBLE" for k, name in (("gk", "good_keep"), ("gr", "good_reject"), ("bk", "bad_keep"), ("br", "bad_reject")))
    good, bad = "x.g", "(1 - x.g)"
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {some.format("x")}) AS l FROM documents
),
win AS (SELECT doc_id, i, w[i] || chr(0) || w[i + 1] || chr(0) || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1)) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, length(regexp_replace(array_to_string(w, ''), '[^\p{{Lu}}]+', '', 'g')) AS n_upper, length(regexp_replace(array_to_string(w, ''), '[^!?]+', '', 'g')) AS n_shouts,
    len(list_filter({stop!r}, lambda x: list_contains(w, x))) AS n_stop
  FROM d LEFT JOIN rep USING (doc_id)
),
v AS (SELECT *, [{", ".join(votes)}] AS v FROM f),
pat AS (SELECT list({{v: v, n: n::DOUBLE}} ORDER BY v) AS p FROM (SELECT v, count(*) AS n FROM v GROUP BY v)),
em AS (
  SELECT 0 AS i, p, list_transform(range(1, {len(votes) + 1}), lambda j: {{{start}}}) AS r, {p.prior_good}::DOUBLE AS prior FROM pat
  UNION ALL
  SELECT i + 1, p, list_transform(range(1, {len(votes) + 1}), lambda j: {{
      gk: {rate(1, good)}, gr: least({p.most_good_rejects}, {rate(-1, good)}), bk: least({rate(1, bad)}, {rate(1, good)}), br: greatest({p.least_bad_rejects}, {rate(-1, bad)})}}),
    least(0.99, greatest(0.5, list_sum(list_transform(g, lambda x: x.n * x.g)) / greatest(list_sum(list_transform(g, lambda x: x.n)), 1.0)))
  FROM (SELECT i, p, r, prior, list_transform(p, lambda x: {{v: x.v, n: x.n, g: {posterior.format(v="x.v")}}}) AS g FROM em WHERE i < {p.rounds})
),
fit AS (SELECT r, prior FROM em WHERE i = {p.rounds}),
judged AS (SELECT v.*, {posterior.format(v="v.v")} AS p_good, n_words < {p.min_words} OR 100 * n_repeat_words > {p.max_repeat_percent} * n_words AS base_failed FROM v CROSS JOIN fit)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p_good >= {p.threshold} AS kept, round(p_good, 6) AS p_good FROM judged
"""


ORACLE = _sql()

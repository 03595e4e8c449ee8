"""Plain versions of stages, one row or pair at a time."""

import collections
import math
import re

import regex

from cairn.llm.quality_rules import STOP_WORDS, QualityParams


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality_votes(text):
    """The seven rules' votes on a text, and whether the base rule fails."""
    text = text or ""
    w = words(text)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    n, joined = max(len(w), 1), "".join(w)
    chars = max(len(joined), 1)
    stop = {f(x) for x in STOP_WORDS for f in (str.lower, str.capitalize, str.upper)}
    mean = chars / n

    def rule(x, keep_to, reject_from):
        return -1 if x >= reject_from else 1 if x <= keep_to else 0

    votes = (
        rule(sum(c in "#*$%&|<>" for c in text) / n, 0.05, 0.3),
        rule(len(regex.findall(r"\p{Lu}", joined)) / chars, 0.15, 0.4),
        rule(sum(c in "!?" for c in joined) / n, 0.1, 0.5),
        rule(len(cover) / n, 0.1, 0.3),
        rule((len(lines) - len(set(lines))) / max(len(lines), 1), 0.05, 0.4),
        -1 if mean < 2 or mean > 16 else 1 if 3 <= mean <= 10 else 0,
        1 if len(stop & set(w)) >= 3 else 0,
    )
    return votes, len(w) < 50 or 100 * len(cover) > 50 * len(w)


def quality(texts, params=QualityParams()):
    """kept and p_good of each text: expectation-maximisation over the single texts instead of the patterns of votes."""
    judged = [quality_votes(t) for t in texts]
    n_rules = len(judged[0][0])
    rates, prior = [dict(params.start) for _ in range(n_rules)], params.prior_good

    def posterior(votes):
        odds = math.log(prior / (1 - prior))
        for v, r in zip(votes, rates):
            silent = max(1 - r["good_keep"] - r["good_reject"], 0.001) / max(1 - r["bad_keep"] - r["bad_reject"], 0.001)
            odds += math.log(r["good_keep"] / r["bad_keep"] if v > 0 else r["good_reject"] / r["bad_reject"] if v < 0 else silent)
        return 1 / (1 + math.exp(-odds))

    for _ in range(params.rounds):
        good = [posterior(v) for v, _ in judged]
        after = []
        for j in range(n_rules):
            r = {}
            for side, weight in (("good", good), ("bad", [1 - g for g in good])):
                for word, vote in (("keep", 1), ("reject", -1)):
                    hits = sum(x for x, (v, _) in zip(weight, judged) if v[j] == vote)
                    r[f"{side}_{word}"] = min(0.98, max(0.001, (hits + 0.5) / (sum(weight) + 1.5)))
            r["good_reject"] = min(r["good_reject"], params.most_good_rejects)
            r["bad_reject"] = max(r["bad_reject"], params.least_bad_rejects)
            r["bad_keep"] = min(r["bad_keep"], r["good_keep"])
            after.append(r)
        rates, prior = after, min(0.99, max(0.5, sum(good) / len(good)))
    return [(not failed and posterior(v) >= params.threshold, posterior(v)) for v, failed in judged]


def line_dedup(rows, digest):
    """Texts of (id, text) rows without later occurrences of three-line windows. digest gives texts' order among equal ids."""
    first, out = {}, []
    order = sorted({(i is not None, i or 0, digest(t), t) for i, t in rows if t is not None})
    for has, i, _, t in order:
        ls = t.split("\n")
        for k in range(len(ls) - 2):
            if words("".join(ls[k : k + 3])):
                first.setdefault(tuple(ls[k : k + 3]), (has, i, t, k))
    for i, t in rows:
        ls = (t or "").split("\n")
        own = (i is not None, i or 0, t)
        gone = {j for k in range(len(ls) - 2) if words("".join(ls[k : k + 3])) and first[tuple(ls[k : k + 3])] != (*own, k) for j in (k, k + 1, k + 2)}
        out.append("\n".join(x for j, x in enumerate(ls) if j not in gone) if gone else t)
    return out


def near_groups(texts):
    """Group number of each text; texts without a word are alone."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if group[a] != group[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    return group


def targets(size, weights=(1, 2, 3), most=3):
    """Words wanted of each source of a dict source to words: reshare until no target is above its cap."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, target, free = sum(size.values()), {}, set(order)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * size[s]]
        if not over:
            return target | share
        target |= {s: float(most * size[s]) for s in over}
        free -= set(over)

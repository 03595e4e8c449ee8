"""Text transforms as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that make no search term (fixed values).
STOP_WORDS = (
    "a an and are as at be by did do does for from how i in is it of on or our so that the this to was we what when "
    "where which who why with you"
).split()
MAX_TERMS = 16

#: Secret shapes and what takes their place, in order (fixed values, Java syntax).
SECRET_SHAPES = (
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (r"\b(AKIA|ASIA)[0-9A-Z]{16}\b", "[REDACTED_AWS_KEY_ID]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{30,}\b", "[REDACTED_GITHUB_TOKEN]"),
    (r"\bgithub_pat_[A-Za-z0-9_]{40,}\b", "[REDACTED_GITHUB_TOKEN]"),
    (r"\bglpat-[A-Za-z0-9_-]{20,}\b", "[REDACTED_GITLAB_TOKEN]"),
    (r"\bxox[abposr]-[A-Za-z0-9-]{10,}\b", "[REDACTED_SLACK_TOKEN]"),
    (r"\bsk-(?:ant-|proj-)?[A-Za-z0-9_-]{20,}\b", "[REDACTED_API_KEY]"),
    (r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "[REDACTED_JWT]"),
    (r"\b(Bearer|Basic)\s+[A-Za-z0-9._~+/=-]{16,}", "$1 [REDACTED]"),
    (
        r"""(?i)\b([A-Za-z0-9_]*(?:api[_-]?key|secret|token|password|passwd|app[_-]?key)[A-Za-z0-9_]*)(\s*[:=]\s*)(["']?)[^\s"']{8,}\3""",
        "$1$2$3[REDACTED]$3",
    ),
)
#: Stated values: code spans, quotes, numbers with units. Words that negate (fixed values).
VALUE = r"""(?i)`[^`]+`|"[^"]+"|\b\d+(?:[.:]\d+)*(?:%|ms|s|m|h|d|kb|mb|gb)?\b"""
NEGATION = (
    r"(?i)\b(?:not|never|no|none|cannot|can't|don't|doesn't|didn't|won't|shouldn't|isn't|aren't|without|avoid|stop|"
    r"disable[ds]?|deprecated)\b"
)


def ascii_bounds(pattern: str) -> str:
    r"""The pattern with each \b as a bound of ASCII words, as SQL and the reference take it. To Java 17 and Python a letter
    such as ñ is part of a word."""
    word = "[A-Za-z0-9_]"
    return pattern.replace(r"\b", rf"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")


REVIEW_MARKER = "[memory:review-reply v1"
REVIEW_PROMPT = "[memory:review-prompt v1"


def search_terms(text: Column) -> Column:
    """Distinct terms of a query in order, at most 16; null if none is left."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_\-./]+)"), 1)
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[-./]+|[-./]+$", ""))
    kept = F.slice(F.array_distinct(F.filter(bare, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))), 1, MAX_TERMS)
    return F.when(F.size(kept) > 0, kept)


def index_words(text: Column) -> Column:
    """Words as the keyword index sees them: lower case; letters, digits, underscore, hyphen and slash hold together."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\-/]+"), "")


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Characters that are one letter with marks, and those letters."""
    pairs = []
    for c in map(chr, range(0x80, 0x110000)):
        bare = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
        if len(bare) == 1 and bare[0] != c:
            pairs.append((c, bare[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def folded(text: Column) -> Column:
    """A text without accents: letters with marks as those letters, marks by themselves gone. In the JVM, and only for what
    isn't ASCII."""
    bare = F.regexp_replace(F.translate(text, *_accents()), r"\p{Mn}+", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), bare).otherwise(text)


#: A piece of text without which the shape at the same place in SECRET_SHAPES can't be there.
TELLTALE = (("-----BEGIN",), ("AKIA", "ASIA"), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ("github_pat_",), ("glpat-",), ("xox",), ("sk-",), ("eyJ",), ("Bearer", "Basic"), ("=", ":"))


def _replaced(text: Column, telltale: tuple[str, ...], pattern: str, put: str) -> Column:
    """The pattern replaced where one of the pieces is there, which is quicker to see than to search with the pattern."""

    def one(t: Column) -> Column:
        some = F.contains(t, F.lit(telltale[0]))
        for x in telltale[1:]:
            some |= F.contains(t, F.lit(x))
        return F.when(some, F.regexp_replace(t, pattern, put)).otherwise(t)

    # A one-element array binds the text, which would be worked out anew at each mention.
    return F.get(F.transform(F.array(text), one), F.lit(0))


def redact(text: Column) -> Column:
    """A text without private parts and secret shapes."""
    out = _replaced(text, ("<",), r"(?i)<private>[\s\S]*?</private>", "[private]")
    for (pattern, put), telltale in zip(SECRET_SHAPES, TELLTALE):
        out = _replaced(out, telltale, ascii_bounds(pattern), put)
    return out


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clip(text: Column, most: int) -> Column:
    one = flat(text)
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.substring(one, 1, most - 1), F.lit("…")))


def clip_words(text: Column, most: int) -> Column:
    """Cuts at the last space if that lies in the second half, and drops punctuation before the ellipsis."""
    one = flat(text)
    cut = F.substring(one, 1, most - 1)
    space = F.length(cut) - F.instr(F.reverse(cut), " ")
    whole = F.when((F.instr(cut, " ") > 0) & (space > most / 2), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.regexp_replace(whole, r"[\s,;:.]+$", ""), F.lit("…")))


def age(then: Column, now: Column) -> Column:
    """Whole days or hours since then."""
    hours = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 3600)
    days = F.floor(hours / 24)
    return F.when(days >= 1, F.concat(days.cast("string"), F.lit("d ago"))).when(hours >= 1, F.concat(hours.cast("string"), F.lit("h ago"))).otherwise("just now")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def content_hash(kind: Column, title: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("\n", kind, title, content), 256)


def value_tokens(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ascii_bounds(VALUE)), 0), F.lower))


def is_negated(text: Column) -> Column:
    return text.rlike(ascii_bounds(NEGATION))


def is_usable_reply(text: Column) -> Column:
    return F.coalesce((F.trim(text) != "") & ~text.rlike(r"(?i)^\s*\[(system )?error\]"), F.lit(False))


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition. The JVM has no expression for it, so what isn't ASCII goes through Python, and only that."""
    other = text.rlike(r"[^\x00-\x7F]")
    return F.when(other, _nfc(F.when(other, text))).otherwise(text)


def task_query(title: Column, prompt: Column, branch: Column) -> Column:
    """Distinct names of a task, ignoring case, joined; null if there is none."""
    names = F.filter(F.array(title, prompt, branch), lambda x: x.isNotNull() & (F.trim(x) != ""))
    names = F.transform(names, flat)
    first = F.filter(names, lambda x, i: F.array_position(F.transform(names, F.lower), F.lower(x)) == i + 1)
    return F.when(F.size(first) > 0, F.array_join(first, " "))


def review_reply(text: Column, marker: str = REVIEW_MARKER) -> Column:
    """summary, saved, updated, nothing_to_save and display of a review's reply."""
    start = r"^\s*" + "".join("\\" + c if not c.isalnum() and c != " " else c for c in marker) + r"(?: (collapsed|full|hidden))?\]"
    lines = F.split(F.regexp_replace(text, start, ""), "\n")
    outcome, nothing = r"(?i)^\s*(saved|updated)\s*:(.*)$", r"(?i)^\s*nothing to save\.?\s*$"

    def ids(word: str) -> Column:
        own = F.filter(lines, lambda x: x.rlike(rf"(?i)^\s*{word}\s*:"))
        return F.flatten(F.transform(own, lambda x: F.transform(F.regexp_extract_all(F.regexp_extract(x, outcome, 2), F.lit(r"#?(\d+)"), 1), lambda d: d.cast("long"))))

    rest = F.filter(lines, lambda x: ~x.rlike(outcome) & ~x.rlike(nothing) & (F.trim(x) != ""))
    summary = F.trim(F.array_join(F.transform(rest, lambda x: F.regexp_replace(F.trim(x), r"(?i)^summary\s*:\s*", "")), " "))
    shown = F.regexp_extract(text, start, 1)
    return F.struct(
        F.when(summary != "", summary).alias("summary"),
        ids("saved").alias("saved"),
        ids("updated").alias("updated"),
        F.exists(lines, lambda x: x.rlike(nothing)).alias("nothing_to_save"),
        F.when(shown != "", shown).otherwise("collapsed").alias("display"),
    )


def review_headline(saved: Column, updated: Column) -> Column:
    def part(word: str, ids: Column) -> Column:
        return F.when(F.size(ids) > 0, F.concat(F.lit(f"{word} "), F.array_join(F.transform(ids, lambda x: F.concat(F.lit("#"), x.cast("string"))), ", ")))

    both = F.concat_ws(", ", part("saved", saved), part("updated", updated))
    return F.concat(F.lit("Memory review: "), F.when(both != "", both).otherwise("nothing new"))


def user_view(text: Column) -> Column:
    """How a user's message is shown: a review's prompt is hidden unless it asks to be shown in full."""
    start = r"^\s*" + "".join("\\" + c if not c.isalnum() and c != " " else c for c in REVIEW_PROMPT) + r"(?: (collapsed|full|hidden))?\]"
    how = F.regexp_extract(text, start, 1)
    return F.when(text.rlike(start) & (how != "full"), "hidden").otherwise("shown")


def assistant_view(text: Column, phase: Column) -> Column:
    """How an assistant's message is shown: a review's reply as a review, in full or not at all, as it says; the beginning
    of one is hidden while it is still arriving."""
    head = F.ltrim(text)
    partial = (phase == "streaming") & (head != "") & F.startswith(F.lit(REVIEW_MARKER), F.substring(head, 1, len(REVIEW_MARKER)))
    is_reply = F.startswith(head, F.lit(REVIEW_MARKER)) & F.contains(head, F.lit("]"))
    how = review_reply(text)["display"]
    return F.when(is_reply, F.when(how == "full", "shown").when(how == "hidden", "hidden").otherwise("review")).when(partial, "hidden").otherwise("shown")

"""WordPiece tokens and the embeddings that a table of token vectors gives for them.

Texts are cleaned and cut into words in the JVM; of all words each distinct one is matched once, longest piece first, in a
trie of the vocabulary. The vocabulary is broadcast (its size is the model's); token vectors are a table that is joined.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .embedder import pooled, prepared

#: Blocks whose characters are words by themselves (fixed values).
IDEOGRAPHS = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]"
CONTINUES, MOST_LETTERS = "##", 100


def words(text: Column, lower: bool = True) -> Column:
    """Words of a text in order: without control characters, ideographs and signs by themselves."""
    clean = F.regexp_replace(text, r"[[\p{Cc}\p{Cf}\x{FFFD}]&&[^\t\n\r]]", "")
    apart = F.regexp_replace(clean, f"({IDEOGRAPHS})", " $1 ")
    return F.regexp_extract_all(F.lower(apart) if lower else apart, F.lit(r"(?U)([^\s\p{P}\p{S}]+|[\p{P}\p{S}])"), 1)


class Pieces:
    """A vocabulary as two tries: pieces that begin a word, and pieces that continue one."""

    def __init__(self, vocabulary: dict[str, int], accents: bool = False):
        self.accents, self.begin, self.go_on = accents, {}, {}
        for piece, number in vocabulary.items():
            at = self.go_on if piece.startswith(CONTINUES) and piece != CONTINUES else self.begin
            for c in piece[len(CONTINUES) :] if at is self.go_on else piece:
                at = at.setdefault(c, {})
            at[None] = number

    def of(self, word: str) -> list[int]:
        """The longest pieces from left to right; none at all for a word that pieces can't make up, or too long a one."""
        if not self.accents:
            word = "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")
        if len(word) > MOST_LETTERS:
            return []
        out, start = [], 0
        while start < len(word):
            at, end, found = self.go_on if start else self.begin, start, None
            while end < len(word) and (at := at.get(word[end])) is not None:
                end += 1
                if None in at:
                    found = at[None], end
            if found is None:
                return []
            out.append(found[0])
            start = found[1]
        return out


def _matched(texts: DataFrame, vocabulary: dict[str, int], kind: str | None, lower: bool, accents: bool) -> tuple[DataFrame, DataFrame]:
    """id, place and word of texts(id, text); and word and pieces of each distinct word."""
    placed = texts.select("id", F.posexplode(words(prepared(F.col("text"), kind), lower)).alias("place", "word"))
    shared = texts.sparkSession.sparkContext.broadcast(Pieces(vocabulary, accents))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(pieces=b["word"].map(shared.value.of))

    return placed, placed.select("word").distinct().mapInPandas(run, "word string, pieces array<int>")


def tokens(texts: DataFrame, vocabulary: dict[str, int], kind: str | None = None, lower: bool = True, accents: bool = False) -> DataFrame:
    """id and tokens (in order) of texts(id, text); ids are unique. Words that aren't made of pieces are dropped."""
    placed, pieces = _matched(texts, vocabulary, kind, lower, accents)
    found = placed.join(pieces, "word").groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "pieces"))), lambda x: x["pieces"])).alias("tokens"))
    return texts.select("id").join(found, "id", "left").select("id", F.coalesce("tokens", F.array().cast("array<int>")).alias("tokens"))


def wordpiece_embedding(texts: DataFrame, vocabulary: dict[str, int], vectors: DataFrame, kind: str | None = None, lower: bool = True, accents: bool = False) -> DataFrame:
    """id and embedding of texts(id, text): the sum over a text's tokens of vectors(token, vector), scaled to length 1.
    Texts without a token that has a vector get none."""
    placed, pieces = _matched(texts, vocabulary, kind, lower, accents)
    counted = placed.groupBy("id", "word").agg(F.count("*").alias("n")).join(pieces, "word").select("id", "n", F.explode("pieces").alias("token"))
    return pooled(counted.groupBy("id", "token").agg(F.sum("n").alias("n")), vectors)

"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing, SentencePiece encoding.

In every stage: an empty table gives an empty one, rows are told apart by their contents and never by doc_id alone (null
and repeated doc_ids are ids like others), texts of any length are worked on whole, and columns beyond those of documents
are carried along unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import documents, release, staged
from cairn.llm.line_dedup import dedup_lines
from cairn.llm.mixing import mixed
from cairn.llm.ngram_join import one_of_each
from cairn.llm.pieces import encode
from cairn.llm.quality_rules import rejected_go


#: Columns of documents, which stages read and may change.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def set_apart(docs: DataFrame) -> DataFrame:
    """docs whose other columns have numbered names, which no operator's can clash with."""
    return docs.toDF(*[c if c in OWN else f"extra {i}" for i, c in enumerate(docs.columns)])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. A null or empty text has no words and goes; repeated rows get one verdict; a
    null in another column changes nothing."""
    return rejected_go(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go from the texts; a text that loses all its words goes with them. A null
    or empty text stays as it is; first is the smallest doc_id (null before all), then the text's digest, then the place;
    rows equal in doc_id and text are one document and get one result. n_chars follows the text."""
    apart = set_apart(docs)
    df = dedup_lines(apart)
    df = df.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return df.select(*apart.columns).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest doc_id (null after all), ties by the
    text's digest; of rows equal in both, one. Texts without a word, null among them, are in no group and all stay."""
    return one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, from never to three times. A null or empty text has no words to take
    and goes; a null source is a source; rows equal in doc_id, source and text share what the mix takes of them."""
    return mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their sampled pieces; copies of a document share them. A null text has null pieces, an empty one
    none; a null doc_id draws as 0 does; columns named like the new ones are replaced."""
    new = ("pieces", "n_pieces", "lossless")
    apart = set_apart(docs)
    kept = [(a, c) for a, c in zip(apart.columns, docs.columns) if c not in new]
    return encode(apart).select(*[a for a, _ in kept], *new).toDF(*[c for _, c in kept], *new)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: The verdicts of expectation-maximisation, the mix's draws and sampled pieces can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read again, and goes once the next one's
    is written."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""The queries op1 to op13: thin digests over the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, embedding_dedup, line_dedup, ngram_join, quality_rules, suffix_dedup
from . import manifest as merkle
from . import prefix_trie as tries
from .chat_format import adjacent_pairs, format_preferences
from .common import documents
from .embedding_dedup import near_duplicates
from .language_id import held_out, identify, train
from .line_dedup import dedup_lines
from .manifest import folded, leaf, manifest, proof
from .mixing import mix
from .ngram_join import jaccard_classes
from .pieces import encode
from .prefix_trie import prefix_trie
from .quality_rules import quality
from .secrets import scan
from .suffix_dedup import remove_repeats
from .toxicity import toxicity
from .toxicity import train as train_toxicity


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = remove_repeats(documents(spark, sf_dir))
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(documents(spark, sf_dir))
    return df.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_grammar")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return df.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good")
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = format_preferences(adjacent_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))

    def listed(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias(spans)

    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")]
    return df.select("pair_id", "chosen_id", "rejected_id", "n_prefix", *digests, listed("chosen_spans"), listed("rejected_spans"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "n_links")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = encode(documents(spark, sf_dir).select("doc_id", "text"))
    digest = F.sha2(F.array_join("pieces", ",").cast("binary"), 256)
    return df.select("doc_id", "n_bytes", "n_pieces", "lossless", digest.alias("pieces_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    claim = leaf(docs, n_chars=F.when(touched, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    df = manifest(docs.withColumn("claim", claim), keep=["doc_id", "claim"])
    df = df.select("doc_id", "leaf", "subroot", "root", proof("path").alias("proof_sha256"), folded("claim", "path").alias("folded_root"))
    return df.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_toxicity(docs, labels.filter(~held_out(F.col("doc_id"))))
    return toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("node")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_suffix_dedup, op3_secret_scan, op4_line_dedup, op5_quality_rules, op6_chat_format, op7_mixing, op8_embedding_dedup, op9_ngram_join, op10_sentencepiece, op11_merkle_manifest, op12_toxicity, op13_prefix_trie)
}

ORACLE_SQL: dict[str, str] = {
    "op2_suffix_dedup": suffix_dedup.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op6_chat_format": chat_format.ORACLE,
    "op8_embedding_dedup": embedding_dedup.ORACLE,
    "op9_ngram_join": ngram_join.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op13_prefix_trie": tries.ORACLE,
}

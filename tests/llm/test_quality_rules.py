from pyspark.sql import functions as F

from cairn.llm.quality_rules import repeated_window_words


def repeats(spark, words, n):
    df = spark.range(1).select(words.alias("words"))
    for name, c in repeated_window_words(F.col("words"), n).items():
        df = df.withColumn(name, c)
    return df.first()["n_repeat_words"]


def test_long_texts_have_no_chance_repeats(spark):
    """A text that says to have 2 ** 30 words leaves packed hashes 33 bits, too few for 300,000 different windows."""
    words = F.transform(F.sequence(F.lit(1), F.lit(300_000)), lambda x: x.cast("string"))
    assert repeats(spark, words, F.lit(1 << 30)) == 0
    assert repeats(spark, F.concat(words, F.slice(words, 10, 4)), F.lit(300_004)) == 8
    assert repeats(spark, F.concat(F.slice(words, 1, 50), F.slice(words, 10, 4)), F.lit(54)) == 8

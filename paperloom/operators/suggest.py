"""Prefix suggestions from corpus frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_FREQ, SHOWN = 50, 5


def vocabulary(post: DataFrame, min_freq: int = MIN_FREQ) -> DataFrame:
    """(word, freq) of words with at least ``min_freq`` occurrences."""
    return post.groupBy("word").agg(F.sum("tf").alias("freq")).filter(F.col("freq") >= min_freq)


def suggest(vocab: DataFrame, prefix: str, k: int = SHOWN) -> DataFrame:
    """(rank, word, freq): the ``k`` most frequent words with the prefix (ASCII-lowered),
    ties alphabetical. An empty prefix suggests nothing."""
    low = "".join(c.lower() if c.isascii() else c for c in prefix)
    fits = F.col("word").startswith(low) if low else F.lit(False)
    order = [F.desc("freq"), F.asc("word")]
    best = vocab.filter(fits).orderBy(*order).limit(k)
    return best.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "word", "freq")


def prefix_table(vocab: DataFrame, k: int = SHOWN) -> DataFrame:
    """(prefix, rank, word, freq): every prefix of every word with its first ``k`` words.
    The rank limit is applied before the shuffle as well, so a hot prefix stays small."""
    lengths = F.sequence(F.lit(1), F.length("word"))
    spread = vocab.select(
        F.explode(F.transform(lengths, lambda n: F.col("word").substr(F.lit(1), n))).alias("prefix"), "word", "freq"
    )
    w = Window.partitionBy("prefix").orderBy(F.desc("freq"), F.asc("word"))
    return spread.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)

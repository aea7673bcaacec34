"""Windowed co-occurrence associations between frequent words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.text import trainer_content

WINDOW, MIN_FREQ, MAX_VOCAB, TOP_K = 5, 50, 50_000, 20


def trainer_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, words): trainer tokens of the whole line ``doc_key<TAB>text`` in order."""
    return docs.select("doc_id", trainer_content(F.concat_ws("\t", "doc_key", "text")).alias("words"))


def vocabulary(rows: DataFrame, min_freq: int = MIN_FREQ, size: int = MAX_VOCAB) -> DataFrame:
    """(word, freq): words with at least ``min_freq`` occurrences, at most ``size`` of them
    by (frequency, word) descending. The size is a parameter of the model, not a guard."""
    return (
        rows.select(F.explode("words").alias("word"))
        .groupBy("word").agg(F.count("*").alias("freq"))
        .filter(F.col("freq") >= min_freq)
        .orderBy(F.desc("freq"), F.desc("word")).limit(size)
    )


def cooccurrence(rows: DataFrame, vocab: DataFrame, window: int = WINDOW) -> DataFrame:
    """(target, context, cnt): directed counts of vocabulary words at most ``window``
    positions apart, positions counted over vocabulary words only.

    The vocabulary has at most 50,000 words, so its broadcast is bounded. Words are
    filtered where they stand and re-gathered per document, then each is paired with a
    slice of its neighbours: linear in the length of a document, unlike a self join.
    A word may be its own context at another position.
    """
    kept = (
        rows.select("doc_id", F.posexplode("words").alias("pos", "word"))
        .join(F.broadcast(vocab.select("word")), "word", "left_semi")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("a"))
        .select(F.transform("a", lambda s: s["word"]).alias("a"))
    )
    here = kept.select("a", F.posexplode("a").alias("i", "target"))
    start = F.greatest(F.col("i") - window, F.lit(0))
    near = F.slice("a", start + 1, F.col("i") + window - start + 1)
    return (
        here.select("target", "i", start.alias("s"), F.posexplode(near).alias("j", "context"))
        .filter(F.col("s") + F.col("j") != F.col("i"))
        .groupBy("target", "context").agg(F.count("*").alias("cnt"))
    )


def top_contexts(pairs: DataFrame, k: int = TOP_K) -> DataFrame:
    """(target, rank, context, cnt): the ``k`` contexts of each word by (count, word)
    descending. Spark limits each group before the shuffle too."""
    w = Window.partitionBy("target").orderBy(F.desc("cnt"), F.desc("context"))
    return pairs.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)

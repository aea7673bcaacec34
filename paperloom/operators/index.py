"""Lexicon, forward and inverted index, lengths and corpus statistics.

Input documents have ``doc_id`` and ``text``; a null text is an empty one. Postings are
kept flat, (doc_id, word, tf), because a nested list of a frequent word has no size bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.scoring import bm25, idf
from paperloom.functions.text import content_tokens, tokens
from paperloom.runtime import attach, dense_ids, store


def postings(docs: DataFrame, stop: bool = True) -> DataFrame:
    """(doc_id, word, tf). Counting is partial before the shuffle, so hot words stay cheap."""
    words = (content_tokens if stop else tokens)(F.col("text"))
    return (
        docs.select("doc_id", F.explode(words).alias("word"))
        .groupBy("doc_id", "word")
        .agg(F.count("*").alias("tf"))
    )


def doc_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, dl) for every document, zero included. A narrow projection: no shuffle."""
    return docs.select("doc_id", F.size(content_tokens(F.col("text"))).cast("long").alias("dl"))


def doc_lengths_of_universe(universe: DataFrame, post: DataFrame) -> DataFrame:
    """(doc_id, dl) for every id of ``universe``, also those without any text."""
    sums = post.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    return universe.select("doc_id").join(sums, "doc_id", "left").select(
        "doc_id", F.coalesce("dl", F.lit(0)).cast("long").alias("dl")
    )


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row (n_docs, avgdl); an empty corpus has avgdl 0."""
    return lengths.agg(
        F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")
    )


def lexicon(docs: DataFrame) -> DataFrame:
    """(word_id, word): ids by first appearance in document and token order, without a
    global one-task window."""
    firsts = (
        docs.select("doc_id", F.posexplode(content_tokens(F.col("text"))).alias("pos", "word"))
        .groupBy("word")
        .agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    )
    return dense_ids(firsts, [F.col("first.doc_id"), F.col("first.pos")], "word_id").select("word_id", "word")


def id_map(keys: DataFrame, key: str = "doc_key") -> DataFrame:
    """(doc_key, doc_id): distinct keys numbered in byte order."""
    return dense_ids(keys.select(key).distinct(), [F.col(key)], "doc_id").select(key, "doc_id")


def mapped_texts(texts: DataFrame, mapping: DataFrame, order: str) -> DataFrame:
    """The rows of texts (doc_key, ``order``, …) whose key is mapped, with their ``doc_id``.

    Rows with an unknown or null key are dropped; of several with one key the one with the
    largest ``order``, which must be unique, stays, as the last one written. The winners are
    chosen on keys alone, by a partial aggregate, and the texts are only shuffled if the
    winners are too many to be broadcast.
    """
    last = texts.filter("doc_key is not null").groupBy("doc_key").agg(F.max(order).alias(order))
    winners = store(last.join(last_mapping(mapping), "doc_key").select(order, "doc_id", F.lit(1).alias("__n")))
    return attach(texts, winners, order, "__n").drop("__n", order)


def last_mapping(mapping: DataFrame) -> DataFrame:
    """One row per key: the largest id, which is the last one written."""
    return mapping.groupBy("doc_key").agg(F.max("doc_id").alias("doc_id"))


def forward_index(post: DataFrame, lex: DataFrame) -> DataFrame:
    """(doc_id, word_id, freq, total, uniq): postings with ids and the document's totals.

    Words without a lexicon entry are dropped and don't count. The lexicon is broadcast while
    it is small; beyond that the join spreads the frequent words, which their document
    counts tell.
    """
    counts = post.groupBy("word").agg(F.count("*").alias("df"))
    flat = attach(post, store(lex.join(counts, "word")), "word", "df").select("doc_id", "word_id", F.col("tf").alias("freq"))
    totals = flat.groupBy("doc_id").agg(F.sum("freq").alias("total"), F.count("*").alias("uniq"))
    return flat.join(totals, "doc_id")


def inverted_digest(post: DataFrame) -> DataFrame:
    """(word, df, cf, sum_doc, min_doc, max_doc): a summary of each posting list."""
    return post.groupBy("word").agg(
        F.count("*").alias("df"),
        F.sum("tf").alias("cf"),
        F.sum("doc_id").alias("sum_doc"),
        F.min("doc_id").alias("min_doc"),
        F.max("doc_id").alias("max_doc"),
    )


def inverted_lists(post: DataFrame, block: int = 100_000) -> DataFrame:
    """(word, block, postings): nested lists sorted by document. A list is cut into blocks
    of document ids so that a hot word is never gathered into one row."""
    return (
        post.withColumn("block", F.expr(f"doc_id div {int(block)}"))
        .groupBy("word", "block")
        .agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))
    )


def barrel_stats(forward: DataFrame, width: int) -> DataFrame:
    """(barrel, n_words, n_postings) by word-id range; words are counted first, so the
    distinct count needs no second expansion."""
    per_word = forward.groupBy("word_id").agg(F.count("*").alias("n"))
    return (
        per_word.groupBy(F.expr(f"word_id div {int(width)}").alias("barrel"))
        .agg(F.count("*").alias("n_words"), F.sum("n").alias("n_postings"))
    )


def idf_table(post: DataFrame, stats: DataFrame) -> DataFrame:
    """(word, df, idf). ``stats`` is a single row, so its broadcast is bounded."""
    return (
        post.groupBy("word").agg(F.count("*").alias("df"))
        .join(F.broadcast(stats))
        .select("word", "df", idf(F.col("n_docs"), F.col("df")).alias("idf"))
    )


def bm25_terms(post: DataFrame, lengths: DataFrame, stats: DataFrame) -> DataFrame:
    """(doc_id, word, weight) for every posting; frequent words are spread as in
    ``forward_index``."""
    return (
        attach(post, store(idf_table(post, stats)), "word", "df")
        .join(lengths, "doc_id")
        .join(F.broadcast(stats))
        .select("doc_id", "word",
                bm25(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl")).alias("weight"))
    )

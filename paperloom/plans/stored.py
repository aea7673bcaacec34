"""The index of one data folder as stored tables, each built at its first use in a session."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import associations, graph, index
from paperloom.plans import fixtures
from paperloom.runtime import attach, exists, read_table, store, work_path
from paperloom.sources import files

#: Word ids of one barrel; the search and lookup queries share it.
WIDTH = 1000


class Stored:
    """Texts, postings in barrels, lexicon, lengths, metadata, link scores and associations.

    A search reads the lexicon rows of its words and, through partition pruning and row-group
    statistics, the postings of their ids; no text is tokenized again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def docs(self) -> DataFrame:
        return store(fixtures.corpus(self.spark, self.folder))

    @cached_property
    def meta(self) -> DataFrame:
        return store(fixtures.corpus_metadata(self.spark, self.folder))

    @cached_property
    def postings(self) -> DataFrame:
        return store(index.postings(self.docs))

    @cached_property
    def lengths(self) -> DataFrame:
        return store(index.doc_lengths(self.docs))

    @cached_property
    def lexicon(self) -> DataFrame:
        """(word_id, word, df), sorted by word, so that a lookup skips most row groups."""
        counts = self.postings.groupBy("word").agg(F.count("*").alias("df"))
        return store(index.lexicon(self.docs).join(counts, "word").repartitionByRange("word").sortWithinPartitions("word"))

    @cached_property
    def barrels(self) -> str:
        path = work_path(self.spark)
        flat = attach(self.postings, self.lexicon, "word", "df").select("doc_id", "word_id", F.col("tf").alias("freq"))
        files.write_barrels(flat, path, WIDTH)
        return path

    @cached_property
    def ranks(self) -> DataFrame:
        edges = graph.clean_edges(read_table(self.spark, self.folder, "graph_edges"))
        return store(graph.pagerank(edges, max_iter=10, tol=None).ranks.withColumnRenamed("id", "doc_id"))

    @cached_property
    def vocabulary(self) -> DataFrame:
        """(word, freq) of the words that associations are learnt for."""
        return store(associations.vocabulary(associations.trainer_rows(self.docs)))

    @cached_property
    def assoc(self) -> DataFrame:
        return store(associations.top_contexts(associations.cooccurrence(associations.trainer_rows(self.docs), self.vocabulary)))

    def lookup(self, terms: list[str]) -> DataFrame:
        """(doc_id, word, tf) of the postings of some words, from their barrels."""
        found = {r["word_id"]: r["word"] for r in self.lexicon.filter(F.col("word").isin(*terms)).select("word_id", "word").collect()} if terms else {}
        rows = files.lookup_barrel(self.spark, self.barrels, sorted(found), WIDTH)
        word = F.lit(None).cast("string")
        for i, w in sorted(found.items()):
            word = F.when(F.col("word_id") == i, F.lit(w)).otherwise(word)
        return rows.select("doc_id", word.alias("word"), F.col("freq").alias("tf"))


    def whole(self) -> bool:
        """Whether all that has been built is still there."""
        paths = [getattr(t, "_paperloom_path", t) for t in vars(self).values() if isinstance(t, DataFrame)]
        return all(exists(self.spark, p) for p in [*paths, *([self.barrels] if "barrels" in vars(self) else [])])


def stored(spark: SparkSession, folder: str) -> Stored:
    """The stored index of a folder, one a session; made anew if its files are gone."""
    sc = spark.sparkContext
    if not hasattr(sc, "_paperloom_stored"):
        sc._paperloom_stored = {}
    found = sc._paperloom_stored.get(folder)
    if found is None or not found.whole():
        found = sc._paperloom_stored[folder] = Stored(spark, folder)
    return found

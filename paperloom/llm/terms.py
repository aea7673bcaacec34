"""Problem 4: how often every distinct word occurs, and in how many documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.runtime import release, ship, store

RARE_DOCS, COMMON_SHARE = 2, 0.1
#: A word id is heavy if it holds at least this share of the rows; at most 1/HEAVY_SHARE are.
HEAVY_SHARE = 0.001
#: Rows of the normalized lexicon up to which it is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def words_by_id(lexicon: DataFrame) -> DataFrame:
    """(word_id, word): words in lower case without outer blanks; null and blank words are
    none. Spellings of one word under one id are one row; an id that stands for different
    words stands for each of them."""
    word = F.lower(F.regexp_replace("word", r"^\s+|\s+$", ""))
    return lexicon.select("word_id", word.alias("word")).filter("word != '' and word_id is not null").distinct()


def counted_rows(index: DataFrame) -> DataFrame:
    """(doc_id, word_id, freq) of the rows that may count."""
    return index.filter("freq > 0 and doc_id is not null and word_id is not null").select("doc_id", "word_id", "freq")


def heavy_ids(rows: DataFrame, key: str = "word_id", share: float = HEAVY_SHARE) -> list[int]:
    """The keys with at least ``share`` of the rows, at most 1/share of them, by an exact
    partial count."""
    counts = store(rows.groupBy(key).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = [r[key] for r in counts.filter(F.col("n") >= share * total).select(key).collect()]
    release(counts)
    return found


def cells(index: DataFrame, lexicon: DataFrame, titles: DataFrame | None = None, heavy: list[int] | None = None) -> DataFrame:
    """(doc_id, word, freq): one row per document and word; with ``titles`` (doc_id, word) also
    those words, with freq 0 if the index lacks them, and a column ``titled``.

    Identical index rows count once; rows with a null id, a null, zero or negative ``freq``
    or without a word don't count; all ids of one word are added up. Rows are laid out once
    by (document, word) and both deduplicated and summed there. Only copies of one row can
    make such a key hot: they share a heavy word id and a heavy document, so where there are
    both, their rows are deduplicated by a partial aggregate before.

    The lexicon is broadcast while a count of its rows proves it small. Beyond that only the
    rows of the heavy word ids, whose lexicon rows are few, are joined by broadcast, and the
    others meet the lexicon in a shuffle without any hot key.
    """
    rows = counted_rows(index)
    heavy = heavy_ids(rows) if heavy is None else heavy
    documents = heavy_ids(rows.filter(F.col("word_id").isin(heavy)), "doc_id") if heavy else []
    if documents:
        hot = F.col("word_id").isin(heavy) & F.col("doc_id").isin(documents)
        rows = rows.filter(~hot).unionByName(rows.filter(hot).distinct())
    ids = store(words_by_id(lexicon))
    if ids.count() <= BROADCAST_ROWS:
        named = rows.join(F.broadcast(ids), "word_id")
    else:
        often = F.col("word_id").isin(heavy)
        named = rows.filter(often).join(F.broadcast(ids.filter(often)), "word_id").unionByName(rows.filter(~often).join(ids, "word_id"))
    long = named.select("doc_id", "word", "word_id", "freq", F.lit(False).alias("titled"))
    if titles is not None:
        nothing = (F.lit(None).cast(dict(named.dtypes)[c]).alias(c) for c in ("word_id", "freq"))
        long = long.unionByName(titles.select("doc_id", "word", *nothing, F.lit(True).alias("titled")))
    once = long.repartition("doc_id", "word").groupBy("doc_id", "word", "word_id", "freq").agg(F.max("titled").alias("titled"))
    freq = F.coalesce(F.sum("freq"), F.lit(0)).cast("long").alias("freq")
    return once.groupBy("doc_id", "word").agg(freq, *([F.max("titled").alias("titled")] if titles is not None else []))


def _local_counters(n: int):
    """Adds one task's heavy cells into two exact arrays and emits them once."""

    def run(batches):
        total, docs = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b in batches:
            at = b.column("slot").to_numpy(zero_copy_only=False)
            np.add.at(total, at, b.column("freq").to_numpy(zero_copy_only=False))
            np.add.at(docs, at, 1)
        used = np.flatnonzero(docs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(total[used]), pa.array(docs[used])], ["slot", "total", "docs"])

    return run


def count_terms(cell: DataFrame, heavy_share: float = HEAVY_SHARE, heavy: list[str] | None = None) -> DataFrame:
    """(word, total, docs) of every word in ``cells``.

    ``heavy`` are words known to be frequent; without them a frequent-items pass finds them,
    which misses none above the share. Both give at most 1/share of them, so their broadcast
    is bounded. Each task counts its heavy cells in local arrays; only array slots and the
    light words are shuffled. Both tables are exact and disjoint, so their union is the answer.
    """
    spark = cell.sparkSession
    ship(spark)
    if heavy is None:
        found = cell.stat.freqItems(["word"], heavy_share).first()
        heavy = [w for w in (found[0] or []) if w is not None] if found else []
    heavy = sorted(set(heavy))
    if not heavy:
        return cell.groupBy("word").agg(F.sum("freq").alias("total"), F.count("*").alias("docs"))
    slots = F.broadcast(spark.createDataFrame([(w, i) for i, w in enumerate(heavy)], "word string, slot int"))
    marked = cell.select("word", "freq").join(slots, "word", "left")
    local = marked.filter("slot is not null").select("slot", "freq").mapInArrow(
        _local_counters(len(heavy)), "slot int, total long, docs long")
    hot = local.groupBy("slot").agg(F.sum("total").alias("total"), F.sum("docs").alias("docs")).join(slots, "slot")
    rest = marked.filter("slot is null").groupBy("word").agg(F.sum("freq").alias("total"), F.count("*").alias("docs"))
    return hot.select("word", "total", "docs").unionByName(rest)


def term_table(index: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, total, docs, mark) for every word of the lexicon; words without counted rows
    have zeros and no mark. ``mark`` is ``rare`` up to 2 documents, ``common`` above a
    tenth of the documents with a counted row, else null; in a collection so small that a
    word is both, it is ``rare``. Empty tables give no rows."""
    often = heavy_ids(counted_rows(index))
    cell = store(cells(index, lexicon, heavy=often))
    n_docs = cell.select("doc_id").distinct().count()
    ids = store(words_by_id(lexicon))
    heavy = [r["word"] for r in ids.filter(F.col("word_id").isin(often)).select("word").distinct().collect()] if often else []
    counts = count_terms(cell, heavy=heavy)
    words = ids.select("word").distinct()
    total, docs = F.coalesce("total", F.lit(0)).cast("long"), F.coalesce("docs", F.lit(0)).cast("long")
    mark = F.when(docs == 0, None).when(docs <= RARE_DOCS, "rare").when(docs > COMMON_SHARE * n_docs, "common")
    return words.join(counts, "word", "left").select("word", total.alias("total"), docs.alias("docs"), mark.alias("mark"))

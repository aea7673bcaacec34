"""Problem 5: how characteristic a word is of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import tokens
from paperloom.llm.terms import cells
from paperloom.runtime import attach, store


def title_words(meta: DataFrame) -> DataFrame:
    """(doc_id, word): distinct search tokens, stopwords included, of all titles of a
    document. Null titles and null ids have none."""
    return (
        meta.filter("doc_id is not null")
        .select("doc_id", F.explode(F.array_distinct(tokens(F.col("title")))).alias("word")).distinct()
    )


def residuals(cell: DataFrame, titles: DataFrame) -> DataFrame:
    """``scored`` of the cells and the words of titles."""
    both = (
        cell.select("doc_id", "word", "freq", F.lit(False).alias("titled"))
        .unionByName(titles.select("doc_id", "word", F.lit(0).cast("long").alias("freq"), F.lit(True).alias("titled")))
        .groupBy("doc_id", "word").agg(F.sum("freq").alias("freq"), F.max("titled").alias("titled"))
    )
    return scored(both)


def scored(table: DataFrame) -> DataFrame:
    """(doc_id, word, freq, docs, total, indexed, titled, residual) for each word of each document.

    ``table`` has one cell (doc_id, word, freq, titled) per document and word: the index
    count, or 0 for a word that only the title has (``indexed`` false), which counts as 1.
    The adjusted residual is ``(o - e) / sqrt(e (1 - r/N) (1 - c/N))`` with row sum r,
    column sum c, grand total N and ``e = r c / N``; a margin equal to N leaves no variance
    and gives 0. ``docs`` counts the indexed documents of the word, ``freq`` the indexed
    count (0 if none), ``total`` is the column sum. Margins are partial sums by key, stored
    once; N is one number. A margin bounds the rows with its key, so that its join can tell
    the hot keys by it.
    """
    table = store(table.withColumn("o", F.greatest("freq", F.lit(1))))
    rows = store(table.groupBy("doc_id").agg(F.sum("o").alias("r")))
    cols = store(table.groupBy("word").agg(F.sum("o").alias("c"), F.sum((F.col("freq") > 0).cast("long")).alias("docs")))
    n = F.lit(float(max(cols.agg(F.sum("c")).first()[0] or 0, 1)))
    e = F.col("r") * F.col("c") / n
    spread = e * (1 - F.col("r") / n) * (1 - F.col("c") / n)
    score = F.when(spread > 0, (F.col("o") - e) / F.sqrt(spread)).otherwise(F.lit(0.0))
    return attach(attach(table, cols, "word", "c"), rows, "doc_id", "r").select(
        "doc_id", "word", "freq", "docs", F.col("c").alias("total"), (F.col("freq") > 0).alias("indexed"), "titled", score.alias("residual"))


def score_words(index: DataFrame, lexicon: DataFrame, meta: DataFrame) -> DataFrame:
    """``scored`` of an index with its lexicon and titles; rows and words count as in
    ``terms.cells``. Empty tables give no rows."""
    return scored(cells(index, lexicon, title_words(meta)))


def beyond_doubt(scored: DataFrame) -> DataFrame:
    """(doc_id, word): the word with the highest count and the fewest documents of all
    words of its document, each alone, in documents of at least two indexed words, and
    also in a title.

    Candidates of a document are its word of highest residual and the words whose column
    sum is larger than that word's. No case is outside them: in one document the residual
    grows with the count and falls with the column sum, and a case has the highest count
    alone, so it has a higher residual than every word of an equal or larger column sum.
    (A single document, whose residuals are all 0, has its counts as column sums.) The
    residual can't decide alone, since few documents may still have a large column sum.

    One partial aggregate per document keeps the extremes; ties show as two different
    words at an extreme. No document's words are gathered.
    """
    own = scored.filter("indexed")
    low = F.struct((-F.col("freq")).alias("k"), "word")
    per = own.groupBy("doc_id").agg(
        F.count("*").alias("n"),
        F.max(F.struct("residual", (-F.col("total")).alias("k"), "word")).alias("first"),
        F.max(F.struct("freq", "word", "total")).alias("hi"), F.min(low).alias("hi2"),
        F.min(F.struct("docs", "word")).alias("lo"), F.max(F.struct((-F.col("docs")).alias("k"), "word")).alias("lo2"),
        F.max(F.struct("freq", F.col("word").alias("w"), "titled")).alias("top"),
    )
    alone = (F.col("hi.word") == F.col("hi2.word")) & (F.col("lo.word") == F.col("lo2.word"))
    candidate = (F.col("hi.word") == F.col("first.word")) | (F.col("hi.total") > -F.col("first.k"))
    return per.filter(candidate & (F.col("n") >= 2) & alone & (F.col("hi.word") == F.col("lo.word")) & F.col("top.titled")).select(
        "doc_id", F.col("hi.word").alias("word"))

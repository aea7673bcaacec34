"""Boolean-AND retrieval with BM25, link score, filters, sorting and paging."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.scoring import RANK_WEIGHT, bm25, idf
from paperloom.functions.text import SEARCH_STOPWORDS

RESULT_CAP, PAGE_SIZE, DIGITS = 120, 20, 6


@dataclass(frozen=True)
class Command:
    """A parsed search line."""

    text: str
    category: str = ""
    by_date: bool = False

    @property
    def terms(self) -> list[str]:
        """Distinct lower-case ASCII tokens without stopwords, sorted."""
        found = (w.lower() for w in re.findall("[A-Za-z0-9]+", self.text))
        return sorted({w for w in found if w not in SEARCH_STOPWORDS})


def parse_command(line: str) -> Command:
    """``/date`` sorts by date, the last ``/cat:X`` filters (empty X: none); the other
    words are the query."""
    words, category, by_date = [], "", False
    for w in line.split():
        if w == "/date":
            by_date = True
        elif w.startswith("/cat:"):
            category = w[len("/cat:"):]
        else:
            words.append(w)
    return Command(" ".join(words), category, by_date)


def match(post: DataFrame, lengths: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, score) of documents holding every term: relational division over one scan.

    The term filter reaches the postings scan; document counts per term are at most one
    row a term, hence the bounded broadcast. Unknown terms leave the division unmet; no
    term gives no hit. ``lengths`` defines the collection: its count and mean length enter
    the score, and documents outside it are no hits.
    """
    hits = post.filter(F.col("word").isin(*terms) if terms else F.lit(False))
    counts = hits.groupBy("word").agg(F.count("*").alias("df"))
    stats = lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    per_term = F.broadcast(
        counts.join(F.broadcast(stats)).select("word", idf(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl")
    )
    weight = bm25(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"))
    return (
        hits.join(per_term, "word")
        .join(lengths, "doc_id")
        .groupBy("doc_id")
        .agg(F.count("*").alias("m"), F.sum(weight).alias("score"))
        .filter(F.col("m") == len(terms))
        .select("doc_id", "score")
    )


def with_links(hits: DataFrame, ranks: DataFrame) -> DataFrame:
    """Add 50 times the link score; documents without one get 0."""
    return hits.join(ranks.select("doc_id", F.col("score").alias("link")), "doc_id", "left").select(
        "doc_id", (F.col("score") + RANK_WEIGHT * F.coalesce("link", F.lit(0.0))).alias("score")
    )


def top(hits: DataFrame, meta: DataFrame, category: str = "", by_date: bool = False, cap: int = RESULT_CAP) -> DataFrame:
    """The first ``cap`` hits with their metadata and rank.

    Scores are rounded before ordering, ties go to the smaller ``doc_id``. Metadata joins
    before the cut only if a filter or the date order needs it, else after it, so that
    only ``cap`` rows look it up.
    """
    scored = hits.withColumn("score", F.round("score", DIGITS))
    order = [F.desc("score"), F.asc("doc_id")]
    if category or by_date:
        scored = scored.join(meta, "doc_id", "inner" if category else "left")
        if category:
            scored = scored.filter(F.col("category").contains(category))
        if by_date:
            order = [F.desc("day"), *order]
            scored = scored.withColumn("day", F.coalesce("date", F.lit("0000")))
        best = scored.orderBy(*order).limit(cap)
    else:
        best = scored.orderBy(*order).limit(cap).join(meta, "doc_id", "left")
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return ranked.select("rank", "doc_id", "id", "title", "authors", "category", "date", "score")


def page(results: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 0) of ranked results."""
    return results.filter(F.col("rank").between(number * size + 1, (number + 1) * size))


def result_json(results: DataFrame) -> DataFrame:
    """(rank, json): one JSON object per hit, the score with four decimals as text."""
    score = F.format_string("%.4f", "score")
    return results.select("rank", F.to_json(F.struct(
        "id", "title", "authors", "category", "date", score.alias("score"),
    ), {"ignoreNullFields": "false"}).alias("json"))


def result_display(results: DataFrame) -> DataFrame:
    """(rank, line): a readable line with authors cut at 80 characters and the paper's link."""
    authors = F.when(F.length("authors") > 80, F.concat(F.substring("authors", 1, 80), F.lit("..."))).otherwise(F.col("authors"))
    return results.select("rank", F.concat(
        F.col("title"), F.lit(" / "), authors, F.lit(" / https://arxiv.org/abs/"), F.col("id"),
    ).alias("line"))

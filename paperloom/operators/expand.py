"""Query expansion by associated words and the merge of the result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.scoring import RANK_WEIGHT, bm25, idf
from paperloom.operators.search import DIGITS, RESULT_CAP

SYNONYMS, MERGED_CAP, PENALTY = 2, 60, 0.5


def synonyms(assoc: DataFrame, query: str, per_word: int = SYNONYMS) -> DataFrame:
    """(seq, word, syn): the first ``per_word`` associations of each lower-cased
    white-space word of the query, without query words, first use kept.

    The query has a handful of words, so everything after the word filter is tiny.
    """
    words = query.lower().split()
    spark = assoc.sparkSession
    asked = spark.createDataFrame(list(enumerate(words)), "pos int, target string")
    picked = assoc.filter(F.col("target").isin(*words) if words else F.lit(False)).filter(F.col("rank") <= per_word)
    usable = picked.join(F.broadcast(asked), "target").filter(~F.col("context").isin(*words) if words else F.lit(False))
    firsts = usable.groupBy("context").agg(F.min(F.struct("pos", "rank", "target")).alias("f"))
    seq = F.row_number().over(Window.orderBy("f.pos", "f.rank")).cast("long")
    return firsts.select(seq.alias("seq"), F.col("f.target").alias("word"), F.col("context").alias("syn"))


def synonym_hits(syns: DataFrame, post: DataFrame, lengths: DataFrame, ranks: DataFrame, cap: int = RESULT_CAP) -> DataFrame:
    """(seq, syn, doc_id, score, place): one single-term search per synonym in one job."""
    hits = post.join(F.broadcast(syns), post["word"] == syns["syn"]).select("seq", "syn", "doc_id", "tf")
    df = hits.groupBy("syn").agg(F.count("*").alias("df"))
    stats = lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    term = F.broadcast(df.join(F.broadcast(stats)).select("syn", idf(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl"))
    scored = (
        hits.join(term, "syn").join(lengths, "doc_id")
        .join(ranks.select("doc_id", F.col("score").alias("link")), "doc_id", "left")
        .select("seq", "syn", "doc_id", F.round(
            bm25(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"))
            + RANK_WEIGHT * F.coalesce("link", F.lit(0.0)), DIGITS).alias("score"))
    )
    w = Window.partitionBy("seq").orderBy(F.desc("score"), F.asc("doc_id"))
    return scored.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= cap)


def merge(primary: DataFrame, extra: DataFrame, meta: DataFrame, cap: int = MERGED_CAP) -> DataFrame:
    """Primary hits in their order, then expanded ones (title tagged, score halved) until
    ``cap`` results; an id appears once, where it comes first. Primary hits are never cut.

    Both inputs hold at most 120 rows a search, so the windows here see a few hundred rows.
    """
    tagged = extra.join(meta, "doc_id", "left").select(
        F.lit(1).alias("src"), "seq", "place", "doc_id", "id",
        F.concat(F.lit("[Related to "), F.col("syn"), F.lit("] "), F.col("title")).alias("title"),
        "authors", "category", "date", (F.col("score") * PENALTY).alias("score"),
    )
    first = primary.select(
        F.lit(0).alias("src"), F.lit(0).cast("long").alias("seq"), F.col("rank").alias("place"),
        "doc_id", "id", "title", "authors", "category", "date", "score",
    )
    order = ["src", "seq", "place"]
    once = F.row_number().over(Window.partitionBy("id").orderBy(*order))
    kept = first.unionByName(tagged).withColumn("once", once).filter("once = 1")
    rank = F.row_number().over(Window.orderBy(*order)).cast("long")
    return kept.withColumn("rank", rank).filter((F.col("src") == 0) | (F.col("rank") <= cap)).select(
        "rank", "doc_id", "id", "title", "authors", "category", "date", "score"
    )

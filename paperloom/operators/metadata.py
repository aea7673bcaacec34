"""The metadata table: cleaning, last-wins deduplication and placeholder rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.ids import metadata_key
from paperloom.functions.text import clean_metadata
from paperloom.operators.index import last_mapping


def paper_metadata(papers: DataFrame) -> DataFrame:
    """(line_no, doc_key, title, authors, category, date) with cleaned fields; a present
    but empty or null field is ``Unknown``."""
    return papers.select(
        "line_no",
        metadata_key(F.col("id")).alias("doc_key"),
        clean_metadata(F.col("title")).alias("title"),
        clean_metadata(F.col("authors")).alias("authors"),
        clean_metadata(F.col("categories")).alias("category"),
        clean_metadata(F.col("update_date")).alias("date"),
    )


def extract(papers: DataFrame, mapping: DataFrame) -> DataFrame:
    """(doc_id, original_id, title, authors, category, date) for every id from 0 to the
    largest one mapped, so that a row's place is its id.

    The paper with the largest ``line_no`` wins; ids without a paper, mapped or not, get a
    placeholder. Keys of ``mapping`` are unique after the last-wins step, so neither join
    multiplies. An empty mapping gives no rows.
    """
    ids = last_mapping(mapping)
    top = ids.agg(F.max("doc_id")).first()[0]
    every = papers.sparkSession.range(0 if top is None else top + 1).withColumnRenamed("id", "doc_id")
    fields = ("doc_key", "title", "authors", "category", "date")
    found = (
        paper_metadata(papers)
        .join(ids, "doc_key")
        .groupBy("doc_id")
        .agg(F.max_by(F.struct(*fields), "line_no").alias("m"))
    )
    blank = F.concat(F.lit("Unknown Title (Doc #"), F.col("doc_id").cast("string"), F.lit(")"))
    return (
        every.join(found, "doc_id", "left")
        .select(
            "doc_id",
            F.coalesce("m.doc_key", F.lit("UnknownID")).alias("original_id"),
            F.coalesce("m.title", blank).alias("title"),
            F.coalesce("m.authors", F.lit("Unknown")).alias("authors"),
            F.coalesce("m.category", F.lit("N/A")).alias("category"),
            F.coalesce("m.date", F.lit("N/A")).alias("date"),
        )
    )

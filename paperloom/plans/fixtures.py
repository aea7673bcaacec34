"""Mappings from the data folder's tables to the engine's logical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import first_line_title
from paperloom.operators.index import mapped_texts
from paperloom.runtime import read_table


def _mapped(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_key", F.col("doc_id").alias("at"), *columns)
    return mapped_texts(docs, read_table(spark, d, "id_map"), "at")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, doc_key, text): the searchable texts, by the ids their keys are mapped to; a
    null text is an empty one."""
    return _mapped(spark, d, "text").select("doc_id", "doc_key", F.coalesce("text", F.lit("")).alias("text"))


def corpus_metadata(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, id, title, authors, category, date) of the texts; what is null is a placeholder."""
    return _mapped(spark, d, "text", "source", "category", "fetched_at").select(
        "doc_id", F.col("doc_key").alias("id"), first_line_title(F.col("text")).alias("title"),
        F.coalesce("source", F.lit("Unknown")).alias("authors"), F.coalesce("category", F.lit("N/A")).alias("category"),
        F.coalesce(F.date_format("fetched_at", "yyyy-MM-dd"), F.lit("N/A")).alias("date"))


def paper_lines(spark: SparkSession, d: str) -> DataFrame:
    """(line_no, value): the papers as JSON lines, nulls as absent keys."""
    return read_table(spark, d, "raw_papers").select("line_no", F.to_json(F.struct(
        "id", "title", "abstract", "authors", "categories", "update_date", "submitter", "versions")).alias("value"))


def citation_lines(spark: SparkSession, d: str) -> DataFrame:
    """(value): one JSON object per edge row, ``{"arXiv:<src>v1": ["<dst>"]}``; an edge
    without a target gives an empty reference list."""
    e = read_table(spark, d, "graph_edges")
    src = F.concat(F.lit("arXiv:"), F.col("src").cast("string"), F.lit("v1"))
    refs = F.when(F.col("dst").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col("dst").cast("string")))
    return e.filter("src is not null").select(F.to_json(F.create_map(src, refs)).alias("value"))

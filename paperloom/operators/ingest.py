"""Incremental ingestion: parse uploads, extend the lexicon, append to the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import clean_upload, content_tokens, first_line_title
from paperloom.operators.index import forward_index, postings
from paperloom.runtime import dense_ids, store

UPLOAD_SCHEMA = (
    "title string, authors string, submitter string, update_date string, "
    "versions array<struct<version:string,created:string>>, id string"
)


def parse_uploads(files: DataFrame, value: str = "value") -> DataFrame:
    """Whole files to (…, title, authors, date, original_id).

    A JSON object gives its keys, with ``submitter`` after ``authors`` and the first
    version's date after ``update_date``; JSON that is no object keeps the defaults; other
    text gives its first line as title. Absent keys take the defaults.
    """
    raw = F.col(value)
    # Spark's JSON parsers stop at the end of the first value, so the text's ends are checked.
    bare = F.regexp_replace(raw, r"^\s+|\s+$", "")
    looks = bare.startswith("{") & bare.endswith("}")
    j = F.when(looks, F.from_json(raw, UPLOAD_SCHEMA + ", __bad string", {"columnNameOfCorruptRecord": "__bad"}))
    is_object = F.col("__j").isNotNull() & F.col("__j.__bad").isNull()
    tight = lambda c: F.regexp_replace(c, r"\s", "")
    is_array = bare.startswith("[") & F.coalesce(tight(F.to_json(F.try_parse_json(bare))) == tight(bare), F.lit(False))
    is_scalar = bare.rlike(r'^(?:-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|"(?:[^"\\\x00-\x1f]|\\.)*")$')
    is_json = is_object | is_array | is_scalar
    line = first_line_title(raw)
    title = (
        F.when(is_object, F.coalesce(clean_upload(F.col("__j.title")), F.lit("Uploaded Document")))
        .when(~is_json & (line != ""), line)
        .otherwise(F.lit("Uploaded Document"))
    )
    return files.withColumn("__j", j).select(
        *files.columns,
        title.alias("title"),
        F.coalesce(clean_upload(F.coalesce("__j.authors", "__j.submitter")), F.lit("System Updater")).alias("authors"),
        F.coalesce("__j.update_date", F.get("__j.versions", F.lit(0))["created"], F.lit("2025-01-01")).alias("date"),
        F.coalesce(F.translate(F.col("__j.id"), "|\n", "-"), F.lit("upload/new")).alias("original_id"),
    )


def lexicon_delta(new_docs: DataFrame, lex: DataFrame) -> DataFrame:
    """(word_id, word) of words not in ``lex``: next free ids in order of appearance."""
    firsts = (
        new_docs.select("doc_id", F.posexplode(content_tokens(F.col("text"))).alias("pos", "word"))
        .groupBy("word").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
        .join(lex.select("word"), "word", "left_anti")
    )
    start = lex.agg(F.coalesce(F.max("word_id") + 1, F.lit(0))).first()[0]
    ids = dense_ids(firsts, [F.col("first.doc_id"), F.col("first.pos")], "n")
    return ids.select((F.col("n") + start).alias("word_id"), "word")


def assign_ids(uploads: DataFrame, first_id: int, order: str) -> DataFrame:
    """Uploads numbered from ``first_id`` in the order of the unique column ``order``."""
    return dense_ids(uploads, [F.col(order)], "__n").withColumn("doc_id", F.col("__n") + first_id).drop("__n")


def appended_rows(uploads: DataFrame) -> DataFrame:
    """(doc_id, original_id, title, authors, category, date, dl): what an upload adds to
    metadata and lengths; the whole raw file is tokenized and the category is ``New``."""
    return uploads.select(
        "doc_id", "original_id", "title", "authors", F.lit("New").alias("category"), "date",
        F.size(content_tokens(F.col("value"))).cast("long").alias("dl"),
    )


def appended_forward(docs: DataFrame, lex: DataFrame) -> DataFrame:
    """(doc_id, word_id, freq, total, uniq): forward rows of new documents (doc_id, text) by the
    lexicon together with ``lexicon_delta`` of them, so that no word is dropped."""
    grown = lex.select("word_id", "word").unionByName(lexicon_delta(docs, lex))
    return forward_index(store(postings(docs)), grown)

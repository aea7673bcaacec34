"""Readers and writers of the line-oriented exchange formats and the Parquet tables.

Every reader takes a path and gives a DataFrame; malformed and blank lines are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAPER_SCHEMA = (
    "id string, title string, abstract string, authors string, categories string, "
    "update_date string, submitter string, versions array<struct<version:string,created:string>>"
)
METADATA_FIELDS = ("original_id", "title", "authors", "category", "date")


def parse_papers(lines: DataFrame, line: str = "value") -> DataFrame:
    """JSON lines to paper rows, other columns kept. Blank, malformed and non-object lines
    are dropped; absent keys are null."""
    parsed = F.from_json(line, PAPER_SCHEMA + ", __bad string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    usable = F.ltrim(F.col(line)).startswith("{")
    return (
        lines.filter(usable)
        .withColumn("__p", parsed)
        .filter(F.col("__p").isNotNull() & F.col("__p.__bad").isNull())
        .select(*[c for c in lines.columns if c != line], "__p.*")
        .drop("__bad")
    )


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines scan of raw papers."""
    return parse_papers(spark.read.text(path))


def parse_citations(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines holding objects ``source -> [references]`` to rows (src, ref); a source
    without references keeps one row with a null ``ref``."""
    parsed = F.from_json(line, "map<string,array<string>>")
    return (
        lines.withColumn("__m", parsed)
        .filter("__m is not null")
        .select(*[c for c in lines.columns if c != line], F.explode("__m").alias("src", "refs"))
        .select("*", F.explode_outer("refs").alias("ref"))
        .drop("refs")
    )


def read_citations(spark: SparkSession, path: str) -> DataFrame:
    """Scan of citation dictionaries."""
    return parse_citations(spark.read.text(path))


def parse_tsv(lines: DataFrame, line: str = "value") -> DataFrame:
    """Split at the first tab into (doc_key, content); lines without a tab are dropped."""
    at = F.instr(line, "\t")
    return lines.filter(at > 0).select(
        *[c for c in lines.columns if c != line],
        F.expr(f"substring(`{line}`, 1, instr(`{line}`, '\\t') - 1)").alias("doc_key"),
        F.expr(f"substring(`{line}`, instr(`{line}`, '\\t') + 1)").alias("content"),
    )


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Scan of the clean text file."""
    return parse_tsv(spark.read.text(path))


def write_tsv(docs: DataFrame, path: str) -> None:
    """Sink of (doc_key, content) lines."""
    docs.select(F.concat_ws("\t", "doc_key", "content").alias("value")).write.mode("overwrite").text(path)


def parse_metadata(line: Column) -> Column:
    """Struct of the first five pipe-separated fields; missing ones are '', surplus ignored."""
    parts = F.split(line, r"\|", -1)
    return F.struct(
        *[F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(f) for i, f in enumerate(METADATA_FIELDS)]
    )


def metadata_line(*fields: Column) -> Column:
    """The pipe-separated form of one metadata row; null fields become ''."""
    return F.concat_ws("|", *[F.coalesce(f, F.lit("")) for f in fields])


def read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """Each file of a folder as one row (path, value)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), "value"
    )


def write_table(df: DataFrame, path: str, sort: list[str] | None = None, by: list[str] | None = None) -> None:
    """Parquet sink; sorted within files so row-group statistics prune point lookups."""
    if sort:
        df = df.sortWithinPartitions(*sort)
    out = df.write.mode("overwrite")
    (out.partitionBy(*by) if by else out).parquet(path)


def write_barrels(postings: DataFrame, path: str, width: int = 50_000) -> None:
    """Postings by word-id range: one folder per ``width`` ids, sorted by word and document.
    Rows of one barrel are spread over tasks by word, so a wide barrel is no single task."""
    ranged = postings.withColumn("barrel", F.expr(f"word_id div {int(width)}"))
    write_table(ranged.repartitionByRange("word_id", "doc_id"), path, ["barrel", "word_id", "doc_id"], ["barrel"])


def lookup_barrel(spark: SparkSession, path: str, word_id: int | list[int], width: int = 50_000) -> DataFrame:
    """Postings of some word ids: partition pruning picks their barrels, row groups the words."""
    ids = word_id if isinstance(word_id, list) else [word_id]
    if not ids:
        return spark.read.parquet(path).filter(F.lit(False))
    barrels = sorted({i // width for i in ids})
    return spark.read.parquet(path).filter(F.col("barrel").isin(barrels) & F.col("word_id").isin(ids))


def associations_json(assoc: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """(value): one JSON object per target word: ``{"word": [associated words in rank order]}``. Words of
    ``vocab`` without any get an empty list."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "context")))  # at most k of a word
    lists = assoc.groupBy("target").agg(F.transform(ranked, lambda s: s["context"]).alias("words"))
    if vocab is not None:
        lists = vocab.select(F.col("word").alias("target")).join(lists, "target", "left").withColumn(
            "words", F.coalesce("words", F.array().cast("array<string>")))
    return lists.select(F.to_json(F.create_map("target", "words")).alias("value"))


def write_associations(assoc: DataFrame, vocab: DataFrame, path: str) -> None:
    """Sink of the association lists."""
    associations_json(assoc, vocab).write.mode("overwrite").text(path)


def read_associations(spark: SparkSession, path: str) -> DataFrame:
    """Inverse of ``associations_json``: rows (target, rank, context); a word with an empty
    list has one row without rank and context."""
    return (
        spark.read.text(path)
        .select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("target", "words"))
        .select("target", F.posexplode_outer("words").alias("pos", "context"))
        .select("target", (F.col("pos") + 1).cast("long").alias("rank"), "context")
    )

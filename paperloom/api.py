"""The engine as one object: build, search, suggest, upload, swap and health.

An index is a list of segments, folders of Parquet tables: one of the build and one of each
upload since. A version is a small file that lists its segments, and a pointer file names the
version in use. Both a build and an upload write new folders first and publish last, by that
one small write: a failure halfway leaves the version in use as it was, and readers pick a
new one up at their next call.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import content_tokens
from paperloom.operators import associations, expand, graph, index, ingest, search, suggest
from paperloom.runtime import exists, release, store
from paperloom.sources.files import read_whole_files, write_associations, write_table

#: Tables that uploads add to.
GROWING = ("postings", "lengths", "meta", "lexicon")
META = ("doc_id", "id", "title", "authors", "category", "date")


def _segment(n: int) -> str:
    """A new segment's name; names sort in the order of their numbers."""
    return f"s-{n:09d}-{uuid.uuid4().hex}"


class Engine:
    """A searchable index in ``path``, which all executors must reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._tables: dict[tuple[str, str], DataFrame] = {}

    # --- versions --------------------------------------------------------------------------

    def version(self) -> str | None:
        """Name of the published version; None before the first build."""
        if not exists(self.spark, f"{self.path}/CURRENT"):
            return None
        return self.spark.read.text(f"{self.path}/CURRENT").first()[0]

    def publish(self, version: str) -> None:
        """Make ``version`` the one in use."""
        self.spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/CURRENT")

    def segments(self, version: str) -> list[str]:
        """The segments of a version in the order they were added."""
        return [r["value"] for r in sorted(self.spark.read.text(f"{self.path}/{version}").collect())]

    def _add_version(self, segments: list[str]) -> str:
        """Write the list of a new version and publish it."""
        version = f"v-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(x,) for x in segments], "value string").coalesce(1).write.text(f"{self.path}/{version}")
        self.publish(version)
        return version

    def table(self, name: str) -> DataFrame:
        """A table of the published version, over all its segments that have it."""
        version = self.version()
        if version is None:
            raise RuntimeError("nothing has been built yet")
        key = (version, name)
        if key not in self._tables:
            self._tables = {k: t for k, t in self._tables.items() if k[0] == version}
            segments = self.segments(version) if name in GROWING else self.segments(version)[:1]
            self._tables[key] = self.spark.read.parquet(*[f"{self.path}/{x}/{name}" for x in segments])
        return self._tables[key]

    # --- build -----------------------------------------------------------------------------

    def build(self, docs: DataFrame, meta: DataFrame, edges: DataFrame | None = None, min_freq: int = suggest.MIN_FREQ) -> str:
        """Index ``docs`` (doc_id, doc_key, text) with ``meta`` (doc_id, id, title, authors,
        category, date) and citation ``edges`` (src, dst); gives the version's name.

        Postings are range-partitioned and sorted by word, so that a query's term filter
        skips all files and row groups but a few.
        """
        segment = _segment(0)
        out = f"{self.path}/{segment}"
        post = index.postings(docs)
        write_table(post.repartitionByRange("word", "doc_id"), f"{out}/postings", ["word", "doc_id"])
        stored = self.spark.read.parquet(f"{out}/postings")
        write_table(index.doc_lengths(docs), f"{out}/lengths")
        write_table(meta.select(*META), f"{out}/meta", ["doc_id"])
        write_table(index.lexicon(docs), f"{out}/lexicon", ["word"])
        write_table(suggest.vocabulary(stored, min_freq).repartitionByRange("word"), f"{out}/vocab", ["word"])
        ranks = graph.pagerank(graph.clean_edges(edges)).ranks if edges is not None else self.spark.createDataFrame([], "id long, score double")
        write_table(ranks.select(F.col("id").alias("doc_id"), "score"), f"{out}/ranks")
        rows = associations.trainer_rows(docs)
        vocab = store(associations.vocabulary(rows, min_freq))
        write_table(associations.top_contexts(associations.cooccurrence(rows, vocab)), f"{out}/assoc", ["target"])
        write_associations(self.spark.read.parquet(f"{out}/assoc"), vocab, f"{out}/assoc_json")
        return self._add_version([segment])

    # --- queries ---------------------------------------------------------------------------

    def hits(self, line: str, doc_limit: int = 0) -> DataFrame:
        """Primary results of a search line with its flags; ``doc_limit`` keeps ids below it."""
        cmd = search.parse_command(line)
        lengths = self.table("lengths")
        if doc_limit:
            lengths = lengths.filter(F.col("doc_id") < doc_limit)
        found = search.match(self.table("postings"), lengths, cmd.terms)
        return search.top(search.with_links(found, self.table("ranks")), self.table("meta"), cmd.category, cmd.by_date)

    def expanded(self, line: str, doc_limit: int = 0, primary: DataFrame | None = None) -> DataFrame:
        """``hits``, or what is given for them, followed by those of associated words."""
        lengths = self.table("lengths")
        if doc_limit:
            lengths = lengths.filter(F.col("doc_id") < doc_limit)
        syns = expand.synonyms(self.table("assoc"), line)
        extra = expand.synonym_hits(syns, self.table("postings"), lengths, self.table("ranks"))
        return expand.merge(self.hits(line, doc_limit) if primary is None else primary, extra, self.table("meta"))

    def search(self, line: str, doc_limit: int = 0, page: int | None = None) -> dict:
        """``{"results": […], "time_ms": n}``; an empty line has no results. The time is that of
        the primary search alone, without expansion, merging and output."""
        if not line.strip():
            return {"results": [], "time_ms": 0}
        began = time.perf_counter()
        primary = store(self.hits(line, doc_limit))
        spent = int((time.perf_counter() - began) * 1000)
        rows = self.expanded(line, doc_limit, primary)
        if page is not None:
            rows = search.page(rows, page)
        results = [r.asDict() for r in sorted(rows.collect(), key=lambda r: r["rank"])]
        release(primary)
        return {"results": results, "time_ms": spent}

    def suggest(self, prefix: str) -> dict:
        """``{"suggestions": […]}``, at most five words."""
        best = suggest.suggest(self.table("vocab"), prefix).collect()
        return {"suggestions": [r["word"] for r in sorted(best, key=lambda r: r["rank"])]}

    def command(self, line: str) -> dict:
        """One line of the command language: ``/suggest prefix`` or a search."""
        head, _, rest = line.strip().partition(" ")
        return self.suggest(rest.strip()) if head == "/suggest" else self.search(line)

    def run(self, lines: Iterable[str]) -> Iterator[dict]:
        """Answers to a stream of command lines, one each, until it ends or a line is ``exit``."""
        for line in lines:
            if line.rstrip("\r\n") == "exit":
                return
            yield self.command(line)

    # --- ingestion -------------------------------------------------------------------------

    def upload(self, folder: str) -> int:
        """Append every file of ``folder`` as a document; gives their number.

        Postings, lengths, metadata, lexicon and forward rows of the new documents are
        written as one segment and published together; link scores, suggestions and
        associations wait for the next build. One writer at a time.
        """
        version = self.version()
        files = read_whole_files(self.spark, folder)
        start = self.table("lengths").agg(F.coalesce(F.max("doc_id") + 1, F.lit(0))).first()[0]
        rows = store(ingest.assign_ids(ingest.parse_uploads(files), start, "path"))
        docs = rows.select("doc_id", F.col("value").alias("text"))
        before = self.segments(version)
        segment = _segment(len(before))
        out = f"{self.path}/{segment}"
        lex = self.table("lexicon").select("word_id", "word")
        write_table(ingest.lexicon_delta(docs, lex), f"{out}/lexicon", ["word"])
        write_table(index.postings(docs), f"{out}/postings", ["word", "doc_id"])
        write_table(ingest.appended_rows(rows).select("doc_id", F.col("original_id").alias("id"), "title", "authors", "category", "date"), f"{out}/meta")
        write_table(docs.select("doc_id", F.size(content_tokens(F.col("text"))).cast("long").alias("dl")), f"{out}/lengths")
        grown = lex.unionByName(self.spark.read.parquet(f"{out}/lexicon").select("word_id", "word"))
        write_table(index.forward_index(self.spark.read.parquet(f"{out}/postings"), grown), f"{out}/forward")
        n = rows.count()
        release(rows)
        self._add_version([*before, segment])
        return n

    def health(self) -> dict:
        """Whether a session and an index are there."""
        stopped = self.spark.sparkContext._jsc.sc().isStopped()
        return {"status": "offline" if stopped or self.version() is None else "online"}

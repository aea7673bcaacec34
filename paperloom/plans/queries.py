"""The engine's queries: each takes (spark, data folder) and gives flat, fully aliased rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.ids import graph_key, metadata_key
from paperloom.functions.text import clean_line, content_line, content_tokens, tokens, trainer_tokens
from paperloom.operators import associations, expand, graph, index, ingest, metadata, multivalue, orphans, search, suggest
from paperloom.plans import fixtures
from paperloom.plans.stored import stored
from paperloom.runtime import read_table, store, work_path
from paperloom.sources import files

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
#: Parameters of the sample searches.
SINGLE, PAIR, CATEGORY, PREFIX, BARREL = "spectrum", "spectrum noisy", "alg", "th", 1000
EXPANDED = "spectrum matrix"


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def _post(s: SparkSession, d: str) -> DataFrame:
    return index.postings(fixtures.corpus(s, d))


def _lengths(s: SparkSession, d: str) -> DataFrame:
    return index.doc_lengths(fixtures.corpus(s, d))


def _counted(s: SparkSession, d: str, words: Callable) -> DataFrame:
    return (fixtures.corpus(s, d).select("doc_id", F.explode(words(F.col("text"))).alias("word"))
            .groupBy("doc_id", "word").agg(F.count("*").alias("tf")))


# --- functions and sources -----------------------------------------------------------------

@query
def tokenize(s, d):
    return _counted(s, d, tokens)


@query
def tokenize_nostop(s, d):
    return _counted(s, d, content_tokens)


@query
def clean_text(s, d):
    p = read_table(s, d, "raw_papers")
    return p.select("line_no", clean_line(F.col("title")).alias("title"), content_line(
        *[F.col(c) for c in ("title", "authors", "abstract", "categories", "update_date")]).alias("content"))


@query
def id_normalize(s, d):
    p = read_table(s, d, "raw_papers")
    return p.select("line_no", graph_key(F.col("id")).alias("graph_key"), metadata_key(F.col("id")).alias("meta_key"))


@query
def metadata_clean(s, d):
    return metadata.paper_metadata(read_table(s, d, "raw_papers")).drop("doc_key")


@query
def src_jsonl_clean(s, d):
    parsed = files.parse_papers(fixtures.paper_lines(s, d))
    return parsed.select("line_no", F.coalesce("id", F.lit("Unknown")).alias("doc_key"), content_line(
        *[F.col(c) for c in ("title", "authors", "abstract", "categories", "update_date")]).alias("content"))


@query
def src_tsv_split(s, d):
    lines = read_table(s, d, "raw_papers").select("line_no", F.concat_ws(
        "\t", clean_line(F.col("id")), "abstract").alias("value"))
    return files.parse_tsv(lines)


@query
def src_citation_explode(s, d):
    rows = files.parse_citations(fixtures.citation_lines(s, d))
    return rows.select(graph_key(F.col("src")).alias("src"), graph_key(F.col("ref")).alias("ref")).groupBy("src", "ref").agg(
        F.count("*").alias("n"))


@query
def src_tsv_file(s, d):
    """The clean text file written and scanned again; a content with a line end is several lines."""
    path, p = work_path(s), read_table(s, d, "raw_papers")
    files.write_tsv(p.select(clean_line(F.col("id")).alias("doc_key"), content_line(F.col("title"), F.col("abstract")).alias("content")), path)
    return files.read_tsv(s, path)


@query
def src_whole_files(s, d):
    """A folder of uploaded files, one row each."""
    path = work_path(s)
    read_table(s, d, "nation").select("n_nationkey", F.concat_ws("\n", "n_name", F.col("n_regionkey").cast("string")).alias("value")).write.partitionBy("n_nationkey").text(path)
    return files.read_whole_files(s, f"{path}/*").select("value")


@query
def metadata_parse(s, d):
    m = read_table(s, d, "doc_metadata")
    line = files.metadata_line(*[F.col(c) for c in ("original_id", "title", "authors", "category")])
    return m.select("line_no", files.parse_metadata(line).alias("m")).select("line_no", "m.*")


# --- index ---------------------------------------------------------------------------------

@query
def id_map(s, d):
    return index.id_map(fixtures.corpus(s, d))


@query
def lexicon(s, d):
    return index.lexicon(fixtures.corpus(s, d))


@query
def forward_index(s, d):
    docs = store(fixtures.corpus(s, d))
    return index.forward_index(store(index.postings(docs)), index.lexicon(docs))


@query
def doc_lengths(s, d):
    return _lengths(s, d)


@query
def doc_lengths_universe(s, d):
    ids = read_table(s, d, "id_map").select("doc_id").distinct()
    flat = read_table(s, d, "forward_index").filter("freq > 0").distinct()
    return index.doc_lengths_of_universe(ids, flat.withColumnRenamed("freq", "tf"))


@query
def corpus_stats(s, d):
    return index.corpus_stats(_lengths(s, d)).select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query
def inverted_index(s, d):
    return index.inverted_digest(_post(s, d))


@query
def barrel_stats(s, d):
    flat = read_table(s, d, "forward_index").filter("freq > 0").distinct()
    return index.barrel_stats(flat, BARREL)


@query
def inverted_lists(s, d):
    """Every posting list, in blocks of ``BARREL`` documents, as ``document:count`` texts."""
    text = lambda p: F.concat_ws(":", p["doc_id"].cast("string"), p["tf"].cast("string"))
    return index.inverted_lists(_post(s, d), BARREL).select("word", "block", F.array_join(F.transform("postings", text), " ").alias("postings"))


@query
def index_build(s, d):
    """(name, n): the rows of the stored tables that searches read, built if they are not yet."""
    t = stored(s, d)
    tables = {"docs": t.docs, "meta": t.meta, "postings": t.postings, "lengths": t.lengths, "lexicon": t.lexicon, "barrels": s.read.parquet(t.barrels)}
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in tables.items()])


@query
def barrel_postings(s, d):
    """The stored barrels read back."""
    return s.read.parquet(stored(s, d).barrels).select("barrel", "word_id", "doc_id", "freq")


@query
def postings_lookup(s, d):
    return stored(s, d).lookup([SINGLE]).select("doc_id", "tf")


@query
def idf(s, d):
    return index.idf_table(_post(s, d), index.corpus_stats(_lengths(s, d))).select("word", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_term(s, d):
    docs = store(fixtures.corpus(s, d))
    lengths = store(index.doc_lengths(docs))
    w = index.bm25_terms(store(index.postings(docs)), lengths, index.corpus_stats(lengths))
    return w.select("doc_id", "word", F.round("weight", 6).alias("weight"))


# --- metadata ------------------------------------------------------------------------------

@query
def metadata_extract(s, d):
    return metadata.extract(read_table(s, d, "raw_papers"), read_table(s, d, "id_map"))


# --- search --------------------------------------------------------------------------------

def _search(s, d, line, limit=0, linked=False, cap=search.RESULT_CAP) -> DataFrame:
    cmd, t = search.parse_command(line), stored(s, d)
    lengths = t.lengths.filter(F.col("doc_id") < limit) if limit else t.lengths
    hits = search.match(t.lookup(cmd.terms), lengths, cmd.terms)
    if linked:
        hits = search.with_links(hits, t.ranks)
    return search.top(hits, t.meta, cmd.category, cmd.by_date, cap)


@query
def search_single(s, d):
    return _search(s, d, SINGLE)


@query
def search_and(s, d):
    return _search(s, d, PAIR)


@query
def search_stopwords_only(s, d):
    return _search(s, d, "the of")


@query
def search_unknown_term(s, d):
    return _search(s, d, f"{SINGLE} zzzzqx")


@query
def search_category(s, d):
    return _search(s, d, f"{PAIR} /cat:x /cat:{CATEGORY}")


@query
def search_date_sort(s, d):
    return _search(s, d, f"{PAIR} /date")


@query
def search_doc_limit(s, d):
    return _search(s, d, PAIR, limit=500)


@query
def hybrid_search(s, d):
    return _search(s, d, PAIR, linked=True)


@query
def paginate(s, d):
    return search.page(_search(s, d, PAIR), 1)


@query
def result_json(s, d):
    return search.result_json(_search(s, d, PAIR))


@query
def result_display(s, d):
    return search.result_display(_search(s, d, PAIR))


# --- graph ---------------------------------------------------------------------------------

def _edges(s, d) -> DataFrame:
    return graph.clean_edges(read_table(s, d, "graph_edges"))


@query
def graph_edges(s, d):
    return _edges(s, d).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query
def graph_nodes(s, d):
    return graph.graph_nodes(_edges(s, d))


@query
def graph_degree(s, d):
    return graph.out_degrees(_edges(s, d))


@query
def graph_dangling(s, d):
    return graph.dangling(_edges(s, d))


@query
def graph_build(s, d):
    """The graph of the citation file: edges by mapped ids, with their multiplicity."""
    return graph.build_graph(files.parse_citations(fixtures.citation_lines(s, d)))[1].groupBy("src", "dst").agg(F.count("*").alias("n"))


@query
def graph_build_nodes(s, d):
    """Its nodes with their keys; a document without references has degree 0."""
    keys, _, nodes = graph.build_graph(files.parse_citations(fixtures.citation_lines(s, d)))
    return keys.join(nodes, "id").select("id", "doc_key", "degree")


@query
def pagerank_iter10(s, d):
    return graph.pagerank(_edges(s, d), max_iter=10, tol=None).ranks.select("id", F.round("score", 10).alias("score"))


@query
def pagerank(s, d):
    return graph.pagerank(_edges(s, d)).ranks.select("id", F.round("score", 10).alias("score"))


# --- suggestions and associations ----------------------------------------------------------

@query
def suggest_vocab(s, d):
    return suggest.vocabulary(_post(s, d))


@query
def suggest_top5(s, d):
    return suggest.suggest(suggest.vocabulary(_post(s, d)), PREFIX)


@query
def suggest_prefix_table(s, d):
    return suggest.prefix_table(suggest.vocabulary(_post(s, d)))


@query
def assoc_tokens(s, d):
    return _counted(s, d, trainer_tokens)


def _vocab(s, d) -> tuple[DataFrame, DataFrame]:
    rows = associations.trainer_rows(fixtures.corpus(s, d))
    return rows, associations.vocabulary(rows)


@query
def assoc_vocab(s, d):
    return _vocab(s, d)[1]


@query
def assoc_cooccurrence(s, d):
    return associations.cooccurrence(*_vocab(s, d))


@query
def assoc_top20(s, d):
    return associations.top_contexts(associations.cooccurrence(*_vocab(s, d)))


@query
def query_synonyms(s, d):
    return expand.synonyms(assoc_top20(s, d), EXPANDED)


@query
def assoc_export(s, d):
    """The association file's lines; words without associations have an empty list."""
    t = stored(s, d)
    return files.associations_json(t.assoc, t.vocabulary)


def _expanded(s, d, ranks: DataFrame) -> DataFrame:
    t, terms = stored(s, d), search.parse_command(EXPANDED).terms
    syns = expand.synonyms(t.assoc, EXPANDED)
    asked = [r["syn"] for r in syns.select("syn").collect()]  # at most two a query word
    extra = expand.synonym_hits(syns, t.lookup(asked), t.lengths, ranks)
    primary = search.top(search.with_links(search.match(t.lookup(terms), t.lengths, terms), ranks), t.meta)
    return expand.merge(primary, extra, t.meta).select("rank", "doc_id", "id", "title", "authors", "category", "date",
                                                       F.round("score", 6).alias("score"))


@query
def expanded_search(s, d):
    """By text alone, as its SQL has it."""
    return _expanded(s, d, s.createDataFrame([], "doc_id long, score double"))


@query
def expanded_hybrid_search(s, d):
    """With link scores in both lists, as the engine ranks."""
    return _expanded(s, d, stored(s, d).ranks)


# --- ingestion -----------------------------------------------------------------------------

def _uploads(s, d) -> DataFrame:
    return ingest.parse_uploads(fixtures.paper_lines(s, d))


@query
def ingest_parse(s, d):
    return _uploads(s, d).drop("value")


@query
def ingest_title_fallback(s, d):
    texts = read_table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("value"))
    return ingest.parse_uploads(texts).select("doc_id", "title", "authors", "date", "original_id")


def _new_docs(s, d) -> DataFrame:
    papers = read_table(s, d, "raw_papers").select(F.col("line_no").alias("doc_id"), F.col("abstract").alias("text"))
    return papers


@query
def ingest_lexicon_delta(s, d):
    old = read_table(s, d, "lexicon").select("word_id", F.lower(F.trim("word")).alias("word"))
    return ingest.lexicon_delta(_new_docs(s, d), old)


def _assigned(s, d) -> DataFrame:
    first = fixtures.corpus(s, d).agg(F.coalesce(F.max("doc_id") + 1, F.lit(0))).first()[0]
    return ingest.assign_ids(_uploads(s, d), first, "line_no")


@query
def ingest_append(s, d):
    return ingest.appended_rows(_assigned(s, d))


@query
def ingest_forward(s, d):
    """The forward rows of uploads, whose lexicon grows by their new words."""
    docs = store(_assigned(s, d).select("doc_id", F.col("value").alias("text")))
    return ingest.appended_forward(docs, stored(s, d).lexicon.select("word_id", "word"))


@query
def stream_ingest(s, d):
    from paperloom.streaming.ingest import ingest_folder_once

    return ingest_folder_once(fixtures.paper_lines(s, d))


# --- training-data problems of the core ----------------------------------------------------

def _orphans(s, d) -> DataFrame:
    ids = read_table(s, d, "id_map")
    meta, edges, hits = (read_table(s, d, t) for t in ("doc_metadata", "graph_edges", "search_results"))
    by_key = ids.select(metadata_key(F.col("doc_key")).alias("key"), "mapped_at", "deleted_at")
    by_id = ids.select(F.col("doc_id").alias("key"), "mapped_at", "deleted_at")
    return orphans.find_orphans({"key": by_key, "id": by_id}, [
        orphans.Child(meta, "doc_metadata", "original_id", metadata_key(F.col("original_id")), "line_no", "loaded_at", "key"),
        orphans.Child(edges, "graph_edges", "src", F.col("src"), "edge_id", "loaded_at", "id"),
        orphans.Child(edges, "graph_edges", "dst", F.col("dst"), "edge_id", "loaded_at", "id"),
        orphans.Child(hits, "search_results", "doc_id", F.col("doc_id"), "hit_id", "ran_at", "id")])


@query
def p2_found(s, d):
    return _orphans(s, d)


@query
def p2_report(s, d):
    return orphans.orphan_report(_orphans(s, d))


@query
def p3_found(s, d):
    return multivalue.values(read_table(s, d, "raw_papers"), "line_no", {"authors": "names", "categories": "codes"})


@query
def p3_codes(s, d):
    """The values of the code field alone, which SQL can split as well."""
    return multivalue.values(read_table(s, d, "raw_papers"), "line_no", {"categories": "codes"}).drop("field")

"""Small worked collections for index, search, graph, suggestion, association and ingestion."""

from __future__ import annotations

import json
import math

from pyspark.sql import functions as F

from paperloom.operators import associations, expand, graph, index, ingest, metadata, search, suggest
from paperloom.runtime import dense_ids
from paperloom.sources import files

DOCS = [(0, "graph theory graph"), (1, "graph matrix"), (2, ""), (3, None), (4, "matrix the of")]


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, text string")


def meta(spark):
    return spark.createDataFrame([(i, f"id{i}", f"T{i}", "A" * 90, c, d) for i, c, d in (
        (0, "physics", "2024-01-01"), (1, "cs.AI", "N/A"), (4, "math", "2023-05-05"))],
        "doc_id long, id string, title string, authors string, category string, date string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_index(spark):
    d = docs(spark)
    post, lengths = index.postings(d), index.doc_lengths(d)
    assert rows(post) == [(0, "graph", 2), (0, "theory", 1), (1, "graph", 1), (1, "matrix", 1), (4, "matrix", 1)]
    assert rows(lengths) == [(0, 3), (1, 2), (2, 0), (3, 0), (4, 1)]
    assert rows(index.corpus_stats(lengths)) == [(5, 6 / 5)]
    assert rows(index.lexicon(d)) == [(0, "graph"), (1, "theory"), (2, "matrix")]
    fwd = index.forward_index(post, index.lexicon(d))
    assert rows(fwd.select("doc_id", "word_id", "freq", "total", "uniq"))[0] == (0, 0, 2, 3, 2)
    lists = {(r["word"], r["block"]): [tuple(p) for p in r["postings"]] for r in index.inverted_lists(post, 1).collect()}
    assert lists[("graph", 0)] == [(0, 2)] and lists[("graph", 1)] == [(1, 1)]
    assert rows(index.corpus_stats(index.doc_lengths(docs(spark, [])))) == [(0, 0.0)]


def test_dense_ids(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), F.col("id")).alias("k")).repartition(7)
    got = [r["k"] for r in dense_ids(df, [F.col("k")], "n").orderBy("n").collect()]
    assert got == sorted(got) and len(got) == 1000
    assert rows(dense_ids(df, [F.col("k")], "n").agg(F.min("n"), F.max("n"))) == [(0, 999)]
    assert dense_ids(df.limit(0), [F.col("k")]).count() == 0


def test_bm25_by_hand(spark):
    d = docs(spark)
    post, lengths = index.postings(d), index.doc_lengths(d)
    hits = {r["doc_id"]: r["score"] for r in search.match(post, lengths, ["graph"]).collect()}
    idf = math.log((5 - 2 + 0.5) / 2.5 + 1)
    assert math.isclose(hits[0], idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 1.2)))
    assert set(hits) == {0, 1}
    assert rows(search.match(post, lengths, ["graph", "matrix"]).select("doc_id")) == [(1,)]
    assert search.match(post, lengths, []).count() == 0
    assert search.match(post, lengths, ["graph", "zzz"]).count() == 0


def test_top_filters_and_order(spark):
    d, m = docs(spark), meta(spark)
    hits = spark.createDataFrame([(0, 1.0), (1, 2.0), (4, 1.0)], "doc_id long, score double")
    assert [r["doc_id"] for r in search.top(hits, m).orderBy("rank").collect()] == [1, 0, 4]
    assert [r["doc_id"] for r in search.top(hits, m, category="cs").orderBy("rank").collect()] == [1, 0]  # physics holds cs
    assert [r["doc_id"] for r in search.top(hits, m, by_date=True).orderBy("rank").collect()] == [1, 0, 4]
    assert search.top(hits, m, cap=2).count() == 2
    assert rows(search.page(search.top(hits, m), 1, 2).select("doc_id")) == [(4,)]
    line = search.result_display(search.top(hits, m)).filter("rank = 1").first()["line"]
    assert line == f"T1 / {'A' * 80}... / https://arxiv.org/abs/id1"
    assert json.loads(search.result_json(search.top(hits, m)).filter("rank = 1").first()["json"])["score"] == "2.0000"
    linked = search.with_links(hits, spark.createDataFrame([(0, 0.1)], "doc_id long, score double"))
    assert dict(rows(linked))[0] == 6.0


def test_pagerank(spark):
    e = spark.createDataFrame([(0, 1), (1, 0), (0, 2)], "src long, dst long")
    pr = graph.pagerank(e)
    r = {x["id"]: x["score"] for x in pr.ranks.collect()}
    assert math.isclose(sum(r.values()), 1.0, abs_tol=1e-9) and pr.error < 1e-9
    assert math.isclose(r[1], r[2]) and r[0] > r[1]
    cycle = graph.pagerank(spark.createDataFrame([(0, 1), (1, 0)], "src long, dst long"))
    assert all(math.isclose(x["score"], 0.5) for x in cycle.ranks.collect())
    twice = graph.pagerank(spark.createDataFrame([(0, 1), (0, 1), (0, 2), (1, 0), (2, 0)], "src long, dst long")).ranks
    got = {x["id"]: x["score"] for x in twice.collect()}
    assert got[1] > got[2]
    assert graph.pagerank(e.limit(0)).ranks.count() == 0
    assert rows(graph.dangling(e)) == [(2,)] and rows(graph.out_degrees(e)) == [(0, 2), (1, 1)]
    dirty = spark.createDataFrame([(0, None), (None, 1), (2, 2)], "src long, dst long")
    assert rows(graph.clean_edges(dirty)) == [(2, 2)]


def test_suggest(spark):
    post = spark.createDataFrame([(0, w, f) for w, f in (("the", 60), ("then", 50), ("they", 60), ("that", 49))], "doc_id long, word string, tf long")
    v = suggest.vocabulary(post)
    assert [r["word"] for r in suggest.suggest(v, "TH").orderBy("rank").collect()] == ["the", "they", "then"]
    assert suggest.suggest(v, "").count() == 0
    assert rows(suggest.prefix_table(v).filter("prefix = 't'").select("rank", "word")) == [(1, "the"), (2, "they"), (3, "then")]


def test_associations_against_brute_force(spark):
    words = "alpha beta alpha gamma delta beta alpha epsilon gamma beta".split()
    table = spark.createDataFrame([(0, "k", " ".join(words)), (1, "k", "alpha beta"), (2, "k", None)], "doc_id long, doc_key string, text string")
    r = associations.trainer_rows(table)
    vocab = associations.vocabulary(r, min_freq=2)
    kept = {x["word"] for x in vocab.collect()}
    assert kept == {"alpha", "beta", "gamma"}
    expected = {}
    for seq in (words, ["alpha", "beta"]):
        seq = [w for w in seq if w in kept]
        for i, a in enumerate(seq):
            for j in range(max(0, i - 2), min(len(seq), i + 3)):
                if i != j:
                    expected[a, seq[j]] = expected.get((a, seq[j]), 0) + 1
    pairs = associations.cooccurrence(r, vocab, window=2)
    assert {(x["target"], x["context"]): x["cnt"] for x in pairs.collect()} == expected
    assert {x["rank"] for x in associations.top_contexts(pairs, 1).collect()} == {1}


def test_expansion(spark):
    assoc = spark.createDataFrame([("deep", 1, "deep"), ("deep", 2, "net"), ("deep", 3, "x"), ("net", 1, "deep")], "target string, rank long, context string")
    assert rows(expand.synonyms(assoc, "Deep graph,")) == [(1, "deep", "net")]
    assert expand.synonyms(assoc, "").count() == 0
    m = meta(spark)
    primary = search.top(spark.createDataFrame([(0, 3.0)], "doc_id long, score double"), m)
    extra = spark.createDataFrame([(1, "net", 0, 9.0, 1), (1, "net", 4, 2.0, 2)], "seq long, syn string, doc_id long, score double, place long")
    merged = expand.merge(primary, extra, m)
    assert rows(merged.select("rank", "doc_id", "title", "score")) == [(1, 0, "T0", 3.0), (2, 4, "[Related to net] T4", 1.0)]
    assert expand.merge(primary, extra, m, cap=1).count() == 1


def test_metadata(spark):
    papers = spark.createDataFrame(
        [(0, "arXiv:a1v2", "Old", None, "c", "d"), (1, "a1", "New|x", "", "c", "d"), (2, "zz", "t", "a", "c", "d"), (3, None, None, None, None, None)],
        "line_no long, id string, title string, authors string, categories string, update_date string")
    ids = spark.createDataFrame([("a1", 5), ("b", 7), ("b", 9)], "doc_key string, doc_id long")
    blank = lambda i: (i, "UnknownID", f"Unknown Title (Doc #{i})", "Unknown", "N/A", "N/A")
    assert rows(metadata.extract(papers, ids)) == [(5, "a1", "New-x", "Unknown", "c", "d") if i == 5 else blank(i) for i in range(10)]
    assert metadata.extract(papers, ids.limit(0)).count() == 0


def test_parsers(spark):
    lines = spark.createDataFrame([('{"id": "1", "title": "t"}',), ("",), ("{bad",), ("[1]",), (None,)], "value string")
    assert rows(files.parse_papers(lines).select("id", "title")) == [("1", "t")]
    cites = spark.createDataFrame([('{"a": ["b", "c"], "d": []}',), ("nope",)], "value string")
    assert sorted((r[0], r[1] or "") for r in files.parse_citations(cites).collect()) == [("a", "b"), ("a", "c"), ("d", "")]
    tsv = spark.createDataFrame([("k\tx\ty",), ("none",)], "value string")
    assert rows(files.parse_tsv(tsv)) == [("k", "x\ty")]
    m = spark.createDataFrame([("i|t||c",), ("a|b|c|d|e|f",)], "v string").select(files.parse_metadata(F.col("v")).alias("m")).select("m.*")
    assert rows(m) == [("a", "b", "c", "d", "e"), ("i", "t", "", "c", "")]


def test_files_round_trip(spark, tmp_path):
    docs_ = spark.createDataFrame([("k", "a\tb")], "doc_key string, content string")
    files.write_tsv(docs_, str(tmp_path / "tsv"))
    assert rows(files.read_tsv(spark, str(tmp_path / "tsv"))) == [("k", "a\tb")]
    post = spark.createDataFrame([(i, i % 7, 1) for i in range(50)], "doc_id long, word_id long, freq long")
    files.write_barrels(post, str(tmp_path / "barrels"), width=3)
    assert files.lookup_barrel(spark, str(tmp_path / "barrels"), 4, width=3).count() == 7
    assoc = spark.createDataFrame([("a", 1, "b"), ("a", 2, "c")], "target string, rank long, context string")
    files.associations_json(assoc).write.text(str(tmp_path / "assoc"))
    assert rows(files.read_associations(spark, str(tmp_path / "assoc"))) == [("a", 1, "b"), ("a", 2, "c")]
    vocab = spark.createDataFrame([("a",), ("lone",)], "word string")
    assert rows(files.associations_json(assoc, vocab)) == [('{"a":["b","c"]}',), ('{"lone":[]}',)]
    files.write_associations(assoc, vocab, str(tmp_path / "all"))
    assert files.read_associations(spark, str(tmp_path / "all")).filter("rank is null").first()["target"] == "lone"
    assert files.lookup_barrel(spark, str(tmp_path / "barrels"), [4, 6], width=3).count() == 14
    assert files.lookup_barrel(spark, str(tmp_path / "barrels"), [], width=3).count() == 0


def test_texts_meet_the_map(spark):
    texts = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("zz", "x", 3), (None, "y", 4), ("b", None, 5)], "doc_key string, text string, n long")
    ids = spark.createDataFrame([("a", 3), ("a", 7), ("b", 1), (None, 9)], "doc_key string, doc_id long")
    got = index.mapped_texts(texts, ids, "n").select("doc_id", "doc_key", F.coalesce("text", F.lit("")))
    assert rows(got) == [(1, "b", ""), (7, "a", "new")]
    assert index.mapped_texts(texts.limit(0), ids, "n").count() == 0 == index.mapped_texts(texts, ids.limit(0), "n").count()


def test_graph_of_citations(spark):
    lines = spark.createDataFrame([('{"arXiv:b1v2": ["a", "a", "c"], "d": []}',), ('{"c": ["b1"]}',), ("",), ("bad",)], "value string")
    keys, edges, nodes = graph.build_graph(files.parse_citations(lines))
    assert rows(keys) == [("a", 0), ("b1", 1), ("c", 2), ("d", 3)]
    assert rows(edges) == [(1, 0), (1, 0), (1, 2), (2, 1)]
    assert rows(nodes) == [(0, 0), (1, 3), (2, 1), (3, 0)]


def test_spread_join_and_attach(spark):
    from paperloom.runtime import attach, release, spread_join, store

    big = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(900)], "k long, v long")
    small = store(spark.createDataFrame([(k, k * 10, 900) for k in range(0, 900, 2)], "k long, w long, n long"))
    expected = rows(big.join(small.drop("n"), "k"))
    assert rows(spread_join(big, small.drop("n"), ["k"], 10)) == expected
    assert rows(attach(big, small, "k", "n", most=0, hot_rows=10).drop("n")) == expected == rows(attach(big, small, "k", "n").drop("n"))
    release(small)


def test_ingest(spark):
    up = spark.createDataFrame([
        (0, '{"title": "A|b\\nc", "submitter": "S", "versions": [{"created": "D"}], "id": "x\\ny|z"}'), (1, "First line\nmore"),
        (2, "[1, 2]"), (3, ""), (4, "{broken json")], "n long, value string")
    got = {r["n"]: (r["title"], r["authors"], r["date"], r["original_id"]) for r in ingest.parse_uploads(up).collect()}
    assert got[0] == ("A-b c", "S", "D", "xy-z")
    assert got[1][0] == "First line" and got[2][0] == got[3][0] == "Uploaded Document" and got[4][0] == "{broken json"
    assert got[1][1:] == ("System Updater", "2025-01-01", "upload/new")
    lex = spark.createDataFrame([(0, "graph"), (6, "matrix")], "word_id long, word string")
    new = spark.createDataFrame([(0, "graph zeta alpha zeta"), (1, None)], "doc_id long, text string")
    assert rows(ingest.lexicon_delta(new, lex)) == [(7, "zeta"), (8, "alpha")]
    ids = ingest.assign_ids(up.drop("value"), 100, "n")
    assert rows(ids) == [(i, 100 + i) for i in range(5)]


def test_stream(spark, tmp_path):
    from paperloom.streaming.ingest import ingest_stream

    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.json").write_text('{"title": "One", "id": "1"}')
    run = lambda: ingest_stream(spark, str(inbox), str(tmp_path / "table"), str(tmp_path / "state"), first_id=10).awaitTermination()
    run()
    (inbox / "b.txt").write_text("Two words\nbody")
    run()
    got = rows(spark.read.parquet(str(tmp_path / "table")).select("doc_id", "title", "dl"))
    assert got == [(10, "One", 4), (11, "Two words", 3)]


def test_expanded_hybrid_search_ranks_by_links(spark, monkeypatch):
    """Its scores are those by text alone plus 50 link scores, halved for related hits."""
    from paperloom.plans import queries

    given = spark.createDataFrame([(1, "spectrum", "noisy")], "seq long, word string, syn string")  # this data associates nothing
    monkeypatch.setattr(queries.expand, "synonyms", lambda *_: given)
    d = "/root/testdata/sf0.001"
    links = {x["doc_id"]: x["score"] for x in queries.stored(spark, d).ranks.collect()}
    found = queries.REGISTRY["expanded_hybrid_search"](spark, d).collect()
    plain = {(x["doc_id"], x["title"]): x["score"] for x in queries.REGISTRY["expanded_search"](spark, d).collect()}
    both = [(x, plain[x["doc_id"], x["title"]]) for x in found if (x["doc_id"], x["title"]) in plain]
    gain = lambda x: 50 * links.get(x["doc_id"], 0.0) * (0.5 if x["title"].startswith("[Related to ") else 1)
    assert both and all(abs(x["score"] - score - gain(x)) < 5e-6 for x, score in both)
    assert any(gain(x) > 0.001 for x, _ in both)
    assert {x["title"].startswith("[Related to ") for x, _ in both} == {True, False}


def test_laid_out_tables_are_not_shuffled(spark):
    from paperloom.runtime import laid_out, release

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = laid_out(spark.range(1000).selectExpr("id % 50 as k", "id"), n, ["k"], ["k"])
    other = spark.range(2000).selectExpr("id % 60 as k", "id as v").groupBy("k").agg(F.max("v").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = laid.join(other, "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and joined.count() == 1000  # that of the other side
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    release(laid)


def test_a_stored_index_that_is_gone_is_built_again(spark):
    from paperloom.plans.stored import stored
    from paperloom.runtime import discard

    d = "/root/testdata/sf0.001"
    first = stored(spark, d)
    n = first.postings.count()
    assert stored(spark, d) is first
    discard(spark, first.postings._paperloom_path)
    assert stored(spark, d) is not first and stored(spark, d).postings.count() == n

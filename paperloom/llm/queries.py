"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.llm import bpe, distinctive, markup, mixing, names, ranking, residue, terms
from paperloom.plans.queries import Query
from paperloom.runtime import read_table

REGISTRY: dict[str, Query] = {}
#: Size of the mixture in passes over all usable tokens, and the share of it that may repeat.
PASSES, REPEATED = 1.0, 0.2


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def _ranked(s, d):
    hits = ranking.clean_hits(read_table(s, d, "search_results"), read_table(s, d, "pagerank_scores"))
    return ranking.rank_items(hits, "query_id", "doc_id", ["score", "link"])


@query
def p1_found(s, d):
    return ranking.near_top(_ranked(s, d)[0])


@query
def p1_rank(s, d):
    return ranking.places(_ranked(s, d)[0], "query_id", "doc_id").select("query_id", "doc_id", "place", "pos_score", "pos_link")


@query
def p1_component(s, d):
    """The component that ranks: a loading per score, its eigenvalue and its place."""
    c = _ranked(s, d)[1]
    return s.createDataFrame(
        [(n, round(x, 6), round(c.eigenvalue, 6), c.place) for n, x in zip(("score", "link"), c.loadings)],
        "score string, loading double, eigenvalue double, place long")


def _terms(s, d):
    return terms.term_table(read_table(s, d, "forward_index"), read_table(s, d, "lexicon"))


@query
def p4_found(s, d):
    return _terms(s, d).filter("mark is not null").select("word", "mark")


@query
def p4_counts(s, d):
    return _terms(s, d)


def _residuals(s, d):
    return distinctive.score_words(*(read_table(s, d, t) for t in ("forward_index", "lexicon", "doc_metadata")))


@query
def p5_found(s, d):
    return distinctive.beyond_doubt(_residuals(s, d))


@query
def p5_scores(s, d):
    return _residuals(s, d).select("doc_id", "word", "freq", F.round("residual", 6).alias("residual"))


@query
def p6_found(s, d):
    return markup.find_markup(read_table(s, d, "raw_papers"), "line_no", ["title", "abstract"])


@query
def p6_clean(s, d):
    return markup.clean_markup(read_table(s, d, "raw_papers"), "line_no", ["title", "abstract"])


def _spellings(s, d):
    return names.link_names(names.author_values(*(read_table(s, d, t) for t in ("raw_papers", "doc_metadata"))))


@query
def p7_found(s, d):
    return names.spelling_pairs(_spellings(s, d))


@query
def p7_clusters(s, d):
    return _spellings(s, d)


@query
def p8_ids(s, d):
    return bpe.encode(read_table(s, d, "documents"))


def _mix(s, d, **size):
    sized = bpe.count_tokens(read_table(s, d, "documents"), ["doc_id", "source"])
    return mixing.mix(sized, read_table(s, d, "mix_targets"), **size)


@query
def p9_mix(s, d):
    """As many tokens as there are, limits binding, the exponent bisected."""
    return _mix(s, d, passes=PASSES, repeated=REPEATED)[0]


@query
def p9_shares(s, d):
    return _mix(s, d, passes=PASSES, repeated=REPEATED)[1]


@query
def p9_exact(s, d):
    """The largest mixture at which every share is its target."""
    return _mix(s, d)[0]


@query
def p9_exact_shares(s, d):
    return _mix(s, d)[1]


@query
def p10_found(s, d):
    return residue.flag_residue(read_table(s, d, "documents")).filter("residue").select("doc_id")


@query
def p10_kept(s, d):
    return residue.flag_residue(read_table(s, d, "documents")).filter("not residue").select("doc_id")


def llm_sql() -> dict[str, str]:
    from paperloom.llm.oracle import llm_sql as sql

    return sql()

"""Problem 1: one ranking from several differently scaled scores.

Scores are turned to their declared directions and replaced by their positions inside the
group, so neither range nor distribution matters; the first principal component of the
positions' correlation matrix that agrees with the directions weighs them.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.runtime import dense_ids, store


def positions(df: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """Group, item and scores of ``df`` plus, for each score s, ``pos_s`` (1 is the highest,
    ties to the smaller item) and ``n``, the size of the group; other columns are left out.

    A range sort over (group, score, item) numbers all rows at once, so a group holding a
    third of the rows is still spread over all tasks; the group's first number, found by a
    partial aggregate, turns global numbers into positions. (group, item) must be unique.
    """
    df = out = df.select(group, item, *scores)
    for s in scores:
        out = dense_ids(out, [F.col(group), F.desc(s), F.col(item)], f"__{s}")
    out = store(out)
    starts = out.groupBy(group).agg(F.count("*").alias("n"), F.min(f"__{scores[0]}").alias("__start"))
    placed = out.join(starts, group)
    return placed.select(
        *[c for c in df.columns], "n", *[(F.col(f"__{s}") - F.col("__start") + 1).alias(f"pos_{s}") for s in scores])


@dataclass(frozen=True)
class Component:
    """A principal component of rank-transformed scores: its loadings, its eigenvalue and its
    place among the components, 1 for the first. Place 0 is no component but equal weights,
    where no component agrees with the declared directions."""

    loadings: list[float]
    eigenvalue: float
    place: int


def oriented_component(corr: np.ndarray) -> Component:
    """The first principal component of a correlation matrix whose loadings have one sign.

    Scores are turned to their declared directions before, so a component that ranks must
    have no negative loading once its sign as a whole is fixed; the sign of a single loading
    is never changed. If scores run against each other, the leading component contrasts them
    and is passed over; the place says so. Equal eigenvalues are taken in order of the
    loadings' sum, largest first, so that equal weights win a tie.
    """
    k = len(corr)
    values, vectors = np.linalg.eigh(corr)
    equal = np.full(k, k**-0.5)
    found = []
    for v, x in zip(values, vectors.T):
        x = x if x.sum() >= 0 else -x
        found.append((-round(float(v), 9), -float(x.sum()), x))
    along = float(equal @ corr @ equal)
    if np.allclose(corr @ equal, along * equal, atol=1e-9):  # so within an eigenspace, whatever basis was returned
        found.append((-round(along, 9), -float(equal.sum()) - 1.0, equal))
    found.sort(key=lambda f: f[:2])
    for _, _, x in found:
        if (x >= -1e-9).all():
            value = float(x @ corr @ x)
            return Component([max(float(y), 0.0) for y in x], value, 1 + sum(float(v) > value + 1e-9 for v in values))
    return Component([float(y) for y in equal], along, 0)


def component(placed: DataFrame, scores: list[str]) -> Component:
    """``oriented_component`` of the scores' positions in ``placed``. One aggregation gives all
    cross products; only this k-by-k matrix reaches the driver. A constant score has
    correlation 0 with the others; an empty table gives equal loadings."""
    u = _standing(scores)
    pairs = [(a, b) for i, a in enumerate(scores) for b in scores[i:]]
    row = placed.agg(*[F.sum(u[a] * u[b]).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    k = len(scores)
    m = np.zeros((k, k))
    for i, (a, b) in enumerate(pairs):
        x, y = scores.index(a), scores.index(b)
        m[x, y] = m[y, x] = row[i] or 0.0
    scale = np.sqrt(np.diag(m))
    safe = np.where(scale > 0, scale, 1.0)
    corr = m / np.outer(safe, safe)
    np.fill_diagonal(corr, 1.0)
    return oriented_component(corr)


def _standing(scores: list[str]) -> dict[str, Column]:
    """Each score's position as a number around 0, the best item's nearly one half."""
    return {s: F.lit(0.5) - (F.col(f"pos_{s}") - 0.5) / F.col("n") for s in scores}


def rank_items(df: DataFrame, group: str, item: str, scores: list[str], directions: list[int] | None = None) -> tuple[DataFrame, Component]:
    """``positions`` plus ``projection``, the items' coordinate on the oriented component, and
    the component.

    ``directions`` says for each score whether high (1) or low (-1) is good; scores are
    turned before they are ranked. Rows must have no null or NaN score and (group, item)
    must be unique; see ``clean_hits``. Sorting by projection descending, then item, gives
    the ranking.
    """
    turned = [F.col(s) if d > 0 else (-F.col(s)).alias(s) for s, d in zip(scores, directions or [1] * len(scores))]
    placed = positions(df.select(group, item, *turned), group, item, scores)
    found = component(placed, scores)
    u = _standing(scores)
    total = reduce(operator.add, [u[s] * F.lit(x) for s, x in zip(scores, found.loadings)])
    return placed.withColumn("projection", F.round(total, 9)), found


def places(ranked: DataFrame, group: str, item: str) -> DataFrame:
    """``ranked`` plus ``place``, 1 for the best of its group, by the same range sort."""
    numbered = dense_ids(ranked, [F.col(group), F.desc("projection"), F.col(item)], "__place")
    starts = numbered.groupBy(group).agg(F.min("__place").alias("__from"))
    return numbered.join(starts, group).withColumn("place", F.col("__place") - F.col("__from") + 1).drop("__place", "__from")


def clean_hits(hits: DataFrame, links: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, link): hits with a usable score, once per document.

    Null and NaN scores, null queries and null documents are left out; a document listed
    several times counts with its highest score. ``link`` is the score of the document's
    latest ``computed_at`` (the higher one if computed twice at one time), 0 where it is
    null, NaN or absent. Other columns of the inputs are ignored.
    """
    best = (
        hits.filter("score is not null and not isnan(score) and query_id is not null and doc_id is not null")
        .groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    )
    usable = F.when(~F.isnan("score"), F.col("score"))
    latest = links.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.struct("computed_at", usable.alias("v"))).alias("m"))
    return best.join(latest, "doc_id", "left").select(
        "query_id", "doc_id", "score", F.coalesce("m.v", F.lit(0.0)).alias("link"))


def near_top(ranked: DataFrame, k: int = 5, least: int = 10) -> DataFrame:
    """(query_id, doc_id) among the first ``k`` by each of two scores, in queries with at
    least ``least`` documents.

    The loadings of a two-score component that agrees with the directions are equal, so the
    projection orders by the sum of positions. A case has a sum of at most 2k, and fewer than 2k documents have one:
    the rows are taken from the first 2k of each query, by projection, and then checked.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("projection"), "doc_id")
    first = ranked.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= 2 * k)
    return first.filter((F.col("n") >= least) & (F.col("pos_score") <= k) & (F.col("pos_link") <= k)).select("query_id", "doc_id")

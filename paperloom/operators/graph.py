"""Citation graph and PageRank.

Edges are (src, dst); repeated edges weigh by multiplicity and self-loops stay. Edges with
a null end are no edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.ids import graph_key
from paperloom.runtime import attach, dense_ids, laid_out, release, store


def clean_edges(edges: DataFrame) -> DataFrame:
    """(src, dst) without null ends."""
    return edges.filter("src is not null and dst is not null").select("src", "dst")


def graph_nodes(edges: DataFrame) -> DataFrame:
    """(id) of every end of an edge."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def out_degrees(edges: DataFrame) -> DataFrame:
    """(src, degree)."""
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def dangling(edges: DataFrame) -> DataFrame:
    """(id) of nodes without an outgoing edge. One grouping instead of an anti join."""
    ends = edges.select(
        F.explode(F.array(
            F.struct(F.col("src").alias("id"), F.lit(1).alias("out")),
            F.struct(F.col("dst").alias("id"), F.lit(0).alias("out")),
        )).alias("e")
    )
    return ends.groupBy("e.id").agg(F.max("e.out").alias("out")).filter("out = 0").select("id")


def build_graph(citations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keys (doc_key, id), edges (src, dst) and nodes (id, degree) of citations (src, ref).

    Keys are normalized, and all of them, sources and references, numbered in byte order. A
    source without references, one row with a null ``ref``, is a node of degree 0, as is a
    document that is only cited; null sources are none. Repeated references are edges each.
    """
    links = store(citations.select(graph_key(F.col("src")).alias("s"), graph_key(F.col("ref")).alias("r")).filter("s is not null"))
    ends = links.select(F.explode(F.array("s", "r")).alias("doc_key")).filter("doc_key is not null").distinct()
    keys = store(dense_ids(ends, [F.col("doc_key")], "id").select("doc_key", "id"))
    of = lambda c, name: keys.select(F.col("doc_key").alias(c), F.col("id").alias(name))
    cited = links.filter("r is not null")
    in_degree = cited.groupBy(F.col("r").alias("r")).agg(F.count("*").alias("n"))
    out_degree = cited.groupBy(F.col("s").alias("s")).agg(F.count("*").alias("n"))
    targets, sources = store(of("r", "dst").join(in_degree, "r")), store(of("s", "src").join(out_degree, "s"))
    edges = attach(attach(cited, targets, "r", "n").select("s", "dst"), sources, "s", "n").select("src", "dst")
    nodes = keys.join(out_degree.withColumnRenamed("s", "doc_key"), "doc_key", "left").select("id", F.coalesce("n", F.lit(0)).alias("degree"))
    return keys, edges, nodes


@dataclass
class PageRank:
    """Ranks after ``iterations`` rounds; ``error`` is the last L1 change."""

    ranks: DataFrame
    iterations: int
    error: float


def pagerank(edges: DataFrame, damping: float = 0.85, max_iter: int = 50, tol: float | None = 1e-9) -> PageRank:
    """Ranks (id, score) summing to 1, dangling mass spread over all nodes.

    Repeated edges are folded into one weighted edge and laid out once in buckets by source;
    a source with more than its bucket's share of the edges is sliced over several (there
    are fewer such sources than buckets). The rounds then leave the edges where they are:
    each shuffles the ranks, one row a node, and the shares, summed per target map-side,
    so a hot target is no burden. Each round is written once to the shared folder and the
    one before is deleted: the plan stays flat, no lost executor can force earlier rounds
    again, and the disk holds two rounds at most. Only two sums a round reach the driver.
    ``tol=None`` runs exactly ``max_iter`` rounds. No edges give no ranks.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folded = store(edges.groupBy("src", "dst").agg(F.count("*").alias("m")))
    per_src = folded.groupBy("src").agg(F.sum("m").alias("degree"), F.count("*").alias("rows"))
    limit = F.lit(max(folded.count() // parts, 1_000))
    per_src = per_src.select("src", "degree", F.ceil(F.col("rows") / limit).cast("int").alias("slices"))
    hot = F.broadcast(per_src.filter("slices > 1").select("src", "slices"))  # fewer than there are buckets
    laid = laid_out(
        folded.join(hot, "src", "left").select("src", "dst", "m", F.pmod(F.hash("dst"), F.coalesce("slices", F.lit(1))).alias("slice")),
        parts, ["src", "slice"], ["src", "slice"])
    ends = folded.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    nodes = store(
        ends.join(per_src.withColumnRenamed("src", "id"), "id", "left")
        .select("id", F.col("slices").isNotNull().cast("int").alias("out"), F.coalesce("slices", F.lit(0)).alias("slices"), "degree")
    )
    n, idle = nodes.agg(F.count("*"), F.sum(1 - F.col("out"))).first()
    if not n:
        return PageRank(nodes.select("id", F.lit(0.0).alias("score")), 0, 0.0)
    ranks, last = nodes.select("id", "out", "slices", "degree", F.lit(1.0 / n).alias("score")), nodes
    idle_mass, error, done = idle / n, float("inf"), 0
    while done < max_iter and (tol is None or error >= tol):
        base = (1 - damping) / n + damping * idle_mass / n
        spread = ranks.filter("out = 1").select(
            F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
            (F.col("score") / F.col("degree")).alias("each"))
        shares = (
            laid.join(spread, ["src", "slice"])
            .groupBy(F.col("dst").alias("id"))
            .agg(F.sum(F.col("each") * F.col("m")).alias("inflow"))
        )
        written = store(
            ranks.join(shares, "id", "left").select(
                "id", "out", "slices", "degree",
                (F.lit(base) + damping * F.coalesce("inflow", F.lit(0.0))).alias("score"),
                F.col("score").alias("was"),
            )
        )
        error, idle_mass = written.agg(
            F.sum(F.abs(F.col("score") - F.col("was"))),
            F.coalesce(F.sum(F.when(F.col("out") == 0, F.col("score"))), F.lit(0.0)),
        ).first()
        release(last)
        ranks, last, done = written.select("id", "out", "slices", "degree", "score"), written, done + 1
    release(folded, laid)
    return PageRank(ranks.select("id", "score"), done, error)

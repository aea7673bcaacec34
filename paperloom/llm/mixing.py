"""Problem 9: mixing sources to target shares of the total size.

Natural shares q (tokens per source) are tempered: ``p ~ q ** a``. With target weights w the
tilt ``p ~ q * (w / q) ** a`` runs from the natural shares (a = 0) to the targets (a = 1):
w / q is how often a source would be repeated, and the exponent tempers it. A source that
would pass its own limit is filled to the limit, and the others share what it leaves. The
exponent is bisected to meet a limit on the repetition of the whole mixture, or a target
entropy. The weights are then realised as budgeted block permutations.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.runtime import store

#: Blocks a source is cut into for its permutation.
BLOCKS = 4096
STEPS = 60


def source_name(source: Column) -> Column:
    """One spelling per source: lower case, outer blanks gone, blanks and underscores as
    dashes. Null stays null, and a null source has no target."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), r"[\s_]+", "-")


def _normal(p: dict[str, float]) -> dict[str, float]:
    total = sum(p.values())
    return {s: x / total for s, x in p.items()} if total > 0 else p


def entropy(p: dict[str, float]) -> float:
    return -sum(x * math.log(x) for x in p.values() if x > 0)


def temper(q: dict[str, float], a: float, w: dict[str, float] | None = None) -> dict[str, float]:
    """Shares with exponent ``a``; sources with no tokens or no weight get nothing."""
    live = {s: x for s, x in q.items() if x > 0 and (w is None or w.get(s, 0) > 0)}
    return _normal({s: x**a if w is None else x * (w[s] / x) ** a for s, x in live.items()})


def bisect_exponent(good: Callable[[float], bool], low: float = 0.0, high: float = 1.0) -> float:
    """The largest exponent in [low, high] for which ``good`` holds, ``good`` being true
    up to some point; ``low`` if it never is."""
    if good(high):
        return high
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if good(mid) else (low, mid)
    return low


def exponent_for_entropy(q: dict[str, float], target: float) -> float:
    """The exponent whose tempered shares have entropy ``target``: 1 keeps the natural
    shares, 0 is uniform; entropy falls as the exponent grows. Clamped to [0, 8]."""
    return bisect_exponent(lambda a: entropy(temper(q, a)) >= target, 0.0, 8.0)


def filled(q: dict[str, float], w: dict[str, float], full: dict[str, float], a: float, budget: float) -> dict[str, float]:
    """Tokens per source of the tilt with exponent ``a``, no source above ``full``: those that
    would be are filled, and the rest of the budget goes to the others in their ratios, until
    none is above or all are full."""
    ratio = {s: x * (w[s] / x) ** a for s, x in q.items()}
    out: dict[str, float] = {}
    free = set(q)
    while free:
        left, total = budget - sum(out.values()), sum(ratio[s] for s in sorted(free))
        want = {s: ratio[s] / total * left for s in sorted(free)}
        over = {s for s in free if want[s] > full[s]}
        if not over:
            return out | want
        out |= {s: full[s] for s in sorted(over)}
        free -= over
    return out


def repeated_share(used: dict[str, float], tokens: dict[str, int]) -> float:
    """Share of a mixture's tokens that come from second and later uses of a row."""
    total = sum(used.values())
    return sum(max(0.0, x - tokens[s]) for s, x in used.items()) / total if total else 0.0


def plan(
    tokens: dict[str, int], weights: dict[str, float], repeats: dict[str, int], budget: float | None = None, repeated: float = 1.0
) -> tuple[dict[str, int], float]:
    """Token budgets per source and the exponent used.

    Weights are normalized over the sources that have tokens. Without a budget the total
    is the largest at which the targets hold within all limits, and the exponent is 1. With
    a budget, sources are filled to their limits where the targets ask for more, and the
    exponent is the largest at which at most ``repeated`` of the mixture are repetitions
    (these grow with it): 1 if the targets keep to that, 0 if not even the natural shares do.
    """
    q = _normal({s: float(t) for s, t in tokens.items() if t > 0 and weights.get(s, 0) > 0 and repeats.get(s, 0) > 0})
    if not q:
        return {}, 1.0
    full = {s: float(tokens[s] * repeats[s]) for s in q}
    ideal = temper(q, 1.0, weights)
    if budget is None:
        budget, repeated = min(full[s] / ideal[s] for s in q), 1.0
    used = lambda a: filled(q, ideal, full, a, budget)
    a = bisect_exponent(lambda a: repeated_share(used(a), tokens) <= repeated + 1e-12)
    return {s: min(int(full[s]), int(x + 1e-6)) for s, x in used(a).items()}, a


def usable_tokens(tokens: dict[str, int], weights: dict[str, float], repeats: dict[str, int]) -> int:
    """Tokens of the sources that may be used at all: one pass over all of them."""
    return sum(t for s, t in tokens.items() if t > 0 and weights.get(s, 0) > 0 and repeats.get(s, 0) > 0)


def mix(
    sized: DataFrame, targets: DataFrame, budget: float | None = None, blocks: int = BLOCKS, passes: float | None = None, repeated: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report. ``passes`` gives the budget as a multiple of
    ``usable_tokens``, instead of ``budget``; ``repeated`` is the share of the mixture that
    may be repetitions. See ``plan``.

    ``sized`` is (doc_id, source, n_tokens) with one row per record, other columns are left out; ``targets`` is
    (source, weight, max_repeats), whose size is that of the mixture's plan and is held on
    the driver together with one token sum per targeted source. The mixture is (doc_id,
    source, n_tokens, uses): rows with uses >= 1. The report is (source, weight, max_repeats,
    tokens, used_tokens, share, records, most_uses, limited, exponent) with one row per
    target; ``limited`` says that the source is filled to its limit.

    Rows without a target, with a null source or without tokens are not used. A target
    listed twice adds its weights up, with the smaller limit. A source gets
    whole passes over its rows and one partial pass: its rows are cut into blocks by a hash
    and blocks come in a hash order until the budget is met; only the block at the edge is
    ordered row by row, its last row used if that comes nearer to the budget. A source with a third of all rows is therefore summed blockwise by
    all tasks, and its edge block holds 1/``blocks`` of it.
    """
    spark = sized.sparkSession
    sized = store(sized.select("doc_id", source_name(F.col("source")).alias("source"), "n_tokens"))  # sizes are dear: take them once
    rows = sized.filter("source is not null and n_tokens > 0")
    goal = {r["source"]: (r["weight"], r["max_repeats"]) for r in (
        targets.withColumn("source", source_name(F.col("source"))).filter("source is not null and weight > 0")
        .groupBy("source").agg(F.sum("weight").alias("weight"), F.coalesce(F.min("max_repeats"), F.lit(1)).alias("max_repeats"))).collect()}
    known = F.broadcast(spark.createDataFrame([(s,) for s in goal], "source string"))
    rows = rows.join(known, "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(blocks)))
    per_block = store(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("t")))
    tokens = {r["source"]: r["t"] for r in per_block.groupBy("source").agg(F.sum("t").alias("t")).collect()}
    weights, repeats = {s: w for s, (w, _) in goal.items()}, {s: m for s, (_, m) in goal.items()}
    if passes is not None:
        budget = passes * usable_tokens(tokens, weights, repeats)
    budgets, exponent = plan(tokens, weights, repeats, budget, repeated)

    plans = spark.createDataFrame(
        [(s, b // tokens[s], b % tokens[s]) for s, b in budgets.items()], "source string, passes long, rest long")
    order = F.xxhash64("source", "block")
    running = Window.partitionBy("source").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)
    laid = per_block.join(F.broadcast(plans), "source").withColumn("before", F.coalesce(F.sum("t").over(running), F.lit(0)))
    left = F.col("rest") - F.col("before")
    state = laid.select("source", "block", "passes", left.alias("left"), (left >= F.col("t")).alias("all_of_it"))
    placed = rows.join(F.broadcast(state), ["source", "block"])  # at most targets x blocks rows
    edge = placed.filter("not all_of_it and left > 0")
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id")
    cutoff = edge.withColumn("upto", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    whole = placed.filter("all_of_it or left <= 0").select(
        "doc_id", "source", "n_tokens", (F.col("passes") + F.col("all_of_it").cast("long")).alias("uses"))
    partial = cutoff.select(
        "doc_id", "source", "n_tokens", (F.col("passes") + (F.col("upto") - F.col("n_tokens") / 2 <= F.col("left")).cast("long")).alias("uses"))
    mixture = whole.unionByName(partial).filter("uses > 0")

    used = mixture.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.sum("uses").alias("records"), F.max("uses").alias("most_uses"))
    all_targets = spark.createDataFrame(
        [(s, float(w), int(m), int(tokens.get(s, 0))) for s, (w, m) in goal.items()],
        "source string, weight double, max_repeats long, tokens long")
    whole_mixture = used.agg(F.sum("used_tokens").alias("total"))
    limited = [s for s, b in budgets.items() if b >= tokens[s] * repeats[s]]
    report = all_targets.join(used, "source", "left").join(F.broadcast(whole_mixture)).select(
        "source", "weight", "max_repeats", "tokens", F.coalesce("used_tokens", F.lit(0)).cast("long").alias("used_tokens"),
        F.coalesce("records", F.lit(0)).cast("long").alias("records"), F.coalesce("most_uses", F.lit(0)).cast("long").alias("most_uses"),
        F.coalesce(F.col("used_tokens") / F.col("total"), F.lit(0.0)).alias("share"),
        (F.col("source").isin(limited) if limited else F.lit(False)).alias("limited"), F.lit(float(exponent)).alias("exponent"))
    return mixture, report

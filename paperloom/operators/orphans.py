"""Problem 2: references to keys that are missing, deleted or mapped only later."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.runtime import store

NO_REFERENCE = "UnknownID"
FOREVER = "9999-12-31 00:00:00"
#: Hash buckets of the open keys: a bound on the broadcast that sifts the references.
BUCKETS = 1 << 20
NTZ = "timestamp_ntz"


@dataclass(frozen=True)
class Child:
    """One referring column: its table, the key expression, the row id, the time and the
    parent table the key belongs to."""

    df: DataFrame
    tab: str
    field: str
    key: Column
    row_id: str
    time: str
    parent: str = "parent"


def _references(children: list[Child]) -> DataFrame:
    """All references in long form (ptab, key, tab, field, row_id, t); null and blank keys
    and ``UnknownID`` are no references. Keys are strings, so that all parents fit one column."""
    parts = []
    for c in children:
        part = c.df.select(
            F.lit(c.parent).alias("ptab"), c.key.alias("key"), F.lit(c.tab).alias("tab"), F.lit(c.field).alias("field"),
            F.col(c.row_id).alias("row_id"), F.col(c.time).cast(NTZ).alias("t"),
        ).filter(F.col("key").isNotNull())
        if dict(part.dtypes)["key"] == "string":
            part = part.filter((F.trim("key") != "") & (F.trim("key") != NO_REFERENCE))
        parts.append(part.withColumn("key", F.col("key").cast("string")))
    return reduce(DataFrame.unionByName, parts)


def _mappings(parents: dict[str, DataFrame]) -> DataFrame:
    """All mapping rows in long form (ptab, key, mapped_at, deleted_at)."""
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(name).alias("ptab"), F.col("key").cast("string").alias("key"),
                  F.col("mapped_at").cast(NTZ).alias("mapped_at"), F.col("deleted_at").cast(NTZ).alias("deleted_at"))
        .filter("key is not null") for name, df in parents.items()])


def find_orphans(parents: DataFrame | dict[str, DataFrame], children: list[Child], hot_share: int = 2000, least: int = 10_000) -> DataFrame:
    """(tab, field, row_id, kind, period): one row per reference without a living parent.

    ``parents`` is a table (key, mapped_at, deleted_at), any number of rows a key, or
    several by name, which ``Child.parent`` tells apart. A reference of time t lives if a
    parent row of its key has mapped_at <= t and deleted_at null or > t. ``kind`` is
    ``missing`` (no parent row), ``late`` (all rows mapped after t) or ``deleted``;
    ``period`` is the month of t. A reference without a time is an orphan only if its key
    has no parent row, with a null period. A parent row without ``mapped_at`` never lives.
    Extra columns of the inputs are not looked at; empty inputs are fine.

    Method: parents and references are united in long form, tagged, and grouped by parent
    table and key. The group sums are plain counts, minima and maxima, so a hot key shrinks
    to one row per task before the shuffle. Groups whose every reference is surely alive
    are settled by this alone; open are the groups lacking the parent flag and those with a
    deletion or a late mapping.

    Settled references leave before the next shuffle, by two broadcasts of bounded size.
    Keys above ``1/hot_share`` of all references (and above ``least``), fewer than
    ``hot_share``, carry whether they are open and over how many slices they are spread:
    a settled hot key is dropped where it is read, an open one is no single task. All other
    keys are sifted by the hashes of the open keys modulo ``BUCKETS``: none of an open key
    is lost, and what passes by chance is judged like the rest and found alive.

    What is left meets the mapping rows of its key in one ordered pass per key and slice:
    the running maximum of the ends of all mappings begun so far tells who lives. The pass
    streams, however many mappings a key has; a key has so few slices that copying its
    mappings to each never outweighs its references.
    """
    refs = _references(children)
    maps = _mappings(parents if isinstance(parents, dict) else {"parent": parents})
    none = F.lit(None).cast(NTZ)
    tagged = maps.select(
        "ptab", "key", F.lit(1).alias("parent"), "mapped_at",
        F.when(F.col("deleted_at").isNotNull() | F.col("mapped_at").isNull(), 1).otherwise(0).alias("ended"), none.alias("t"),
    ).unionByName(refs.select("ptab", "key", F.lit(0).alias("parent"), none.alias("mapped_at"), F.lit(0).alias("ended"), "t"))
    groups = tagged.groupBy("ptab", "key").agg(
        F.max("ended").alias("ended"), F.min("mapped_at").alias("first_mapped"), F.min("t").alias("first_t"),
        F.sum("parent").alias("maps"), F.sum(1 - F.col("parent")).alias("n"),
    ).filter("n > 0")
    settled = (F.col("maps") > 0) & (F.col("ended") == 0) & (
        F.col("first_t").isNull() | (F.col("first_mapped") <= F.col("first_t")))
    judged = groups.select("ptab", "key", "maps", "n", (~F.coalesce(settled, F.lit(False))).alias("open"))
    known = store(judged.filter((F.col("open")) | (F.col("n") > least)))

    total = refs.count()
    limit = max(total // hot_share, least)
    slices = F.ceil(F.col("n") / F.greatest(F.lit(limit), F.col("maps"))).cast("int")
    hot = F.broadcast(known.filter(F.col("n") > limit).select("ptab", "key", "open", slices.alias("slices")))
    bucket = F.pmod(F.xxhash64("ptab", "key"), F.lit(BUCKETS)).cast("int")
    sieve = F.broadcast(known.filter("open").select(bucket.alias("bucket")).distinct())
    spread = (
        refs.withColumn("bucket", bucket).join(sieve, "bucket", "left_semi").drop("bucket")
        .join(hot, ["ptab", "key"], "left").filter("coalesce(open, true)")
        .select("ptab", "key", F.pmod(F.hash("row_id", "field"), F.coalesce("slices", F.lit(1))).alias("slice"),
                F.lit(1).alias("ref"), "t", none.alias("until"), "tab", "field", "row_id")
    )
    until = F.coalesce("deleted_at", F.lit(FOREVER).cast(NTZ))
    begun = (
        maps.withColumn("bucket", bucket).join(sieve, "bucket", "left_semi")
        .groupBy("ptab", "key", F.col("mapped_at").alias("t")).agg(F.max(F.when(F.col("mapped_at").isNotNull(), until)).alias("until"))
        .join(hot, ["ptab", "key"], "left").filter("coalesce(open, true)")
        .select("ptab", "key", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)).alias("slice"), "t", "until")
    )
    # a mapping row counts as begun from its time on, one without a time from the start; a
    # row of its own says from the start that the key has parent rows
    blank = {c: F.lit(None).cast(k) for c, k in spread.select("tab", "field", "row_id").dtypes}
    marks = begun.select("ptab", "key", "slice", F.explode(F.array(
        F.struct(F.lit(0).alias("ref"), "t", "until"), F.struct(F.lit(-1).alias("ref"), none.alias("t"), none.alias("until")))).alias("m")).select(
        "ptab", "key", "slice", "m.ref", "m.t", "m.until", *[v.alias(c) for c, v in blank.items()])
    line = Window.partitionBy("ptab", "key", "slice").orderBy(F.col("t").asc_nulls_first(), "ref").rowsBetween(Window.unboundedPreceding, 0)
    kind = (
        F.when(F.col("has").isNull(), "missing").when(F.col("t").isNull() | (F.col("ends") > F.col("t")), None)
        .when(F.col("has") < 0, "late").otherwise("deleted")
    )
    return (
        spread.unionByName(marks)
        .withColumn("has", F.max(F.when(F.col("ref") < 1, F.col("ref"))).over(line)).withColumn("ends", F.max("until").over(line))
        .filter("ref = 1").withColumn("kind", kind).filter("kind is not null")
        .select("tab", "field", "row_id", "kind", F.date_format("t", "yyyy-MM").alias("period"))
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(tab, field, kind, period, n): counts per table, field, kind and month."""
    return orphans.groupBy("tab", "field", "kind", "period").agg(F.count("*").alias("n"))

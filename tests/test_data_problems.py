"""Orphan references and packed fields: brute force, dirt and edge cases."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.operators.multivalue import split_codes, split_names, values
from paperloom.operators.orphans import Child, find_orphans, orphan_report

T0 = dt.datetime(2024, 1, 1)


def day(n):
    return None if n is None else T0 + dt.timedelta(days=n)


def brute(parents, refs):
    out = []
    for row, key, t in refs:
        if key is None:
            continue
        own = [p for p in parents if p[0] == key]
        if t is None:
            if not own:
                out.append((row, "missing", None))
            continue
        if any(m is not None and m <= t and (d is None or d > t) for _, m, d in own):
            continue
        kind = "missing" if not own else "late" if all(m is not None and m > t for _, m, _ in own) else "deleted"
        out.append((row, kind, f"{day(t):%Y-%m}"))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_orphans_against_brute_force(spark, seed):
    r = random.Random(seed)
    parents = [(r.randint(0, 12), r.choice([None, *range(60)]), r.choice([None, None, *range(60)])) for _ in range(25)]
    parents += parents[:4]
    refs = [(i, r.choice([None, 3, 3, 3, *range(16)]), r.choice([None, *range(70)])) for i in range(300)]
    p = spark.createDataFrame([(k, day(m), day(d), "x") for k, m, d in parents], "key long, mapped_at timestamp_ntz, deleted_at timestamp_ntz, tab string")
    c = spark.createDataFrame([(i, k, day(t), "y") for i, k, t in refs], "id long, ref long, at timestamp_ntz, kind string")
    got = find_orphans(p, [Child(c, "c", "ref", F.col("ref"), "id", "at")], hot_share=3, least=1)
    assert sorted(((x["row_id"], x["kind"], x["period"]) for x in got.collect()), key=str) == brute(parents, refs)


@pytest.mark.parametrize("deleted", [None, 30])
def test_a_hot_key_is_dropped_or_spread(spark, deleted):
    """A key with two thirds of the references: settled, none of them reaches a shuffle; open,
    it is spread, and its many mappings are walked through, not gathered."""
    parents = [(0, day(i % 25), day(deleted)) for i in range(300)] + [(k, day(0), None) for k in range(1, 40)]
    refs = [(i, 0 if i % 3 else i % 50, day(26 + i % 9)) for i in range(3000)]
    p = spark.createDataFrame(parents, "key long, mapped_at timestamp_ntz, deleted_at timestamp_ntz")
    c = spark.createDataFrame(refs, "id long, ref long, at timestamp_ntz")
    got = find_orphans(p, [Child(c, "c", "ref", F.col("ref"), "id", "at")], hot_share=10, least=1)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("LeftSemi") == 2
    expected = sum(1 for _, k, t in refs if k >= 40 or (k == 0 and deleted is not None and t >= day(deleted)))
    assert got.count() == expected
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = got.filter("row_id % 3 != 0").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 3 if deleted else tasks == 0


def test_parent_tables_are_told_apart(spark):
    a = spark.createDataFrame([("1", T0, None)], "key string, mapped_at timestamp_ntz, deleted_at timestamp_ntz")
    b = spark.createDataFrame([(2, T0, None)], "key long, mapped_at timestamp_ntz, deleted_at timestamp_ntz")
    c = spark.createDataFrame([(7, 1, T0), (8, 2, T0)], "id long, ref long, at timestamp_ntz")
    child = lambda f, to: Child(c, "c", f, F.col("ref"), "id", "at", to)
    got = find_orphans({"a": a, "b": b}, [child("x", "a"), child("y", "b")])
    assert sorted((r["field"], r["row_id"]) for r in got.collect()) == [("x", 8), ("y", 7)]


def test_orphans_of_strings_and_empty_tables(spark):
    p = spark.createDataFrame([("a", T0, None)], "key string, mapped_at timestamp_ntz, deleted_at timestamp_ntz")
    c = spark.createDataFrame([(1, "a", T0), (2, " ", T0), (3, "UnknownID", T0), (4, None, T0), (5, "b", T0)], "id long, ref string, at timestamp_ntz")
    child = lambda df: [Child(df, "c", "ref", F.col("ref"), "id", "at")]
    got = find_orphans(p, child(c))
    assert [tuple(x) for x in got.collect()] == [("c", "ref", 5, "missing", "2024-01")]
    assert [tuple(x) for x in orphan_report(got).collect()] == [("c", "ref", "missing", "2024-01", 1)]
    assert find_orphans(p, child(c.limit(0))).count() == 0
    assert find_orphans(p.limit(0), child(c)).count() == 2


NAMES = [
    ("Tobias A and Yusuf B", ["Tobias A", "Yusuf B"]),
    ('"NURANOBESK, Johannes" "Amanda Vumobock"', ["NURANOBESK, Johannes", "Amanda Vumobock"]),
    ("'A B','C D'", ["A B", "C D"]),
    ("Emil S, Jr., Roland S & Eduardo D", ["Emil S, Jr.", "Roland S", "Eduardo D"]),
    ("W. T and NURANOBESK, Johannes and Isabella S", ["W. T", "NURANOBESK, Johannes", "Isabella S"]),
    ("X Collaboration: Anton K (Dept. of A, B and C), B D; E F", ["X Collaboration", "Anton K", "B D", "E F"]),
    ("van Dikrefugald, W.", ["van Dikrefugald, W."]),
    ("Bikremuler, R. N.; Anton K", ["Bikremuler, R. N.", "Anton K"]),
    ("A B,\nC D\n  E, and F G", ["A B", "C D E", "F G"]),
    ("A B / C D · E F | G H;; ", ["A B", "C D", "E F", "G H"]),
    ("J. D. O'Neil, P. D'Ar", ["J. D. O'Neil", "P. D'Ar"]),
    ("A B (1), A B (2)", ["A B", "A B"]),
    (" A;0 B", [" A", "0 B"]),
    ("", []), (None, []), (" \n\t ", []), (";,;", []),
]


def test_names(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NAMES)], "i long, t string")
    got = {r["i"]: r["v"] for r in df.select("i", split_names(F.col("t")).alias("v")).collect()}
    for i, (text, expected) in enumerate(NAMES):
        assert got[i] == expected, text


CODES = [
    ("['a.b', 'c.d']", ["a.b", "c.d"]), ('["a","b"]', ["a", "b"]), ("a / b", ["a", "b"]), ('"maps / atlases", lin.SX', ["maps / atlases", "lin.SX"]),
    ("'signals, systems'; x|y", ["signals, systems", "x", "y"]), ("a;;b;", ["a", "b"]), ("a\tb  c", ["a", "b", "c"]), ("a a", ["a", "a"]), (None, []),
]


def test_codes(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CODES)], "i long, t string")
    got = {r["i"]: r["v"] for r in df.select("i", split_codes(F.col("t")).alias("v")).collect()}
    for i, (text, expected) in enumerate(CODES):
        assert got[i] == expected, text


def test_values_with_clashing_columns_and_long_fields(spark):
    long = "; ".join(f"A{i} Bcd" for i in range(3000))
    df = spark.createDataFrame([(1, "A Bcd; C Def", "x y", "f", 1, "v"), (2, long, None, "f", 2, "v"), (2, long, None, "f", 2, "v")],
                               "line_no long, authors string, categories string, field string, pos long, value string")
    got = values(df, "line_no", {"authors": "names", "categories": "codes"})
    assert got.dtypes == [("line_no", "bigint"), ("field", "string"), ("pos", "bigint"), ("value", "string")]
    assert got.filter("line_no = 1").count() == 4 and got.filter("line_no = 2").count() == 6000
    assert values(df.limit(0), "line_no", {"authors": "names"}).count() == 0


MEGA = 1_000_000
LONG = [  # each more than Java's stack would bear if a loop over a group recursed, or its square in steps
    ('"' + "a, b " * (MEGA // 5) + '" x', 2, 2), ('"' + "a b " * (MEGA // 4), 1, MEGA // 2), ("'" + "it's a " * (MEGA // 7), 1, None),
    ('"' + 'a ""b"" ' * (MEGA // 8) + '"', 1, 1), ("van " * (MEGA // 4) + "Berg, J.", 1, None), ("Berg, " + "A." * (MEGA // 2), 1, 2),
    ("Berg, " + "A. " * (MEGA // 3), 1, None), ("“a " * (MEGA // 3), 1, MEGA // 3), ("," * MEGA, 0, 0), ("x" + "\n" * MEGA + "y", 2, 2), ("((" * (MEGA // 2), 0, 0),
]


def test_fields_of_a_megabyte(spark, tmp_path):
    """Quoted spans, unclosed quotes and long runs, read from a file so that nothing is folded."""
    rows = [(i, t, t) for i, (t, _, _) in enumerate(LONG)]
    spark.createDataFrame(rows, "line_no long, authors string, categories string").write.parquet(str(tmp_path / "long"))
    got = values(spark.read.parquet(str(tmp_path / "long")), "line_no", {"authors": "names", "categories": "codes"})
    counts = {(r["line_no"], r["field"]): r["n"] for r in got.groupBy("line_no", "field").agg(F.count("*").alias("n")).collect()}
    for i, (t, names, codes) in enumerate(LONG):
        assert counts.get((i, "authors"), 0) == names, t[:20]
        assert codes is None or counts.get((i, "categories"), 0) == codes, t[:20]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["Anton Kep", "B. Rav", "Ida van Dik", "Kep, Anton"]), min_size=1, max_size=5), min_size=1, max_size=6), st.sampled_from(["; ", ";", " | ", "\n", " and ", " · "]))
def test_join_then_split_is_identity(spark, lists, sep):
    df = spark.createDataFrame([(i, sep.join(x)) for i, x in enumerate(lists)], "i long, t string")
    got = {r["i"]: r["v"] for r in df.select("i", split_names(F.col("t")).alias("v")).collect()}
    assert [got[i] for i in range(len(lists))] == lists

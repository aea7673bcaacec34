"""Ranking, term counts, distinctive words and mixing against brute force and edge cases."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperloom.llm import distinctive, mixing, ranking, terms

NAN, T = float("nan"), dt.datetime(2024, 1, 1)
HITS = "query_id long, doc_id long, score double, rank long, link double"
LINKS = "doc_id long, score double, computed_at timestamp"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def hits(spark, data):
    return spark.createDataFrame([(q, d, s, 0, 9.0) for q, d, s in data], HITS)


def links(spark, data):
    return spark.createDataFrame([(d, s, T + dt.timedelta(days=t) if t is not None else None) for d, s, t in data], LINKS)


def test_clean_hits(spark):
    h = hits(spark, [(1, 1, 2.0), (1, 1, 5.0), (1, 2, NAN), (1, 3, None), (None, 4, 1.0), (1, None, 1.0), (1, 5, 1.0)])
    k = links(spark, [(1, 3.0, 1), (1, 4.0, 0), (5, None, 2), (5, 7.0, 1), (None, 1.0, 1)])
    assert rows(ranking.clean_hits(h, k)) == [(1, 1, 5.0, 3.0), (1, 5, 1.0, 0.0)]
    assert ranking.clean_hits(h.limit(0), k.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_near_top_against_brute_force(spark, seed):
    r = random.Random(seed)
    data = [(q, d, r.choice([1.0, 2.0, 3.0, r.random() * 10**q])) for q in range(6) for d in range(r.choice([4, 9, 10, 30]))]
    k = [(d, r.choice([0.0, 0.5, r.random()]), 0) for d in range(0, 30, 2)]
    link = dict((d, s) for d, s, _ in k)
    expected = []
    for q in {x[0] for x in data}:
        own = [(d, s) for p, d, s in data if p == q]
        if len(own) >= 10:
            a = {d for d, s in sorted(own, key=lambda x: (-x[1], x[0]))[:5]}
            b = {d for d, s in sorted(own, key=lambda x: (-link.get(x[0], 0.0), x[0]))[:5]}
            expected += [(q, d) for d in a & b]
    clean = ranking.clean_hits(hits(spark, data), links(spark, k))
    ranked, _ = ranking.rank_items(clean, "query_id", "doc_id", ["score", "link"])
    assert rows(ranking.near_top(ranked)) == sorted(expected)
    placed = ranking.places(ranked, "query_id", "doc_id").collect()
    for q in {x[0] for x in data}:
        own = sorted((x for x in placed if x["query_id"] == q), key=lambda x: x["place"])
        assert [x["place"] for x in own] == list(range(1, len(own) + 1))
        sums = [x["pos_score"] + x["pos_link"] for x in own]
        assert sums == sorted(sums)  # equal loadings order by the sum of positions


def test_rank_directions_and_scale(spark):
    df = spark.createDataFrame([(1, i, float(i), -1e9 * i, 5.0) for i in range(20)], "g long, i long, a double, b double, c double")
    ranked, part = ranking.rank_items(df, "g", "i", ["a", "b"], [1, -1])
    assert part.place == 1 and math.isclose(part.loadings[0], part.loadings[1]) and math.isclose(part.eigenvalue, 2.0)
    assert ranked.orderBy(F.desc("projection")).first()["i"] == 19
    against, part = ranking.rank_items(df, "g", "i", ["a", "b"])  # they contradict each other: the leading component is passed over
    assert part.place == 2 and math.isclose(part.loadings[0], part.loadings[1]) and math.isclose(part.eigenvalue, 0.0, abs_tol=1e-9)
    assert ranking.rank_items(df.limit(0), "g", "i", ["a", "b"])[0].count() == 0


def test_component_is_one_of_the_matrix():
    """Loadings are an eigenvector, its sign turned as a whole, never one by one."""
    import numpy as np

    agree = np.array([[1, 0.8, 0.5], [0.8, 1, 0.3], [0.5, 0.3, 1.0]])
    c = ranking.oriented_component(agree)
    x = np.array(c.loadings)
    assert c.place == 1 and (x > 0).all() and np.allclose(agree @ x, c.eigenvalue * x)
    third = np.array([[1, 0.9, -0.8], [0.9, 1, -0.8], [-0.8, -0.8, 1.0]])
    first = np.linalg.eigh(third)[1][:, -1]
    assert first[0] * first[2] < 0  # the third score runs against the others
    c = ranking.oriented_component(third)
    assert c.place != 1 and min(c.loadings) >= 0
    assert c.place == 0 or np.allclose(third @ np.array(c.loadings), c.eigenvalue * np.array(c.loadings), atol=1e-6)
    assert ranking.oriented_component(np.eye(2)).loadings == pytest.approx([0.5**0.5] * 2)


def index_rows(spark, data):
    return spark.createDataFrame([(d, w, f, "x") for d, w, f in data], "doc_id long, word_id long, freq long, word string")


def lexicon(spark, data):
    return spark.createDataFrame(data, "word_id long, word string")


LEX = [(0, "Alpha"), (1, " alpha "), (2, "beta"), (3, None), (4, "  "), (5, "gamma"), (5, "gamma"), (None, "delta"), (7, "unused")]


def test_terms_against_brute_force(spark):
    r = random.Random(3)
    data = [(r.choice([None, *range(60)]), r.choice([0, 0, 0, 1, 2, 3, 4, 5, 6]), r.choice([None, -1, 0, 1, 2, 3])) for _ in range(1500)]
    words = {0: "alpha", 1: "alpha", 2: "beta", 5: "gamma"}
    seen = {(d, w, f) for d, w, f in data if d is not None and f and f > 0 and w in words}
    total, docs = Counter(), {}
    for d, w, f in seen:
        total[words[w]] += f
        docs.setdefault(words[w], set()).add(d)
    got = {x["word"]: (x["total"], x["docs"], x["mark"]) for x in terms.term_table(index_rows(spark, data), lexicon(spark, LEX)).collect()}
    n = len({d for d, _, _ in seen})
    for w in ("alpha", "beta", "gamma"):
        assert got[w] == (total[w], len(docs[w]), "rare" if len(docs[w]) <= 2 else "common" if len(docs[w]) > 0.1 * n else None)
    assert got["unused"] == (0, 0, None) and "delta" not in got and len(got) == 4


def test_heavy_and_light_words_agree(spark):
    data = [(d, 0, 1) for d in range(300)] + [(d, 2, 2) for d in range(5)]
    cell = terms.cells(index_rows(spark, data), lexicon(spark, LEX))
    assert rows(terms.count_terms(cell, 0.1)) == rows(terms.count_terms(cell, 0.9)) == [("alpha", 300, 300), ("beta", 10, 5)]
    assert terms.term_table(index_rows(spark, []), lexicon(spark, [])).count() == 0


def test_an_id_of_several_words_counts_for_each(spark):
    got = {x["word"]: x["total"] for x in terms.term_table(index_rows(spark, [(1, 5, 2), (2, 6, 3)]), lexicon(spark, [(5, "a"), (5, "B "), (6, "b")])).collect()}
    assert got == {"a": 2, "b": 5}


def test_copies_and_large_lexicons(spark, monkeypatch):
    """A group of copies of a third of the rows, and a lexicon beyond the broadcast, give the same."""
    r = random.Random(9)
    data = [(1, 0, 3)] * 500 + [(r.randint(0, 40), r.choice([0, 0, 1, 2, 5]), r.randint(1, 4)) for _ in range(1000)]
    index, lex = index_rows(spark, data), lexicon(spark, LEX)
    titles = spark.createDataFrame([(1, "alpha"), (3, "omega")], "doc_id long, word string")
    expected = rows(terms.cells(index, lex, titles))
    assert (3, "omega", 0, True) in expected and any(x[1] == "alpha" and x[0] == 1 and x[3] for x in expected)
    assert rows(terms.cells(index, lex)) == [x[:3] for x in expected if x[2]]
    assert 0 in terms.heavy_ids(terms.counted_rows(index)) and 1 in terms.heavy_ids(terms.counted_rows(index), "doc_id", 0.3)
    counts = rows(terms.term_table(index, lex))
    monkeypatch.setattr(terms, "BROADCAST_ROWS", 0)
    assert rows(terms.cells(index, lex, titles)) == expected and rows(terms.term_table(index, lex)) == counts
    plain = distinctive.attach
    monkeypatch.setattr(distinctive, "attach", lambda b, s, k, c: plain(b, s, k, c, most=0, hot_rows=5))
    scored = rows(distinctive.scored(terms.cells(index, lex, titles)))
    monkeypatch.undo()
    assert scored == rows(distinctive.scored(terms.cells(index, lex, titles)))


def test_residuals_by_hand(spark):
    cell = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "b", 4)], "doc_id long, word string, freq long")
    titles = spark.createDataFrame([(1, "a"), (2, "c")], "doc_id long, word string")
    got = {(x["doc_id"], x["word"]): x for x in distinctive.residuals(cell, titles).collect()}
    n, r1, ca = 9.0, 4.0, 3.0
    e = r1 * ca / n
    assert math.isclose(got[1, "a"]["residual"], (3 - e) / math.sqrt(e * (1 - r1 / n) * (1 - ca / n)))
    assert got[2, "c"]["freq"] == 0 and not got[2, "c"]["indexed"] and got[2, "c"]["docs"] == 0
    assert got[1, "a"]["titled"] and got[1, "a"]["residual"] > got[1, "b"]["residual"]
    lone = spark.createDataFrame([(1, "a", 3)], "doc_id long, word string, freq long")
    assert distinctive.residuals(lone, titles.limit(0)).first()["residual"] == 0.0


def test_beyond_doubt(spark):
    lex = lexicon(spark, [(i, w) for i, w in enumerate("apple pear plum fig".split())])
    data = [(1, 0, 5), (1, 1, 2), (2, 1, 3), (2, 2, 3), (3, 2, 9), (4, 1, 4), (4, 2, 1), (4, 3, 4)]
    meta = spark.createDataFrame([(1, "An Apple!", 0), (1, None, 0), (3, "plum", 0), (4, "pear", 0), (None, "apple", 0)], "doc_id long, title string, word long")
    scored = distinctive.score_words(index_rows(spark, data), lex, meta)
    assert rows(distinctive.beyond_doubt(scored)) == [(1, "apple")]  # 2 and 4 tie, 3 has one word


def test_beyond_doubt_takes_candidates_from_residuals(spark):
    """Against the plain definition, also where a rare word has a large column sum."""
    r = random.Random(11)
    data = {(d, w): r.choice([1, 1, 2, 3, 5, 8, 400]) for d in range(150) for w in r.sample("abcdefghijkl", r.randint(1, 5))}
    data |= {(150, "p"): 6, (150, "q"): 5, (151, "p"): 4000, (152, "q"): 1, (153, "q"): 1}
    docs = Counter(w for _, w in data)
    titles = {(d, w) for d in range(150) for w in r.sample("abcdefghijklxyz", 6)} | {(150, "p")}
    expected = []
    for d in range(154):
        own = {w: f for (e, w), f in data.items() if e == d}
        hi, lo = [w for w in own if own[w] == max(own.values())], [w for w in own if docs[w] == min(docs[v] for v in own)]
        if len(own) > 1 and len(hi) == 1 and hi == lo and (d, hi[0]) in titles:
            expected.append((d, hi[0]))
    cell = spark.createDataFrame([(d, w, f) for (d, w), f in data.items()], "doc_id long, word string, freq long")
    scored = distinctive.residuals(cell, spark.createDataFrame(sorted(titles), "doc_id long, word string"))
    found = distinctive.beyond_doubt(scored)
    assert rows(found) == expected and len(expected) > 5
    tops = {x["doc_id"]: x["w"] for x in scored.filter("indexed").groupBy("doc_id").agg(F.max_by("word", "residual").alias("w")).collect()}
    assert any(tops[d] != w for d, w in expected)  # the highest residual alone would lose these
    assert "SQRT" in found._jdf.queryExecution().optimizedPlan().toString()  # residuals are computed


def test_temper_and_plan():
    q = {"a": 0.7, "b": 0.2, "c": 0.1}
    a = mixing.exponent_for_entropy(q, 1.0)
    assert abs(mixing.entropy(mixing.temper(q, a)) - 1.0) < 1e-6
    assert mixing.temper(q, 0.0) == pytest.approx({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3})
    tokens, w, m = {"a": 1000, "b": 100, "x": 50}, {"a": 0.5, "b": 0.4, "none": 0.1}, {"a": 1, "b": 4, "none": 3}
    budgets, e = mixing.plan(tokens, w, m)
    assert e == 1.0 and budgets["b"] == 400 and abs(budgets["a"] / budgets["b"] - 0.5 / 0.4) < 0.01 and set(budgets) == {"a", "b"}
    big, e = mixing.plan(tokens, w, m, budget=1200)
    assert e == 1.0 and big == {"a": 800, "b": 400}  # b is filled to its limit, a takes the rest
    big, e = mixing.plan(tokens, w, m, budget=1200, repeated=0.1)
    assert 0 < e < 1 and big["a"] + big["b"] == pytest.approx(1200, abs=2)
    assert mixing.repeated_share(big, tokens) == pytest.approx(0.1, abs=0.002)
    assert mixing.plan(tokens, w, m, budget=5000) == ({"a": 1000, "b": 400}, 1.0)  # all there is
    assert mixing.plan({}, w, m) == ({}, 1.0)


def test_mix(spark):
    r = random.Random(1)
    sized = [(i, "Big_Source" if i % 10 else "small", r.randint(0, 40)) for i in range(3000)] + [(9000, None, 5), (9001, "other", 5)]
    df = spark.createDataFrame([(i, s, n, 0) for i, s, n in sized], "doc_id long, source string, n_tokens long, uses long").drop("uses")
    targets = spark.createDataFrame([("big-source", 0.5, 1), ("small", 0.5, 3), ("absent", 0.2, 2)], "source string, weight double, max_repeats long")
    mixture, report = mixing.mix(df, targets, blocks=16)
    used = mixture.collect()
    assert len({x["doc_id"] for x in used}) == len(used) and all(x["n_tokens"] == sized[x["doc_id"]][2] for x in used)
    limit = {"big-source": 1, "small": 3}
    assert all(1 <= x["uses"] <= limit[x["source"]] for x in used)
    got = {x["source"]: x for x in report.collect()}
    assert abs(got["small"]["share"] - 0.5) < 0.01 and got["absent"]["share"] == 0.0 and got["small"]["most_uses"] == 3
    again = mixing.mix(df.repartition(5), targets, blocks=16)[0]
    assert rows(again) == rows(mixture)  # the permutation depends on ids only
    empty, rep = mixing.mix(df.limit(0), targets)
    assert empty.count() == 0 and rep.count() == 3


def test_mix_of_corpus_size_is_tempered(spark):
    """Limits bind, the exponent is bisected to the bound on repetitions, and the budget is used."""
    sized = [(i, "big" if i % 10 else "small", 10) for i in range(3000)] + [(8000, "tiny", 50), (9000, "barred", 500)]
    df = spark.createDataFrame(sized, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("tiny", 0.1, 2), ("barred", 0.1, 0)], "source string, weight double, max_repeats long")
    mixture, report = mixing.mix(df, targets, blocks=16, passes=1.0, repeated=0.1)
    got = {x["source"]: x for x in report.collect()}
    total = sum(x["used_tokens"] for x in got.values())
    assert 0 < got["big"]["exponent"] < 1 and got["barred"]["used_tokens"] == 0
    assert total == pytest.approx(30050, abs=30)
    assert got["tiny"]["limited"] and got["tiny"]["used_tokens"] == 100 and got["tiny"]["most_uses"] == 2 and not got["big"]["limited"]
    assert 0.1 < got["small"]["share"] < 0.4 and got["big"]["most_uses"] == 1 and got["small"]["most_uses"] == 2
    again = mixture.agg(F.sum(F.col("n_tokens") * (F.col("uses") - 1))).first()[0]
    assert again / total == pytest.approx(0.1, abs=0.005)
    assert sum(x["share"] for x in got.values()) == pytest.approx(1)


def test_mix_of_the_data(spark):
    """The registered mixture uses most of the tokens, keeps every limit, and nears the targets
    where no limit binds."""
    from paperloom.llm.queries import REGISTRY, REPEATED
    from paperloom.runtime import read_table

    d = "/root/testdata/sf0.001"
    shares = {x["source"]: x for x in REGISTRY["p9_shares"](spark, d).collect()}
    mixture = REGISTRY["p9_mix"](spark, d).collect()
    limit = {mixing_name: n for mixing_name, n in ((x["source"], x["max_repeats"]) for x in shares.values())}
    assert all(1 <= x["uses"] <= limit[x["source"]] for x in mixture)
    once, all_uses = sum(x["n_tokens"] for x in mixture), sum(x["n_tokens"] * x["uses"] for x in mixture)
    usable = sum(x["tokens"] for x in shares.values())
    assert once > 0.6 * usable and all_uses <= usable * 1.05
    assert (all_uses - once) / all_uses <= REPEATED + 0.05
    assert any(x["limited"] for x in shares.values()) and read_table(spark, d, "documents").count() > len(mixture)

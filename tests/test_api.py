"""The engine object end to end on a small collection."""

from __future__ import annotations

import pytest

from paperloom.api import Engine

TEXTS = ["deep graph net", "deep net", "graph matrix deep net", "matrix", None]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    docs = spark.createDataFrame([(i, f"k{i}", t) for i, t in enumerate(TEXTS)], "doc_id long, doc_key string, text string")
    meta = spark.createDataFrame([(i, f"k{i}", f"T{i}", "A", "cs.AI" if i % 2 else "math", f"2024-0{i + 1}-01") for i in range(5)],
                                 "doc_id long, id string, title string, authors string, category string, date string")
    edges = spark.createDataFrame([(0, 1), (2, 1), (1, 0), (3, None)], "src long, dst long")
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")))
    assert e.health() == {"status": "offline"}
    e.build(docs, meta, edges, min_freq=2)
    return e


def test_search(engine):
    assert engine.health() == {"status": "online"}
    got = engine.search("deep net")
    assert {r["doc_id"] for r in got["results"]} == {0, 1, 2} and got["results"][0]["rank"] == 1
    assert engine.search("  ") == {"results": [], "time_ms": 0}
    assert [r["doc_id"] for r in engine.hits("deep /cat:cs").collect()] == [1]
    dated = sorted(engine.hits("deep /date").collect(), key=lambda r: r["rank"])
    assert [r["doc_id"] for r in dated] == [2, 1, 0]
    assert {r["doc_id"] for r in engine.hits("deep", doc_limit=2).collect()} == {0, 1}


def test_expansion_and_suggestion(engine):
    titles = [r["title"] for r in engine.search("matrix")["results"]]
    assert any(t.startswith("[Related to ") for t in titles)
    assert engine.suggest("de") == {"suggestions": ["deep"]} == engine.command("/suggest DE")


def test_upload(engine, tmp_path):
    (tmp_path / "a.json").write_text('{"title": "Fresh", "id": "new/1"}')
    (tmp_path / "b.txt").write_text("Quasar deep\nbody")
    assert engine.upload(str(tmp_path)) == 2
    hits = {r["title"]: r for r in engine.hits("deep").collect()}
    assert hits["Quasar deep"]["doc_id"] == 6 and hits["Quasar deep"]["category"] == "New"
    assert [r["id"] for r in engine.hits("fresh").collect()] == ["new/1"]
    words = engine.table("lexicon").groupBy("word").count().filter("count > 1")
    assert words.count() == 0


def test_uploads_are_published_whole(engine, tmp_path, monkeypatch):
    """A failure before the end leaves the index as it was; a repeat adds each file once."""
    import pytest as pt

    (tmp_path / "c.txt").write_text("Pulsar deep\nbody")
    before, n = engine.version(), engine.table("lengths").count()
    monkeypatch.setattr(engine, "_add_version", lambda segments: (_ for _ in ()).throw(OSError("lost")))
    with pt.raises(OSError):
        engine.upload(str(tmp_path))
    assert engine.version() == before and engine.hits("pulsar").count() == 0 and engine.table("lengths").count() == n
    monkeypatch.undo()
    assert engine.upload(str(tmp_path)) == 1
    assert engine.hits("pulsar").count() == 1 and engine.table("lengths").count() == n + 1
    newest = engine.segments(engine.version())[-1]
    forward = engine.spark.read.parquet(f"{engine.path}/{newest}/forward")
    assert forward.agg({"freq": "sum"}).first()[0] == engine.table("lengths").filter(f"doc_id = {n}").first()["dl"]


def test_command_stream(engine):
    answers = list(engine.run(["/suggest de", "deep net\n", "exit\n", "deep"]))
    assert len(answers) == 2 and answers[0] == {"suggestions": ["deep"]} and answers[1]["results"] and answers[1]["time_ms"] >= 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_filters_reach_the_scans(engine):
    """The term filter, the prefix and the columns in use go down to Parquet."""
    from paperloom.operators import search, suggest

    plan = plan_of(search.match(engine.table("postings"), engine.table("lengths"), ["deep", "net"]))
    assert "In(word, [deep,net])" in plan
    plan = plan_of(suggest.suggest(engine.table("vocab"), "de"))
    assert "StringStartsWith(word,de)" in plan and "TakeOrderedAndProject" in plan
    lengths = plan_of(engine.table("meta").select("doc_id"))
    assert "ReadSchema: struct<doc_id:bigint>" in lengths

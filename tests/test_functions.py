"""Hand-computed cases of the scalar functions and the command parser."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paperloom.functions.ids import graph_key, metadata_key
from paperloom.functions.text import clean_line, clean_metadata, content_tokens, first_line_title, tokens, trainer_content, trainer_tokens
from paperloom.operators.search import parse_command


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize("text, expected", [
    ("Don't naïve state-of-the-art cs.AI 2007-05-23", "don t na ve state of the art cs ai 2007 05 23".split()),
    ("Kelvin", ["elvin"]),
    ("", []), (None, []), ("  \n", []), ("a" * 5000, ["a" * 5000]),
])
def test_tokens(spark, text, expected):
    assert one(spark, tokens, text) == expected


def test_stopwords(spark):
    assert one(spark, content_tokens, "Don't naïve state-of-the-art cs.AI 2007-05-23") == "don t na ve state art cs ai 2007 05 23".split()


def test_trainer(spark):
    text = "Don't naïve state-of-the-art cs.AI 2007-05-23"
    assert one(spark, trainer_tokens, text) == "dont nave stateoftheart csai 20070523".split()
    assert one(spark, trainer_content, "the Big image of it we saw\vnow") == ["big", "saw", "now"]


@pytest.mark.parametrize("key, graph, meta", [
    ("arXiv:0704.0001v2", "0704.0001", "0704.0001"), ("math/v12", "math/", "math/"), ("v1v2", "v1", "v1"),
    ("0704.1v", "0704.1v", "0704.1v"), (" arXiv:1 arXiv:2 ", " arXiv:1 arXiv:2 ", "1 2"), (None, None, None), ("", "", ""),
])
def test_ids(spark, key, graph, meta):
    assert one(spark, graph_key, key) == graph
    assert one(spark, metadata_key, key) == meta


def test_cleaners(spark):
    assert one(spark, clean_line, "a\nb\tc\rd") == "a b c d"
    assert one(spark, clean_line, None) == ""
    assert one(spark, clean_metadata, "a|b\nc\rd\te ") == "a-b cd e"
    assert one(spark, clean_metadata, None) == one(spark, clean_metadata, "") == "Unknown"
    assert one(spark, first_line_title, "  A title \nmore") == "A title"
    assert one(spark, first_line_title, "x" * 100) == "x" * 60


def test_command():
    c = parse_command("deep /cat:cs /date learning /cat:stat")
    assert (c.text, c.category, c.by_date) == ("deep learning", "stat", True)
    assert parse_command("a /cat:x /cat:").category == ""
    assert parse_command("The matrix, the Matrix of spectrum").terms == ["matrix", "spectrum"]
    assert parse_command("the of").terms == []

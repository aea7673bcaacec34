"""Normalizers of document keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION_SUFFIX = "v[0-9]+$"


def graph_key(key: Column) -> Column:
    """Drop one leading ``arXiv:``, then one trailing ``v<digits>``. No trimming; null stays null."""
    return F.regexp_replace(F.regexp_replace(key, "^arXiv:", ""), VERSION_SUFFIX, "")


def metadata_key(key: Column) -> Column:
    """Delete every ``arXiv:``, trim white space, then drop one trailing ``v<digits>``.
    Null stays null."""
    bare = F.replace(key, F.lit("arXiv:"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(bare, r"^\s+|\s+$", ""), VERSION_SUFFIX, "")

"""Ranking arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking formula.
K1, B, RANK_WEIGHT = 1.5, 0.75, 50.0


def idf(n_docs: Column, df: Column) -> Column:
    """ln((N - n + 0.5) / (n + 0.5) + 1); negative only if n exceeds N."""
    return F.ln((n_docs - df + 0.5) / (df + 0.5) + 1.0)


def bm25(idf_value: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    """Weight of one term in one document."""
    return idf_value * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))

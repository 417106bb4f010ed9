"""Counts over the library, each table read once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from libris.operators.ownership import missing_by_isbn
from libris.schema import SOURCES


def library_stats(editions: DataFrame, works: DataFrame, wants: DataFrame) -> DataFrame:
    """One row of 13 counts; grab_count goes by ISBN alone and so differs from the grab list's length."""
    e = editions.agg(
        F.count("*").alias("total_editions"),
        F.count_if(F.col("owned") == 1).alias("owned_editions"),
        F.count_if(F.col("isbn").isNotNull()).alias("with_isbn"),
        F.count_if(F.col("series_name").isNotNull()).alias("in_series"),
        F.count_if(F.col("enriched_at").isNotNull()).alias("enriched"),
    )
    w = works.agg(F.count("*").alias("total_works"))
    by_source = [F.count_if(F.col("source") == s).alias(f"want_{s}") for s in SOURCES]
    n = wants.agg(*by_source)
    g = missing_by_isbn(wants, editions).agg(F.count("*").alias("grab_count"))
    # four frames of one row each
    return e.crossJoin(w).crossJoin(n).crossJoin(g)

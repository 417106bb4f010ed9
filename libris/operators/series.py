"""Series: what is owned, and which whole numbers between are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from libris.functions.text import format_position, position_number

#: Neighbours further apart than this leave room for a number between.
GAP = 1.5


def gaps(rows: DataFrame, key: str, number: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, missing) for each whole number between two neighbours of a key that are over 1.5 apart.

    The range is from floor + 1 to floor of the next - 1, and may be empty.
    """
    w = Window.partitionBy(key).orderBy(number)
    ahead = rows.withColumn("__next", F.lead(number).over(w)).where(F.col("__next") - F.col(number) > GAP)
    spans = ahead.withColumn("__lo", F.floor(number).cast("long") + 1).withColumn("__hi", F.floor("__next").cast("long") - 1)
    return spans.where("__lo <= __hi").select(key, *keep, F.explode(F.sequence("__lo", "__hi")).alias("missing"))


def series_entries(editions: DataFrame) -> DataFrame:
    """(series_name, non_numeric, position, owned, place) of owned editions with a series.

    A series is numeric if all its positions that are given are plain numbers; its
    gaps are then entries with owned = false.  Otherwise entries stand in the order
    of their texts.  A series without any position has one row with nulls.
    """
    rows = editions.where((F.col("owned") == 1) & F.col("series_name").isNotNull()).select("series_name", "series_position").withColumn("number", position_number("series_position"))
    by_series = rows.groupBy("series_name").agg(F.count("series_position").alias("__given"), F.count("number").alias("__numbers"))
    state = by_series.select("series_name", ((F.col("__given") == 0) | (F.col("__numbers") < F.col("__given"))).alias("non_numeric"), (F.col("__given") == 0).alias("__none"))
    given = rows.where(F.col("series_position").isNotNull()).join(state.where(~F.col("__none")).drop("__none"), "series_name")
    numeric = given.where(~F.col("non_numeric"))
    held = given.select("series_name", "non_numeric", F.when(F.col("non_numeric"), F.col("series_position")).otherwise(format_position("number")).alias("position"), F.lit(True).alias("owned"), F.when(~F.col("non_numeric"), F.col("number")).alias("number"))
    lacking = gaps(numeric, "series_name", "number").select("series_name", F.lit(False).alias("non_numeric"), F.col("missing").cast("string").alias("position"), F.lit(False).alias("owned"), F.col("missing").cast("double").alias("number"))
    bare = state.where("__none").select("series_name", "non_numeric", F.lit(None).cast("string").alias("position"), F.lit(None).cast("boolean").alias("owned"), F.lit(None).cast("double").alias("number"))
    place = F.row_number().over(Window.partitionBy("series_name").orderBy("number", "position"))
    return held.unionByName(lacking).unionByName(bare).withColumn("place", place).drop("number")


def series_views(editions: DataFrame) -> DataFrame:
    """(series_name, entries, non_numeric), a row per series in order of its name."""
    rows = series_entries(editions)
    entry = F.struct("place", "series_name", "position", "owned")
    grouped = rows.groupBy("series_name").agg(F.sort_array(F.collect_list(F.when(F.col("position").isNotNull(), entry))).alias("__e"), F.first("non_numeric").alias("non_numeric"))
    entries = F.transform("__e", lambda e: F.struct(e["series_name"].alias("series_name"), e["position"].alias("position"), e["owned"].alias("owned")))
    return grouped.select("series_name", entries.alias("entries"), "non_numeric").orderBy("series_name")

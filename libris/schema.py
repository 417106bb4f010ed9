"""Tables and their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where a want may come from, and the priorities of wants.
SOURCES = ("goodreads_csv", "openlibrary", "manual", "text_file", "author_follow", "series_fill")
PRIORITY_RANGE = (1, 10)
DEFAULT_PRIORITY = 5
SERIES_FILL_PRIORITY = 7

_S, _L = T.StringType(), T.LongType()


def _table(**columns: tuple[T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, (t, null) in columns.items()])


WORKS = _table(id=(_L, False), canonical_title=(_S, False), canonical_authors=(_S, False), openlibrary_work_id=(_S, True), created_at=(_S, False))
EDITIONS = _table(
    id=(_L, False), title=(_S, True), authors=(_S, True), isbn=(_S, True), series_name=(_S, True), series_position=(_S, True), publisher=(_S, True), publish_date=(_S, True), language=(_S, True),
    description=(_S, True), cover_image_path=(_S, True), source_path=(_S, False), work_id=(_L, True), owned=(_L, False), enriched_at=(_S, True), enrichment_attempted=(_L, False),
)
WANTS = _table(id=(_L, False), title=(_S, False), author=(_S, True), isbn13=(_S, True), source=(_S, False), source_id=(_S, True), added_at=(_S, False), priority=(_L, False), notes=(_S, True))
AUTHORS = _table(id=(_L, False), name=(_S, False), ol_key=(_S, True), last_synced=(_S, True), added_at=(_S, False))
TABLES = {"works": WORKS, "editions": EDITIONS, "want_list": WANTS, "followed_authors": AUTHORS}

#: What the package parser gives, beside the path.
PACKAGE_FIELDS = ("title", "authors", "isbn", "series_name", "series_position", "publisher", "publish_date", "language", "description", "cover_image_path")


def check_source(source: str) -> str:
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}; known are {', '.join(SOURCES)}")
    return source


def check_priority(priority: int) -> int:
    low, high = PRIORITY_RANGE
    if not low <= priority <= high:
        raise ValueError(f"priority must be from {low} to {high}, not {priority}")
    return priority


def validated_wants(wants: DataFrame) -> DataFrame:
    """``wants``; a row of an unknown source or a priority out of range fails the query that reads it."""
    low, high = PRIORITY_RANGE

    def held(ok: Column, what: str, value: Column) -> Column:
        return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(value.cast("string"), F.lit("null")))).cast("string"))

    return wants.withColumn("source", held(F.col("source").isin(*SOURCES), "unknown source", F.col("source"))).withColumn("priority", held(F.col("priority").between(low, high), "priority out of range", F.col("priority")).cast("long"))

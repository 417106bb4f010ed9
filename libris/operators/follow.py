"""Followed authors, and the books of series: works that a service lists, queued as wants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from libris.checkpoints import checkpointed
from libris.operators.maintenance import max_id
from libris.sources.http import CATALOGUE, Transport, author_key, author_works, numbered, works_of


def find_author(authors: DataFrame, name: str) -> DataFrame:
    """Authors of that name in any case."""
    return authors.where(F.lower("name") == name.lower())


def add_author(authors: DataFrame, name: str, transport: Transport, now: str, base: str = CATALOGUE) -> tuple[DataFrame, list[dict], str]:
    """(authors, works to queue, status): ``added``, ``duplicate`` or ``not_found``.

    Nothing is added if the author's works can't be had.
    """
    if not find_author(authors, name).isEmpty():
        return authors, [], "duplicate"
    key = author_key(transport, name, base)
    if key is None:
        return authors, [], "not_found"
    works = author_works(transport, key, base)
    row = authors.sparkSession.createDataFrame([(max_id(authors) + 1, name, key, now, now)], authors.schema)
    return authors.unionByName(row), [{**w, "author": name} for w in works], "added"


def sync_authors(authors: DataFrame, transport: Transport, now: str, base: str = CATALOGUE) -> tuple[DataFrame, DataFrame, list[str]]:
    """(authors, entries to queue, names that failed); services are asked by tasks, and one failure doesn't stop the others."""
    found = checkpointed(works_of(authors, transport, base))
    well = found.where(F.col("error").isNull())
    books = well.select("id", F.col("name").alias("author"), F.posexplode("works").alias("place", "work")).orderBy("id", "place")
    queued = numbered(books.select("work.title", "author", F.lit(None).cast("string").alias("isbn13"), "work.source_id"))
    synced = authors.join(well.select("id", F.lit(now).alias("__at")), "id", "left").withColumn("last_synced", F.coalesce("__at", "last_synced")).select(*authors.columns)
    return synced, queued, [r["name"] for r in found.where(F.col("error").isNotNull()).orderBy("id").select("name").collect()]


def remove_author(authors: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """(authors, whether one went); here the name's case counts."""
    there = not authors.where(F.col("name") == name).isEmpty()
    return authors.where(F.col("name") != name), there

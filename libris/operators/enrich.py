"""Enrichment of editions and wants from catalogue services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from libris.checkpoints import checkpointed
from libris.functions.text import normalize_isbn
from libris.operators.maintenance import coalesce_update, merge_by_key
from libris.sources.http import CATALOGUE, VOLUMES, Transport, book_fields, book_url, fetch, found_isbn, ok, search_url, volume_fields, volume_url

#: Columns that an answer may fill; what is there already stays.
FILLED = ("title", "authors", "isbn", "publisher", "publish_date", "description")


def missing_isbns(rows: DataFrame, transport: Transport, author_col: str, catalogue: str = CATALOGUE) -> DataFrame:
    """(id, isbn) found by title and author; rows without either aren't asked for, failures find nothing."""
    asked = rows.where((F.coalesce("title", F.lit("")) != "") & F.col(author_col).isNotNull())
    answers = fetch(asked.select("id", search_url(F.col("title"), F.col(author_col), catalogue).alias("url")), transport)
    return answers.where(ok()).select("id", found_isbn(F.col("body")).alias("isbn")).where(F.col("isbn").isNotNull())


def enrich_editions(editions: DataFrame, works: DataFrame, transport: Transport, now: str, catalogue: str = CATALOGUE, volumes: str = VOLUMES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(editions, works, outcome) after every edition not attempted yet was looked up.

    Without an ISBN one is searched for by title and authors.  The catalogue is asked
    first and the volume service where it knows nothing.  outcome: ``enriched``,
    ``unknown`` to both (attempted, not asked again), ``failed`` or ``no_isbn`` (both
    asked again next time).  Works that turn out to be one in the catalogue are merged.
    """
    due = editions.where(F.col("enrichment_attempted") == 0)
    searched = checkpointed(missing_isbns(due.where(F.col("isbn").isNull()), transport, "authors", catalogue))
    known = due.select("id", "work_id", "isbn").join(searched.withColumnRenamed("isbn", "__found"), "id", "left").select("id", "work_id", F.coalesce(normalize_isbn("isbn"), "__found").alias("isbn"))
    first = checkpointed(fetch(known.where(F.col("isbn").isNotNull()).withColumn("url", book_url(F.col("isbn"), catalogue)), transport))
    answered = first.withColumn("fields", F.when(ok(), book_fields(F.col("body"), F.col("isbn"))))
    empty = answered.where(ok() & F.col("fields").isNull()).select("id", "work_id", "isbn")
    second = checkpointed(fetch(empty.withColumn("url", volume_url(F.col("isbn"), volumes)), transport)).withColumn("fields", F.when(ok(), volume_fields(F.col("body"))))
    status = F.when(~ok(), "failed").when(F.col("fields").isNull(), "unknown").otherwise("enriched")
    done = second.select("id", "work_id", status.alias("status"), "fields").unionByName(
        answered.join(empty.select("id"), "id", "left_anti").select("id", "work_id", F.when(~ok(), "failed").otherwise("enriched").alias("status"), "fields")
    )
    done = checkpointed(done)
    outcome = done.select("id", "status").unionByName(known.where(F.col("isbn").isNull()).select("id", F.lit("no_isbn").alias("status")))
    updates = done.where(F.col("status").isin("enriched", "unknown")).select(
        "id", *[F.col(f"fields.{c}").alias(c) for c in FILLED if c != "isbn"], normalize_isbn("fields.isbn").alias("isbn"),
        F.when(F.col("status") == "enriched", F.lit(now)).alias("enriched_at"), F.lit(1).cast("long").alias("enrichment_attempted"),
    )
    with_isbn = coalesce_update(editions, searched, "id", fill=("isbn",))
    enriched = coalesce_update(with_isbn, updates, "id", fill=FILLED, overwrite=("enriched_at", "enrichment_attempted"))
    keys = done.where(F.col("work_id").isNotNull()).select("work_id", F.col("fields.ol_work_id").alias("openlibrary_work_id"))
    merged_works, repointed = merge_by_key(works, enriched, keys)
    return repointed, merged_works, outcome


def enrich_wants(wants: DataFrame, transport: Transport, catalogue: str = CATALOGUE) -> tuple[DataFrame, int, int]:
    """(wants, enriched, eligible): ISBNs searched for where they lack; eligible counts rows that can't be asked for too."""
    due = wants.where(F.col("isbn13").isNull())
    found = checkpointed(missing_isbns(due, transport, "author", catalogue).withColumnRenamed("isbn", "isbn13"))
    return coalesce_update(wants, found, "id", fill=("isbn13",)), found.count(), due.count()

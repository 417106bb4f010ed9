"""A library: its stored tables and the commands on them."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from libris.checkpoints import checkpointed
from libris.operators import enrich, follow, imports, maintenance, ownership, series, stats, works
from libris.operators import search as searching
from libris.schema import DEFAULT_PRIORITY, SERIES_FILL_PRIORITY, check_priority, check_source
from libris.sources import epub, http, lists
from libris.sources.http import ServiceError, Transport
from libris.store import Store


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def take_in(store: Store, parsed: DataFrame, at: str) -> tuple[int, int]:
    """(editions inserted, number of the commit) after parsed packages came in and were linked to works, all at once."""
    before = store.table("editions")
    after = checkpointed(maintenance.insert_or_ignore(before, epub.as_editions(parsed), "source_path", "source_path"))
    linked, made = works.link_works(after, store.table("works"), at)
    return after.count() - before.count(), store.commit({"editions": linked, "works": made})


class Library:
    """Each command reads the current snapshots, and commits new ones all at once if it changes something."""

    def __init__(self, spark: SparkSession, folder: str, transport: Transport | None = None, catalogue: str = http.CATALOGUE, volumes: str = http.VOLUMES, clock=now):
        self.spark, self.store, self.clock = spark, Store(spark, folder), clock
        self.transport, self.catalogue, self.volumes = transport, catalogue, volumes

    @property
    def editions(self) -> DataFrame:
        return self.store.table("editions")

    @property
    def works(self) -> DataFrame:
        return self.store.table("works")

    @property
    def wants(self) -> DataFrame:
        return self.store.table("want_list")

    @property
    def authors(self) -> DataFrame:
        return self.store.table("followed_authors")

    def _service(self) -> Transport:
        if self.transport is None:
            raise ServiceError("no transport was given")
        return self.transport

    def scan(self, folder: str) -> dict:
        """Takes in the packages of a folder; those whose path is known are left alone."""
        parsed, others = epub.scan(self.spark, folder)
        parsed = checkpointed(parsed)  # read once: the files may change meanwhile
        inserted, number = take_in(self.store, parsed, self.clock())
        failed = [r.asDict() for r in parsed.where(F.col("error").isNotNull()).select("source_path", "error").orderBy("source_path").collect()]
        return {"scanned": parsed.count(), "inserted": inserted, "skipped_non_epub": others, "errors": failed, "commit": number}

    def list(self) -> DataFrame:
        return self.editions.orderBy("id")

    def search(self, query: str) -> DataFrame:
        return searching.search(self.editions, query)

    def info(self, edition_id: int) -> dict | None:
        row = self.editions.where(F.col("id") == edition_id).first()
        return row.asDict() if row else None

    def enrich(self) -> dict[str, int]:
        """Counts of editions by what became of them."""
        e, w, outcome = enrich.enrich_editions(self.editions, self.works, self._service(), self.clock(), self.catalogue, self.volumes)
        counts = {r["status"]: r["count"] for r in outcome.groupBy("status").count().collect()}
        self.store.commit({"editions": e, "works": w})
        return counts

    def _import(self, entries: DataFrame, source: str, skipped: int = 0, priority: int = DEFAULT_PRIORITY, notes: str | None = None) -> dict[str, int]:
        after, outcome = imports.import_wants(self.wants, self.editions, entries, source, self.clock(), priority, notes)
        out = imports.summary(outcome, skipped)
        self.store.commit({"want_list": after})
        return out

    def import_export(self, path: str, all_shelves: bool = False) -> dict[str, int]:
        entries, skipped = lists.read_export(self.spark, path, all_shelves)
        return self._import(entries, "goodreads_csv", skipped.count())

    def import_text(self, path: str) -> dict[str, int]:
        return self._import(lists.read_lines(self.spark, path), "text_file")

    def import_reading_list(self, user: str) -> dict[str, int]:
        return self._import(http.entries(self.spark, http.reading_list(self._service(), user, self.catalogue)), "openlibrary")

    def add_want(self, title: str, author: str | None = None, isbn: str | None = None, priority: int = DEFAULT_PRIORITY, notes: str | None = None) -> str:
        """``inserted``, ``skipped_owned`` or ``updated`` (it was wanted already)."""
        check_priority(priority)
        entry = self.spark.createDataFrame([(title, author, isbn, None, 0)], "title string, author string, isbn13 string, source_id string, line long")
        after, outcome = imports.import_wants(self.wants, self.editions, entry, "manual", self.clock(), priority, notes)
        status = outcome.first()["status"]
        self.store.commit({"want_list": after})
        return status

    def list_wants(self, source: str | None = None) -> DataFrame:
        rows = self.wants if source is None else self.wants.where(F.col("source") == check_source(source))
        return rows.orderBy("id")

    def find_want(self, isbn: str) -> DataFrame:
        """The first want of an ISBN in any form."""
        probe = isbn.upper()
        kept = "".join(c for c in probe if c in "0123456789X")
        return self.wants.where(F.col("isbn13") == kept).orderBy("id").limit(1)

    def enrich_wants(self) -> tuple[int, int]:
        after, found, eligible = enrich.enrich_wants(self.wants, self._service(), self.catalogue)
        self.store.commit({"want_list": after})
        return found, eligible

    def remove_want(self, want_id: int) -> bool:
        before = self.wants
        if before.where(F.col("id") == want_id).isEmpty():
            return False
        self.store.commit({"want_list": before.where(F.col("id") != want_id)})
        return True

    def grab(self, min_priority: int | None = None) -> DataFrame:
        return ownership.grab_list(self.wants, self.editions, min_priority)

    def stats(self) -> DataFrame:
        return stats.library_stats(self.editions, self.works, self.wants)

    def follow(self, name: str) -> tuple[str, dict[str, int]]:
        """The status, and the summary of the author's works queued as wants; both are committed at once."""
        authors, found, status = follow.add_author(self.authors, name, self._service(), self.clock(), self.catalogue)
        if status != "added":
            return status, imports.summary(self.spark.createDataFrame([], "line long, status string"))
        return status, self._queue(http.entries(self.spark, found), {"followed_authors": authors})

    def _queue(self, found: DataFrame, more: dict[str, DataFrame]) -> dict[str, int]:
        after, outcome = imports.import_wants(self.wants, self.editions, found, "author_follow", self.clock())
        out = imports.summary(outcome)
        self.store.commit({"want_list": after, **more})
        return out

    def sync(self) -> dict[str, int]:
        """Queues new works of all followed authors; raises after the others are done if any failed."""
        authors, found, failed = follow.sync_authors(self.authors, self._service(), self.clock(), self.catalogue)
        out = self._queue(found, {"followed_authors": authors})
        if failed:
            raise ServiceError(f"sync failed for: {', '.join(failed)}")
        return out

    def unfollow(self, name: str) -> bool:
        authors, gone = follow.remove_author(self.authors, name)
        if gone:
            self.store.commit({"followed_authors": authors})
        return gone

    def list_authors(self) -> DataFrame:
        return self.authors.orderBy("name")

    def series(self) -> DataFrame:
        return series.series_views(self.editions)

    def fill_series(self) -> dict[str, int]:
        """Queues the books that the catalogue ascribes to any owned series, not only to its gaps."""
        names = self.editions.where((F.col("owned") == 1) & F.col("series_name").isNotNull()).select("series_name").distinct()
        asked = checkpointed(http.fetch(names.withColumn("url", http.series_url(F.col("series_name"), self.catalogue)), self._service()))
        found = asked.where(http.ok()).select("series_name", F.posexplode(http.series_books(F.col("body"), F.col("series_name"))).alias("place", "book"))
        out = self._import(http.numbered(found.orderBy("series_name", "place").select("book.*")), "series_fill", priority=SERIES_FILL_PRIORITY)
        failed = [r["series_name"] for r in asked.where(~http.ok()).select("series_name").orderBy("series_name").collect()]
        if failed:
            raise ServiceError(f"series fill failed for: {', '.join(failed)}")
        return out

"""Catalogue services: requests, paging and what is taken from their answers.

A transport is any callable that takes a URL and gives (status, body); keys are
looked up in parallel by tasks that each call it, pages one after the other.
Answers become a column of JSON text, from which native functions take fields.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from libris.functions.text import normalize_isbn, trim, url_encode

Transport = Callable[[str], tuple[int, str]]

#: Where the services live; tests give others.
CATALOGUE = "https://openlibrary.org"
VOLUMES = "https://www.googleapis.com"
#: A paging service that has more pages than this is an error.
MOST_PAGES = 10_000
WORKS_PAGE = 50


class ServiceError(RuntimeError):
    """A service answered with a failure."""


def fetch(requests: DataFrame, transport: Transport, url_col: str = "url") -> DataFrame:
    """``requests`` with ``status`` and ``body``; a transport that raises gives status 0 and the error as body."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for url in batch[url_col]:
                try:
                    answers.append(transport(url))
                except Exception as error:  # noqa: BLE001 any failure of a transport is a failed request
                    answers.append((0, repr(error)))
            yield batch.assign(status=[int(a[0]) for a in answers], body=[a[1] for a in answers])

    schema = T.StructType([*requests.schema.fields, T.StructField("status", T.IntegerType()), T.StructField("body", T.StringType())])
    return requests.mapInPandas(run, schema)


def ok() -> Column:
    return F.col("status").between(200, 299)


def book_url(isbn: Column, base: str = CATALOGUE) -> Column:
    return F.concat(F.lit(f"{base}/api/books?bibkeys=ISBN:"), isbn, F.lit("&format=json&jscmd=data"))


def volume_url(isbn: Column, base: str = VOLUMES) -> Column:
    return F.concat(F.lit(f"{base}/books/v1/volumes?q=isbn:"), isbn)


def search_url(title: Column, author: Column, base: str = CATALOGUE) -> Column:
    return F.concat(F.lit(f"{base}/search.json?title="), url_encode(title), F.lit("&author="), url_encode(author))


_BOOK = "struct<title:string,publishers:array<struct<name:string>>,publish_date:string,identifiers:struct<isbn_13:array<string>>,works:array<struct<key:string>>>"
_VOLUMES = (
    "struct<totalItems:long,items:array<struct<volumeInfo:struct<title:string,authors:array<string>,publisher:string,publishedDate:string,description:string,"
    "industryIdentifiers:array<struct<type:string,identifier:string>>>>>>"
)
_SEARCH = "struct<docs:array<struct<isbn:array<string>>>>"


def first(array: Column) -> Column:
    """The first element, null where there is none."""
    return F.try_element_at(array, F.lit(1))


def book_fields(body: Column, isbn: Column) -> Column:
    """struct(title, authors, isbn, publisher, publish_date, description, ol_work_id) of a catalogue's answer; null if it lacks the book."""
    own = F.element_at(F.from_json(body, "map<string,string>"), F.concat(F.lit("ISBN:"), isbn))
    b = F.from_json(own, _BOOK)
    text = F.coalesce(F.get_json_object(own, "$.description.value"), F.get_json_object(own, "$.description"))
    fields = F.struct(
        b["title"].alias("title"),
        F.lit(None).cast("string").alias("authors"),
        first(b["identifiers"]["isbn_13"]).alias("isbn"),
        first(b["publishers"])["name"].alias("publisher"),
        b["publish_date"].alias("publish_date"),
        text.alias("description"),
        first(b["works"])["key"].alias("ol_work_id"),
    )
    return F.when(own.isNotNull(), fields)


def volume_fields(body: Column) -> Column:
    """The same struct of a volume service's answer; null if it found nothing."""
    v = F.from_json(body, _VOLUMES)
    info = first(v["items"])["volumeInfo"]
    thirteen = first(F.filter(info["industryIdentifiers"], lambda x: x["type"] == "ISBN_13"))["identifier"]
    fields = F.struct(
        info["title"].alias("title"),
        F.array_join(info["authors"], ", ").alias("authors"),
        thirteen.alias("isbn"),
        info["publisher"].alias("publisher"),
        info["publishedDate"].alias("publish_date"),
        info["description"].alias("description"),
        F.lit(None).cast("string").alias("ol_work_id"),
    )
    return F.when((F.coalesce(v["totalItems"], F.lit(0)) > 0) & info.isNotNull(), fields)


def found_isbn(body: Column) -> Column:
    """The first ISBN of exactly 13 digits of a search's first hit, in normal form."""
    isbns = first(F.from_json(body, _SEARCH)["docs"])["isbn"]
    return normalize_isbn(first(F.filter(isbns, lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")) == 13)))


def _get(transport: Transport, url: str, missing: str | None = None) -> dict:
    status, body = transport(url)
    if status == 404 and missing:
        raise ServiceError(missing)
    if not 200 <= status <= 299:
        raise ServiceError(f"{url}: status {status}")
    return json.loads(body)


def reading_list(transport: Transport, user: str, base: str = CATALOGUE) -> list[dict]:
    """All works a user wants to read: title, key, author.  An unknown user is an error."""
    out: list[dict] = []
    for page in range(1, MOST_PAGES + 1):
        body = _get(transport, f"{base}/people/{quote(user)}/books/want-to-read.json?page={page}", f"user not found: {user}")
        entries = body.get("reading_log_entries") or []
        out += [{"title": w.get("title"), "author": ", ".join(w.get("author_names") or []) or None, "source_id": w.get("key")} for w in (e["work"] for e in entries)]
        if not entries or page >= -(-int(body.get("numFound") or 0) // len(entries)):
            return out
    raise ServiceError(f"more than {MOST_PAGES} pages of {user}'s reading list")


def author_key(transport: Transport, name: str, base: str = CATALOGUE) -> str | None:
    """The key of the best match of an author search."""
    docs = _get(transport, f"{base}/search/authors.json?q={quote(name, safe='')}").get("docs") or []
    return docs[0]["key"] if docs else None


def author_works(transport: Transport, key: str, base: str = CATALOGUE) -> list[dict]:
    """All works of an author: title and key, page by page to the first empty one."""
    bare = key.removeprefix("/authors/")
    out: list[dict] = []
    for page in range(MOST_PAGES):
        entries = _get(transport, f"{base}/authors/{bare}/works.json?limit={WORKS_PAGE}&offset={page * WORKS_PAGE}").get("entries") or []
        if not entries:
            return out
        out += [{"title": e.get("title"), "source_id": e.get("key")} for e in entries]
    raise ServiceError(f"more than {MOST_PAGES} pages of works of {key}")


_FOUND = "id long, name string, ol_key string, error string, works array<struct<title:string,source_id:string>>"


def works_of(authors: DataFrame, transport: Transport, base: str = CATALOGUE) -> DataFrame:
    """(id, name, ol_key, error, works) of ``authors`` (id, name, ol_key): each author's pages are one task's turn.

    An author without a key is searched for.  error is null where all went well.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ident, name, key in zip(batch["id"], batch["name"], batch["ol_key"], strict=True):
                try:
                    key = key or author_key(transport, name, base)
                    if key is None:
                        raise ServiceError(f"author not found: {name}")
                    rows.append((ident, name, key, None, author_works(transport, key, base)))
                except Exception as error:  # noqa: BLE001 any failure of a service fails this author only
                    rows.append((ident, name, key, repr(error), []))
            yield pd.DataFrame(rows, columns=["id", "name", "ol_key", "error", "works"])

    return authors.select("id", "name", "ol_key").mapInPandas(run, _FOUND)


_SERIES = "struct<docs:array<struct<title:string,author_name:array<string>,isbn:array<string>,series:array<string>,key:string>>>"


def series_url(series: Column, base: str = CATALOGUE) -> Column:
    return F.concat(F.lit(f"{base}/search.json?q="), url_encode(series), F.lit("&fields=title,author_name,isbn,series,series_number,key&limit=50"))


def series_books(body: Column, series: Column) -> Column:
    """Array of (title, author, isbn13, source_id) of books that a search ascribes to a series, by its name within theirs in any case."""
    docs = F.coalesce(F.from_json(body, _SERIES)["docs"], F.from_json(F.lit('{"docs": []}'), _SERIES)["docs"])
    fits = F.filter(docs, lambda d: F.exists(F.coalesce(d["series"], F.array().cast("array<string>")), lambda s: F.contains(F.lower(s), F.lower(series))))
    return F.transform(fits, lambda d: F.struct(d["title"].alias("title"), first(d["author_name"]).alias("author"), first(d["isbn"]).alias("isbn13"), d["key"].alias("source_id")))


def numbered(rows: DataFrame) -> DataFrame:
    """Sorted rows (title, author, isbn13, source_id) as entries with a ``line`` that rises with their order; those without a title go."""
    titled = rows.withColumn("title", trim("title")).where(F.coalesce("title", F.lit("")) != "")
    return titled.select("title", "author", "isbn13", "source_id").withColumn("line", F.monotonically_increasing_id())


def entries(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows of the paging functions as entries (title, author, isbn13, source_id, line); those without a title go."""
    kept = [(r["title"].strip(), r.get("author"), r.get("isbn13"), r.get("source_id"), i) for i, r in enumerate(rows) if (r.get("title") or "").strip()]
    return spark.createDataFrame(kept, "title string, author string, isbn13 string, source_id string, line long")

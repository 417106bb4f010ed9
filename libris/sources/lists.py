"""Want lists: reading-site CSV exports and plain text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from libris.functions.text import blank_to_null, is_list_entry, isbn10_to_13, parse_line, trim, unwrap_isbn

#: Headers that an export must have, and may have.
REQUIRED = ("Title", "Author", "ISBN13", "Book Id")
OPTIONAL = ("ISBN", "Exclusive Shelf")
#: The shelf of books to be read.
SHELF = "to-read"


def read_export(spark: SparkSession, path: str, all_shelves: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries, skipped) of a CSV export, columns found by their headers.

    entries: title, author, isbn13, source_id and ``line`` for the order.  skipped:
    a row per record that is damaged, has no title or stands on another shelf.  Blank
    records are neither.  The ISBN-13 cell counts, else the ISBN cell made thirteen digits long.
    """
    options = {"multiLine": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    head = spark.read.options(**options).csv(path).limit(1).collect()
    names = [(c or "").lstrip("﻿") for c in head[0]] if head else []
    lacking = [c for c in REQUIRED if c not in names]
    if lacking:
        raise ValueError(f"missing column: {', '.join(lacking)}")
    # a schema binds by position, so it is made of the header; repeated headers get their place as a name
    fields = [c if names.index(c) == i else f"_{i}" for i, c in enumerate(names)]
    schema = T.StructType([*[T.StructField(f, T.StringType()) for f in fields], T.StructField("_damaged", T.StringType())])
    raw = spark.read.options(header=True, enforceSchema=True, columnNameOfCorruptRecord="_damaged", **options).schema(schema).csv(path)
    get = lambda c: blank_to_null(f"`{c}`") if c in fields else F.lit(None).cast("string")
    blank = F.concat_ws("", *[trim(f"`{f}`") for f in fields]) == ""
    rows = raw.withColumn("line", F.monotonically_increasing_id()).where(F.col("_damaged").isNotNull() | ~blank)
    title = trim("Title")
    shelf = F.lit(True) if all_shelves else F.coalesce(get("Exclusive Shelf"), F.lit("")) == SHELF
    good = F.col("_damaged").isNull() & (F.coalesce(title, F.lit("")) != "") & shelf
    entries = rows.where(good).select(
        title.alias("title"), get("Author").alias("author"), F.coalesce(unwrap_isbn(get("ISBN13")), isbn10_to_13(unwrap_isbn(get("ISBN")))).alias("isbn13"), get("Book Id").alias("source_id"), "line"
    )
    return entries, rows.where(~good).select("line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Entries (title, author, isbn13, source_id, line) of a text file, a line each; blank lines and comments don't count."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    parsed = lines.where(is_list_entry("value")).withColumn("p", parse_line("value"))
    none = F.lit(None).cast("string")
    return parsed.select(F.col("p.title").alias("title"), F.col("p.author").alias("author"), none.alias("isbn13"), none.alias("source_id"), "line")

"""What of a want list is owned: by ISBN, by likeness, by work; and the list of what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from libris.functions.similarity import with_similar
from libris.functions.text import normalize_isbn


def owned(editions: DataFrame) -> DataFrame:
    return editions.where(F.col("owned") == 1)


def owned_by_isbn(wants: DataFrame, editions: DataFrame) -> DataFrame:
    """Ids of wants whose ISBN an owned edition has."""
    held = owned(editions).where(F.col("isbn").isNotNull()).select(F.col("isbn").alias("isbn13"))
    return wants.join(held, "isbn13", "left_semi").select("id")


def owned_by_likeness(wants: DataFrame, editions: DataFrame) -> DataFrame:
    """Ids of wants with an author that are the same work as an owned edition by title and author.

    Distinct (title, author) pairs are scored, not rows.
    """
    asked = wants.where(F.col("author").isNotNull())
    hits = with_similar(asked.select("title", "author"), owned(editions).select("title", F.col("authors").alias("author")))
    hits = hits.select(F.col("title").alias("__t"), F.col("author").alias("__a"))
    return asked.join(hits, (F.coalesce("title", F.lit("")) == F.col("__t")) & (F.col("author") == F.col("__a")), "left_semi").select("id")


def owned_by_work_on_import(wants: DataFrame, editions: DataFrame) -> DataFrame:
    """Ids of wants whose ISBN an edition has, owned or not, of whose work some edition is owned."""
    works = owned(editions).where(F.col("work_id").isNotNull()).select("work_id").distinct()
    isbns = editions.where(F.col("isbn").isNotNull()).join(works, "work_id", "left_semi").select(F.col("isbn").alias("isbn13"))
    return wants.join(isbns, "isbn13", "left_semi").select("id")


def owned_by_work_on_grab(wants: DataFrame, editions: DataFrame) -> DataFrame:
    """Ids of wants whose normal ISBN an owned edition of a known work has."""
    isbns = owned(editions).where(F.col("work_id").isNotNull() & F.col("isbn").isNotNull()).select(normalize_isbn("isbn").alias("__isbn"))
    return wants.join(isbns, normalize_isbn("isbn13") == F.col("__isbn"), "left_semi").select("id")


def _union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def owned_on_import(wants: DataFrame, editions: DataFrame) -> DataFrame:
    """Ids of wants that an import passes over; what an ISBN decides isn't scored."""
    exact = _union(owned_by_isbn(wants, editions), owned_by_work_on_import(wants, editions))
    rest = wants.join(exact, "id", "left_anti")
    return _union(exact, owned_by_likeness(rest, editions))


def grab_list(wants: DataFrame, editions: DataFrame, min_priority: int | None = None) -> DataFrame:
    """Wants that nothing owned answers, highest priority first, then by title in lower case, then by id."""
    asked = wants if min_priority is None else wants.where(F.col("priority") >= min_priority)
    exact = _union(owned_by_isbn(asked, editions), owned_by_work_on_grab(asked, editions))
    rest = asked.join(exact, "id", "left_anti")
    missing = rest.join(owned_by_likeness(rest, editions), "id", "left_anti")
    return missing.orderBy(F.desc("priority"), F.lower("title"), "id").select("title", "author", "isbn13", "priority", "source", "notes")


def missing_by_isbn(wants: DataFrame, editions: DataFrame) -> DataFrame:
    """Wants whose ISBN no owned edition has; wants without an ISBN stay."""
    held = owned(editions).select(F.col("isbn").alias("isbn13"))
    return wants.join(held, "isbn13", "left_anti")

"""Linking of editions to works."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from libris.functions.similarity import SAME_WORK, similar_pairs
from libris.operators.components import components
from libris.operators.maintenance import max_id, with_ids


def link_works(editions: DataFrame, works: DataFrame, now: str, least: float = SAME_WORK) -> tuple[DataFrame, DataFrame]:
    """(editions, works) with every edition linked that can be.

    An edition with an ISBN takes the work of the first edition of that ISBN, or a
    new one (titled ``Unknown`` where it has none).  One without, but with title and
    authors, takes the work of the first edition without ISBN, in order of source path, that
    is the same work; the first match counts and likeness is not carried on.  Others stay unlinked.
    Pairs are scored in parallel; the greedy choice runs within each connected group of likes.
    """
    base = max_id(works)
    # by ISBN
    with_isbn = editions.where(F.col("isbn").isNotNull())
    known = with_isbn.groupBy("isbn").agg(F.min_by("work_id", F.when(F.col("work_id").isNotNull(), F.col("id"))).alias("__work"), F.min(F.when(F.col("work_id").isNull(), F.col("source_path"))).alias("__first"))
    fresh = with_ids(known.where(F.col("__work").isNull()).select("isbn", F.col("__first").alias("source_path")), base, "isbn", id_col="__new")
    isbn_work = known.join(fresh.select("isbn", "__new"), "isbn", "left").select("isbn", F.coalesce("__work", "__new").alias("__by_isbn"))
    unknown = F.lit("Unknown")
    first = editions.select("source_path", "title", "authors")
    new_isbn = fresh.join(first, "source_path").select(F.col("__new").alias("id"), F.coalesce("title", unknown).alias("canonical_title"), F.coalesce("authors", unknown).alias("canonical_authors"))
    # by likeness
    bare = editions.where(F.col("isbn").isNull() & F.col("title").isNotNull() & F.col("authors").isNotNull())
    keyed = bare.select("id", "source_path", "work_id", "title", F.col("authors").alias("author"))
    # only what isn't linked yet looks for a partner
    likes = similar_pairs(keyed.where(F.col("work_id").isNull()), keyed, least).select("left_title", "left_author", "right_title", "right_author")
    numbered = keyed.withColumn("__key", F.xxhash64("title", "author"))
    pairs = likes.select(F.xxhash64("left_title", "left_author").alias("a"), F.xxhash64("right_title", "right_author").alias("b"))
    roots = components(pairs.where("a <> b")).select(F.col("node").alias("__key"), F.col("root").alias("__root"))
    grouped = numbered.join(roots, "__key", "left").withColumn("__root", F.coalesce("__root", "__key"))
    neighbours = pairs.groupBy(F.col("a").alias("__key")).agg(F.collect_set("b").alias("__likes"))
    ready = grouped.join(neighbours, "__key", "left").withColumn("__likes", F.coalesce("__likes", F.array("__key")))

    def greedy(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["linked", "source_path"], ascending=[False, True], kind="stable")
        work_of_key: dict[int, tuple[int, str]] = {}
        out = []
        for n, (ident, path, key, own, likes) in enumerate(zip(batch["id"], batch["source_path"], batch["__key"], batch["work_id"], batch["__likes"], strict=True)):
            if pd.isna(own):
                found = min((work_of_key[k] for k in set(likes) | {key} if k in work_of_key), default=None)
                work = found[1] if found else f"new:{ident}"
            else:
                work = f"old:{int(own)}"
            work_of_key.setdefault(key, (n, work))
            out.append((ident, work))
        return pd.DataFrame(out, columns=["id", "work"])

    columns = ready.withColumn("linked", F.col("work_id").isNotNull()).select("id", "source_path", "work_id", "__key", "__likes", "__root", "linked")
    chosen = columns.groupBy("__root").applyInPandas(greedy, "id long, work string")
    made = chosen.where(F.startswith("work", F.lit("new:"))).select(F.substring("work", 5, 20).cast("long").alias("first_id")).distinct()
    offset = fresh.agg(F.coalesce(F.max("__new"), F.lit(base)).cast("long")).first()[0]
    new_likes = with_ids(made, offset, "first_id", id_col="__new")
    by_like = chosen.join(new_likes, F.concat(F.lit("new:"), F.col("first_id").cast("string")) == F.col("work"), "left").select(
        F.col("id"), F.coalesce("__new", F.substring("work", 5, 20).try_cast("long")).alias("__by_like")
    )
    new_bare = new_likes.join(editions.select(F.col("id").alias("first_id"), "title", "authors"), "first_id").select(F.col("__new").alias("id"), F.col("title").alias("canonical_title"), F.col("authors").alias("canonical_authors"))
    linked = editions.join(isbn_work, "isbn", "left").join(by_like, "id", "left").withColumn("work_id", F.coalesce("work_id", "__by_isbn", "__by_like")).select(*editions.columns)
    added = new_isbn.unionByName(new_bare).withColumn("openlibrary_work_id", F.lit(None).cast("string")).withColumn("created_at", F.lit(now))
    return linked, works.unionByName(added)


def first_work_by_isbn(editions: DataFrame) -> DataFrame:
    """``editions`` with ``first_work_id``: the work of the first edition by id that shares the ISBN and has one."""
    w = Window.partitionBy("isbn").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return editions.withColumn("first_work_id", F.when(F.col("isbn").isNotNull(), F.first("work_id", ignorenulls=True).over(w)))

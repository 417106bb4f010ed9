"""Changes of tables, as new tables: insert-or-ignore, coalescing update, merge by key, delete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_ids(rows: DataFrame, start: int, *order: str, id_col: str = "id", bucket: Column | None = None) -> DataFrame:
    """``rows`` numbered from ``start`` + 1 on, with the same numbers however often it is computed.

    Numbers come in two steps, rows per bucket and places within one, so that no task
    orders all rows, and only the sizes of the buckets, 4096 by default, are summed up in one.  Buckets are hashes of the order's columns by default; a bucket that
    rises with the order makes the numbers rise with it too.
    """
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(4096)) if bucket is None else bucket)
    sizes = dealt.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    return dealt.withColumn("__own", own).join(before, "__bucket").withColumn(id_col, (F.col("__before") + F.col("__own") + start).cast("long")).drop("__bucket", "__own", "__before")


def max_id(table: DataFrame, id_col: str = "id") -> int:
    return table.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).first()[0]


def first_per_key(rows: DataFrame, key: Sequence[str], *order: str | Column) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__place") == 1).drop("__place")


def insert_or_ignore(table: DataFrame, incoming: DataFrame, key: str, *order: str) -> DataFrame:
    """``table`` and those incoming rows whose key it lacks, the first of each key; rows that are there never change."""
    new = first_per_key(incoming.join(table.select(key), key, "left_anti"), [key], *order)
    return table.unionByName(with_ids(new, max_id(table), key), allowMissingColumns=True)


def coalesce_update(table: DataFrame, updates: DataFrame, key: str, fill: Sequence[str] = (), overwrite: Sequence[str] = ()) -> DataFrame:
    """``table`` with nulls of ``fill`` columns taken from the update of the same key and ``overwrite`` columns set by it."""
    u = updates.select(F.col(key), *[F.col(c).alias(f"__new_{c}") for c in (*fill, *overwrite)], F.lit(True).alias("__there"))
    joined = table.join(u, key, "left")
    new = {c: F.coalesce(F.col(c), F.col(f"__new_{c}")) for c in fill} | {c: F.when(F.col("__there"), F.col(f"__new_{c}")).otherwise(F.col(c)) for c in overwrite}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in table.columns])


def delete_rows(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def merge_by_key(works: DataFrame, editions: DataFrame, keys: DataFrame, key_col: str = "openlibrary_work_id") -> tuple[DataFrame, DataFrame]:
    """(works, editions) after works got catalogue keys: works of one key become the one of the smallest id.

    ``keys`` has work_id and the key; the smallest key stands if a work gets several.
    Editions of works that go are repointed.
    """
    given = keys.where(F.col(key_col).isNotNull()).groupBy(F.col("work_id").alias("id")).agg(F.min(key_col).alias("__key"))
    keyed = works.join(given, "id", "left").withColumn(key_col, F.coalesce("__key", key_col)).select(*works.columns)
    least = keyed.where(F.col(key_col).isNotNull()).groupBy(key_col).agg(F.min("id").alias("__to"))
    remap = keyed.join(least, key_col).where(F.col("id") != F.col("__to")).select(F.col("id").alias("__from"), "__to")
    kept = keyed.join(remap, keyed["id"] == remap["__from"], "left_anti")
    moved = editions.join(remap, editions["work_id"] == remap["__from"], "left").withColumn("work_id", F.coalesce("__to", "work_id")).select(*editions.columns)
    return kept, moved

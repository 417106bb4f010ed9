"""Import of want lists: what is owned is passed over, what is wanted already is updated, the rest comes in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from libris.checkpoints import checkpointed
from libris.functions.similarity import SAME_WORK, similar_pairs, similarity
from libris.functions.text import normalize_isbn
from libris.operators.components import components
from libris.operators.maintenance import max_id, with_ids
from libris.operators.ownership import owned_on_import
from libris.schema import DEFAULT_PRIORITY, check_priority, check_source

_STATE = "id long, title string, author string, isbn13 string, source string, source_id string, added_at string, priority long, notes string, line long, status string"


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    """Takes incoming rows in order; each updates the first want it matches, or is a new one.

    A match is one of the ISBN, else of title and author, else (without an author)
    of the title in lower case with a want that has none either.
    """
    rows = rows.astype(object).where(rows.notna(), None)
    records = rows.to_dict("records")
    state = sorted((r for r in records if r["line"] is None), key=lambda r: r["id"])
    for new in sorted((r for r in records if r["line"] is not None), key=lambda r: r["line"]):
        match = next((w for w in state if new["isbn13"] is not None and w["isbn13"] == new["isbn13"]), None)
        if match is None and new["author"] is not None:
            named = [w for w in state if w["author"] is not None]
            if named:
                n = len(named)
                scores = similarity([new["title"]] * n, [new["author"]] * n, [w["title"] for w in named], [w["author"] for w in named])
                match = next((w for w, s in zip(named, scores, strict=True) if s >= SAME_WORK), None)
        elif match is None:
            match = next((w for w in state if w["author"] is None and w["title"].lower() == new["title"].lower()), None)
        if match is None:
            state.append({**new, "status": "inserted"})
        else:
            # a list that lacks an ISBN or an id doesn't take away the one that is known
            match.update(title=new["title"], author=new["author"], isbn13=new["isbn13"] or match["isbn13"], source_id=new["source_id"] or match["source_id"])
            state.append({**new, "status": "updated"})
    return pd.DataFrame([r for r in state if r["status"] != "updated"] + [r for r in state if r["status"] == "updated"], columns=list(rows.columns))


def import_wants(wants: DataFrame, editions: DataFrame, entries: DataFrame, source: str, now: str, priority: int = DEFAULT_PRIORITY, notes: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(wants, outcome) after ``entries`` (title, author, isbn13, source_id, line) came in, in order of their lines.

    outcome has a row per entry: its line and ``skipped_owned``, ``updated`` or
    ``inserted``.  Ownership is found set-based.  Matching depends on order, since an
    entry may match what an earlier one brought or changed; it runs as a fold within each group of
    rows that any chain of equal ISBNs, like titles and authors, or equal titles joins.
    ISBNs are stored in normal form.  An update keeps source, priority and notes.
    """
    check_source(source)
    check_priority(priority)
    given = checkpointed(entries.withColumn("isbn13", F.nullif(normalize_isbn("isbn13"), F.lit(""))).withColumn("id", F.col("line")))
    skipped = checkpointed(owned_on_import(given, editions))
    rest = given.join(skipped, "id", "left_anti")
    none = F.lit(None)
    old = wants.withColumn("line", none.cast("long")).withColumn("status", none.cast("string"))
    new = rest.select(
        none.cast("long").alias("id"), "title", "author", "isbn13", F.lit(source).alias("source"), "source_id", F.lit(now).alias("added_at"),
        F.lit(priority).cast("long").alias("priority"), F.lit(notes).cast("string").alias("notes"), "line", F.lit("new").alias("status"),
    )
    rows = old.select(*new.columns).unionByName(new)
    me = F.xxhash64(F.coalesce(F.concat(F.lit("w"), F.col("id").cast("string")), F.concat(F.lit("n"), F.col("line").cast("string"))))
    rows = checkpointed(rows.withColumn("node", me))
    book = F.xxhash64(F.lit("book"), "title", "author")
    hubs = F.array_compact(
        F.array(
            F.when(F.col("isbn13").isNotNull(), F.xxhash64(F.lit("isbn"), "isbn13")),
            F.when(F.col("author").isNotNull(), book).otherwise(F.xxhash64(F.lit("title"), F.lower("title"))),
        )
    )
    to_hubs = rows.select(F.col("node").alias("a"), F.explode(hubs).alias("b"))
    named = rows.where(F.col("author").isNotNull()).select("title", "author")
    # an old want matters only to what comes in
    incoming = rows.where(F.col("line").isNotNull() & F.col("author").isNotNull()).select("title", "author")
    likes = similar_pairs(incoming, named).select(F.xxhash64(F.lit("book"), "left_title", "left_author").alias("a"), F.xxhash64(F.lit("book"), "right_title", "right_author").alias("b"))
    roots = components(to_hubs.unionByName(likes))
    grouped = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    untouched = grouped.join(grouped.where(F.col("line").isNotNull()).select("root").distinct(), "root", "left_anti")
    touched = grouped.join(grouped.where(F.col("line").isNotNull()).select("root").distinct(), "root", "left_semi")
    folded = checkpointed(touched.select("root", *new.columns).groupBy("root").applyInPandas(lambda pdf: _fold(pdf.drop(columns="root")), _STATE))
    kept = folded.where(F.col("status").isNull())
    added = with_ids(folded.where(F.col("status") == "inserted").drop("id"), max_id(wants), "line", bucket=F.shiftright("line", 16))
    after = untouched.select(*wants.columns).unionByName(kept.select(*wants.columns)).unionByName(added.select(*wants.columns))
    outcome = skipped.select(F.col("id").alias("line"), F.lit("skipped_owned").alias("status")).unionByName(folded.where(F.col("line").isNotNull()).select("line", "status"))
    return after, outcome


def summary(outcome: DataFrame, skipped_rows: int = 0) -> dict[str, int]:
    """imported, skipped_owned and skipped_rows; an update counts as imported."""
    counts = {r["status"]: r["count"] for r in outcome.groupBy("status").count().collect()}
    return {"imported": counts.get("inserted", 0) + counts.get("updated", 0), "skipped_owned": counts.get("skipped_owned", 0), "skipped_rows": skipped_rows}

"""Search that forgives typing errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from libris.functions.similarity import SEARCH_HIT, search_score


def search(editions: DataFrame, query: str, least: float = SEARCH_HIT) -> DataFrame:
    """Editions with a ``score`` of ``least`` or more, best first, then by id; distinct titles and authors are scored once."""
    t, a = F.coalesce("title", F.lit("")), F.coalesce("authors", F.lit(""))
    keyed = editions.withColumn("__t", t).withColumn("__a", a)
    scored = keyed.select("__t", "__a").distinct().withColumn("score", search_score("__t", "__a", query)).where(F.col("score") >= least)
    return keyed.join(scored, ["__t", "__a"]).drop("__t", "__a").orderBy(F.desc("score"), "id")

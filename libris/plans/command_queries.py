"""Queries that apply the library's commands to the driver's tables."""

from __future__ import annotations

import json
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from libris.functions import text
from libris.operators import enrich, follow, imports, maintenance, ownership, stats, works
from libris.operators.search import search
from libris.plans.registry import query, table
from libris.schema import AUTHORS, EDITIONS, SOURCES, WANTS, WORKS
from libris.sources import epub, http

NOW = "2024-05-01T00:00:00Z"


def _thirteen(c):
    return F.lpad(c.cast("string"), 13, "0")


def _shaped(rows: DataFrame, schema) -> DataFrame:
    """``rows`` with the columns of a table; those that it lacks are null, and needed ones have a plain value."""
    plain = {"owned": 1, "enrichment_attempted": 0, "priority": 5, "source": "manual", "added_at": NOW, "created_at": NOW}
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(plain.get(f.name))).cast(f.dataType).alias(f.name) for f in schema])


def _orders_as_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return _shaped(
        table(spark, sf_dir, "orders").select(
            key.alias("id"), (F.col("o_orderstatus") == "F").cast("long").alias("owned"), F.when(key % 4 != 0, _thirteen(F.col("o_custkey"))).alias("isbn"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "s").alias("series_name"), F.when(F.col("o_totalprice") > 150000, NOW).alias("enriched_at"), key.cast("string").alias("source_path"),
        ),
        EDITIONS,
    )


def _parts_as_wants(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.element_at(F.array(*[F.lit(s) for s in SOURCES[:5]]), F.col("p_size") % 5 + 1)
    return _shaped(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), source.alias("source"), F.when(F.col("p_size") != 9, _thirteen(F.col("p_partkey"))).alias("isbn13")), WANTS)


_STATS_SQL = """
WITH e AS (SELECT o_orderstatus = 'F' AS owned, CASE WHEN o_orderkey % 4 <> 0 THEN lpad(o_custkey::VARCHAR, 13, '0') END AS isbn, o_orderpriority = '1-URGENT' AS s, o_totalprice > 150000 AS done FROM orders),
w AS (SELECT p_size % 5 AS k, CASE WHEN p_size <> 9 THEN lpad(p_partkey::VARCHAR, 13, '0') END AS isbn13 FROM part)
"""


@query(
    _STATS_SQL
    + """
SELECT a.*, n.*, (SELECT count(*) FROM nation) AS total_works, (SELECT count(*) FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.owned AND e.isbn = w.isbn13)) AS grab_count
FROM (SELECT count(*) AS total_editions, count(*) FILTER (owned) AS owned_editions, count(isbn) AS with_isbn, count(*) FILTER (s) AS in_series, count(*) FILTER (done) AS enriched FROM e) a,
(SELECT count(*) FILTER (k = 0) AS want_goodreads_csv, count(*) FILTER (k = 1) AS want_openlibrary, count(*) FILTER (k = 2) AS want_manual,
  count(*) FILTER (k = 3) AS want_text_file, count(*) FILTER (k = 4) AS want_author_follow, 0::BIGINT AS want_series_fill FROM w) n
"""
)
def stats_conditional_counts(spark, sf_dir):
    return stats.library_stats(_orders_as_editions(spark, sf_dir), table(spark, sf_dir, "nation"), _parts_as_wants(spark, sf_dir))


@query(
    _STATS_SQL
    + """
SELECT s.name AS source, count(w.k) AS n FROM (VALUES (0, 'want_goodreads_csv'), (1, 'want_openlibrary'), (2, 'want_manual'), (3, 'want_text_file'), (4, 'want_author_follow'), (5, 'want_series_fill')) s(k, name)
LEFT JOIN w ON w.k = s.k GROUP BY s.name
"""
)
def stats_by_source(spark, sf_dir):
    one = stats_conditional_counts(spark, sf_dir)
    return one.unpivot([], [F.col(f"want_{s}") for s in SOURCES], "source", "n")


@query("SELECT c_custkey AS id FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderkey % 4 <> 0 AND o.o_orderstatus = 'F')")
def semi_join_exists(spark, sf_dir):
    wants = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), _thirteen(F.col("c_custkey")).alias("isbn13"))
    return ownership.owned_by_isbn(wants, _orders_as_editions(spark, sf_dir))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join_not_exists(spark, sf_dir):
    wants = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("doc_id").cast("string").alias("isbn13"))
    held = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("isbn"), F.lit(1).alias("owned"))
    return ownership.missing_by_isbn(wants, held).select("doc_id", "source")


@query("""
SELECT p_partkey, k FROM (SELECT p_partkey, nullif(p_size, 7)::BIGINT AS k FROM part) p
WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = p.k AND s.s_acctbal > 0)
""")
def anti_join_null_key(spark, sf_dir):
    wants = table(spark, sf_dir, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(7)).cast("long").alias("isbn13"))
    held = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("isbn"), (F.col("s_acctbal") > 0).cast("int").alias("owned"))
    return ownership.missing_by_isbn(wants, held).select("p_partkey", F.col("isbn13").alias("k"))


@query("""
SELECT p_partkey AS id FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND EXISTS (
  SELECT 1 FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE s.s_suppkey = l.l_suppkey AND n.n_regionkey = 2))
""")
def two_hop_semi(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"))
    held = table(spark, sf_dir, "supplier").join(nations, "s_nationkey", "left_semi").select(F.lit(None).cast("long").alias("isbn"), F.col("s_suppkey").alias("work_id"), F.lit(1).alias("owned"))
    known = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("isbn"), F.col("l_suppkey").alias("work_id"), F.lit(0).alias("owned"))
    wants = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("isbn13"))
    return ownership.owned_by_work_on_import(wants, held.unionByName(known)).distinct()


@query("SELECT p_partkey FROM part WHERE lower(p_brand) = 'brand#12'")
def ci_title_match(spark, sf_dir):
    return follow.find_author(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("name")), "bRAND#12").select("p_partkey")


@query("""
SELECT p_partkey, p_name AS title, NULL::VARCHAR AS authors, CASE WHEN p_size > 5 THEN lpad(p_partkey::VARCHAR, 13, '0') END AS isbn, p_brand AS publisher, p_size::VARCHAR AS publish_date, p_type AS description, '/works/' || p_size AS ol_work_id FROM part
""")
def json_extract(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    isbn = _thirteen(F.col("p_partkey"))
    described = F.when(F.col("p_size") % 2 == 0, F.to_json(F.struct(F.struct(F.col("p_type").alias("value")).alias("description")))).otherwise(F.to_json(F.struct(F.col("p_type").alias("description"))))
    rest = F.to_json(
        F.struct(
            F.col("p_name").alias("title"), F.array(F.struct(F.col("p_brand").alias("name"))).alias("publishers"), F.col("p_size").cast("string").alias("publish_date"),
            F.struct(F.when(F.col("p_size") > 5, F.array(isbn)).alias("isbn_13")).alias("identifiers"), F.array(F.struct(F.concat(F.lit("/works/"), F.col("p_size").cast("string")).alias("key"))).alias("works"),
        )
    )
    # one object of both parts
    body = F.concat(F.lit('{"ISBN:'), isbn, F.lit('":'), F.regexp_replace(rest, r"\}$", ","), F.regexp_replace(described, r"^\{", ""), F.lit("}"))
    return part.select("p_partkey", http.book_fields(body, isbn).alias("f")).select("p_partkey", "f.*")


@query("""
SELECT p_partkey, 'A & <B> "' || p_name || '"' AS title, p_brand || ', ' || p_type AS authors, lpad(p_partkey::VARCHAR, 13, '0') AS isbn, 'Series ' || p_size AS series_name, p_size::VARCHAR AS series_position FROM part
""")
def html_title_extract(spark, sf_dir):
    """Packages written, with their texts escaped, and parsed again."""
    part = table(spark, sf_dir, "part")
    rows = part.select(
        F.concat(F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), F.concat(F.lit('A & <B> "'), "p_name", F.lit('"')).alias("title"), F.array("p_brand", "p_type").alias("authors"),
        _thirteen(F.col("p_partkey")).alias("isbn"), F.concat(F.lit("Series "), F.col("p_size").cast("string")).alias("series_name"), F.col("p_size").cast("string").alias("series_position"),
    )
    parsed = epub.as_editions(epub.parse_packages(epub.write_packages(rows)))
    return parsed.select(F.substring("source_path", 2, 20).cast("long").alias("p_partkey"), "title", "authors", "isbn", "series_name", "series_position")


def _answer(url: str) -> tuple[int, str]:
    """A stand-in for the services: an ISBN that ends in 0-4 is in the catalogue, in 5-6 with the volumes, in 7-8 nowhere; 9 fails."""
    isbn = re.search(r"[0-9]{13}", url)[0]
    kind = int(isbn[-1])
    if kind == 9:
        return 503, ""
    if "/api/books" in url:
        return 200, json.dumps({f"ISBN:{isbn}": {"title": f"catalogue {isbn}", "publish_date": "1999"}} if kind < 5 else {})
    return 200, json.dumps({"totalItems": 1, "items": [{"volumeInfo": {"title": f"volume {isbn}", "authors": ["A", "B"]}}]} if kind < 7 else {"totalItems": 0})


@query("""
WITH p AS (SELECT p_partkey AS id, lpad(p_partkey::VARCHAR, 13, '0') AS isbn, p_partkey % 10 AS k, CASE WHEN p_size % 2 = 0 THEN p_name END AS title, p_size >= 10 AS due FROM part)
SELECT id, CASE WHEN due THEN coalesce(title, CASE WHEN k < 5 THEN 'catalogue ' || isbn WHEN k < 7 THEN 'volume ' || isbn END) ELSE title END AS title, CASE WHEN due AND k IN (5, 6) THEN 'A, B' END AS authors,
  CASE WHEN due AND k < 5 THEN '1999' END AS publish_date, CASE WHEN due AND k < 7 THEN '2024-05-01T00:00:00Z' END AS enriched_at, CASE WHEN due AND k = 9 THEN 0 ELSE 1 END::BIGINT AS enrichment_attempted FROM p
""")
def enrichment_fallback(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(
        F.col("p_partkey").alias("id"), _thirteen(F.col("p_partkey")).alias("isbn"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("title"),
        (F.col("p_size") < 10).cast("long").alias("enrichment_attempted"), F.col("p_partkey").cast("string").alias("source_path"),
    )
    done = enrich.enrich_editions(_shaped(rows, EDITIONS), spark.createDataFrame([], WORKS), _answer, NOW, "http://catalogue", "http://volumes")[0]
    return done.select("id", "title", "authors", "publish_date", "enriched_at", "enrichment_attempted")


_SEARCH_SQL = """
WITH s AS (SELECT p_partkey, greatest(jaro_winkler_similarity(p_name, 'seel bolt'), jaro_winkler_similarity(p_brand, 'seel bolt'), jaro_winkler_similarity(p_name || ' ' || p_brand, 'seel bolt'),
  list_max(list_transform(string_split(p_name, ' '), lambda w: jaro_winkler_similarity(w, 'seel bolt')))) AS x FROM part)
"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("authors"))
    return search(parts, "seel bolt")


@query(_SEARCH_SQL + "SELECT p_partkey, round(x, 6) AS score FROM s WHERE x >= 0.72")
def fuzzy_search_ranked(spark, sf_dir):
    return _found(spark, sf_dir).select(F.col("id").alias("p_partkey"), F.round("score", 6).alias("score"))


@query(_SEARCH_SQL + "SELECT p_partkey, (row_number() OVER (ORDER BY round(x, 9) DESC, p_partkey) - 1)::INT AS rank FROM s WHERE x >= 0.72 QUALIFY rank < 100")
def search_top(spark, sf_dir):
    # the first 100 of the report, in its order
    top = _found(spark, sf_dir).limit(100).coalesce(1)
    return top.select(F.col("id").alias("p_partkey"), F.monotonically_increasing_id().cast("int").alias("rank"))


@query("""
WITH s AS (SELECT s_suppkey AS k, s_name, s_acctbal < 0 AS held, s_suppkey % 2 = 0 AS even, (SELECT max(s_suppkey) FROM supplier) AS top FROM supplier)
SELECT k AS id, CASE WHEN even AND NOT held THEN 'New ' || s_name ELSE upper(s_name) END AS title, lpad(k::VARCHAR, 13, '0') AS isbn13, 'manual' AS source FROM s
UNION ALL SELECT top + row_number() OVER (ORDER BY k), 'New ' || s_name, NULL, 'text_file' FROM s WHERE NOT even
""")
def import_wants(spark, sf_dir):
    """Every supplier is wanted already; its name in capitals comes in, then a new title with its ISBN or with none."""
    return _imported(spark, sf_dir)[0].select("id", "title", "isbn13", "source")


@query("""
WITH s AS (SELECT s_suppkey AS k, s_acctbal < 0 AS held, s_suppkey % 2 = 0 AS even FROM supplier)
SELECT 2 * k AS line, 'updated' AS status FROM s UNION ALL SELECT 2 * k + 1, CASE WHEN NOT even THEN 'inserted' WHEN held THEN 'skipped_owned' ELSE 'updated' END FROM s
""")
def import_outcome(spark, sf_dir):
    return _imported(spark, sf_dir)[1].select("line", "status")


def _imported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "supplier")
    key, even = F.col("s_suppkey"), F.col("s_suppkey") % 2 == 0
    wants = _shaped(s.select(key.alias("id"), F.col("s_name").alias("title"), _thirteen(key).alias("isbn13")), WANTS)
    held = s.where("s_acctbal < 0").select(key.alias("id"), F.lit("Zz").alias("title"), F.lit("Qq").alias("authors"), _thirteen(key).alias("isbn"), key.cast("string").alias("source_path"))
    none = F.lit(None).cast("string")
    capitals = s.select(F.upper("s_name").alias("title"), none.alias("author"), none.alias("isbn13"), none.alias("source_id"), (key * 2).alias("line"))
    new = s.select(F.concat(F.lit("New "), "s_name").alias("title"), none.alias("author"), F.when(even, _thirteen(key)).alias("isbn13"), none.alias("source_id"), (key * 2 + 1).alias("line"))
    return imports.import_wants(wants, _shaped(held, EDITIONS), capitals.unionByName(new), "text_file", NOW)


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = o_orderkey)")
def delete_rows(spark, sf_dir):
    return maintenance.delete_rows(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("o_orderkey")), "o_orderkey")


@query("SELECT p_partkey, nullif(regexp_replace(p_name || p_size, '[^0-9X]', '', 'g'), '') AS isbn FROM part")
def unwrap_isbn(spark, sf_dir):
    name = F.concat("p_name", F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", text.unwrap_isbn(F.concat(F.lit(" \t="), F.lit('"'), F.regexp_replace(name, "x", ""), F.lit('" '))).alias("isbn"))


@query("SELECT p_partkey, p_name AS title, p_brand AS author FROM part")
def list_line(spark, sf_dir):
    """Lines with a number before them and white space of every kind around them."""
    line = F.concat(F.lit("\t "), F.col("p_size").cast("string"), F.lit(".  "), "p_name", F.lit("  by \t"), "p_brand", F.lit(" 　"))
    return table(spark, sf_dir, "part").select("p_partkey", text.parse_line(line).alias("p")).select("p_partkey", "p.title", "p.author")


def _works(url: str) -> tuple[int, str]:
    """A stand-in for the catalogue: two pages of works for each author; names that begin with A fail."""
    if found := re.search(r"/search/authors.json\?q=(.*)$", url):
        return 200, json.dumps({"docs": [{"key": f"OL-{unquote(found[1])}"}]})
    name, at = re.search(r"/authors/OL-(.*)/works.json.*offset=([0-9]+)", url).groups()
    if name.startswith("A"):
        return 500, ""
    return 200, json.dumps({"entries": [{"title": f"{name} {at}", "key": f"/works/{name}-{at}"}] if int(at) < 100 else []})


@query("SELECT n_name || ' ' || k AS title, n_name AS author, '/works/' || n_name || '-' || k AS source_id FROM nation, (VALUES ('0'), ('50')) v(k) WHERE n_name NOT LIKE 'A%'")
def follow_sync(spark, sf_dir):
    authors = _shaped(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), AUTHORS)
    return follow.sync_authors(authors, _works, NOW, "http://catalogue")[1].select("title", "author", "source_id")


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN min(o_orderkey) OVER (PARTITION BY o_orderkey % 4 <> 0, o_custkey) END AS first_id FROM orders
""")
def link_works(spark, sf_dir):
    """Editions of one ISBN share a work; those without an ISBN and a title stay unlinked."""
    linked = works.link_works(_orders_as_editions(spark, sf_dir), spark.createDataFrame([], WORKS), NOW)[0]
    first = linked.where("work_id is not null").groupBy("work_id").agg(F.min("id").alias("first_id"))
    return linked.select("id", "work_id").join(first, "work_id", "left").select("id", "first_id")


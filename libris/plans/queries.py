"""Queries that apply each operator to the driver's tables, and DuckDB's SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from libris import report
from libris.functions import text
from libris.functions.similarity import book_similarity, near_strings, similar_pairs
from libris.operators import maintenance, ownership, series, works
from libris.plans.registry import ORACLE, QUERIES, query, table
from libris.sources.http import first

@query("""
SELECT l_orderkey, unnest(generate_series(lo, hi)) AS missing FROM (
  SELECT l_orderkey, (l_linenumber + 1)::BIGINT AS lo, (lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1)::BIGINT AS hi FROM lineitem) WHERE lo <= hi
""")
def series_gaps(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("double").alias("number"))
    return series.gaps(rows, "l_orderkey", "number")


@query("""
SELECT series, unnest(generate_series(lo, hi)) AS missing FROM (
  SELECT series, (p_size + 1)::BIGINT AS lo, (lead(p_size) OVER (PARTITION BY series ORDER BY p_size) - 1)::BIGINT AS hi
  FROM (SELECT p_brand || '/' || p_type AS series, p_size FROM part)) WHERE lo <= hi
""")
def series_gaps_sparse(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("series"), F.col("p_size").cast("double").alias("number"))
    return series.gaps(rows, "series", "number")


def _part_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as owned editions: brand and type make the series, the size the position; a size of 50 is no number."""
    position = F.when(F.col("p_size") == 50, "last").otherwise(F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(F.lit(1).cast("long").alias("owned"), F.concat_ws("/", "p_brand", "p_type").alias("series_name"), F.when(F.col("p_size") > 1, position).alias("series_position"))


@query("""
WITH e AS (SELECT p_brand || '/' || p_type AS series_name, CASE WHEN p_size = 50 THEN 'last' WHEN p_size > 1 THEN p_size::VARCHAR END AS pos FROM part),
s AS (SELECT series_name, count(pos) = 0 OR count(*) FILTER (pos = 'last') > 0 AS non_numeric FROM e GROUP BY series_name),
g AS (SELECT e.*, non_numeric, CASE WHEN NOT non_numeric THEN pos::DOUBLE END AS num FROM e JOIN s USING (series_name) WHERE pos IS NOT NULL),
m AS (SELECT series_name, unnest(generate_series(num::BIGINT + 1, nx::BIGINT - 1)) AS k FROM
  (SELECT *, lead(num) OVER (PARTITION BY series_name ORDER BY num) AS nx FROM g WHERE NOT non_numeric) WHERE nx - num > 1.5),
a AS (SELECT series_name, non_numeric, pos AS position, true AS owned, num FROM g UNION ALL SELECT series_name, false, k::VARCHAR, false, k::DOUBLE FROM m)
SELECT series_name, non_numeric, position, owned, (row_number() OVER (PARTITION BY series_name ORDER BY num, position))::INT AS place FROM a
UNION ALL SELECT s.series_name, true, NULL, NULL, 1 FROM s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.series_name = s.series_name)
""")
def series_entries(spark, sf_dir):
    return series.series_entries(_part_editions(spark, sf_dir))


@query("""
WITH e AS (SELECT p_brand || '/' || p_type AS series_name, CASE WHEN p_size = 50 THEN 'last' WHEN p_size > 1 THEN p_size::VARCHAR END AS pos FROM part),
s AS (SELECT series_name, count(pos) = 0 OR count(*) FILTER (pos = 'last') > 0 AS non_numeric FROM e GROUP BY series_name),
g AS (SELECT e.*, non_numeric, CASE WHEN NOT non_numeric THEN pos::DOUBLE END AS num FROM e JOIN s USING (series_name) WHERE pos IS NOT NULL),
m AS (SELECT series_name, unnest(generate_series(num::BIGINT + 1, nx::BIGINT - 1)) AS k FROM
  (SELECT *, lead(num) OVER (PARTITION BY series_name ORDER BY num) AS nx FROM g WHERE NOT non_numeric) WHERE nx - num > 1.5),
a AS (SELECT series_name, pos AS position, true AS owned, num FROM g UNION ALL SELECT series_name, k::VARCHAR, false, k::DOUBLE FROM m)
SELECT s.series_name, s.non_numeric, count(a.position) AS n_entries, count(*) FILTER (NOT a.owned) AS n_missing, coalesce(string_agg(a.position, ',' ORDER BY a.num, a.position), '') AS positions
FROM s LEFT JOIN a ON a.series_name = s.series_name GROUP BY s.series_name, s.non_numeric
""")
def series_views_nested(spark, sf_dir):
    views = series.series_views(_part_editions(spark, sf_dir))
    missing = F.size(F.filter("entries", lambda e: ~e["owned"])).cast("long")
    return views.select("series_name", "non_numeric", F.size("entries").cast("long").alias("n_entries"), missing.alias("n_missing"), F.array_join(F.col("entries.position"), ",").alias("positions"))


@query("""
WITH n AS (SELECT DISTINCT p_name FROM part)
SELECT a.p_name AS a_name, b.p_name AS b_name, round(jaro_winkler_similarity(a.p_name, b.p_name), 6) AS score
FROM n a JOIN n b ON a.p_name < b.p_name WHERE jaro_winkler_similarity(a.p_name, b.p_name) >= 0.85
""")
def fuzzy_self_join(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name")
    return near_strings(names, names).where("left < right").select(F.col("left").alias("a_name"), F.col("right").alias("b_name"), F.round("score", 6).alias("score"))


@query("""
WITH n AS (SELECT DISTINCT p_name AS t, p_brand AS a FROM part), s AS (
  SELECT x.t AS a_title, x.a AS a_author, y.t AS b_title, y.a AS b_author, greatest(jaro_winkler_similarity(x.t || ' ' || x.a, y.t || ' ' || y.a),
    CASE WHEN jaro_winkler_similarity(x.a, y.a) > 0.9 THEN jaro_winkler_similarity(x.t, y.t) ELSE 0 END) AS score
  FROM n x JOIN n y ON (x.t, x.a) < (y.t, y.a))
SELECT a_title, a_author, b_title, b_author, round(score, 6) AS score FROM s WHERE score >= 0.85
""")
def book_similarity_pairs(spark, sf_dir):
    books = table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), F.col("p_brand").alias("author"))
    p = similar_pairs(books, books).where("struct(left_title, left_author) < struct(right_title, right_author)")
    return p.select(F.col("left_title").alias("a_title"), F.col("left_author").alias("a_author"), F.col("right_title").alias("b_title"), F.col("right_author").alias("b_author"), F.round("score", 6).alias("score"))


@query("SELECT c_custkey, translate(regexp_replace(c_name || 'x', '[^0-9Xx]', '', 'g'), 'x', 'X') AS code FROM customer")
def normalize_code(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.normalize_isbn(F.concat("c_name", F.lit("x"))).alias("code"))


@query("""
WITH t AS (SELECT p_partkey, lpad(p_partkey::VARCHAR, 10, '0') AS s FROM part), b AS (SELECT p_partkey, '978' || substr(s, 1, 9) AS b FROM t)
SELECT p_partkey, b || ((10 - list_sum(list_transform(generate_series(1, 12), lambda i: substr(b, i::INT, 1)::INT * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10)::VARCHAR AS isbn13 FROM b
""")
def isbn10_to_13(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.isbn10_to_13(F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("isbn13"))


@query("SELECT doc_id, length(regexp_replace(text, '[^0-9]', '', 'g')) IN (10, 13) AS looks FROM documents")
def looks_like_code(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.looks_like_isbn("text").alias("looks"))


@query("""
SELECT p_partkey, regexp_extract(l, '^(.*) by (.*)$', 1) AS title, regexp_extract(l, '^(.*) by (.*)$', 2) AS author
FROM (SELECT p_partkey, p_name || ' by ' || p_type || ' by ' || p_brand AS l FROM part)
""")
def split_last_delimiter(spark, sf_dir):
    line = F.concat_ws(" by ", "p_name", "p_type", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", text.parse_line(line).alias("p")).select("p_partkey", "p.title", "p.author")


@query("SELECT p_partkey, p_name AS rest FROM part")
def number_prefix_strip(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.strip_number_prefix(F.concat(F.col("p_size").cast("string"), F.lit(") "), F.col("p_name"))).alias("rest"))


@query("""
WITH held AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
new AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM held) GROUP BY 1)
SELECT * FROM held UNION ALL SELECT * FROM new
""")
def insert_or_ignore(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    held = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")).withColumn("id", F.col("o_custkey"))
    return maintenance.insert_or_ignore(held, orders, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@query("""
SELECT d.doc_id, coalesce(nullif(d.lang, 'en'), CASE WHEN l.doc_id IS NOT NULL THEN 'labelled' END) AS lang, CASE WHEN l.doc_id IS NOT NULL THEN l.quality::BIGINT ELSE d.n_chars END AS n
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def coalesce_update(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.col("lang"), F.lit("en")).alias("lang"), F.col("n_chars").alias("n"))
    updates = table(spark, sf_dir, "labels").select("doc_id", F.lit("labelled").alias("lang"), F.col("quality").cast("long").alias("n"))
    return maintenance.coalesce_update(docs, updates, "doc_id", fill=("lang",), overwrite=("n",))


@query("""
WITH w AS (SELECT s_suppkey AS id, s_nationkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS keep FROM supplier)
SELECT l.l_orderkey, l.l_linenumber, w.keep AS work_id FROM lineitem l JOIN w ON w.id = l.l_suppkey
""")
def merge_by_key(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    made = suppliers.select(F.col("s_suppkey").alias("id"), F.lit(None).cast("string").alias("openlibrary_work_id"))
    keys = suppliers.select(F.col("s_suppkey").alias("work_id"), F.col("s_nationkey").cast("string").alias("openlibrary_work_id"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("work_id"))
    return maintenance.merge_by_key(made, items, keys)[1]


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1
""")
def first_match_per_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return maintenance.first_per_key(orders, ["o_custkey"], F.desc("o_totalprice"), "o_orderkey")


@query("""
SELECT o_orderkey, first_value(nullif(o_custkey % 3, 0) IGNORE NULLS) OVER (PARTITION BY o_custkey % 1000 ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_work_id FROM orders
""")
def first_work_by_isbn(spark, sf_dir):
    key = F.col("o_custkey")
    editions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (key % 1000).alias("isbn"), F.nullif(key % 3, F.lit(0)).cast("long").alias("work_id"))
    return works.first_work_by_isbn(editions).select(F.col("id").alias("o_orderkey"), "first_work_id")


def _catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as wants; suppliers, and parts again, as editions, of which some are owned."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    thirteen = lambda c: F.lpad(F.col(c).cast("string"), 13, "0")
    wants = part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 5, F.col("p_brand")).alias("author"), F.when(F.col("p_size") != 9, thirteen("p_partkey")).alias("isbn13"),
        F.lit("manual").alias("source"), (F.col("p_size") % 10 + 1).cast("long").alias("priority"), F.lit(None).cast("string").alias("notes"),
    )
    by_isbn = supplier.select(F.col("s_name").alias("title"), F.lit("n/a").alias("authors"), thirteen("s_suppkey").alias("isbn"), F.col("s_nationkey").cast("long").alias("work_id"), (F.col("s_acctbal") > 0).cast("long").alias("owned"))
    by_name = part.select(F.concat("p_name", F.lit(" (new)")).alias("title"), F.col("p_brand").alias("authors"), F.lit(None).cast("string").alias("isbn"), F.lit(None).cast("long").alias("work_id"), (F.col("p_size") >= 49).cast("long").alias("owned"))
    return wants, by_isbn.unionByName(by_name)


_CATALOGUE_SQL = """
WITH w AS (SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size > 5 THEN p_brand END AS author, CASE WHEN p_size <> 9 THEN lpad(p_partkey::VARCHAR, 13, '0') END AS isbn13, (p_size % 10 + 1)::BIGINT AS priority FROM part),
e AS (SELECT s_name AS title, 'n/a' AS authors, lpad(s_suppkey::VARCHAR, 13, '0') AS isbn, s_nationkey AS work_id, s_acctbal > 0 AS owned FROM supplier
  UNION ALL SELECT p_name || ' (new)', p_brand, NULL, NULL, p_size >= 49 FROM part),
b AS (SELECT DISTINCT title, authors FROM e WHERE owned), k AS (SELECT DISTINCT title, author FROM w WHERE author IS NOT NULL),
s AS (SELECT DISTINCT k.title, k.author FROM k, b WHERE greatest(jaro_winkler_similarity(k.title || ' ' || k.author, b.title || ' ' || b.authors),
  CASE WHEN jaro_winkler_similarity(k.author, b.authors) > 0.9 THEN jaro_winkler_similarity(k.title, b.title) ELSE 0 END) >= 0.85)
"""


_MISSING = """
SELECT title, author, isbn13, priority, 'manual' AS source, NULL::VARCHAR AS notes FROM w
WHERE NOT EXISTS (SELECT 1 FROM e WHERE owned AND e.isbn = w.isbn13) AND NOT EXISTS (SELECT 1 FROM s WHERE s.title = w.title AND s.author = w.author)
"""


@query(_CATALOGUE_SQL + _MISSING)
def grab_list(spark, sf_dir):
    return ownership.grab_list(*_catalogue(spark, sf_dir))


@query(_CATALOGUE_SQL + _MISSING + " AND priority >= 8")
def grab_min_priority(spark, sf_dir):
    return ownership.grab_list(*_catalogue(spark, sf_dir), min_priority=8)


@query(
    _CATALOGUE_SQL
    + ", m AS ("
    + _MISSING
    + """), r AS (SELECT *, row_number() OVER (ORDER BY priority DESC, lower(title)) AS rank FROM m)
SELECT priority, lower(title) AS title, (rank - 1)::INT AS rank FROM r WHERE rank <= 100
"""
)
def grab_top(spark, sf_dir):
    # the first 100 of the list, in its order
    top = ownership.grab_list(*_catalogue(spark, sf_dir)).limit(100).coalesce(1)
    return top.select("priority", F.lower("title").alias("title"), F.monotonically_increasing_id().cast("int").alias("rank"))


@query(
    _CATALOGUE_SQL
    + """
SELECT id FROM w WHERE EXISTS (SELECT 1 FROM e WHERE owned AND e.isbn = w.isbn13) OR EXISTS (SELECT 1 FROM s WHERE s.title = w.title AND s.author = w.author)
  OR EXISTS (SELECT 1 FROM e x WHERE x.isbn = w.isbn13 AND EXISTS (SELECT 1 FROM e y WHERE y.owned AND y.work_id = x.work_id))
"""
)
def owned_on_import(spark, sf_dir):
    return ownership.owned_on_import(*_catalogue(spark, sf_dir))


@query(_CATALOGUE_SQL + "SELECT id FROM w WHERE EXISTS (SELECT 1 FROM e x WHERE x.isbn = w.isbn13 AND EXISTS (SELECT 1 FROM e y WHERE y.owned AND y.work_id = x.work_id))")
def owned_by_work_on_import(spark, sf_dir):
    return ownership.owned_by_work_on_import(*_catalogue(spark, sf_dir))


@query(_CATALOGUE_SQL + "SELECT id FROM w WHERE EXISTS (SELECT 1 FROM e WHERE owned AND work_id IS NOT NULL AND e.isbn = w.isbn13)")
def owned_by_work_on_grab(spark, sf_dir):
    return ownership.owned_by_work_on_grab(*_catalogue(spark, sf_dir))


@query(_CATALOGUE_SQL + "SELECT count(*) AS grab_count FROM w WHERE NOT EXISTS (SELECT 1 FROM e WHERE owned AND e.isbn = w.isbn13)")
def stats_grab_count(spark, sf_dir):
    return ownership.missing_by_isbn(*_catalogue(spark, sf_dir)).agg(F.count("*").alias("grab_count"))


@query("SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda w: length(w) > 4)[1] AS word FROM part")
def array_first_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", first(F.filter(F.split("p_name", " "), lambda w: F.length(w) > 4)).alias("word"))


@query("""
SELECT doc_id, doc_id::VARCHAR || ',' || source || ',' || CASE WHEN regexp_matches(text, '[",\r\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS line FROM documents
""")
def report_csv_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", report.csv_line("doc_id", "source", "text").alias("line"))


@query("SELECT page_id, replace(replace(replace(url, '%', '%25'), ':', '%3A'), '/', '%2F') AS encoded FROM (SELECT page_id, regexp_replace(url, '[^a-z0-9:/.-]', '', 'g') AS url FROM pages)")
def url_encode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.url_encode(F.regexp_replace("url", "[^a-z0-9:/.-]", "")).alias("encoded"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def timestamp_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.iso_utc(F.col("ts")).alias("at"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN (p_size // 2)::VARCHAR ELSE (p_size // 2)::VARCHAR || '.5' END AS position FROM part")
def position_text(spark, sf_dir):
    half = F.col("p_size") / 2
    return table(spark, sf_dir, "part").select("p_partkey", text.format_position(text.position_number(half.cast("string"))).alias("position"))


@query("""
SELECT a.p_partkey, round(greatest(jaro_winkler_similarity(a.p_name || ' ' || a.p_brand, n_name || ' ' || 'Brand#12'),
  CASE WHEN jaro_winkler_similarity(a.p_brand, 'Brand#12') > 0.9 THEN jaro_winkler_similarity(a.p_name, n_name) ELSE 0 END), 6) AS score FROM part a JOIN nation ON n_nationkey = a.p_size % 25
""")
def book_similarity_score(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("n_nationkey", F.col("p_size") % 25)
    both = part.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int"), "n_name"), "n_nationkey")
    return both.select("p_partkey", F.round(book_similarity("p_name", "p_brand", "n_name", F.lit("Brand#12")), 6).alias("score"))


from libris.plans import command_queries  # noqa: E402, F401  registers its queries too

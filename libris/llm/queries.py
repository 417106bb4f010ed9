"""The ``opN_*`` queries: each operator with production parameters on its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from libris.llm.ann import nearest
from libris.llm.bpe import decoded, encoded
from libris.llm.common import checkpointed, deleted, shared_folder, table
from libris.llm.line_dedup import dedup_lines
from libris.llm.media import image_features, stored_text
from libris.llm.packing import pack, pieces, token_counts
from libris.llm.simhash import near_duplicates
from libris.llm.substring_dedup import dedup_substrings
from libris.llm.token_counts import Rollup, byte_bpe_counts
from libris.llm.toxicity import held_out, toxicity, train
from libris.llm.url_filter import filter_urls, rules

#: The rules for pages.
URL_RULES = """
allow com/
block example.com/en/
allow www.example.com/en/
block net/es/
block net/fr/
"""


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules(URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict", "probability")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after batches of changes, two of which arrive twice: documents come in with a guess, the guess
    is revised to the count, documents without a token go and come in again, so all documents count."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    versions = {
        "byte_bpe_50k": byte_bpe_counts("text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
        "word_bpe_49k": token_counts("text", public_tokenizers.path("word_bpe_49k.json")),
    }
    lengths = docs.select("source", "lang", F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4).cast("long").alias("guess"), *[c.alias(v) for v, c in versions.items()])
    each = checkpointed(lengths).select("source", "lang", "guess", F.inline(F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(v).alias("tokens")) for v in versions])))
    none = {"old_source": F.lit(None).cast("string"), "old_lang": F.lit(None).cast("string"), "old_tokens": F.lit(None).cast("long")}
    loaded = each.withColumns({"change": F.lit("insert"), "tokens": F.col("guess"), **none})
    revised = each.withColumns({"change": F.lit("revise"), "old_source": F.col("source"), "old_lang": F.col("lang"), "old_tokens": F.col("guess")})
    empty = each.where("tokens = 0").withColumns(none)
    gone, back = empty.withColumn("change", F.lit("delete")), empty.withColumn("change", F.lit("insert"))
    rollup = Rollup(spark, f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}")
    for name, batch in (("load", loaded), ("revise", revised), ("gone", gone), ("back", back), ("load", loaded), ("revise", revised)):
        rollup.commit(name, batch)
    totals = checkpointed(rollup.totals())
    deleted(spark, rollup.folder)
    return totals


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_sentences", "n_removed")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ids = table(spark, sf_dir, "documents").select("doc_id", encoded("text", path, pattern).alias("ids"))
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(decoded("ids", path), 256).alias("decoded_sha256"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), toxicity("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """Places of all pieces of ``docs``; the ids themselves don't move, only their checksums."""
    import public_tokenizers

    cut = pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    placed = pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), stored_text("text").alias("media"))
    read = stored.withColumn("read", image_features("media"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("read.payload").cast("long").alias("payload_bytes"),
        F.sha2("read.payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("read.payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "read.width", "read.height"), "read.thumbnail_dhash", "read.thumbnail_xxh64").alias("feature"),
    )


#: DuckDB: windows by text instead of digest, later occurrences by row number.
OP2_SQL = r"""
WITH line AS (
  SELECT doc_id, i, x, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM documents WHERE text IS NOT NULL)
), shingle AS (
  SELECT doc_id, i AS a, lead(i, 2) OVER w AS b, bare || chr(10) || lead(bare, 1) OVER w || chr(10) || lead(bare, 2) OVER w AS t
  FROM line WHERE bare <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), later AS (
  SELECT doc_id, a, b FROM shingle WHERE b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, a) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(a, b)) AS i FROM later
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, max(l.i) AS last_line, max(l.i) FILTER (g.i IS NULL) AS last_kept,
         string_agg(l.x, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS joined
  FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL WHEN last_kept < last_line THEN joined || chr(10) ELSE coalesce(joined, '') END AS text,
       coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

#: DuckDB: words as rows, cut to sentences by window functions; runs by text instead of digest.
OP6_SQL = r"""
WITH token AS (
  SELECT doc_id, unnest(tokens) AS x, generate_subscripts(tokens, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*') AS tokens FROM documents WHERE text IS NOT NULL)
), word AS (
  SELECT doc_id, i, x, regexp_extract(x, '^[^ \t\n\x0b\f\r]+') AS w, i = max(i) OVER (PARTITION BY doc_id) AS ends_text FROM token
), stopped AS (
  SELECT *, (ends_text OR contains('.!?', right(w, 1)) OR contains(x, chr(10)))::INT AS stops FROM word
), numbered AS (
  SELECT *, sum(stops) OVER (PARTITION BY doc_id ORDER BY i) - stops AS s FROM stopped
), measured AS (
  SELECT *, (stops = 1 AND (ends_text OR count(*) OVER (PARTITION BY doc_id, s) >= 5))::INT AS ends FROM numbered
), grouped AS (
  SELECT *, sum(ends) OVER (PARTITION BY doc_id ORDER BY i) - ends AS g FROM measured
), parted AS (
  SELECT *, (count(*) OVER (PARTITION BY doc_id, g) - row_number() OVER (PARTITION BY doc_id, g ORDER BY i)) // 12 AS p FROM grouped
), piece AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS u, string_agg(x, '' ORDER BY i) AS piece, string_agg(w, ' ' ORDER BY i) AS bare
  FROM parted GROUP BY doc_id, g, p
), run AS (
  SELECT doc_id, u, bare || ' ' || lead(bare, 1) OVER w || ' ' || lead(bare, 2) OVER w AS t FROM piece WINDOW w AS (PARTITION BY doc_id ORDER BY u)
), later AS (
  SELECT doc_id, u FROM run WHERE t IS NOT NULL QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, u) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(u, u + 2)) AS u FROM later
), kept AS (
  SELECT p.doc_id, count(*) AS n_sentences, count(g.u) AS n_removed, bool_or(p.u = 1 AND g.u IS NULL) AS has_first,
         string_agg(p.piece, '' ORDER BY p.u) FILTER (g.u IS NULL) AS joined
  FROM piece p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.u = g.u GROUP BY p.doc_id
)
SELECT d.doc_id, CASE WHEN k.doc_id IS NULL THEN d.text ELSE CASE WHEN has_first THEN regexp_extract(d.text, '^[ \t\n\x0b\f\r]*') ELSE '' END || coalesce(joined, '') END AS text,
       coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules alone decide of :func:`op4_url_filter`."""
    judged = op4_url_filter(spark, sf_dir)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What :func:`op7_bpe` decodes."""
    return op7_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def packing_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's pieces of :func:`op9_packing` are the whole of it, and whether its sequences keep to the capacity."""
    placed = op9_packing(spark, sf_dir)
    full = placed.groupBy("sequence_id").agg(F.sum("length").alias("ids"), F.max(F.col("offset") + F.col("length")).alias("end"))
    fits = placed.join(full.select("sequence_id", ((F.col("ids") <= 4096) & (F.col("ids") == F.col("end"))).alias("fits")), "sequence_id")
    return fits.groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("whole"), F.bool_and("fits").alias("fits"))


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What :func:`op10_media` reads back."""
    return op10_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


#: DuckDB: the five rules, the longest first.
URL_RULES_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
r AS (SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/' WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM p)
SELECT *, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict FROM r
"""

MEDIA_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
p AS (SELECT doc_id, t, n, greatest(192, (n + 191) // 192 * 192)::BIGINT AS m FROM d)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(t || repeat(' ', m - n)) AS payload_sha256 FROM p
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_ann": op3_ann,
    "op4_url_filter": op4_url_filter,
    "op5_token_counts": op5_token_counts,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_bpe": op7_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_media": op10_media,
    "url_rules": url_rules,
    "bpe_round_trip": bpe_round_trip,
    "packing_whole": packing_whole,
    "media_payload": media_payload,
}

ORACLE: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op6_substring_dedup": OP6_SQL,
    "url_rules": URL_RULES_SQL,
    "bpe_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "packing_whole": "SELECT doc_id, true AS whole, true AS fits FROM documents",
    "media_payload": MEDIA_SQL,
}

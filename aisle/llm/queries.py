"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from itertools import permutations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from aisle.llm import (
    bpe, filter_audit, hard_negatives, jaccard, lines, lm_score, media, packing, quality, sharding, sketches, token_counts,
    vectors,
)
from aisle.llm.registry import query, table


@query("op3_bestfit_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_rendezvous_shards")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"), 24)


@query("op10_byte_bpe")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(table(spark, folder, "documents"), path, pattern)


_BLANKS = r"[\x20\x09-\x0D]"
_ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op8_line_dedup", f"""
WITH line AS (
  SELECT doc_id, pos, line,
         regexp_replace({_ASCII_LOWER.format("line")}, '^{_BLANKS}+|{_BLANKS}+$', '', 'g') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM line WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR keeper = doc_id), ''))
         AS kept_sha256
FROM line LEFT JOIN repeated USING (key) GROUP BY doc_id
""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op1_token_counts")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(
        table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_quality_pu")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = quality.score(docs, quality.learn(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", quality.in_fold(F.col("doc_id"), 5).alias("held_out"), "score", "predicted")


@query("op4_lattice_score")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.score_documents(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op2_embedding_neardup", """
WITH RECURSIVE unit AS (
  SELECT vec_id, label, embedding::DOUBLE[64] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE array_cosine_similarity(a.v, b.v) >= 0.98
),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
)
SELECT vec_id, (SELECT count(*) FROM link WHERE link.a = vec_id) AS n_links, component_id,
       vec_id = component_id AS kept
FROM (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


def jaccard_sql(documents: str, words: int, percent: int) -> str:
    """doc_id, n_shingles and component_id of a table, for DuckDB (with recursion)."""
    return f"""
  word AS (
    SELECT doc_id, list_filter(regexp_split_to_array({_ASCII_LOWER.format("coalesce(text, '')")}, '{_BLANKS}+'),
                               lambda x: x <> '') AS w FROM {documents}
  ),
  shingle AS (
    SELECT DISTINCT doc_id, s FROM (
      SELECT doc_id, unnest(CASE WHEN len(w) >= {words}
        THEN list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i : i + {words} - 1], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM word)
  ),
  size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
  link AS (
    SELECT a, b FROM (
      SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
      FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id)
    JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
    WHERE 100 * common >= {percent} * (p.n + q.n - common)
  ),
  reach AS (
    SELECT doc_id AS a, doc_id AS b FROM {documents}
    UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
  ),
  class AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
"""


@query("op7_jaccard_join", f"""
WITH RECURSIVE {jaccard_sql("documents", 4, 85)}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM class LEFT JOIN size USING (doc_id)
""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, folder, "documents"), words=4, percent=85)


@query("op5_chroma_fingerprints")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings made of all vectors; those whose id is divisible by 50 are the queries, and each has a row."""
    prints = media.fingerprints(media.recordings(table(spark, folder, "embeddings")))
    queries = table(spark, folder, "embeddings").where("vec_id % 50 = 0").selectExpr("vec_id AS id")
    classes, members = media.sounds(prints)
    return media.summary(queries, classes, members, media.align(queries, classes, members))


@query("op12_filter_audit", f"""
WITH word AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANKS}+'), lambda x: x <> '') AS w FROM documents
),
fact AS (
  SELECT doc_id, part,
         [len(w) < 200,
          100 * len(list_distinct(w)) < 50 * len(w),
          100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 3 * length(body),
          regexp_matches(body, '[#$%&*|]'),
          doc_id > min(doc_id) OVER (PARTITION BY body)] AS fails,
         coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM word LEFT JOIN labels USING (doc_id)
),
filter AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS path
  FROM filter a, filter b, filter c, filter d, filter e
  WHERE a.f <> b.f AND a.f <> c.f AND a.f <> d.f AND a.f <> e.f AND b.f <> c.f AND b.f <> d.f AND b.f <> e.f
    AND c.f <> d.f AND c.f <> e.f AND d.f <> e.f
),
step AS (SELECT path, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
met AS (
  SELECT part, path, step, path[step] AS f, fails[path[step]] AS failing, good, toxic,
         len(list_filter(path[:step - 1], lambda x: fails[x])) > 0 AS earlier,
         len(list_filter(fails, lambda x: x)) = 1 AS single
  FROM fact, step
),
counted AS (
  SELECT part, path, step, f,
         count(*) FILTER (NOT earlier AND NOT failing) AS kept,
         count(*) FILTER (NOT earlier AND failing) AS removed,
         count(*) FILTER (earlier AND failing) AS redundant,
         count(*) FILTER (failing AND single) AS unique_fails,
         count(*) FILTER (NOT earlier AND failing AND good) AS good_lost,
         count(*) FILTER (NOT earlier AND failing AND toxic) AS toxic_lost
  FROM met GROUP BY ALL
)
SELECT part, array_to_string(list_transform(path, lambda x: chr(64 + x::INTEGER)), '') AS filter_order, step, kept,
       removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    orders = ["".join(p) for p in permutations("ABCDE")]
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"),
                              filter_audit.text_filters(), orders, copies="E")


@query("op13_hard_negatives", """
WITH taken AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM taken a JOIN taken b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0
),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Every vec_id divisible by 7 gets the next label, so that some labels are wrong."""
    rows = hard_negatives.quantised(table(spark, folder, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def _sketch_sql(table: str) -> str:
    """doc_id, hashes in order, limit, sketch and number of shingles of a table with doc_id and text, for DuckDB."""
    return f"""
  {table}_word AS (
    SELECT doc_id, list_filter(regexp_split_to_array({_ASCII_LOWER.format("text")}, '{_BLANKS}+'),
                               lambda x: x <> '') AS w FROM {table}
  ),
  {table}_hash AS (
    SELECT doc_id, list_sort(list_distinct(list_transform(
      CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END, lambda x: md5(x)[:15]))) AS h
    FROM {table}_word
  ),
  {table}_limit AS (
    SELECT doc_id, h, CASE WHEN len(h) <= 32 THEN 'fffffffffffffff' ELSE greatest('0ffffffffffffff', h[32]) END AS top
    FROM {table}_hash
  ),
  {table}_sketch AS (SELECT doc_id, top, list_filter(h, lambda x: x <= top) AS s, len(h) AS n FROM {table}_limit)
"""


def _likeness_sql(a: str, b: str) -> str:
    low, common = f"least({a}.top, {b}.top)", "len(list_intersect({0}, {1}))"
    x, y = (f"list_filter({t}.s, lambda x: x <= {low})" for t in (a, b))
    both = common.format(x, y)
    return f"""coalesce({both}::DOUBLE / nullif(len({x}) + len({y}) - {both}, 0), 1.0)"""


@query("op11_scaled_sketch", f"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS many
  FROM documents
),
edit AS (
  SELECT d.doc_id, e.doc_id AS next_id, length(d.text) AS n_chars,
         left(d.text, length(d.text) - length(d.text) // 4) || left(e.text, length(d.text) // 4) AS text
  FROM doc d JOIN doc e ON e.place = (d.place + 1) % d.many
),
{_sketch_sql("doc")},
{_sketch_sql("edit")}
SELECT doc_id, n_chars, sha256(edit.text) AS edited_sha256,
       a.top || ':' || array_to_string(a.s, '') AS fingerprint,
       b.top || ':' || array_to_string(b.s, '') AS edited_fingerprint,
       {_likeness_sql("a", "b")} AS near_edited, {_likeness_sql("a", "c")} AS near_next, a.n AS n_shingles
FROM edit JOIN doc_sketch a USING (doc_id) JOIN edit_sketch b USING (doc_id) JOIN doc_sketch c ON c.doc_id = next_id
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.compare_edits(table(spark, folder, "documents"))

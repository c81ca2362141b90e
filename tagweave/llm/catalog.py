"""Registered queries of the text operators, and their DuckDB SQL where SQL can express them.

Every query applies its operator, with its production parameters, to the whole of its tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (collocations, convtrie, decontaminate, licenses, linedup, neardup, packing, pii, quality, substring, topk,
               toxicity, urlfilter)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark, sf_dir):
    return topk.report(_table(spark, sf_dir, "embeddings"))


def op2_decontaminate(spark, sf_dir):
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_pii(spark, sf_dir):
    return pii.report(_table(spark, sf_dir, "documents"), pii.run_key(spark))


def op4_line_dedup(spark, sf_dir):
    return linedup.report(_table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark, sf_dir):
    return neardup.report(_table(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_packing(spark, sf_dir):
    return packing.report(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark, sf_dir):
    return substring.report(_table(spark, sf_dir, "documents")).drop("spans", "factors")


def op9_licenses(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_collocations(spark, sf_dir):
    return collocations.report(_table(spark, sf_dir, "documents"))


def op12_url_filter(spark, sf_dir):
    return urlfilter.report(_table(spark, sf_dir, "pages"))


def op13_conversation_trie(spark, sf_dir):
    return convtrie.report(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_topk, op2_decontaminate, op3_pii, op4_line_dedup, op5_near_duplicates, op6_quality, op7_packing,
    op8_substring_dedup, op9_licenses, op10_toxicity, op11_collocations, op12_url_filter, op13_conversation_trie)}

_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

SQL = {
    "op1_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op2_decontaminate": f"""
WITH item AS (
  SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i
        FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
place AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, win.n FROM place JOIN win ON place.n = win.n AND place.k = win.k),
words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
""",
    "op8_substring_dedup": r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM doc WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM doc),
kept AS (
  SELECT word.doc_id AS doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY word.p) AS t
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p
  WHERE gone.p IS NULL GROUP BY word.doc_id)
SELECT doc.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
""",
    "op11_collocations": r"""
WITH doc AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
piece AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM doc)),
gram AS (
  SELECT lang, w[i:i + n - 1] AS g
  FROM (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM piece, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(w) >= n)),
f AS MATERIALIZED (SELECT lang, g, count(*) AS f FROM gram GROUP BY lang, g),
total AS (SELECT lang, sum(f) AS n FROM f WHERE len(g) = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= 30),
inner_phrase AS (
  SELECT lang, g[i:i + n - 1] AS g, max(a) AS longer
  FROM (SELECT lang, g, a, n, unnest(range(1, len(g) - n + 2)) AS i
        FROM cand, (SELECT unnest([2, 3]) AS n) WHERE len(g) > n) GROUP BY ALL),
cut AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM cand),
score AS (
  SELECT cut.lang, cut.g, a, k, l.f AS l, r.f AS r, (CAST(2000000 AS HUGEINT) * a) // (l.f + r.f) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.g = cut.g[1:k] JOIN f r ON r.lang = cut.lang AND r.g = cut.g[k + 1:]),
best AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.g, ' ')) AS rank,
    array_to_string(b.g, ' ') AS phrase, a, l, r, score
  FROM best b LEFT JOIN inner_phrase i ON i.lang = b.lang AND i.g = b.g
  WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
""",
    "op13_conversation_trie": r"""
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
opening AS (
  -- h: crc32 of the decimal conv_id, bit by bit, modulo 4
  SELECT conv_id, t, xor(list_reduce(list_concat([4294967295], flatten(list_transform(
      string_split(CAST(conv_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda j: (ascii(c) >> j) & 1)))),
    lambda a, b: xor(a >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 4 AS h
  FROM own),
seq AS (
  SELECT o.conv_id, list_concat(coalesce(b.t, [])[1:o.h], o.t[o.h + 1:]) AS s
  FROM opening o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
pre AS (
  SELECT conv_id, d, len(s) = d AS ends, s[1:d] AS p
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seq)),
node AS MATERIALIZED (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids
  FROM pre GROUP BY d, p),
kid AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS kids FROM node WHERE d > 0 GROUP BY ALL),
full_node AS MATERIALIZED (
  SELECT node.*, coalesce(kids, 0) AS kids,
    CASE WHEN node.d = 0 THEN 0 ELSE (n - 1) * len(regexp_extract_all(node.p[node.d].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM node LEFT JOIN kid ON kid.d = node.d AND kid.p = node.p),
up AS (SELECT p[1:k] AS p, k AS d, kids, saved
  FROM (SELECT p, kids, saved, unnest(range(0, d + 1)) AS k FROM full_node)),
below AS (SELECT d, p, count(*) FILTER (kids = 0) AS leaves, sum(saved) AS saved FROM up GROUP BY d, p)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, CAST(f.n AS BIGINT) AS n_convs,
  CAST(f.kids AS BIGINT) AS n_children, CAST(below.leaves AS BIGINT) AS n_leaves,
  CAST(below.saved AS BIGINT) AS saved_tokens, sha256(f.ids) AS ends_sha256
FROM full_node f JOIN below ON below.d = f.d AND below.p = f.p
  LEFT JOIN full_node parent ON f.d > 0 AND parent.d = f.d - 1 AND parent.p = f.p[1:f.d - 1]
""",
}

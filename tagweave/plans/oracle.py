"""DuckDB SQL that states, independently of Spark, what each registered
query must return.  The input shapes are re-derived from the same parquet
views with the same rules as ``sources.fixtures``.

White space: Java's ``(?U)\\s`` is the Unicode White_Space set; the RE2
class below is the same set.  DuckDB string literals keep backslashes, so
the patterns are written as raw strings.
"""

from __future__ import annotations

WS = r"[\t\n\x0B\f\r\x{85}\p{Z}]"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+$', '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def strip_eot(x: str) -> str:
    return f"regexp_replace({rstrip(x)}, '{WS}*<\\|eot_id\\|>$', '')"


def split_caption(x: str) -> str:
    return f"string_split({rstrip(strip_eot(x))}, ', ')"


def split_tags(x: str) -> str:
    return f"string_split({rstrip(x)}, ', ')"


def comma_pieces(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, ','), lambda p: {strip('p')}), lambda p: p <> '')"


def normalize_delimiters(x: str) -> str:
    return f"array_to_string({comma_pieces(x)}, ', ')"


WORDS = r"regexp_extract_all(lower(text), '\p{L}+')"


def image_name(x: str) -> str:
    return f"concat('img_', lpad(CAST({x} AS VARCHAR), 10, '0'))"


# ----------------------------------------------------------------- fixtures
CTE = {}
CTE["captions"] = f"""captions AS (
  SELECT {image_name('doc_id')} AS name,
         concat(array_to_string(list_transform({WORDS},
                  lambda x: CASE WHEN length(x) % 5 = 0 THEN concat('meta:', x) ELSE x END), ', '),
                CASE WHEN doc_id % 3 = 0 THEN ' <|eot_id|> ' ELSE '' END) AS text,
         doc_id
  FROM documents)"""
CTE["plain_captions"] = f"""plain_captions AS (
  SELECT {image_name('doc_id')} AS name,
         concat(array_to_string({WORDS}, ', '),
                CASE WHEN doc_id % 6 = 0 THEN ', 2014, 4leg' ELSE '' END,
                CASE WHEN doc_id % 3 = 0 THEN ' <|eot_id|> ' ELSE '' END) AS text,
         doc_id
  FROM documents)"""
CTE["raw_caps"] = f"""raw_caps AS (SELECT {image_name('doc_id')} AS name, text FROM documents)"""
CTE["dictionary"] = f"""dictionary AS (
  SELECT name, CAST((length(name) + ascii(name)) % 9 AS INTEGER) AS category,
         CAST(count(*) - 1 AS BIGINT) AS post_count
  FROM (SELECT unnest({WORDS}) AS name FROM documents) GROUP BY name
  UNION ALL SELECT '2014', 0, 1
  UNION ALL SELECT '4leg', 0, 1)"""
CTE["live"] = """live AS (SELECT name, category FROM dictionary WHERE post_count > 0)"""
CTE["alias_rows"] = """alias_rows AS (
  SELECT name AS antecedent_name, substr(name, 1, length(name) - 1) AS consequent_name, 1 AS kind, 1 AS row_no
    FROM dictionary WHERE length(name) >= 6 AND ascii(substr(name, length(name), 1)) % 2 = 0
  UNION ALL
  SELECT name, substr(name, 1, length(name) - 2), 1, 2
    FROM dictionary WHERE length(name) >= 7 AND ascii(substr(name, length(name), 1)) % 4 = 0
  UNION ALL
  SELECT name, substr(name, 1, 3), 2, 1 FROM dictionary WHERE length(name) >= 8 AND ascii(name) % 4 = 1)"""
CTE["alias_map"] = """alias_map AS (
  SELECT antecedent_name, consequent_name FROM (
    SELECT *, row_number() OVER (PARTITION BY antecedent_name ORDER BY kind DESC, row_no DESC) AS rn
    FROM alias_rows) WHERE rn = 1)"""
CTE["plain_tags"] = f"""plain_tags AS (
  SELECT c.name, u.tag, CAST(u.pos - 1 AS BIGINT) AS pos
  FROM (SELECT name, {split_caption('text')} AS tags FROM plain_captions) c,
       unnest(c.tags) WITH ORDINALITY AS u(tag, pos))"""
CTE["caption_tags"] = f"""caption_tags AS (
  SELECT c.name, u.tag, CAST(u.pos - 1 AS BIGINT) AS pos
  FROM (SELECT name, {split_caption('text')} AS tags FROM captions) c,
       unnest(c.tags) WITH ORDINALITY AS u(tag, pos))"""
CTE["posts"] = f"""posts AS (
  SELECT doc_id * 3 AS post_id, {image_name('doc_id + 20')} AS filename,
         CASE WHEN doc_id % 10 = 0 THEN '' ELSE concat('Artist ', source) END AS artist,
         CAST(2000 + doc_id % 25 AS VARCHAR) AS year
  FROM documents
  UNION ALL
  SELECT doc_id * 3 + k, {image_name('doc_id + 20')}, concat('Studio (', lang, ')'), CAST(2000 + doc_id % 25 AS VARCHAR)
  FROM documents, (VALUES (1), (2)) AS t(k) WHERE lang = 'de')"""
CTE["raw_posts"] = """raw_posts AS (
  SELECT event_id, concat('post ', event_id, ',, ', event_type, ' no ', event_id, ', ', event_type, ' User', user_id, ', ',
         CASE WHEN event_id % 7 = 0 THEN 'n.d.' ELSE CAST(2000 + event_id % 25 AS VARCHAR) END, ', ', props, ', ',
         strftime(ts, '%Y-%m-%d %H:%M:%S'), ', end') AS raw
  FROM events)"""
CTE["replies"] = f"""replies AS (
  SELECT conv_id, turn, role,
    CASE turn % 4
      WHEN 0 THEN concat('Sure.' || chr(10) || '**Output:**' || chr(10) || '```' || chr(10) || '- ',
                         array_to_string({WORDS}, ', '), chr(10) || '```' || chr(10) || 'Done')
      WHEN 1 THEN concat('```text' || chr(10), array_to_string({WORDS}, ', '), '```')
      WHEN 2 THEN concat('The tags removed are ', array_to_string({WORDS}, ', '))
      ELSE array_to_string({WORDS}, ', ') END AS reply
  FROM conversations)"""
CTE["file_names"] = """file_names AS (
  SELECT page_id,
    CASE page_id % 4 WHEN 0 THEN concat('clip_frame_', page_id // 8, '-up2x-', length(html))
                     WHEN 1 THEN concat('a-b=', page_id // 8, '-x', length(html))
                     WHEN 2 THEN concat('plain-', page_id) ELSE concat('k=', page_id) END AS stem,
    CASE WHEN page_id % 2 = 0 THEN '.png' ELSE '.txt' END AS ext
  FROM pages)"""

# CTE dependencies, so a query names only what it reads.
DEPS = {
    "live": ["dictionary"],
    "alias_rows": ["dictionary"],
    "alias_map": ["alias_rows"],
    "plain_tags": ["plain_captions"],
    "caption_tags": ["captions"],
}


def with_(*names: str) -> str:
    order: list[str] = []

    def add(n):
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)
    for n in names:
        add(n)
    return "WITH " + ",\n".join(CTE[n] for n in order) + "\n"


def basic_clean_sql(src: str) -> str:
    """Ordered de-dup in SQL: unnest with ordinality, min(pos) per tag,
    string_agg in position order; names keep an empty text."""
    last = strip("regexp_extract(t, '[^:]*$')")
    after = f"CASE WHEN contains(t, ':') THEN {last} ELSE t END"
    return f"""bc_tags AS (
  SELECT c.name, u.tag, u.pos FROM (SELECT name, list_transform({split_caption('text')}, lambda t: {after}) AS tags
                                    FROM {src}) c, unnest(c.tags) WITH ORDINALITY AS u(tag, pos)),
bc_first AS (SELECT name, tag, min(pos) AS pos FROM bc_tags GROUP BY name, tag),
basic_clean AS (SELECT name, coalesce(string_agg(tag, ', ' ORDER BY pos), '') AS text FROM bc_first GROUP BY name)"""


SQL: dict[str, str] = {}

# ---------------------------------------------------------------- text jobs
SQL["strip_eot"] = with_("captions") + f"SELECT name, {strip_eot('text')} AS text FROM captions"

SQL["split_tags"] = with_("captions") + f"""SELECT name, CAST(len(l) AS BIGINT) AS n_tags, array_to_string(l, ' | ') AS tags
FROM (SELECT name, {split_tags('text')} AS l FROM captions)"""

SQL["dedup_order"] = with_("caption_tags") + """, f AS (SELECT name, tag, min(pos) AS pos FROM caption_tags GROUP BY name, tag)
SELECT name, CAST(count(*) AS BIGINT) AS n_tags, string_agg(tag, ' | ' ORDER BY pos) AS tags FROM f GROUP BY name"""

SQL["basic_clean"] = with_("captions") + ", " + basic_clean_sql("captions") + "\nSELECT name, text FROM basic_clean"

SQL["pad_only"] = with_("raw_caps") + f"""SELECT name,
  array_to_string(list_transform({split_caption('text')}, lambda t: regexp_replace(t, '{WS}+', '_', 'g')), ', ') AS text
FROM raw_caps"""

SQL["fix_delimiters"] = with_("replies") + f"""SELECT concat(conv_id, '_', turn) AS name, {normalize_delimiters('reply')} AS text,
  {normalize_delimiters('reply')} <> reply AS changed FROM replies"""

SQL["fix_delimiters_summary"] = with_("replies") + f"""SELECT CAST(count(*) FILTER (WHERE {normalize_delimiters('reply')} <> reply) AS BIGINT) AS changed,
  CAST(count(*) FILTER (WHERE {normalize_delimiters('reply')} = reply) AS BIGINT) AS unchanged FROM replies"""

_pad = f"array_to_string(list_transform({split_caption('text')}, lambda t: regexp_replace(t, '{WS}+', '_', 'g')), ', ')"
_kw_clean = strip("replace(replace(t, '_', ' '), '\\', '')")
_kw_pieces = f"list_transform(list_filter(string_split({strip('p')}, ', '), lambda t: {strip('t')} <> ''), lambda t: {_kw_clean})"
SQL["keyword_clean"] = with_("raw_caps") + f"""SELECT name,
  concat(array_to_string(CASE WHEN list_contains(k, 'solo') THEN k ELSE list_prepend('solo', k) END, ', '), chr(10)) AS text
FROM (SELECT name, {_kw_pieces} AS k FROM (SELECT name, {_pad} AS p FROM raw_caps) WHERE {strip('p')} <> '')"""

_rs_frame = ("CASE WHEN strpos(substr(stem, strpos(stem, 'frame_')), '-') > 0 "
             "THEN substr(stem, 1, strpos(stem, 'frame_') + strpos(substr(stem, strpos(stem, 'frame_')), '-') - 2) ELSE stem END")
_rs_eq = ("CASE WHEN strpos(substr(stem, strpos(stem, '=')), '-') > 0 "
          "THEN substr(stem, 1, strpos(stem, '=') + strpos(substr(stem, strpos(stem, '=')), '-') - 2) ELSE stem END")
SQL["restore_names"] = with_("file_names") + f"""SELECT restored, max(source) AS source FROM (
  SELECT concat(stem, ext) AS source,
    concat(CASE WHEN strpos(stem, 'frame_') > 0 THEN {_rs_frame} WHEN strpos(stem, '=') > 0 THEN {_rs_eq} ELSE stem END, ext) AS restored
  FROM file_names) GROUP BY restored"""

_skip7 = f"CASE WHEN ends_with(name, '7') THEN ' ' || chr(10) ELSE {_pad} END"
SQL["keyword_clean_summary"] = with_("raw_caps") + f"""SELECT
  CAST(count(*) FILTER (WHERE {strip('p')} <> '') AS BIGINT) AS written,
  CAST(count(*) FILTER (WHERE {strip('p')} = '') AS BIGINT) AS skipped FROM (SELECT {_skip7} AS p FROM raw_caps)"""


def inject_sql(text: str, artist: str, year: str) -> str:
    a = f"lower({strip(artist)})"
    y = f"lower({strip(year)})"
    has_both = (f"regexp_matches({text}, concat('(?i)\\b', regexp_escape({a}), '\\b')) AND "
                f"regexp_matches({text}, concat('(?i)\\b', regexp_escape({y}), '\\b'))")
    return (f"CASE WHEN {has_both} THEN {text} WHEN strpos({text}, ', ') > 0 THEN "
            f"concat(substr({text}, 1, strpos({text}, ', ') + 1), {a}, ', ', {y}, ', ', substr({text}, strpos({text}, ', ') + 2)) "
            f"ELSE concat({a}, ', ', {y}, ', ', {text}) END")


SQL["inject_artist_year"] = with_("captions", "posts") + f"""SELECT p.post_id, c.name, {inject_sql('c.text', 'p.artist', 'p.year')} AS text
FROM posts p JOIN captions c ON p.filename = c.name WHERE p.artist <> ''"""

_uy_after = "CASE WHEN strpos(raw, ',') > 0 THEN regexp_replace(raw, '^[^,]*,[, \\t\\n]*', '') ELSE regexp_replace(raw, '^[ \\t\\n]+', '') END"
SQL["uploader_year"] = with_("raw_posts") + f"""SELECT event_id, concat(replace(lower(parts[yi - 1]), ' ', '_'), ', ', parts[yi]) AS text
FROM (SELECT event_id, parts, coalesce(list_position(list_transform(parts, lambda p: regexp_matches(p, '^\\d{{4}}$')), true), 0) AS yi
      FROM (SELECT event_id, list_filter(list_transform(string_split({_uy_after}, ', '), lambda p: {strip('p')}), lambda p: p <> '') AS parts
            FROM raw_posts))
WHERE len(parts) >= 3 AND yi > 1"""
SQL["uploader_year_summary"] = with_("raw_posts") + f"""SELECT
  CAST((SELECT count(*) FROM ({SQL["uploader_year"][len(with_("raw_posts")):]})) AS BIGINT) AS written,
  CAST((SELECT count(*) FROM raw_posts) - (SELECT count(*) FROM ({SQL["uploader_year"][len(with_("raw_posts")):]})) AS BIGINT) AS skipped"""

_hb_rest = f"regexp_replace(substr(raw, strpos(raw, ',') + 1), '^[,\\t\\n\\x0B\\f\\r\\x{{85}}\\p{{Z}}]+', '')"
_hb_header = f"regexp_replace({_hb_rest}, '\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}}.*$', '', 's')"
_hb_body = "regexp_replace(CASE WHEN yi > 0 THEN array_to_string(parts[yi + 1:], ', ') ELSE '' END, '^[, ]+|[, ]+$', '', 'g')"
SQL["post_header_body"] = with_("raw_posts") + f"""SELECT event_id,
  CASE WHEN yi > 1 THEN replace(lower(parts[yi - 1]), ' ', '_') ELSE '' END AS uploader,
  {strip(_hb_body)} AS body
FROM (SELECT event_id, parts, coalesce(list_position(list_transform(parts, lambda p: regexp_matches(p, '^\\d{{4}}$')), true), 0) AS yi
      FROM (SELECT event_id, list_filter(list_transform(string_split({_hb_header}, ', '), lambda p: {strip('p')}), lambda p: p <> '') AS parts
            FROM raw_posts))"""

SQL["prepend_trigger"] = with_("captions") + ", " + basic_clean_sql("captions") + """
SELECT name, CASE WHEN starts_with(text, 'abo') THEN text ELSE concat('abo, ', text) END AS text FROM basic_clean"""

# ---------------------------------------------------------- caption files
SQL["src_captions"] = with_("captions") + """SELECT concat(name, '.txt') AS file, name, text FROM captions WHERE doc_id % 7 <> 0"""
SQL["src_captions_recursive"] = with_("captions") + """SELECT concat(name, '.txt') AS file, name, text FROM captions"""

# ---------------------------------------------------------- dictionary jobs
SQL["live_tags"] = with_("dictionary") + "SELECT name, category, post_count FROM dictionary WHERE post_count > 0"

SQL["known_tags"] = with_("plain_tags", "live") + """SELECT name, string_agg(tag, ' | ' ORDER BY pos) AS tags
FROM plain_tags WHERE tag IN (SELECT name FROM live) GROUP BY name"""

SQL["drop_year_tags"] = with_("plain_tags") + """SELECT name, string_agg(tag, ' | ' ORDER BY pos) AS tags
FROM plain_tags WHERE NOT (length(tag) = 4 AND regexp_matches(tag, '\\d')) GROUP BY name"""

SQL["drop_categories"] = with_("plain_tags", "live") + """SELECT t.name, string_agg(t.tag, ' | ' ORDER BY t.pos) AS tags
FROM plain_tags t LEFT JOIN live l ON t.tag = l.name
WHERE l.category IS NULL OR l.category NOT IN (1, 3, 4, 6, 7) GROUP BY t.name"""

SQL["alias_map"] = with_("alias_map") + "SELECT antecedent_name, consequent_name FROM alias_map"

SQL["canonical_tags"] = with_("plain_tags", "alias_map") + """SELECT t.name,
  string_agg(coalesce(a.consequent_name, t.tag), ' | ' ORDER BY t.pos) AS tags
FROM plain_tags t LEFT JOIN alias_map a ON t.tag = a.antecedent_name GROUP BY t.name"""


def code_sql(tag: str, cat: str) -> str:
    k = f"lower({strip(tag)})"
    return (f"CASE {cat} WHEN 4 THEN 'char' WHEN 5 THEN 'spec' WHEN 6 THEN 'inv' WHEN 1 THEN 'art' ELSE "
            f"CASE WHEN regexp_matches({k}, '^\\d{{4}}$') THEN 'meta' WHEN starts_with({k}, 'meta:') THEN 'meta' "
            f"WHEN starts_with({k}, 'rating:') THEN 'rate' ELSE 'gen' END END")


SQL["tag_category"] = with_("caption_tags", "live") + f"""SELECT t.name, string_agg({code_sql('t.tag', 'l.category')}, ' | ' ORDER BY t.pos) AS tags
FROM caption_tags t LEFT JOIN live l ON lower({strip('t.tag')}) = l.name GROUP BY t.name"""

SQL["sanitize"] = with_("plain_tags", "alias_map", "live") + """, canon AS (
  SELECT t.name, t.pos, coalesce(a.consequent_name, t.tag) AS canon
  FROM plain_tags t LEFT JOIN alias_map a ON t.tag = a.antecedent_name),
kept AS (
  SELECT c.name, c.canon, min(c.pos) AS pos FROM canon c JOIN live l ON c.canon = l.name
  WHERE NOT (length(c.canon) = 4 AND regexp_matches(c.canon, '\\d')) AND l.category NOT IN (1, 3, 4, 6, 7)
  GROUP BY c.name, c.canon)
SELECT p.name, coalesce(string_agg(k.canon, ', ' ORDER BY k.pos), '') AS text
FROM plain_captions p LEFT JOIN kept k ON p.name = k.name GROUP BY p.name"""

# ------------------------------------------------------------- merge family
CTE["src_words"] = f"""src_words AS (SELECT doc_id, lang, {image_name('doc_id')} AS name, {WORDS} AS w FROM documents)"""
CTE["source_captions"] = """source_captions AS (
  SELECT concat('tagger', source_ord) AS source, source_ord, name,
         concat(array_to_string(tags, ', '), CASE WHEN source_ord = 2 THEN ' <|eot_id|>' || chr(10) ELSE '' END) AS text
  FROM (SELECT name, 1 AS source_ord, list_filter(w, lambda x: length(x) <= 6) AS tags FROM src_words
        UNION ALL SELECT name, 2, list_filter(w, lambda x: length(x) >= 5) FROM src_words WHERE lang <> 'de'
        UNION ALL SELECT name, 3, list_filter(w, lambda x: contains(x, 'e')) FROM src_words WHERE lang <> 'es'))"""
DEPS["source_captions"] = ["src_words"]


def save_rank_sql(code: str) -> str:
    return (f"CASE {code} WHEN 'char' THEN 0 WHEN 'spec' THEN 1 WHEN 'inv' THEN 2 WHEN 'art' THEN 3 "
            f"WHEN 'year' THEN 4 WHEN 'gen' THEN 5 WHEN 'meta' THEN 6 WHEN 'rate' THEN 7 END")


SQL["merge_captions"] = with_("source_captions") + f""", mt AS (
  SELECT s.name, s.source_ord, u.tag, u.pos
  FROM (SELECT name, source_ord, {split_caption('text')} AS tags FROM source_captions) s,
       unnest(s.tags) WITH ORDINALITY AS u(tag, pos)),
mf AS (SELECT name, tag, min(CAST(source_ord AS BIGINT) * 1000000000 + pos) AS k FROM mt GROUP BY name, tag)
SELECT name, string_agg(tag, ', ' ORDER BY k) AS text FROM mf GROUP BY name"""

SQL["src_multi"] = with_("source_captions") + """SELECT source, CAST(CASE source WHEN 'tagger2' THEN 0 WHEN 'tagger1' THEN 1 ELSE 2 END AS INTEGER) AS source_ord,
  concat(name, '.txt') AS file, name, text FROM source_captions"""

SQL["all_names"] = with_("source_captions") + "SELECT DISTINCT name FROM source_captions"

_pieces_sp = f"list_filter(list_transform(string_split(text, ', '), lambda p: {strip('p')}), lambda p: p <> '')"
SQL["merge_priority"] = with_("source_captions", "live") + f""", mp AS (
  SELECT s.name, s.source_ord, u.tag, u.pos
  FROM (SELECT name, source_ord, {_pieces_sp} AS tags FROM source_captions WHERE source_ord <= 2) s,
       unnest(s.tags) WITH ORDINALITY AS u(tag, pos)),
mpf AS (SELECT name, tag, min(CAST(source_ord AS BIGINT) * 1000000000 + pos) AS k FROM mp GROUP BY name, tag),
mpc AS (SELECT f.name, f.tag, f.k, {code_sql('f.tag', 'l.category')} AS code
        FROM mpf f LEFT JOIN live l ON lower({strip('f.tag')}) = l.name)
SELECT n.name, coalesce(string_agg(mpc.tag, ', ' ORDER BY mpc.code, mpc.k), '') AS text
FROM (SELECT DISTINCT name FROM source_captions WHERE source_ord <= 2) n LEFT JOIN mpc ON n.name = mpc.name GROUP BY n.name"""


def _comma_tag_rows(src: str, alias: str) -> str:
    return f"""{alias} AS (
  SELECT c.name, u.tag, u.pos FROM (SELECT name, {comma_pieces('text')} AS tags FROM {src}) c,
       unnest(c.tags) WITH ORDINALITY AS u(tag, pos))"""


SQL["save_order"] = with_("captions", "live") + ", " + _comma_tag_rows("captions", "so") + f""",
sof AS (SELECT name, tag, min(pos) AS pos FROM so GROUP BY name, tag),
soc AS (SELECT f.name, f.tag, f.pos, {code_sql('f.tag', 'l.category')} AS code
        FROM sof f LEFT JOIN live l ON lower({strip('f.tag')}) = l.name)
SELECT c.name, coalesce(string_agg(soc.tag, ', ' ORDER BY {save_rank_sql('soc.code')}, soc.pos), '') AS text
FROM captions c LEFT JOIN soc ON c.name = soc.name GROUP BY c.name"""

SQL["keep_only_character"] = with_("captions", "live") + ", " + _comma_tag_rows("captions", "kc") + f""",
kcc AS (SELECT k.name, k.tag, k.pos, {code_sql('k.tag', 'l.category')} AS code
        FROM kc k LEFT JOIN live l ON lower({strip('k.tag')}) = l.name)
SELECT c.name, coalesce(string_agg(kcc.tag, ', ' ORDER BY CASE WHEN kcc.code = 'char' THEN 0 ELSE 1 END, kcc.pos)
                        FILTER (WHERE kcc.code <> 'char' OR lower(kcc.tag) = 'der'), '') AS text
FROM captions c LEFT JOIN kcc ON c.name = kcc.name GROUP BY c.name"""

# -------------------------------------------------------------------- posts
_VALID_POST = f"{strip('artist')} <> '' AND {strip('year')} <> '' AND {strip('filename')} <> ''"
CTE["vp"] = f"""vp AS (
  SELECT post_id, lower({strip('artist')}) AS a, lower({strip('year')}) AS y, {strip('filename')} AS filename,
         row_number() OVER (PARTITION BY {strip('filename')} ORDER BY post_id) AS rn
  FROM posts WHERE {_VALID_POST})"""
# one post after the other: as many rounds as a caption has posts
CTE["folded"] = f"""folded AS (
  SELECT name, text, 0 AS rn, 0 AS n FROM captions
  UNION ALL
  SELECT name, new, rn, n + CAST(new <> old AS INTEGER)
  FROM (SELECT f.name, f.text AS old, {inject_sql('f.text', 'p.a', 'p.y')} AS new, p.rn, f.n
        FROM folded f JOIN vp p ON p.filename = f.name AND p.rn = f.rn + 1))"""
CTE["last_fold"] = """last_fold AS (SELECT name, arg_max(text, rn) AS text, arg_max(n, rn) AS n FROM folded GROUP BY name)"""
DEPS["vp"] = ["posts"]
DEPS["folded"] = ["captions", "vp"]
DEPS["last_fold"] = ["folded"]


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


SQL["inject_posts"] = recursive(with_("last_fold")) + "SELECT name, text, CAST(n AS BIGINT) AS n_modified FROM last_fold"
SQL["inject_post_meta"] = SQL["inject_posts"]

SQL["inject_posts_summary"] = recursive(with_("last_fold")) + f"""SELECT
  CAST((SELECT coalesce(sum(n), 0) FROM last_fold) AS BIGINT) AS modified,
  CAST((SELECT count(*) FROM vp WHERE filename NOT IN (SELECT name FROM captions)) AS BIGINT) AS missing,
  CAST((SELECT count(*) FROM posts WHERE NOT ({_VALID_POST})) AS BIGINT) AS skipped"""

SQL["src_post_meta"] = with_("posts") + """SELECT CAST(post_id % 3 AS INTEGER) AS post_no, CAST(post_id AS VARCHAR) AS post_key,
  artist, year, filename FROM posts"""

# ------------------------------------------------------------------- scores
_MODELS = "(VALUES ('m1', 0, 0, 39), ('m2', 1, 24, 63)) AS m(model, model_ord, lo, hi)"
CTE["emb_cells"] = """emb_cells AS (
  SELECT e.vec_id, e.label, CAST(u.pos - 1 AS BIGINT) AS pos, CAST(u.v AS DOUBLE) AS v
  FROM embeddings e, unnest(e.embedding) WITH ORDINALITY AS u(v, pos))"""
CTE["slices"] = f"""slices AS (
  SELECT c.vec_id AS image, m.model, m.model_ord, c.pos - m.lo AS idx,
         CAST(floor((c.v + 1) * 500000) AS BIGINT) AS score
  FROM emb_cells c, {_MODELS} WHERE c.pos BETWEEN m.lo AND m.hi)"""
CTE["vocab"] = f"""vocab AS (
  SELECT model, g - lo AS idx, CASE WHEN g % 13 = 0 THEN 'dup tag' ELSE concat('tag_', g) END AS tag
  FROM (SELECT model, lo, unnest(range(lo, hi + 1)) AS g FROM {_MODELS})
  WHERE g IN (SELECT DISTINCT pos FROM emb_cells))"""
DEPS["slices"] = ["emb_cells"]
DEPS["vocab"] = ["emb_cells"]


def _labeled(k: int) -> str:
    return f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY image, model ORDER BY score DESC, idx) - 1 AS rnk FROM slices),
labeled AS (SELECT r.image, r.model, r.model_ord, r.rnk, r.score, v.tag
            FROM ranked r JOIN vocab v ON r.model = v.model AND r.idx = v.idx WHERE r.rnk < {k}),
dedup AS (SELECT image, model, model_ord, tag, min(score) AS score, min(rnk) AS first_rnk
          FROM labeled GROUP BY image, model, model_ord, tag)"""


SQL["topk_scores"] = with_("slices") + """SELECT image, model, rnk AS rank, idx, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY image, model ORDER BY score DESC, idx) - 1 AS BIGINT) AS rnk
  FROM slices) WHERE rnk < 25"""

SQL["score_labels"] = with_("slices", "vocab") + ", " + _labeled(250) + """
SELECT image, model, tag, score,
       CAST(row_number() OVER (PARTITION BY image, model ORDER BY first_rnk) - 1 AS BIGINT) AS rank FROM dedup"""


def _batch_tag_sql(thr_micro: int) -> str:
    return with_("slices", "vocab") + ", " + _labeled(250) + f"""
SELECT image, model, coalesce(string_agg(tag, ', ' ORDER BY first_rnk) FILTER (WHERE score > {thr_micro}), '') AS text
FROM dedup GROUP BY image, model"""


SQL["batch_tag"] = _batch_tag_sql(500000)
SQL["tag_string"] = _batch_tag_sql(0)

_ENS = ", " + _labeled(250) + """,
ens AS (SELECT image, tag, CAST(sum(score) AS BIGINT) AS sum_micro, CAST(count(*) AS BIGINT) AS n_models,
               arg_min(first_rnk, model_ord) AS first_rank, min(model_ord) AS first_model
        FROM dedup GROUP BY image, tag)"""
SQL["ensemble_scores"] = with_("slices", "vocab") + _ENS + """
SELECT image, tag, sum_micro, n_models FROM ens WHERE sum_micro > 500000 * n_models"""
SQL["score_threshold"] = with_("slices", "vocab") + _ENS + """
SELECT image, tag, sum_micro, n_models FROM ens WHERE sum_micro > 550000 * n_models"""
SQL["rethreshold_tag_string"] = with_("slices", "vocab") + _ENS + """
SELECT image, string_agg(tag, ', ' ORDER BY first_model, first_rank) AS text
FROM ens WHERE sum_micro > 550000 * n_models GROUP BY image"""
SQL["ensemble_tag_string"] = with_("slices", "vocab") + _ENS + """
SELECT image, coalesce(string_agg(tag, ', ' ORDER BY first_model, first_rank) FILTER (WHERE sum_micro > 500000 * n_models), '') AS text
FROM ens GROUP BY image"""
SQL["label_index"] = with_("slices", "vocab") + _ENS + """,
req AS (SELECT e.image, e.tag, m.model FROM ens e, (VALUES ('m1'), ('m2')) AS m(model) WHERE e.sum_micro > 500000 * e.n_models),
last AS (SELECT model, tag, max(idx) AS idx FROM vocab GROUP BY model, tag)
SELECT r.image, r.model, r.tag, CAST(l.idx AS BIGINT) AS idx FROM req r JOIN last l ON r.model = l.model AND r.tag = l.tag"""
SQL["labels_padded"] = with_("vocab") + """, nc AS (SELECT * FROM (VALUES ('m1', 43), ('m2', 40)) AS t(model, num_classes)),
sizes AS (SELECT model, count(*) AS n FROM vocab GROUP BY model)
SELECT model, CAST(idx AS INTEGER) AS idx, tag FROM vocab
UNION ALL
SELECT s.model, CAST(s.n + i AS INTEGER), concat('placeholder', i)
FROM sizes s JOIN nc ON s.model = nc.model, range(3) AS r(i) WHERE s.n + 3 = nc.num_classes"""


def _head_sql(n_labels: int, gated: bool) -> str:
    z = f"""z AS (
  SELECT c.vec_id, w.l, sum(c.v * w.w) AS z FROM emb_cells c
  JOIN (SELECT l, e, ((l * 31 + e * 17) % 21 - 10) / 10.0 AS w FROM range({n_labels}) AS a(l), range(64) AS b(e)) w
    ON c.pos = w.e GROUP BY c.vec_id, w.l)"""
    if not gated:
        return with_("emb_cells") + ", " + z + """
SELECT vec_id, CAST(l AS BIGINT) AS l, CAST(floor(1.0 / (1.0 + exp(-z)) * 1000000) AS BIGINT) AS micro FROM z"""
    c = n_labels // 2
    return with_("emb_cells") + ", " + z + f"""
SELECT a.vec_id, CAST(a.l AS BIGINT) AS l,
       CAST(floor((1.0 / (1.0 + exp(-a.z))) * (1.0 / (1.0 + exp(-g.z))) * 1000000) AS BIGINT) AS micro
FROM z a JOIN z g ON a.vec_id = g.vec_id AND g.l = a.l + {c} WHERE a.l < {c}"""


SQL["linear_scores"] = _head_sql(20, False)
SQL["gated_scores"] = _head_sql(20, True)

SQL["auto_sigmoid"] = with_("emb_cells") + f""", s AS (
  SELECT c.vec_id AS image, m.model, c.pos - m.lo AS idx, c.v AS logit, (c.v + 1) / 2 AS prob
  FROM emb_cells c, {_MODELS} WHERE c.pos BETWEEN m.lo AND m.hi),
b AS (SELECT image, model, min(logit) AS mn_l, max(logit) AS mx_l, min(prob) AS mn_p, max(prob) AS mx_p
      FROM s GROUP BY image, model)
SELECT s.image, s.model, 'logit' AS kind, CAST(s.idx AS BIGINT) AS idx,
       CAST(floor(CASE WHEN mn_l >= 0 AND mx_l <= 1 THEN logit ELSE 1.0 / (1.0 + exp(-logit)) END * 1000000) AS BIGINT) AS micro
FROM s JOIN b ON s.image = b.image AND s.model = b.model
UNION ALL
SELECT s.image, s.model, 'prob', CAST(s.idx AS BIGINT),
       CAST(floor(CASE WHEN mn_p >= 0 AND mx_p <= 1 THEN prob ELSE 1.0 / (1.0 + exp(-prob)) END * 1000000) AS BIGINT)
FROM s JOIN b ON s.image = b.image AND s.model = b.model"""

# --------------------------------------------------------------------- heat
SQL["grid_layout"] = """SELECT page_id, n, h, CAST(n // h AS BIGINT) AS w FROM (
  SELECT page_id, CAST(length(html) AS BIGINT) AS n,
         CAST(list_max(list_filter(range(1, greatest(CAST(floor(sqrt(length(html))) AS BIGINT), 1) + 1),
                                   lambda h: length(html) % h = 0)) AS BIGINT) AS h
  FROM pages)"""

CTE["fused"] = """fused AS (
  SELECT image, tag, cell, n_models, s - min(s) OVER (PARTITION BY image, tag) AS num,
         max(s) OVER (PARTITION BY image, tag) - min(s) OVER (PARTITION BY image, tag) AS den
  FROM (SELECT vec_id AS image, concat('tag_', label) AS tag, CAST(pos % 16 AS INTEGER) AS cell,
               CAST(sum(CAST(floor((v + 1) * 500000) AS BIGINT)) AS BIGINT) AS s, CAST(count(*) AS BIGINT) AS n_models
        FROM (SELECT vec_id, label, pos, CASE WHEN vec_id % 11 = 0 THEN 0.25 ELSE v END AS v FROM emb_cells)
        GROUP BY vec_id, label, pos % 16))"""
DEPS["fused"] = ["emb_cells"]
SQL["heat_fuse"] = with_("fused") + "SELECT image, tag, cell, n_models, num, den FROM fused"
SQL["heat_mask"] = with_("fused") + f"""SELECT image, tag, cell,
  CASE WHEN den > 0 AND num * 1000000 >= {int(round(0.35 * 1_000_000))} * den THEN {int(0.6 * 255)} ELSE 0 END AS mask FROM fused"""
SQL["patch_saliency"] = with_("emb_cells") + """, q AS (
  SELECT vec_id // 4 AS image, CAST(vec_id % 4 AS INTEGER) AS patch, pos, CAST(floor(v * 10000) AS BIGINT) AS q FROM emb_cells),
wts AS (SELECT image, pos - 32 AS e, sum(q) AS wt FROM q WHERE pos >= 32 GROUP BY image, pos - 32),
v AS (SELECT a.image, a.patch, CAST(greatest(sum(a.q * w.wt), 0) AS BIGINT) AS v
      FROM q a JOIN wts w ON a.image = w.image AND a.pos = w.e WHERE a.pos < 32 GROUP BY a.image, a.patch),
g AS (SELECT image, count(*) AS n FROM v GROUP BY image),
gh AS (SELECT image, n, list_max(list_filter(range(1, greatest(CAST(floor(sqrt(n)) AS BIGINT), 1) + 1), lambda h: n % h = 0)) AS h FROM g)
SELECT v.image, v.patch, CAST(v.patch // (gh.n // gh.h) AS INTEGER) AS row, CAST(v.patch % (gh.n // gh.h) AS INTEGER) AS col,
       v.v - min(v.v) OVER (PARTITION BY v.image) AS num,
       max(v.v) OVER (PARTITION BY v.image) - min(v.v) OVER (PARTITION BY v.image) AS den
FROM v JOIN gh ON v.image = gh.image"""

# -------------------------------------------------------------- files, review
CTE["image_inv"] = f"""image_inv AS (
  SELECT doc_id, concat({image_name('doc_id')}, CASE doc_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.webp'
                                                       WHEN 3 THEN '.gif' ELSE '.pdf' END) AS file,
         text AS content, {image_name('doc_id')} AS stem,
         CASE doc_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.webp' WHEN 3 THEN '.gif' ELSE '.pdf' END AS ext
  FROM documents)"""
_DEDUP_EXTS = "('.png', '.jpg', '.jpeg', '.webp', '.bmp', '.gif')"
_MODEL_EXTS = "('.png', '.jpg', '.jpeg', '.webp', '.bmp', '.tif', '.tiff')"


def _rank(ext: str, exts: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {ext} = '{e}' THEN {i}" for i, e in enumerate(exts)) + " END"


SQL["src_images"] = with_("image_inv") + f"""SELECT file, CAST(strlen(content) AS BIGINT) AS n_bytes
FROM image_inv WHERE lower(ext) IN {_DEDUP_EXTS}"""
_FILES = with_("captions") + f""", files AS (
  SELECT concat(name, '.txt') AS file, name, {strip('text')} AS text FROM captions WHERE text IS NOT NULL)
"""
SQL["sink_captions"] = _FILES + "SELECT file, name, text FROM files"
SQL["dedup_files"] = _FILES + """SELECT file, CAST(strlen(text) AS BIGINT) AS n_bytes,
  CASE WHEN row_number() OVER (PARTITION BY md5(text) ORDER BY file) = 1 THEN 'keep' ELSE 'move' END AS action FROM files"""
SQL["dedup_groups"] = with_("image_inv") + f"""SELECT md5(content) AS h, min(file) AS keep, CAST(count(*) - 1 AS BIGINT) AS extra
FROM image_inv WHERE lower(ext) IN {_DEDUP_EXTS} GROUP BY md5(content)"""
SQL["dedup_keep_move"] = with_("image_inv") + f"""SELECT file, h, CASE WHEN rn = 1 THEN 'keep' ELSE 'move' END AS action
FROM (SELECT file, md5(content) AS h, row_number() OVER (PARTITION BY md5(content) ORDER BY file) AS rn
      FROM image_inv WHERE lower(ext) IN {_DEDUP_EXTS})"""
SQL["pair_files"] = with_("captions", "image_inv") + f"""SELECT concat(c.name, '.txt') AS txt, arg_min(i.file, {_rank('i.ext', ['.png', '.jpg', '.jpeg', '.webp'])}) AS image
FROM captions c JOIN image_inv i ON c.name = i.stem
WHERE i.ext IN ('.png', '.jpg', '.jpeg', '.webp') GROUP BY c.name"""
_MODEL_LIST = ['.png', '.jpg', '.jpeg', '.webp', '.bmp', '.tif', '.tiff']
SQL["ensure_images"] = with_("captions", "image_inv") + f""", own AS (
  SELECT {image_name('doc_id')} AS stem, concat({image_name('doc_id')}, '.bmp') AS file FROM documents WHERE lang = 'de'),
raw AS (SELECT stem, arg_min(file, {_rank('ext', _MODEL_LIST)}) AS file FROM image_inv
        WHERE ext IN {_MODEL_EXTS} GROUP BY stem)
SELECT c.name AS stem, coalesce(own.file, raw.file) AS image,
       CASE WHEN own.file IS NOT NULL THEN 'own' WHEN raw.file IS NOT NULL THEN 'raw' END AS origin
FROM captions c LEFT JOIN own ON c.name = own.stem LEFT JOIN raw ON c.name = raw.stem"""

CTE["review_rows"] = f"""review_rows AS (
  SELECT i.file AS image, s.source AS model, {comma_pieces('s.text')} AS tags
  FROM image_inv i LEFT JOIN source_captions s ON i.stem = s.name WHERE lower(i.ext) IN {_MODEL_EXTS})"""
DEPS["review_rows"] = ["image_inv", "source_captions"]
SQL["review_union"] = with_("review_rows") + """, u AS (
  SELECT image, list_sort(list_distinct(flatten(list(tags) FILTER (WHERE tags IS NOT NULL)))) AS l
  FROM review_rows GROUP BY image)
SELECT image, CAST(len(l) AS BIGINT) AS n_tags, array_to_string(l, ' | ') AS tags FROM u"""
SQL["review_by_model"] = with_("review_rows") + """SELECT image, model, array_to_string(tags, ' | ') AS tags
FROM review_rows WHERE model IS NOT NULL"""
SQL["review_items"] = with_("image_inv", "source_captions") + f""", mt AS (
  SELECT s.name, s.source_ord, u.tag, u.pos
  FROM (SELECT name, source_ord, {split_caption('text')} AS tags FROM source_captions) s,
       unnest(s.tags) WITH ORDINALITY AS u(tag, pos)),
mf AS (SELECT name, tag, min(CAST(source_ord AS BIGINT) * 1000000000 + pos) AS k FROM mt GROUP BY name, tag),
merged AS (SELECT name, string_agg(tag, ', ' ORDER BY k) AS text FROM mf GROUP BY name),
u AS (SELECT i.file AS image, list_sort(list_distinct(flatten(list({comma_pieces('m.text')}) FILTER (WHERE m.text IS NOT NULL)))) AS l
      FROM image_inv i LEFT JOIN merged m ON i.stem = m.name WHERE lower(i.ext) IN {_MODEL_EXTS} GROUP BY i.file)
SELECT image, CAST(len(l) AS BIGINT) AS n_tags, array_to_string(l, ' | ') AS tags, CAST(0 AS BIGINT) AS n_models FROM u"""
SQL["apply_edits"] = with_("captions") + f""", edits AS (
  SELECT {image_name('doc_id')} AS name, concat('edited, ', source) AS text FROM documents WHERE lang = 'fr')
SELECT name, text FROM captions WHERE name NOT IN (SELECT name FROM edits)
UNION ALL SELECT name, text FROM edits"""
SQL["finalize"] = with_("image_inv", "source_captions") + f""", mt AS (
  SELECT s.name, s.source_ord, u.tag, u.pos
  FROM (SELECT name, source_ord, {split_caption('text')} AS tags FROM source_captions) s,
       unnest(s.tags) WITH ORDINALITY AS u(tag, pos)),
mf AS (SELECT name, tag, min(CAST(source_ord AS BIGINT) * 1000000000 + pos) AS k FROM mt GROUP BY name, tag),
merged AS (SELECT name, string_agg(tag, ', ' ORDER BY k) AS text FROM mf GROUP BY name),
c AS (SELECT name AS stem, CASE WHEN starts_with(text, 'abo') THEN text ELSE concat('abo, ', text) END AS text FROM merged),
im AS (SELECT stem, string_agg(file, ' | ' ORDER BY file) AS images, count(*) AS n FROM (
         SELECT stem, file FROM image_inv WHERE lower(ext) IN {_MODEL_EXTS}
         UNION ALL SELECT stem, concat(stem, '.jpeg') FROM image_inv WHERE doc_id % 3 = 0) GROUP BY stem),
fin AS (SELECT coalesce(c.stem, im.stem) AS stem, c.text, coalesce(im.images, '') AS images, coalesce(im.n, 0) AS n
        FROM c FULL OUTER JOIN im ON c.stem = im.stem)
SELECT stem, text, images FROM fin"""
SQL["finalize_summary"] = SQL["finalize"].removesuffix("SELECT stem, text, images FROM fin") + """SELECT
  CAST(count(text) AS BIGINT) AS captions, CAST(sum(n) AS BIGINT) AS images FROM fin"""
SQL["work_list"] = with_("image_inv") + f"""SELECT file AS image, m.model FROM image_inv, (VALUES ('vendor/alpha'), ('lab/beta')) AS m(model)
WHERE lower(ext) IN {_MODEL_EXTS}"""

# ------------------------------------------------- prompts, replies, stages
from ..functions import prompts as _pr  # noqa: E402


def sql_str(s: str) -> str:
    """A Python string as a DuckDB expression (quotes doubled, line breaks
    as chr(10))."""
    parts = [("'" + p.replace("'", "''") + "'") for p in s.split("\n")]
    return " || chr(10) || ".join(parts)


def ordered_distinct_join(list_expr: str, sep: str, key_cols: str, src: str, alias: str) -> str:
    """CTE pieces: ordered de-dup of a list per key, joined by ``sep``."""
    return f"""{alias}_u AS (SELECT {key_cols}, u.t, u.pos FROM (SELECT {key_cols}, {list_expr} AS l FROM {src}) s,
                           unnest(s.l) WITH ORDINALITY AS u(t, pos)),
{alias}_f AS (SELECT {key_cols}, t, min(pos) AS pos FROM {alias}_u GROUP BY {key_cols}, t),
{alias} AS (SELECT k.*, coalesce((SELECT string_agg(t, '{sep}' ORDER BY pos) FROM {alias}_f f
                                   WHERE {' AND '.join(f'f.{c.strip()} = k.{c.strip()}' for c in key_cols.split(','))}), '') AS text
            FROM (SELECT DISTINCT {key_cols} FROM {src}) k)"""


_TEMPLATES = "(VALUES " + ", ".join(
    f"({sql_str(t)}, {i}, {sql_str(s)})" for t, tpl in _pr.CAPTION_TYPE_MAP.items() for i, s in enumerate(tpl)
) + ") AS tp(caption_type, slot, template)"
_TYPES = "[" + ", ".join(sql_str(t) for t in _pr.CAPTION_TYPE_MAP) + "]"
SQL["caption_prompts"] = f"""WITH req AS (
  SELECT {image_name('doc_id')} AS name, {_TYPES}[doc_id % {len(_pr.CAPTION_TYPE_MAP)} + 1] AS caption_type,
         CASE doc_id % 3 WHEN 0 THEN 'any' WHEN 1 THEN CAST(len({WORDS}) AS VARCHAR)
              ELSE CASE WHEN n_chars > 5000 THEN 'very long' ELSE 'short' END END AS caption_length,
         CASE WHEN lang = 'en' THEN {sql_str(_pr.NAME_OPTION)} END AS extra,
         CASE WHEN source IN ('src1', 'src2') THEN '{{NAME}}' ELSE concat('Char_', source) END AS nm
  FROM documents),
r AS (SELECT *, CASE WHEN caption_length = 'any' THEN 0 WHEN regexp_matches(caption_length, '^[0-9]+$') THEN 1 ELSE 2 END AS slot
      FROM req)
SELECT r.name, replace(replace(replace(CASE WHEN extra IS NULL THEN template ELSE concat(template, ' ', extra) END,
                                       '{{word_count}}', caption_length), '{{length}}', caption_length), '{{name}}', nm) AS prompt
FROM r JOIN {_TEMPLATES} ON r.caption_type = tp.caption_type AND r.slot = tp.slot"""

CTE["header_body"] = f"""header_body AS (
  SELECT event_id, CASE WHEN yi > 1 THEN replace(lower(parts[yi - 1]), ' ', '_') ELSE '' END AS uploader,
         {strip(_hb_body)} AS body
  FROM (SELECT event_id, parts, coalesce(list_position(list_transform(parts, lambda p: regexp_matches(p, '^\\d{{4}}$')), true), 0) AS yi
        FROM (SELECT event_id, list_filter(list_transform(string_split({_hb_header}, ', '), lambda p: {strip('p')}), lambda p: p <> '') AS parts
              FROM raw_posts)))"""
DEPS["header_body"] = ["raw_posts"]
_ARTIST_TEMPLATE = "Artists behind the post of <UPLOADER> (<POSTER>):\n<BODY>"
SQL["artist_prompts"] = with_("header_body") + f"""SELECT h.event_id,
  CASE WHEN e.event_type = 'click'
       THEN replace(replace(replace({sql_str(_ARTIST_TEMPLATE)}, '<UPLOADER>', h.uploader), '<POSTER>', h.uploader), '<BODY>', h.body)
       ELSE concat({sql_str(_pr.ARTIST_DEFAULT_INSTR)}, chr(10) || '### Uploader:' || chr(10), h.uploader,
                   chr(10) || '### Body:' || chr(10), h.body, chr(10) || '<|output|>' || chr(10)) END AS prompt
FROM header_body h JOIN events e ON h.event_id = e.event_id"""

CTE["filter_items"] = f"""filter_items AS (
  SELECT i.file AS image, c.text AS tag_text
  FROM image_inv i LEFT JOIN (SELECT name, text FROM captions WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'es')) c
    ON i.stem = c.name
  WHERE lower(i.ext) IN {_MODEL_EXTS})"""
DEPS["filter_items"] = ["image_inv", "captions"]
_UT = f"concat('Keep it short.' || chr(10) || chr(10), {normalize_delimiters('tag_text')})"
SQL["chat_requests"] = with_("filter_items") + f"""SELECT image,
  CASE WHEN tag_text IS NOT NULL THEN {_UT} END AS user_text,
  CASE WHEN tag_text IS NOT NULL THEN
    '[{{"role":"system","content":[{{"type":"text","text":' || to_json({sql_str(_pr.SYSTEM_PROMPT_BASE)}) ||
    '}}]}},{{"role":"user","content":[{{"type":"text","text":' || to_json({_UT}) ||
    '}},{{"type":"image_url","image_url":{{"url":' || to_json(image) || '}}}}]}}]' END AS request,
  CASE WHEN tag_text IS NULL THEN {sql_str(_pr.FILTER_NEEDS_TAGS)} END AS error
FROM filter_items"""

_FENCED = "(?s)```(?:\\w*\\n)?(.+?)```"
_REMOVED = "(?is)removed\\s*(?:are|:)\\s*(.+)"


def prune_reply_pieces(reply: str) -> str:
    head = f"strpos(lower({reply}), '**output:**')"
    parts = f"string_split(substr({reply}, {head} + 11), '```')"
    after_head = f"CASE WHEN {head} > 0 AND len({parts}) >= 2 THEN {strip(parts + '[2]')} ELSE '' END"
    block = (f"CASE WHEN regexp_matches({reply}, '{_FENCED}') THEN {strip(f'regexp_extract({reply}, {chr(39)}{_FENCED}{chr(39)}, 1)')} "
             f"ELSE '' END")
    removed = (f"CASE WHEN regexp_matches({reply}, '{_REMOVED}') THEN {strip(f'regexp_extract({reply}, {chr(39)}{_REMOVED}{chr(39)}, 1)')} "
               f"ELSE {strip(reply)} END")
    chosen = f"CASE WHEN {after_head} <> '' THEN {after_head} WHEN {block} <> '' THEN {block} ELSE {strip(removed)} END"
    bullets = "^[-*•\\t\\n\\x0B\\f\\r\\x{85}\\p{Z}]+"
    return comma_pieces(f"regexp_replace({chosen}, '{bullets}', '')")


SQL["parse_prune_reply"] = with_("replies") + f"""SELECT conv_id, turn, CAST(len(t) AS BIGINT) AS n_tags, array_to_string(t, ' | ') AS tags
FROM (SELECT conv_id, turn, {prune_reply_pieces('reply')} AS t FROM replies)"""

CTE["artist_replies"] = f"""artist_replies AS (
  SELECT conv_id, turn, concat('prompt ', conv_id, chr(10) || '<|output|>' || chr(10), array_to_string({WORDS}, ', '), ', ',
                               coalesce({WORDS}[1], '')) AS reply
  FROM conversations)"""
SQL["parse_artist_reply"] = with_("artist_replies") + ", " + ordered_distinct_join(
    comma_pieces(strip("string_split(reply, '<|output|>')[-1]")), ", ", "conv_id, turn", "artist_replies", "par") + """
SELECT conv_id, turn, text FROM par"""

_LINE_END = "[^\\n\\r\\x0B\\f\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]"
_first = strip(f"regexp_extract({strip('reply')}, '^({_LINE_END}*)', 1)")
SQL["parse_tag_reply"] = with_("replies") + f"""SELECT conv_id, turn,
  CASE WHEN {strip('reply')} <> '' THEN {strip(f"CASE WHEN starts_with({_first}, '-') THEN substr({_first}, 2) ELSE {_first} END")} END AS text
FROM replies"""

CTE["turn_captions"] = f"""turn_captions AS (
  SELECT conv_id, turn, array_to_string(list_transform(list_filter({WORDS}, lambda x: length(x) % 2 = 1),
                                          lambda x: concat(translate(substr(x, 1, 1), 'aeiou', 'AEIOU'), substr(x, 2))), ', ') AS text FROM conversations)"""
CTE["proposals"] = f"""proposals AS (
  SELECT r.conv_id, r.turn, {prune_reply_pieces('r.reply')} AS proposed, {comma_pieces('c.text')} AS tags,
         list_transform({comma_pieces('c.text')}, lambda x: lower(x)) AS tags_lower
  FROM replies r JOIN turn_captions c ON r.conv_id = c.conv_id AND r.turn = c.turn)"""
DEPS["proposals"] = ["replies", "turn_captions"]
SQL["guard_proposals"] = with_("proposals") + """SELECT conv_id, turn, CAST(len(k) AS BIGINT) AS n_kept, array_to_string(k, ' | ') AS kept
FROM (SELECT conv_id, turn, list_filter(proposed, lambda t: list_contains(tags_lower, lower(t))) AS k FROM proposals)"""
SQL["prune_tags"] = with_("proposals") + """, pr AS (
  SELECT conv_id, turn, list_filter(tags, lambda t: NOT list_contains(
           list_filter(proposed, lambda p: list_contains(tags_lower, lower(p))), t)) AS kept FROM proposals),
""" + ordered_distinct_join("kept", ", ", "conv_id, turn", "pr", "pt") + """
SELECT conv_id, turn, text FROM pt"""

_STUB_TAGS = f"list_filter(list_transform(string_split({strip('text')}, ','), lambda t: {strip('t')}), lambda t: length(t) >= 9)"
_STUB_REPLY = (f"'Sure.' || chr(10) || '**Output:**' || chr(10) || '```' || chr(10) || '- ' || "
               f"array_to_string(list_append({_STUB_TAGS}, 'zz_not_there'), ', ') || chr(10) || '```' || chr(10) || 'Done'")
SQL["model_hook"] = with_("captions") + f"SELECT name, {_STUB_REPLY} AS reply, CAST(NULL AS VARCHAR) AS error FROM captions"
SQL["prune_captions"] = with_("captions", "live") + f""", pc AS (
  SELECT name, {comma_pieces('text')} AS tags, {_STUB_TAGS} AS proposed FROM captions),
pl AS (SELECT name, tags, proposed, list_transform(tags, lambda x: lower(x)) AS tags_lower FROM pc),
pr AS (SELECT name, tags, list_filter(list_append(proposed, 'zz_not_there'), lambda p: list_contains(tags_lower, lower(p))) AS removed
       FROM pl),
pk AS (SELECT name, list_filter(tags, lambda t: NOT list_contains(removed, t)) AS kept FROM pr),
pu AS (SELECT k.name, u.tag, u.pos FROM pk k, unnest(k.kept) WITH ORDINALITY AS u(tag, pos)),
pf AS (SELECT name, tag, min(pos) AS pos FROM pu GROUP BY name, tag),
pcd AS (SELECT f.name, f.tag, f.pos, {code_sql('f.tag', 'l.category')} AS code FROM pf f LEFT JOIN live l ON lower({strip('f.tag')}) = l.name)
SELECT c.name, coalesce(string_agg(pcd.tag, ', ' ORDER BY {save_rank_sql('pcd.code')}, pcd.pos), '') AS text
FROM captions c LEFT JOIN pcd ON c.name = pcd.name GROUP BY c.name"""

SQL["artist_tags"] = with_("header_body") + """SELECT event_id,
  CASE WHEN uploader = '' THEN concat('guest_', length(body)) ELSE concat(uploader, ', guest_', length(body)) END AS text
FROM header_body"""

SQL["apply_transform"] = with_("captions") + "SELECT name, replace(replace(text, 'e', 'E'), 'a', 'A') AS text FROM captions"

CTE["scrape"] = """scrape AS (
  SELECT page_id, concat('page_', lpad(CAST(page_id AS VARCHAR), 8, '0')) AS stem, url,
         regexp_extract_all(lower(html), '\\p{L}+') AS w
  FROM pages)"""
CTE["ingested"] = """ingested AS (
  SELECT stem, concat(stem, CASE WHEN page_id % 2 = 0 THEN '.png' ELSE '.jpg' END) AS image,
    CASE page_id % 5 WHEN 0 THEN array_to_string(w, ', ') WHEN 1 THEN array_to_string(w, ', ')
                     WHEN 2 THEN concat('k_', page_id) WHEN 3 THEN NULL
                     ELSE CASE WHEN page_id % 2 = 0 THEN url END END AS caption,
    CASE WHEN page_id % 5 <> 4 THEN 'json' WHEN page_id % 2 = 0 THEN 'txt' END AS origin,
    CASE WHEN page_id % 5 = 3 THEN 'JSONDecodeError: invalid JSON' END AS error
  FROM scrape)"""
DEPS["ingested"] = ["scrape"]
SQL["ingest_scrape"] = with_("ingested") + "SELECT stem, image, caption, origin FROM ingested"
SQL["quarantine"] = with_("ingested") + "SELECT stem, error FROM ingested WHERE error IS NOT NULL"

CTE["stage"] = f"""stage AS (
  SELECT m.model, m.model_key, i.file AS image, i.stem,
         CASE WHEN NOT ends_with(i.stem, '7') THEN concat(m.model_key, '_', i.stem, ', solo') END AS text,
         CASE WHEN ends_with(i.stem, '7') THEN 'empty_reply' END AS error
  FROM image_inv i, (VALUES ('vendor/alpha', 'alpha'), ('lab/beta', 'beta')) AS m(model, model_key)
  WHERE lower(i.ext) IN {_MODEL_EXTS})"""
DEPS["stage"] = ["image_inv"]
SQL["multi_model_stage"] = with_("stage") + "SELECT model, model_key, image, stem, text, error FROM stage"
SQL["multi_model_resumed"] = SQL["multi_model_stage"]
SQL["batch_summary"] = with_("stage") + """SELECT model, CAST(count(*) FILTER (WHERE error IS NULL) AS BIGINT) AS processed,
  CAST(count(*) FILTER (WHERE error IS NOT NULL) AS BIGINT) AS failed,
  coalesce(string_agg(concat(image, ': ', error), chr(10) ORDER BY image) FILTER (WHERE error IS NOT NULL AND rn <= 20), '') AS first_failures
FROM (SELECT *, row_number() OVER (PARTITION BY model, error IS NULL ORDER BY image) AS rn FROM stage) GROUP BY model"""

SQL["curation_run_raw"] = with_("ingested") + f""", rc AS (SELECT stem AS name, caption AS text FROM ingested WHERE caption IS NOT NULL),
""" + ordered_distinct_join(split_caption("text"), ", ", "name", "rc", "merged") + f""",
pruned AS (SELECT m.name, array_to_string({comma_pieces('m.text')}[3:], ', ') AS text
           FROM merged m JOIN ingested i ON m.name = i.stem WHERE NOT ends_with(m.name, '7')),
""" + ordered_distinct_join(split_caption(strip("text")), ", ", "name", "pruned", "review") + """
SELECT name, CASE WHEN starts_with(text, 'abo') THEN text ELSE concat('abo, ', text) END AS text FROM review"""

# the two caption models give 'alpha_<stem>, solo' and 'beta_<stem>, solo'; pruning drops the first two tags
SQL["curation_run"] = with_("ingested") + """SELECT stem AS name, concat('abo, beta_', stem) AS text
FROM ingested WHERE NOT ends_with(stem, '7')"""

SQL["curation_rejects"] = with_("ingested") + """SELECT 'ingest' AS stage, CAST(NULL AS VARCHAR) AS model, image AS item, error
FROM ingested WHERE error IS NOT NULL
UNION ALL
SELECT 'prune', m.model, i.image, 'empty_reply' FROM ingested i, (VALUES ('team/gamma'), ('lab/delta')) AS m(model)
WHERE i.caption IS NOT NULL AND ends_with(i.stem, '7')"""

SQL["model_configs"] = """SELECT event_id, CAST(0 AS BIGINT) AS model_ord, concat('vendor/', event_type) AS model,
       concat('p', user_id) AS prompt FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 1, concat('lab/', user_id), NULL FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 0, concat('vendor/', event_type), NULL FROM events WHERE event_id % 3 = 1
UNION ALL SELECT event_id, 1, concat('lab/u', user_id), NULL FROM events WHERE event_id % 3 = 1
UNION ALL SELECT event_id, 2, 'team/z', NULL FROM events WHERE event_id % 3 = 1"""

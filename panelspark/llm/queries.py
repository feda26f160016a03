"""Named queries of the operators, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import decontaminate as leak
from panelspark.llm import cascade, cotrain, language, lines, mixing, neardup, neighbours, personal, resample, suffixes, tokens, trie
from panelspark.llm.shared import A_Z, a_z


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(_table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return personal.find_personal(docs, personal.train(docs))


def op5_suffix_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs, ~language.is_held_out())
    out = language.identify(docs, model)
    return out.select("doc_id", language.is_held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op10_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("kept_text").alias("kept_md5"))


def op11_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cascade.rate(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *cascade.REPORTED, "base_failed", "kept")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cotraining": op1_cotraining,
    "op2_bit_planes": op2_bit_planes,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_personal_data": op4_personal_data,
    "op5_suffix_columns": op5_suffix_columns,
    "op6_mix": op6_mix,
    "op7_decontaminate": op7_decontaminate,
    "op8_kmeans_tree": op8_kmeans_tree,
    "op9_language": op9_language,
    "op10_line_windows": op10_line_windows,
    "op11_rule_cascade": op11_rule_cascade,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_conversation_trie": op13_conversation_trie,
}

# CRC-32 in SQL: the table of 256 remainders, and the checksum of a text's UTF-8 bytes with that table as t
CRC_TABLE = """
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t"""


def _crc(text: str) -> str:
    byte = f"('0x' || substr(hex({text}), (2 * i + 1)::INT, 2))::BIGINT"
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hex({text})) // 2), lambda i: {byte})),"
        " lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::INT])))"
    )


SQL: dict[str, str] = {
    "op6_mix": """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h,
         coalesce('=' || source, 'null') AS src
  FROM documents),
s AS (SELECT src, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
w AS (SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, sum(source_size) OVER () AS total FROM s),
l AS (
  SELECT *, 3.0 * source_size AS cap,
    (total - coalesce(sum(3.0 * source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT src, source_size, least(cap, max(level) OVER () * w)::DOUBLE AS target,
        ('0x' || substr(md5('7|offset|' || src), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM l),
r AS (SELECT d.*, row_number() OVER (PARTITION BY src ORDER BY size, h, doc_id NULLS FIRST) AS k FROM d),
p AS (SELECT r.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM r JOIN t USING (src))
SELECT doc_id, size, source_size, target,
  (least(floor(k * rate + u) - floor((k - 1) * rate + u), 3)::BIGINT * size)::BIGINT AS taken
FROM p
""",
    "op10_line_windows": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
i AS (SELECT doc_id, lines, unnest(range(len(lines))) AS p FROM d),
w AS (SELECT doc_id, p, lines[p + 1] || chr(10) || lines[p + 2] || chr(10) || lines[p + 3] AS w FROM i WHERE p + 3 <= len(lines)),
r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS n FROM w
      WHERE trim(translate(w, chr(10) || chr(13) || chr(9), '   ')) <> ''),
c AS (SELECT DISTINCT doc_id, p + unnest([0, 1, 2]) AS p FROM r WHERE n > 1),
k AS (SELECT i.doc_id, count(c.p) AS gone, coalesce(string_agg(i.lines[i.p + 1], chr(10) ORDER BY i.p) FILTER (c.p IS NULL), '') AS kept
      FROM i LEFT JOIN c ON c.doc_id = i.doc_id AND c.p = i.p GROUP BY i.doc_id)
SELECT d.doc_id, CASE WHEN text = '' THEN 0 ELSE len(lines) END::BIGINT AS n_lines, gone::BIGINT AS n_removed, md5(kept) AS kept_md5
FROM d JOIN k USING (doc_id)
""",
    "op3_near_duplicates": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{A_Z}', '{a_z}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * m >= 85 * (nx.n + ny.n - m)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
""",
    "op11_rule_cascade": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d),
g AS (SELECT doc_id, p, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, g FROM g WHERE g IS NOT NULL GROUP BY doc_id, g HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, p + unnest([0, 1, 2]) AS p FROM g JOIN r USING (doc_id, g)) GROUP BY doc_id),
f AS (SELECT doc_id, sum(length(word) * n)::BIGINT AS word_chars, max(n) AS top, sum(n)::BIGINT AS n_words,
    coalesce(sum(n) FILTER (NOT regexp_matches(word, '[A-Za-z\\x{80}-\\x{10FFFF}]')), 0) AS letterless,
    coalesce(sum(n) FILTER (regexp_full_match(word, '[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*')), 0) AS shouted
  FROM (SELECT doc_id, word, count(*) AS n FROM w GROUP BY doc_id, word) GROUP BY doc_id),
a AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(letterless, 0) AS letterless, coalesce(shouted, 0) AS shouted, coalesce(top, 0) AS top
  FROM d LEFT JOIN f USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * letterless > 2 * n_words
    OR (n_lines >= 10 AND 10 * n_dup_lines > 3 * n_lines) OR 2 * shouted > n_words OR 10 * top > 3 * n_words) AS kept
FROM b
""",
    "op12_importance_resampling": f"""
WITH crc AS ({CRC_TABLE}),
x AS (SELECT 'd' AS side, doc_id, translate(coalesce(text, ''), '{A_Z}', '{a_z}') AS text FROM documents
  UNION ALL SELECT 't', NULL, translate(coalesce(text, ''), '{A_Z}', '{a_z}') FROM benchmark),
w AS (SELECT side, doc_id, word, count(*) AS n FROM (
  SELECT side, doc_id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM x) GROUP BY ALL),
v AS MATERIALIZED (SELECT word, {_crc('word')} % 10000 AS bucket FROM (SELECT DISTINCT word FROM w), crc),
h AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t
  FROM w JOIN v USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM h),
f AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM w JOIN v USING (word) JOIN g USING (bucket) WHERE side = 'd' GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(n_features, 0) AS n_features,
    CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
    ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h
  FROM documents LEFT JOIN f USING (doc_id)),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 10 * count(*) OVER () // 100 AS wanted FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight::BIGINT AS weight, score, CASE WHEN place <= wanted THEN place END AS rank FROM z LEFT JOIN k USING (doc_id)
""",
    "op13_conversation_trie": f"""
WITH crc AS ({CRC_TABLE}),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 20 AS lead, {_crc('conv_id::VARCHAR')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM o), crc),
r AS (SELECT c.conv_id, k, role, text FROM c JOIN o ON o.conv_id = c.lead AND k <= h
  UNION ALL SELECT c.conv_id, k, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND k > h),
q AS (SELECT conv_id, row_number() OVER b AS d, string_agg(md5(length(role) || ':' || role || text), '') OVER b AS p,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM r WINDOW b AS (PARTITION BY conv_id ORDER BY k)),
l AS (SELECT c.conv_id, coalesce(max(d), 0) AS len FROM c LEFT JOIN q USING (conv_id) GROUP BY c.conv_id),
m AS (SELECT conv_id, d, p, words FROM q UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (SELECT p, any_value(d) AS depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (len = d), '')) AS ends_sha256
  FROM m JOIN l USING (conv_id) GROUP BY p),
k AS (SELECT left(p, (32 * depth - 32)::INT) AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
a AS (SELECT left(n.p, (32 * unnest(range(depth + 1)))::INT) AS p, saved, (n_children IS NULL)::INT AS leaf FROM n LEFT JOIN k USING (p)),
s AS (SELECT p, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM a GROUP BY p)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (p) LEFT JOIN k USING (p) LEFT JOIN n u ON n.depth > 0 AND u.p = left(n.p, (32 * n.depth - 32)::INT) AND u.depth = n.depth - 1
""",
}

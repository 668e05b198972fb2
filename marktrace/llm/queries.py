"""The corpus operators as queries over the driver tables: name -> query, and DuckDB statements where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marktrace.llm.decontaminate import contamination
from marktrace.llm.hnsw import near_vectors
from marktrace.llm.licenses import TEMPLATES, license_matches, template_table
from marktrace.llm.lines import dedup_lines
from marktrace.llm.minhash import near_duplicates
from marktrace.llm.mixing import mix_sources
from marktrace.llm.packing import pack_documents
from marktrace.llm.pseudonyms import pseudonymise
from marktrace.llm.quality import quality_scores
from marktrace.llm.suffixes import remove_repeats
from marktrace.llm.tokens import token_counts
from marktrace.llm.tries import conversation_trie
from marktrace.llm.variants import spelling_variants
from marktrace.registry.base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: key of the registered query; a user passes a secret one
PSEUDONYM_KEY = "marktrace"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


@query("op1_embedding_near_dedup")
def op1(spark, sf):
    return near_vectors(table(spark, sf, "embeddings"))


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
LICENSE_SQL = f"""
WITH template AS (SELECT name AS license, {WORDS.replace("text", "body")} AS w FROM (VALUES {_VALUES}) t(name, body)),
gram AS (SELECT DISTINCT license, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM template)),
size AS (SELECT license, n, len(w) - 4 AS m FROM template JOIN (SELECT license, count(*) AS n FROM gram GROUP BY license) USING (license)),
doc AS (SELECT doc_id, i - 1 AS at_word, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents) d)),
hit AS (SELECT doc_id, license, n, at_word, g, at_word // m AS slot FROM doc JOIN gram USING (g) JOIN size USING (license)),
placed AS (SELECT *, unnest(CASE WHEN slot > 0 THEN [slot - 1, slot] ELSE [slot] END) AS win FROM hit),
counted AS (SELECT doc_id, license, win, count(DISTINCT g)::DOUBLE / any_value(n) AS share, min(at_word) AS first_word FROM placed GROUP BY doc_id, license, win)
SELECT doc_id, license, max(share) AS containment, min(first_word)::BIGINT AS first_word, count(*) AS n_windows FROM counted WHERE share >= 0.8 GROUP BY doc_id, license
"""


@query("op2_license_scan", LICENSE_SQL)
def op2(spark, sf):
    return license_matches(table(spark, sf, "documents"), template_table(spark, TEMPLATES))


@query("op3_best_fit_packing")
def op3(spark, sf):
    return pack_documents(table(spark, sf, "documents"))


@query("op4_suffix_array_dedup")
def op4(spark, sf):
    left = remove_repeats(table(spark, sf, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_quality_classifier")
def op5(spark, sf):
    scored = quality_scores(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op6_pii_pseudonyms")
def op6(spark, sf):
    return pseudonymise(table(spark, sf, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.*, common.k IS NOT NULL AND keyed.doc_id <> common.keeper AS gone FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op7_line_dedup", LINES_SQL)
def op7(spark, sf):
    kept = dedup_lines(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op8_minhash_near_dedup")
def op8(spark, sf):
    return near_duplicates(table(spark, sf, "documents")).select("doc_id", "class_id", "class_size", "kept")


@query("op9_token_counts")
def op9(spark, sf):
    return token_counts(table(spark, sf, "documents"))


CONTAMINATION_SQL = f"""
WITH item AS (SELECT item_id, {WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS body
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {WORDS} AS w FROM documents),
place AS (
  SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS body
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM windows))),
hit AS (SELECT doc_id, i, windows.size, item_id FROM place JOIN windows USING (body)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op10_benchmark_decontamination", CONTAMINATION_SQL)
def op10(spark, sf):
    marked = contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: CRC-32 of a decimal number or text of one-byte characters, by a table made from the published polynomial
CRC_SQL = """
RECURSIVE crc_bits(i, v, step) AS (
  SELECT range, range::BIGINT, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM crc_bits WHERE step < 8),
crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM crc_bits WHERE step = 8)"""


def crc_of(octets: str) -> str:
    """CRC-32 of a list of bytes; ``tab`` is the table of ``CRC_SQL``."""
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


VARIANT_SQL = rf"""
WITH {CRC_SQL},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
spelled AS (
  SELECT run, k, {crc_of("flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))")} AS h
  FROM counted, crc_table),
worded AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM spelled),
words AS (SELECT word, sum(k)::BIGINT AS n FROM worded WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
holed AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS u, b.word AS v, b.n AS n FROM holed a JOIN holed b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holed h JOIN words w ON w.word = h.rest
  UNION SELECT w.word, h.word, h.n FROM holed h JOIN words w ON w.word = h.rest),
near AS (SELECT u AS word, count(*) AS n_near, max(n) AS top FROM pairs GROUP BY u),
best AS (SELECT u AS word, min(v) AS best FROM pairs JOIN near ON near.word = u AND near.top = pairs.n GROUP BY u),
told AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * words.n THEN best END AS form, CASE WHEN top >= 2 * words.n THEN top END AS form_n
  FROM words LEFT JOIN near USING (word) LEFT JOIN best USING (word)),
walk(word, reached, step) AS (
  SELECT word, form, 1 FROM told WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, told.form, step + 1 FROM walk JOIN told ON told.word = walk.reached WHERE told.form IS NOT NULL),
ends AS (SELECT word, max_by(reached, step) AS root FROM walk GROUP BY word)
SELECT told.word, form, coalesce(root, told.word) AS root, n, n_near, form_n FROM told LEFT JOIN ends USING (word)
"""


@query("op11_spelling_variants", VARIANT_SQL)
def op11(spark, sf):
    return spelling_variants(table(spark, sf, "documents"))


TRIE_SQL = rf"""
WITH {CRC_SQL},
raw AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role)::VARCHAR || ':' || role || text)) AS pos FROM raw),
sizes AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
heads AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc_of("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 4 AS h FROM sizes, crc_table),
plan AS (SELECT h.conv_id, base, h, least(h, coalesce(b.n, 0)) AS lent FROM heads h LEFT JOIN sizes b ON b.conv_id = base),
new AS (
  SELECT plan.conv_id, pos, role, text FROM plan JOIN turns ON turns.conv_id = base AND pos <= h
  UNION ALL SELECT plan.conv_id, pos - h + lent, role, text FROM plan JOIN turns ON turns.conv_id = plan.conv_id AND pos > h),
chained AS (SELECT conv_id, pos, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM new),
place AS (SELECT conv_id, pos AS depth, words, md5(path::VARCHAR) || '-' || pos AS id FROM chained UNION ALL SELECT conv_id, 0, 0, 'root' FROM sizes),
node AS (SELECT id, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n FROM place GROUP BY id),
linked AS (
  SELECT node.*, up.id AS parent, first.conv_id AS parent_conv_id
  FROM node LEFT JOIN place up ON up.conv_id = node.conv_id AND up.depth = node.depth - 1 LEFT JOIN node first ON first.id = up.id),
childless AS (SELECT id, id NOT IN (SELECT parent FROM linked WHERE parent IS NOT NULL) AS leaf FROM linked),
below AS (
  SELECT up.id, sum(leaf::BIGINT) AS n_leaves, sum((node.n - 1) * node.words) AS saved_tokens
  FROM node JOIN childless USING (id) JOIN place up ON up.conv_id = node.conv_id AND up.depth <= node.depth GROUP BY up.id),
kids AS (SELECT parent AS id, count(*) AS n_children FROM linked GROUP BY parent),
ends AS (SELECT id, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(id, depth) AS id FROM place GROUP BY conv_id) GROUP BY id)
SELECT conv_id, linked.depth::BIGINT AS depth, parent_conv_id, n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM linked JOIN below USING (id) LEFT JOIN kids USING (id) LEFT JOIN ends USING (id)
"""


@query("op12_conversation_trie", TRIE_SQL)
def op12(spark, sf):
    return conversation_trie(table(spark, sf, "conversations"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS k
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM d GROUP BY source),
dealt AS (SELECT source, s, ([3.0, 1.0, 2.0]::DOUBLE[])[(turn - 1) % 3 + 1] AS w FROM src),
stops AS (SELECT source, (SELECT sum(least(2.0 * b.s, 2.0 * a.s / a.w * b.w)) FROM dealt b) < 1.5 * (SELECT sum(s) FROM dealt) AS stopped FROM dealt a),
level AS (
  SELECT (1.5 * sum(s) - 2 * coalesce(sum(s) FILTER (WHERE stopped), 0)) / sum(w) FILTER (WHERE NOT stopped) AS l
  FROM dealt JOIN stops ON dealt.source IS NOT DISTINCT FROM stops.source),
aimed AS (SELECT source, s, least(2.0 * s, (SELECT l FROM level) * w) AS target FROM dealt),
plan AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS base, floor(target * 0.001)::BIGINT AS tol FROM aimed),
budget AS (SELECT *, floor(target - base * s)::BIGINT AS rest FROM plan),
listed AS (
  SELECT budget.source, any_value(rest) AS rest, any_value(tol) AS tol, list(doc_id ORDER BY k, doc_id) AS ids, list([size]::BIGINT[] ORDER BY k, doc_id) AS sizes
  FROM d JOIN budget ON d.source IS NOT DISTINCT FROM budget.source GROUP BY budget.source),
walked AS (
  SELECT ids, list_reduce(list_concat([[rest, CASE WHEN rest > tol THEN 9223372036854775807 ELSE 0 END, tol]::BIGINT[]], sizes), lambda a, x:
    CASE WHEN x[1] = 0 OR x[1] > a[2] THEN list_concat(a, [0::BIGINT])
         WHEN x[1] <= a[1] THEN list_concat([a[1] - x[1], a[2], a[3]], a[4:], [1::BIGINT])
         ELSE list_concat([a[1], CASE WHEN a[1] > a[3] THEN a[1] ELSE 0 END, a[3]], a[4:], [0::BIGINT]) END) AS r
  FROM listed),
extra AS (SELECT unnest(ids) AS doc_id, unnest(r[4:]) AS more FROM walked)
SELECT d.doc_id, size, s AS source_size, target, (base + more) * size AS taken
FROM d JOIN budget ON d.source IS NOT DISTINCT FROM budget.source JOIN extra USING (doc_id)
"""


@query("op13_source_mixing", MIX_SQL)
def op13(spark, sf):
    return mix_sources(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")

"""The registered queries of this subpackage: opN_<name> and pipeline, with their DuckDB twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm import (
    backoff_lm, decontaminate, fertility, fill_in_middle, line_bitmaps, ngram_jaccard, packing, prefix_trie, secret_scan, suffix_dedup,
    token_orc, unit_dedup, warc_revisit)
from basketlens.llm.common import read_table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(read_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op2_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_revisit.resolve_revisits(warc_revisit.page_records(read_table(spark, sf_dir, "pages")))
    return out.withColumn("headers", warc_revisit.headers_text(F.col("headers")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read_table(spark, sf_dir, "documents")).drop("kept")


def op4_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of one to five words, four back-off steps."""
    out = backoff_lm.backoff_scores(read_table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 4) for c in ("log_score", "mean_log_score")})


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.tokens_round_trip(read_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that has a word is a unit, however short."""
    return unit_dedup.unit_dedup(read_table(spark, sf_dir, "documents")).drop("kept_text")


def op7_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility_quality(read_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(read_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("hits", "items")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return prefix_trie.branched_trie(read_table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed, and restored from what was written."""
    out = fill_in_middle.restore(fill_in_middle.fill_in_middle(read_table(spark, sf_dir, "documents")))
    return out.drop("pieces", "output", "restored")


def op13_line_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep bitmaps of all documents, applied to them."""
    return line_bitmaps.line_dedup(read_table(spark, sf_dir, "documents")).drop("kept_text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_ngram_jaccard, op2_warc_revisit, op3_suffix_dedup, op4_stupid_backoff, op5_token_orc, op6_line_dedup,
        op7_tokeniser_fertility, op8_secret_scan, op9_decontamination, op10_best_fit_packing,
        op11_prefix_trie, op12_fill_in_middle, op13_line_bitmaps)}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = "'[^\\x20\\x09-\\x0D]+'"

_OP2 = r"""
WITH p AS (SELECT * FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL),
rec AS (
  SELECT page_id * 2 AS record_id, url, page_id AS captured, 'response' AS type, md5(html) AS etag,
         NULL::VARCHAR AS last_modified, md5(html) AS payload_digest,
         [{'k': 'Content-Type', 'v': 'text/html'}, {'k': 'ETag', 'v': md5(html)}] AS h
  FROM p UNION ALL
  SELECT page_id * 2 + 1, regexp_extract(url, '^[^:]+://[^/?#]+(/[a-z]{2})?'), page_id,
         CASE WHEN page_id % 5 = 0 THEN 'response' ELSE 'revisit' END,
         CASE WHEN page_id % 11 < 9 THEN (CASE WHEN page_id % 2 = 0 THEN 'W/' ELSE '' END) || '"v' || (page_id // 50) || '"' END,
         CASE WHEN page_id % 11 < 10 THEN 'day ' || (page_id // 50) END,
         CASE WHEN page_id % 5 = 0 THEN md5(html) END,
         [{'k': 'Date', 'v': page_id::VARCHAR}, {'k': 'content-length', 'v': length(html)::VARCHAR},
          {'k': 'Server', 'v': 's' || (page_id % 3)}]
  FROM p),
u AS (SELECT *, regexp_replace(regexp_replace(trim(url, ' '), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM rec),
c AS (
  SELECT *, regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www\.|:(80|443)$', '', 'g')
    || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '^[^/?]*', ''),
         '([?&])(utm_[a-z]+|gclid|fbclid|ref)=[^&]*', '\1', 'g'), '&+', '&', 'g'), '\?&', '?', 'g'), '[?&/]+$', '') AS canonical_url
  FROM u),
r AS (
  SELECT *, last_value(CASE WHEN type = 'response' THEN {'id': record_id, 'etag': etag, 'lm': last_modified,
      'digest': payload_digest, 'h': h} END IGNORE NULLS) OVER (
      PARTITION BY canonical_url ORDER BY captured, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ref
  FROM c),
s AS (
  SELECT *, CASE WHEN type = 'response' THEN 'full' WHEN ref IS NULL THEN 'unresolved'
      WHEN etag IS NOT NULL AND ref.etag IS NOT NULL THEN
        CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(ref.etag, '^W/', '') THEN 'resolved' ELSE 'validator_mismatch' END
      WHEN last_modified IS NOT NULL AND ref.lm IS NOT NULL THEN
        CASE WHEN last_modified = ref.lm THEN 'resolved' ELSE 'validator_mismatch' END
      ELSE 'unvalidated' END AS status
  FROM r),
m AS (
  SELECT *, list_filter(h, lambda x: lower(x.k) IN ('cache-control', 'content-location', 'date', 'etag', 'expires', 'last-modified', 'vary')) AS upd
  FROM s)
SELECT record_id, canonical_url, captured, type, status,
  CASE WHEN status IN ('resolved', 'validator_mismatch', 'unvalidated') THEN ref.id END AS refers_to,
  CASE WHEN status = 'resolved' THEN ref.digest WHEN type = 'response' THEN payload_digest END AS payload_digest,
  array_to_string(list_transform(list_sort(CASE WHEN status = 'resolved' THEN list_concat(
      list_filter(ref.h, lambda x: NOT list_contains(list_transform(upd, lambda y: lower(y.k)), lower(x.k))), upd) ELSE h END),
    lambda x: x.k || '=' || x.v), ';') AS headers
FROM m
"""

_GRAM = ", ".join(f"CASE WHEN i >= {k} THEN array_to_string(w[i - {k - 1}:i], ' ') END AS g{k}" for k in range(1, 6))
_OP4 = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_WORD}) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t WHERE len(w) > 0),
g AS (SELECT doc_id, i, {_GRAM} FROM p),
c AS (SELECT *, count(*) OVER () AS n, {", ".join(f"count(*) OVER (PARTITION BY g{k}) AS n{k}" for k in range(1, 6))} FROM g),
x AS (SELECT *, {", ".join(f"lag(n{k}) OVER d AS x{k}" for k in range(1, 5))} FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
s1 AS (SELECT *, ln(n1) - ln(n) AS l1 FROM x),
{" ".join(f"""s{k} AS (SELECT *, CASE WHEN g{k} IS NULL THEN l{k - 1} WHEN n{k} >= 2 THEN ln(n{k}) - ln(x{k - 1})
  ELSE ln(0.4) + l{k - 1} END AS l{k} FROM s{k - 1}),""" for k in range(2, 6))}
y AS (SELECT doc_id, sum(l5) AS l, count(*) FILTER (g5 IS NOT NULL AND n5 < 2) AS k FROM s5 GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(k, 0)::BIGINT AS n_backoffs, round(coalesce(l, 0), 4) AS log_score,
  round(l / len(w), 4) AS mean_log_score
FROM t LEFT JOIN y ON y.doc_id = t.doc_id
"""

_OP6 = f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM t),
v AS (
  SELECT *, array_to_string(regexp_extract_all(translate(line, {_AZ}), {_WORD}), ' ') AS w,
    (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(line) - 1)::BIGINT AS s
  FROM u),
x AS (SELECT *, w <> '' AS unit, w <> '' AND row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) > 1 AS gone,
    w <> '' AND count(*) OVER (PARTITION BY w) > 1 AS again FROM v)
SELECT doc_id, count(*) FILTER (unit) AS n_units, count(*) FILTER (gone) AS n_removed, count(*) FILTER (again) AS n_repeated,
  coalesce(max(len(string_split(w, ' '))) FILTER (again), 0)::BIGINT AS longest_repeat,
  coalesce(string_agg(s || ':' || (s + length(line)), ',' ORDER BY pos) FILTER (gone), '') AS removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id
"""

#: CRC-32 of a decimal string, bit by bit: after each character, eight steps that are marked by -1.
_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
    lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))::BIGINT[]),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""

_OP11 = f"""
WITH o AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS t, ({_CRC} % 9)::BIGINT AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
c AS (
  SELECT o.conv_id, list_concat(coalesce(b.t[1:o.h], []), o.t[o.h + 1:]) AS t
  FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 5),
m AS (SELECT conv_id, len(t) AS ends, unnest(range(len(t) + 1)) AS depth, t FROM c),
n AS (
  SELECT depth, t[1:depth] AS k, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * coalesce(strlen(any_value(t)[depth].t), 0) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends = depth), '')) AS ends_sha256
  FROM m GROUP BY 1, 2),
p AS (
  SELECT n.*, u.conv_id AS parent_conv_id
  FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.k = n.k[1:n.depth - 1]),
g AS (SELECT parent_conv_id, depth - 1 AS depth, count(*) AS n FROM p WHERE depth > 0 GROUP BY 1, 2),
q AS (SELECT p.*, coalesce(g.n, 0)::BIGINT AS n_children FROM p LEFT JOIN g ON g.parent_conv_id = p.conv_id AND g.depth = p.depth),
a AS (SELECT unnest(range(depth + 1)) AS depth, k, n_children, saved FROM q),
s AS (SELECT depth, k[1:depth] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM a GROUP BY 1, 2)
SELECT conv_id, q.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM q JOIN s ON s.depth = q.depth AND s.k = q.k
"""

_OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS x
  FROM documents),
h AS (
  SELECT *, len(u) AS n, [('0x' || x[8 * k + 1:8 * k + 8])::BIGINT FOR k IN range(4)] AS h FROM d),
c AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

_OP13 = """
WITH u AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents WHERE doc_id IS NOT NULL),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS key FROM u),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
x AS (SELECT k.*, g.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN g ON g.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id
"""

#: The others have no SQL form that runs on whole tables (tokenisers, automata, similarity joins): they are tested
#: against brute-force versions.
ORACLE_SQL: dict[str, str] = {
    "op2_warc_revisit": _OP2, "op4_stupid_backoff": _OP4, "op6_line_dedup": _OP6, "op11_prefix_trie": _OP11,
    "op12_fill_in_middle": _OP12, "op13_line_bitmaps": _OP13}

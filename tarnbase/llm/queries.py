"""Queries of this subpackage for the registry, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, entropy_mix, fm_quality, licences, pii_feistel, quality_rules, recompress, secret_scan, simhash_bk, warc


SYNTHETIC_KEY = "for synthetic tables only"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = fm_quality.score_quality(docs, labels)
    return scored.select("doc_id", fm_quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality_rules.apply_rules(docs)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def op3_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.entropy_mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op5_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_bk.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_bk.as_hex().alias("fingerprint"), "component_id")


def op6_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's setting; the synthetic tables, which hold nobody's data, get along with the one named here."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_feistel.pseudonymise(docs, spark.conf.get("spark.tarnbase.pii.key", SYNTHETIC_KEY))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents"), with_text=False)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_fm_quality, op2_quality_rules, op3_entropy_mix, op4_license_scan, op5_simhash_bk, op6_pii_feistel, op7_secret_scan, op8_decontaminate, op9_warc, op10_recompression)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_STOPS = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))

_RULES_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({_STOPS})))::BIGINT AS n_stop_words, len(l)::BIGINT AS n_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')))::BIGINT AS n_bullet_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines
  FROM d LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 1500 * n_words AND 100 * n_symbols <= 10 * n_words
       AND 100 * n_stop_words >= 2 * n_words AND 100 * n_dup_lines <= 60 * n_lines AND 100 * n_bullet_lines <= 90 * n_lines
       AND 100 * n_ellipsis_lines <= 30 * n_lines AS kept,
       n_stop_words, n_lines, n_bullet_lines, n_ellipsis_lines
FROM b"""


def _canonical_sql(x: str) -> str:
    out = f"regexp_replace(lower({x}), '{licences.COPYRIGHT_LINE}', ' ', 'g')"
    for a, b in licences.SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '{licences.NOT_TEXT}', ' ', 'g'))"


_KNOWN = ", ".join(f"('{d}', '{k}', {str(w).lower()})" for d, k, w in licences.digest_rows())
_LICENCES_SQL = rf"""
WITH known(digest, licence, whole) AS (VALUES {_KNOWN}),
d AS (SELECT doc_id, sha256({_canonical_sql("coalesce(text, '')")}) AS digest,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '(?i)licen[sc]e')) AS l FROM documents),
lines AS (SELECT doc_id, sha256({_canonical_sql("x")}) AS digest FROM (SELECT doc_id, unnest(l) AS x FROM d)),
hits AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM lines JOIN known USING (digest) WHERE NOT whole GROUP BY doc_id)
SELECT doc_id, d.digest, w.licence AS license_id, coalesce(hits.notices, '') AS notices
FROM d LEFT JOIN (SELECT * FROM known WHERE whole) w ON w.digest = d.digest LEFT JOIN hits USING (doc_id)"""

_REPEATS_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM windows) WHERE c > 1),
covered AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM twice)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

# A base32 character is five bits; five hex digits hold four of them.
_ARCHIVES_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT page_id, t, h, max(page_id) OVER (PARTITION BY t) AS last FROM p)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, 5 * (i // 4)::INTEGER + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1), 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM m"""

ORACLE_SQL: dict[str, str] = {"op2_quality_rules": _RULES_SQL, "op4_license_scan": _LICENCES_SQL, "op9_warc": _ARCHIVES_SQL, "op10_recompression": _REPEATS_SQL}

"""The registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, mixing, quality, simhash, substring_dedup, suffix_dedup, toxicity, urlfilter, warc
from .common import Workspace, table

#: The tokenizer that queries use; its place is a parameter of the operator.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Rules of op9, in the contract's words.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), Workspace(spark, "op1"), every=100, k=10)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(table(spark, sf_dir, "documents"), Workspace(spark, "op2"))
    return rows.select(F.col("_doc").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_line_words", "base_failed", "kept")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), Workspace(spark, "op4")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"), Workspace(spark, "op5"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "op6")
    index = warc.write_archives(table(spark, sf_dir, "pages"), work)
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), Workspace(spark, "op7")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"), Workspace(spark, "op8"), carry=["doc_id"])
    return rows.select("_row.doc_id", "size", "source_size", "target", "taken")


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"), Workspace(spark, "op10")).select("doc_id", "fingerprint", "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_ann, op2_quality, op3_bpe, op4_toxicity, op5_suffix_dedup, op6_warc, op7_substring_dedup, op8_mixing, op9_urlfilter, op10_simhash)
    return {f.__name__: f for f in own}


_WORDS = r"""
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
w AS (SELECT rid, doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM l)"""

_QUALITY = (
    r"WITH"
    + _WORDS
    + r""",
g AS (SELECT rid, i, word AS a, lead(word, 1) OVER p AS b, lead(word, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
cover AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
counts AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY rid),
raw AS (SELECT rid, doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT rid, doc_id, host, text, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
held AS (SELECT host, norm, count(*) AS n FROM (SELECT DISTINCT host, norm, doc_id, text FROM lines) GROUP BY host, norm),
copies AS (SELECT host, text, count(*) AS n FROM (SELECT DISTINCT host, text, doc_id FROM d) GROUP BY host, text),
cut AS (SELECT rid, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS n FROM lines JOIN held USING (host, norm) JOIN copies USING (host, text) WHERE held.n - copies.n >= 20 GROUP BY rid),
s AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(cut.n, 0)::BIGINT AS n_line_words
  FROM d LEFT JOIN counts USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN cover USING (rid) LEFT JOIN cut USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (2 * n_line_words > n_words) AS kept FROM s"""
)

_WARC = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""

_SUBSTRING = (
    "WITH"
    + _WORDS
    + r""",
g AS (SELECT rid, doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM l WHERE len(words) >= 13),
k AS (SELECT rid, doc_id, i, array_to_string(words[i:i + 12], ' ') AS key FROM g),
m AS (SELECT key, min(doc_id) AS least FROM k GROUP BY key),
gone AS (SELECT rid, i FROM k JOIN m USING (key) WHERE doc_id > least),
marked AS (SELECT w.rid, w.word, w.i, max(gone.i) OVER (PARTITION BY w.rid ORDER BY w.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) IS NOT NULL AS removed
  FROM w LEFT JOIN gone ON w.rid = gone.rid AND w.i = gone.i),
kept AS (SELECT rid, count(*) AS n_words, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS text FROM marked GROUP BY rid)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)"""
)

_MIXING = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents),
k AS (SELECT *, -ln((('0x' || substr(md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, '-'), digest)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496)
  / (0.25::DOUBLE + 0.75::DOUBLE * least(size, 400) / 400) AS key FROM d),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM t),
c AS (SELECT *, sum(source_size) OVER () AS total, row_number() OVER o AS n,
  coalesce(sum(3::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
v AS (SELECT *, (total - capped) / rest AS level FROM c),
free AS (SELECT arg_min(level, n) AS level FROM v WHERE NOT level * weight > 3 * source_size),
a AS (SELECT v.source, source_size, CASE WHEN v.level * weight > 3 * source_size THEN 3.0::DOUBLE * source_size ELSE coalesce(free.level * weight, 0) END AS target FROM v, free),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size + 1e-9), 3) ELSE 0 END::BIGINT AS epochs FROM a),
x AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
  sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id, digest ROWS UNBOUNDED PRECEDING) - k.size AS ahead
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, ((epochs + CASE WHEN epochs < 3 AND size > 0 AND ahead + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM x"""

_URLS = r"""
WITH s AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
r(rule, rule_host, rule_path, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
f AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f ON p.host = f.host AND p.path = f.path"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality": _QUALITY, "op6_warc": _WARC, "op7_substring_dedup": _SUBSTRING, "op8_mixing": _MIXING, "op9_urlfilter": _URLS}

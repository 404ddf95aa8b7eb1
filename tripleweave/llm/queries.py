"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleweave.llm import decontamination, html_extraction, language_id, mixing, pii, quality, simhash, suffix_dedup, tokens, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_tokenizer() -> str:
    """The file of the tokenizer that the token query encodes with."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "soft_weight")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extracted(_read(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymized(_read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(_read(spark, sf_dir, "documents")).drop("spans")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~held_out))
    return language_id.predicted(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenized(_read(spark, sf_dir, "documents"), word_tokenizer())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixed(docs.withColumn("n_mass", mixing.text_mass()).drop("text"), mass=F.col("n_mass")).select("doc_id", "source", "n_mass", "copy", "shuffle_key")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(_read(spark, sf_dir, "documents"))
    bits = F.col("fail_bits")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality.verdict(bits, "base")).alias("base_failed"), quality.verdict(bits).alias("kept"), "fail_bits")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_urls": op1_urls,
    "op2_simhash": op2_simhash,
    "op3_html": op3_html,
    "op4_pii": op4_pii,
    "op5_decontamination": op5_decontamination,
    "op6_suffix": op6_suffix,
    "op7_language": op7_language,
    "op8_tokens": op8_tokens,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _oracle_op1() -> str:
    strict = "|".join(url_filter.STRICT)
    soft = ", ".join(f"(CASE WHEN regexp_matches(lower(host || path), '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])') THEN {w} ELSE 0 END)" for t, w in url_filter.SOFT.items())
    rules = ", ".join(f"('{v}', '{t}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}')" for v, t in url_filter.CONTRACT_RULES)
    return f"""
WITH p AS (
  SELECT page_id, {_LOWER.format("regexp_extract(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^[^/?#]*')")} AS host,
         regexp_extract(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
q AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path FROM p),
r(v, t, h, b) AS (VALUES {rules}),
m AS (
  SELECT q.*, arg_max(r.t, length(r.t)) AS rule, arg_max(r.v, length(r.t)) AS ruled
  FROM q LEFT JOIN r ON (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.b)
  GROUP BY ALL),
w AS (SELECT *, regexp_matches(lower(host || path), '(^|[^\\p{{L}}\\p{{N}}])({strict})($|[^\\p{{L}}\\p{{N}}])') AS s, [{soft}] AS f FROM m)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN s OR (len(list_filter(f, lambda x: x > 0)) > 1 AND list_sum(f) >= {url_filter.SOFT_LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict,
       list_sum(f)::BIGINT AS soft_weight
FROM w"""


def _oracle_op5() -> str:
    words = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
x AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 8 THEN [w] ELSE list_transform(range(1, len(w) - 6), lambda i: w[i:i + 7]) END) AS k FROM b),
k AS (SELECT k, list(item_id) AS ids, len(k) AS m FROM x GROUP BY k),
n AS (SELECT DISTINCT m FROM k),
c AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, n WHERE len(w) >= m),
h AS (SELECT c.doc_id, c.i, c.m, k.ids FROM c JOIN k ON c.w[c.i:c.i + c.m - 1] = k.k),
s AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list_distinct(flatten(list(ids)))::VARCHAR[]) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(len(ids), 0) >= {decontamination.MIN_ITEMS} AS contaminated
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _oracle_op9() -> str:
    unit = "('0x' || substr(md5({}), 1, 13))::BIGINT / (1::BIGINT << 52)::DOUBLE"
    name = f"('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, length(coalesce(text, ''))::BIGINT + 1 AS n_mass FROM documents),
m AS (SELECT source, sum(n_mass)::BIGINT AS mass FROM d GROUP BY source),
a AS (SELECT sum(mass)::DOUBLE AS everything, sum(pow(mass::DOUBLE, {mixing.ALPHA})) AS shares FROM m),
r AS (SELECT source, everything * pow(mass::DOUBLE, {mixing.ALPHA}) / shares / mass AS rate FROM m, a),
q AS (SELECT source, greatest(ceil(rate / {mixing.MEAN}), 1)::BIGINT AS parts, rate / greatest(ceil(rate / {mixing.MEAN}), 1) AS mu FROM r),
c AS (SELECT source, 0 AS k, mu, exp(-mu) AS p, exp(-mu) AS cdf FROM q
      UNION ALL SELECT source, k + 1, mu, p * mu / (k + 1), cdf + p * mu / (k + 1) FROM c WHERE k < {mixing.TERMS}),
l AS (SELECT source, list(cdf ORDER BY k) AS cdfs FROM c GROUP BY source),
n AS (SELECT doc_id, d.source, n_mass, list_sum(list_transform(range(1, parts + 1), lambda i: len(list_filter(cdfs, lambda x: x <= {unit.format(f"{name} || i::VARCHAR")})))) AS n
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN l ON d.source IS NOT DISTINCT FROM l.source),
e AS (SELECT doc_id, source, n_mass, unnest(range(1, n::BIGINT + 1)) AS copy FROM n)
SELECT doc_id, source, n_mass, copy::INTEGER AS copy, md5({name} || 'copy|' || copy::VARCHAR) AS shuffle_key FROM e"""


def _oracle_op10() -> str:
    m = ", ".join(quality.MEASURES)
    bits = " | ".join(f"(CASE WHEN {rule} THEN {1 << i} ELSE 0 END)" for i, (_, rule) in enumerate(quality.RULES))
    return rf"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
l AS (SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines,
        CASE WHEN len(w) < 8 THEN [] ELSE list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) END AS v FROM a),
g AS (SELECT doc_id, count(DISTINCT j) AS n FROM (
        SELECT doc_id, unnest(range(i, i + 8)) AS j FROM (
          SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM (SELECT doc_id, unnest(v) AS k, unnest(range(1, len(v) + 1)) AS i FROM l)) WHERE c > 1) GROUP BY doc_id),
n AS (SELECT l.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(g.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM l LEFT JOIN g USING (doc_id)),
f AS (SELECT doc_id, {m}, ({bits})::BIGINT AS fail_bits FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {quality.mask("base")}) <> 0 AS base_failed, (fail_bits & {quality.mask(quality.PRODUCTION)}) = 0 AS kept, fail_bits FROM f"""


def oracle_sql() -> dict[str, str]:
    return {"op1_urls": _oracle_op1(), "op5_decontamination": _oracle_op5(), "op9_mixing": _oracle_op9(), "op10_quality": _oracle_op10()}
